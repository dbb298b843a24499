"""Quality rules with a language model: word and line statistics, and perplexity bands by language.

Each language has a modified Kneser-Ney model whose highest order is the whole word and whose lower orders spell it:

* Words, as they are written, with their counts over the corpus; counts are lessened by the discounts D1, D2 and D3+ that the
  counts of counts give. What that frees goes to the spelling model.
* Spelling: modified Kneser-Ney of order 4 over 48 symbols (UTF-8 bytes, letters in one case, digits, rare marks and parts
  of longer characters folded). At most 48^4 n-grams a language, whatever the corpus.

1. Spark counts the 4-grams (dense counts inside a task, then a sum by language and n-gram); one task per language turns its
   bounded counts into sorted arrays of n-grams and contexts, in the shared folder.
2. Words are counted in the same pass. Their number grows with the corpus, so no task holds them all: every partition sums up its own
   words and deals them, as sorted arrays of 64-bit hashes with counts, over ranges of hashes. A range's task merges the
   arrays and answers each partition that asked: a sorted array of that partition's words with their counts in the whole
   corpus. So a worker looks words up in sorted arrays no larger than its own partition's words, and nothing is broadcast.
3. A document's score is the mean over its words of their negative log probability by byte; its own words are taken off the counts, so
   that scores are held out. The second score is the spelling model's alone.
4. The bands of a language: ``lower_width`` and ``upper_width`` robust deviations around the median word score, and
   ``spelling_width`` below the median spelling score, over all its documents that pass the plain rules.

Answers belong to partitions, so the rows that are judged must be those that the rules were fitted on, in the same partitions: as
read from files they are. A word without an answer stops the job rather than be guessed. Input whose plan has an exchange is
written to the shared folder first (``fit_rules`` keeps that table; ``Rules.documents`` reads it).

Defined cases: a null or empty text has no words, so it fails the plain rules; a null language is a language of its
own, as is the empty string; a language whose texts are all empty has no model, its texts fail the plain rules anyway; rows with null
or repeated ids are judged one by one; an empty table gives an empty result; other columns are ignored, or
kept as they are where documents are filtered.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, scratch_path
from .worker import file_system, per_worker, release_memory

ORDER = 4
SYMBOLS = 48
PAD = b"\n\n\n"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
UPPER_WIDTH = 4.0
LOWER_WIDTH = 4.8
SPELLING_WIDTH = 6.0
LEAST_DEVIATION = 0.02  # of log perplexity by byte, in nats
LEAST_RANGES, MOST_RANGES = 8, 16_384
STRETCH = 1 << 20  # bytes that are looked at together
COMPACT = 1 << 21  # words of a partition that wait to be summed up
TABLES_HELD = 8
MOST_COUNTED = 1 << 32  # bytes that 32-bit counts are safe for


def _symbol_table() -> np.ndarray:
    """Symbol of each byte: 26 letters, white space (2), digits, marks (9), other ASCII, controls, parts of longer characters (8)."""
    table = np.full(256, 38, dtype=np.int32)  # other ASCII
    table[:32] = table[127] = 39
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = i
    table[[32, 9, 11, 12, 13]] = 26
    table[10] = 27
    table[ord("0") : ord("9") + 1] = 28
    for i, marks in enumerate((".", ",", "'", '"', "-", ":", ";", "!?", "()")):
        table[[ord(mark) for mark in marks]] = 29 + i
    table[128:192] = 42 + np.arange(64) % 6
    table[192:196] = 40
    table[196:] = 41
    return table


def text_codes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code of the 4-gram that ends at each byte of the concatenated texts; ``ends`` are their bounds, with 0 in front."""
    symbols = _symbol_table()
    s = np.insert(symbols[data], np.repeat(ends[:-1], 3), symbols[PAD[0]])
    codes = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
    sizes = np.diff(ends)
    return codes[np.arange(len(data)) + 3 * np.repeat(np.arange(len(sizes)), sizes)]


def _codes(data: bytes) -> np.ndarray:
    """Code of the 4-gram that ends at each byte behind the first three."""
    s = _symbol_table()[np.frombuffer(data, dtype=np.uint8)]
    return ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]


def _lang_key(lang):
    """A language as a key that tells null from the empty string."""
    return F.when(lang.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), lang.cast("string")))


_BASE = 0x9E3779B97F4A7C15 | 1
_WHITE_BYTE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def word_places(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of the concatenated texts that begin at ``starts``."""
    inside = ~_WHITE_BYTE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[starts[starts < len(data)]] = True  # a text's first word doesn't go on from the text before it
    begin &= inside
    end = inside.copy()
    end[:-1] &= ~inside[1:] | begin[1:]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    with np.errstate(over="ignore"):
        n = len(data)
        powers = np.cumprod(np.full(n, _BASE, dtype=np.uint64))
        sums = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers))
        inverse = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64))
        h = (sums[end] - sums[begin]) * inverse[begin]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, with their counts added up."""
    h, n = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(first) else n


def _stretches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts (as binary, no nulls): first and last row of each stretch, its bytes, and where its texts begin and end."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype="<i8")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRETCH, side="right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def _by_language(batch: pa.RecordBatch, lang: int, text: int) -> Iterator[tuple[str, np.ndarray, pa.Array]]:
    """Language key, rows and texts (binary) of a batch, for one language after the other."""
    langs = np.array(batch.column(lang).to_pylist(), dtype=object)
    texts = batch.column(text).cast(pa.binary()).fill_null(b"")
    for one in dict.fromkeys(langs):
        rows = np.flatnonzero(langs == one)
        yield one, rows, texts if len(rows) == len(langs) else texts.take(pa.array(rows))


class _WordCounts:
    """Words of a partition by language, summed up now and then."""

    def __init__(self) -> None:
        self.held: dict[str, tuple[list, list]] = {}
        self.waiting: dict[str, int] = {}

    def add(self, lang: str, hashes: np.ndarray) -> None:
        h, n = self.held.setdefault(lang, ([], []))
        distinct, counts = np.unique(hashes, return_counts=True)
        h.append(distinct)
        n.append(counts.astype(np.int64))
        self.waiting[lang] = self.waiting.get(lang, 0) + len(distinct)
        if self.waiting[lang] > COMPACT + 2 * len(h[0]):
            merged = _summed(h, n)
            self.held[lang] = ([merged[0]], [merged[1]])
            self.waiting[lang] = 0

    def rows(self, split: int, ranges: int) -> Iterator[tuple]:
        width = (1 << 64) // ranges + 1
        for lang, (h, n) in self.held.items():
            hashes, counts = _summed(h, n)
            bounds = np.searchsorted(hashes, np.array([min(k * width, (1 << 64) - 1) for k in range(ranges)], dtype=np.uint64))
            bounds = np.append(bounds, len(hashes))
            for k in range(ranges):
                part = slice(int(bounds[k]), int(bounds[k + 1]))
                if part.stop > part.start:
                    yield lang, k, split, hashes[part].tobytes(), counts[part].astype("<u8").tobytes()


_COUNTED = [("lang", pa.string()), ("code", pa.int32()), ("n", pa.int64()), ("range", pa.int32()), ("split", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())]


def counted(df: DataFrame, ranges: int, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One pass over all texts. Rows with a ``code``: ``lang``, ``code``, ``n`` of 4-grams; rows with a ``range``: a partition's words there."""
    size = SYMBOLS**ORDER
    schema = pa.schema(_COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[str, np.ndarray] = OrderedDict()
        summed: dict[str, int] = {}
        words = _WordCounts()

        def rows(lang: str, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            used = np.flatnonzero(counts)
            for part in np.array_split(used, -(-len(used) // 200_000) or 1):
                if len(part):
                    known = [pa.array([lang] * len(part)), pa.array(part.astype(np.int32)), pa.array(counts[part].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([*known, *(pa.nulls(len(part), t) for _, t in _COUNTED[3:])], schema=schema)

        for batch in batches:
            for lang, _, texts in _by_language(batch, 0, 1):
                for _, _, data, ends in _stretches(texts):
                    if not len(data):
                        continue
                    if lang in held and summed[lang] + len(data) > MOST_COUNTED:
                        yield from rows(lang, held.pop(lang))
                    if lang not in held:
                        held[lang], summed[lang] = np.zeros(size, dtype=np.uint32), 0
                    codes, there = np.unique(text_codes(data, ends), return_counts=True)
                    held[lang][codes] += there.astype(np.uint32)
                    summed[lang] += len(data)
                    words.add(lang, word_hashes(data, *word_places(data, ends[:-1])))
                if lang in held:
                    held.move_to_end(lang)
                while len(held) > TABLES_HELD:
                    yield from rows(*held.popitem(last=False))
        while held:
            yield from rows(*held.popitem())
        for row in words.rows(TaskContext.get().partitionId(), ranges):
            values = {"lang": row[0], "code": None, "n": None, "range": row[1], "split": row[2], "hashes": row[3], "counts": row[4]}
            yield pa.RecordBatch.from_pylist([values], schema=schema)
        release_memory()

    texts = df.select(_lang_key(F.col(lang_col)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "lang string, code int, n long, range int, split int, hashes binary, counts binary")


def ngram_counts(passed: DataFrame) -> DataFrame:
    """``lang``, ``code``, ``n`` of every 4-gram of every text, from ``counted``."""
    return passed.where("code is not null").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def answered(passed: DataFrame, ranges: int) -> DataFrame:
    """The words of each range merged. Rows with a ``split``: that partition's words (``hashes``, ``counts`` in the whole corpus);
    others: ``lang``, the number of words ``total`` and of different ones by count, 1 to 4 and more (``types``)."""
    schema = pa.schema([("lang", pa.string()), ("split", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("total", pa.int64()), ("types", pa.list_(pa.int64()))])

    def merge(lang: str, asked: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[dict]:
        hashes, counts = _summed([h for _, h, _ in asked], [n for _, _, n in asked])
        types = np.bincount(np.minimum(counts, 5), minlength=6)[1:]
        yield {"lang": lang, "split": None, "hashes": None, "counts": None, "total": int(counts.sum()), "types": types.tolist()}
        for split, h, _ in asked:
            there = counts[np.searchsorted(hashes, h)]
            yield {"lang": lang, "split": split, "hashes": h.tobytes(), "counts": there.astype("<u8").tobytes(), "total": None, "types": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asked = None, []
        for batch in batches:
            for lang, number, split, hashes, counts in zip(*(batch.column(k) for k in range(5)), strict=True):
                this = (number.as_py(), lang.as_py())
                if this != key and asked:
                    yield from (pa.RecordBatch.from_pylist([row], schema=schema) for row in merge(key[1], asked))
                    asked = []
                key = this
                asked.append((split.as_py(), np.frombuffer(hashes.as_py(), dtype="<u8"), np.frombuffer(counts.as_py(), dtype="<i8")))
        if asked:
            yield from (pa.RecordBatch.from_pylist([row], schema=schema) for row in merge(key[1], asked))
        release_memory()

    words = passed.where("range is not null").select("lang", "range", "split", "hashes", "counts")
    dealt = words.repartitionById(ranges, "range").sortWithinPartitions("range", "lang")
    return dealt.mapInArrow(run, "lang string, split int, hashes binary, counts binary, total long, types array<long>")


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 1, 2 and above (index 1 to 3), from the counts of counts."""
    return discounts_of(*(int((counts == k).sum()) for k in (1, 2, 3, 4)))


def discounts_of(*types: int) -> np.ndarray:
    n1, n2, n3, n4 = (max(n, 1) for n in types)
    y = n1 / (n1 + 2 * n2)
    raw = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw[1:], strict=True))])


def kneser_ney(codes: np.ndarray, counts: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Sorted arrays of each order from 1: ``code``/``alpha`` of n-grams, ``context``/``gamma`` of their contexts."""
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order].astype(np.float64)
    levels: list[dict[str, np.ndarray]] = []
    for n in range(ORDER, 0, -1):
        d = discounts(counts)[np.minimum(counts, 3).astype(np.int64)]
        context, start = np.unique(codes // SYMBOLS, return_index=True)
        total = np.add.reduceat(counts, start)
        gamma = np.add.reduceat(d, start) / total
        share = np.repeat(total, np.diff(np.append(start, len(codes))))
        levels.append({"code": codes, "alpha": (counts - d) / share, "context": context, "gamma": gamma})
        codes, counts = np.unique(codes % SYMBOLS ** (n - 1), return_counts=True)  # in how many contexts one symbol longer
        counts = counts.astype(np.float64)
    return levels[::-1]


def dense_log_probabilities(levels: list[dict[str, np.ndarray]]) -> np.ndarray:
    """Log probability of the last symbol of every 4-gram, seen or not."""
    p = np.full(SYMBOLS, 1 / SYMBOLS, dtype=np.float32)  # order 0: uniform
    for n, level in enumerate(levels, start=1):
        gamma = np.ones(SYMBOLS ** (n - 1), dtype=np.float32)
        gamma[level["context"]] = level["gamma"]
        shorter = p if n == 1 else np.tile(p, SYMBOLS)
        p = (gamma[:, None] * shorter.reshape(-1, SYMBOLS)).reshape(-1)
        p[level["code"]] += level["alpha"]
    return np.log(p)


def build_models(counts: DataFrame, path: str) -> None:
    """Write the spelling models of all languages below ``path``."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        levels = kneser_ney(rows["code"].to_numpy(), rows["n"].to_numpy())
        out: dict[str, list] = {name: [] for name in ("lang", "order", "code", "alpha", "context", "gamma")}
        for n, level in enumerate(levels, start=1):
            out["lang"].append(key[0].as_py())
            out["order"].append(n)
            for name in ("code", "context"):
                out[name].append(level[name].astype("<u4").tobytes())
            for name in ("alpha", "gamma"):
                out[name].append(level[name].astype("<f4").tobytes())
        return pa.table(out, schema=pa.schema([("lang", pa.string()), ("order", pa.int32()), *((x, pa.binary()) for x in ("code", "alpha", "context", "gamma"))]))

    models = counts.groupBy("lang").applyInArrow(build, "lang string, order int, code binary, alpha binary, context binary, gamma binary")
    models.write.parquet(path)


def _load(path: str, lang: str) -> np.ndarray | None:
    store, folder = file_system(path)
    rows = pq.read_table(folder, filesystem=store, filters=[("lang", "=", lang)]).sort_by("order").to_pylist()
    if not rows:
        return None
    as_type = {"code": "<u4", "context": "<u4", "alpha": "<f4", "gamma": "<f4"}
    return dense_log_probabilities([{name: np.frombuffer(row[name], dtype=t) for name, t in as_type.items()} for row in rows])


class Scorer:
    """Scores of texts of one partition; a few languages' spelling tables are held at a time, and the partition's words."""

    def __init__(self, path: str, words: dict[str, tuple[int, list[int]]]) -> None:
        self.path = path
        self.words = words
        self.tables: OrderedDict[str, np.ndarray | None] = OrderedDict()
        self.split, self.known = None, {}

    def open(self, split: int) -> None:
        if split == self.split:
            return
        store, folder = file_system(f"{self.path}/words/split={split}")
        self.split, self.known = split, {}
        if store.get_file_info(folder).type.name == "NotFound":  # a partition without words
            return
        rows = pq.read_table(folder, filesystem=store, partitioning=None).to_pylist()
        parts: dict[str, tuple[list, list]] = {}
        for row in rows:
            h, n = parts.setdefault(row["lang"], ([], []))
            h.append(np.frombuffer(row["hashes"], dtype="<u8"))
            n.append(np.frombuffer(row["counts"], dtype="<i8"))
        self.known = {lang: _summed(h, n) for lang, (h, n) in parts.items()}

    def table(self, lang: str) -> np.ndarray | None:
        if lang not in self.tables:
            self.tables[lang] = _load(f"{self.path}/spelling", lang)
            if len(self.tables) > TABLES_HELD:
                self.tables.popitem(last=False)
        self.tables.move_to_end(lang)
        return self.tables[lang]

    def __call__(self, lang: str, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word score and spelling score of each of the concatenated texts of a language; NaN where there is no word."""
        texts = len(ends) - 1
        begin, end = word_places(data, ends[:-1])
        if not len(begin):
            return np.full(texts, np.nan), np.full(texts, np.nan)
        log_p = self.table(lang)[text_codes(data, ends)].astype(np.float64)
        sums = np.append(0.0, np.cumsum(log_p))
        hashes, counts = self.known.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        h = word_hashes(data, begin, end)
        place = np.searchsorted(hashes, h)
        if not len(hashes) or (hashes[np.minimum(place, len(hashes) - 1)] != h).any():
            raise RuntimeError("a word that was not counted: documents are not those that the rules were fitted on, or in other partitions")
        row = np.searchsorted(ends, begin, side="right") - 1
        row = np.minimum(row, texts - 1)
        order = np.lexsort((place, row))
        first = np.append(True, (row[order][1:] != row[order][:-1]) | (place[order][1:] != place[order][:-1]))
        group = np.cumsum(first) - 1
        own = np.empty(len(order), np.int64)
        own[order] = np.bincount(group)[group]
        total, types = self.words[lang]
        d = word_discounts(types)
        left = counts[place] - own
        freed = (d[1] * types[0] + d[2] * types[1] + d[3] * sum(types[2:])) / total
        space = np.maximum(begin - 1, ends[row])
        spelled = np.exp(sums[end] - sums[space])
        p = np.maximum(left - d[np.minimum(left, 3)], 0) / total + freed * spelled
        by_byte = -np.log(np.maximum(p, 1e-300)) / (end - begin + 1)
        n = np.bincount(row, minlength=texts)
        with np.errstate(invalid="ignore"):
            words = np.bincount(row, by_byte, minlength=texts) / np.where(n, n, np.nan)
            spelling = -(sums[ends[1:]] - sums[ends[:-1]]) / np.where(n, np.diff(ends), np.nan)
        return words, spelling


def word_discounts(types: list[int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of words of counts 1, 2 and above, from how many words have the counts 1 to 4."""
    return discounts_of(*types[:4])


_WHITE = b" \t\n\x0b\x0c\r"
_MARKS = b"#*$%&|<>"
_CONTINUATION = bytes(range(128, 192))


def text_statistics(data: bytes) -> tuple[int, int, int, int, int]:
    """``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` of a text in UTF-8."""
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    repeated = 0
    if len(words) > 3 and len(seen) < len(words):
        size = len(seen)
        pairs = ids[:-1] * size + ids[1:]
        if size > 2_000_000:  # keep the code of three words inside 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * size + ids[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            twice = np.zeros(len(windows), dtype=bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            covered = np.zeros(len(words), dtype=bool)
            for k in range(3):
                covered[k : k + len(windows)] |= twice
            repeated = int(covered.sum())
    inside = data.translate(None, _WHITE)
    return (
        len(words),
        len(inside.translate(None, _CONTINUATION)),
        len(data) - len(data.translate(None, _MARKS)),
        len(lines) - len(set(lines)),
        repeated,
    )


def fails_plain_rules(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


class Rules:
    """A fitted model: where its arrays lie, the documents, and each language's word counts and bands."""

    def __init__(self, documents: DataFrame, path: str, words: dict[str, tuple[int, list[int]]], bands: dict[str, tuple[float, float, float]]) -> None:
        self.documents, self.path, self.words, self.bands = documents, path, words, bands

    def judge(self) -> _Judge:
        return _Judge(self.path, self.words, self.bands)


class _Judge:
    """What workers need of the rules."""

    def __init__(self, path: str, words: dict, bands: dict) -> None:
        self.path, self.words, self.bands = path, words, bands

    def scorer(self) -> Scorer:
        path, words = self.path, self.words
        scorer = per_worker("perplexity", path, lambda: Scorer(path, words))
        scorer.open(TaskContext.get().partitionId())
        return scorer

    def __call__(self, batch: pa.RecordBatch, lang: int, text: int) -> dict[str, np.ndarray]:
        """Statistics, scores and verdict of each row of a batch."""
        n = batch.num_rows
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        out = {name: np.zeros(n, np.int64) for name in names} | {"base_failed": np.zeros(n, bool), "kept": np.zeros(n, bool)}
        out |= {"log_perplexity": np.full(n, np.nan), "spelling": np.full(n, np.nan)}
        scorer = self.scorer()
        for one, rows, texts in _by_language(batch, lang, text):
            lowest, highest, plainest = self.bands.get(one, (-np.inf, np.inf, -np.inf))
            for at, to, data, ends in _stretches(texts):
                there = rows[at:to]
                found = [text_statistics(data[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                for name, values in zip(names, zip(*found, strict=True), strict=True):
                    out[name][there] = values
                failed = np.array([fails_plain_rules(row[0], row[4]) for row in found])
                score, spelling = scorer(one, data, ends)
                out["base_failed"][there] = failed
                out["log_perplexity"][there], out["spelling"][there] = score, spelling
                out["kept"][there] = ~failed & (score >= lowest) & (score <= highest) & (spelling >= plainest)
        return out


def fit_rules(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    upper_width: float = UPPER_WIDTH,
    lower_width: float = LOWER_WIDTH,
    spelling_width: float = SPELLING_WIDTH,
) -> Rules:
    """Count, build the models, and set the bands from all documents. One row per language reaches the driver."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():  # partitions may be other ones when it runs again
        df = materialise(df, "judged")
    path = scratch_path(df.sparkSession, "perplexity")
    ranges = min(max(df.rdd.getNumPartitions(), LEAST_RANGES), MOST_RANGES)
    passed = materialise(counted(df, ranges, text_col, lang_col), "counted")
    build_models(ngram_counts(passed), f"{path}/spelling")
    answers = materialise(answered(passed, ranges), "answers")
    discard(passed)
    answers.where("split is not null").select("lang", "hashes", "counts", "split").repartition("split").write.partitionBy("split").parquet(f"{path}/words")
    sums = answers.where("total is not null").groupBy("lang").agg(F.sum("total").alias("total"), *(F.sum(F.col("types")[k]).alias(f"t{k}") for k in range(5)))
    words = {row["lang"]: (row["total"], [row[f"t{k}"] for k in range(5)]) for row in sums.toLocalIterator()}
    discard(answers)
    judge = _Judge(path, words, {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judge(batch, 0, 1)
            sound = pa.array(~found["base_failed"])
            columns = [batch.column(0), pa.array(found["log_perplexity"]), pa.array(found["spelling"])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "score", "spelling"]).filter(sound)
        release_memory()

    texts = df.select(_lang_key(F.col(lang_col)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    scores = texts.mapInArrow(run, "lang string, score double, spelling double")
    quartiles = scores.groupBy("lang").agg(*(F.percentile_approx(name, [0.25, 0.5, 0.75], 10_000).alias(name) for name in ("score", "spelling")))
    bands = {}
    for row in quartiles.toLocalIterator():
        (low, middle, high), (plain_low, plain, plain_high) = row["score"], row["spelling"]
        deviation, plain_deviation = (max((b - a) / 1.349, LEAST_DEVIATION) for a, b in ((low, high), (plain_low, plain_high)))
        bands[row["lang"]] = (middle - lower_width * deviation, middle + upper_width * deviation, plain - spelling_width * plain_deviation)
    return Rules(df, path, words, bands)


def verdicts(rules: Rules, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Statistics and verdict of every document that the rules were fitted on."""
    types = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("log_perplexity", "double")]
    judge = rules.judge()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judge(batch, 1, 2)
            columns = [pa.array(found[name], from_pandas=True) for name, _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *(name for name, _ in types)])
        release_memory()

    df = rules.documents
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), _lang_key(F.col(lang_col)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{name} {t}" for name, t in types))


def keep_documents(rules: Rules, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    judge = rules.judge()
    df = rules.documents
    key = "__lang_key"
    text = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = judge(batch, batch.num_columns - 1, text)["kept"]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(kept))
        release_memory()

    return df.withColumn(key, _lang_key(F.col(lang_col))).mapInArrow(run, df.schema)
