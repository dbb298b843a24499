"""Exact substring deduplication: bytes covered by a ``LENGTH``-byte string that also starts earlier.

Suffixes are sampled, sampled suffixes are named by their prefixes and brought together, and every other suffix is decided by
the bytes up to the next sampled one and that one's name: the scheme of the difference-cover
construction. What differs is the cover, and the depth. A cover by residues (two of three positions, for triples) would
move 8 to 16 bytes several times for two thirds of all bytes of a corpus. Here positions are sampled by content:
in each string of ``LENGTH`` bytes the ``GRAM``-byte substring with the smallest hash. Equal strings thus
sample at equal distances from their starts, which is what a cover is for, and about one position in 35 is
sampled. And as only the first ``LENGTH`` bytes of suffixes count, names need no recursion: they
are the hashes of the ``GRAM`` bytes, and the bytes around decide inside a group of equal names.

Texts that equal an earlier one are set apart first: all their bytes are repeats. Then:

1. Sampled positions (anchors) of all texts with the range of string starts that each one serves.
2. Names that occur once are dropped (aggregation and join).
3. The rest get the bytes around them, go to their name's group in the order of the text, and adjacent equal strings are
   compared: all but the first of a run are repeats. Groups of more than ``HOT`` anchors are not gathered: their
   strings are grouped one by one, summed up in the tasks that hold them.
4. Repeats become byte ranges of their documents, which are merged and cut out.

Hashes of strings have 64 bits. Defined cases: a null or empty text has no bytes; texts shorter than ``LENGTH`` keep all;
null ids come last; rows that repeat an id are documents of their own, in the order of their texts; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .worker import release_memory

LENGTH = 100
GRAM = 32
HOT = 20_000
STRIDE = 1 << 23  # longer texts are looked at in overlapping stretches of so many bytes

_BASE = 0x9E3779B97F4A7C15 | 1


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit polynomial hash of the ``size`` bytes from each position on."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(n, _BASE, dtype=np.uint64))
        inverse = np.cumprod(np.full(n - size + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64))
        sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers)
        h = sums[size - 1 :].copy()
        h[1:] -= sums[: n - size]
        h *= inverse
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name, position, and first and last served start of the anchors of a text."""
    names, at, first, last = [], [], [], []
    window = length - gram + 1
    for begin in range(0, max(len(data) - length + 1, 0), STRIDE):
        part = data[begin : begin + STRIDE + length - 1]
        h = rolling(part, gram)
        key = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
        width, least = 1, key
        while 2 * width <= window:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < window:
            least = np.minimum(least[: len(h) - window + 1], least[window - width :])
        position = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, position[1:] != position[:-1]))
        anchor = position[starts]
        names.append(h[anchor].view(np.int64))
        at.append(anchor + begin)
        first.append(starts + begin)
        last.append(np.append(starts[1:], len(position)) - 1 + begin)
    empty = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or empty) for x in (names, at, first, last))


def _keyed(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``doc`` (a key in the order of documents), ``doc_id``, ``text``; and the table to discard, if ids needed keys of their own."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    odd = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1)
    if odd.isEmpty():
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text"), None
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    numbered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id())
    kept = materialise(numbered.select("doc", "doc_id", "text"), "numbered")
    return kept, kept


def _anchor_rows(rows: DataFrame, length: int, gram: int) -> DataFrame:
    names = ["name", "doc", "at", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            held = 0

            def flush() -> pa.RecordBatch:
                columns = [np.concatenate(c) for c in out]
                types = (np.int64, np.int64, np.int32, np.int16, np.int16)
                arrays = [pa.array(c.astype(t)) for c, t in zip(columns, types, strict=True)]
                for c in out:
                    c.clear()
                return pa.RecordBatch.from_arrays(arrays, names)

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(text.as_buffer() or b"", dtype=np.uint8)
                name, at, first, last = anchors(data, length, gram)
                if len(name):
                    for column, values in zip(out, (name, np.full(len(name), doc), at, at - last, at - first), strict=True):
                        column.append(values)
                    held += len(name)
                if held > 200_000:
                    yield flush()
                    held = 0
            if held:
                yield flush()
        release_memory()

    return rows.select("doc", "text").mapInArrow(run, "name long, doc long, at int, low smallint, high smallint")


def _copies(rows: DataFrame, length: int) -> DataFrame:
    """``doc`` of each text of ``length`` bytes or more that equals an earlier one: all its bytes are repeats.

    Every string of a copy stands in the first of its kind too, which starts earlier than anything after the copy, so copies
    decide nothing about other texts and take no further part.
    """
    hashed = rows.where(F.octet_length("text") >= length).select("doc", F.unhex(F.sha2("text", 256)).alias("h"))
    first = hashed.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first <> last")
    return hashed.join(first, "h").where("doc <> first").select("doc")


def _split(rows: DataFrame, repeated: DataFrame, copies: DataFrame) -> DataFrame:
    """Kind 0: texts without repeated names; kind 1: copies; kind 2: texts with repeated names, and these (``found``)."""
    mine = repeated.join(copies, "doc", "left_anti")
    lists = mine.groupBy("doc").agg(F.collect_list(F.struct("name", "at", "low", "high", "n")).alias("found"))
    joined = rows.join(lists, "doc", "left").join(copies.withColumn("copy", F.lit(True)), "doc", "left")
    text = F.coalesce("text", F.lit(b""))
    kind = F.when(F.col("copy"), 1).when(F.col("found").isNull(), 0).otherwise(2)
    digest = F.when(kind == 0, F.sha2(text, 256)).when(kind == 1, F.sha2(F.lit(b""), 256))
    return joined.select(
        kind.alias("kind"), "doc", "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"), F.when(kind == 2, F.col("text")).alias("text"), "found"
    )


def _spans(texts: DataFrame, length: int) -> DataFrame:
    """The repeated anchors of kind 2 with the bytes that their strings span."""
    names = ["name", "doc", "at", "low", "high", "n", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = part.column(2)
                counts = found.value_lengths().to_numpy(zero_copy_only=False)
                flat = found.flatten()
                at, low, high = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("at", "low", "high"))
                begins, ends = (at - high).tolist(), (at - low + length).tolist()
                pieces, k = [], 0
                for text, count in zip(part.column(1).to_pylist(), counts.tolist(), strict=True):
                    pieces += [text[b:e] for b, e in zip(begins[k : k + count], ends[k : k + count], strict=True)]
                    k += count
                docs = np.repeat(part.column(0).to_numpy(zero_copy_only=False), counts)
                columns = [flat.field("name"), pa.array(docs), flat.field("at"), flat.field("low"), flat.field("high"), flat.field("n"), pa.array(pieces, type=pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
        release_memory()

    return texts.mapInArrow(run, "name long, doc long, at int, low smallint, high smallint, n long, data binary")


def _strings(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every string of the anchors' spans: its anchor's row, its distance to the anchor, its hash. By row, then distance."""
    low, high = rows["low"].to_numpy().astype(np.int64), rows["high"].to_numpy().astype(np.int64)
    data = rows["data"].combine_chunks()
    data = data if isinstance(data, pa.Array) else data.chunk(0)
    bounds = np.frombuffer(data.buffers()[1], dtype="<i4")[data.offset : data.offset + len(data) + 1].astype(np.int64)
    h = rolling(np.frombuffer(data.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]], length)
    counts = high - low + 1
    row = np.repeat(np.arange(len(counts)), counts)
    distance = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + low[row]
    return row, distance, h[(bounds[:-1] - bounds[0])[row] + high[row] - distance]


def _ranges(row: np.ndarray, distance: np.ndarray, marked: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """Byte ranges of marked strings; strings that start next to each other share one."""
    row, distance = row[marked], distance[marked]
    new = np.append(True, (row[1:] != row[:-1]) | (distance[1:] != distance[:-1] + 1)) if len(row) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(row)) - 1 if len(begin) else begin
    columns = (doc[row[begin]], at[row[begin]] - distance[end], at[row[begin]] - distance[begin] + length)
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["doc", "start", "end"])


def _repeats_in_groups(spans: DataFrame, length: int) -> DataFrame:
    """``doc``, ``start``, ``end`` of repeats in groups that a task may hold."""

    def decide(rows: pa.Table) -> pa.RecordBatch:
        row, distance, h = _strings(rows, length)
        order = np.argsort(h, kind="stable")  # equal strings become neighbours, the earliest first
        again = np.append(False, h[order][1:] == h[order][:-1])
        marked = np.zeros(len(h), dtype=bool)
        marked[order[again]] = True
        return _ranges(row, distance, marked, rows["doc"].to_numpy(), rows["at"].to_numpy().astype(np.int64), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_500):
                part = batch.slice(lo, 2_500)
                held.append(part)
                size += part.num_rows
                if size >= 10_000:
                    rows = pa.Table.from_batches(held)
                    name = rows["name"].to_numpy()
                    cut = int(np.flatnonzero(np.append(True, name[1:] != name[:-1]))[-1])  # the last group may go on
                    if cut:
                        yield decide(rows.slice(0, cut))
                    held, size = rows.slice(cut).to_batches(), rows.num_rows - cut
        if size:
            yield decide(pa.Table.from_batches(held))
        held.clear()
        release_memory()

    dealt = spans.select("name", "doc", "at", "low", "high", "data").repartition("name").sortWithinPartitions("name", "doc", "at")
    return dealt.mapInArrow(run, "doc long, start long, end long")


def _repeats_of_hot_names(spans: DataFrame, length: int) -> DataFrame:
    """The same string by string: aggregated inside tasks, then joined by equality."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 5_000):
                rows = pa.Table.from_batches([batch.slice(lo, 5_000)])
                row, distance, h = _strings(rows, length)
                columns = (h.view(np.int64), rows["doc"].to_numpy()[row], rows["at"].to_numpy().astype(np.int64)[row] - distance)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "doc", "start"])

    strings = spans.select("doc", "at", "low", "high", "data").mapInArrow(run, "h long, doc long, start long")
    first = strings.groupBy("h").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = strings.join(first, "h").where(F.struct("doc", "start") != F.col("first"))
    return again.select("doc", "start", (F.col("start") + length).alias("end"))


def find_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT
) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``spans`` (array of start, end in bytes), ``kept_sha256`` of every row."""
    rows, numbered = _keyed(df, id_col, text_col)
    found = _anchor_rows(rows, length, gram)
    counts = found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = materialise(found.join(counts, "name"), "repeated")
    copies = materialise(_copies(rows, length), "copies")
    split = materialise(_split(rows, repeated, copies), "split")
    some_hot = not repeated.where(F.col("n") > hot).isEmpty()
    discard(repeated)
    discard(copies)
    texts = split.where("kind = 2")
    spans = _spans(texts.select("doc", "text", "found"), length)
    ranges = _repeats_in_groups(spans.where(F.col("n") <= hot), length)
    if some_hot:
        common = texts.withColumn("found", F.filter("found", lambda x: x["n"] > hot)).where(F.size("found") > 0)
        ranges = ranges.unionByName(_repeats_of_hot_names(_spans(common.select("doc", "text", "found"), length), length))
    lists = ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    joined = texts.select("doc", "doc_id", "text").join(lists, "doc", "left").select("doc_id", "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = text.as_py()
                merged: list[list[int]] = []
                for one in sorted((x["start"], x["end"]) for x in (ranges.as_py() or [])):
                    if merged and one[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], one[1])
                    else:
                        merged.append(list(one))
                digest, done = hashlib.sha256(), 0
                for start, end in merged:
                    digest.update(data[done:start])
                    done = end
                digest.update(data[done:])
                out.append((doc_id, len(data), sum(e - s for s, e in merged), [{"start": s, "end": e} for s, e in merged], digest.hexdigest()))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string())
            columns = zip(*out, strict=True) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])
        release_memory()

    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string"
    cut_texts = joined.mapInArrow(cut, schema)
    everything = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    copy = F.col("kind") == 1
    whole = split.where("kind < 2").select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(copy, everything).otherwise(nothing).alias("spans"), F.col("digest").alias("kept_sha256")
    )
    result = materialise(cut_texts.unionByName(whole), "kept")
    for table in filter(None, (numbered, split)):
        discard(table)
    return result
