"""Token ids of columns of texts, by the tokenizers library, with what it said about each unit remembered.

A byte-level BPE vocabulary splits a text before its merges, so a text may be cut wherever that split always cuts, and the ids of a
text are the ids of its units, one after another: the library's own result. Cuts (``unit_starts``) are found in the bytes of a
whole column with numpy, and only where no rule of the split could reach across: in front of a space that a non-space
follows, between letters, digits and marks (not behind an apostrophe, which may begin a contraction), and around a
single line end. Every distinct unit goes through the library once per worker; units of up to ``KEY_BYTES`` bytes are kept
in a hash table of arrays under their bytes themselves (no digest, so no collision), longer ones are not kept.

A vocabulary file with another split or with a normaliser is not cut at all: the library gets whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa

from .worker import per_worker

VOCABULARY = "byte_bpe_50k.json"
KEY_BYTES = 24
MOST_UNITS = 1 << 21  # a full table is emptied: what is frequent is soon back
GROUP_BYTES = 1 << 20

# Classes of bytes: 0 others, never cut at; 1 letters, 2 digits, 3 marks, 4 the apostrophe, 5 the space, 6 the line end,
# 7 first bytes of characters that are not white space.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 1
_CLASS[list(b"0123456789")] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
_CLASS[39], _CLASS[32], _CLASS[10] = 4, 5, 6
_CLASS[[c for c in range(0xC4, 0xF5) if c not in (0xE1, 0xE2, 0xE3)]] = 7
_VISIBLE = np.isin(np.arange(8), [1, 2, 3, 4, 7])
_PLAIN = np.isin(np.arange(8), [1, 2, 3, 4])
_KIND = np.array([0, 1, 2, 3, 3, 0, 0, 0])  # letters, digits, marks
_BETWEEN = np.zeros((8, 8), dtype=bool)  # of a byte's class and the class before it
for _before in range(8):
    for _now in range(8):
        _BETWEEN[_before, _now] = _PLAIN[_before] and ((_now == 6) or (_before != 4 and _PLAIN[_now] and _KIND[_before] != _KIND[_now]))

_ONE_WORD = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]+|[!-/:-@\[-`{-~]+)\Z")


def unit_starts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where units begin in the concatenated texts (UTF-8) that lie from ``starts`` to ``ends``; ascending."""
    n = len(data)
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    cut = np.zeros(n + 1, dtype=bool)
    before, now = kind[:-1], kind[1:]
    cut[1:n] = _BETWEEN.reshape(-1)[before << 3 | now]
    cut[1:n] &= data[1:] & 0xC0 != 0x80
    space = (before == 5) & _VISIBLE[now]
    space[ends[(ends > 0) & (ends < n)] - 1] = False  # what follows is another text
    cut[: n - 1] |= space
    line = _PLAIN[kind[:-2]] & (kind[1:-1] == 6) & _PLAIN[kind[2:]] if n > 2 else np.zeros(0, bool)
    cut[2:n] |= line
    cut[starts[starts < ends]] = True
    return np.flatnonzero(cut[:n])


def _byte_names() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself where it can be printed, the others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(c if c in shown else next(hidden)) for c in range(256)]


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, 0] != b[:, 0]) | (a[:, 1] != b[:, 1]) | (a[:, 2] != b[:, 2])


class Units:
    """A hash table from units (their bytes, in three words) to places in a pool of ids. Linear probing, at most half full."""

    def __init__(self, kind: str) -> None:
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.count, self.used = 0, 0
        self.pool = np.zeros(1 << 12, dtype=self.kind)
        self._make(1 << 12)

    def _make(self, slots: int) -> None:
        self.mask = np.uint64(slots - 1)
        self.keys = np.zeros((slots, 3), dtype=np.uint64)
        self.place = np.zeros(slots, dtype=np.int64)  # 0: free; else offset << 16 | number of ids

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ keys[:, 2] * np.uint64(0x165667B19E3779F9)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(24)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, 0 where there is none."""
        slot = self._slot(keys)
        place = self.place[slot]
        wrong = np.flatnonzero((place != 0) & _differ(self.keys[slot], keys))
        while len(wrong):
            slot[wrong] = slot[wrong] + np.uint64(1) & self.mask
            there = slot[wrong]
            place[wrong] = self.place[there]
            wrong = wrong[(place[wrong] != 0) & _differ(self.keys[there], keys[wrong])]
        return place

    def _insert(self, keys: np.ndarray, places: np.ndarray) -> None:
        slot = self._slot(keys)
        rest = np.arange(len(keys))
        while len(rest):
            free = rest[self.place[slot[rest]] == 0]
            self.place[slot[free]] = places[free]
            self.keys[slot[free]] = keys[free]  # of several for one slot the last has written both
            rest = rest[self.place[slot[rest]] != places[rest]]
            slot[rest] = slot[rest] + np.uint64(1) & self.mask

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Remember new, distinct keys with their ids (concatenated; ``counts`` each); their places are returned."""
        if self.count + len(keys) > MOST_UNITS:
            self.clear()
        while 2 * (self.count + len(keys)) > len(self.place):
            old = np.flatnonzero(self.place)
            held, places = self.keys[old], self.place[old]
            self._make(2 * len(self.place))
            self._insert(held, places)
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), len(ids)), dtype=self.kind)])
        self.pool[self.used : self.used + len(ids)] = ids
        places = (self.used + np.cumsum(counts) - counts) << 16 | counts
        self.used += len(ids)
        self.count += len(keys)
        self._insert(keys, places)
        return places


_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def _keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of units of at most ``KEY_BYTES`` bytes as three words each. ``data`` has 24 bytes behind the last unit.

    Units don't end in a zero byte (the caller sees to that), so their lengths are in the words.
    """
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    keys = np.zeros((len(starts), 3), dtype=np.uint64)
    for k in range(3):
        some = np.flatnonzero(lengths > 8 * k)
        keys[some, k] = words[starts[some] + 8 * k] & _TAIL[np.minimum(lengths[some] - 8 * k, 8)]
    return keys


class ColumnEncoder:
    """Ids of texts, ``kind`` each: 16 bits if all ids fit, else 32."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        file = json.loads(Path(path).read_text(encoding="utf-8"))
        split, model = file.get("pre_tokenizer") or {}, file["model"]
        plain = not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"))
        known_split = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        self.cuts = bool(known_split and plain and model.get("type") == "BPE" and not file.get("normalizer"))
        self.names = str.maketrans(dict(enumerate(_byte_names())))
        self.known = Units(self.kind)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, concatenated, and how many each has. One word or mark goes straight to the library's merges."""
        one_word = np.fromiter(map(bool, map(_ONE_WORD.match, units)), dtype=bool, count=len(units))
        found: list = [None] * len(units)
        words = np.flatnonzero(one_word).tolist()
        merges = self.tokenizer.model.tokenize
        if words:
            named = b"\n".join([units[k] for k in words]).decode("latin-1").translate(self.names).split(self.names[10])
            for k, word in zip(words, named, strict=True):
                found[k] = [token.id for token in merges(word)]
        others = np.flatnonzero(~one_word).tolist()
        for k, ids in zip(others, self.library([units[k].decode() for k in others]), strict=True):
            found[k] = ids
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.array(list(chain.from_iterable(found)), dtype=self.kind), counts

    def _places(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Place of each unit, and the pool that places are in; None where there are too many or too long ones for the table."""
        places = np.zeros(len(starts), dtype=np.int64)
        short = np.flatnonzero((lengths <= KEY_BYTES) & (data[starts + lengths - 1] != 0))
        keys = _keys(data, starts[short], lengths[short])
        places[short] = self.known.find(keys)
        new = np.flatnonzero(places[short] == 0)
        if len(new):
            order = np.lexsort(keys[new].T)
            sorted_keys = keys[new][order]
            first = np.append(True, _differ(sorted_keys[1:], sorted_keys[:-1]))
            group = np.cumsum(first) - 1
            at = short[new[order[first]]]
            ids, counts = self._learn([data[b : b + n].tobytes() for b, n in zip(starts[at].tolist(), lengths[at].tolist(), strict=True)])
            if self.known.count + len(at) > MOST_UNITS:  # places found before the table is emptied are void
                self.known.clear()
                return self._places(data, starts, lengths) if len(at) <= MOST_UNITS // 2 else None
            places[short[new[order]]] = self.known.add(sorted_keys[first], ids, counts)[group]
        pool = self.known.pool
        long = np.flatnonzero(places == 0)
        if len(long):
            units = [data[b : b + n].tobytes() for b, n in zip(starts[long].tolist(), lengths[long].tolist(), strict=True)]
            distinct = dict.fromkeys(units)
            ids, counts = self._learn(list(distinct))
            base = self.known.used
            where = dict(zip(distinct, ((base + np.cumsum(counts) - counts) << 16 | np.minimum(counts, 0xFFFF)).tolist(), strict=True))
            if (counts > 0xFFFF).any():
                return None
            places[long] = [where[unit] for unit in units]
            pool = np.concatenate([pool[:base], ids])
        return places, pool

    def encode_bytes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts from ``starts`` to ``ends`` (consecutive), concatenated, and how many each has, ``end_id`` included."""
        raw = data.tobytes()
        if not self.cuts or any(token in raw for token in self.special):
            return self._by_library(raw, starts, ends, end_id)
        units = unit_starts(data, starts, ends)
        lengths = np.diff(np.append(units, len(data)))
        found = self._places(np.concatenate([data, np.zeros(KEY_BYTES, np.uint8)]), units, lengths)
        if found is None:
            return self._by_library(raw, starts, ends, end_id)
        places, pool = found
        offsets, counts = places >> 16, places & 0xFFFF
        first = np.searchsorted(units, starts)  # the first unit of each text
        if end_id is not None:
            pool = np.append(pool, np.array([end_id], dtype=pool.dtype))
            behind = np.append(first[1:], len(units))
            offsets, counts = np.insert(offsets, behind, len(pool) - 1), np.insert(counts, behind, 1)
            first = first + np.arange(len(first))
        sums = np.append(0, np.cumsum(counts))
        per_text = np.diff(np.append(sums[first], sums[-1]))
        ids = pool[np.repeat(offsets - sums[:-1], counts) + np.arange(sums[-1])]
        return ids, per_text

    def _by_library(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        found = self.library([raw[b:e].decode() for b, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        end = [] if end_id is None else [end_id]
        counts = np.fromiter((len(ids) + len(end) for ids in found), dtype=np.int64, count=len(found))
        return np.fromiter((i for ids in found for i in (*ids, *end)), dtype=self.kind, count=int(counts.sum())), counts

    def __call__(self, column: pa.Array, end_id: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and their number per text (nulls as empty ones), for one stretch of a column after the other."""
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], dtype="<i8")[column.offset : column.offset + len(column) + 1]
        values = column.buffers()[2]
        data = np.frombuffer(values, dtype=np.uint8) if values else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, side="right")) - 1)
            low = offsets[at]
            yield self.encode_bytes(data[low : offsets[to]], offsets[at:to] - low, offsets[at + 1 : to + 1] - low, end_id)
            at = to


def encoder(path: str | None = None) -> ColumnEncoder:
    """The worker's encoder. ``path``: a tokenizer file; None is the installed public vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return per_worker("encoder", path, lambda: ColumnEncoder(path))
