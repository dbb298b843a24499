from __future__ import annotations

import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import encoding, packing, tokens
from tidemark.llm.common import scratch_path
from tidemark.llm.queries import op2_token_files, op8_best_fit_packing

SPECIAL = [" ", "  ", "\n", " \n", "\t", "a", "é", "1", "'s", "don't", ".", " ", "　", "\x1c", "<|endoftext|>", "日本", "🙂", "​", "\x85", "_", " ", "\r\n", "Straße,\nOf", "×", "÷", "\0", "²", "Жук", "'", "'re", "?!", "12", "\x1f"]


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def encoded(encode, texts, end_id=None):
    found = []
    for ids, counts in encode(pa.array(texts, type=pa.string()), end_id):
        ends = np.cumsum(counts)
        found += [ids[a:b].tolist() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
    return found


@pytest.mark.parametrize("stretch", [50, 5000, 1 << 20])
def test_units_give_the_library_ids(library, monkeypatch, stretch):
    draw = random.Random(1)
    texts = ["".join(draw.choice(SPECIAL) for _ in range(draw.randint(0, 9))) for _ in range(5000)] + ["", "x" * 5000, None, "x " * 50_000]
    monkeypatch.setattr(encoding, "GROUP_BYTES", stretch)
    encode = encoding.encoder()
    assert encode.kind == "<u2" and encode.cuts
    assert encoded(encode, texts) == [library(t) for t in texts]
    assert encoded(encode, texts, 2) == [[*library(t), 2] for t in texts]
    assert encoded(encode, []) == []


@pytest.mark.parametrize("most", [1, 40, 1000])
def test_a_full_memory_changes_nothing(library, monkeypatch, texts, most):
    monkeypatch.setattr(encoding, "MOST_UNITS", most)
    monkeypatch.setattr(encoding, "GROUP_BYTES", 2000)
    encode = encoding.ColumnEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    some = [texts[k] for k in sorted(texts)[:60]]
    assert encoded(encode, some) == [library(t) for t in some]
    assert encode.known.count <= most


def test_another_vocabulary_gets_whole_texts():
    for name in ("byte_bpe_50k.json", *(p.name for p in Path("/opt/tokenizers").glob("*.json"))):
        path = str(public_tokenizers.path(name)) if name == "byte_bpe_50k.json" else f"/opt/tokenizers/{name}"
        try:
            made = Tokenizer.from_file(path)
        except Exception:  # noqa: BLE001  another kind of file
            continue
        texts = ["Straße 12, don't  stop.\n\nNow ", "", "日本 a"]
        assert encoded(encoding.ColumnEncoder(path), texts) == [made.encode(t, add_special_tokens=False).ids for t in texts]


def test_an_id_of_many_rows_is_dealt_over_files():
    bounds = np.array([3, 5, 5, 5, 8])
    ids = np.repeat([-(1 << 63), 3, 4, 5, 6, 9], 1000)
    hashes = np.sort(np.random.default_rng(0).integers(-(1 << 63), (1 << 63) - 1, (6, 1000)), axis=1).ravel()
    parts = tokens.parts_of(ids, hashes, bounds)
    assert (np.diff(parts) >= 0).all() and set(parts[ids == 5]) == {1, 2, 3} and set(parts[ids < 4]) == {0} and set(parts[ids == 9]) == {5}


@pytest.mark.parametrize("counts", [[0], [1], [4], [0, 5, 4, 0, 1, 1000, 3, 0]])
def test_streams_of_ranks_round_trip(counts):
    counts = np.array(counts)
    ranks = np.random.default_rng(0).choice([0, 255, 256, 65_535, 65_536, 1 << 24, (1 << 32) - 1], counts.sum()).astype("<u4")
    control, data = tokens.pack_ranks(ranks, counts)
    assert [len(c) for c in control] == [-(-n // 4) for n in counts]
    small = (ranks % 65_536).astype("<u2")
    assert tokens.pack_ranks(small, counts) == tokens.pack_ranks(small.astype("<u4"), counts)
    back = tokens.unpack_ranks(np.frombuffer(b"".join(control), np.uint8), np.frombuffer(b"".join(data), np.uint8), counts)
    assert (back == ranks).all()


def test_files_of_the_whole_table(spark, sf_dir, texts, library):
    rows = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op2_token_files(spark, sf_dir).collect()}
    expected, start = {}, 0
    for doc_id in sorted(texts):
        ids = [*library(texts[doc_id]), 2]
        expected[doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    assert rows == expected


def test_odd_rows_in_many_files(spark, odd, none, library):
    path = scratch_path(spark, "test-tokens")
    tokens.write_token_files(odd, path, tokens_per_file=100)
    rows = tokens.read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7, 8]
    by_id = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert all(r["ids"] == [*library(by_id[r["doc_id"]]), 2] and r["ids_crc32"] == crc(r["ids"]) for r in rows)
    assert [r["start"] for r in rows] == np.append(0, np.cumsum([r["n_tokens"] for r in rows])[:-1]).tolist()
    empty = scratch_path(spark, "test-empty")
    tokens.write_token_files(none, empty)
    assert tokens.read_token_files(spark, empty).count() == 0


def test_ranks_go_by_frequency(spark):
    counts = spark.createDataFrame([(3, 10), (1, 10), (0, 1)], "id int, n long")
    ids, total = tokens.frequency_ranks(counts, 5)
    assert ids.tolist() == [1, 3, 0, 2, 4] and total == 21


def check_packing(rows, lengths, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == np.append(0, np.cumsum([n for _, n in places])[:-1]).tolist()
        assert sum(n for _, n in places) <= capacity
    assert sum(r["length"] for r in rows) == sum(lengths)
    return len(by), -(-sum(lengths) // capacity)


def test_packing_the_whole_table(spark, sf_dir, texts, library):
    rows = op8_best_fit_packing(spark, sf_dir).collect()
    expected = {}
    for doc_id, text in texts.items():
        ids = [*library(text), 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[doc_id, piece] = (a, b - a, crc(ids[a:b]))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected
    bins, least = check_packing(rows, [v[1] for v in expected.values()])
    assert bins <= least + 3


@pytest.mark.parametrize(("items", "rows"), [(200_000, 1_000_000), (40, 1_000_000), (10, 20)])
def test_rounds_of_bounded_tasks(spark, items, rows):
    draw = random.Random(items)
    lengths = [draw.randint(1, 1024) for _ in range(300)] + [600] * 50
    pieces = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long")
    found = packing.pack(pieces, items_per_task=items, rows_per_task=rows).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(350))
    check_packing(found, lengths)


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fill = packing.best_fit(np.array([7, 6, 3, 4, 10]), 10)
    assert bins.tolist() == [1, 2, 1, 2, 0] and offsets.tolist() == [0, 0, 7, 6, 0] and fill.tolist() == [10, 10, 10]


def test_packing_odd_rows(odd, none):
    rows = packing.pack(packing.token_pieces(odd)).collect()
    pieces = packing.token_pieces(odd).collect()
    assert len(rows) == len(pieces)
    check_packing(rows, [r["length"] for r in pieces])
    assert {r["doc_id"] for r in rows} == {None, *range(1, 9)}
    assert packing.pack(packing.token_pieces(none)).count() == 0
