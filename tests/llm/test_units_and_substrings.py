from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tidemark.llm import substrings, unit_dedup
from tidemark.llm.queries import op5_unit_dedup, op7_substring_dedup


def without_repeats(texts):
    seen, out = set(), {}
    for doc_id in sorted(texts):
        kept, at = [], 0
        for start, end, digest in unit_dedup.units_of(texts[doc_id]):
            if digest in seen:
                kept.append(texts[doc_id][at:start])
                at = end
            seen.add(digest)
        out[doc_id] = "".join(kept) + texts[doc_id][at:]
    return out


def test_units_of_the_whole_table(spark, sf_dir, texts):
    rows = op5_unit_dedup(spark, sf_dir).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == without_repeats(texts)
    for row in rows:
        cut = texts[row["doc_id"]]
        for one in reversed(row["removed"]):
            assert (one["first_doc"], one["first_start"]) < (row["doc_id"], one["start"])
            cut = cut[: one["start"]] + cut[one["end"] :]
        assert cut == row["text"]


def test_units_are_lines_and_sentences():
    text = "One two three four five.  ONE two  three four five.\nshort one.\nsix seven eight nine ten"
    found = unit_dedup.units_of(text)
    assert [text[a:b] for a, b, _ in found] == ["One two three four five.", "ONE two  three four five.", "six seven eight nine ten"]
    assert found[0][2] == found[1][2] != found[2][2]


def test_repeated_lines_go_whole(spark, sf_dir, texts):
    """Lines are compared here, not units: nothing may be left of a line of five words or more that equals an earlier one."""
    seen, repeats = set(), 0
    removed = {r["doc_id"]: r["removed"] for r in op5_unit_dedup(spark, sf_dir).collect()}
    for doc_id in sorted(texts):
        left, at = list(texts[doc_id]), 0
        for one in removed[doc_id]:
            left[one["start"] : one["end"]] = " " * (one["end"] - one["start"])
        for line in texts[doc_id].split("\n"):
            normal = " ".join(line.lower().split())
            if len(normal.split()) >= 5 and normal in seen:
                repeats += 1
                assert not "".join(left[at : at + len(line)]).strip()
            seen.add(normal)
            at += len(line) + 1
    assert repeats


def test_short_sentences_go_with_what_is_around_them(spark):
    long, other = "The long sentence number one is here.", "Some other sentence of many words follows."
    texts = {1: "Yes. No. Why not? Well.", 2: "YES. No.  Why not? Well.", 3: f"{long} Stop. Go. {other} Yes.", 4: f"First of all. {long} Stop. Go. {other} No.", 5: "Stop. Go.", 6: f"{other} Stop. Go. {long}"}
    rows = unit_dedup.remove_repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    kept = {r["doc_id"]: " ".join(r["text"].split()) for r in rows}
    assert kept == {1: texts[1], 2: "", 3: texts[3], 4: "First of all. No.", 5: "Stop. Go.", 6: "Stop. Go."}


def test_units_of_odd_rows(odd, none):
    found = unit_dedup.remove_repeats(odd)
    assert found.columns == [*(c for c in odd.columns if c != "removed"), "removed"] and found.count() == odd.count()
    of = {}
    for row in found.collect():
        of.setdefault(row["doc_id"], []).append(row)
    assert of[1][0]["text"] == of[1][1]["text"] and len(of[1][0]["removed"]) == 7  # eight equal sentences
    assert of[2][0]["text"].split() == [] and of[None][0]["text"].split() == []
    assert of[4][0]["text"] is None and of[3][0]["text"] == "" and of[4][0]["removed"] == []
    assert unit_dedup.remove_repeats(none).count() == 0


def brute(texts, length=100):
    """Bytes covered by a string seen before, window by window."""
    seen, out = set(), {}
    for doc_id, text in texts:
        data = (text or "").encode()
        covered = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            if window in seen:
                covered[k : k + length] = True
            seen.add(window)
        runs = int((np.diff(np.append(0, covered.astype(int))) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~covered[:-1]])
        out[doc_id] = (len(data), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_of_the_whole_table(spark, sf_dir, texts):
    rows = op7_substring_dedup(spark, sf_dir).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == brute(sorted(texts.items()))


@pytest.mark.parametrize("hot", [2, 20_000])
def test_substrings_of_repetitive_texts(spark, hot):
    draw = random.Random(2)
    texts = [(k, "".join(draw.choice("ab") for _ in range(draw.randint(0, 60))) * draw.randint(0, 4)) for k in range(200)]
    texts += [(300, "a" * 3000), (301, "a" * 150), (302, None), (303, ""), (304, "é" * 50)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    rows = substrings.find_repeats(frame, length=12, gram=4, hot=hot).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in rows} == brute(texts, 12)


def test_long_texts_are_looked_at_in_stretches(monkeypatch):
    data = np.random.default_rng(0).integers(97, 99, 5000).astype(np.uint8)
    whole = substrings.anchors(data, 20, 6)
    monkeypatch.setattr(substrings, "STRIDE", 700)
    parts = substrings.anchors(data, 20, 6)
    served = lambda found: {(n, a, s) for n, a, f, l in zip(*found, strict=True) for s in range(f, l + 1)}  # noqa: E731, E741
    assert served(whole) == served(parts) and len(served(whole)) == 5000 - 19


def test_every_string_has_one_anchor():
    data = np.frombuffer(b"abcabcabcabd" * 40, np.uint8)
    _, at, first, last = substrings.anchors(data, 30, 10)
    starts = np.concatenate([np.arange(f, l + 1) for f, l in zip(first, last, strict=True)])  # noqa: E741
    assert starts.tolist() == list(range(len(data) - 29))
    assert all(f <= a - 0 and a + 10 <= l + 30 for a, f, l in zip(at, first, last, strict=True))  # noqa: E741


def test_substrings_of_odd_rows(odd, none):
    rows = substrings.find_repeats(odd).collect()
    assert len(rows) == odd.count()
    ones = sorted(r["n_removed"] for r in rows if r["doc_id"] == 1)
    twos = [r for r in rows if r["doc_id"] == 2]
    assert ones[1] == twos[0]["n_removed"] == twos[0]["n_bytes"] and 0 < ones[0] < ones[1]
    assert [r["n_bytes"] for r in rows if r["doc_id"] in (3, 4)] == [0, 0]
    assert substrings.find_repeats(none).count() == 0
