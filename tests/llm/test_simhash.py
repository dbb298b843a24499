from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import connected_components
from tidemark.llm.queries import op1_simhash


def plain_fingerprint(text):
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(table)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    """Smallest id reachable, by comparing all pairs."""
    ids = list(prints)
    group = {i: i for i in ids}
    while True:
        before = dict(group)
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= radius:
                    group[a] = group[b] = min(group[a], group[b])
        if group == before:
            return group


def test_fingerprints_and_components_of_the_whole_table(spark, sf_dir, texts):
    rows = op1_simhash(spark, sf_dir).collect()
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in rows} == prints
    assert {r["doc_id"]: r["component_id"] for r in rows} == components(prints)


@pytest.mark.parametrize("radius", [0, 1, 2, 4, 5])
def test_masks_cover_the_radius(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    draw = random.Random(radius)
    for _ in range(500):
        flips = sum(1 << b for b in draw.sample(range(64), radius))
        assert any(mask & flips == 0 for mask in masks)


def near_values(seed=3):
    draw, out = random.Random(seed), set()
    for _ in range(6):
        base = draw.getrandbits(64)
        out |= {base ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 6))) for _ in range(40)}
    return sorted(out)


@pytest.mark.parametrize("limit", [2, 5, 4096])
@pytest.mark.parametrize("radius", [3, 4])
def test_crowded_buckets_lose_no_link(spark, radius, limit):
    values = near_values()
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.hamming_links(spark.createDataFrame([(v,) for v in signed], "fp long"), radius, limit)
    pairs = [(r["src"], r["dst"]) for r in links.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= radius for a, b in pairs)
    group = {v: v for v in signed}
    for _ in values:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    expected = components({v: v & (1 << 64) - 1 for v in signed}, radius)
    assert group == expected


def test_long_chains_are_connected(spark):
    n = 300
    links = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001), (7, 7)], "src long, dst long")
    roots = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert roots == {k: 0 for k in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert connected_components(links.where("false")).count() == 0


def test_forest_connects_what_links_connect():
    values = np.array(near_values(5), dtype=np.uint64)
    links = simhash.forest(values, 4)
    assert len(links) < len(values) and all(int(values[a] ^ values[b]).bit_count() <= 4 for a, b in links)


def test_odd_rows(odd, none):
    rows = simhash.near_duplicate_groups(odd).collect()
    assert len(rows) == odd.count()
    of = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows}
    assert of[1] == of[2] and of[2][1] == 1 and of[None] == of[1]
    assert of[3] == of[4] == of[8] == ("0" * 16, 3)
    assert simhash.near_duplicate_groups(none).count() == 0


def test_one_document_of_each_group_stays(odd, none):
    kept = simhash.keep_one_per_group(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 3, 5, 6, 7, None]
    assert simhash.keep_one_per_group(none).count() == 0
