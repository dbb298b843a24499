"""SimHash near-duplicate groups by covering locality-sensitive hashing.

1. Each text gets a 64-bit fingerprint: majority of the XXH64 bits of its word shingles (with repeats).
2. Distinct fingerprints are put in ``2^(radius+1) - 1`` tables. Table ``v`` keeps the bits ``i`` with an odd
   ``popcount(v & m(i))``, where ``m(i)`` is a non-zero vector of ``radius + 1`` bits. The vectors of at most
   ``radius`` differing positions never span that space, so some ``v`` is orthogonal to all of them: two
   fingerprints within the radius agree on all the bits which that table keeps. No link is lost.
3. Every bucket yields a spanning forest of its links (not its pairs). Buckets of more than ``bucket_limit``
   fingerprints are split by further structured masks, again without loss (see ``_refine``), so no task ever
   holds an unbounded bucket.
4. Connected components of the links come from alternating star contraction, in DataFrame joins.

Defined cases: a null or empty text (or one of white space only) has fingerprint 0 and links like any other;
null ids are kept as rows, form no representative of their own group unless no other id is there, and then
have a null component; repeated rows come out as often as they came in; an empty table gives an empty result;
other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed
from .components import connected_components
from .worker import release_memory

BITS = 64
SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
BUCKET_LIMIT = 4096

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint_of(text: bytes, words_per_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Fingerprint of one text (UTF-8), unsigned."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space characters
    if not words:
        return 0
    if len(words) <= words_per_shingle:
        shingles, count = [b" ".join(words)], 1
    else:
        count = len(words) - words_per_shingle + 1
        shingles = map(b" ".join, zip(*(words[k : k + count] for k in range(words_per_shingle)), strict=True))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=count)
    lanes = hashes.view(np.uint8).reshape(count, 8) + _BYTE_LANES
    ones = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(np.packbits(2 * ones > count, axis=1, bitorder="little").reshape(8).view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (signed 64-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            values = np.fromiter((fingerprint_of(t.as_py() or b"") for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])
        release_memory()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The structured masks, as unsigned integers."""
    vectors = (1 << (radius + 1)) - 1
    owner = [1 + i % vectors for i in range(bits)]
    return [sum(1 << i for i in range(bits) if (v & owner[i]).bit_count() & 1) for v in range(1, vectors + 1)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (indices) that connect what links of at most ``radius`` differing bits connect; breadth first, so at most n - 1."""
    left = np.arange(len(values))
    links: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= radius
            if near.any():
                found = left[near].tolist()
                links += zip(repeat(at), found)
                queue += found
                left = left[~near]
    return links


def _bucket_links(members: DataFrame, radius: int) -> DataFrame:
    """Spanning links of every bucket of ``(t, key, fp)``; buckets are bounded by the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t_rest, key_rest, fp_rest = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)

        def links_of(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.append(0, cuts), np.append(cuts, len(t))
            sizes = ends - starts
            two = starts[sizes == 2]
            close = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            a, b = [fp[close]], [fp[close + 1]]
            for start, end in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
                if links := forest(fp[start:end], radius):
                    pairs = np.array(links) + start
                    a.append(fp[pairs[:, 0]])
                    b.append(fp[pairs[:, 1]])
            columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)]
            return pa.RecordBatch.from_arrays(columns, ["src", "dst"])

        for batch in batches:
            t = np.concatenate([t_rest, batch.column(0).to_numpy(zero_copy_only=False)])
            key = np.concatenate([key_rest, batch.column(1).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp_rest, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(t):
                continue
            tail = np.flatnonzero((t != t[-1]) | (key != key[-1]))
            cut = int(tail[-1]) + 1 if len(tail) else 0  # the last bucket may go on in the next batch
            t_rest, key_rest, fp_rest = t[cut:], key[cut:], fp[cut:]
            if cut:
                yield links_of(t[:cut], key[:cut], fp[:cut])
        if len(t_rest):
            yield links_of(t_rest, key_rest, fp_rest)

    dealt = members.select("t", "key", "fp").repartition("t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInArrow(run, "src long, dst long")


def _refine(members: DataFrame, radius: int) -> DataFrame:
    """Links inside buckets over the limit, without looking at pairs.

    A bucket's first fingerprint (its leader) is linked to all that lie within the radius. If that is the whole
    bucket, nothing is left: its members are connected. Fingerprints of other buckets meet at midpoints.
    """
    leaders = members.groupBy("t", "key").agg(F.min("fp").alias("leader"))
    placed = members.join(leaders, ["t", "key"]).withColumn(
        "near", F.bit_count(F.col("fp").bitwiseXOR(F.col("leader"))) <= radius
    )
    stars = placed.where("near and fp <> leader").select(F.col("fp").alias("src"), F.col("leader").alias("dst"))
    unsettled = placed.where("not near").select("t", "key").distinct()
    rest = members.join(unsettled, ["t", "key"], "left_semi").select("fp").distinct()
    return stars.unionByName(_midpoint_links(rest, radius))


def _midpoint_links(fps: DataFrame, radius: int) -> DataFrame:
    """Exact links by shared midpoints: two values within the radius share a point within half of it (rounded up) of both.

    At most as many fingerprints lie around a point as its ball has points (2081 for radius 4), so no group is hot.
    For an even radius all members of a group are linked, so one link to the smallest will do.
    """
    half = (radius + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
        ball = np.zeros(1, np.uint64)
        for _ in range(half):
            ball = np.unique(np.concatenate([ball, (ball[:, None] ^ single[None, :]).ravel()]))
        for batch in batches:
            for x in batch.column(0).to_numpy(zero_copy_only=False):
                points = (ball ^ x.view(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(np.full(len(points), x))], ["point", "fp"])

    points = fps.mapInArrow(run, "point long, fp long")
    if radius % 2:  # members of a group need not all lie within an odd radius of each other: test neighbours in the group
        pairs = points.join(points.withColumnRenamed("fp", "dst"), "point").where("fp > dst")
    else:
        first = points.groupBy("point").agg(F.min("fp").alias("dst"))
        pairs = points.join(first, "point").where("fp <> dst")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("dst"))) <= radius
    return pairs.where(near).select(F.col("fp").alias("src"), "dst").distinct()


def hamming_links(fps: DataFrame, radius: int = RADIUS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links ``(src, dst)`` whose components are those of all pairs of ``fps.fp`` (distinct) within ``radius`` bits."""
    masks = covering_masks(radius)
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])
    tables = fps.select("fp", F.posexplode(keys).alias("t", "key"))
    crowded = tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = checkpointed(tables.join(crowded, ["t", "key"]).withColumn("t", F.col("t").cast("long")))
    small = _bucket_links(members.where(F.col("n") <= bucket_limit), radius)
    large = members.where(F.col("n") > bucket_limit).select("t", "key", "fp")
    links = small if large.isEmpty() else small.unionByName(_refine(large, radius))
    ordered = links.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    return ordered.distinct()


def near_duplicate_groups(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = RADIUS,
    bucket_limit: int = BUCKET_LIMIT,
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable by links)."""
    prints = checkpointed(fingerprints(df, id_col, text_col))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = hamming_links(distinct.select("fp"), radius, bucket_limit)
    groups = connected_components(links)  # node, root: only linked fingerprints
    rooted = distinct.join(groups, distinct.fp == groups.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_per_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Rows of ``df`` whose id is the smallest of its near-duplicate group; all columns as they were.

    Of rows that repeat the kept id, one stays: the first in the order of a hash of all columns. Rows with a null id
    can't be told apart, so they stay.
    """
    groups = near_duplicate_groups(df, id_col, text_col, radius)
    kept = groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias(id_col)).agg(F.count(F.lit(1)).alias("__rows"))
    kept = checkpointed(kept)
    rows = df.join(kept.select(id_col), id_col, "left_semi").select(df.columns)
    if not kept.where(F.col("__rows") > 1).isEmpty():
        rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(*df.columns)))
        rows = rows.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
    return rows.unionByName(df.where(F.col(id_col).isNull()))
