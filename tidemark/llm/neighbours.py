"""Approximate nearest neighbours by largest inner product: NN-descent builds the graph, greedy search answers.

1. Equal vectors become one node (the smallest id), so that copies neither crowd the graph nor make hot groups;
   each node keeps the ids of its copies that can matter, the smallest ones.
2. The graph starts from random hyperplane trees with small leaves: nodes with the same side of all of a tree's planes share
   a leaf and are compared there. Crowded leaves are cut into slices along one more direction of the tree, at its quantiles; only
   slices that are still crowded (more than ``SLICES`` would be needed, or equal places) are dealt by a hash.
3. NN-descent rounds are Spark joins: each node's neighbours, forward and backward, meet at it with their vectors, and those pairs of
   them of which one is new there are compared. Pairs better than what an end already has become new edges.
   Each node keeps its best (``degree_for``). Rounds end when at most ``STILL`` of the edges are new.
4. Nodes are stored in blocks in the shared folder, each with its neighbours' ids and half-precision vectors. A search
   keeps a pool per query and expands its best unexpanded nodes: the query goes to the blocks of these nodes,
   scores their neighbours there, and what beats its pool comes back, until hardly a pool's node is unexpanded (``SETTLED``).
5. The effort follows the table: for ``SAMPLE`` queries the nearest are also found by a scan, and the pools are doubled and searched
   on until the sample's recall is ``TARGET`` or pools hold all nodes. The scan decides how long to search, never an answer.
6. The pool's best are scored again in double precision on the original vectors, and copies take their nodes' score.

Everything a task holds is bounded: a leaf, a batch of nodes with at most twice ``degree_for`` neighbours, a block, a batch of pools.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of
another length than most (of equally many lengths the smaller); null ids take no part; of repeated ids one
row counts for each different vector; fewer candidates than asked for give all of them; an empty table gives an empty result;
ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, scratch_path
from .worker import file_system

TREES = 8
LEAF = 500
LEAF_EDGES = 12
DEGREE = 16
SLICES = 256
STILL = 0.03
BLOCK_NODES = 2048
POOL = 256
NEIGHBOURS = 20
SETTLED = 16
SAMPLE = 256
TARGET = 0.93
SEED = 5


def degree_for(count: int) -> int:
    """Edges of a node: ``DEGREE``, and from 50,000 nodes four more each time that their number doubles."""
    return DEGREE + round(4 * math.log2(max(count / 50_000, 1)))


def pool_for(count: int) -> int:
    """Nodes that a query's pool holds at first."""
    return max(POOL, 2 * math.isqrt(count))


def valid_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id``, ``vector`` (array of double) of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["size"] if sizes else 0))


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    """Rows of equally long binary values."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(len(values), -1)


def _sorted_runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Batches of a partition that is sorted by a column, cut so that no run of equal values is split."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]) if rest is not None else rows
        if not rows.num_rows:
            continue
        key = rows.column(column).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        rest = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def _flat(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column end to end, and the length of each list (0 for null)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype), lengths


def _list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), pa.array(values))


def _rank_in_group(group: np.ndarray) -> np.ndarray:
    """Position of each element in its run of equal values."""
    if not len(group):
        return np.zeros(0, np.int64)
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return np.arange(len(group)) - np.repeat(begin, np.diff(np.append(begin, len(group))))


def _as_nodes(vectors: DataFrame) -> DataFrame:
    """``node``, ``v`` (float32 bytes), ``h`` (float16 bytes) from the smallest id of each different vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, lengths = _flat(batch.column(1), np.float64)
            x = values.reshape(len(lengths), -1) if len(lengths) else np.zeros((0, 1))
            packed = [pa.array([row.tobytes() for row in part], type=pa.binary()) for part in (np.clip(x, -3e38, 3e38).astype("<f4"), np.clip(x, -6e4, 6e4).astype("<f2"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *packed], ["node", "v", "h"])

    return vectors.mapInArrow(run, "node long, v binary, h binary")


def _leaves(nodes: DataFrame, count: int, mean: np.ndarray, trees: int, leaf: int) -> DataFrame:
    """``tree``, ``code``, ``along``, ``node``, ``v``: a row of each node for each tree, with its place along a direction."""
    planes = max(0, math.ceil(math.log2(max(count / leaf, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(SEED)
        directions = random.standard_normal((trees, len(mean), planes + 1)).astype(np.float32)
        bits = 1 << np.arange(planes, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), "<f4") - mean
            for tree in range(trees):
                places = x @ directions[tree]
                code = (places[:, :planes] > 0) @ bits if planes else np.zeros(len(x), np.int64)
                columns = [pa.array(np.full(len(x), tree, np.int32)), pa.array(code.astype(np.int64)), pa.array(places[:, planes]), batch.column(0), batch.column(1)]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "code", "along", "node", "v"])

    return nodes.mapInArrow(run, "tree int, code long, along float, node long, v binary")


def _edges_in_leaves(leaves: DataFrame, leaf: int, degree: int) -> DataFrame:
    """``a``, ``b``, ``s``: each node's best in each of its leaves."""
    quantiles = F.percentile_approx("along", [k / SLICES for k in range(1, SLICES)], 10_000)
    few = leaves.groupBy("tree", "code").agg(F.least(F.ceil(F.count(F.lit(1)) / leaf), F.lit(SLICES)).alias("slices"), quantiles.alias("cuts"))
    wanted = F.transform(F.sequence(F.lit(1), F.col("slices") - 1), lambda k: F.element_at("cuts", F.ceil(k * SLICES / F.col("slices")).cast("int")))
    few = few.select("tree", "code", F.when(F.col("slices") > 1, wanted).otherwise(F.array().cast("array<float>")).alias("cuts"))
    behind = F.size(F.filter("cuts", lambda cut: cut < F.col("along")))
    sliced = materialise(leaves.join(few, ["tree", "code"]).select("tree", "code", behind.alias("slice"), "node", "v"), "slices")
    sizes = sliced.groupBy("tree", "code", "slice").agg(F.ceil(F.count(F.lit(1)) / (1.25 * leaf)).alias("parts"))  # quantiles are approximate
    salted = sliced.join(sizes, ["tree", "code", "slice"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))

    def run(rows: pa.Table) -> pa.Table:
        ids, x = rows["node"].to_numpy(), _matrix(rows["v"].combine_chunks(), "<f4")
        k = min(degree, len(ids) - 1)
        if k < 1:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "s": pa.array([], pa.float32())})
        best, scores = [], []
        for at in range(0, len(ids), 512):
            s = x[at : at + 512] @ x.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            best.append(top)
            scores.append(np.take_along_axis(s, top, axis=1))
        return pa.table({"a": np.repeat(ids, k), "b": ids[np.concatenate(best).ravel()], "s": np.concatenate(scores).ravel().astype(np.float32)})

    return salted.select("tree", "code", "slice", "part", "node", "v").groupBy("tree", "code", "slice", "part").applyInArrow(run, "a long, b long, s float")


def _best(edges: DataFrame, degree: int, only_fresh: bool = False) -> DataFrame:
    """The ``degree`` best edges of each ``a``; an edge is ``fresh`` if all that say so are. ``only_fresh``: of ``a`` that has a fresh one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _sorted_runs(batches, 0):
            a, b, s, fresh = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            order = np.lexsort((fresh, b, -s, a))  # an edge has one score, up to its last bits; copies of one edge are next to each other
            a, b, s, fresh = a[order], b[order], s[order], fresh[order]
            order = np.lexsort((fresh, b, a))
            first = order[np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))]
            keep = np.zeros(len(a), bool)
            keep[first] = True
            a, b, s, fresh = a[keep], b[keep], s[keep], fresh[keep]
            few = _rank_in_group(a) < degree
            a, b, s, fresh = a[few], b[few], s[few], fresh[few]
            if only_fresh:
                some = np.isin(a, a[fresh])
                a, b, s, fresh = a[some], b[some], s[some], fresh[some]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, s, fresh)], ["a", "b", "s", "fresh"])

    dealt = edges.select("a", "b", "s", "fresh").repartition("a").sortWithinPartitions("a")
    return dealt.mapInArrow(run, "a long, b long, s float, fresh boolean")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "s", "fresh").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "s", "fresh"))


def _descend(edges: DataFrame, nodes: DataFrame, degree: int) -> DataFrame:
    """New edges found by comparing the neighbours of each node with each other; one of a pair is a fresh neighbour."""
    worst = edges.groupBy("a").agg(F.min("s").alias("worst")).withColumnRenamed("a", "m")
    members = _best(_both_ways(edges), 2 * degree, only_fresh=True).select(F.col("a").alias("w"), F.col("b").alias("m"), "fresh")
    half = nodes.join(worst, nodes.node == F.col("m")).select("m", "h", "worst")
    dealt = members.join(half, "m").repartition("w").sortWithinPartitions("w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _sorted_runs(batches, 0):
            w, ids, fresh, worst = (rows.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 4))
            x = _matrix(rows.column(3), "<f2").astype(np.float32)
            starts = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
            sizes = np.diff(np.append(starts, len(w)))
            a, b, s = [], [], []
            for lo in range(0, len(starts), 256):
                st, sz = starts[lo : lo + 256], sizes[lo : lo + 256]
                wide = int(sz.max())
                at = np.minimum(st[:, None] + np.arange(wide), len(w) - 1)
                there = np.arange(wide) < sz[:, None]
                group = x[at]
                scores = group @ group.transpose(0, 2, 1)
                new = fresh[at]
                good = (scores > worst[at][:, :, None]) & (new[:, :, None] | new[:, None, :]) & there[:, :, None] & there[:, None, :]
                good[:, np.arange(wide), np.arange(wide)] = False
                g, i, j = np.nonzero(good)
                a.append(ids[at[g, i]])
                b.append(ids[at[g, j]])
                s.append(scores[g, i, j])
            a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
            order = np.lexsort((b, -s, a))  # only a node's best can become its edges
            a, b, s = a[order], b[order], s[order]
            once = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.zeros(0, bool)
            a, b, s = a[once], b[once], s[once]
            few = _rank_in_group(a) < degree
            yield pa.RecordBatch.from_arrays([pa.array(a[few]), pa.array(b[few]), pa.array(s[few].astype(np.float32))], ["a", "b", "s"])

    found = dealt.select("w", "m", "fresh", "h", "worst").mapInArrow(run, "a long, b long, s float")
    return found.withColumn("fresh", F.lit(True))


def _block(node: np.ndarray, blocks: int) -> np.ndarray:
    return (node ^ node >> 7 ^ node >> 17) % blocks


def build_graph(nodes: DataFrame, path: str, trees: int = TREES, leaf: int = LEAF, degree: int | None = None, rounds: int | None = None) -> int:
    """Write the neighbour graph of ``nodes`` (``node``, ``v``, ``h``) below ``path``, in blocks; their number is returned.

    ``rounds``: at most so many, else until the edges hardly change.
    """
    count = nodes.count()
    degree = degree or degree_for(count)
    blocks = max(1, -(-count // BLOCK_NODES))
    width = 2 * degree

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            if batch.num_rows:
                part = _matrix(batch.column(0), "<f4").sum(axis=0, dtype=np.float64)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "x"])

    means = nodes.select("v").mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toArrow()
    mean = (means["x"].to_numpy() / max(count, 1)).astype(np.float32)
    first = _edges_in_leaves(_leaves(nodes.select("node", "v"), count, mean, trees, leaf), leaf, LEAF_EDGES).withColumn("fresh", F.lit(True))
    edges = materialise(_best(first, degree), "edges")
    for _ in itertools.count() if rounds is None else range(rounds):
        seen = edges.withColumn("fresh", F.lit(False))
        old, edges = edges, materialise(_best(seen.unionByName(_descend(edges, nodes, degree)), degree), "edges")
        discard(old)
        fresh, total = edges.agg(F.count_if("fresh"), F.count(F.lit(1))).first()
        if fresh <= STILL * total:
            break
    around = _best(_both_ways(edges), width)
    vectors = nodes.select(F.col("node").alias("b"), "h")
    lists = around.join(vectors, "b").groupBy("a").agg(F.collect_list(F.struct("b", "h")).alias("n"))
    lists = nodes.select(F.col("node").alias("a")).join(lists, "a", "left")
    size = 2 * len(mean)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                lengths = batch.column(1).value_lengths().fill_null(0).to_numpy().astype(np.int64)
                members = batch.column(1).flatten()
                row = np.repeat(np.arange(len(lengths)), lengths)
                place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                near = np.full((len(lengths), width), -1, dtype="<i8")
                vectors = np.zeros((len(lengths), width, size), dtype=np.uint8)
                if len(row):
                    near[row, place] = members.field("b").to_numpy(zero_copy_only=False)
                    vectors[row, place] = _matrix(members.field("h"), "u1")
                ids = batch.column(0).to_numpy()
                packed = [pa.array([x.tobytes() for x in part], type=pa.binary()) for part in (near, vectors)]
                yield pa.RecordBatch.from_arrays([pa.array(_block(ids, blocks)), pa.array(ids), *packed], ["block", "node", "near", "vectors"])

    packed = lists.mapInArrow(pack, "block long, node long, near binary, vectors binary")
    packed.repartition("block").write.partitionBy("block").parquet(path)
    discard(edges)
    return blocks


_POOLS = "query long, h binary, ids array<long>, scores array<float>, done array<boolean>"


def start_pools(queries: DataFrame) -> DataFrame:
    """Pools that hold only the query's own node. ``queries``: ``query`` (a node of the graph), ``h``."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), "<f2").astype(np.float32) if batch.num_rows else np.zeros((0, 1), np.float32)
            ones = np.ones(len(x), np.int64)
            own = (x * x).sum(axis=1).astype(np.float32)
            columns = [_list_array(batch.column(0).to_numpy(), ones), _list_array(own, ones), _list_array(np.zeros(len(x), bool), ones)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["query", "h", "ids", "scores", "done"])

    return materialise(queries.select("query", "h").mapInArrow(begin, _POOLS), "pools")


def search(state: DataFrame, path: str, blocks: int, pool: int = POOL, beam: int | None = None) -> DataFrame:
    """``state`` (a table of pools, which is discarded) searched on with pools of ``pool`` nodes.

    A query is done when at most one in ``SETTLED`` of its pool's nodes is unexpanded. A pool's worst score only rises, so every
    search ends.
    """
    beam = beam or pool

    def frontier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                ids, lengths = _flat(batch.column(2), np.int64)
                scores, _ = _flat(batch.column(3), np.float32)
                done, _ = _flat(batch.column(4), bool)
                row = np.repeat(np.arange(len(lengths)), lengths)
                last = np.cumsum(lengths) - 1
                least = np.where(lengths >= pool, scores[last], -np.inf).astype(np.float32)
                waiting = np.flatnonzero(~done)  # pools are in order of score
                waiting = waiting[_rank_in_group(row[waiting]) < beam]
                home = _block(ids[waiting], blocks)
                order = np.lexsort((home, row[waiting]))
                node, home, row = ids[waiting][order], home[order], row[waiting][order]
                new = np.flatnonzero(np.append(True, (home[1:] != home[:-1]) | (row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
                counts = np.diff(np.append(new, len(row)))
                sent = pa.array(row[new])
                columns = [pa.array(home[new]), batch.column(0).take(sent), batch.column(1).take(sent), _list_array(node, counts), pa.array(least[row[new]])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "query", "h", "nodes", "least"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(path)
        held = -1
        for batch in batches:
            block = batch.column(0).to_numpy()
            for lo in np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else ():
                if block[lo] != held:
                    held = int(block[lo])
                    rows = pq.read_table(f"{folder}/block={held}", filesystem=store, partitioning=None)
                    node = rows["node"].to_numpy()
                    order = np.argsort(node)
                    node, near = node[order], _matrix(rows["near"], "<i8")[order]
                    vectors = _matrix(rows["vectors"], "<f2").reshape(*near.shape, -1)[order]
                end = int(np.searchsorted(block, block[lo], side="right")) if lo + 1 < len(block) else len(block)
                for at in range(int(lo), end, 64):
                    part = batch.slice(at, min(64, end - at))
                    wanted, counts = _flat(part.column(3), np.int64)
                    row = np.repeat(np.arange(len(counts)), counts)
                    x = _matrix(part.column(2), "<f2").astype(np.float32)
                    least = part.column(4).to_numpy()
                    place = np.searchsorted(node, wanted)
                    ids = near[place]
                    scores = np.matmul(vectors[place].astype(np.float32), x[row][:, :, None])[:, :, 0]
                    good = (ids >= 0) & (scores > least[row][:, None])
                    pair, _ = np.nonzero(good)
                    found = np.bincount(row[pair], minlength=len(counts))
                    columns = [part.column(1), _list_array(ids[good], found), _list_array(scores[good].astype(np.float32), found)]
                    yield pa.RecordBatch.from_arrays(columns, ["query", "ids", "scores"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pools (rows with a vector) and what their expansions found; what was sent out is done now."""
        for rows in _sorted_runs(batches, 0):
            query = rows.column(0).to_numpy()
            ids, lengths = _flat(rows.column(2), np.int64)
            scores, _ = _flat(rows.column(3), np.float32)
            marks, marked = _flat(rows.column(4), bool)
            row = np.repeat(np.arange(len(lengths)), lengths)
            done = np.zeros(len(ids), bool)
            old = np.flatnonzero(np.repeat(marked > 0, lengths))
            done[old] = marks
            waiting = old[~marks]
            done[waiting[_rank_in_group(row[waiting]) < beam]] = True
            owner = query[row]
            order = np.lexsort((~done, ids, owner))
            ids, scores, done, owner = ids[order], scores[order], done[order], owner[order]
            once = np.append(True, (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1]))
            ids, scores, done, owner = ids[once], scores[once], done[once], owner[once]
            order = np.lexsort((ids, -scores, owner))
            ids, scores, done, owner = ids[order], scores[order], done[order], owner[order]
            few = _rank_in_group(owner) < pool
            ids, scores, done, owner = ids[few], scores[few], done[few], owner[few]
            holder = np.flatnonzero(marked > 0)  # rows with the vectors, in order of query
            size = np.diff(np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(owner)))
            lists = [_list_array(x, size) for x in (ids, scores, done)]
            h = rows.column(1).combine_chunks()
            h = h.chunk(0) if isinstance(h, pa.ChunkedArray) else h
            yield pa.RecordBatch.from_arrays([pa.array(query[holder]), h.take(pa.array(holder)), *lists], ["query", "h", "ids", "scores", "done"])

    waits = F.size(F.filter("done", lambda done: ~done)) > F.least(F.lit(pool), F.size("done")) / F.lit(SETTLED)
    while not state.where(waits).isEmpty():
        active = state.where(waits)
        sent = active.mapInArrow(frontier, "block long, query long, h binary, nodes array<long>, least float")
        found = sent.repartition("block").sortWithinPartitions("block").mapInArrow(expand, "query long, ids array<long>, scores array<float>")
        empty = found.select("query", F.lit(None).cast("binary").alias("h"), "ids", "scores", F.lit(None).cast("array<boolean>").alias("done"))
        merged = active.unionByName(empty).repartition("query").sortWithinPartitions("query").mapInArrow(merge, _POOLS)
        old, state = state, materialise(merged.unionByName(state.where(~waits)), "pools")
        discard(old)
    return state


def scanned(nodes: DataFrame, sample: pa.Table, neighbours: int) -> DataFrame:
    """``query``, ``node``: the nearest of a bounded sample of nodes (``node``, ``v``) by a scan over all."""
    asked = sample["node"].to_numpy()
    x = _matrix(sample["v"], "<f4") if len(asked) else np.zeros((0, 1), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(asked):
                ids = batch.column(0).to_numpy()
                scores = x @ _matrix(batch.column(1), "<f4").T
                scores[asked[:, None] == ids[None, :]] = -np.inf
                k = min(neighbours, len(ids))
                top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                best = np.take_along_axis(scores, top, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, k)), pa.array(ids[top].ravel()), pa.array(best.ravel())], ["query", "node", "s"])

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "node"))
    found = nodes.select("node", "v").mapInArrow(run, "query long, node long, s float").where(F.col("s") > float("-inf"))
    return found.withColumn("r", rank).where(F.col("r") <= neighbours).select("query", "node")


def search_to_recall(nodes: DataFrame, queries: DataFrame, path: str, blocks: int, neighbours: int = NEIGHBOURS, pool: int | None = None, target: float = TARGET) -> DataFrame:
    """Pools of all ``queries`` (``query``, ``v``, ``h``), doubled until a sample's recall is the target."""
    count = nodes.count()
    sample = queries.orderBy(F.xxhash64("query"), "query").limit(SAMPLE).select(F.col("query").alias("node"), "v").toArrow()
    truth = materialise(scanned(nodes, sample, neighbours), "truth")
    wanted = truth.count()
    state = start_pools(queries)
    pool = pool or pool_for(count)
    while True:
        state = search(state, path, blocks, pool)
        others = F.slice(F.filter("ids", lambda i: i != F.col("query")), 1, neighbours)
        found = state.select("query", F.explode(others).alias("node")).join(F.broadcast(truth), ["query", "node"], "left_semi").count()
        if found >= target * wanted or pool >= count:
            discard(truth)
            return state
        pool *= 2
        again = F.transform("done", lambda _: F.lit(False))
        old, state = state, materialise(state.withColumn("done", again), "pools")
        discard(old)


def nearest(
    df: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the valid rows on which ``is_query`` (a column of ``vec_id``) holds."""
    spark = df.sparkSession
    rows = valid_vectors(df, id_col, vector_col).distinct()
    copy = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    # The smallest ids of each vector are all that can be among its nearest; the limit is taken before the shuffle.
    few = materialise(rows.withColumn("copy", copy).where(F.col("copy") <= neighbours + 1), "copies")
    firsts = few.where("copy = 1").select(F.col("vec_id").alias("node"), "vector")
    of_node = few.join(firsts, "vector").select("node", "vec_id")
    nodes = materialise(_as_nodes(firsts.select("node", "vector")), "nodes")
    path = scratch_path(spark, "graph")
    blocks = build_graph(nodes, path)
    asked = materialise(rows.where(is_query).join(firsts, "vector").select(F.col("vec_id").alias("query_id"), "node"), "asked")
    queries = asked.select("node").distinct().join(nodes, "node").select(F.col("node").alias("query"), "v", "h")
    pools = search_to_recall(nodes, materialise(queries, "queries"), path, blocks, neighbours)
    best = pools.select("query", F.explode(F.slice("ids", 1, 2 * neighbours + 8)).alias("node"))
    left, right = firsts.select(F.col("node").alias("query"), F.col("vector").alias("x")), firsts.withColumnRenamed("vector", "y")
    exact = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda total, p: total + p)
    scored = best.join(right, "node").join(left, "query").select("query", "node", exact.alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    scored = materialise(scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= neighbours + 1).drop("r"), "scored")
    pairs = asked.withColumnRenamed("node", "query").join(scored, "query").join(of_node, "node").where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = pairs.select("query_id", F.row_number().over(final).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= neighbours)
