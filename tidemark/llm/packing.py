"""Hierarchical best-fit packing of documents into sequences of bounded length.

A document longer than a sequence is cut so that all its pieces but the first are exactly one sequence long; those
fill sequences of their own. The other pieces are packed in rounds. In a round every task packs its bins (at first:
pieces) best-fit, largest first, and closes those that are full or nearly so. What is
left open goes, as items as large as their content, to fewer tasks in the next round, and so on up a tree until one
task has held all that was left. A task is dealt about ``items_per_task`` bins and ``rows_per_task`` pieces at most: where
more remain open and a round no longer joins at least one in twenty, they are final.

Defined cases: a null or empty text has only its end token; null ids and repeated rows are packed as documents of their
own (pieces of equal ids can't be told apart); an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .encoding import encoder
from .tokens import END_ID
from .worker import release_memory

LENGTH = 1024
ITEMS_PER_TASK = 200_000
ROWS_PER_TASK = 1_000_000
NEARLY_FULL = 4  # tokens that a bin may lack to be closed before the last round
FAN_IN = 8

_PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END_ID,
    vocabulary: str | None = None,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``; texts themselves go no further."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            at = 0
            for ids, totals in encode(batch.column(1), end_id):
                whole = -(-totals // length)  # pieces of each document
                row = np.repeat(np.arange(len(totals)), whole)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
                first = totals - (whole - 1) * length
                end = first[row] + piece * length
                start = np.where(piece > 0, end - length, 0)
                place = 4 * np.repeat(np.cumsum(totals) - totals, whole)
                data = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(data[a:b]) for a, b in zip((place + 4 * start).tolist(), (place + 4 * end).tolist(), strict=True)]
                doc_ids = batch.column(0).slice(at, len(totals)).take(pa.array(row))
                at += len(totals)
                arrays = [doc_ids, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(end - start), pa.array(crcs, type=pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])
        release_memory()

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECE_SCHEMA)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and the fill of each bin. Room is found by one bit per residual."""
    bin_of, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    some = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = some >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                some ^= 1 << room
        else:
            at, room = len(fill), capacity
            fill.append(0)
        bin_of[i], offset[i] = at, fill[at]
        fill[at] += size
        if left := room - size:
            rooms[left].append(at)
            some |= 1 << left
    return bin_of, offset, np.array(fill, dtype=np.int64)


def _round(bins: DataFrame, number: int, capacity: int, slack: int) -> DataFrame:
    """Pack the bins of each partition; the rows of a bin are in one partition. ``slack`` below 0: all bins are closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [batch for batch in batches if batch.num_rows]
        if not tables:
            return
        rows = pa.Table.from_batches(tables).combine_chunks()
        _, first, of_row = np.unique(rows["sequence_id"].to_numpy(), return_index=True, return_inverse=True)
        bin_of, offset, fill = best_fit(rows["fill"].to_numpy()[first], capacity)
        new = bin_of[of_row]
        changed = {
            "sequence_id": new | np.int64(number << 56 | TaskContext.get().partitionId() << 28),
            "offset": offset[of_row] + rows["offset"].to_numpy(),
            "fill": fill[new].astype(np.int32),
            "open": (fill < capacity - slack)[new] & (slack >= 0),
        }
        for name, values in changed.items():
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values))
        yield from rows.to_batches(max_chunksize=100_000)

    return bins.mapInArrow(run, bins.schema)


def pack(
    pieces: DataFrame,
    capacity: int = LENGTH,
    items_per_task: int = ITEMS_PER_TASK,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``pieces`` (with a ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``."""
    items = materialise(pieces, "pieces")
    bins = items.withColumns(
        {
            "sequence_id": F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("long"),
            "fill": F.col("length").cast("int"),
            "open": F.col("length") < capacity,
        }
    )
    wanted = [*items.columns, "sequence_id", "offset"]
    result = bins.where("not open").withColumn("sequence_id", -1 - F.col("sequence_id")).select(wanted)
    left = bins.where("open")
    count, rows = left.count(), 0
    tasks = -(-count * FAN_IN // items_per_task)
    for number in range(64):
        if not count:
            break
        least = max(-(-count // items_per_task), -(-rows // rows_per_task))
        tasks = max(tasks, least)
        packed = materialise(_round(left.repartition(tasks, "sequence_id"), number, capacity, -1 if tasks == 1 else NEARLY_FULL), "packed")
        result = result.unionByName(packed.where("not open").select(wanted))
        left, before = packed.where("open"), count
        count, rows = left.agg(F.count_distinct("sequence_id"), F.count(F.lit(1))).first()
        if tasks == least and count > 0.95 * before:
            return result.unionByName(left.select(wanted))
        tasks = -(-tasks // FAN_IN)
    return result
