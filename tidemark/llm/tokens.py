"""Token ids of texts, and files of them.

Encoding is in ``encoding``. The ids of the texts are kept once, compressed, until the files are there.

Files. Ids are replaced by their frequency rank over the whole input, and ranks are written with one to four bytes each. Their lengths sit apart in control bytes (two bits a rank, four ranks a byte), so that a block is decoded
without branches: numpy looks all lengths up in a table of 256 rows. A file holds blocks of about a million tokens:

    magic "TIDEIDS1", then per block: documents u32, tokens u64, control bytes u64, data bytes u64,
    document ids i64 each, null flags u8 each, tokens per document u32 each, control bytes, data bytes

Documents are in ascending id order over all the files. ``manifest`` (Parquet, written last; one row for each of at most ``MOST_FILES`` files) names the files that count, so
files of failed or repeated task attempts are never read; ``dictionary`` (Parquet) has the id of each rank.

Defined cases: a null or empty text has no ids (and only the end id where one is asked for); a null id comes first;
rows with equal ids are ordered by a hash of the text, and dealt over several files by it where one id has more tokens than a file;
an empty table gives a manifest without rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import remove_path, scratch_path
from .encoding import encoder
from .worker import file_system, release_memory

END_ID = 2
BLOCK_TOKENS = 1 << 20
TOKENS_PER_FILE = 1 << 23
MOST_FILES = 20_000  # beyond that files grow, so that what the driver sketches doesn't
MAGIC = b"TIDEIDS1"

def encode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = END_ID,
    vocabulary: str | None = None,
) -> DataFrame:
    """``doc_id``, ``text_hash`` (to order rows of equal ids), ``ids`` (bytes of the encoder's kind), ``counts``.

    Behind its documents each task adds a row that only has ``counts``: how often it met each id (64 bits each).
    """
    names = ["doc_id", "text_hash", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts = encoder(vocabulary)
        width = np.dtype(encode_texts.kind).itemsize
        total = np.zeros(encode_texts.size, dtype=np.int64)
        for batch in batches:
            at = 0
            for ids, counts in encode_texts(batch.column(2), end_id):
                total += np.bincount(ids, minlength=len(total))
                rows = batch.slice(at, len(counts))
                at += len(counts)
                offsets = pa.py_buffer(np.append(0, width * np.cumsum(counts)).astype("<i4"))
                packed = pa.Array.from_buffers(pa.binary(), len(counts), [None, offsets, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), packed, pa.nulls(len(counts), pa.binary())], names)
        nothing = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array([total.tobytes()], type=pa.binary())], names)
        release_memory()

    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, ids binary, counts binary")


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _flat_ids(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and how many each row has; no row is copied by itself."""
    if not len(column):
        return np.zeros(0, id_type(size)), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype="<i4")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    width = np.dtype(id_type(size)).itemsize
    data = column.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return flat.view(id_type(size)), np.diff(offsets) // width


def token_counts(encoded: DataFrame) -> DataFrame:
    """``id``, ``n`` over all texts: the tasks' counts, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                counts = np.frombuffer(row.as_buffer(), dtype="<i8")
                used = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["id", "n"])

    counted = encoded.where("counts is not null").select("counts")
    return counted.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def frequency_ranks(counts: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Id of each rank, and the number of ids. Most frequent first, ties and unused ids by id; one row per id reaches the driver."""
    n = np.zeros(size, dtype=np.int64)
    rows = counts.where(F.col("id") < size).toArrow()
    n[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return np.lexsort((np.arange(size), -n)).astype("<u4"), int(n.sum())


def pack_ranks(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of consecutive streams of ``counts`` unsigned 16- or 32-bit values each."""
    extra = (ranks > 0xFF).astype(np.uint8)
    if ranks.dtype.itemsize > 2:
        extra += (ranks > 0xFFFF).astype(np.uint8) + (ranks > 0xFFFFFF)
    lanes = -(-counts // 4) * 4
    ends, lane_ends = np.cumsum(counts), np.cumsum(lanes)
    padded = np.zeros(int(lanes.sum()), dtype=np.uint8)
    padded[np.arange(len(ranks)) + np.repeat(lane_ends - lanes - ends + counts, counts)] = extra
    four = padded.reshape(-1, 4)
    control = memoryview((four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes())
    data_ends = np.append(0, np.cumsum(extra, dtype=np.int64) + np.arange(1, len(ranks) + 1))[np.append(0, ends)]
    if extra.any():
        wide = ranks.dtype.itemsize
        data = ranks.view(np.uint8).reshape(-1, wide)[np.arange(wide, dtype=np.uint8)[None, :] <= extra[:, None]]
    else:
        data = ranks.astype(np.uint8)
    data, cuts = memoryview(data.tobytes()), np.append(0, lane_ends // 4)
    return (
        [bytes(control[i:j]) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)],
        [bytes(data[i:j]) for i, j in zip(data_ends[:-1].tolist(), data_ends[1:].tolist(), strict=True)],
    )


_LENGTHS = 1 + (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], dtype=np.uint8) & 3)


def unpack_ranks(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Values of concatenated streams of ``counts`` values each (every stream begins with a control byte of its own)."""
    lanes = -(-counts // 4) * 4
    used = np.ones(int(lanes.sum()), dtype=bool)
    ends = np.cumsum(lanes)
    for k in range(1, 4):  # unused lanes of each stream's last control byte
        used[(ends - k)[lanes - counts >= k]] = False
    lengths = _LENGTHS[control].reshape(-1)[used].astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    values = data[starts].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(lengths > k)
        values[longer] |= data[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


_BLOCK = "<IQQQ"


def _write_block(out, rows: list[tuple[int | None, int, bytes, bytes]]) -> None:
    ids, counts, controls, data = zip(*rows, strict=True)
    out.write(struct.pack(_BLOCK, len(rows), sum(counts), sum(map(len, controls)), sum(map(len, data))))
    out.write(np.array([x or 0 for x in ids], dtype="<i8").tobytes())
    out.write(np.array([x is None for x in ids], dtype=np.uint8).tobytes())
    out.write(np.array(counts, dtype="<u4").tobytes())
    out.writelines(controls)
    out.writelines(data)


def read_blocks(source) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, null flags, tokens per document and ranks of each block of an open file."""
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    while head := source.read(struct.calcsize(_BLOCK)):
        docs, _, n_control, n_data = struct.unpack(_BLOCK, head)
        ids = np.frombuffer(source.read(8 * docs), dtype="<i8")
        null = np.frombuffer(source.read(docs), dtype=np.uint8)
        counts = np.frombuffer(source.read(4 * docs), dtype="<u4").astype(np.int64)
        control = np.frombuffer(source.read(n_control), dtype=np.uint8)
        data = np.frombuffer(source.read(n_data), dtype=np.uint8)
        yield ids, null, counts, unpack_ranks(control, data, counts)


FIRST_ID = -(1 << 63)


def parts_of(ids: np.ndarray, text_hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The file of each row, by id, in the order of ids; rows of an id that is several bounds at once are dealt over its files by their hash."""
    low, high = np.searchsorted(bounds, ids, side="left"), np.searchsorted(bounds, ids, side="right")
    share = (text_hashes.astype(np.float64) + 2.0**63) / 2.0**64
    wide = np.maximum(high - low, 1)
    return (low + np.minimum((share * wide).astype(np.int64), wide - 1)).astype(np.int32)


_ENCODED = "part int, doc_id long, text_hash long, n long, control binary, data binary"


def write_token_files(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = END_ID,
    vocabulary: str | None = None,
    tokens_per_file: int = TOKENS_PER_FILE,
) -> None:
    """Encode every text once and write the files, the dictionary and the manifest below ``path`` (shared by all executors)."""
    spark = df.sparkSession
    size = encoder(vocabulary).size
    encoded_path = scratch_path(spark, "encoded")
    encode(df, id_col, text_col, end_id, vocabulary).write.option("compression", "zstd").parquet(encoded_path)
    written = spark.read.parquet(encoded_path)
    id_of_rank, total = frequency_ranks(token_counts(written), size)
    encoded = written.where("ids is not null").select("doc_id", "text_hash", "ids")
    rank_of = np.empty(size, dtype=id_type(size))
    rank_of[id_of_rank] = np.arange(size, dtype=id_type(size))
    parts = min(max(-(-total // tokens_per_file), 1), MOST_FILES)
    quantiles = [k / parts for k in range(1, parts)]
    place = F.coalesce("doc_id", F.lit(FIRST_ID).cast("long"))
    cuts = encoded.agg(F.percentile_approx(place, quantiles or [0.5], max(20 * parts, 10_000))).first()[0]
    bounds = np.array(cuts if quantiles and cuts else [], dtype=np.int64)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = parts_of(batch.column(0).fill_null(FIRST_ID).to_numpy(), batch.column(1).to_numpy(), bounds)
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                ids, counts = _flat_ids(rows.column(2), size)
                packed = pack_ranks(rank_of[ids], counts)
                columns = [pa.array(part[at : at + 256]), rows.column(0), rows.column(1), pa.array(counts), *(pa.array(x, type=pa.binary()) for x in packed)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "text_hash", "n", "control", "data"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(path)
        name, part, docs, tokens = f"tokens-{uuid.uuid4().hex}.ids", None, 0, 0
        out = None
        rows: list[tuple[int | None, int, bytes, bytes]] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                if out is None:
                    part = batch.column(0)[0].as_py()
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}")
                    out.write(MAGIC)
                rows.append((row[0], *row[2:]))
                held += row[2]
                docs, tokens = docs + 1, tokens + row[2]
                if held >= BLOCK_TOKENS:
                    _write_block(out, rows)
                    rows, held = [], 0
        if out is not None:
            if rows:
                _write_block(out, rows)
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"file": name, "part": part, "docs": docs, "tokens": tokens}],
                schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]),
            )

    ranked = encoded.mapInArrow(rank, _ENCODED)
    ordered = ranked.repartitionById(parts, "part").sortWithinPartitions("doc_id", "text_hash")
    manifest = ordered.mapInArrow(write, "file string, part int, docs long, tokens long")
    dictionary = spark.createDataFrame(pa.table({"rank": np.arange(size), "id": id_of_rank.astype(np.int64)}))
    dictionary.coalesce(1).write.parquet(f"{path}/dictionary")
    manifest.write.parquet(f"{path}/manifest")
    remove_path(spark, encoded_path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids`` (array)."""
    dictionary = spark.read.parquet(f"{path}/dictionary").orderBy("rank").toArrow()  # bounded by the vocabulary
    id_of_rank = dictionary.column("id").to_numpy().astype("<u4")
    manifest = spark.read.parquet(f"{path}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(path)
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{folder}/{file}") as source:
                    for doc_ids, null, lengths, ranks in read_blocks(source):
                        ids = id_of_rank[ranks]
                        ends = np.cumsum(lengths)
                        data = memoryview(ids.tobytes())
                        spans = zip((4 * (ends - lengths)).tolist(), (4 * ends).tolist(), strict=True)
                        columns = [
                            pa.array(doc_ids, mask=null.astype(bool)),
                            pa.array(start + ends - lengths),
                            pa.array(lengths),
                            pa.array([zlib.crc32(data[a:b]) for a, b in spans], type=pa.int64()),
                        ]
                        if with_ids:
                            columns.append(pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), ids.astype(np.int32)))
                        start += int(lengths.sum())
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.repartition(max(1, manifest.count())).mapInArrow(run, schema)


