"""Substring deduplication by hashing units: lines, and sentences of lines.

A unit is a stretch of a line up to and with a sentence end (``.``, ``!`` or ``?`` before white space) or the
line's end. Units are compared by a 128-bit digest of their normalised form: one case, runs of white space as one
space, none at the ends. Of each group of equal units the one ranked first stays (smallest document id, then
smallest offset); the others are cut out of their texts.

Sentences of fewer than ``MIN_WORDS`` words repeat in any prose, so alone they are left; each run of them between longer ones is a
unit together with what is around it: its digest is that of the longer sentence before it (or the line's start), the
run, and the longer sentence after it (or the line's end). So of two equal lines all units are equal and the later line
goes whole, as do the short sentences inside a repeated passage. A line without longer sentences is one unit.
Lines of fewer than ``MIN_WORDS`` words are left alone.

Digests are grouped by aggregation (a very frequent unit is summed up inside the tasks that meet it), then joined back
to the units by equality, so no task gathers a group. The offsets of what went are kept, in code points of the input.

Defined cases: a null text stays null, an empty one empty; rows with equal id and text are one document (both
keep the same); null ids rank last; ties can't be, as offsets differ; an empty table gives an empty result; other
columns are ignored, or kept as they are by ``remove_repeats``, but for one named ``removed``, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

MIN_WORDS = 5
LAST = (1 << 63) - 1


def units_of(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """Start, end and digest of the units of a text that count."""
    found = []
    for line in re.finditer(r"[^\n]+", text):
        at = line.start()
        parts: list[tuple[int, int, list[str], bool]] = []  # start, end, words, whether short; a run of short sentences is one
        for part in re.split(r"(?<=[.!?])(?=\s)", line.group()):
            words = part.split()
            if words:
                start, end, short = at + len(part) - len(part.lstrip()), at + len(part.rstrip()), len(words) < min_words
                if short and parts and parts[-1][3]:
                    start, words = parts[-1][0], parts.pop()[2] + words
                parts.append((start, end, words, short))
            at += len(part)
        if sum(len(part[2]) for part in parts) < min_words:
            continue
        normal = [" ".join(part[2]).lower() for part in parts]
        for k, (start, end, _, short) in enumerate(parts):
            # Words hold no line end, so the digest of a run can't be that of a sentence.
            around = "\n".join(["", *normal[:k][-1:], "\n", normal[k], "\n", *normal[k + 1 : k + 2]])
            key = around if short and len(parts) > 1 else normal[k]
            found.append((start, end, xxhash.xxh3_128_digest(key.encode())))
    return found


def _keys(id_col: str, text_col: str) -> list:
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(text_col)).alias("text_hash")]


def units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``doc``, ``text_hash``, ``start``, ``end``, ``high``, ``low`` of every unit that counts."""
    names = ["doc", "text_hash", "start", "end", "high", "low"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = units_of(text.as_py() or "", min_words)
                if found:
                    starts, ends, digests = zip(*found, strict=True)
                    halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                    n = len(found)
                    columns = [np.full(n, doc), np.full(n, text_hash), np.array(starts, np.int32), np.array(ends, np.int32), halves[:, 0], halves[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    rows = df.select(*_keys(id_col, text_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc long, text_hash long, start int, end int, high long, low long")


def repeated_units(found: DataFrame) -> DataFrame:
    """The units that are not the first of their group, with the first one's document (``first_doc``) and offset."""
    place = F.struct("doc", "text_hash", "start")
    groups = found.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    return found.join(groups.drop("last"), ["high", "low"]).where(F.struct("doc", "text_hash", "start") != F.col("first"))


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """``df`` with repeats cut out of its texts, and ``removed``: start, end, first_doc and first_start of each cut."""
    found = materialise(units(df, id_col, text_col, min_words), "units")
    cut = F.struct("start", "end", F.col("first.doc").alias("first_doc"), F.col("first.start").alias("first_start"))
    cuts = repeated_units(found).distinct().groupBy("doc", "text_hash").agg(F.array_sort(F.collect_list(cut)).alias("removed"))
    keyed = df.withColumns(dict(zip(("__unit_doc", "__unit_hash"), _keys(id_col, text_col), strict=True)))
    cuts = cuts.select(F.col("doc").alias("__unit_doc"), F.col("text_hash").alias("__unit_hash"), F.col("removed").alias("__unit_cuts"))
    own = [name for name in df.columns if name != "removed"]
    joined = keyed.join(cuts, ["__unit_doc", "__unit_hash"], "left").select(*own, F.col("__unit_cuts").alias("removed"))
    at = own.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, cuts in enumerate(batch.column(batch.num_columns - 1)):
                if cuts.is_valid:
                    text, kept, done = texts[k], [], 0
                    for one in cuts.as_py():
                        kept.append(text[done : one["start"]])
                        done = one["end"]
                    texts[k] = "".join(kept) + text[done:]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, type=batch.schema.field(at).type))

    none = F.array().cast(joined.schema["removed"].dataType)
    return joined.mapInArrow(run, joined.schema).withColumn("removed", F.coalesce("removed", none))
