"""Quality classifier: random Fourier features over text statistics, ridge scores, isotonic calibration.

1. Every text is reduced to ``STATISTICS`` numbers (sizes, shares of kinds of characters, repetition).
2. They are standardised with the training rows' means and deviations and clipped to a few deviations, then mapped to
   ``FEATURES`` cosines of random projections, whose inner products approximate a Gaussian kernel of width ``WIDTH``.
3. Each partition of the training rows sums its part of the normal equations; the driver adds the parts (a
   bounded number of matrices of fixed size) and solves the ridge system.
4. On training rows that the fit did not see, isotonic regression turns scores into probabilities; between the
   centres of its steps they are interpolated, so that different scores seldom tie.

At most ``TRAINING_ROWS`` labelled rows are used, those with the smallest hash of their id: the only bound here, and one that
scoring does not have. Labels, languages, sources and ids are never inputs of a score.

Defined cases: a null or empty text has statistics of 0; null ids have no label and are scored; labels that are null
or of unknown documents are left out, of several labels of one id the largest counts; repeated rows come out as
often as they came in; without labels of both kinds every score is the share of label 1 (0.5 without any label); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .perplexity import text_statistics

TRAINING_ROWS = 200_000
FEATURES = 512
WIDTH = 4.0
RIDGE = 1e-3
CLIP = 6.0
CALIBRATION_PARTS = 5
SUM_PARTITIONS = 16
SEED = 7

STATISTICS = 20
_MARKS = (b"#*$%&|<>", b"|", b"!?", b".,;:", b"0123456789", b"\n", b"\"'()[]{}")
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_HIGH = bytes(range(128, 256))


def statistics_of(data: bytes) -> list[float]:
    """The numbers that describe a text (UTF-8)."""
    n_words, word_chars, _, n_dup_lines, n_repeat = text_statistics(data)
    if not data:
        return [0.0] * STATISTICS
    size = len(data)
    share = lambda chars: (size - len(data.translate(None, chars))) / size
    words = data.lower().split()
    distinct = len(set(words)) / max(n_words, 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    histogram = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) / size
    entropy = -float((histogram[histogram > 0] * np.log(histogram[histogram > 0])).sum())
    lines = data.count(b"\n") + 1
    return [
        math.log1p(n_words),
        word_chars / max(n_words, 1),
        float(lengths.std()),
        math.log1p(float(lengths.max())),
        distinct,
        distinct * math.log1p(n_words),
        n_repeat / max(n_words, 1),
        n_dup_lines / lines,
        math.log1p(size / lines),
        *(share(marks) for marks in _MARKS),
        share(_UPPER),
        share(_UPPER) / max(share(_UPPER) + share(_LOWER), 1e-9),
        share(_HIGH),
        entropy,
    ]


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``x`` (array of floats) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics_of(text.as_py() or b"") for text in batch.column(1).cast(pa.binary())]
            values = pa.array(np.array(rows, dtype=np.float32).reshape(-1))
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "x"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x array<float>")


@dataclass
class Classifier:
    """A fitted model; small, so it travels with the plan."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier_features(x, self.mean, self.deviation)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.weights, *self.steps), 0.0, 1.0)


def fourier_features(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    random = np.random.default_rng(SEED)
    directions = random.standard_normal((STATISTICS, FEATURES)) / WIDTH
    shifts = random.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((x - mean) / deviation, -CLIP, CLIP)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ directions + shifts), np.ones((len(x), 1))])


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and means of the steps of the isotonic regression of labels on scores (pool adjacent violators)."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
    for s, y in zip(scores[order].tolist(), labels[order].tolist(), strict=True):
        blocks.append([y, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    table = np.array(blocks)
    return table[:, 2] / table[:, 1], table[:, 0] / table[:, 1]


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, STATISTICS).astype(np.float64)


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", training_rows: int = TRAINING_ROWS) -> Classifier:
    """``stats`` from ``statistics`` over all training rows; ``labels``: ``doc_id`` and the label."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).alias("y"))
    rows = stats.dropDuplicates(["doc_id"]).join(known, "doc_id").withColumn("h", F.xxhash64("doc_id", F.lit(SEED)))
    rows = materialise(rows.select("h", "x", F.col("y").cast("double").alias("y")), "training")
    if (count := rows.count()) > training_rows:
        bound = rows.agg(F.percentile_approx(F.col("h"), training_rows / count, 100_000)).first()[0]
        rows = rows.where(F.col("h") <= bound)
    share = rows.agg(F.avg("y")).first()[0]
    if share is None or share in (0.0, 1.0):
        constant = 0.5 if share is None else share
        return Classifier(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(FEATURES + 1), (np.zeros(1), np.array([constant])))
    columns = [F.col("x")[k] for k in range(STATISTICS)]
    moments = rows.agg(*(F.avg(c) for c in columns), *(F.stddev_pop(c) for c in columns)).first()
    mean, deviation = np.array(moments[:STATISTICS]), np.maximum(np.array(moments[STATISTICS:]), 1e-6)
    held = F.pmod("h", F.lit(CALIBRATION_PARTS)) == 0

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for batch in batches:
            z = fourier_features(_matrix(batch, "x"), mean, deviation)
            y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            a += z.T @ z
            b += z.T @ (2 * y - 1)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], ["a", "b"])

    parts = rows.where(~held).coalesce(SUM_PARTITIONS).mapInArrow(sums, "a binary, b binary")
    a, b = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
    for part in parts.toLocalIterator():
        a += np.frombuffer(part["a"]).reshape(a.shape)
        b += np.frombuffer(part["b"])
    ridge = RIDGE * max(a[-1, -1], 1.0) / FEATURES * np.eye(FEATURES + 1)
    model = Classifier(mean, deviation, np.linalg.solve(a + ridge, b), (np.zeros(1), np.zeros(1)))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.features(_matrix(batch, "x")) @ model.weights
            yield pa.RecordBatch.from_arrays([pa.array(scores), batch.column(batch.schema.get_field_index("y"))], ["s", "y"])

    seen = rows.where(held).mapInArrow(raw, "s double, y double").toArrow()  # at most a part of the bounded sample
    if seen.num_rows:
        model.steps = isotonic(seen["s"].to_numpy(), seen["y"].to_numpy())
    return model


def score(stats: DataFrame, model: Classifier) -> DataFrame:
    """``doc_id``, ``score`` of every row of ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(_matrix(batch, "x")))], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_documents(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document; labels of held-out rows are not looked at."""
    stats = materialise(statistics(df, id_col, text_col), "statistics")
    usable = labels.where(~held_out(F.col("doc_id")))
    scored = score(stats, fit(stats, usable))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
