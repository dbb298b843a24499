"""Mixing sources to target weights: raking of token weights, then sampling. DataFrame functions only.

1. Documents are summed into cells (source, language, topic) with their tokens; cells, not documents, take part in
   the iterations.
2. Iterative proportional fitting: for each dimension in turn the cells' sampling probabilities are scaled so that
   the tokens expected of each value meet its target. A probability never leaves [0, 1], as nothing is drawn twice;
   what a full cell can't give, the other cells of its row make up in the next round. A step is a window sum over the
   cells; after every few rounds they are written to a table. Up to ``CELLS_IN_ONE_TASK`` cells lie in one partition, which
   serves every window as it is; that changes the plan, not the sums.
3. A document stays if a hash of its id and the seed, read as a number in [0, 1), lies below its cell's probability. So
   the sample is the same for any partitioning, and a larger target keeps what a smaller one kept.

A target is a mapping of values to shares (values left out get nothing), or None for shares in proportion to
tokens to the power ``temper``, which lifts small sources. All targets add up to ``token_share`` of the input's tokens, and
no value's target is above the tokens that it has.

Defined cases: nulls in a dimension are a value of their own (``""``); an empty text has no tokens and is sampled
like its cell; a cell without tokens keeps ``token_share``; rows without an id draw by their text; repeated rows share one
decision; an empty table gives an empty sample; other columns are kept as they are, but for ones named ``mix_topic``,
``mix_tokens`` or ``mix_probability``, which ``describe`` replaces. Raking that is still moving after ``ROUNDS`` rounds gives a warning.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise

TOKEN_SHARE = 0.7
TEMPER = 0.7
ROUNDS = 50
TOLERANCE = 0.0002  # share of all tokens that a last round may still move
ROUNDS_PER_TABLE = 5
CELLS_IN_ONE_TASK = 20_000  # so many cells are raked in one task, without exchanges; more are dealt by value for each sum
GRID, GRID_ROUNDS = 32, 4
SEED = 20240229
DIMENSIONS = ("source", "lang", "topic")

Target = Mapping[str, float] | None


def token_count(text: Column) -> Column:
    """Words as a measure of tokens."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def form_topic(text: Column) -> Column:
    """A topic from the text's form: what it is made of, by the first rule that holds."""
    text = F.coalesce(text, F.lit(""))
    size = F.length(text)
    share = lambda chars: F.regexp_count(text, F.lit(f"[{chars}]"))
    lines = share(r"\n") + 1
    return (
        F.when(size == 0, "empty")
        .when(share("|") * 100 > size, "table")
        .when(share("#*$%&<>{}=") * 50 > size, "markup")
        .when(share("0-9") * 20 > size, "numeric")
        .when(size < lines * 60, "list")
        .when(size < 1500, "short prose")
        .otherwise("prose")
    )


def cells_of(df: DataFrame, dimensions: Mapping[str, Column], tokens: Column) -> DataFrame:
    """Tokens of each combination of the dimensions' values."""
    keys = [F.coalesce(column.cast("string"), F.lit("")).alias(f"d{k}") for k, column in enumerate(dimensions.values())]
    return df.select(*keys, tokens.alias("tokens")).groupBy(*(f"d{k}" for k in range(len(keys)))).agg(F.sum("tokens").alias("tokens"))


def _targets(cells: DataFrame, names: list[str], targets: list[Target], wanted: float, temper: float) -> DataFrame:
    """``dim``, ``value``, ``target`` tokens of every dimension's values, none above what the value has.

    Targets are ``min(have, scale * share)``: what a value lacks goes to the others in proportion to their shares. The scale
    is narrowed on a grid, for all dimensions at once: three jobs whose results are a few numbers each.
    """
    parts = []
    for name, target in zip(names, targets, strict=True):
        sums = cells.groupBy(F.lit(name).alias("dim"), F.col(name).alias("value")).agg(F.sum("tokens").cast("double").alias("have"))
        if target is None:
            share = F.pow("have", F.lit(temper))
        else:
            pairs = [F.lit(x) for pair in target.items() for x in pair]
            share = F.coalesce(F.create_map(*pairs)[F.col("value")], F.lit(0.0)) if pairs else F.lit(0.0)
        parts.append(sums.withColumn("share", share.cast("double")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    sums = materialise(union, "sums")
    some = F.col("share") > 0
    bounds = {name: (0.0, 0.0) for name in names}
    for row in sums.where(some).groupBy("dim").agg(F.max(F.col("have") / F.col("share")).alias("top")).collect():
        bounds[row["dim"]] = (0.0, row["top"])
    for _ in range(GRID_ROUNDS):
        grids = {name: [low + (high - low) * k / GRID for k in range(GRID + 1)] for name, (low, high) in bounds.items()}
        grid = F.create_map(*(x for name, values in grids.items() for x in (F.lit(name), F.array(*map(F.lit, values)))))[F.col("dim")]
        reached = [F.sum(F.least("have", grid[k] * F.col("share"))).alias(f"r{k}") for k in range(GRID + 1)]
        for row in sums.groupBy("dim").agg(*reached).collect():
            values = grids[row["dim"]]
            at = next((k for k in range(GRID + 1) if row[f"r{k}"] >= wanted), GRID)
            bounds[row["dim"]] = (values[max(at - 1, 0)], values[at])
    scale = F.create_map(*(x for name, (_, high) in bounds.items() for x in (F.lit(name), F.lit(high))))[F.col("dim")]
    found = materialise(sums.select("dim", "value", F.least("have", scale * F.col("share")).alias("target")), "targets")
    discard(sums)
    return found


def rake(
    cells: DataFrame,
    targets: list[Target],
    token_share: float = TOKEN_SHARE,
    temper: float = TEMPER,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``cells`` with ``probability``. A few sums per round reach the driver."""
    names = [f"d{k}" for k in range(len(targets))]
    state = materialise(cells.withColumn("probability", F.lit(float(token_share))), "raking")
    total, count = state.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not total:
        return state
    total = float(total)
    placed = (lambda frame: frame.coalesce(1)) if count <= CELLS_IN_ONE_TASK else (lambda frame: frame)
    wanted = _targets(state, names, targets, total * token_share, temper)
    for name in names:
        target = wanted.where(F.col("dim") == name).select(F.col("value").alias(name), F.col("target").alias(f"target_{name}"))
        state = state.join(target, name)
    state = placed(state)
    for _ in range(0, rounds, ROUNDS_PER_TABLE):
        for _ in range(ROUNDS_PER_TABLE):
            state = state.withColumn("before", F.col("probability"))
            for name in names:
                have = F.sum(F.col("tokens") * F.col("probability")).over(Window.partitionBy(name))
                scaled = F.least(F.lit(1.0), F.col("probability") * F.col(f"target_{name}") / have)
                state = state.withColumn("probability", F.when(have > 0, scaled).otherwise(F.col("probability")))
        state = placed(materialise(state, "raking"))
        moved = state.agg(F.sum(F.col("tokens") * F.abs(F.col("probability") - F.col("before")))).first()[0] / total
        if moved <= tolerance:
            break  # targets met, or held back by full cells only
    else:
        warnings.warn(f"raking still moved {moved:.2%} of all tokens in round {rounds}", stacklevel=2)
    return state.select(*names, "tokens", F.when(F.col("tokens") > 0, F.col("probability")).otherwise(F.lit(float(token_share))).alias("probability"))


def mix(
    df: DataFrame,
    targets: Mapping[str, Target] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    topic: Column | None = None,
    token_share: float = TOKEN_SHARE,
    temper: float = TEMPER,
    seed: int = SEED,
    describe: bool = True,
) -> DataFrame:
    """The sampled rows of ``df``; ``describe``: with ``mix_topic``, ``mix_tokens`` and ``mix_probability`` behind their own columns."""
    targets = targets or {}
    text = F.col(text_col)
    topic = form_topic(text) if topic is None else topic
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}
    cells = cells_of(df, dimensions, token_count(text))
    raked = rake(cells, [targets.get(name) for name in dimensions], token_share, temper)
    keys = {f"__mix_d{k}": F.coalesce(column.cast("string"), F.lit("")) for k, column in enumerate(dimensions.values())}
    chances = raked.select(*(F.col(f"d{k}").alias(f"__mix_d{k}") for k in range(len(keys))), F.col("probability").alias("__mix_probability"))
    seen = F.when(F.col(id_col).isNull(), F.xxhash64(text, *(F.col(name) for name in ("source", "lang"))))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), seen), 11) / F.lit(float(1 << 53))
    joined = df.withColumns(keys).join(chances, list(keys)).where(draw < F.col("__mix_probability"))
    if not describe:
        return joined.select(df.columns)
    own = [name for name in df.columns if name not in ("mix_topic", "mix_tokens", "mix_probability")]
    return joined.select(*own, F.col("__mix_d2").alias("mix_topic"), token_count(text).alias("mix_tokens"), F.col("__mix_probability").alias("mix_probability"))
