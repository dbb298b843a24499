from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.queries import op3_source_mixing


def raked(cells, targets, share, rounds=400):
    """The same fixed point by plain loops: ``cells`` maps value tuples to tokens, ``targets`` are per dimension."""
    p = dict.fromkeys(cells, share)
    for _ in range(rounds):
        for k, target in enumerate(targets):
            have: dict = {}
            for cell, tokens in cells.items():
                have[cell[k]] = have.get(cell[k], 0) + tokens * p[cell]
            for cell in cells:
                p[cell] = min(1.0, p[cell] * target[cell[k]] / have[cell[k]])
    return p


def test_raking_reaches_the_fixed_point(spark):
    cells = {("a", "en"): 500, ("a", "fr"): 100, ("b", "en"): 50, ("b", "fr"): 300, ("c", "en"): 20}
    frame = spark.createDataFrame([(*k, v) for k, v in cells.items()], "d0 string, d1 string, tokens long")
    wanted = [{"a": 0.5, "b": 0.4, "c": 0.1}, {"en": 0.5, "fr": 0.5}]
    total = sum(cells.values()) * 0.4
    # c has 20 tokens only, so it is full and a and b share the rest of the target as 5 to 4.
    targets = [{"a": (total - 20) * 5 / 9, "b": (total - 20) * 4 / 9, "c": 20}, {"en": total / 2, "fr": total / 2}]
    expected = raked(cells, targets, 0.4)
    found = {(r["d0"], r["d1"]): r["probability"] for r in mixing.rake(frame, wanted, token_share=0.4).collect()}
    assert found == pytest.approx(expected, abs=0.01)
    for k, target in enumerate(targets):
        for value, tokens in target.items():
            assert sum(cells[c] * found[c] for c in cells if c[k] == value) == pytest.approx(tokens, rel=0.05)


def test_the_sample_meets_its_marginals(spark, sf_dir):
    rows = op3_source_mixing(spark, sf_dir)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    total = documents.agg(F.sum(mixing.token_count(F.col("text")))).first()[0]
    sampled, weighted = rows.agg(F.sum("mix_tokens"), F.sum(F.col("mix_tokens") / F.col("mix_probability"))).first()
    assert 0.5 * total < sampled < 0.9 * total
    assert weighted == pytest.approx(total, rel=0.2)  # weights by the inverse probability give back the table
    again = op3_source_mixing(spark, sf_dir)
    assert rows.exceptAll(again).count() == 0 == again.exceptAll(rows).count()


def proportional_targets(have, wanted, temper):
    """``min(have, scale * have ** temper)`` that add up to ``wanted``, by halving."""
    low, high = 0.0, max(have.values()) * 2
    for _ in range(200):
        scale = (low + high) / 2
        reached = sum(min(v, scale * v**temper) for v in have.values())
        low, high = (scale, high) if reached < wanted else (low, scale)
    return {k: min(v, high * v**temper) for k, v in have.items()}


def test_the_query_equals_plain_loops(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), "doc_id", F.lit(None).cast("long")), 11) / F.lit(float(1 << 53))
    cell_of, tokens_of, draw_of = {}, {}, {}
    for r in documents.withColumns({"topic": mixing.form_topic(F.col("text")), "draw": draw}).collect():
        cell_of[r["doc_id"]] = (r["source"] or "", r["lang"] or "", r["topic"])
        tokens_of[r["doc_id"]] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        draw_of[r["doc_id"]] = r["draw"]
    cells: dict = {}
    for i, cell in cell_of.items():
        cells[cell] = cells.get(cell, 0) + tokens_of[i]
    cells = {cell: n for cell, n in cells.items() if n}
    wanted, targets = sum(cells.values()) * mixing.TOKEN_SHARE, []
    for k in range(3):
        have: dict = {}
        for cell, n in cells.items():
            have[cell[k]] = have.get(cell[k], 0) + n
        targets.append(proportional_targets(have, wanted, mixing.TEMPER))
    plain = raked(cells, targets, mixing.TOKEN_SHARE, rounds=mixing.ROUNDS)
    found = {r["doc_id"]: r for r in op3_source_mixing(spark, sf_dir).collect()}
    slack = 0.01  # the scale is narrowed on a grid, and rounds end at a tolerance
    for i, cell in cell_of.items():
        chance = plain.get(cell, mixing.TOKEN_SHARE)
        if i in found:
            assert found[i]["mix_probability"] == pytest.approx(chance, abs=slack) and found[i]["mix_tokens"] == tokens_of[i]
        if abs(draw_of[i] - chance) > slack:
            assert (i in found) == (draw_of[i] < chance)


def test_cells_in_one_task_and_dealt_give_the_same(spark, monkeypatch):
    rows = [(f"s{k % 7}", f"l{k % 3}", f"t{k % 5}", 10 + k * k % 97) for k in range(105)]
    frame = spark.createDataFrame(rows, "d0 string, d1 string, d2 string, tokens long")

    def probabilities():
        made = mixing.rake(frame, [None, None, {"t0": 2.0, "t1": 1.0, "t2": 1.0}], token_share=0.5)
        return {tuple(r)[:3]: r["probability"] for r in made.collect()}, made

    one, frame_of_one = probabilities()
    assert "hashpartitioning" not in frame_of_one._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(mixing, "CELLS_IN_ONE_TASK", 0)
    dealt, _ = probabilities()
    assert one == pytest.approx(dealt, abs=1e-9) and len(one) == 105


def test_larger_samples_hold_smaller_ones(documents):
    few = {r["doc_id"] for r in mixing.mix(documents, token_share=0.3).collect()}
    many = {r["doc_id"] for r in mixing.mix(documents, token_share=0.8).collect()}
    assert few < many


def test_odd_rows(odd, none):
    kept = mixing.mix(odd)
    added = ["mix_topic", "mix_tokens", "mix_probability"]
    assert kept.columns == [*(c for c in odd.columns if c not in added), *added]
    assert mixing.mix(odd, describe=False).schema == odd.schema
    assert kept.count() <= odd.count()
    everything = mixing.mix(odd, token_share=1.0)
    assert everything.count() == odd.count()
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd.where("doc_id in (3, 4)")).count() <= 2  # no tokens at all


def test_the_plan_is_native(odd):
    plan = mixing.mix(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize(("text", "topic"), [("", "empty"), (None, "empty"), ("a | b | c", "table"), ("##a %%b", "markup"), ("12 34 ab cd", "numeric"), ("one\ntwo\nthree", "list"), ("word " * 100, "short prose"), ("word " * 1000, "prose")])
def test_topics(spark, text, topic):
    assert spark.createDataFrame([(text,)], "t string").select(mixing.form_topic(F.col("t"))).first()[0] == topic
