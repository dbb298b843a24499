"""Golden sequences of the classifiers, and properties that hold between them."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import lifecycle

COLUMNS = "event_id string, trade_id string, event_version int, event_type string, payload_hash string, topic string, partition int, offset long, parse_failed boolean, failed_rules array<string>, failure_reason string"


def batch(spark, events, trade="T1", start=0, rules=()):
    """Events as (id, version, type, payload)."""
    rows = [(e, trade, v, t, h, "t", 0, start + k, False, list(rules), "|".join(rules)) for k, (e, v, t, h) in enumerate(events)]
    return spark.createDataFrame(rows, COLUMNS)


def outcomes(decided):
    return [row["outcome"] for row in decided.orderBy("topic", "partition", "offset").collect()]


def steps(*names):
    """'NEW1', 'AMEND2', ... with ids and payloads of their own."""
    out = []
    for k, name in enumerate(names):
        kind = name.rstrip("0123456789")
        out.append((f"E{k}", int(name[len(kind) :]), kind, f"H{k}"))
    return out


MATRIX = [("E1", 1, "NEW", "a"), ("E2", 2, "AMEND", "b"), ("E2", 2, "AMEND", "b"), ("E3", 1, "NEW", "a"), ("E4", 2, "AMEND", "c"), ("E5", 3, "CANCEL", "d"), ("E6", 4, "AMEND", "e")]


@pytest.mark.parametrize(
    ("events", "expected"),
    [
        (steps("NEW1", "AMEND2", "CANCEL3"), ["APPLIED"] * 3),
        (steps("AMEND2"), ["QUARANTINED"]),
        (steps("AMEND2", "NEW1"), ["QUARANTINED", "STALE_VERSION"]),
        (steps("NEW1", "AMEND3", "CANCEL2", "AMEND4"), ["APPLIED", "APPLIED", "STALE_VERSION", "QUARANTINED"]),
        (steps("NEW1", "AMEND5"), ["APPLIED", "APPLIED"]),
        (steps("NEW1", "CANCEL2", "AMEND3", "NEW4"), ["APPLIED", "APPLIED", "QUARANTINED", "QUARANTINED"]),
        (MATRIX, ["APPLIED", "VERSION_CONFLICT", "DUPLICATE", "DUPLICATE", "VERSION_CONFLICT", "APPLIED", "QUARANTINED"]),
    ],
)
def test_one_batch(spark, events, expected):
    assert outcomes(lifecycle.classify(batch(spark, events))) == expected


def run_one_by_one(spark, events, strict=False):
    ledger, found = None, []
    for k, event in enumerate(events):
        state = None
        if ledger is not None:
            applied = lifecycle.latest_per_trade(ledger.where("outcome = 'APPLIED'").withColumn("event_ts", F.lit(0)))
            state = applied.withColumns({"current_version": F.col("event_version"), "trade_status": lifecycle.trade_status(F.col("event_type"))})
        decided = lifecycle.classify(batch(spark, [event], start=k), ledger, state, strict)
        rows = decided.collect()
        found.append(rows[0]["outcome"])
        made = spark.createDataFrame(rows, decided.schema)
        ledger = made if ledger is None else spark.createDataFrame(ledger.collect() + rows, decided.schema)
    return found


def test_a_batch_per_event_gives_the_sequential_answer(spark):
    expected = ["APPLIED", "APPLIED", "DUPLICATE", "STALE_VERSION", "VERSION_CONFLICT", "APPLIED", "QUARANTINED"]
    assert run_one_by_one(spark, MATRIX) == expected
    assert outcomes_in_order(MATRIX) == expected


def outcomes_in_order(events):
    return [outcome for outcome, _, _ in lifecycle.fold_events(events)]


def test_sequential_reasons():
    reasons = [reason for _, reason, _ in lifecycle.fold_events(MATRIX)]
    assert reasons == ["ACCEPTED_HIGHER_VERSION", "ACCEPTED_HIGHER_VERSION", "DUPLICATE_EVENT_ID", "LOWER_THAN_CURRENT_VERSION", "CONFLICTING_TRADE_VERSION", "ACCEPTED_HIGHER_VERSION", "EVENT_AFTER_CANCEL"]


def test_strict_lets_a_stale_cancel_pass(spark):
    events = steps("NEW1", "AMEND3", "CANCEL2", "AMEND4")
    assert outcomes(lifecycle.classify(batch(spark, events), strict=True)) == ["APPLIED", "APPLIED", "STALE_VERSION", "APPLIED"]


def test_rows_without_keys_are_decided_without_windows(spark):
    rows = [
        (None, "T1", 1, "NEW", "a", "t", 0, 0, False, ["MISSING_EVENT_ID"], "MISSING_EVENT_ID"),
        ("E1", None, 1, "NEW", "a", "t", 0, 1, False, ["MISSING_TRADE_ID"], "MISSING_TRADE_ID"),
        ("E1", None, 1, "NEW", "a", "t", 0, 2, False, ["MISSING_TRADE_ID"], "MISSING_TRADE_ID"),
        (None, None, None, None, "z", "t", 0, 3, True, ["PAYLOAD_DESERIALIZATION_FAILED"], "PAYLOAD_DESERIALIZATION_FAILED"),
        ("E2", "T1", 1, "NEW", "b", "t", 0, 4, False, [], ""),
    ]
    found = lifecycle.classify(spark.createDataFrame(rows, COLUMNS)).orderBy("offset").collect()
    assert [r["outcome"] for r in found] == ["QUARANTINED", "QUARANTINED", "DUPLICATE", "QUARANTINED", "APPLIED"]
    assert found[3]["outcome_reason"] == "PAYLOAD_DESERIALIZATION_FAILED"


def test_repeated_message_keys_count_once(spark):
    one = batch(spark, steps("NEW1"))
    assert outcomes(lifecycle.classify(one.unionByName(one))) == ["APPLIED"]


def test_an_empty_batch_has_no_outcomes(spark):
    assert outcomes(lifecycle.classify(spark.createDataFrame([], COLUMNS))) == []


def plain(events):
    """Whether a sequence is free of the patterns on which the two classifiers differ by design."""
    versions: dict[int, set] = {}
    for _, version, _, digest in events:
        versions.setdefault(version, set()).add(digest)
    repeated = len({(v, h) for _, v, _, h in events}) < len(events)
    opens = events[0][1:3] == (1, "NEW") and all(kind != "NEW" for _, _, kind, _ in events[1:])
    top, stale_cancel = 0, False
    for _, version, kind, _ in events:
        stale_cancel |= kind == "CANCEL" and version < top
        top = max(top, version)
    return opens and not repeated and not stale_cancel and all(len(h) == 1 for h in versions.values())


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 6), st.sampled_from(["AMEND", "AMEND", "CANCEL"])), max_size=6))
def test_classifiers_agree_on_plain_sequences(spark, tail):
    events = [("E0", 1, "NEW", "H0")] + [(f"E{k}", v, t, f"H{v}{t}") for k, (v, t) in enumerate(tail, start=1)]
    if plain(events):
        assert outcomes(lifecycle.classify(batch(spark, events))) == outcomes_in_order(events)


def test_a_batch_within_trades_is_dealt_once(spark):
    """Ids and keys of one trade each: the same outcomes with no exchange beyond the one by trade that the batch comes with."""
    events = batch(spark, MATRIX).unionByName(batch(spark, [(f"X{e}", v, t, h) for e, v, t, h in steps("NEW1", "AMEND3", "CANCEL2", "AMEND4")], trade="T2", start=20))
    events = events.unionByName(batch(spark, MATRIX[:1]))  # a key that is met again
    dealt = events.repartition(4, "trade_id")
    shown = ("event_id", "offset", "outcome", "outcome_reason")
    once = lifecycle.mark_latest(lifecycle.classify(dealt.withColumn("event_ts", F.lit(0)), within_trades=True), "latest")
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert sorted(once.select(*shown).collect()) == sorted(lifecycle.classify(events).select(*shown).collect())
    applied = once.where("outcome = 'APPLIED'").drop("latest")
    assert sorted(once.where("latest").select("offset").collect()) == sorted(lifecycle.latest_per_trade(applied).select("offset").collect())


def test_rows_without_an_id_or_a_trade_are_read_once(spark):
    """No branch of the plan for them: the batch was scanned up to four times."""
    decided = lifecycle.classify(spark.createDataFrame([(None, None, 1, "NEW", "a", "t", 0, k, False, ["X"], "X") for k in range(3)], COLUMNS))
    assert decided._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert [r["outcome"] for r in decided.collect()] == ["QUARANTINED"] * 3


def test_expected_state_is_the_latest_applied_row(spark):
    from tidemark.operators.reconcile import expected_state

    rows = lifecycle.classify(batch(spark, steps("NEW1", "AMEND2", "AMEND3", "CANCEL4"))).withColumn("event_ts", F.lit(0))
    found = expected_state(rows).collect()
    assert [tuple(r) for r in found] == [("T1", 4, "CANCELLED", "H3")]
