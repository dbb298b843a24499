from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import functions as F

import pytest

from tidemark.functions import avro
from tidemark.functions.trade import notional, payload_hash, signed_quantity
from tidemark.model import FX_RATES, INSTRUMENTS, PAYLOAD_FIELDS, PORTFOLIOS, BookingEvent, EventType, Side
from tidemark.operators import enrich

EVENT = {
    "event_id": "E1", "trade_id": "T1", "event_version": 1, "event_type": "NEW", "event_ts": 1786454400000, "produced_ts": 1786454410000,
    "source_system": "SYNTHETIC_OMS", "portfolio_id": "PORT-001", "instrument_id": "INS-001", "side": "BUY", "quantity": 100, "price": "12.5000", "trade_currency": "CAD",
}
BRONZE = "raw_value binary, payload_format string, topic string, partition int, offset long"


def null_filled(spark, schema, **values):
    return spark.createDataFrame([tuple(values.get(f.name) for f in schema)], schema)


def dimensions(spark):
    day = __import__("datetime").date(2026, 8, 11)
    return (
        null_filled(spark, INSTRUMENTS, instrument_id="INS-001", active_flag=True, quote_currency="CAD"),
        null_filled(spark, PORTFOLIOS, portfolio_id="PORT-001", active_flag=True),
        null_filled(spark, FX_RATES, currency="CAD", rate_date=day, cad_rate=Decimal("1.000000")),
    )


def enriched(spark, *values, avro_format=False):
    kind = "CONFLUENT_AVRO" if avro_format else "JSON_REPLAY"
    rows = [(v if isinstance(v, bytes) else json.dumps(v).encode(), kind, "t", 0, k) for k, v in enumerate(values)]
    return enrich.enrich(spark.createDataFrame(rows, BRONZE), *dimensions(spark)).orderBy("offset").collect()


def test_a_valid_event_passes_all_rules(spark):
    row = enriched(spark, EVENT)[0]
    assert row["failed_rules"] == [] and not row["parse_failed"]
    assert (row["signed_quantity"], row["local_notional"], row["notional_cad"]) == (100, Decimal("1250.0000"), Decimal("1250.0000"))


def test_all_failing_rules_are_reported_in_order(spark):
    bad = EVENT | {"event_id": None, "event_version": 0, "event_type": "OPEN", "side": "HOLD", "quantity": -1, "price": "x", "instrument_id": "?", "portfolio_id": "?", "trade_currency": "JPY"}
    row = enriched(spark, bad)[0]
    assert row["failure_reason"] == "MISSING_EVENT_ID|INVALID_EVENT_VERSION|INVALID_EVENT_TYPE|INVALID_SIDE|INVALID_QUANTITY|INVALID_PRICE|UNKNOWN_INSTRUMENT|UNKNOWN_PORTFOLIO|MISSING_FX_RATE"


def test_currency_mismatch_needs_both_currencies(spark):
    day = enriched(spark, EVENT | {"trade_currency": "USD"}, EVENT | {"trade_currency": None})
    assert day[0]["failed_rules"] == ["MISSING_FX_RATE", "TRADE_CURRENCY_MISMATCH"]
    assert day[1]["failed_rules"] == ["MISSING_FX_RATE"]


def test_malformed_payloads_are_named(spark):
    for row in enriched(spark, b"{not json", b"", b'{"event_id": "E1"'):
        assert row["parse_failed"] and row["failed_rules"][0] == "PAYLOAD_DESERIALIZATION_FAILED"


def test_avro_round_trip_and_broken_bodies(spark):
    body = avro.encode_body(EVENT)
    assert avro.decode_body(body) == EVENT
    assert avro.decode_body(body[:-1]) is None and avro.decode_body(body + b"x") is None and avro.decode_body(b"") is None
    good, broken, short = enriched(spark, avro.framed(body), avro.framed(body[:9]), b"\0\0", avro_format=True)
    assert (good["trade_id"], good["price"], good["failed_rules"]) == ("T1", Decimal("12.5000"), [])
    assert broken["parse_failed"] and short["parse_failed"]


@pytest.mark.parametrize("name", ["event_version", "event_ts", "produced_ts", "quantity"])
@pytest.mark.parametrize("value", [1 << 63, -(1 << 63) - 1, 1 << 90])
def test_numbers_of_more_than_64_bits_break_only_their_message(spark, name, value):
    names = [field["name"] for field in avro.CONTRACT["fields"]]
    before = {field: EVENT[field] for field in names[: names.index(name)]}
    zigzag, out = (value << 1) if value >= 0 else (-value << 1) - 1, bytearray()
    while zigzag > 0x7F:
        out.append(zigzag & 0x7F | 0x80)
        zigzag >>= 7
    whole = avro.encode_body(EVENT)
    start = len(avro.encode_body(before, {"fields": avro.CONTRACT["fields"][: len(before)]}))
    size = len(avro.encode_body(before | {name: EVENT[name]}, {"fields": avro.CONTRACT["fields"][: len(before) + 1]})) - start
    broken = whole[:start] + bytes([*out, zigzag]) + whole[start + size :]
    assert avro.decode_body(broken) is None
    if value == 1 << 63:
        bad, good = enriched(spark, avro.framed(broken), avro.framed(whole), avro_format=True)
        assert bad["parse_failed"] and not good["parse_failed"]


def test_extreme_numbers_within_64_bits_stop_no_job(spark):
    extreme = [EVENT | {name: value} for name in ("event_ts", "produced_ts", "quantity") for value in ((1 << 63) - 1, -(1 << 63))]
    rows = enriched(spark, *(avro.framed(avro.encode_body(e)) for e in extreme), avro_format=True)
    assert len(rows) == 6 and not any(r["parse_failed"] for r in rows)
    assert sum(r["event_ts"] is None for r in rows) == 2


def test_negative_prices_survive_avro():
    assert avro.decode_body(avro.encode_body(EVENT | {"price": "-0.0129"}))["price"] == "-0.0129"


def test_hash_covers_the_payload_only(spark):
    other = EVENT | {"event_id": "E9", "produced_ts": 1, "source_system": "X"}
    changed = EVENT | {"quantity": 101}
    a, b, c = (row["payload_hash"] for row in enriched(spark, EVENT, other, changed))
    assert a == b != c
    assert set(PAYLOAD_FIELDS).isdisjoint({"event_id", "produced_ts", "source_system"})


def test_measures_never_throw(spark):
    row = spark.range(1).select(
        notional(F.lit(9223372036854775807), F.lit(Decimal("99999999999999.9999"))).alias("n"),
        signed_quantity(F.lit("SELL"), F.lit(-9223372036854775808)).alias("q"),
        notional(F.lit(1), F.lit(Decimal("0.0001")).cast("decimal(18,4)"), F.lit(Decimal("0.499999")).cast("decimal(18,6)")).alias("twice"),
        payload_hash({name: F.lit(None) for name in PAYLOAD_FIELDS}).alias("h"),
    ).first()
    assert row["n"] is None and row["q"] is None and row["twice"] == Decimal("0.0001") and len(row["h"]) == 64


def test_a_repeated_dimension_key_multiplies_nothing(spark):
    instruments, portfolios, rates = dimensions(spark)
    bronze = spark.createDataFrame([(json.dumps(EVENT).encode(), "JSON_REPLAY", "t", 0, 0)], BRONZE)
    assert enrich.enrich(bronze, instruments.unionByName(instruments), portfolios, rates).count() == 1


def test_record_round_trip():
    event = BookingEvent.read(EVENT)
    assert event.event_type is EventType.NEW and event.side is Side.BUY
    assert event.as_record() == EVENT
    assert BookingEvent.read({k: v for k, v in EVENT.items() if k != "source_system"}).source_system == "SYNTHETIC_OMS"
