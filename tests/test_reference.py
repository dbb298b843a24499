from __future__ import annotations

import json
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.model import FX_RATES
from tidemark.sources import generator, reference
from tidemark.streaming.store import Store, safe_identifier

PAYLOAD = {"observations": [{"d": "2026-08-07", "FXUSDCAD": {"v": "1.3943"}, "FXEURCAD": {"v": "1.6121"}, "FXGBPCAD": {"v": ""}}]}


def test_rates_are_carried_over_a_weekend(spark):
    raw = spark.createDataFrame([(json.dumps(PAYLOAD),)], "value string")
    rates = reference.carried_rates(reference.observations(raw), F.lit(date(2026, 8, 8)), F.lit(date(2026, 8, 9))).collect()
    usd = sorted((r["rate_date"], r["cad_rate"], r["original_rate_date"], r["is_carried_forward"]) for r in rates if r["currency"] == "USD")
    assert usd == [(date(2026, 8, d), Decimal("1.394300"), date(2026, 8, 7), True) for d in (8, 9)]
    assert {r["currency"] for r in rates} == {"USD", "EUR", "CAD"}
    assert all(r["cad_rate"] == 1 and not r["is_carried_forward"] for r in rates if r["currency"] == "CAD")


def test_the_service_address_looks_back():
    assert "start_date=2026-08-01&end_date=2026-08-09" in reference.rates_url(date(2026, 8, 8), date(2026, 8, 9))


def test_issuers_are_normalised(spark, tmp_path):
    path = tmp_path / "issuers.csv"
    path.write_text("﻿Company Name, Symbol ,Exchange\nExample Issuer,abc,tsx\n,zzz,TSX\nOther,xyz,\n", encoding="utf-8")
    rows = reference.normalise_issuer_csv(spark, str(path)).collect()
    assert [(r["exchange"], r["symbol"], r["issuer_name"], r["quote_currency"]) for r in rows] == [("", "XYZ", "Other", "CAD"), ("TSX", "ABC", "Example Issuer", "CAD")]
    first = rows[1]
    assert first["instrument_id"].startswith("INS-") and len(first["instrument_id"]) == 12 and first["quote_currency_is_synthetic"]
    with pytest.raises(ValueError, match="none of"):
        reference.resolve_column(["a", "b"], ("symbol",))


def test_loading_logs_success_and_failure(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    good = tmp_path / "fx.csv"
    good.write_text("currency,rate_date,cad_rate,original_rate_date,is_carried_forward,source,retrieved_at\nUSD,2026-08-11,1.3927,2026-08-11,false,x,2026-08-12T00:00:00\n")
    save, log = (lambda f: store.overwrite("fx_rates", f)), (lambda f: store.append("ingestion_manifest", f))
    assert reference.load_dataset(spark, "fx_rates", str(good), FX_RATES, save, log, "r1", "u", "rate_date") == 1
    assert store.read("fx_rates").first()["cad_rate"] == Decimal("1.392700")
    bad = tmp_path / "bad.csv"
    bad.write_text("currency,rate_date\nUSD,2026-08-11\n")
    with pytest.raises(Exception):  # noqa: B017 the reader's own error is passed on
        reference.load_dataset(spark, "fx_rates", str(bad), FX_RATES, save, log, "r2", "u", "rate_date")
    rows = {r["pipeline_run_id"]: r for r in store.read("ingestion_manifest").collect()}
    assert (rows["r1"]["load_status"], rows["r1"]["row_count"], rows["r1"]["business_date"]) == ("SUCCESS", 1, date(2026, 8, 11))
    assert rows["r2"]["load_status"] == "FAILED" and rows["r2"]["row_count"] == 0 and 0 < len(rows["r2"]["error_message"]) <= 2000


def test_column_loaders(spark, tmp_path):
    path = tmp_path / "i.csv"
    path.write_text("instrument_id,quote_currency\nI1, USD \nI2,\n,EUR\n")
    found = {r["instrument_id"]: r["quote_currency"] for r in reference.instrument_currencies(spark, str(path)).collect()}
    assert found == {"I1": "USD", "I2": "CAD"}
    assert reference.column_values(spark, str(path), "instrument_id").count() == 2
    (tmp_path / "e.csv").write_text("instrument_id\n")
    with pytest.raises(ValueError, match="no values"):
        reference.column_values(spark, str(tmp_path / "e.csv"), "instrument_id")


def test_identifiers_are_guarded():
    assert safe_identifier("abc_1") == "abc_1"
    with pytest.raises(ValueError, match="unsafe"):
        safe_identifier("a; drop")


@pytest.fixture(scope="module")
def generated(spark):
    config = generator.Config(num_trades=200, amend_rate=0.30, multiple_amend_rate=0.25, cancel_rate=0.10, duplicate_rate=0.05, invalid_rate=0.02, unknown_reference_rate=0.02, late_event_rate=0.05, conflict_rate=0.02)
    instruments = spark.createDataFrame([("INS-1", "CAD"), ("INS-2", "USD")], "instrument_id string, quote_currency string")
    portfolios = spark.createDataFrame([("PORT-1",), ("PORT-2",)], "portfolio_id string")
    return [generator.generate(spark, config, instruments, portfolios) for _ in range(2)]


def test_generation_is_deterministic_and_dense(generated):
    first, second = ([tuple(r) for r in events.orderBy("replay_offset").collect()] for events, _ in generated)
    assert first == second
    assert [r[0] for r in first] == list(range(len(first)))


def test_generation_has_every_scenario(generated):
    events, about = generated[0]
    rows = events.collect()
    total = about["lifecycle_event_count_before_injections"]
    assert len(rows) == about["generated_event_count"]
    assert {r["event_type"] for r in rows} == {"NEW", "AMEND", "CANCEL"}
    assert len(rows) - len({r["event_id"] for r in rows}) == about["duplicate_events_injected"] == round(total * 0.05)
    assert sum(r["quantity"] < 0 for r in rows) >= round(total * 0.02)
    assert any(r["instrument_id"] == "INS-UNKNOWN" for r in rows) or any(r["portfolio_id"] == "PORT-UNKNOWN" for r in rows)
    assert about["same_version_conflicts_injected"] == round(total * 0.02) and about["late_events_injected"] > 0
    assert all(r["trade_currency"] == {"INS-1": "CAD", "INS-2": "USD"}.get(r["instrument_id"], r["trade_currency"]) for r in rows)


def test_bad_rates_are_refused():
    with pytest.raises(ValueError, match="between 0 and 1"):
        generator.Config(amend_rate=1.5)
    with pytest.raises(ValueError, match="positive"):
        generator.Config(num_trades=0)
