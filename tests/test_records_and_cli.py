from __future__ import annotations

import json
import subprocess
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest

from tidemark import cli
from tidemark.functions import avro
from tidemark.model import BookingEvent
from tidemark.operators import records
from tidemark.sources import messages, reference
from tidemark.streaming.store import Store

from test_enrich import EVENT

KNOWN = ({"INS-001"}, {"PORT-001"}, {"CAD", "USD"})


def test_row_rules():
    assert records.failed_rules(EVENT, *KNOWN) == ()
    bad = EVENT | {"event_id": "", "event_version": "1", "quantity": 0, "price": "x", "side": None, "portfolio_id": "?", "trade_currency": "JPY", "event_ts": 0}
    assert records.failed_rules(bad, *KNOWN) == ("MISSING_EVENT_ID", "INVALID_EVENT_VERSION", "MISSING_EVENT_TIMESTAMP", "INVALID_SIDE", "INVALID_QUANTITY", "INVALID_PRICE", "UNKNOWN_OR_INACTIVE_PORTFOLIO", "MISSING_FX_RATE")


def test_record_hash_ignores_delivery():
    assert records.record_hash(EVENT) == records.record_hash(EVENT | {"event_id": "X", "produced_ts": 0}) != records.record_hash(EVENT | {"price": "1"})


def make(number, version, kind, price="10.0000", trade="T1"):
    return BookingEvent.read(EVENT | {"event_id": f"E{number}", "event_version": version, "event_type": kind, "price": price, "trade_id": trade, "event_ts": 1786454400000 + version * 1000})


def test_events_of_several_trades():
    events = [make(1, 1, "NEW"), make(2, 1, "NEW", trade="T2"), make(3, 2, "AMEND"), make(3, 2, "AMEND"), make(4, 1, "NEW"), make(5, 2, "AMEND", "11.0000"), make(6, 3, "CANCEL"), make(7, 4, "AMEND"), make(8, 2, "AMEND", trade="T3")]
    decisions, states = records.classify_events(events)
    assert [d.outcome for d in decisions] == ["APPLIED", "APPLIED", "APPLIED", "DUPLICATE", "STALE_VERSION", "VERSION_CONFLICT", "APPLIED", "QUARANTINED", "QUARANTINED"]
    assert {k: (s.version, s.status) for k, s in states.items()} == {"T1": (3, "CANCELLED"), "T2": (1, "BOOKED")}
    more, after = records.classify_events([make(1, 9, "AMEND", trade="T2"), make(9, 2, "AMEND", trade="T2")], states, {"E1"})
    assert [d.outcome for d in more] == ["DUPLICATE", "APPLIED"] and after["T2"].version == 2


def test_commands_from_reference_data_to_reconciliation(spark, tmp_path, capsys):
    root = str(tmp_path / "store")
    issuers = tmp_path / "issuers.csv"
    issuers.write_text("Symbol,Company Name,Exchange\n" + "".join(f"S{k},Issuer {k},TSX\n" for k in range(12)))
    rates = tmp_path / "rates.json"
    rates.write_text('{"observations":[{"d":"2026-08-07","FXUSDCAD":{"v":"1.39"},"FXEURCAD":{"v":"1.61"},"FXGBPCAD":{"v":"1.88"}}]}')
    books = tmp_path / "books.csv"
    books.write_text("portfolio_id,portfolio_name,strategy,base_currency,active_flag,effective_date,source\nP1,a,b,CAD,true,2026-01-01,x\nP2,a,b,CAD,false,2026-01-01,x\n")
    run = lambda *words: cli.main([words[0], "--store", root, *words[1:]])
    assert run("issuers", str(issuers)) == 0
    assert run("rates", str(rates), "--start-date", "2026-08-10", "--end-date", "2026-08-12") == 0
    assert run("load", "portfolios", str(books)) == 0
    assert run("generate", str(tmp_path / "replay"), "--num-trades", "60", "--amend-rate", "0.4", "--duplicate-rate", "0.1") == 0
    assert run("run", "--replay", str(tmp_path / "replay" / "events")) == 0
    assert run("gold", "--as-of-date", "2026-08-11") == 0
    assert capsys.readouterr().out.count("PASS") == 8
    store = Store(spark, root)
    assert {r["outcome"] for r in store.read("outcomes").select("outcome").distinct().collect()} >= {"APPLIED", "DUPLICATE", "QUARANTINED"}
    with pytest.raises(ValueError, match="before"):
        run("rates", str(rates), "--start-date", "2026-08-12", "--end-date", "2026-08-10")


def test_one_command_prepares_and_one_enters_the_catalogue(spark, tmp_path, monkeypatch, capsys):
    root = str(tmp_path / "store")
    issuers = tmp_path / "issuers.csv"
    issuers.write_text("Symbol,Company Name,Exchange\n" + "".join(f"S{k},Issuer {k},TSX\n" for k in range(8)))
    asked = []
    answer = '{"observations":[{"d":"2026-08-07","FXUSDCAD":{"v":"1.39"},"FXEURCAD":{"v":"1.61"},"FXGBPCAD":{"v":"1.88"}}]}'
    monkeypatch.setattr(reference, "download", lambda url: asked.append(url) or answer.encode())
    days = ["--start-date", "2026-08-10", "--end-date", "2026-08-12"]
    assert cli.main(["prepare", "--store", root, "--run-id", "r1", str(tmp_path / "replay"), "--issuers", str(issuers), *days, "--num-trades", "20"]) == 0
    assert asked == [reference.rates_url(*map(__import__("datetime").date.fromisoformat, days[1::2]))]
    assert (tmp_path / "store" / "raw" / "rates-r1.json").read_text() == answer
    store = Store(spark, root)
    counts = [store.read(name).count() for name in ("instruments", "portfolios", "fx_rates")]
    assert counts[0] == 8 and counts[1] > 0 and counts[2] == 12
    assert json.loads(capsys.readouterr().out.splitlines()[-1])
    events = messages.replay_events(spark, str(tmp_path / "replay" / "events"))
    assert events.count() >= 20
    key, value = messages.kafka_records(events, 77).first()
    assert value[:5] == b"\0" + (77).to_bytes(4, "big") and avro.decode_body(bytes(value[5:]))["trade_id"] == key.decode()
    assert cli.main(["setup", "--store", root, "--database", "tidemark_setup"]) == 0
    assert spark.table("tidemark_setup.instruments").count() == 8 and spark.table("booked_trades").count() == 0
    spark.sql("DROP SCHEMA tidemark_setup CASCADE")
    monkeypatch.setattr(reference, "download", lambda url: b'{"observations":[]}')
    with pytest.raises(ValueError, match="no usable rates"):
        cli.main(["rates", "--store", root, *days])
    assert store.read("fx_rates").count() == 12


def test_keys_and_secrets(monkeypatch):
    args = cli.parser().parse_args(["run", "--store", "x", "--kafka-servers", "h:1", "--kafka-key-env", "K", "--kafka-secret-env", "S"])
    assert cli.login(args, "kafka") == (None, None) and messages.login_options(None, None) == {}
    monkeypatch.setenv("K", "user")
    with pytest.raises(ValueError, match="only one"):
        cli.login(args, "kafka")
    monkeypatch.setenv("S", 'a"b\\c')
    options = messages.login_options(*cli.login(args, "kafka"))
    assert options["kafka.security.protocol"] == "SASL_SSL" and options["kafka.sasl.jaas.config"].endswith('password="a\\"b\\\\c";')


def test_the_registry_gives_the_schema_id():
    asked = []

    class Registry(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"id": 4711}')

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Registry)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        address = f"http://127.0.0.1:{server.server_port}"
        assert messages.registered_schema(address, "trade-events.v1-value") == 4711
        with pytest.raises(ValueError, match="https"):
            messages.registered_schema(address, "s", "key", "secret")
    finally:
        server.shutdown()
    path, body = asked[0]
    assert len(asked) == 1 and path == "/subjects/trade-events.v1-value/versions"
    assert json.loads(body["schema"]) == avro.CONTRACT


def test_a_job_runs_in_order_with_retries_and_limits(tmp_path):
    calls = []

    def start(words, check, timeout):
        calls.append((words[3], timeout))
        if len(calls) < 3:
            raise subprocess.CalledProcessError(1, words) if len(calls) == 1 else subprocess.TimeoutExpired(words, timeout)

    path = tmp_path / "job.json"
    tasks = [
        {"key": "b", "depends_on": ["a"], "arguments": ["gold", "{day}"], "timeout_seconds": 5},
        {"key": "a", "arguments": ["run"], "max_retries": 2, "retry_interval_seconds": 0, "timeout_seconds": 7},
    ]
    path.write_text(json.dumps({"tasks": tasks, "timeout_seconds": 60}))
    cli.run_job(str(path), {"day": "x"}, start)
    assert calls == [("run", 7)] * 3 + [("gold", 5)]
    calls.clear()
    tasks[1]["max_retries"] = 1
    path.write_text(json.dumps({"tasks": tasks}))
    with pytest.raises(RuntimeError, match="task a failed"):
        cli.run_job(str(path), {"day": "x"}, start)
    path.write_text(json.dumps({"tasks": tasks[:1]}))
    with pytest.raises(ValueError, match="wait"):
        cli.run_job(str(path), {}, start)
    # The job that comes with the repository names commands that exist.
    job = json.loads((Path(__file__).resolve().parent.parent / "job.json").read_text())
    for task in job["tasks"]:
        cli.parser().parse_args([word if "{" not in word else "2026-08-11" for word in task["arguments"]])
