"""Command line: ``python -m tidemark <command> --store ROOT ...``. Each command is one job; a scheduler chains them."""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys
import time
import uuid
from collections.abc import Callable, Sequence
from datetime import date

from .model import FX_RATES, INSTRUMENTS, PORTFOLIOS
from .session import session
from .sources import generator, messages, reference
from .streaming import pipeline
from .streaming.store import Store

DATASETS = {"instruments": (INSTRUMENTS, None), "portfolios": (PORTFOLIOS, None), "fx_rates": (FX_RATES, "rate_date")}


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    commands = made.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=text)
        one.add_argument("--store", required=True, help="root of the tables")
        one.add_argument("--run-id", default=None)
        return one

    load = command("load", "load a reference CSV and log it in the manifest")
    load.add_argument("dataset", choices=sorted(DATASETS))
    load.add_argument("path")
    load.add_argument("--source-url", default="")
    rates = command("rates", "carry observed rates over a calendar")
    rates.add_argument("path", nargs="?", help="a JSON file of the rate service; without it the service is asked and its answer kept in the store")
    calendar(rates)
    issuers = command("issuers", "normalise an issuer CSV into instruments")
    issuers.add_argument("path")
    issuers.add_argument("--limit", type=int, default=25)
    generate = command("generate", "write synthetic events as replay files")
    generate.add_argument("output")
    configured(generate)
    prepare = command("prepare", "instruments, portfolios, rates and synthetic events in one go")
    prepare.add_argument("output")
    prepare.add_argument("--issuers", required=True, help="issuer CSV")
    prepare.add_argument("--limit", type=int, default=25)
    prepare.add_argument("--rates", dest="path", help="as for the command rates")
    calendar(prepare)
    configured(prepare)
    setup = command("setup", "enter the tables and views in the session's catalogue")
    setup.add_argument("--database", default="tidemark")
    run = command("run", "ingest replay files or a Kafka topic, and classify")
    source = run.add_mutually_exclusive_group(required=True)
    source.add_argument("--replay")
    source.add_argument("--kafka-servers")
    secured(run)
    publish = command("publish", "send the events of replay files to a Kafka topic as framed Avro")
    publish.add_argument("path")
    publish.add_argument("--kafka-servers", required=True)
    publish.add_argument("--registry", help="address of the schema registry, which gives the schema's id; without it the id is 1")
    secured(publish)
    gold = command("gold", "build the aggregates and reconcile; fails if a check does")
    gold.add_argument("--as-of-date", type=date.fromisoformat, required=True)
    job = commands.add_parser("job", help="run the tasks of a job file in the order of their dependencies, with retries and time limits")
    job.add_argument("path")
    job.add_argument("--set", action="append", default=[], metavar="NAME=VALUE", help="value for {NAME} in the tasks' arguments")
    return made


def calendar(command: argparse.ArgumentParser) -> None:
    for name in ("--start-date", "--end-date"):
        command.add_argument(name, type=date.fromisoformat, required=True)


def configured(command: argparse.ArgumentParser) -> None:
    for name, kind in generator.Config.__annotations__.items():
        cast = {"int": int, "float": float}.get(kind, str)
        command.add_argument(f"--{name.replace('_', '-')}", type=cast, default=getattr(generator.Config(), name))


def secured(command: argparse.ArgumentParser) -> None:
    """A topic, and the names of environment variables with keys and secrets: secrets are never on a command line."""
    command.add_argument("--topic", default="trade-events.v1")
    for name in ("kafka-key", "kafka-secret", "registry-key", "registry-secret"):
        command.add_argument(f"--{name}-env", default=f"TIDEMARK_{name.upper().replace('-', '_')}")


def login(args: argparse.Namespace, service: str) -> tuple[str | None, str | None]:
    """Key and secret of a service from the environment; both or none."""
    names = getattr(args, f"{service}_key_env"), getattr(args, f"{service}_secret_env")
    key, secret = (os.environ.get(name) or None for name in names)
    if (key is None) != (secret is None):
        raise ValueError(f"of {names[0]} and {names[1]} only one is set")
    return key, secret


def load_rates(store: Store, args: argparse.Namespace, run_id: str) -> None:
    if args.end_date < args.start_date:
        raise ValueError("the end date lies before the start date")
    from pyspark.sql import functions as F

    path = args.path
    if path is None:
        path = f"{store.root}/raw/rates-{run_id}.json"
        store.put(path, reference.download(reference.rates_url(args.start_date, args.end_date)).decode())
    observed = reference.observations(store.spark.read.text(path, wholetext=True))
    if observed.isEmpty():
        raise ValueError(f"no usable rates in {path}")
    store.overwrite("fx_rates", reference.carried_rates(observed, F.lit(args.start_date), F.lit(args.end_date)))


def generate(store: Store, args: argparse.Namespace, run_id: str) -> None:
    config = generator.Config(**{name: getattr(args, name) for name in generator.Config.__annotations__})
    events, about = generator.generate(store.spark, config, store.read("instruments").select("instrument_id", "quote_currency"), store.read("portfolios").select("portfolio_id"))
    generator.write_replay(events, args.output, about | {"generation_run_id": run_id})
    print(json.dumps(about))


def run_job(path: str, values: dict[str, str], start: Callable[..., subprocess.CompletedProcess] = subprocess.run) -> None:
    """Run the tasks of a job file, each in a process of its own. A task that fails or is late is tried again; then the job fails.

    A task has ``key``, ``arguments`` (of this command line), ``depends_on``, ``max_retries``, ``retry_interval_seconds`` and
    ``timeout_seconds``; the job has a ``timeout_seconds`` over all.
    """
    with open(path, encoding="utf-8") as file:
        job = json.load(file)
    waiting, done, begun = {task["key"]: task for task in job["tasks"]}, set(), time.monotonic()
    while waiting:
        ready = [key for key, task in waiting.items() if done.issuperset(task.get("depends_on", ()))]
        if not ready:
            raise ValueError(f"tasks wait for each other or for missing ones: {', '.join(waiting)}")
        task = waiting.pop(ready[0])
        words = [sys.executable, "-m", __package__, *(word.format(**values) for word in task["arguments"])]
        for attempt in range(task.get("max_retries", 0) + 1):
            if attempt:
                time.sleep(task.get("retry_interval_seconds", 30))
            left = job.get("timeout_seconds", 7200) - (time.monotonic() - begun)
            if left <= 0:
                raise RuntimeError(f"the job's time was over before {task['key']}")
            try:
                start(words, check=True, timeout=min(left, task.get("timeout_seconds", 3600)))
                break
            except (subprocess.CalledProcessError, subprocess.TimeoutExpired) as error:
                failure = error
        else:
            raise RuntimeError(f"task {task['key']} failed") from failure
        done.add(task["key"])


def main(arguments: Sequence[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    if args.command == "job":
        run_job(args.path, {"run_id": str(uuid.uuid4())} | dict(pair.split("=", 1) for pair in args.set))
        return 0
    spark = session()
    store, run_id = Store(spark, args.store), args.run_id or str(uuid.uuid4())
    if args.command == "load":
        columns, business_date = DATASETS[args.dataset]
        count = reference.load_dataset(spark, args.dataset, args.path, columns, lambda f: store.overwrite(args.dataset, f), lambda f: store.append("ingestion_manifest", f), run_id, args.source_url, business_date)
        print(f"{args.dataset}: {count} rows")
    elif args.command == "rates":
        load_rates(store, args, run_id)
    elif args.command == "issuers":
        store.overwrite("instruments", reference.normalise_issuer_csv(spark, args.path, args.limit))
    elif args.command == "generate":
        generate(store, args, run_id)
    elif args.command == "prepare":
        store.overwrite("instruments", reference.normalise_issuer_csv(spark, args.issuers, args.limit))
        store.overwrite("portfolios", reference.portfolios(spark))
        load_rates(store, args, run_id)
        generate(store, args, run_id)
    elif args.command == "setup":
        store.create_tables(args.database)
        store.create_views()
    elif args.command == "publish":
        schema_id = messages.registered_schema(args.registry, f"{args.topic}-value", *login(args, "registry")) if args.registry else 1
        messages.publish(messages.replay_events(spark, args.path), args.kafka_servers, args.topic, schema_id, *login(args, "kafka"))
    elif args.command == "run":
        if args.replay:
            pipeline.ingest(store, messages.replay_messages(messages.replay_lines(spark, args.replay, "*.{jsonl,txt}"), run_id), "replay")
        else:
            pipeline.ingest(store, messages.kafka_messages(spark, args.kafka_servers, args.topic, run_id, *login(args, "kafka")), "kafka")
        pipeline.transform(store)
    else:
        pipeline.build_gold(store, args.as_of_date.isoformat())
        pipeline.reconcile(store, run_id).show(truncate=False)
    return 0
