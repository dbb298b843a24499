"""Messages to enriched events: decode, join reference dimensions, evaluate rules, derive measures."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import avro
from ..functions.trade import notional, payload_hash, price_from_text, signed_quantity
from ..model import PAYLOAD

CORRUPT = "_corrupt_record"


def instant(millis: Column) -> Column:
    """A timestamp from epoch milliseconds; null outside the years 1 to 9999, so that no number stops a job."""
    return F.when(millis.between(-62_135_596_800_000, 253_402_300_799_999), F.timestamp_millis(millis))


JSON, AVRO = "JSON_REPLAY", "CONFLUENT_AVRO"
FORMATS = (JSON, AVRO)


def possible_trade(messages: DataFrame, formats: Collection[str] = FORMATS) -> Column:
    """The trade that bronze messages name, in those too that ``decode`` finds unreadable.

    The key of a replay line is the trade in it; only without one is the line parsed. ``formats``: see ``decode``.
    """
    text = F.from_json(F.col("raw_value").cast("string"), "trade_id string")["trade_id"]
    named = F.when(F.col("payload_format") == JSON, F.coalesce(F.col("raw_key").cast("string"), text))
    return named.when(F.col("payload_format") == AVRO, avro.decode(_bodies())["trade_id"]) if AVRO in formats else named


def _bodies() -> Column:
    """Avro values; null in other messages, as a Python function is evaluated for every row, whatever condition stands around it."""
    return F.when(F.col("payload_format") == AVRO, F.col("raw_value"))


def decode(messages: DataFrame, formats: Collection[str] = FORMATS) -> DataFrame:
    """Bronze messages with the event's fields and ``parse_failed``.

    Malformed JSON is told from good JSON by the reader's corrupt-record field, as permissive parsing alone gives a struct of
    nulls; that counts as a failed parse, so the rule that names it is reported. ``formats``: those that the messages have (more will
    do); without Avro among them no row goes through Python.
    """
    text = F.col("raw_value").cast("string")
    as_json = F.from_json(text, StructType([*PAYLOAD.fields, *StructType.fromDDL(f"{CORRUPT} string").fields]), {"columnNameOfCorruptRecord": CORRUPT})
    staged = messages.withColumn("__json", F.when(F.col("payload_format") == JSON, as_json))
    staged = staged.withColumn("__good", F.when(F.col(f"__json.{CORRUPT}").isNull(), F.col("__json")))
    found = ["__good"]
    if AVRO in formats:
        staged = staged.withColumn("__avro", avro.decode(_bodies()))
        found.append("__avro")
    names = [name for name in PAYLOAD.fieldNames() if name != "replay_offset"]
    fields = {name: F.coalesce(*(F.col(f"{event}.{name}") for event in found)) for name in names}
    fields["event_ts"] = instant(fields["event_ts"])
    fields["produced_ts"] = instant(fields["produced_ts"])
    fields["price"] = price_from_text(fields["price"])
    failed = reduce(and_, (F.col(event).isNull() for event in found))
    columns = [column.alias(name) for name, column in fields.items()]
    event = staged.select(*messages.columns, *columns, failed.alias("parse_failed"))
    return event.withColumn("trade_date", F.to_date("event_ts"))


def dimension_views(instruments: DataFrame, portfolios: DataFrame, rates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dimensions' columns that enrichment needs; of rows that repeat a key the smallest counts, so no event can multiply."""

    def one(frame: DataFrame, *keys: str) -> DataFrame:
        others = [name for name in frame.columns if name not in keys]
        return frame.groupBy(*keys).agg(F.min(F.struct(*others)).alias("v")).select(*keys, "v.*")

    return (
        one(instruments.select("instrument_id", F.col("active_flag").alias("instrument_active"), F.col("quote_currency").alias("instrument_currency")), "instrument_id"),
        one(portfolios.select("portfolio_id", F.col("active_flag").alias("portfolio_active")), "portfolio_id"),
        one(rates.select(F.col("currency").alias("trade_currency"), F.col("rate_date").alias("trade_date"), "cad_rate"), "trade_currency", "trade_date"),
    )


#: A dimension that the planner takes for smaller than this is broadcast, whatever the session's threshold. Its estimate is of compressed
#: columns: 1.2 million instruments, some 100 MB as a hash table, are a few MB of Parquet.
BROADCAST_BYTES = 8 << 20


def _near(dimension: DataFrame) -> DataFrame:
    estimate = int(dimension._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(dimension) if estimate <= BROADCAST_BYTES else dimension


def join_dimensions(events: DataFrame, instruments: DataFrame, portfolios: DataFrame, rates: DataFrame) -> DataFrame:
    """Left joins on each dimension: broadcast, so that wide events stay where they are, or left to the planner beyond ``BROADCAST_BYTES``."""
    instruments, portfolios, rates = map(_near, dimension_views(instruments, portfolios, rates))
    return events.join(instruments, "instrument_id", "left").join(portfolios, "portfolio_id", "left").join(rates, ["trade_currency", "trade_date"], "left")


def rules() -> dict[str, Column]:
    """Codes and the conditions that raise them, in the order of reporting."""
    c = F.col
    missing = lambda name: c(name).isNull()
    outside = lambda name, *values: missing(name) | ~c(name).isin(*values)
    not_positive = lambda name: missing(name) | (c(name) <= 0)
    return {
        "PAYLOAD_DESERIALIZATION_FAILED": c("parse_failed"),
        "MISSING_EVENT_ID": missing("event_id"),
        "MISSING_TRADE_ID": missing("trade_id"),
        "INVALID_EVENT_VERSION": not_positive("event_version"),
        "INVALID_EVENT_TYPE": outside("event_type", "NEW", "AMEND", "CANCEL"),
        "MISSING_EVENT_TIMESTAMP": missing("event_ts"),
        "INVALID_SIDE": outside("side", "BUY", "SELL"),
        "INVALID_QUANTITY": not_positive("quantity"),
        "INVALID_PRICE": not_positive("price"),
        "UNKNOWN_INSTRUMENT": missing("instrument_active"),
        "INACTIVE_INSTRUMENT": ~c("instrument_active"),
        "UNKNOWN_PORTFOLIO": missing("portfolio_active"),
        "INACTIVE_PORTFOLIO": ~c("portfolio_active"),
        "MISSING_FX_RATE": missing("cad_rate"),
        "TRADE_CURRENCY_MISMATCH": c("instrument_currency") != c("trade_currency"),
    }


def apply_rules(enriched: DataFrame) -> DataFrame:
    """``failed_rules`` (all codes raised) and ``failure_reason`` (them joined by ``|``)."""
    raised = F.array_compact(F.array(*(F.when(condition, code) for code, condition in rules().items())))
    return enriched.withColumn("failed_rules", raised).withColumn("failure_reason", F.array_join("failed_rules", "|"))


def derive(validated: DataFrame) -> DataFrame:
    """Payload hash and measures. Measures that overflow are null; such rows can only be quarantined ones or are visible as null."""
    signed = signed_quantity(F.col("side"), F.col("quantity"))
    rate = F.col("cad_rate")
    return validated.withColumns(
        {
            "payload_hash": payload_hash(),
            "signed_quantity": signed,
            "local_notional": notional(F.col("quantity"), F.col("price")),
            "notional_cad": notional(F.col("quantity"), F.col("price"), rate),
            "signed_notional_cad": notional(signed, F.col("price"), rate),
        }
    )


def enrich(messages: DataFrame, instruments: DataFrame, portfolios: DataFrame, rates: DataFrame, formats: Collection[str] = FORMATS) -> DataFrame:
    """Bronze messages to events with rules and measures; works on a stream as well as on a table. ``formats``: see ``decode``."""
    return derive(apply_rules(join_dimensions(decode(messages, formats), instruments, portfolios, rates)))
