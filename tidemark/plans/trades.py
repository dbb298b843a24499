"""Trade events, dimensions and rates derived from the test tables; ``scenario_*`` add what sound sources don't have.

Only the derivation of input is here. A trade is an order, its events are the order's lines by ship date; a selector
``k`` in 0..99 of each line decides what befalls it (conflicts, late delivery, re-delivery, bad values, unknown keys).
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.trade import cycled
from ..operators.enrich import apply_rules, derive, join_dimensions
from ..sources.reference import QUOTE_CURRENCIES, carried_rates

AS_OF = "1998-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def messages(spark: SparkSession, sf_dir: str, buckets: int | None = None, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """Events with their message key and the selector ``k``; with ``buckets``, each bucket of trades (from 0) in a partition of its own."""
    c = F.col
    # Only what the events are made of is dealt, by trade; a price is shorter as a decimal than as a double.
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("TRD-"), c("l_orderkey")).alias("trade_id"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        c("l_quantity").cast("long").alias("l_quantity"), c("l_extendedprice").cast("decimal(18,4)").alias("l_extendedprice"), "l_linestatus", "l_shipdate",
    )
    trade = ["trade_id"]
    if buckets is not None:
        lines = lines.withColumn("__bucket", bucket(c("trade_id"))).repartitionById(buckets, "__bucket")
        trade = ["__bucket", "trade_id"]
    order = Window.partitionBy(*trade).orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    k = ((c("l_partkey") * 7 + c("l_suppkey") * 13 + c("l_linenumber") * 31) % 100).cast("int")
    rows = lines.withColumn("r", F.row_number().over(order)).withColumn("k", k)
    k, r = c("k"), c("r")
    millis = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c("l_shipdate")) + r * 60_000
    event = rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("event_id"),
        "trade_id",
        F.when((k < 3) & (r > 1), r - 1).otherwise(r).alias("event_version"),
        F.when(r == 1, "NEW").when(k >= 92, "CANCEL").otherwise("AMEND").alias("event_type"),
        F.timestamp_millis(millis).alias("event_ts"),
        millis.alias("event_ms"),
        c("l_shipdate").cast("date").alias("trade_date"),
        F.when(k == 63, "PORT-UNKNOWN").otherwise(F.concat(F.lit("PORT-"), c("l_suppkey"))).alias("portfolio_id"),
        F.when(k == 62, "INS-UNKNOWN").otherwise(F.concat(F.lit("INS-"), c("l_partkey"))).alias("instrument_id"),
        F.when(k == 64, "HOLD").when(c("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"),
        (c("l_quantity") * F.when(k == 50, -1).otherwise(1)).alias("quantity"),
        F.when(k != 51, c("l_extendedprice")).alias("price"),
        F.when(k == 60, "JPY").when(k == 61, "USD").otherwise(cycled(QUOTE_CURRENCIES, c("l_partkey"))).alias("trade_currency"),
        F.lit(False).alias("parse_failed"),
        F.lit("trades").alias("topic"),
        F.lit(0).alias("partition"),
        (c("l_orderkey") * 100_000 + r + F.when(k.between(4, 7) & (r > 1), 10_000).otherwise(0)).alias("offset"),
        "k",
    )
    # Some come again. No union: rows stay dealt by trade.
    later = F.explode(F.when(c("k") == 20, F.array(F.lit(0), F.lit(20_000))).otherwise(F.array(F.lit(0))))
    return event.withColumn("__later", later).withColumn("offset", c("offset") + c("__later")).drop("__later")


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.concat(F.lit("INS-"), F.col("p_partkey")).alias("instrument_id"),
        (F.col("p_size") % 25 != 0).alias("active_flag"),
        cycled(QUOTE_CURRENCIES, F.col("p_partkey")).alias("quote_currency"),
    )


def portfolios(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    return supplier.select(F.concat(F.lit("PORT-"), F.col("s_suppkey")).alias("portfolio_id"), (F.col("s_acctbal") > -900).alias("active_flag"))


def scenario_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with unreadable and incomplete ones among them, and payloads that come again under another event id."""
    rows = messages(spark, sf_dir)
    k = F.col("k")
    again = rows.where(k == 21).withColumns({"event_id": F.concat("event_id", F.lit("-R")), "offset": F.col("offset") + 30_000})
    lost = {name: F.when(k != 22, F.col(name)) for name in ("portfolio_id", "instrument_id", "side", "quantity", "price", "trade_currency")}
    lost |= {name: F.when(~k.isin(22, other), F.col(name)) for name, other in (("event_id", 23), ("trade_id", 24), ("event_ts", 27), ("event_ms", 27), ("trade_date", 27))}
    lost |= {"event_version": F.when(k == 25, 0).when(k != 22, F.col("event_version")), "event_type": F.when(k == 26, "BUST").when(k != 22, F.col("event_type"))}
    return rows.withColumns(lost | {"parse_failed": k == 22}).unionByName(again)


def scenario_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scenario messages joined, ruled and measured; every tenth portfolio is inactive."""
    books = table(spark, sf_dir, "supplier").select(F.concat(F.lit("PORT-"), F.col("s_suppkey")).alias("portfolio_id"), (F.col("s_suppkey") % 10 != 0).alias("active_flag"))
    return derive(apply_rules(join_dimensions(scenario_messages(spark, sf_dir), instruments(spark, sf_dir), books, rates(spark, sf_dir))))


def rate_days(spark: SparkSession, sf_dir: str) -> tuple[Column, Column]:
    """First and last day of the shipped lines (two values)."""
    low, high = table(spark, sf_dir, "lineitem").agg(F.min("l_shipdate").cast("date"), F.max("l_shipdate").cast("date")).first()
    return F.lit(low), F.lit(high)


def observed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates on week days; the pound has gaps and starts late."""
    low, high = rate_days(spark, sf_dir)
    days = spark.range(1).select(F.explode(F.sequence(F.date_sub(low, 7), high)).alias("observed")).withColumn("n", day_number(F.col("observed")))
    currencies = F.explode(F.array(*(F.struct(F.lit(c).alias("currency"), F.lit(m).alias("m")) for c, m in (("USD", 1_390_000), ("EUR", 1_600_000), ("GBP", 1_880_000)))))
    rows = days.where((F.col("n") + 3) % 7 < 5).select("observed", "n", currencies.alias("x"))
    rows = rows.where((F.col("x.currency") != "GBP") | ((F.col("n") % 11 != 0) & (F.datediff("observed", low) >= 60)))
    micros = F.col("x.m") + (F.col("n") * 37 % 1000) * 100
    rate = (micros.cast("decimal(18,0)") * F.lit(Decimal("0.000001"))).cast("decimal(18,6)")
    return rows.select(F.col("x.currency").alias("currency"), "observed", rate.alias("rate"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carried_rates(observed_rates(spark, sf_dir), *rate_days(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages joined, ruled and measured."""
    dimensions = (make(spark, sf_dir) for make in (instruments, portfolios, rates))
    return derive(apply_rules(join_dimensions(messages(spark, sf_dir), *dimensions)))


def applied(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("outcome") == "APPLIED")
