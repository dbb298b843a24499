"""Reference data: CSV loading with an audit manifest, portfolios, issuer lists, exchange rates."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import UTC, date, datetime, timedelta
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.trade import cycled, stable_instrument_id
from ..model import FX_RATES, INSTRUMENTS, MANIFEST, PORTFOLIOS

# Series of the rate service and their currencies, its address, and where issuer lists come from.
SERIES = {"FXUSDCAD": "USD", "FXEURCAD": "EUR", "FXGBPCAD": "GBP"}
RATES_URL = "https://www.bankofcanada.ca/valet/observations"
ISSUERS_URL = "https://www.tsx.com/en/listings/listing-with-us/listed-company-directory"
RATE_SOURCE, IDENTITY_SOURCE = "BANK_OF_CANADA_VALET_API", "BANK_OF_CANADA_IDENTITY_RATE"
LOOK_BACK_DAYS = 7
# The portfolios (id, name, strategy, base currency) and the made-up currency of each issuer by its row.
PORTFOLIO_ROWS = (
    ("PORT-001", "Canadian Growth Fund", "LONG_ONLY", "CAD"),
    ("PORT-002", "North America Equity Fund", "LONG_SHORT", "CAD"),
    ("PORT-003", "Dividend Income Fund", "LONG_ONLY", "CAD"),
    ("PORT-004", "Technology Opportunities Fund", "LONG_SHORT", "CAD"),
    ("PORT-005", "Internal Trading Book", "TRADING", "CAD"),
)
QUOTE_CURRENCIES = ("CAD", "CAD", "CAD", "USD", "CAD", "EUR", "CAD", "GBP")
EFFECTIVE = date(2026, 1, 1)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a broken line fails the job."""
    return spark.read.option("header", True).option("mode", "FAILFAST").option("encoding", "UTF-8").csv(path)


def typed(frame: DataFrame, to: StructType) -> DataFrame:
    """The columns of a schema, cast one by one."""
    return frame.select(*(F.col(field.name).cast(field.dataType) for field in to))


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def column_values(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The non-blank values of a CSV column, trimmed; an error if there are none."""
    values = read_csv(spark, path).select(F.trim(F.col(column)).alias(column)).where(F.col(column) != "")
    if values.isEmpty():
        raise ValueError(f"no values in column {column!r} of {path}")
    return values


def instrument_currencies(spark: SparkSession, path: str) -> DataFrame:
    """``instrument_id``, ``quote_currency`` (CAD where none is given); an error if there are none."""
    frame = read_csv(spark, path)
    quote = F.trim("quote_currency") if "quote_currency" in frame.columns else F.lit("")
    rows = frame.where(F.trim("instrument_id") != "").select(
        F.trim("instrument_id").alias("instrument_id"), F.coalesce(F.nullif(quote, F.lit("")), F.lit("CAD")).alias("quote_currency")
    )
    if rows.isEmpty():
        raise ValueError(f"no instruments in {path}")
    return rows


def manifest_row(spark: SparkSession, **values) -> DataFrame:
    """One row of the manifest; what isn't given is null."""
    return spark.createDataFrame([tuple(values.get(name) for name in MANIFEST.fieldNames())], MANIFEST)


def load_dataset(
    spark: SparkSession,
    name: str,
    path: str,
    to: StructType,
    save: Callable[[DataFrame], None],
    log: Callable[[DataFrame], None],
    run_id: str,
    source_url: str,
    business_date: str | None = None,
) -> int:
    """Read, cast and save a CSV, and log a manifest row: SUCCESS, or FAILED (then the error is raised again)."""
    common = {
        "source_name": name,
        "source_type": "PUBLIC_API" if name == "fx_rates" else "REFERENCE_FILE",
        "source_url": source_url,
        "retrieved_at": datetime.now(UTC).replace(tzinfo=None),
        "file_path": path,
        "file_format": "CSV",
        "pipeline_run_id": run_id,
    }
    try:
        frame = typed(read_csv(spark, path), to)
        save(frame)
        measures = [F.count(F.lit(1)), F.max(business_date) if business_date else F.lit(None).cast("date")]
        count, latest = frame.agg(*measures).first()
    except Exception as error:
        log(manifest_row(spark, **common, row_count=0, load_status="FAILED", error_message=str(error)[:2000]))
        raise
    log(manifest_row(spark, **common, row_count=count, business_date=latest, load_status="SUCCESS"))
    return count


def portfolios(spark: SparkSession) -> DataFrame:
    rows = [(*row, True, EFFECTIVE, "SYNTHETIC") for row in PORTFOLIO_ROWS]
    return spark.createDataFrame(rows, PORTFOLIOS)


def resolve_column(names: Iterable[str], candidates: tuple[str, ...]) -> str:
    """The column whose trimmed lower-case name is the first candidate found."""
    known = {name.lstrip("﻿").strip().lower(): name for name in names}
    for candidate in candidates:
        if candidate in known:
            return known[candidate]
    raise ValueError(f"none of {candidates} among {sorted(known)}")


def normalise_issuers(rows: DataFrame, index: Column, limit: int | None = None) -> DataFrame:
    """Instruments of an issuer list. ``index``: the row's place in the list, from 0; ``limit``: so many usable rows, in that order."""
    symbol = F.upper(F.trim(F.col(f"`{resolve_column(rows.columns, ('symbol', 'ticker', 'stock symbol'))}`")))
    issuer = F.trim(F.col(f"`{resolve_column(rows.columns, ('company name', 'issuer name', 'company', 'name'))}`"))
    try:
        exchange = F.coalesce(F.upper(F.trim(F.col(f"`{resolve_column(rows.columns, ('exchange', 'market'))}`"))), F.lit(""))
    except ValueError:
        exchange = F.lit("TSX")
    usable = rows.select(index.cast("long").alias("row"), symbol.alias("symbol"), issuer.alias("issuer_name"), exchange.alias("exchange"))
    usable = usable.where((F.col("symbol") != "") & (F.col("issuer_name") != ""))
    if limit is not None:
        usable = usable.orderBy("row").limit(limit)
    columns = {
        "instrument_id": stable_instrument_id(F.col("exchange"), F.col("symbol")),
        "asset_class": F.lit("EQUITY"),
        "quote_currency": cycled(QUOTE_CURRENCIES, F.col("row")),
        "active_flag": F.lit(True),
        "effective_date": F.lit(EFFECTIVE),
        "source": F.lit("TMX_ISSUER_LIST"),
        "source_url": F.lit(ISSUERS_URL),
        "retrieved_at": F.current_timestamp(),
        "quote_currency_is_synthetic": F.lit(True),
    }
    return usable.withColumns(columns).select(*INSTRUMENTS.fieldNames()).orderBy("exchange", "symbol")


def normalise_issuer_csv(spark: SparkSession, path: str, limit: int = 25) -> DataFrame:
    """Instruments of an issuer CSV (header names vary in case and spaces; a byte order mark may lead)."""
    rows = read_csv(spark, path).withColumn("__row", F.monotonically_increasing_id())
    order = F.row_number().over(Window.orderBy("__row")) - 1  # one small file; currencies go by the row's place
    found = normalise_issuers(rows.withColumn("__row", order), F.col("__row"), limit)
    if found.isEmpty():
        raise ValueError(f"no usable issuers in {path}")
    return found


def rates_url(start: date, end: date) -> str:
    """Address of the observations for a range, from some days earlier, so that the first day has a rate to carry."""
    since = start - timedelta(days=LOOK_BACK_DAYS)
    return f"{RATES_URL}/{','.join(SERIES)}/json?{urlencode({'start_date': since.isoformat(), 'end_date': end.isoformat()})}"


def download(url: str, timeout: int = 30) -> bytes:
    """The rate service's answer (driver side; the file then goes to shared storage)."""
    from urllib.request import urlopen

    if not url.startswith("https://"):
        raise ValueError("only https addresses are read")
    with urlopen(url, timeout=timeout) as answer:
        return answer.read()


def observations(raw: DataFrame) -> DataFrame:
    """``currency``, ``observed``, ``rate`` of the service's JSON (one document per row, column ``value``); blanks are left out."""
    fields = ", ".join(f"{series}: struct<v: string>" for series in SERIES)
    parsed = raw.select(F.from_json("value", f"observations array<struct<d: string, {fields}>>").alias("j"))
    day = parsed.select(F.explode("j.observations").alias("o"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("currency"), F.col(f"o.{s}.v").alias("v")) for s, c in SERIES.items())))
    rows = day.select(F.to_date("o.d").alias("observed"), each.alias("x"))
    rate = F.col("x.v").try_cast("decimal(18,6)")
    return rows.select(F.col("x.currency").alias("currency"), "observed", rate.alias("rate")).where(rate.isNotNull())


def carried_rates(observed: DataFrame, start: Column, end: Column, base: str = "CAD") -> DataFrame:
    """The rate of each currency on each day from ``start`` to ``end``: the latest observation up to it (an as-of join).

    Each observation is spread over the days until the next one, so the join is a window over observations
    and an explode: no pair of a day and an observation is ever compared. Days before the first have no row. The base
    currency is 1 on every day.
    """
    following = F.lead("observed").over(Window.partitionBy("currency").orderBy("observed"))
    # Of several observations of one day one counts: the largest, so that the result doesn't hang on their order.
    one = observed.groupBy("currency", "observed").agg(F.max("rate").alias("rate"))
    spans = one.withColumn("until", F.least(F.coalesce(F.date_sub(following, 1), end), end)).withColumn("since", F.greatest("observed", start))
    days = spans.where(F.col("since") <= F.col("until")).select(
        "currency", F.explode(F.sequence("since", "until")).alias("rate_date"), F.col("rate").alias("cad_rate"), F.col("observed").alias("original_rate_date"), F.lit(RATE_SOURCE).alias("source")
    )
    calendar = observed.sparkSession.range(1).select(F.explode(F.sequence(start, end)).alias("rate_date"))
    identity = calendar.select(
        F.lit(base).alias("currency"), "rate_date", F.lit(1).cast("decimal(18,6)").alias("cad_rate"), F.col("rate_date").alias("original_rate_date"), F.lit(IDENTITY_SOURCE).alias("source")
    )
    both = days.withColumn("cad_rate", F.col("cad_rate").cast("decimal(18,6)")).unionByName(identity)
    return both.withColumns(
        {"is_carried_forward": F.col("original_rate_date") != F.col("rate_date"), "retrieved_at": F.current_timestamp()}
    ).select(*FX_RATES.fieldNames())
