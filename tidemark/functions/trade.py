"""Columns derived from a trade event. Untrusted input never throws: try-forms give NULL where ANSI mode would stop the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import PAYLOAD_FIELDS

NULL_MARK = "∅"


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def payload_hash(columns: dict[str, Column] | None = None) -> Column:
    """SHA-256 of the payload's canonical text: its fields joined by ``|``, timestamps as epoch milliseconds, nulls marked."""
    columns = columns or {name: epoch_millis(F.col(name)) if name == "event_ts" else F.col(name) for name in PAYLOAD_FIELDS}
    fields = [F.coalesce(columns[name].cast("string"), F.lit(NULL_MARK)) for name in PAYLOAD_FIELDS]
    return F.sha2(F.concat_ws("|", *fields), 256)


def signed_quantity(side: Column, quantity: Column) -> Column:
    """The quantity, negative for everything but BUY."""
    return F.when(side == "BUY", quantity).otherwise(F.try_subtract(F.lit(0).cast("long"), quantity))


def notional(quantity: Column, price: Column, rate: Column | None = None) -> Column:
    """Exact product, rounded as decimals of the model are: with a rate to six places first, then to four."""
    product = F.try_multiply(quantity.cast("decimal(20,0)"), price)
    if rate is not None:
        product = F.try_multiply(product, rate)
    return product.try_cast("decimal(28,4)")


def price_from_text(text: Column) -> Column:
    return text.try_cast("decimal(18,4)")


def stable_instrument_id(exchange: Column, symbol: Column) -> Column:
    return F.concat(F.lit("INS-"), F.upper(F.substring(F.sha2(F.concat_ws(":", exchange, symbol), 256), 1, 8)))


def cycled(values: tuple[str, ...], index: Column) -> Column:
    """The value at a row index, over and over."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))
