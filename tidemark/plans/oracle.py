"""The same queries in DuckDB's SQL, written from the rules and not from the Spark code."""

from __future__ import annotations

CYCLE = "['CAD','CAD','CAD','USD','CAD','EUR','CAD','GBP']"

MESSAGES = f"""
numbered AS (
  SELECT *, (l_partkey * 7 + l_suppkey * 13 + l_linenumber * 31) % 100 AS k,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS r
  FROM lineitem),
once AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS event_id, 'TRD-' || l_orderkey AS trade_id,
         CAST(CASE WHEN k < 3 AND r > 1 THEN r - 1 ELSE r END AS INTEGER) AS event_version,
         CASE WHEN r = 1 THEN 'NEW' WHEN k >= 92 THEN 'CANCEL' ELSE 'AMEND' END AS event_type,
         CAST(epoch_ms(l_shipdate) + r * 60000 AS BIGINT) AS event_ms, CAST(l_shipdate AS DATE) AS trade_date,
         CASE WHEN k = 63 THEN 'PORT-UNKNOWN' ELSE 'PORT-' || l_suppkey END AS portfolio_id,
         CASE WHEN k = 62 THEN 'INS-UNKNOWN' ELSE 'INS-' || l_partkey END AS instrument_id,
         CASE WHEN k = 64 THEN 'HOLD' WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side,
         CAST(l_quantity AS BIGINT) * (CASE WHEN k = 50 THEN -1 ELSE 1 END) AS quantity,
         CASE WHEN k <> 51 THEN CAST(l_extendedprice AS DECIMAL(18,4)) END AS price,
         CASE WHEN k = 60 THEN 'JPY' WHEN k = 61 THEN 'USD' ELSE {CYCLE}[l_partkey % 8 + 1] END AS trade_currency,
         CAST(l_orderkey * 100000 + r + CASE WHEN k BETWEEN 4 AND 7 AND r > 1 THEN 10000 ELSE 0 END AS BIGINT) AS "offset", k
  FROM numbered),
msg AS (SELECT * FROM once UNION ALL SELECT * REPLACE ("offset" + 20000 AS "offset") FROM once WHERE k = 20)"""

RATES = """
span AS (SELECT CAST(min(l_shipdate) AS DATE) AS low, CAST(max(l_shipdate) AS DATE) AS high FROM lineitem),
day AS (SELECT CAST(unnest(generate_series(low - 7, high, INTERVAL 1 DAY)) AS DATE) AS d, low, high FROM span),
base AS (SELECT * FROM (VALUES ('USD', 1390000), ('EUR', 1600000), ('GBP', 1880000)) t(currency, m)),
obs AS (
  SELECT currency, d AS observed,
         CAST(CAST(m + (date_diff('day', DATE '1970-01-01', d) * 37 % 1000) * 100 AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(8,6)) AS DECIMAL(18,6)) AS rate
  FROM day, base
  WHERE (date_diff('day', DATE '1970-01-01', d) + 3) % 7 < 5
    AND (currency <> 'GBP' OR (date_diff('day', DATE '1970-01-01', d) % 11 <> 0 AND date_diff('day', low, d) >= 60))),
fx AS (
  SELECT c.currency, d AS rate_date, o.rate AS cad_rate, o.observed AS original_rate_date
  FROM (SELECT d, currency FROM day, base WHERE d >= low) c ASOF JOIN obs o ON c.currency = o.currency AND c.d >= o.observed
  UNION ALL SELECT 'CAD', d, CAST(1 AS DECIMAL(18,6)), d FROM day WHERE d >= low)"""

DIMENSIONS = f"""
ins AS (SELECT 'INS-' || p_partkey AS instrument_id, p_size % 25 <> 0 AS instrument_active, {CYCLE}[p_partkey % 8 + 1] AS instrument_currency FROM part),
port AS (SELECT 'PORT-' || s_suppkey AS portfolio_id, s_acctbal > -900 AS portfolio_active FROM supplier)"""

ENRICHED = """
joined AS (
  SELECT m.*, instrument_active, instrument_currency, portfolio_active, cad_rate, original_rate_date
  FROM msg m LEFT JOIN ins USING (instrument_id) LEFT JOIN port USING (portfolio_id)
  LEFT JOIN fx ON fx.currency = m.trade_currency AND fx.rate_date = m.trade_date),
ruled AS (
  SELECT *, array_to_string(list_filter([
    CASE WHEN event_type NOT IN ('NEW', 'AMEND', 'CANCEL') THEN 'INVALID_EVENT_TYPE' END,
    CASE WHEN side IS NULL OR side NOT IN ('BUY', 'SELL') THEN 'INVALID_SIDE' END,
    CASE WHEN quantity IS NULL OR quantity <= 0 THEN 'INVALID_QUANTITY' END,
    CASE WHEN price IS NULL OR price <= 0 THEN 'INVALID_PRICE' END,
    CASE WHEN instrument_active IS NULL THEN 'UNKNOWN_INSTRUMENT' END,
    CASE WHEN instrument_active = false THEN 'INACTIVE_INSTRUMENT' END,
    CASE WHEN portfolio_active IS NULL THEN 'UNKNOWN_PORTFOLIO' END,
    CASE WHEN portfolio_active = false THEN 'INACTIVE_PORTFOLIO' END,
    CASE WHEN cad_rate IS NULL THEN 'MISSING_FX_RATE' END,
    CASE WHEN instrument_currency <> trade_currency THEN 'TRADE_CURRENCY_MISMATCH' END], lambda x: x IS NOT NULL), '|') AS failure_reason
  FROM joined),
ev AS MATERIALIZED (
  SELECT *, CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END AS signed_quantity,
    CAST(quantity * price AS DECIMAL(28,4)) AS local_notional,
    CAST(CAST(quantity * price * cad_rate AS DECIMAL(38,6)) AS DECIMAL(28,4)) AS notional_cad,
    CAST(CAST((CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) * price * cad_rate AS DECIMAL(38,6)) AS DECIMAL(28,4)) AS signed_notional_cad,
    sha256(concat_ws('|', trade_id, event_version, event_type, event_ms, portfolio_id, instrument_id, side, quantity,
                     coalesce(CAST(price AS VARCHAR), '∅'), trade_currency)) AS payload_hash
  FROM ruled)"""


def classified(source: str, ledger: str | None = None, state: str | None = None, name: str = "cls", broken: str = "false") -> str:
    """CTEs that classify the rows of ``source``, given a ledger and a state (names of CTEs). ``broken``: the payload couldn't be read."""
    seen = f"coalesce(event_id IN (SELECT event_id FROM {ledger} WHERE event_id IS NOT NULL), false)" if ledger else "false"
    stored = f"LEFT JOIN {state} st USING (trade_id)" if state else "CROSS JOIN (SELECT CAST(NULL AS INTEGER) AS sv, CAST(NULL AS VARCHAR) AS ss, CAST(NULL AS VARCHAR) AS sh) st"
    unseen = f'WHERE "offset" NOT IN (SELECT "offset" FROM {ledger})' if ledger else ""
    return f"""
{name}_a AS (
  SELECT *, failure_reason = '' AS clean, {seen} AS seen, CASE WHEN event_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY event_id ORDER BY "offset") END AS id_rank,
         row_number() OVER (PARTITION BY trade_id, event_version, payload_hash ORDER BY "offset") AS payload_rank
  FROM {source} {unseen}),
{name}_n AS (SELECT trade_id, event_version, count(DISTINCT payload_hash) AS payloads FROM {name}_a WHERE clean GROUP BY ALL),
{name}_b AS (
  SELECT a.*, coalesce(payloads, 1) AS payloads, sv, ss, sh,
         clean AND NOT seen AND id_rank = 1 AND coalesce(payloads, 1) = 1 AND payload_rank = 1 AS pre
  FROM {name}_a a LEFT JOIN {name}_n USING (trade_id, event_version) {stored}),
{name}_c AS (
  SELECT *, max(CASE WHEN pre THEN event_version END) OVER w AS prior_max,
         coalesce(max(CASE WHEN pre AND event_type = 'NEW' AND event_version = 1 THEN 1 ELSE 0 END) OVER w, 0) AS prior_new,
         min(CASE WHEN pre AND event_type = 'CANCEL' THEN event_version END) OVER w AS prior_cancel
  FROM {name}_b WINDOW w AS (PARTITION BY trade_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_d AS (
  SELECT *, greatest(coalesce(sv, 0), coalesce(prior_max, 0)) AS low,
         prior_cancel IS NULL AND CASE WHEN ss = 'CANCELLED' THEN false
           WHEN sv IS NULL THEN (event_type = 'NEW' AND event_version = 1 AND prior_new = 0) OR (event_type <> 'NEW' AND prior_new = 1)
           ELSE event_type <> 'NEW' END AS allowed
  FROM {name}_c),
{name} AS MATERIALIZED (
  SELECT *, CASE WHEN {broken} THEN 'QUARANTINED' WHEN seen OR id_rank > 1 THEN 'DUPLICATE' WHEN NOT clean THEN 'QUARANTINED' WHEN clean AND payloads > 1 THEN 'VERSION_CONFLICT'
    WHEN payload_rank > 1 THEN 'DUPLICATE' WHEN event_version = sv THEN CASE WHEN payload_hash = sh THEN 'DUPLICATE' ELSE 'VERSION_CONFLICT' END
    WHEN event_version < low THEN 'STALE_VERSION' WHEN NOT allowed THEN 'QUARANTINED' ELSE 'APPLIED' END AS outcome,
    CASE WHEN {broken} THEN 'PAYLOAD_DESERIALIZATION_FAILED' WHEN seen THEN 'DUPLICATE_EVENT_ID' WHEN id_rank > 1 THEN 'DUPLICATE_EVENT_ID_IN_BATCH' WHEN NOT clean THEN failure_reason
    WHEN payloads > 1 THEN 'CONFLICTING_TRADE_VERSION' WHEN payload_rank > 1 THEN 'REPLAYED_TRADE_VERSION'
    WHEN event_version = sv THEN 'EXISTING_TRADE_VERSION' WHEN event_version < low THEN 'LOWER_THAN_APPLIED_VERSION'
    WHEN NOT allowed THEN 'INVALID_LIFECYCLE_TRANSITION' ELSE 'ACCEPTED_HIGHER_VERSION' END AS reason
  FROM {name}_d)"""


def current(source: str = "cls", name: str = "cur") -> str:
    return f"""
{name} AS (
  SELECT *, CASE WHEN event_type = 'CANCEL' THEN 'CANCELLED' ELSE 'BOOKED' END AS trade_status FROM {source} WHERE outcome = 'APPLIED'
  QUALIFY row_number() OVER (PARTITION BY trade_id ORDER BY event_version DESC, event_ms DESC, "offset" DESC) = 1)"""


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",".join(parts) + "\n" + select


INPUT = (MESSAGES, RATES, DIMENSIONS, ENRICHED)
ALL = (*INPUT, classified("ev"), current())
POSITION_COLUMNS = """portfolio_id, instrument_id, CAST(sum(signed_quantity) AS BIGINT) AS net_quantity,
  CAST(sum(CASE WHEN side = 'BUY' THEN quantity ELSE 0 END) AS BIGINT) AS gross_buy_quantity,
  CAST(sum(CASE WHEN side = 'SELL' THEN quantity ELSE 0 END) AS BIGINT) AS gross_sell_quantity,
  CAST(sum(local_notional) AS DECIMAL(38,4)) AS gross_local_notional, CAST(sum(signed_notional_cad) AS DECIMAL(38,4)) AS net_signed_notional_cad,
  count(trade_id) AS active_trade_count"""
NOTIONAL_COLUMNS = """portfolio_id, trade_currency, count(trade_id) AS active_trade_count, CAST(sum(local_notional) AS DECIMAL(38,4)) AS gross_local_notional,
  CAST(sum(notional_cad) AS DECIMAL(38,4)) AS gross_notional_cad, CAST(sum(signed_notional_cad) AS DECIMAL(38,4)) AS net_signed_notional_cad"""
BATCHES = """
first_batch AS (SELECT * FROM ev WHERE "offset" % 100000 <= 2), second_batch AS (SELECT * FROM ev WHERE "offset" % 100000 > 1)"""
# The scenario run: unreadable and incomplete messages, replays of a payload under another event id, inactive portfolios.
_FIELDS = ("trade_id", "event_type", "portfolio_id", "instrument_id", "side", "quantity", "price", "trade_currency")
_LOST = {"event_id": "22, 23", "trade_id": "22, 24", "event_ms": "22, 27", "trade_date": "22, 27"} | {name: "22" for name in _FIELDS if name != "trade_id"}
_REPLACED = ", ".join(f"CASE WHEN k NOT IN ({ks}) THEN {name} END AS {name}" for name, ks in _LOST.items() if name != "event_type")
SCENARIO_MESSAGES = MESSAGES.replace("msg AS (", "plain AS (") + f""",
msg AS (
  SELECT * REPLACE ({_REPLACED}, CASE WHEN k = 22 THEN NULL WHEN k = 25 THEN 0 ELSE event_version END AS event_version,
                    CASE WHEN k = 22 THEN NULL WHEN k = 26 THEN 'BUST' ELSE event_type END AS event_type), k = 22 AS parse_failed FROM plain
  UNION ALL SELECT * REPLACE (event_id || '-R' AS event_id, "offset" + 30000 AS "offset"), false FROM plain WHERE k = 21)"""
SCENARIO_INPUT = (
    SCENARIO_MESSAGES,
    RATES,
    DIMENSIONS.replace("s_acctbal > -900", "s_suppkey % 10 <> 0"),
    ENRICHED.replace("CASE WHEN event_type NOT IN ('NEW', 'AMEND', 'CANCEL') THEN 'INVALID_EVENT_TYPE' END,", """
    CASE WHEN parse_failed THEN 'PAYLOAD_DESERIALIZATION_FAILED' END, CASE WHEN event_id IS NULL THEN 'MISSING_EVENT_ID' END,
    CASE WHEN trade_id IS NULL THEN 'MISSING_TRADE_ID' END, CASE WHEN event_version IS NULL OR event_version <= 0 THEN 'INVALID_EVENT_VERSION' END,
    CASE WHEN event_type IS NULL OR event_type NOT IN ('NEW', 'AMEND', 'CANCEL') THEN 'INVALID_EVENT_TYPE' END,
    CASE WHEN event_ms IS NULL THEN 'MISSING_EVENT_TIMESTAMP' END,"""),
)
STATE = "st AS (SELECT trade_id, event_version AS sv, trade_status AS ss, payload_hash AS sh FROM cur1)"
