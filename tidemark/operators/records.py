"""Single records in plain Python: the rules, the payload's identity and the lifecycle, for producers and small tools.

The row validator knows sets of ids instead of dimensions, so it has one code for an unknown and for an inactive portfolio, and none
for an inactive instrument or a currency mismatch. Empty text counts as missing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Collection, Iterable, Mapping
from decimal import Decimal, InvalidOperation
from typing import Any, NamedTuple

from ..model import PAYLOAD_FIELDS, EventType, Side, BookingEvent
from .lifecycle import fold_events


class Decision(NamedTuple):
    event_id: str
    trade_id: str
    event_version: int
    outcome: str
    reason: str


class State(NamedTuple):
    version: int
    status: str
    payload: str


def record_hash(record: Mapping[str, Any]) -> str:
    """SHA-256 of the payload fields as compact JSON with sorted keys."""
    payload = {name: record.get(name) for name in PAYLOAD_FIELDS}
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def _positive(value: Any) -> bool:
    return isinstance(value, int) and value > 0


def _positive_decimal(value: Any) -> bool:
    try:
        return Decimal(str(value)) > 0
    except InvalidOperation:
        return False


def failed_rules(
    record: Mapping[str, Any], instruments: Collection[str], portfolios: Collection[str], currencies: Collection[str]
) -> tuple[str, ...]:
    """Codes of all the rules that a record breaks, in the order of reporting."""
    get = record.get
    checks = {
        "MISSING_EVENT_ID": bool(get("event_id")),
        "MISSING_TRADE_ID": bool(get("trade_id")),
        "INVALID_EVENT_VERSION": _positive(get("event_version")),
        "INVALID_EVENT_TYPE": get("event_type") in set(EventType),
        "MISSING_EVENT_TIMESTAMP": bool(get("event_ts")),
        "INVALID_SIDE": get("side") in set(Side),
        "INVALID_QUANTITY": _positive(get("quantity")),
        "INVALID_PRICE": _positive_decimal(get("price")),
        "UNKNOWN_INSTRUMENT": get("instrument_id") in instruments,
        "UNKNOWN_OR_INACTIVE_PORTFOLIO": get("portfolio_id") in portfolios,
        "MISSING_FX_RATE": get("trade_currency") in currencies,
    }
    return tuple(code for code, good in checks.items() if not good)


def classify_events(
    events: Iterable[BookingEvent], states: Mapping[str, State] | None = None, seen: Collection[str] = ()
) -> tuple[list[Decision], dict[str, State]]:
    """Outcomes of events of any trades in order of arrival, and the states that they lead to."""
    states, ids = dict(states or {}), set(seen)
    decisions = []
    for event in events:
        item = event.event_id, event.event_version, event.event_type, record_hash(event.as_record())
        outcome, reason, state = next(fold_events([item], states.get(event.trade_id), ids))
        if state is not None:
            states[event.trade_id] = State(*state)
        decisions.append(Decision(event.event_id, event.trade_id, event.event_version, outcome, reason))
    return decisions, states
