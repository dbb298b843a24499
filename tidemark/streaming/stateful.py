"""The sequential classifier as two stateful streaming operators: the ids that were met, and each trade's state, in Spark's state store.

Unlike the set-based batches it gives the same outcomes wherever micro-batches end, as long as a trade's messages arrive
in order. Needs the RocksDB provider (``STATE_STORE``).

Both are keyed by a bucket of ids or trades, as a key of its own for each would cost a call of pandas and several round trips to the state
store for every row. A micro-batch reads and writes the state of the buckets that it meets; ids are added in chunks, which are
merged now and then. A stream keeps the number of buckets that it began with.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..model import MESSAGE_KEY
from ..operators.lifecycle import SEQUENTIAL, step

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


_NEEDED = ["event_id", "trade_id", "event_version", "event_type", "payload_hash", *MESSAGE_KEY]
_MARKED = "event_id string, trade_id string, event_version int, event_type string, payload_hash string, topic string, partition int, offset long, known boolean"


BUCKETS = 2048
CHUNKS = 16  # of a bucket's ids, before they are merged


def _packed(value) -> bytes:
    return zlib.compress(json.dumps(value, separators=(",", ":")).encode(), 1)


def _unpacked(data: bytes):
    return json.loads(zlib.decompress(data))


class IdProcessor(StatefulProcessor):
    """Rows of a bucket of event ids; the first of an id (in any batch) is unmarked, the others are marked as known."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.met = handle.getListState("met", "ids binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        same = pd.concat(list(rows)).sort_values(list(MESSAGE_KEY), kind="stable")
        chunks = [_unpacked(bytes(data)) for (data,) in self.met.get()] if self.met.exists() else []
        met = {name for chunk in chunks for name in chunk}
        known = [name in met for name in same["event_id"]] | same["event_id"].duplicated().to_numpy()
        new = same["event_id"][~known].tolist()
        if len(chunks) >= CHUNKS:
            self.met.put([(_packed([*met, *new]),)])
        elif new:
            self.met.appendValue((_packed(new),))
        yield same[_NEEDED].assign(known=known)

    def close(self) -> None:
        pass


class TradeProcessor(StatefulProcessor):
    """Folds the rows of a bucket of trades, each trade for itself."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getValueState("states", "trades binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        trades = pd.concat(list(rows)).sort_values(list(MESSAGE_KEY), kind="stable")
        states = {name: tuple(state) for name, state in _unpacked(bytes(self.states.get()[0])).items()} if self.states.exists() else {}
        decided = []
        for name, version, kind, digest, known in zip(*(trades[c].tolist() for c in ("trade_id", "event_version", "event_type", "payload_hash", "known")), strict=True):
            outcome, reason, state = step((version, kind, digest), states.get(name), known)
            if state is not None:
                states[name] = state
            decided.append((outcome, reason))
        self.states.update((_packed(states),))
        out = trades[["event_id", "trade_id", "event_version"]].copy()
        out["outcome"], out["reason"] = zip(*decided, strict=True)
        yield out

    def close(self) -> None:
        pass


def classify_stream(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Outcomes of a stream of enriched events that have an id, a trade and a version, in order of arrival per trade."""

    def dealt(rows: DataFrame, name: str):
        return rows.withColumn("bucket", F.pmod(F.xxhash64(name), F.lit(buckets)).cast("int")).groupBy("bucket")

    marked = dealt(events.select(*_NEEDED), "event_id").transformWithStateInPandas(IdProcessor(), _MARKED, "Append", "None")
    return dealt(marked, "trade_id").transformWithStateInPandas(TradeProcessor(), SEQUENTIAL, "Append", "None")
