"""One outcome for each message: the set-based classifier, and the sequential one.

The set-based rules see a batch at once. First match wins: unreadable; id seen in an earlier batch; id
repeated in this batch; failed rules; several clean payloads for one version (all of them); repeated payload of a version; the
stored version again, with the same or another payload; a version below what is stored or came before; a step
that the lifecycle doesn't allow; applied.

Plan: one exchange by message key, one by event id (ranks), one by trade (all other windows: version and payload partitions are
refinements of it), and equi-joins with the store. A batch whose ids and keys each belong to one trade needs the one by trade only
(``within_trades``). Rows without an id, a trade or a version are dealt by a hash of their message key, so null keys can't gather in
one task; they only meet rules that need no window. Whether a version has several payloads is
seen by comparing the smallest and largest hash in a window rather than by a join with an aggregate.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import MESSAGE_KEY, OUTCOMES, Outcome, TradeStatus



def _arrival() -> list:
    return [F.col(name) for name in MESSAGE_KEY]


def unseen(batch: DataFrame, ledger: DataFrame | None, within: tuple[str, ...] = ()) -> DataFrame:
    """Messages of the batch whose key the ledger doesn't have; of rows that repeat a key, the first by payload hash.

    ``within``: columns that are the same in all rows of a key, by which the batch may be dealt already.
    """
    rank = F.row_number().over(Window.partitionBy(*within, *MESSAGE_KEY).orderBy("payload_hash", "event_id"))
    once = batch.withColumn("__copy", rank).where(F.col("__copy") == 1).drop("__copy")
    return once if ledger is None else once.join(ledger.select(*MESSAGE_KEY), list(MESSAGE_KEY), "left_anti")


_RULED = (*MESSAGE_KEY, "event_id", "trade_id", "event_version", "event_type", "payload_hash", "parse_failed")  # columns that the rules read
#: What a decision rests on; ``classify`` can return it. The first two are known for every row.
EVIDENCE = ("event_id_seen", "event_id_rank", "payload_rank", "conflict", "prior_max", "prior_new", "prior_cancel")


def classify(
    batch: DataFrame,
    ledger: DataFrame | None = None,
    current: DataFrame | None = None,
    strict: bool = False,
    evidence: tuple[str, ...] = (),
    keys: DataFrame | None = None,
    within_trades: bool = False,
    dealt: str = "trade_id",
    packed: bool = False,
) -> DataFrame:
    """``batch`` with ``outcome`` and ``outcome_reason``. ``strict``: a cancel that is stale itself doesn't end a trade.

    ``ledger``: outcomes of earlier batches; ``current``: the state they led to; ``evidence``: columns of ``EVIDENCE`` to return;
    ``keys``: the part of the ledger whose message keys can be in the batch, if that is known; ``within_trades``: the source
    vouches that no event id and no message key of the batch is met in two trades, so that a batch which is dealt by trade
    isn't dealt again; ``dealt``: the column that it is dealt by, the same in all rows of a trade; ``packed``: columns that no rule
    needs go through the windows as one struct, which is copied at once (for callers that want nearly all columns).
    """
    columns, carried = batch.columns, []
    batch = batch.withColumn("__clean", F.size("failed_rules") == 0)
    if packed:
        carried = [name for name in columns if name not in (*_RULED, dealt)]
        batch = batch.select(*(name for name in batch.columns if name not in carried), F.struct(*carried).alias("__carried"))
    within = (dealt,) if within_trades else ()
    rows = unseen(batch, ledger if keys is None else keys, within)
    if ledger is None:
        rows = rows.withColumn("event_id_seen", F.lit(False))
    else:
        ids = ledger.where("event_id is not null").select("event_id").distinct().withColumn("event_id_seen", F.lit(True))
        rows = rows.join(ids, "event_id", "left").withColumn("event_id_seen", F.coalesce("event_id_seen", F.lit(False)))
    nobody = F.lit(None)
    if current is None:
        rows = rows.withColumns({"stored_version": nobody.cast("int"), "stored_status": nobody.cast("string"), "stored_hash": nobody.cast("string")})
    else:
        state = current.select("trade_id", F.col("current_version").alias("stored_version"), F.col("trade_status").alias("stored_status"), F.col("payload_hash").alias("stored_hash"))
        rows = rows.join(state, "trade_id", "left")

    # A row without an id, or without a trade or version, is a partition of its own in the windows.
    alone = F.xxhash64(*MESSAGE_KEY)
    rows = rows.withColumn("__no_id", F.when(F.col("event_id").isNull(), alone))
    by_id = Window.partitionBy(*within, "event_id", "__no_id").orderBy(*_arrival())
    keyed = F.col("trade_id").isNotNull() & F.col("event_version").isNotNull()
    ranked = rows.withColumns({"event_id_rank": F.when(F.col("event_id").isNull(), 1).otherwise(F.row_number().over(by_id)), "__loose": F.when(~keyed, alone)})
    trade = (*(name for name in within if name != "trade_id"), "trade_id", "__loose")
    if not within_trades:  # dealt by trade once: that serves the windows by version and payload too, which would else each deal anew
        ranked = ranked.repartition(*trade)

    clean = F.col("__clean")
    version = Window.partitionBy(*trade, "event_version")
    payload = Window.partitionBy(*trade, "event_version", "payload_hash").orderBy(*_arrival())
    before = Window.partitionBy(*trade).orderBy(*_arrival()).rowsBetween(Window.unboundedPreceding, -1)
    clean_hash = F.when(clean, F.col("payload_hash"))
    rows = ranked.withColumn("payload_rank", F.row_number().over(payload)).withColumn(
        "conflict", clean & F.coalesce(F.min(clean_hash).over(version) != F.max(clean_hash).over(version), F.lit(False))
    )
    eligible = ~F.col("parse_failed") & clean & ~F.col("event_id_seen") & (F.col("event_id_rank") == 1) & ~F.col("conflict") & (F.col("payload_rank") == 1)
    rows = rows.withColumn("__version", F.when(eligible, F.col("event_version")))
    prior_max = F.max("__version").over(before)
    if strict:
        rows = rows.withColumn("prior_max", prior_max)
        prior_max = F.col("prior_max")
    opens = (F.col("event_type") == "NEW") & (F.col("event_version") == 1)
    prior_new = F.coalesce(F.max(F.when(F.col("__version").isNotNull() & opens, 1)).over(before), F.lit(0))
    floor = F.greatest(F.coalesce("stored_version", F.lit(0)), F.coalesce("prior_max", F.lit(0)))
    cancels = F.col("event_type") == "CANCEL"
    if strict:
        cancels &= F.col("event_version") >= floor
    prior_cancel = F.min(F.when(cancels, F.col("__version"))).over(before)
    rows = rows.withColumns({"prior_max": prior_max, "prior_new": prior_new, "prior_cancel": prior_cancel})  # in one window

    is_new = F.col("event_type") == "NEW"
    first_step = F.when(is_new, (F.col("event_version") == 1) & (F.col("prior_new") == 0)).otherwise(F.col("prior_new") == 1)
    allowed = (
        F.when(F.col("stored_status") == "CANCELLED", False).when(F.col("stored_version").isNull(), first_step).otherwise(~is_new)
        & F.col("prior_cancel").isNull()
    )
    at_stored = F.col("event_version") == F.col("stored_version")
    always = [
        (F.col("parse_failed"), Outcome.QUARANTINED, F.lit("PAYLOAD_DESERIALIZATION_FAILED")),
        (F.col("event_id_seen"), Outcome.DUPLICATE, F.lit("DUPLICATE_EVENT_ID")),
        (F.col("event_id_rank") > 1, Outcome.DUPLICATE, F.lit("DUPLICATE_EVENT_ID_IN_BATCH")),
        (~clean, Outcome.QUARANTINED, F.col("failure_reason")),
    ]
    windowed = [
        (F.col("conflict"), Outcome.VERSION_CONFLICT, F.lit("CONFLICTING_TRADE_VERSION")),
        (F.col("payload_rank") > 1, Outcome.DUPLICATE, F.lit("REPLAYED_TRADE_VERSION")),
        (at_stored & (F.col("payload_hash") == F.col("stored_hash")), Outcome.DUPLICATE, F.lit("EXISTING_TRADE_VERSION")),
        (at_stored, Outcome.VERSION_CONFLICT, F.lit("EXISTING_TRADE_VERSION")),
        (F.col("event_version") < floor, Outcome.STALE_VERSION, F.lit("LOWER_THAN_APPLIED_VERSION")),
        (~allowed, Outcome.QUARANTINED, F.lit("INVALID_LIFECYCLE_TRANSITION")),
        (F.lit(True), Outcome.APPLIED, F.lit("ACCEPTED_HIGHER_VERSION")),
    ]

    outcome, reason = F, F
    if carried:
        rows = rows.withColumns({name: F.col(f"__carried.{name}") for name in carried})
    for condition, name, why in always + [(keyed & condition, name, why) for condition, name, why in windowed]:
        outcome, reason = outcome.when(condition, str(name)), reason.when(condition, why)
    shown = (F.col(name) if name in EVIDENCE[:2] else F.when(keyed, F.col(name)).alias(name) for name in evidence)
    return rows.select(*columns, outcome.alias("outcome"), reason.alias("outcome_reason"), *shown)


def ledger_rows(classified: DataFrame, stream_id: str, batch_id: int) -> DataFrame:
    """Classified messages in the ledger's shape."""
    reason = F.col("outcome_reason")
    return classified.withColumns(
        {
            "failure_reason": reason,
            "failed_rules": F.when(F.size("failed_rules") > 0, F.col("failed_rules")).otherwise(F.array(reason)),
            "processed_at": F.current_timestamp(),
            "stream_id": F.lit(stream_id),
            "batch_id": F.lit(batch_id).cast("long"),
        }
    ).select(*OUTCOMES.fieldNames())


def latest_per(frame: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is largest by the columns of ``order``, the first one deciding first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*map(F.desc, order)))
    return frame.withColumn("__rank", rank).where(F.col("__rank") == 1).drop("__rank")


LATEST = ("event_version", "event_ts", "offset", "partition", "topic")  # the row of a trade that is largest by these is its state


def latest_per_trade(applied: DataFrame) -> DataFrame:
    """The row of each trade with the highest version (then latest event, then last offset)."""
    return latest_per(applied, "trade_id", *LATEST)


def mark_latest(classified: DataFrame, name: str) -> DataFrame:
    """The rows with a boolean: whether ``latest_per_trade`` of the applied ones would return it. Needs no exchange where rows lie by trade."""
    applied = F.coalesce(F.col("outcome") == str(Outcome.APPLIED), F.lit(False))
    marked = classified.withColumn("__applied", applied)
    rank = F.row_number().over(Window.partitionBy("trade_id", "__applied").orderBy(*map(F.desc, LATEST)))
    return marked.withColumn(name, F.col("__applied") & (rank == 1)).drop("__applied")


def trade_status(event_type: Column) -> Column:
    return F.when(event_type == "CANCEL", str(TradeStatus.CANCELLED)).otherwise(str(TradeStatus.BOOKED))


# The sequential classifier: a fold over one trade's events in arrival order, with no notion of batches.

SEQUENTIAL = "event_id string, trade_id string, event_version int, outcome string, reason string"


def step(event: tuple, state: tuple | None, known: bool) -> tuple[str, str, tuple | None]:
    """Outcome, reason and new state for a (version, type, hash) of a trade; state is (version, status, hash).

    ``known``: the event's id came before, in whatever trade and with whatever outcome.
    """
    version, kind, digest = event
    if known:
        return Outcome.DUPLICATE.value, "DUPLICATE_EVENT_ID", state
    if state is None:
        if kind != "NEW" or version != 1:
            return Outcome.QUARANTINED.value, "LIFECYCLE_MUST_START_WITH_NEW_VERSION_1", None
    elif version is None:
        return Outcome.QUARANTINED.value, "INVALID_EVENT_VERSION", state
    elif version < state[0]:
        return Outcome.STALE_VERSION.value, "LOWER_THAN_CURRENT_VERSION", state
    elif version == state[0]:
        if digest == state[2]:
            return Outcome.DUPLICATE.value, "REPLAYED_TRADE_VERSION", state
        return Outcome.VERSION_CONFLICT.value, "CONFLICTING_TRADE_VERSION", state
    elif state[1] == TradeStatus.CANCELLED.value:
        return Outcome.QUARANTINED.value, "EVENT_AFTER_CANCEL", state
    elif kind == "NEW":
        return Outcome.QUARANTINED.value, "NEW_FOR_EXISTING_TRADE", state
    status = TradeStatus.CANCELLED if kind == "CANCEL" else TradeStatus.BOOKED
    return Outcome.APPLIED.value, "ACCEPTED_HIGHER_VERSION", (version, status.value, digest)


def fold_events(events: Iterable[tuple], state: tuple | None = None, seen=None) -> Iterator[tuple]:
    """``(outcome, reason, state)`` after each (event_id, version, type, hash) of one trade. ``seen`` is asked for each id and gets it."""
    seen = set() if seen is None else seen
    for event_id, *event in events:
        known = event_id in seen
        seen.add(event_id)
        outcome, reason, state = step(tuple(event), state, known)
        yield outcome, reason, state


def classify_in_order(events: DataFrame) -> DataFrame:
    """The fold over every trade's events in order of arrival; an id that came before in any trade makes a duplicate.

    Ids are ranked by arrival first (one exchange by id), then trades are sorted by arrival inside their partitions and folded as they
    stream by: a task holds one trade's state at a time. A missing id repeats none; an event without a trade has no lifecycle
    and is quarantined where it is. Neither gathers in one task.
    """
    names = ["event_id", "trade_id", "event_version", "event_type", "payload_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trade, state = object(), None
        for batch in batches:
            decided = []
            for trade_id, version, kind, digest, known in zip(*(batch.column(k).to_pylist() for k in range(1, 6)), strict=True):
                if trade_id != trade:
                    trade, state = trade_id, None
                outcome, reason, state = step((version, kind, digest), state, known)
                decided.append((outcome, reason))
            outcomes, reasons = zip(*decided, strict=True) if decided else ((), ())
            added = [pa.array(outcomes, type=pa.string()), pa.array(reasons, type=pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *added], ["event_id", "trade_id", "event_version", "outcome", "reason"])

    rows = events.select(*names, *MESSAGE_KEY)
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(*_arrival()))
    ranked = rows.where("event_id is not null").withColumn("known", rank > 1).unionByName(rows.where("event_id is null").withColumn("known", F.lit(False)))
    ordered = ranked.where("trade_id is not null").repartition("trade_id").sortWithinPartitions("trade_id", *MESSAGE_KEY)
    folded = ordered.select(*names, "known").mapInArrow(run, SEQUENTIAL)
    outcome = F.when(F.col("known"), str(Outcome.DUPLICATE)).otherwise(str(Outcome.QUARANTINED))
    reason = F.when(F.col("known"), "DUPLICATE_EVENT_ID").otherwise("MISSING_TRADE_ID")
    loose = ranked.where("trade_id is null").select("event_id", "trade_id", "event_version", outcome.alias("outcome"), reason.alias("reason"))
    return folded.unionByName(loose)
