from __future__ import annotations

from tidemark.streaming import stateful

from test_lifecycle import MATRIX, batch, outcomes_in_order, steps


def test_outcomes_don_t_depend_on_batches(spark, tmp_path):
    for key, value in stateful.STATE_STORE.items():
        spark.conf.set(key, value)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    other = steps("AMEND2", "NEW1", "AMEND3", "CANCEL2", "AMEND4")
    events = [(f"X{e}", v, t, h) for e, v, t, h in other]
    cuts = [(0, 2), (2, 3), (3, 7)]
    for a, b in cuts:
        batch(spark, MATRIX[a:b], start=a).unionByName(batch(spark, events[a:b], trade="T2", start=a)).coalesce(1).write.mode("append").parquet(source)
        stream = stateful.classify_stream(spark.readStream.schema(batch(spark, MATRIX).schema).parquet(source))
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(sink)
        query.awaitTermination()
    found = spark.read.parquet(sink).collect()
    for trade, rows in (("T1", MATRIX), ("T2", events)):
        expected = sorted(zip((e for e, *_ in rows), outcomes_in_order(rows), strict=True))
        assert sorted((r["event_id"], r["outcome"]) for r in found if r["trade_id"] == trade) == expected


def test_a_few_buckets_hold_many_ids_over_many_batches(spark, tmp_path):
    """Ids are met again in other trades and later batches, in buckets whose chunks are merged meanwhile."""
    for key, value in stateful.STATE_STORE.items():
        spark.conf.set(key, value)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = batch(spark, MATRIX).schema
    ids = {}
    for n in range(stateful.CHUNKS + 3):
        rows = [(f"E{n}-{k}", 1, "NEW", "a") for k in range(4)] + [(f"E{n - 1}-0", 2, "AMEND", "b"), (f"E{0}-1", 2, "AMEND", "c")]
        frames = [batch(spark, [row], trade=f"T{n}-{k}", start=n * 10 + k) for k, row in enumerate(rows)]
        for frame in frames[1:]:
            frames[0] = frames[0].unionByName(frame)
        frames[0].coalesce(1).write.mode("append").parquet(source)
        for k, (name, *_) in enumerate(rows):
            ids.setdefault(name, []).append(f"T{n}-{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = stateful.classify_stream(stream, buckets=2).writeStream.format("parquet").outputMode("append")
    writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(sink).awaitTermination()
    found = {(r["event_id"], r["trade_id"]): r["reason"] for r in spark.read.parquet(sink).collect()}
    assert len(found) == 6 * (stateful.CHUNKS + 3)
    for name, trades in ids.items():
        assert [found[name, trade] == "DUPLICATE_EVENT_ID" for trade in trades] == [False] + [True] * (len(trades) - 1)
