"""Streams over files, run to the end of what is there."""

from datetime import datetime

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from plumbline.operators.quality import dedupe
from plumbline.sources import publish as P
from plumbline.streaming import streams as L


def source(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    events.withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_mapping_keeps_every_row(spark, folder, tmp_path):
    events, stream = source(spark, folder, tmp_path)
    lookup = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey")
    out = run(L.stream_mapping(stream, lookup, F.expr("user_id = c_custkey"), F.expr("value > 100")), tmp_path, "mapped")
    assert out.count() == events.count()


def test_late_rows_are_routed_not_lost(spark, folder, tmp_path):
    events, stream = source(spark, folder, tmp_path)
    own = stream.withColumn("processed_at", F.expr("ts + make_dt_interval(0, cast(event_id % 9 as int))"))
    out = run(L.stream_route_late(own, "ts", "processed_at", 2, 2, "BACKFILL"), tmp_path, "routed")
    assert out.count() == events.count() and out.where("route = 'BACKFILL'").count() > 0


def test_dedupe(spark, folder, tmp_path):
    events, stream = source(spark, folder, tmp_path)
    assert run(L.stream_dedupe(stream, "event_id", "ts", "60 days"), tmp_path, "once").count() == dedupe(events, ["event_id"], ["ts"]).count()


def test_epochs(spark, folder, tmp_path):
    events, stream = source(spark, folder, tmp_path)
    out = run(L.stream_epochs(stream, "ts", "1 day", "60 days"), tmp_path, "epochs", "complete")
    assert out.agg(F.sum("n")).first()[0] == events.count()


def test_status_matches_batch(spark, folder, tmp_path):
    events, stream = source(spark, folder, tmp_path)
    out = run(L.stream_status(stream, "user_id", "view", "purchase"), tmp_path, "status", "update")
    views = {r.user_id: r.n for r in events.where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    last = {r.user_id: r.m for r in out.groupBy("user_id").agg(F.max("iterations").alias("m")).collect()}
    assert all(last[u] == n for u, n in views.items())


def test_accumulate_and_volume(spark, folder, tmp_path):
    events, stream = source(spark, folder, tmp_path)
    seen = []
    q = stream.writeStream.foreachBatch(L.stream_volume(1, 10_000, lambda df: seen.extend(df.collect()))).option("checkpointLocation", str(tmp_path / "v")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.n for r in seen) == events.count()
    kept = []
    base = events.limit(10)
    L.accumulate_late(lambda: base, lambda df: kept.append(df.count()), ["event_id"])(events.limit(20), 0)
    assert kept[0] >= 20


def batches(spark, tmp_path, parts, schema):
    """A stream of the given lists of rows, one a batch."""
    at = str(tmp_path / "parts")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(at)


def to_end(df, step, at, mode="append"):
    q = df.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


@pytest.mark.parametrize("limits,good", [({"absolute": 0}, 100), ({"share": 0.01}, 100), ({"share": 0.02}, 298)])
def test_a_batch_beyond_the_threshold_is_not_committed(spark, tmp_path, limits, good):
    parts = [[(i, 1.0) for i in range(100)], [(i, -1.0 if i % 50 == 0 else 1.0) for i in range(100, 200)], [(i, 1.0) for i in range(200, 300)]]
    stream, out = batches(spark, tmp_path, parts, "id long, v double"), str(tmp_path / "out")
    step = L.threshold_sink(F.col("v") > 0, out, **limits)
    if good == 100:
        with pytest.raises(StreamingQueryException, match="batch 1: 2 of 100 rows fail"):
            to_end(stream, step, str(tmp_path / "c"))
    else:
        to_end(stream, step, str(tmp_path / "c"))
    ok, bad = L.committed(spark, out, stream.schema)
    assert ok.count() == good and bad.count() == (2 if good > 100 else 0)
    if good == 100:  # once the rule is mended, the stream goes on where it stopped
        to_end(stream, L.threshold_sink(F.col("v") > -2, out, **limits), str(tmp_path / "c"))
        assert L.committed(spark, out, stream.schema)[0].count() == 300


def test_a_replayed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "sums")
    step = L.accumulate_once(at, ["k"])
    one, two = (spark.createDataFrame(rows, "k string, v long") for rows in ([("a", 1), ("b", 2)], [("b", 3), ("c", 4)]))
    step(one, 0)
    step(two, 1)
    step(two.withColumn("v", F.lit(99).cast("long")), 1)
    step(one, 0)
    rows = {r.k: r.v for r in P.read_published(spark, at).collect()}
    assert rows == {"a": 1, "b": 3, "c": 4}
    monkeypatch.setattr(P, "point", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        step(one, 2)
    monkeypatch.undo()
    assert {r.k: r.v for r in P.read_published(spark, at).collect()} == rows
    step(one, 2)
    assert {r.k: r.v for r in P.read_published(spark, at).collect()} == {"a": 1, "b": 2, "c": 4}


def test_status_expires(spark, tmp_path):
    day = lambda d, h=0: datetime(2024, 1, d, h)
    parts = [[(1, day(1), 1, "view"), (2, day(1, 1), 1, "purchase"), (3, day(1), 2, "view")], [(4, day(3), 2, "view")], [(5, day(9), 3, "click")], [(6, day(9, 1), 2, "purchase")]]
    stream = batches(spark, tmp_path, parts, "event_id long, ts timestamp, user_id long, event_type string")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", L.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        seen = []
        to_end(L.stream_status_ttl(stream, "user_id", "view", "purchase", 4 * 86_400), lambda df, n: seen.extend((n, *r) for r in df.collect()), str(tmp_path / "c"), "update")
        held = spark.read.format("statestore").option("stateVarName", "status").load(str(tmp_path / "c"))
        keys = {r.key.user_id for r in held.collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    last = {}
    for _, user, n, status in sorted(seen, key=lambda r: r[0]):
        last.setdefault(user, []).append((n, status))
    assert last[1] == [(1, "CONVERGED"), (1, "EXPIRED")]
    assert last[2][:3] == [(1, "IN_PROGRESS"), (2, "IN_PROGRESS"), (2, "EXPIRED")] and last[2][3:] == [(0, "NOT_STARTED")]
    assert 1 not in keys and 3 in keys


class Store:
    """Counts the trips to a state store."""

    def __init__(self):
        self.value, self.trips, self.timers = None, 0, []

    def get(self):
        self.trips += 1
        return self.value

    def exists(self):
        self.trips += 1
        return self.value is not None

    def update(self, value):
        self.trips += 1
        self.value = value

    def registerTimer(self, at):
        self.trips += 1
        self.timers.append(at)


def test_few_trips_to_the_store_for_a_key():
    step, store = L.Status("k", "view", "purchase", 100), Store()
    step.state = step.handle = store
    for at, kind in enumerate(["view", "purchase", "view"]):
        rows = [L.Row(ts=at, event_id=at, event_type=kind, at_ms=at)]
        out = list(step.handleInputRows((7,), iter(rows), None))
    assert (out[0].k, out[0].iterations, out[0].status) == (7, 2, "IN_PROGRESS")
    assert store.timers == [100] and store.trips == 7  # a reading and a writing a batch, and one timer
