"""Streams: mappings, epochs with watermarks, loss-free late routing, deduplication, bursts and keyed status."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.quality import mark_late, route_late, volume_check
from ..sources import publish as P
from ..sources.tables import merge_upsert


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp; the session runs in UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_mapping(stream: DataFrame, lookup: DataFrame, on: Column, rule: Column) -> DataFrame:
    """Enrich by a static lookup and mark rows that fail the rule; nothing is dropped."""
    return stream.join(lookup, on, "left").withColumn("valid", F.coalesce(rule, F.lit(False)))


def stream_epochs(stream: DataFrame, ts: str, width: str, watermark: str) -> DataFrame:
    own = event_time(stream, ts).withWatermark(ts, watermark)
    return own.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("epoch_start"), "event_type", "n", "total")


def stream_route_late(stream: DataFrame, event: str, processing: str, close_hours: int, watermark_hours: int, strategy: str) -> DataFrame:
    """Late rows are decided by a column, before any stateful step, so that none is lost silently."""
    return route_late(mark_late(stream, event, processing, close_hours, watermark_hours), strategy, processing)


def accumulate_late(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges a batch into the target by key."""

    def step(batch: DataFrame, _: int) -> None:
        write(merge_upsert(read(), batch, keys))

    return step


def stream_dedupe(stream: DataFrame, key: str, ts: str, watermark: str) -> DataFrame:
    return event_time(stream, ts).withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


def bursts(df: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Events of one key closer than the gap become one; batch or stream (with a watermark)."""
    return df.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("begun"), F.col("w.end").alias("ended"), "n")


def stream_volume(low: int, high: int, write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that reports each source's volume in a batch against its bounds."""

    def step(batch: DataFrame, number: int) -> None:
        status = F.when(F.col("n") < low, "LOW").when(F.col("n") > high, "HIGH").otherwise("OK")
        write(batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("status", status).withColumn("batch", F.lit(number)))

    return step


def stream_status(stream: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Status of each key, kept between batches: iterations, and converged once ``end`` follows a ``start``."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, done = state.get if state.exists else (0, False)
        for pdf in batches:
            for kind in pdf.sort_values(["ts", "event_id"])["event_type"]:
                if kind == start:
                    n, done = n + 1, False
                elif kind == end and n:
                    done = True
        state.update((n, done))
        yield pd.DataFrame({key: [k[0]], "iterations": [n], "status": ["CONVERGED" if done else "IN_PROGRESS" if n else "NOT_STARTED"]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, iterations long, status string", "n long, done boolean", "update", GroupStateTimeout.NoTimeout)


class BatchHalted(RuntimeError):
    """A batch with more failures than allowed; its rows are not committed, and the stream stops."""


def halts(failed: int, total: int, absolute: int | None, share: float | None) -> bool:
    """Beyond a count or a share; exactly at it goes on, and an empty batch passes. Zero tolerance is ``absolute=0``."""
    return (absolute is not None and failed > absolute) or (share is not None and total > 0 and failed / total > share)


def threshold_sink(rule: Column, path: str, absolute: int | None = None, share: float | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that commits a batch, or stops the stream if too many of its rows fail the rule.

    The rows are counted while they are written to a staging folder, in the same pass. A batch within the threshold is
    committed by one rename, its good rows and, beside them, its failures; a replayed batch replaces itself. A batch beyond
    it stays uncommitted, and so does the stream's checkpoint.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark, seen, staging = batch.sparkSession, Observation(), f"{path}/_staging/batch={number}"
        flagged = batch.withColumn("ok", F.coalesce(rule, F.lit(False)))
        watched = flagged.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(~F.col("ok")).alias("failed"))
        watched.write.mode("overwrite").partitionBy("ok").parquet(staging)
        total, failed = seen.get["total"], seen.get["failed"]
        if halts(failed, total, absolute, share):
            raise BatchHalted(f"batch {number}: {failed} of {total} rows fail")
        P.moved(spark, staging, f"{path}/batch={number}")

    return step


def committed(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows and failures of all committed batches of a ``threshold_sink``."""
    fields = [*[f for f in schema.fields if f.name not in ("ok", "batch")], T.StructField("batch", T.LongType()), T.StructField("ok", T.BooleanType())]
    rows = spark.read.schema(T.StructType(fields)).option("basePath", path).parquet(path)
    return rows.where("ok").drop("ok"), rows.where("not ok").drop("ok")


def accumulate_once(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each batch into a published table exactly once.

    The number of the last batch is written with the version that holds it, by the same rename, so a batch that is given
    again after a failure changes nothing, wherever the failure was. Use one path for one stream.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = P.current(spark, path)
        if now is not None and now["mark"] >= number:
            return
        P.publish(batch if now is None else merge_upsert(P.read_published(spark, path), batch, keys), path, number)

    return step


def volume_by_batch(low: int, high: int, path: str) -> Callable[[DataFrame, int], None]:
    """``stream_volume`` with the statuses of ``volume_check``, written to a folder a batch; a replayed batch replaces itself."""

    def step(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
        volume_check(counts, low, high).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return step


class Status(StatefulProcessor):
    """Iterations and status of a key in a state store; the key leaves it when event time has passed its last event by ``ttl_ms``."""

    def __init__(self, key: str, start: str, end: str, ttl_ms: int):
        self.key, self.start, self.end, self.ttl_ms = key, start, end, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("status", "n long, done boolean, last long")

    def row(self, key: tuple, n: int, status: str) -> Row:
        return Row(**{self.key: key[0], "iterations": n, "status": status})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get()  # each call is a trip to the store and back, so one call serves for all fields
        n, done, last = held or (0, False, None)
        for _, _, kind, ms in sorted((r.ts, r.event_id, r.event_type, r.at_ms) for r in rows):
            if last is not None and ms > last + self.ttl_ms:  # the watermark has not come so far, but the key has
                yield self.row(key, n, "EXPIRED")
                n, done = 0, False
            if kind == self.start:
                n, done = n + 1, False
            elif kind == self.end and n:
                done = True
            last = max(last or 0, ms)
        self.state.update((n, done, last))
        if held is None:
            self.handle.registerTimer(last + self.ttl_ms)
        yield self.row(key, n, "CONVERGED" if done else "IN_PROGRESS" if n else "NOT_STARTED")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """A key has one timer, of its first event; where later ones have come, it is set anew for the last of them."""
        n, _, last = self.state.get()
        if last + self.ttl_ms > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(last + self.ttl_ms)
        else:
            self.state.clear()
            yield self.row(key, n, "EXPIRED")

    def close(self) -> None:
        pass


#: State of keys is kept in this store, on disk, not in the heap.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_status_ttl(stream: DataFrame, key: str, start: str, end: str, ttl_seconds: int, watermark: str = "0 seconds") -> DataFrame:
    """``stream_status`` with keys that expire: ``ttl_seconds`` of event time after a key's last event its state is removed
    and a row EXPIRED given. The session must use the RocksDB store (``ROCKSDB``)."""
    own = event_time(stream).withColumn("at_ms", F.unix_millis("ts")).withWatermark("ts", watermark)
    kind = T.StructType([stream.schema[key], T.StructField("iterations", T.LongType()), T.StructField("status", T.StringType())])
    return own.select(key, "ts", "event_id", "event_type", "at_ms").groupBy(key).transformWithState(Status(key, start, end, ttl_seconds * 1000), kind, "Update", "eventTime")
