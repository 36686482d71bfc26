"""Streams over landed event files. Event time is a TIMESTAMP; state is bounded by watermarks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventlake.plans.stage import keep, shared_dir
from eventlake.plans.versions import VersionedTable

LATE = "8 days"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    if _is_folder(spark, path):
        raw = spark.readStream.schema(schema).parquet(path)
    else:
        top, _, name = path.rpartition("/")
        raw = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(top)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what has landed, into a table of the shared folder, and read it."""
    spark, top = stream.sparkSession, f"{shared_dir(stream.sparkSession).rstrip('/')}/eventlake/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    else:
        # each batch replaces the whole result: the last one stands
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{top}/out")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/out")


def dedup(events: DataFrame) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(["event_id"])


def daily_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def sliding_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.window("ts", "7 days", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


class _ClickDedup(StatefulProcessor):
    """The last kept time of a key; a timer forgets it when the watermark has passed it by the time to live."""

    def __init__(self, gap_ms: int, ttl_ms: int):
        self.gap_ms, self.ttl_ms = gap_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at_ms long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        import pandas as pd

        all_ = pd.concat(list(rows)).sort_values(["at_ms", "event_id"])
        last, kept = self.last.get()[0] if self.last.exists() else None, []
        for t in all_["at_ms"]:
            kept.append(last is None or t - last >= self.gap_ms)
            last = t if kept[-1] else last
        self.last.update((int(last),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(last) + self.ttl_ms)
        yield all_[kept][["key", "event_id", "at_ms"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def click_dedup(events: DataFrame, gap_ms: int, ttl: str = "1 day") -> DataFrame:
    """Per key (user and kind), an event within gap_ms of the last kept one is dropped; the last kept time is the state,
    forgotten by a timer of event time. The state lies in RocksDB, so that keys needn't fit in memory: start the stream
    within `rocks`. A batch's rows of one key are ordered in its task; how many there can be is set by how much a batch reads.
    """
    millis = int(ttl.split()[0]) * 86_400_000
    keyed = events.select(F.concat_ws(":", "user_id", "event_type").alias("key"), "event_id", F.unix_millis("ts").alias("at_ms"), "ts")
    return keyed.groupBy("key").transformWithStateInPandas(_ClickDedup(gap_ms, millis), "key string, event_id long, at_ms long", "append", "eventTime")


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, as keyed state with timers needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def ingest(stream: DataFrame, key: str, target: str) -> None:
    """Landed rows into a table of distinct keys, a batch at a time: rows whose key is there already are dropped, and of a
    batch's rows of one key the first by all columns stays. Each batch writes its own partition anew, so that a batch that
    is run again changes nothing.
    """

    def one(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        new = df.groupBy(key).agg(F.min(F.struct(*(c for c in df.columns if c != key))).alias("_row")).select(key, "_row.*").select(*df.columns)
        if batch:
            try:
                known = spark.read.parquet(target).where(F.col("_batch") < batch).select(key)
                new = new.join(known, key, "left_anti")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
        new.withColumn("_batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(target)

    stream.writeStream.option("checkpointLocation", f"{target}-state").trigger(availableNow=True).foreachBatch(one).start().awaitTermination()


EVENT = "event string, first_seen timestamp, last_seen timestamp, importance long, title string"


def merge_reports(stored: DataFrame, reports: DataFrame) -> DataFrame:
    """Stored events and reports, one row an event: earliest and latest time, greatest importance, the title of the earliest
    report (the smallest, if several). Each is a least or greatest of all, so that order, lateness and repetition of reports
    don't matter."""
    new = reports.select("event", F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.col("importance").cast("long").alias("importance"), "title")
    first = F.min_by("title", F.struct(F.coalesce("first_seen", F.lit("9999-01-01").cast("timestamp")), "title")).alias("title")
    return stored.unionByName(new).groupBy("event").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("importance").alias("importance"), first)


def ingest_reports(stream: DataFrame, target: VersionedTable, keep_if: Column, checkpoint: str) -> None:
    """Landed reports (event, ts, importance, title) into a table of events: each batch is filtered, and merged with the stored
    events of its keys, of which only the buckets are read. What is late is merged as anything else, and what is merged
    again after a crash changes nothing: the table is that of one job over all reports, in whatever order they land."""

    def one(df: DataFrame, batch: int) -> None:
        new = keep(df.where(keep_if & F.col("event").isNotNull()).select("event", "ts", "importance", "title"), "reports")
        if not new.isEmpty():
            target.upsert(new, merge_reports)

    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(one).start().awaitTermination()


def split_late(batch: DataFrame, watermark: Column) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows that came after the watermark had passed them, which `ingest_reports` merges as any others."""
    late = F.coalesce(F.col("ts") < watermark, F.lit(False))
    return batch.where(~late), batch.where(late)
