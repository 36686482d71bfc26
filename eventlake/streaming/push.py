"""Deciding what to push: per event a small state machine over polled feeds, caps per run and day, and forgetting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window as W

TERMINAL = ("sent", "attempted", "failed")
STATE = "event_id string, importance int, recommended boolean, status string, last_seen timestamp, attempted timestamp"


def baseline(feed: DataFrame, now: Column) -> DataFrame:
    """The state after the first run: everything has been seen, nothing is pushed."""
    return feed.select("event_id", F.col("importance").cast("int").alias("importance"), "recommended", F.lit("seen").alias("status"), now.alias("last_seen"), F.lit(None).cast("timestamp").alias("attempted"))


def advance(state: DataFrame, feed: DataFrame, now: Column, max_age_hours: int = 48) -> DataFrame:
    """The state after a poll. What was sent, attempted or failed stays so. An event that becomes recommended is pending
    while it is young enough, else expired; one that isn't recommended any more is only seen. Events that the feed doesn't
    hold keep their state.

    feed: event_id, importance, recommended, discovered.
    """
    old = state.select("event_id", *(F.col(c).alias(f"_{c}") for c in ("importance", "recommended", "status", "last_seen", "attempted")))
    j = feed.withColumn("_now", F.lit(True)).join(old, "event_id", "full_outer")
    status = F.coalesce("_status", F.lit("seen"))
    rec = F.coalesce("recommended", F.lit(False))
    newly = rec & ~F.coalesce("_recommended", F.lit(False))
    young = F.coalesce(F.col("discovered").between(now - F.expr(f"INTERVAL {max_age_hours} HOURS"), now), F.lit(False))
    nxt = (
        F.when(F.col("_now").isNull(), status).when(status.isin(*TERMINAL), status).when(rec & (status == "pending"), "pending")
        .when(newly & young, "pending").when(newly, "expired").when(~rec & (status == "pending"), "seen").otherwise(status)
    )
    there = F.col("_now").isNotNull()
    return j.select(
        "event_id", F.when(there, F.col("importance").cast("int")).otherwise(F.col("_importance")).alias("importance"), F.when(there, rec).otherwise(F.col("_recommended")).alias("recommended"),
        nxt.alias("status"), F.when(there, now).otherwise(F.col("_last_seen")).alias("last_seen"), F.col("_attempted").alias("attempted"),
    )


TRANSITIONS = "event_id string, at timestamp, status string, importance int, recommended boolean"


class _PushMachine(StatefulProcessor):
    """One event's state. Rows: polled, baseline, importance, recommended, discovered, and outcome (attempted, sent or failed)
    for what became of a push. A timer turns pending into expired when the event is too old, without a poll."""

    def __init__(self, max_age_ms: int):
        self.max_age_ms = max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "status string, recommended boolean, importance int")

    def _timer(self, at_ms: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at_ms is not None:
            self.handle.registerTimer(at_ms)

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        import pandas as pd

        status, was, importance = self.state.get() if self.state.exists() else ("seen", False, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("polled", kind="stable").itertuples():
            before = status if out or self.state.exists() else None
            if isinstance(r.outcome, str):
                if (r.outcome == "attempted" and status == "pending") or (r.outcome in ("sent", "failed") and status == "attempted"):
                    status = r.outcome
            else:
                rec, importance = bool(r.recommended), int(r.importance or 0)
                young = pd.notna(r.discovered) and 0 <= (r.polled - r.discovered) / pd.Timedelta(milliseconds=1) <= self.max_age_ms
                if r.baseline:
                    status = status if before else "seen"
                elif status in TERMINAL or (rec and status == "pending"):
                    pass
                elif rec and not was:
                    status = "pending" if young else "expired"
                elif not rec and status == "pending":
                    status = "seen"
                if status == "pending" and young:
                    self._timer(int(r.discovered.timestamp() * 1000) + self.max_age_ms + 1)
                was = rec
            if status != before:
                out.append((key[0], r.polled, status, importance, was))
        if status != "pending":
            self._timer(None)
        self.state.update((status, was, importance))
        yield pd.DataFrame(out, columns=["event_id", "at", "status", "importance", "recommended"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        import pandas as pd

        status, was, importance = self.state.get()
        if status == "pending":
            self.state.update(("expired", was, importance))
            yield pd.DataFrame([(key[0], pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), "expired", importance, was)], columns=["event_id", "at", "status", "importance", "recommended"])

    def close(self) -> None:
        pass


def push_stream(rows: DataFrame, max_age_hours: int = 48) -> DataFrame:
    """TRANSITIONS of a stream of polls and outcomes (see _PushMachine): a row for each new status of an event. The stream needs a
    watermark on `polled` and RocksDB for its state (`jobs.rocks`). Times are taken as UTC."""
    own = rows.select("event_id", "polled", "baseline", "importance", "recommended", "discovered", "outcome")
    return own.groupBy("event_id").transformWithStateInPandas(_PushMachine(max_age_hours * 3_600_000), TRANSITIONS, "append", "eventTime")


def select_pushes(state: DataFrame, feed: DataFrame, attempts: DataFrame, now: Column, per_run: int = 3, per_day: int = 5, max_age_hours: int = 48) -> DataFrame:
    """(event_id, place): the pending events to push now, by importance, discovery and id, within both caps.

    attempts: day, n; a day is a local one. The rest stays pending.
    """
    day = F.to_date(now + F.expr("INTERVAL 8 HOURS"))
    used = attempts.where(F.col("day") == day).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("used"))  # one row
    young = F.col("discovered").between(now - F.expr(f"INTERVAL {max_age_hours} HOURS"), now)
    pending = feed.where(young).join(state.where("status = 'pending'").select("event_id"), "event_id", "left_semi")
    first = pending.orderBy(F.desc(F.coalesce("importance", F.lit(0))), F.desc("discovered"), F.desc("event_id")).limit(per_run)
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(F.coalesce("importance", F.lit(0))), F.desc("discovered"), F.desc("event_id")))
    return first.withColumn("place", place).join(F.broadcast(used)).where(F.col("place") <= per_day - F.col("used")).select("event_id", "place")


def record_attempts(state: DataFrame, pushes: DataFrame, now: Column) -> DataFrame:
    """The state with the chosen events attempted: written before anything is sent, so that a crash never sends twice."""
    picked = pushes.select("event_id").distinct().withColumn("_p", F.lit(True))
    j = state.join(picked, "event_id", "left")
    return j.withColumn("status", F.when(F.col("_p"), "attempted").otherwise(F.col("status"))).withColumn("attempted", F.when(F.col("_p"), now).otherwise(F.col("attempted"))).drop("_p")


def record_results(state: DataFrame, results: DataFrame) -> DataFrame:
    """The state with what became of attempts: sent or failed. results: event_id, ok."""
    r = results.groupBy("event_id").agg(F.bool_or("ok").alias("_ok"))
    done = (F.col("status") == "attempted") & F.col("_ok").isNotNull()
    return state.join(r, "event_id", "left").withColumn("status", F.when(done, F.when(F.col("_ok"), "sent").otherwise("failed")).otherwise(F.col("status"))).drop("_ok")


def trim(state: DataFrame, attempts: DataFrame, now: Column, days: int = 90, counter_days: int = 14) -> tuple[DataFrame, DataFrame]:
    """Without events unseen for so many days, and without the counters of older days."""
    day = F.to_date(now + F.expr("INTERVAL 8 HOURS"))
    return state.where(F.col("last_seen") >= now - F.expr(f"INTERVAL {days} DAYS")), attempts.where((F.col("day") > F.date_sub(day, counter_days)) & (F.col("day") <= day))


def changed(before: DataFrame, after: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, change): rows that are new, gone or different between two snapshots of a feed; nothing where nothing changed."""
    columns = sorted(c for c in after.columns if c != key)
    print_ = F.sha2(F.to_json(F.struct(*columns)), 256)
    j = before.select(key, print_.alias("_b")).join(after.select(key, print_.alias("_a")), key, "full_outer")
    change = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "gone").when(F.col("_a") != F.col("_b"), "changed")
    return j.select(key, change.alias("change")).where("change is not null")
