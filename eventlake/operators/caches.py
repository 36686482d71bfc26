"""Keyed decisions that expire, work queues and usage ledgers, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eventlake.operators.events import cache_reason, upsert

TTL_DAYS, ERROR_HOURS, GRACE_DAYS, NEWEST = 21, 6, 7, 5000


def url_key(norm: Column) -> Column:
    return F.sha2(norm, 256)


def lookup(candidates: DataFrame, cache: DataFrame, now: Column, ttl_days: int = TTL_DAYS, error_hours: int = ERROR_HOURS) -> DataFrame:
    """candidates (key, content_hash, model, rule_version, ...) with what the cache says: reason, status, enrichment.

    cache: key, content_hash, model, rule_version, status, decided, enrichment. An undated entry has expired; a decision
    counts only for a hit, an error only while it is backed off.
    """
    c = cache.select("key", *(F.col(n).alias(f"_{n}") for n in ("content_hash", "model", "rule_version", "status", "decided", "enrichment")), F.lit(True).alias("_found"))
    j = candidates.join(c, "key", "left")
    age = F.coalesce((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("_decided").cast("timestamp"))) / 3.6e9, F.lit(1e12))
    version = (F.col("_model") == F.col("model")) & (F.col("_rule_version") == F.col("rule_version"))
    reason = cache_reason(F.col("_found").isNotNull(), F.col("_content_hash") == F.col("content_hash"), version, F.col("_status"), age, ttl_days * 24, error_hours)
    told = reason.isin("hit", "error_backoff")
    return j.select(*candidates.columns, reason.alias("reason"), F.when(told, F.col("_status")).alias("status"), F.when(told & (F.col("_status") == "accepted"), F.col("_enrichment")).alias("enrichment"))


def lookup_stats(looked: DataFrame) -> DataFrame:
    return looked.groupBy("reason").agg(F.count("*").alias("n"))


def remember(cache: DataFrame, decisions: DataFrame) -> DataFrame:
    """The cache with new decisions under their keys; the last of several for one key stands."""
    last = F.row_number().over(W.partitionBy("key").orderBy(F.desc("decided"), F.desc("status")))
    return upsert(cache, decisions.withColumn("_last", last).where("_last = 1").drop("_last"), "key")


def prune(cache: DataFrame, now: Column, days: int = TTL_DAYS + GRACE_DAYS, newest: int = NEWEST) -> DataFrame:
    """Dated entries younger than the days, and of those the newest."""
    young = cache.where(F.col("decided").isNotNull() & (F.col("decided") > now - F.expr(f"INTERVAL {days} DAYS")))
    return young.orderBy(F.desc("decided"), "key").limit(newest)


def precheck(looked: DataFrame) -> DataFrame:
    """Candidates without the rejected and the backed-off ones; accepted ones carry what is stored of them."""
    out = ~F.coalesce(F.col("status").isin("rejected", "error"), F.lit(False))
    return looked.where(out)


def overlay(df: DataFrame, stored: str, columns: list[str]) -> DataFrame:
    """Columns from a stored struct where it has them."""
    return df.select(*(F.coalesce(F.col(f"{stored}.{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns if c != stored))


def propagate(group: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(item, status): the verdict of a group's primary for all of the group. group: group_id, item, is_primary; verdicts: item, status."""
    primary = group.where("is_primary").join(verdicts, "item").groupBy("group_id").agg(F.max("status").alias("status"))
    return group.join(primary, "group_id").select("item", "status")


def not_completed(sources: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """Documents whose text hasn't been processed by this version with a quality of pass. Both: id, hash; done: version, quality."""
    fine = done.where((F.col("version") == version) & (F.col("quality") == "pass")).select("id", "hash")
    return sources.join(fine, ["id", "hash"], "left_anti")


def curate(events: DataFrame, pins: DataFrame, drops: DataFrame, key: str = "event_id") -> DataFrame:
    """Editors' lists: dropped ids go, pinned ones are pinned. The lists are short; Spark broadcasts what is small."""
    pinned = pins.select(key).distinct().withColumn("_pin", F.lit(True))
    kept = events.join(drops.select(key), key, "left_anti").join(pinned, key, "left")
    return kept.withColumn("pinned", F.coalesce("pinned", F.lit(False)) | F.coalesce("_pin", F.lit(False))).drop("_pin")


def keep_weeks(weeks: DataFrame, n: int = 26) -> DataFrame:
    """Rows of the newest weeks."""
    return weeks.join(weeks.select("week_id").distinct().orderBy(F.desc("week_id")).limit(n), "week_id", "left_semi")


#: What a week's text depends on: another value of any of them is another text.
WEEKLY_KEY = ("week_id", "input_hash", "baseline_hash", "prompt_version", "schema_version", "model")


def weekly_key(model_default: str = "unconfigured") -> Column:
    """The name of a stored week: a hash of all that it depends on. Nulls count as empty, without a model as the default."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in WEEKLY_KEY[:-1]]
    return F.sha2(F.to_json(F.array(*parts, F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit(model_default)))), 256)


def weekly_lookup(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """asked (the columns of WEEKLY_KEY) with `entry` where it is stored under the same key, and a reason: hit, changed (the
    week is there, made from something else) or absent. stored: key, week_id, entry; one row a key."""
    j = asked.withColumn("key", weekly_key()).join(stored.select("key", "entry", F.lit(True).alias("_hit")), "key", "left")
    weeks = stored.select("week_id").distinct().withColumn("_week", F.lit(True))
    reason = F.when(F.col("_hit"), "hit").when(F.col("_week"), "changed").otherwise("absent")
    return j.join(weeks, "week_id", "left").withColumn("reason", reason).drop("_hit", "_week")


# --- ledgers ---------------------------------------------------------------------------------------------------------


def append_runs(ledger: DataFrame, run: DataFrame) -> DataFrame:
    """Facts of runs with those of a new one; a run that was there before is replaced, so its totals count once."""
    return ledger.join(run.select("run_id").distinct(), "run_id", "left_anti").unionByName(run)


def usage_accounts(calls: DataFrame, by: tuple[str, ...] = ("run_id", "purpose", "source", "day")) -> DataFrame:
    """Calls, failures, reported and accounted tokens by each of the columns alone and in all, from one pass. A call that
    reported nothing, a failed one as well, is accounted with what was reserved for it."""
    sums = [F.count("*").alias("calls"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failures"), F.sum(F.coalesce("total_tokens", F.lit(0))).alias("total_tokens"), F.sum(F.when(F.coalesce("usage_reported", F.lit(False)), F.coalesce("total_tokens", F.lit(0))).otherwise(F.coalesce("reserved", F.lit(0)))).alias("accounted_tokens")]
    sets = [[F.col(c)] for c in by] + [[]]
    return calls.groupingSets(sets, *(F.col(c) for c in by)).agg(*sums)


def daily_totals(ledger: DataFrame) -> DataFrame:
    """Calls, failures and tokens by day and by day and purpose, worked out anew from the facts.

    A call without a reported total counts with what was reserved for it.
    """
    counted = ledger.withColumn("accounted", F.coalesce("total", "reserved"))
    sums = [F.count("*").alias("calls"), F.count_if("failed").alias("failures"), F.sum("accounted").alias("tokens")]
    return counted.groupingSets([[F.col("day")], [F.col("day"), F.col("purpose")]], F.col("day"), F.col("purpose")).agg(*sums)


def prune_ledger(calls: DataFrame, days: int = 45, runs: int = 50, details: int = 2000) -> DataFrame:
    """Calls of the newest runs within the newest days, newest first until so many details are kept.

    calls: run_id, started, day, call. Days and runs are few: their lists are ordered, the calls aren't.
    """
    by_day = calls.select("day").distinct().orderBy(F.desc("day")).limit(days)
    by_run = calls.groupBy("run_id").agg(F.max("started").alias("_at")).orderBy(F.desc("_at"), F.desc("run_id")).limit(runs)
    kept = calls.join(by_day, "day", "left_semi").join(by_run.select("run_id"), "run_id", "left_semi")
    return kept.orderBy(F.desc("started"), F.desc("run_id"), F.desc("call")).limit(details)


def whole_estimate(chunks: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """Tokens that a document may take: each chunk by its characters and the answer, and once more for a retry."""
    each = F.greatest(F.lit(512), F.floor(F.col("chars") / 3) + most)
    return chunks.groupBy(key).agg((2 * F.sum(each)).alias("tokens"), F.count("*").alias("chunks"))


# --- queues ----------------------------------------------------------------------------------------------------------


def backfill_queue(events: DataFrame, now: Column, limit: int = 3, cooldown_hours: int = 6, days: int = 14) -> DataFrame:
    """Recent events without a translated title that weren't tried lately, newest first.

    events: event_id, seen, translated, tried.
    """
    fresh = F.col("seen") > now - F.expr(f"INTERVAL {days} DAYS")
    cool = F.col("tried").isNull() | (F.col("tried") <= now - F.expr(f"INTERVAL {cooldown_hours} HOURS"))
    return events.where(fresh & ~F.coalesce("translated", F.lit(False)) & cool).orderBy(F.desc("seen"), "event_id").limit(limit)


def translation_backlog(events: DataFrame, now: Column, version: str, limit: int, days: int = 7, retry_days: int = 7) -> DataFrame:
    """What is still to be translated, in order: never tried before tried, pinned, by stale version, mode, importance, heat
    and time; the last key is the id.

    events: event_id, seen, mode, version, tried, pinned, importance, heat.
    """
    due = F.col("tried").isNull() | (F.col("tried") <= now - F.expr(f"INTERVAL {retry_days} DAYS"))
    stale = F.coalesce(F.col("version") != version, F.lit(True))
    open_ = (F.col("seen") > now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("mode").isin("summary", "original") | stale) & due
    order = [F.asc(F.col("tried").isNotNull()), F.desc("pinned"), F.desc(stale), F.asc("mode"), F.desc("importance"), F.desc("heat"), F.desc("seen"), F.asc("event_id")]
    return events.where(open_).orderBy(*order).limit(limit)


def retry_media_queue(figures: DataFrame, limit: int = 48) -> DataFrame:
    """Events with figures to fetch again, by how many and then by time. figures: event_id, seen, retryable."""
    return figures.where("retryable").groupBy("event_id").agg(F.count("*").alias("figures"), F.max("seen").alias("seen")).orderBy(F.desc("figures"), F.desc("seen"), "event_id").limit(limit)
