"""Filters, joins, aggregates and rankings over content events. Every ranking ends in a unique tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eventlake.functions import scores


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds, else null: why a row is dropped."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def keyword_match(text: Column, words: list[str]) -> Column:
    """Short ASCII words match as words, others anywhere."""
    out = F.lit(False)
    for w in words:
        out = out | (text.rlike(rf"(?i)\b{w}\b") if w.isascii() and len(w) <= 3 else F.lower(text).contains(w.lower()))
    return out


def recent(time: Column, ref: Column, days: int) -> Column:
    return time.between(ref - F.expr(f"INTERVAL {days} DAYS"), ref)


def push_reason(pinned: Column, importance: Column, sources: Column) -> Column:
    return F.when(pinned, "pinned").when(importance >= 80, "importance").when((importance >= 75) & (sources >= 2), "multi_source")


def quality_gate(pinned: Column, importance: Column, heat: Column, items: Column) -> Column:
    return pinned | (importance >= 70) | (heat >= 65) | (items >= 2)


def cap_per_key(df: DataFrame, key: str, order: list[Column], cap: int, overrides: dict[str, int] | None = None) -> DataFrame:
    """The first `cap` rows of each key in the given order: what a greedy pass over the ordered rows keeps."""
    most = F.lit(cap)
    for name, n in (overrides or {}).items():
        most = F.when(F.col(key) == name, n).otherwise(most)
    return df.withColumn("_row", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("_row") <= most).drop("_row")


def hot_top(events: DataFrame, limit: int, cap: int = 2, source: str = "source") -> DataFrame:
    """The hottest events with at most `cap` per source. Expects heat, importance, published, event_id."""
    order = [F.desc("heat"), F.desc("importance"), F.desc("published"), F.asc("event_id")]
    return cap_per_key(events, source, order, cap).orderBy(*order).limit(limit)


def streaks(runs: DataFrame, key: str, order: str, zero: Column, neutral: Column) -> DataFrame:
    """Length of the last run of zeros per key; neutral rows neither count nor reset."""
    real = runs.where(~neutral).withColumn("_z", zero)
    w = W.partitionBy(key).orderBy(order)
    islands = real.withColumn("_i", F.sum((~F.col("_z")).cast("int")).over(w))
    last = islands.groupBy(key).agg(F.max("_i").alias("_last"))
    return last.join(islands.where("_z"), key, "left").groupBy(key).agg(F.sum((F.coalesce(F.col("_i") == F.col("_last"), F.lit(False))).cast("long")).alias("streak"))


def admit_prefix(queue: DataFrame, order: list[Column], cost: str, budget: int, key: str) -> DataFrame:
    """Rows in order until one would pass the key's budget; it and all after it wait."""
    spent = F.sum(cost).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return queue.withColumn("spent", spent).withColumn("admitted", F.col("spent") <= budget)


def upsert(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rows of updates replace those of target with the same key."""
    return target.join(updates.select(key).distinct(), key, "left_anti").unionByName(updates)


def cache_reason(found: Column, same_content: Column, same_version: Column, status: Column, age_h: Column, ttl_h: int = 21 * 24, error_h: int = 6) -> Column:
    return (
        F.when(~found, "absent").when(~same_content, "content_changed").when(~same_version, "version_invalidated")
        .when(status == "error", F.when(age_h < error_h, "error_backoff").otherwise("error_retry"))
        .when(age_h > ttl_h, "expired").otherwise("hit")
    )


def catalog_diff(base: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Every key of either side with lost, new or kept."""
    b, c = base.select(key).distinct().withColumn("_b", F.lit(True)), candidate.select(key).distinct().withColumn("_c", F.lit(True))
    return b.join(c, key, "full_outer").select(key, F.when(F.col("_c").isNull(), "lost").when(F.col("_b").isNull(), "new").otherwise("kept").alias("change"))


def release_guard(base: DataFrame, candidate: DataFrame, base_details: DataFrame, details: DataFrame, protected: DataFrame, now: Column, days: int = 8) -> DataFrame:
    """One row: counts of a release against the one before it, and codes of what speaks against it.

    base, candidate: event_id, time, evergreen, structured, renderable, suspect, chrome; the others: event_id. News older than
    the days may go, unless it is protected; nothing else may.
    """
    flags = ("structured", "renderable", "suspect", "chrome")
    b = base.select("event_id", F.lit(True).alias("b"), "time", "evergreen", *(F.col(f).alias(f"b_{f}") for f in flags))
    k = candidate.select("event_id", F.lit(True).alias("k"), *(F.col(f).alias(f"k_{f}") for f in flags))
    j = b.join(k, "event_id", "full_outer")
    for name, df in (("bd", base_details), ("kd", details), ("p", protected)):
        j = j.join(df.select("event_id").distinct().withColumn(name, F.lit(True)), "event_id", "full_outer")

    def on(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    recent = F.coalesce(F.col("time") >= now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    expired = on("b") & ~recent & ~on("evergreen") & ~on("p")
    row = j.agg(
        F.count_if(on("b")).alias("base"), F.count_if(on("k")).alias("candidate"), F.count_if(expired & ~on("k")).alias("expired_gone"), F.count_if(on("b") & recent & ~on("k")).alias("recent_missing"),
        (F.count_if(on("bd")) - F.count_if(expired & on("bd") & ~on("kd")) - F.count_if(on("kd"))).alias("details_short"), F.count_if(on("p") & ~on("k")).alias("protected_missing"),
        F.count_if(on("b_structured") & on("k") & ~on("k_structured")).alias("structured_lost"), F.count_if(on("b_renderable") & on("k") & ~on("k_renderable")).alias("unrenderable"),
        F.count_if(on("k_suspect") & ~on("b_suspect")).alias("new_suspect"), F.count_if(on("k_chrome")).alias("chrome"),
    )
    c = F.col
    rules = (
        ("event_count_decreased", c("candidate") < c("base") - c("expired_gone")), ("recent_events_missing", c("recent_missing") > 0), ("detail_count_decreased", c("details_short") > 0), ("protected_events_missing", c("protected_missing") > 0),
        ("structured_content_lost", c("structured_lost") > 0), ("structured_content_unrenderable", c("unrenderable") > 0), ("structured_content_suspect", c("new_suspect") > 0), ("stored_article_chrome", c("chrome") > 0),
    )
    return row.withColumn("codes", F.array_compact(F.array(*(F.when(bad, code) for code, bad in rules))))


def retain(time: Column, evergreen: Column, protected: Column, cutoff: Column) -> Column:
    """Protected ids and evergreens stay, others while they are recent."""
    return F.coalesce(protected, F.lit(False)) | F.coalesce(evergreen, F.lit(False)) | F.coalesce(time > cutoff, F.lit(False))


def search_filter(q: str, fields: list[Column], topic: str | None = None, topics: Column | None = None, category: str | None = None, of: Column | None = None) -> Column:
    """Rows of a category and topic whose joined fields hold the folded query."""
    out = F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(q.strip().lower()))
    if topic is not None:
        out = out & F.coalesce(F.array_contains(topics, topic), F.lit(False))
    if category is not None:
        out = out & F.coalesce(of == category, F.lit(False))
    return out


def group_supplements(items: DataFrame, visible: int = 3) -> DataFrame:
    """(event_id, source, reports, place, shown): reports beside the primary one by source, the most first; the first few show.

    items: event_id, source, is_primary.
    """
    g = items.where("not is_primary").groupBy("event_id", "source").agg(F.count("*").alias("reports"))
    place = F.row_number().over(W.partitionBy("event_id").orderBy(F.desc("reports"), "source"))
    return g.withColumn("place", place).withColumn("shown", F.col("place") <= visible)


def primary_item(items: DataFrame, event: str = "event_id") -> DataFrame:
    """The item of each event with the largest (score, published, item id)."""
    return items.groupBy(event).agg(F.max_by("item", F.struct("score", "published", "item")).alias("primary_item"), F.max("score").alias("score"))


def with_heat(events: DataFrame, now: Column) -> DataFrame:
    return events.withColumn("heat", scores.heat(F.col("importance"), F.col("published"), F.col("signal"), F.col("n_sources") - 1, now))
