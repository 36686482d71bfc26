"""Measures over click events: validation, counts, funnels, activity and return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eventlake.functions.scores import safe_ratio


def as_behavior(events: DataFrame) -> DataFrame:
    """The raw event table in the roles of the click model."""
    kind = F.create_map(*(F.lit(x) for x in ("view", "exposure", "click", "detail", "purchase", "outbound", "signup", "session_start", "error", "search")))
    day = F.to_date("ts")
    return events.select("event_id", kind[F.col("event_type")].alias("name"), "ts", day.alias("day"), F.col("user_id").alias("device"), F.concat_ws(":", "user_id", day).alias("session"), F.get_json_object("props", "$.k").cast("int").alias("object"), "value")


def errors(ids: Column, name: Column, ts: Column, value: Column, known: list[str]) -> Column:
    """Codes of what is wrong with a row."""
    codes = (("missing_id", ids.isNull()), ("unknown_name", ~F.coalesce(name.isin(*known), F.lit(False))), ("missing_time", ts.isNull()), ("value_range", F.coalesce(~value.between(0, 100), F.lit(False))))
    return F.array_compact(F.array(*(F.when(bad, code) for code, bad in codes)))


# What click rows may hold.
EVENT_NAMES = ("session_start", "list_exposure", "detail_click", "outbound_click", "favorite_toggle", "search", "filter", "weekly_brief_click", "daily_brief_click")
PAGES = ("home", "weekly", "daily", "topics", "topic", "classics", "hot", "favorites", "sources", "detail", "privacy", "other")
CATEGORIES = ("agent", "platform", "bi", "product", "insight", "")
VIEWPORTS = ("small", "medium", "large")
REFERRERS = ("direct", "internal", "search", "social", "other")
QUERY_BUCKETS = ("1-3", "4-8", "9+")
OPTIONAL = ("event_id", "category", "source", "action", "filter", "query_bucket", "result_count")
REQUIRED = ("schema_version", "event_uuid", "name", "ts", "environment", "site_id", "page", "session_id", "device_id", "sequence", "viewport", "referrer")
WITH_EVENT = ("list_exposure", "detail_click", "outbound_click", "favorite_toggle")
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def validate(rows: DataFrame) -> Column:
    """Codes of what is wrong with a click row, in a fixed order; none means that it is taken.

    rows: the columns of REQUIRED and OPTIONAL as texts (sequence and result_count as longs), and `fields`, the names that
    the row came with.
    """
    c = F.col

    def among(name: str, words: tuple[str, ...]) -> Column:
        return ~F.coalesce(c(name).isin(*words), F.lit(False))

    def blank(name: str) -> Column:
        return F.coalesce(c(name), F.lit(""))

    def shaped(name: str, pattern: str) -> Column:
        return ~blank(name).rlike(pattern)

    event = blank("event_id")
    needs = F.coalesce(c("name").isin(*WITH_EVENT), F.lit(False))
    odd = ~event.rlike("^[a-f0-9]{12}$")
    zoned = F.coalesce(c("ts").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(?:Z|[+-]\d{2}:\d{2})$"), F.lit(False)) & F.try_to_timestamp(F.col("ts")).isNotNull()
    all_ = F.array(*(F.lit(x) for x in (*REQUIRED, *OPTIONAL)))
    codes = (
        ("unknown_fields", F.size(F.array_except("fields", all_)) > 0), ("missing_fields", F.size(F.array_except(F.array(*(F.lit(x) for x in REQUIRED)), c("fields"))) > 0), ("schema_version", ~F.coalesce(c("schema_version") == "1", F.lit(False))),
        ("event_name", among("name", EVENT_NAMES)), *((n, shaped(n, UUID)) for n in ("event_uuid", "session_id", "device_id")), ("timestamp", ~zoned), ("environment", blank("environment") != "production"), ("site_id", shaped("site_id", "^[a-z0-9_-]{1,40}$")),
        ("page", among("page", PAGES)), ("event_id_required", needs & odd), ("event_id", ~needs & (event != "") & odd), ("category", ~blank("category").isin(*CATEGORIES)),
        *((n, (F.length(blank(n)) > most) | blank(n).rlike(r"[\x00-\x1f\x7f]")) for n, most in (("source", 80), ("filter", 40))), ("sequence", ~F.coalesce(c("sequence").between(1, 1_000_000), F.lit(False))),
        ("viewport", among("viewport", VIEWPORTS)), ("referrer", among("referrer", REFERRERS)), ("action", ~blank("action").isin("add", "remove", "")), ("query_bucket", ~blank("query_bucket").isin(*QUERY_BUCKETS, "")),
        ("action_required", (c("name") == "favorite_toggle") & ~blank("action").isin("add", "remove")), ("query_bucket_required", (c("name") == "search") & ~blank("query_bucket").isin(*QUERY_BUCKETS)),
        ("result_count", F.array_contains("fields", "result_count") & ~F.coalesce(c("result_count").between(0, 100_000), F.lit(False))),
    )
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), code) for code, bad in codes)))


def quality_report(validated: DataFrame, parse_errors: int = 0, key: str = "event_uuid") -> DataFrame:
    """One row: rows, valid ones (each key once), invalid and repeated ones, lines that didn't parse, share of valid ones."""
    per = validated.groupBy(key).agg(F.count_if(F.size("errors") > 0).alias("bad"), F.count_if(F.size("errors") == 0).alias("good"))
    total = F.coalesce(F.sum(F.col("bad") + F.col("good")), F.lit(0)) + parse_errors
    valid = F.count_if(F.col("good") > 0)
    return per.agg(
        total.alias("input_events"), valid.alias("valid_events"), F.coalesce(F.sum("bad"), F.lit(0)).alias("invalid_events"), F.coalesce(F.sum(F.greatest(F.col("good") - 1, F.lit(0))), F.lit(0)).alias("duplicate_events"),
        F.lit(parse_errors).cast("long").alias("parse_errors"), safe_ratio(valid, total).alias("valid_rate"),
    )


def funnel(b: DataFrame) -> DataFrame:
    """Over distinct (session, object) pairs: exposed ones, the share of them with a detail view, the share of detail views
    with an outbound click, and the share of exposed ones that were made favourites."""
    flag = {n: F.max((F.col("name") == n).cast("int")).alias(n) for n in ("exposure", "detail", "outbound", "favorite")}
    pairs = b.where("object is not null").groupBy("session", "object").agg(*flag.values())
    c = F.col
    return pairs.agg(
        F.coalesce(F.sum("exposure"), F.lit(0)).alias("exposures"), safe_ratio(F.sum(c("exposure") * c("detail")), F.sum("exposure")).alias("ctr"),
        safe_ratio(F.sum(c("detail") * c("outbound")), F.sum("detail")).alias("outbound_rate"), safe_ratio(F.sum(c("exposure") * c("favorite")), F.sum("exposure")).alias("favorite_rate"),
    )


def usage(b: DataFrame, uses: dict[str, list[str]], start: str = "session_start") -> DataFrame:
    """The share of started sessions with an event of each use."""
    flags = [F.max(F.col("name").isin(*names).cast("int")).alias(u) for u, names in uses.items()]
    s = b.groupBy("session").agg(F.max((F.col("name") == start).cast("int")).alias("_started"), *flags).where("_started = 1")
    return s.agg(*(safe_ratio(F.sum(u), F.count("*")).alias(f"{u}_rate") for u in uses))


def daily_active(b: DataFrame) -> DataFrame:
    return b.groupBy("day").agg(F.count_distinct("device").alias("devices"))


def return_rate(b: DataFrame, days: int = 7) -> DataFrame:
    """Of the devices first seen at least `days` before the last day, the share active again within `days`."""
    active = b.select("device", "day").distinct()
    first = active.groupBy("device").agg(F.min("day").alias("first"))
    last = active.agg(F.max("day").alias("last"))
    cohort = first.join(F.broadcast(last), F.expr(f"first <= last - INTERVAL {days} DAYS"))  # one row
    again = cohort.join(active, "device").groupBy("device").agg(F.max((F.datediff("day", "first").between(1, days)).cast("int")).alias("back"))
    return again.agg(F.count("*").alias("cohort"), safe_ratio(F.sum("back"), F.count("*")).alias("rate"))


def daily_sketches(events: DataFrame, device: str, ts: str, log_k: int = 14) -> DataFrame:
    """day, sketch: a sketch of each day's distinct devices, from one pass over the events."""
    return events.where(F.col(device).isNotNull() & F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.hll_sketch_agg(F.col(device), log_k).alias("sketch"))


def sliding_devices(sketches: DataFrame, days: int = 7) -> DataFrame:
    """day, devices: the estimated number of distinct devices in the `days` up to each day that has events, from the daily
    sketches alone; its relative error is about 1 / sqrt(2 ** log_k)."""
    shifted = sketches.select(F.explode(F.sequence(F.col("day"), F.date_add("day", days - 1))).alias("day"), "sketch")
    merged = shifted.groupBy("day").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("devices"))
    return merged.join(sketches.select("day"), "day", "left_semi")


def exact_sliding_devices(events: DataFrame, device: str, ts: str, days: int = 7) -> DataFrame:
    """day, devices: the number of distinct devices in the `days` up to each day that has events.

    A device counts from a day on which it is active for `days`, or until it is active again: a step up and a step down, so
    that each day's device costs two steps whatever the window. Their running sum is over one row a day.
    """
    active = events.where(F.col(ts).isNotNull()).select(F.to_date(ts).alias("day"), F.col(device).alias("device")).distinct()
    active = active.withColumn("again", F.lead("day").over(W.partitionBy("device").orderBy("day")))
    up = F.when(F.col("device").isNotNull(), 1).otherwise(0).cast("long")
    steps = F.array(F.struct("day", up.alias("step"), F.lit(True).alias("seen")), F.struct(F.least(F.date_add("day", days), "again").alias("day"), (-up).alias("step"), F.lit(False).alias("seen")))
    daily = active.select(F.inline(steps)).groupBy("day").agg(F.sum("step").alias("step"), F.bool_or("seen").alias("seen"))
    return daily.withColumn("devices", F.sum("step").over(W.partitionBy(F.lit(0)).orderBy("day"))).where("seen").select("day", "devices")
