"""How reports become events and events one event. Lists keep their first-seen order and are cut where they are long."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions import scores, text

VENDORS, TOPICS = 5, 3


def in_order(values: str, *order: str, n: int | None = None) -> Column:
    """Aggregate: distinct values of arrays, in order of the given columns."""
    sorted_ = F.transform(F.sort_array(F.collect_list(F.struct(*order, values))), lambda x: x[values])
    flat = F.array_distinct(F.flatten(F.filter(sorted_, lambda x: x.isNotNull())))
    return flat if n is None else F.slice(flat, 1, n)


def make_event(items: DataFrame) -> DataFrame:
    """A report as an event of its own: named after its normalised URL, first seen when it was taken in."""
    return items.select(
        text.stable_id(text.norm_url(F.col("link"))).alias("event_id"), "title", "summary", "category", "vendors", "topics",
        F.coalesce("importance", F.lit(50)).alias("importance"), F.coalesce("signal", F.lit(0)).alias("signal"), F.coalesce("evergreen", F.lit(False)).alias("evergreen"),
        "published", F.coalesce("ingested", "published").alias("first_seen"), F.array(F.struct("id", "source", "link", "published", "title")).alias("items"),
    )


def merge_items(items: DataFrame, event: str = "event_id", order: str = "seq") -> DataFrame:
    """Reports into their event: the earliest dates, the largest signal and importance, the longest summary (the first of
    equals), vendors and topics in order, evergreen if one is. The event's own first report is the first in order."""
    longest = F.struct(F.length("summary"), -F.col(order))
    return items.groupBy(event).agg(
        F.min("published").alias("published"), F.min("first_seen").alias("first_seen"), F.max("signal").alias("signal"), F.max("importance").alias("importance"),
        F.max_by("summary", longest).alias("summary"), in_order("vendors", order, n=VENDORS).alias("vendors"), in_order("topics", order, n=TOPICS).alias("topics"),
        F.bool_or("evergreen").alias("evergreen"), F.count("*").alias("items"),
    )


#: Ways in which a body was got that come before all others.
BODY_MODES = ("original", "translated")


def choose_merged_body(items: DataFrame, event: str = "event_id", order: str = "seq", item: str = "item", mode: str = "mode", body: str = "body", modes: tuple[str, ...] = BODY_MODES) -> DataFrame:
    """(event, item): whose body an event keeps as its reports come in, in order. A report's body takes the place of the one
    kept if it is longer, or if it was got in one of the modes and the kept one wasn't. Each report may undo the last, so
    that an event's reports are folded one by one: by their lengths and modes alone, the texts stay where they are."""
    row = F.struct(F.col(order).alias("o"), F.col(item).alias("i"), F.coalesce(F.col(mode).isin(*modes), F.lit(False)).alias("good"), F.length(F.coalesce(F.col(body), F.lit(""))).alias("n"))
    rows = F.sort_array(F.collect_list(row))

    def keep(held: Column, new: Column) -> Column:
        return F.when(held.isNull() | (new["good"] & ~held["good"]) | (new["n"] > held["n"]), new).otherwise(held)

    kept = F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), F.get("rows", F.lit(0)), keep)
    return items.groupBy(event).agg(rows.alias("rows")).select(event, kept["i"].alias(item))


def merge_events(events: DataFrame, into: str = "into", key: str = "event_id") -> DataFrame:
    """Events into the one that they merge into: the latest publication, the largest signal and importance, vendors in
    order; first sight and text stay the leader's, and items add up."""
    lead = F.struct((F.col(key) != F.col(into)).cast("int"), key)
    return events.groupBy(into).agg(
        F.max("published").alias("published"), F.min_by("first_seen", lead).alias("first_seen"), F.max("signal").alias("signal"), F.max("importance").alias("importance"),
        F.min_by("summary", lead).alias("summary"), in_order("vendors", key, n=VENDORS).alias("vendors"), F.sum("items").alias("items"),
    ).withColumnRenamed(into, key)


def merge_same_url(events: DataFrame, extra: DataFrame, now: Column, key: str = "event_id") -> DataFrame:
    """Known events with further sources of their URL: the latest publication, the largest signal, heat anew. Events
    without one don't change. extra: event_id, published, signal."""
    more = extra.groupBy(key).agg(F.max("published").alias("p"), F.max("signal").alias("s"), F.count("*").alias("k"))
    both = events.join(more, key, "left")
    merged = both.withColumn("published", F.greatest("published", "p")).withColumn("signal", F.greatest("signal", "s")).withColumn("items", F.col("items") + F.coalesce("k", F.lit(0)))
    heat = scores.heat(F.col("importance"), F.col("published"), F.col("signal"), F.col("items") - 1, now)
    return merged.withColumn("heat", F.when(F.col("k").isNotNull(), heat).otherwise(F.col("heat"))).drop("p", "s", "k")


def attach_secondary(events: DataFrame, group: DataFrame, known: DataFrame, key: str = "event_id") -> DataFrame:
    """The rest of a group on its primary's event: only reports that it doesn't hold yet; signal and vendors grow.

    group: event_id, item, is_primary, signal, vendors, seq; known: event_id, item.
    """
    new = group.where("not is_primary").join(known.select(key, "item"), [key, "item"], "left_anti")
    more = new.groupBy(key).agg(F.max("signal").alias("s"), in_order("vendors", "seq").alias("v"), F.count("*").alias("k"))
    none = F.array().cast("array<string>")
    both = events.join(more, key, "left")
    return both.withColumn("signal", F.greatest("signal", "s")).withColumn("vendors", scores.ordered_union(F.coalesce("vendors", none), F.coalesce("v", none), VENDORS)).withColumn("items", F.col("items") + F.coalesce("k", F.lit(0))).drop("s", "v", "k")


def stack_signal(items: DataFrame, key: str = "norm") -> DataFrame:
    """Reports of one URL in one run are one, with their signals added."""
    return items.groupBy(key).agg(F.min("id").alias("id"), F.sum("signal").alias("signal"), F.count("*").alias("reports"))
