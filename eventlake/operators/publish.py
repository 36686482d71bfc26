"""Personal ranking, alignment of stored texts, feed checks and due sources. Every ranking ends in a unique tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eventlake.functions import text
from eventlake.functions.scores import personal_score


def personal_rank(follows: DataFrame, events: DataFrame, now: Column, k: int, dismissed: DataFrame | None = None, favourites: DataFrame | None = None) -> DataFrame:
    """The k best events of each user among those with a followed key, without dismissed ones.

    follows: user_id, key; events: key, event_id, importance, heat, sources, published, source; dismissed: user_id,
    event_id; favourites: user_id, source. Users meet events by an equi-join on the key, never all with all.
    """
    pick = [F.max(c).alias(c) for c in ("importance", "heat", "sources", "published", "source")]
    hits = follows.select("user_id", "key").distinct().join(events, "key").groupBy("user_id", "event_id").agg(F.count_distinct("key").alias("matches"), *pick)
    if dismissed is not None:
        hits = hits.join(dismissed.select("user_id", "event_id"), ["user_id", "event_id"], "left_anti")
    liked = F.lit(False)
    if favourites is not None:
        hits = hits.join(favourites.select("user_id", "source").distinct().withColumn("liked", F.lit(True)), ["user_id", "source"], "left")
        liked = F.coalesce("liked", F.lit(False))
    # rounded before it is ordered by: sums that differ in their last bit are equal
    score = F.round(personal_score(F.col("matches"), F.col("importance"), F.col("heat"), F.datediff(now, "published"), F.col("sources"), liked), 6)
    scored = hits.withColumn("score", score)
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("score"), F.desc("published"), F.asc("event_id")))
    return scored.withColumn("place", place).where(F.col("place") <= k).select("user_id", "place", "event_id", "score")


def block_ids(blocks: DataFrame, doc: str, order: str) -> DataFrame:
    """Digest of each text and how many equal texts stand before it in the document: an id that survives edits elsewhere."""
    digest = F.md5(F.coalesce("text", F.lit("")))
    again = F.row_number().over(W.partitionBy(doc, digest).orderBy(order))
    return blocks.select(doc, F.col(order).alias("at"), F.concat_ws("-", digest, again.cast("string")).alias("block"))


def align_blocks(source: DataFrame, stored: DataFrame, doc: str, order: str, share: float = 0.6, least: int = 3) -> DataFrame:
    """Whether stored blocks can be carried over: enough anchors, both ends anchored, the order unchanged."""
    pairs = block_ids(source, doc, order).join(block_ids(stored, doc, order).withColumnRenamed("at", "theirs"), [doc, "block"], "left")
    before = F.max("theirs").over(W.partitionBy(doc).orderBy("at").rowsBetween(W.unboundedPreceding, -1))
    flagged = pairs.withColumn("back", F.coalesce(F.col("theirs") < before, F.lit(False)))
    per = flagged.groupBy(doc).agg(F.count("*").alias("blocks"), F.count("theirs").alias("anchors"), (~F.bool_or("back")).alias("ordered"), F.max_by(F.col("theirs").isNotNull(), "at").alias("last"), F.min_by(F.col("theirs").isNotNull(), "at").alias("first"))
    enough = (F.col("anchors") >= least) & (F.col("anchors") >= share * F.col("blocks"))
    return per.select(doc, "blocks", "anchors", "ordered", (enough & F.col("ordered") & F.col("first") & F.col("last")).alias("aligned"))


def order_breaks(feed: DataFrame, key: str, time: str, position: str) -> DataFrame:
    """How often a later entry of a feed is newer than the one before it; feeds in order don't appear."""
    last = F.lag(time).over(W.partitionBy(key).orderBy(position))
    return feed.withColumn("_break", F.col(time) > last).groupBy(key).agg(F.count_if("_break").alias("breaks")).where("breaks > 0")


def due_sources(attempts: DataFrame, source: str, time: str, hours: Column) -> DataFrame:
    """Sources by their last attempt: due, or how many whole minutes are left, against the newest attempt of all."""
    last = attempts.groupBy(source).agg(F.max(time).alias("last"))
    now = last.agg(F.max("last").alias("now"))  # one row
    left = hours * 60 - F.floor((F.unix_micros("now") - F.unix_micros("last")) / 60_000_000)
    return last.join(F.broadcast(now)).select(source, (left <= 0).alias("due"), F.greatest(left, F.lit(0)).cast("long").alias("minutes_left"))


def broken_links(pages: DataFrame) -> DataFrame:
    """(page_id, href, target): links within a page's own site that lead to none of the pages. Links to other hosts and of
    other kinds (mail, scripts) are left alone."""
    hrefs = F.explode(F.regexp_extract_all("html", F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1)))
    refs = pages.select("page_id", "url", hrefs.alias("href")).distinct().withColumn("target", text.resolve_reference(F.col("url"), F.col("href")))
    own = refs.where(F.col("target").rlike("^(?i)https?://") & (text.url_host(F.col("target")) == text.url_host(F.col("url")))).withColumn("key", text.page_key(F.col("target")))
    return own.join(pages.select(text.page_key(F.col("url")).alias("key")), "key", "left_anti").select("page_id", "href", "target")
