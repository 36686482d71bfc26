"""What is published: projections without bodies, feeds for agents and readers, their checks, and users' own state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eventlake.functions import text
from eventlake.functions.scores import ordered_union
from eventlake.operators.events import first_reason, push_reason

#: Names of body fields that no published row may hold at any depth.
BANNED = ("full_zh", "content_blocks", "article_blocks", "article_text", "media", "fulltext", "body", "raw_html")
#: Badges that a published row may carry.
BADGES = ("公众号", "X 线索", "收录", "Bluesky", "HN", "官网", "社区", "RSS")
ID = "^[0-9a-f]{12}$"
NONE = "array<string>"


def _list(c: str) -> Column:
    return F.coalesce(c, F.array().cast(NONE))


def lite_projection(events: DataFrame, badge: Column | None = None) -> DataFrame:
    """The allowed columns of an event, without its bodies; items are reduced to their sources."""
    b = F.coalesce(badge if badge is not None else F.lit("RSS"), F.lit("RSS"))
    sources = F.transform(F.filter("items", lambda x: F.coalesce(x["source"], F.lit("")) != ""), lambda x: F.struct(x["source"].alias("source")))
    text_ = [F.coalesce(c, F.lit("")).alias(c) for c in ("event_id", "title", "summary", "reason", "category", "category_label")]
    return events.select(
        *text_, _list("vendors").alias("vendors"), _list("topics").alias("topics"), F.coalesce("heat", F.lit(0)).cast("int").alias("heat"), F.coalesce("star", F.lit(False)).alias("star"), F.col("importance").cast("int").alias("importance"),
        F.coalesce("shelf", F.lit("news")).alias("shelf"), F.coalesce("pinned", F.lit(False)).alias("pinned"), "published", "first_seen", sources.alias("items"), F.when(b.isin(*BADGES), b).otherwise("RSS").alias("source_badge"),
    )


def unique_sources(items: Column) -> Column:
    """Names of an event's sources in order, white space collapsed, each once."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: text.clean_text(x["source"])), lambda x: x != ""))


def eligible_reason(title: Column, summary: Column, category: Column, importance: Column, signal: Column, source: Column, time: Column, categories: list[str], least: int = 30) -> Column:
    """Why an event stays off public lists, else null. An importance that is absent counts as 50."""
    t, s = text.clean_text(title), text.clean_text(summary)
    value = F.coalesce(importance, F.lit(50))
    return first_reason(
        ("empty", (t == "") | (s == "")), ("script", ~text.contains_han(F.concat_ws(" ", t, s))), ("category", ~F.coalesce(category.isin(*categories), F.lit(False))), ("importance", value < least),
        ("signal", ~(F.coalesce(signal, F.lit(False)) | (value != 50))), ("source", F.coalesce(source, F.lit("")) == ""), ("time", time.isNull()),
    )


def agent_feed(events: DataFrame, now: Column, base: str, days: int = 7) -> DataFrame:
    """Nested rows for polling agents: events discovered within the days, newest first, each with its push decision."""
    seen = F.coalesce("first_seen", "published")
    names = unique_sources(F.col("items"))
    why = push_reason(F.coalesce("pinned", F.lit(False)), F.coalesce("importance", F.lit(0)), F.size(names))
    rows = events.where(seen.between(now - F.expr(f"INTERVAL {days} DAYS"), now)).select(
        "event_id", text.clean_text(F.col("title")).alias("title"), text.clean_text(F.col("summary")).alias("summary"), text.clean_text(F.col("reason")).alias("why_it_matters"),
        F.struct(F.coalesce("category", F.lit("")).alias("slug"), F.coalesce("category_label", F.lit("")).alias("label")).alias("category"), _list("topics").alias("topics"), _list("vendors").alias("vendors"),
        F.col("importance").cast("int").alias("importance"), F.coalesce("heat", F.lit(0)).cast("int").alias("heat"), F.coalesce("pinned", F.lit(False)).alias("pinned"), F.col("published").alias("published_at"), seen.alias("discovered_at"),
        F.struct(F.size(names).alias("count"), names.alias("names")).alias("sources"), F.struct(why.isNotNull().alias("recommended"), why.alias("reason")).alias("push"),
        F.struct(F.concat(F.lit(base.rstrip("/") + "/e/"), "event_id", F.lit(".html")).alias("detail")).alias("links"),
    )
    return rows.orderBy(F.desc("discovered_at"), F.desc_nulls_last("importance"), F.desc("event_id"))


def validate_feed(feed: DataFrame, base: str, position: str = "position") -> DataFrame:
    """(event_id, position, errors): malformed or repeated ids, empty texts, wrong links, miscounted sources, order.

    Order is checked against the entry before, by discovery, importance and id.
    """
    w = W.partitionBy(F.lit(0)).orderBy(position)  # a feed is short: it holds days of events
    key = F.struct(F.col("discovered_at"), F.coalesce("importance", F.lit(0)), F.col("event_id"))
    last = F.lag(key).over(w)
    again = F.row_number().over(W.partitionBy("event_id").orderBy(position)) > 1
    expected = F.concat(F.lit(base.rstrip("/") + "/e/"), "event_id", F.lit(".html"))
    bad_id = ~F.coalesce(F.col("event_id").rlike(ID), F.lit(False))
    rules = (
        ("event_id", bad_id), ("duplicate", ~bad_id & again), ("content", ~bad_id & ((F.coalesce("title", F.lit("")) == "") | (F.coalesce("summary", F.lit("")) == ""))),
        ("detail_url", ~bad_id & ~F.coalesce(F.col("links.detail") == expected, F.lit(False))), ("source_count", ~bad_id & (F.col("sources.count") != F.size(F.array_distinct("sources.names")))), ("order", ~bad_id & F.coalesce(key > last, F.lit(False))),
    )
    return feed.select("event_id", position, F.array_compact(F.array(*(F.when(bad, code) for code, bad in rules))).alias("errors"))


def forbidden_keys(rows: DataFrame, json: str, key: str, banned: tuple[str, ...] = BANNED, depth: int = 8) -> DataFrame:
    """(path, rows): banned keys at any depth of stored JSON. One level is opened at a time; places in lists are [*]."""
    level = rows.select(key, F.try_parse_json(json).alias("v"), F.lit("$").alias("path"))
    found = None
    for _ in range(depth):
        inner = level.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("v").outer())).select(F.col(key), F.col("key").alias("k"), F.col("value").alias("w"), "path").where("w is not null")
        level = inner.select(key, F.col("w").alias("v"), F.concat("path", F.when(F.col("k").isNotNull(), F.concat(F.lit("."), "k")).otherwise(F.lit("[*]"))).alias("path"), "k")
        hits = level.where(F.col("k").isin(*banned)).select(key, "path")
        found = hits if found is None else found.union(hits)
        level = level.drop("k")
    return found.groupBy("path").agg(F.count_distinct(key).alias("rows"))


def parse_object(c: Column, strict: bool = False) -> Column:
    """A JSON object as a variant: the text itself or, unless strict, its first to last brace; else null."""
    whole = F.try_parse_json(c)
    found = whole if strict else F.coalesce(whole, F.try_parse_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1)))
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def jsonld_bodies(html: Column) -> Column:
    """articleBody of the page's linked-data scripts, also within @graph."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"""), F.lit(1))
    bodies = F.flatten(F.transform(scripts, lambda s: F.array(F.get_json_object(s, "$.articleBody"), F.get_json_object(s, "$.mainEntity.articleBody"), F.get_json_object(s, "$['@graph'][0].articleBody"), F.get_json_object(s, "$[0].articleBody"))))
    return F.array_distinct(F.array_compact(bodies))


def validate_atom(entries: DataFrame) -> DataFrame:
    """(id, errors) of feed entries: id, link, published, updated, summary, title."""
    again = F.count("*").over(W.partitionBy("id")) > 1
    c = F.col
    rules = (
        ("duplicate_id", again), ("link", ~F.coalesce(c("link") == c("id"), F.lit(False))), ("https", ~F.coalesce(c("link").startswith("https://"), F.lit(False))),
        ("times", c("published").isNull() | c("updated").isNull() | (c("updated") < c("published"))), ("title", F.coalesce(F.trim("title"), F.lit("")) == ""), ("summary", F.coalesce(F.trim("summary"), F.lit("")) == ""),
    )
    return entries.select("id", F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), code) for code, bad in rules))).alias("errors"))


def id_errors(events: DataFrame, key: str = "event_id", pattern: str = ID) -> DataFrame:
    """(key, rows, error): ids that repeat or are malformed."""
    n = events.groupBy(key).agg(F.count("*").alias("rows"))
    error = F.when(~F.coalesce(F.col(key).rlike(pattern), F.lit(False)), "malformed").when(F.col("rows") > 1, "duplicate")
    return n.withColumn("error", error).where("error is not null")


def weekly_archive_index(weeks: DataFrame) -> DataFrame:
    """Valid weeks, newest first. weeks: week_id, items, valid."""
    ok = F.col("week_id").rlike(r"^\d{4}-W(0[1-9]|[1-4]\d|5[0-3])$") & F.coalesce("valid", F.lit(False)) & (F.col("items") > 0)
    return weeks.where(ok).orderBy(F.desc("week_id"))


# --- users -----------------------------------------------------------------------------------------------------------


def new_since(events: DataFrame, visits: DataFrame) -> DataFrame:
    """(user_id, new): how many events each user hasn't seen; users without a visit have none. visits: user_id, last.

    Days before the visit's are out, later ones count whole (one row a day, ranked once), its own by the event's time.
    """
    day = F.to_date("first_seen")
    days = events.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    later = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    asked = visits.where("last is not null").select(F.to_date("last").alias("day")).distinct()
    marks = asked.withColumn("n", F.lit(0).cast("long")).unionByName(days).groupBy("day").agg(F.sum("n").alias("n")).select("day", later.alias("later"))
    one = visits.withColumn("day", F.to_date("last"))
    same = one.join(events.select(day.alias("day"), "first_seen"), "day").where(F.col("first_seen") > F.col("last")).groupBy("user_id").agg(F.count("*").alias("today"))
    return one.join(marks, "day", "left").join(same, "user_id", "left").select("user_id", (F.coalesce("later", F.lit(0)) + F.coalesce("today", F.lit(0))).cast("long").alias("new"))


def match_reasons(topics: Column, vendors: Column, followed_topics: Column, followed_vendors: Column, n: int = 3) -> Column:
    """Followed topics, then vendors, that an event has."""
    return ordered_union(F.array_intersect(topics, followed_topics), F.array_intersect(vendors, followed_vendors), n)


def follow_state(topics: Column, vendors: Column, favourites: Column, dismissed: Column, caps: tuple[int, ...] = (50, 50, 200, 500), clips: tuple[int, ...] = (80, 80, 80, 80)) -> Column:
    """A user's lists, trimmed, clipped, each value once, and no longer than their caps. caps and clips: one for each list."""

    def neat(c: Column, n: int, clip: int) -> Column:
        return F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast(NONE)), lambda x: F.left(F.trim(x), F.lit(clip))), lambda x: x != "")), 1, n)

    named = zip((topics, vendors, favourites, dismissed), caps, clips, ("topics", "vendors", "favourites", "dismissed"), strict=True)
    return F.struct(*(neat(c, n, clip).alias(name) for c, n, clip, name in named))


def sanitize_behavior(rows: DataFrame, names: list[str], pages: list[str]) -> DataFrame:
    """Allowed columns of click rows only: unknown names and pages fall back, texts are clipped, numbers clamped."""
    name = F.when(F.col("name").isin(*names), F.col("name")).otherwise("unknown")
    page = F.when(F.col("page").isin(*pages), F.col("page")).otherwise("other")
    number = F.least(F.greatest(F.coalesce(F.floor("value"), F.lit(0)), F.lit(0)), F.lit(100_000))
    return rows.select("event_id", name.alias("name"), page.alias("page"), F.left(F.coalesce("object", F.lit("")), F.lit(80)).alias("object"), number.cast("int").alias("value"))
