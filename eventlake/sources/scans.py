"""Landed files as tables. Schemas are fixed: the readers would guess types from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eventlake.functions.text import norm_url, repair_markup, slug_title, stable_id, strip_html

PER_SOURCE = 20


def scan_feed_items(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """RSS items (or Atom entries): title, link, published, summary; rows without title or link are dropped."""
    if tag == "item":
        raw = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, description string").load(path)
        rows = raw.select("title", "link", F.col("pubDate").alias("published"), F.col("description").alias("summary"))
    else:
        raw = spark.read.format("xml").option("rowTag", "entry").schema("title string, link array<struct<_href:string,_rel:string>>, updated string, published string, summary string, content string").load(path)
        first = F.filter("link", lambda x: x["_rel"].isNull() | (x["_rel"] == "alternate"))
        rows = raw.select("title", F.get(first, 0)["_href"].alias("link"), F.coalesce("published", "updated").alias("published"), F.coalesce("content", "summary").alias("summary"))
    return rows.where("trim(title) <> '' and trim(link) <> ''")


_ENTRY = "title:string, pubDate:string, published:string, updated:string, date:string, `dc:date`:string, description:string, summary:string, content:string, encoded:string, `content:encoded`:string"
_ITEM = f"struct<link:array<string>, {_ENTRY}>"
_ATOM = f"struct<link:array<struct<_href:string, _rel:string>>, {_ENTRY}>"
FEED_SCHEMA = f"channel struct<item:array<{_ITEM}>>, item array<{_ITEM}>, entry array<{_ATOM}>, _bad string"


def scan_feeds(spark: SparkSession, path: str, cap: int | None = PER_SOURCE) -> tuple[DataFrame, DataFrame]:
    """(items, files) of whole feed documents, RSS or Atom, with their markup repaired before it is parsed.

    items: file, at, title, link, published, summary (plain text), feed_content_html (the richest body: encoded, then
    content, description, summary); rows without title or link are dropped, and of each file at most `cap` stay, in its
    order. files: file, bad (what couldn't be parsed), items. A reader that splits files by tags would drop each item with
    a bare ampersand, so that a document is one row here; each must fit in a task's memory.
    """
    return parse_feeds(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"), cap)


def parse_feeds(documents: DataFrame, cap: int | None = PER_SOURCE) -> tuple[DataFrame, DataFrame]:
    """`scan_feeds` of documents that are there already: file (any key), value."""
    text = repair_markup(F.regexp_replace("value", r"^[^<]+", ""))
    parsed = documents.select("file", F.from_xml(text, FEED_SCHEMA, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("doc"))
    rows = [F.transform(F.coalesce(items, F.array().cast(f"array<{kind}>")), _entry(atom)) for items, kind, atom in ((F.col("doc.channel.item"), _ITEM, False), (F.col("doc.item"), _ITEM, False), (F.col("doc.entry"), _ATOM, True))]
    found = parsed.select("file", F.col("doc._bad").isNotNull().alias("bad"), F.concat(*rows).alias("all"))
    fit = F.filter("all", lambda x: (x["title"] != "") & (x["link"] != ""))
    kept = found.select("file", "bad", (fit if cap is None else F.slice(fit, 1, cap)).alias("items"))
    return kept.select("file", F.posexplode("items").alias("at", "x")).select("file", "at", "x.*"), kept.select("file", "bad", F.size("items").alias("items"))


def _entry(atom: bool):
    def go(x: Column) -> Column:
        def first(*names: str) -> Column:
            return F.coalesce(*(F.when(F.trim(x[n]) != "", F.trim(x[n])) for n in names), F.lit(""))

        rich = first("encoded", "content:encoded", "content", "description", "summary") if not atom else first("content", "summary")
        if atom:
            link = F.get(F.filter(x["link"], lambda y: y["_href"].isNotNull() & (y["_rel"].isNull() | (y["_rel"] == "alternate"))), F.lit(0))["_href"]
        else:
            link = F.get(F.filter(x["link"], lambda y: F.trim(y) != ""), F.lit(0))
        dates = ("published", "updated") if atom else ("pubDate", "published", "updated", "date", "dc:date")
        return F.struct(
            strip_html(first("title")).alias("title"), F.trim(F.coalesce(link, F.lit(""))).alias("link"), F.nullif(first(*dates), F.lit("")).alias("published"), strip_html(rich).alias("summary"), rich.alias("feed_content_html")
        )

    return go


def scan_sitemap(spark: SparkSession, path: str, include: str = "") -> DataFrame:
    """url, lastmod, title (from the last step of the path) of the entries whose address holds a text."""
    raw = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return raw.where(F.col("loc").contains(include)).select(F.trim("loc").alias("url"), "lastmod").withColumn("title", slug_title(F.col("url")))


def scan_link_list(pages: DataFrame, cap: int = PER_SOURCE) -> DataFrame:
    """Links of listing pages: first occurrence per target, at most `cap` per page in page order."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*href=["']([^"']+)["']"""), F.lit(1))
    rows = pages.select("page_id", F.posexplode(found).alias("at", "href"))
    first = rows.groupBy("page_id", "href").agg(F.min("at").alias("at"))
    return first.withColumn("n", F.row_number().over(W.partitionBy("page_id").orderBy("at"))).where(F.col("n") <= cap)


def scan_listing(pages: DataFrame, link: str = r"(/[a-z0-9_/-]+\d{3,})", title: str = r"<strong[^>]*>(.*?)</strong>", base: str = "", cap: int = PER_SOURCE) -> DataFrame:
    """page_id, place, title, link of the articles that listing pages name: anchors whose address matches `link` (a pattern with
    one group) with the title that `title` finds within them, else their own text. Of each address the first anchor with a
    title counts; at most `cap` per page, in page order."""
    anchor = rf'(?is)<a\b[^>]*\bhref="{link}"[^>]*>(.*?)</a>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("path"), F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("inner"))
    rows = pages.select("page_id", F.posexplode(both).alias("at", "a")).select("page_id", "at", F.col("a.path").alias("path"), F.col("a.inner").alias("inner"))
    found = F.regexp_extract("inner", f"(?s){title}", 1)
    named = rows.withColumn("title", strip_html(F.when(F.col("inner").rlike(f"(?s){title}"), found).otherwise(F.col("inner")))).where("title <> ''")
    first = named.groupBy("page_id", "path").agg(F.min_by("title", "at").alias("title"), F.min("at").alias("at"))
    ranked = first.withColumn("place", F.row_number().over(W.partitionBy("page_id").orderBy("at"))).where(F.col("place") <= cap)
    return ranked.select("page_id", "place", "title", F.concat(F.lit(base), F.col("path")).alias("link"))


def scan_versioned_index(pages: DataFrame, column: str, newest: int = 6) -> DataFrame:
    """Newest version paths YYYY/M_N by year and numbers."""
    v = F.explode(F.regexp_extract_all(column, F.lit(r"(\d{4}/\d+_\d+)"), F.lit(1)))
    parts = [F.regexp_extract("version", r"^(\d+)/(\d+)_(\d+)$", i).cast("int") for i in (1, 2, 3)]
    return pages.select(v.alias("version")).distinct().orderBy(F.desc(F.struct(*parts))).limit(newest)


def scan_behavior_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One event, or an object with an array of events, per line; lines that don't parse have bad = true."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    both = lines.select("value", F.from_json("value", f"{schema}, events array<struct<{schema}>>", {"columnNameOfCorruptRecord": "_bad"}).alias("one"), F.try_parse_json("value").isNull().alias("bad"))
    names = [f.split()[0] for f in schema.split(", ")]
    alone = F.array(F.struct(*(F.col(f"one.{n}").alias(n) for n in names)))
    return both.select("bad", F.inline(F.coalesce("one.events", alone)))


def scan_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def scan_catalog_document(spark: SparkSession, path: str) -> DataFrame:
    """Events of landed catalog documents: event_id, title, items. A document of the older layout holds only items, of which
    each becomes an event of its own, named after its link."""
    item = "struct<id:string,source:string,link:string,published:string,title:string>"
    raw = spark.read.schema(f"events array<struct<event_id:string,title:string,items:array<{item}>>>, items array<{item}>").option("multiLine", True).json(path)
    own = F.transform("items", lambda x: F.struct(stable_id(norm_url(x["link"])).alias("event_id"), x["title"].alias("title"), F.array(x).alias("items")))
    return raw.select(F.inline(F.coalesce("events", own)))


def scan_enabled_sources(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return scan_catalog(spark, path, schema).where("enabled")


def union_sources(*scans: DataFrame) -> DataFrame:
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def scan_story_json(spark: SparkSession, path: str, least: int = 30) -> DataFrame:
    """Hits of landed search answers with enough points: title, link (the item's page where it has none), published, signal;
    the first by answer order for each link."""
    schema = "hits array<struct<title:string,url:string,objectID:string,created_at_i:long,points:int,num_comments:int>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("hits").alias("at", "h"))
    return stories(raw.select("at", "h.*"), least)


def stories(hits: DataFrame, least: int = 30) -> DataFrame:
    page = F.concat(F.lit("https://news.ycombinator.com/item?id="), "objectID")
    kept = hits.where(F.coalesce("points", F.lit(0)) >= least).withColumn("link", F.coalesce(F.nullif("url", F.lit("")), page))
    first = kept.groupBy("link").agg(F.min_by(F.struct("title", "created_at_i", "points", "num_comments"), F.struct("at", "objectID")).alias("h"))
    return first.select(F.col("h.title").alias("title"), "link", F.timestamp_seconds("h.created_at_i").alias("published"), F.col("h.points").alias("signal"), F.coalesce("h.num_comments", F.lit(0)).alias("comments"))


POST = "uri string, text string, created string, likes int, embed string, facets array<string>, permalink string"


def scan_post_json(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """Landed posts, one a line, in the columns of POST."""
    return posts(spark.read.schema(POST).json(path), least)


def posts(rows: DataFrame, least: int = 10) -> DataFrame:
    """Posts with enough likes and a text: the link of the embed, else the first of the text, else the post's own."""
    link = F.coalesce(F.nullif("embed", F.lit("")), F.get(F.filter("facets", lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0)), F.col("permalink"))
    kept = rows.where((F.coalesce("likes", F.lit(0)) >= least) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return kept.select("uri", F.trim("text").alias("text"), link.alias("link"), F.col("likes").alias("signal"), "created")


BATCH = "schema_version int, batch_id string, ingested_at string, items array<struct<title:string,summary:string,reason:string,body:string,source_title:string,source_url:string,published:string,category:string,shelf:string,discovery_url:string,discovery_account:string>>"


def scan_manual_batch(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a reviewed batch with its header, numbered in order."""
    raw = spark.read.schema(BATCH).option("multiLine", True).json(path)
    return raw.select("schema_version", "batch_id", "ingested_at", F.posexplode("items").alias("place", "item")).select("schema_version", "batch_id", "ingested_at", "place", "item.*")


def scan_snapshots(spark: SparkSession, path: str, weeks: list[str]) -> DataFrame:
    """Rows of the asked weeks of a table by week_id, of weeks whose ids are all well formed: only their folders are read."""
    rows = spark.read.parquet(path).where(F.col("week_id").isin(*weeks))
    good = rows.groupBy("week_id").agg(F.min(F.coalesce(F.col("event_id").rlike("^[0-9a-f]{12}$"), F.lit(False)).cast("int")).alias("_ok")).where("_ok = 1").select("week_id")
    return rows.join(good, "week_id", "left_semi")


def scan_path_ids(spark: SparkSession, path: str, pattern: str = r"([0-9a-f]{12})\.html$") -> DataFrame:
    """Distinct ids in a listing of paths, one a line."""
    return path_ids(spark.read.text(path), pattern)


def path_ids(lines: DataFrame, pattern: str = r"([0-9a-f]{12})\.html$") -> DataFrame:
    return lines.select(F.regexp_extract("value", pattern, 1).alias("id")).where("id <> ''").distinct()
