"""Reviewed batches, reports and checks. Orders and their lines stand in for events, pages for reviewed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.operators import reviews
from eventlake.query_sets.registry import query, table
from eventlake.sources import scans

_ROWS = """WITH r AS (SELECT page_id AS place, CASE WHEN page_id % 9 = 0 THEN ' ' ELSE 't' END AS title, 'http://h/' || page_id % 40 || CASE WHEN page_id % 2 = 0 THEN '?utm_a=1&source=x' ELSE '' END AS url, 'http://h/' || page_id % 40 AS norm, CASE page_id % 3 WHEN 0 THEN 'http://d/' || page_id WHEN 1 THEN '' END AS disc, page_id % 5 <> 0 AS acc, CASE WHEN page_id % 4 = 0 THEN 'odd' ELSE 'agent' END AS category, CASE WHEN page_id % 6 = 0 THEN 'soon' ELSE '2024-01-02' END AS published FROM pages)
"""


def rows(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("page_id")
    s = i.cast("string")
    fill = [F.lit("x").alias(c) for c in ("summary", "reason", "body", "source_title")]
    return table(spark, d, "pages").select(
        i.alias("place"), F.when(i % 9 == 0, " ").otherwise("t").alias("title"), *fill, F.concat(F.lit("http://h/"), (i % 40).cast("string"), F.when(i % 2 == 0, "?utm_a=1&source=x").otherwise("")).alias("source_url"),
        F.when(i % 3 == 0, F.concat(F.lit("http://d/"), s)).when(i % 3 == 1, "").alias("discovery_url"), F.when(i % 5 != 0, "acc").alias("discovery_account"), F.when(i % 4 == 0, "odd").otherwise("agent").alias("category"), F.lit(None).cast("string").alias("shelf"), F.when(i % 6 == 0, "soon").otherwise("2024-01-02").alias("published"),
    )


@query(_ROWS + "SELECT place, concat_ws(',', CASE WHEN title = ' ' THEN 'missing_title' END, CASE WHEN category = 'odd' THEN 'category' END, CASE WHEN published = 'soon' THEN 'published' END, CASE WHEN (coalesce(disc, '') = '') <> NOT acc THEN 'discovery_pair' END, CASE WHEN count(*) OVER (PARTITION BY norm) > 1 THEN 'duplicate_url' END) AS errors FROM r")
def batch_errors(spark: SparkSession, d: str) -> DataFrame:
    return reviews.validate_batch(rows(spark, d), ["agent"]).select("place", F.array_join("errors", ",").alias("errors"))


_MATCH = _ROWS + """, k AS (SELECT o_orderkey AS event, 'http://h/' || o_orderkey AS norm FROM orders WHERE o_orderkey % 2 = 0), h AS (SELECT o_orderkey AS event, 'http://d/' || o_orderkey AS disc FROM orders WHERE o_orderkey % 4 = 0),
 m AS (SELECT place, k.event, CASE WHEN k.event IS NULL THEN 'added' WHEN coalesce(r.disc, '') <> '' AND h.event IS NULL THEN 'enriched' ELSE 'unchanged' END AS outcome FROM r LEFT JOIN k USING (norm) LEFT JOIN h ON h.event = k.event AND h.disc = r.disc)
"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event"))
    s = F.col("event").cast("string")
    links = o.where("event % 2 = 0").select("event", F.concat(F.lit("HTTP://H/"), s, F.lit("/")).alias("link")).union(o.where("event % 4 = 0").select("event", F.concat(F.lit("http://d/"), s).alias("link")))
    return reviews.match_batch(rows(spark, d), links)


@query(_MATCH + "SELECT place, event, outcome FROM m")
def batch_match(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).select("place", "event", "outcome")


@query(_MATCH + "SELECT count(*) AS records, count(*) FILTER (WHERE outcome = 'added') AS added, count(*) FILTER (WHERE outcome = 'enriched') AS enriched, count(*) FILTER (WHERE outcome = 'unchanged') AS unchanged FROM m")
def batch_report(spark: SparkSession, d: str) -> DataFrame:
    return reviews.batch_report(_matched(spark, d))


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 7 = 0 THEN '$:required.name' END, CASE WHEN o_orderkey % 7 <> 0 AND length(o_orderpriority) < 6 THEN '$.name:minLength' END, CASE WHEN o_custkey > 100 THEN '$.n:maximum' END, CASE WHEN o_orderstatus = 'P' THEN '$.status:enum' END, CASE WHEN o_orderkey % 2 = 0 THEN '$.tags:uniqueItems' END, CASE WHEN o_orderkey % 5 = 0 THEN '$.tags[*]:pattern' END) AS errors FROM orders""")
def row_schema_errors(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    tag = F.when(i % 5 == 0, "9").otherwise("a")
    row = F.struct(F.when(i % 7 != 0, F.col("o_orderpriority")).alias("name"), F.col("o_custkey").alias("n"), F.col("o_orderstatus").alias("status"), F.array(tag, F.when(i % 2 == 0, tag).otherwise("b")).alias("tags"))
    schema = {"type": "object", "required": ["name"], "properties": {"name": {"type": "string", "minLength": 6}, "n": {"type": "integer", "maximum": 100}, "status": {"type": "string", "enum": ["F", "O"]}, "tags": {"type": "array", "uniqueItems": True, "items": {"type": "string", "pattern": "^[a-z]$"}}}}
    return table(spark, d, "orders").select("o_orderkey", F.array_join(reviews.schema_errors(schema, row), ",").alias("errors"))


def _tags(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    task = F.when(i % 3 == 0, F.array("o_orderstatus", "o_orderstatus")).otherwise(F.array("o_orderstatus"))
    return table(spark, d, "orders").select(i.alias("event_id"), F.when(i % 11 != 0, F.struct(task.alias("task"), F.array(F.substring("o_orderpriority", 1, 1)).alias("role"))).alias("tags"))


@query("SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' ELSE concat_ws(',', CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'task_unknown' END, CASE WHEN o_orderkey % 3 = 0 THEN 'task_repeated' END, CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN 'role_unknown' END) END AS errors FROM orders")
def tag_errors(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = {"task": ["F", "O"], "role": ["1", "2", "3", "4"]}
    return _tags(spark, d).select("event_id", F.array_join(reviews.tag_errors(F.col("tags"), vocabulary), ",").alias("errors"))


@query("WITH t AS (SELECT 'task' AS dimension, o_orderstatus AS value FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT 'role', substr(o_orderpriority, 1, 1) FROM orders WHERE o_orderkey % 11 <> 0) SELECT dimension, value, count(*) AS rows, round_even(count(*) / (SELECT count(*) FROM orders), 4) AS share FROM t GROUP BY ALL")
def tag_audit(spark: SparkSession, d: str) -> DataFrame:
    return reviews.tag_audit(_tags(spark, d), ["task", "role"])


@query("SELECT l_shipmode AS strategy, l_returnflag AS quality, l_linestatus AS mode, CAST(l_suppkey % 5 AS VARCHAR) AS source, count(*) AS attempted, count(*) FILTER (WHERE l_quantity > 10) AS ready, sum(l_linenumber)::BIGINT AS figures, sum(l_partkey % 3)::BIGINT AS tables FROM (SELECT *, 's' || l_linenumber % 4 AS l_shipmode FROM lineitem) GROUP BY GROUPING SETS ((l_shipmode), (l_returnflag), (l_linestatus), (CAST(l_suppkey % 5 AS VARCHAR)), ())")
def extraction_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    r = table(spark, d, "lineitem").select(F.concat(F.lit("s"), (c("l_linenumber") % 4).cast("string")).alias("strategy"), c("l_returnflag").alias("quality"), c("l_linestatus").alias("mode"), (c("l_suppkey") % 5).cast("string").alias("source"), (c("l_quantity") > 10).alias("ready"), c("l_linenumber").alias("figures"), (c("l_partkey") % 3).alias("tables"))
    return reviews.extraction_metrics(r)


@query("SELECT count(*) AS events, count(*) FILTER (WHERE p_size > 5) AS structured, count(*) FILTER (WHERE p_size > 5 AND p_retailprice >= 950) AS renderable, count(*) FILTER (WHERE p_size > 5 AND p_type = 'PROMO') AS suspect, count(*) FILTER (WHERE p_size > 5 AND p_partkey % 3 > 0) AS trimmed, count(*) FILTER (WHERE p_size > 5 AND (p_brand <> 'Brand#1' OR p_brand IS NULL)) AS debt FROM part")
def catalog_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    b = table(spark, d, "part").select((c("p_size") - 5).alias("blocks"), c("p_retailprice").alias("chars"), F.when(c("p_type") == "PROMO", "suspect").otherwise("pass").alias("quality"), (c("p_partkey") % 3).alias("removed"), c("p_brand").alias("version"))
    return reviews.catalog_metrics(b, 950, "Brand#1")


@query(_ROWS + ", e AS (SELECT CASE WHEN title = ' ' THEN 'missing_title' END AS a, CASE WHEN category = 'odd' THEN 'category' END AS b, CASE WHEN published = 'soon' THEN 'published' END AS c, CASE WHEN (coalesce(disc, '') = '') <> NOT acc THEN 'discovery_pair' END AS d, CASE WHEN count(*) OVER (PARTITION BY norm) > 1 THEN 'duplicate_url' END AS e FROM r) SELECT error, count(*) AS rows FROM (SELECT unnest([a, b, c, d, e]) AS error FROM e) WHERE error IS NOT NULL GROUP BY error")
def error_summary(spark: SparkSession, d: str) -> DataFrame:
    return reviews.error_summary(reviews.validate_batch(rows(spark, d), ["agent"]))


_CLASSICS = "WITH e AS (SELECT o_orderkey AS event_id, unnest(CASE WHEN o_orderkey % 5 = 0 THEN ['t' || o_custkey % 6] ELSE ['t' || o_custkey % 6, 'u' || o_custkey % 4] END) AS topic, o_orderkey % 30 = 0 AS pinned, CAST(floor(o_totalprice) AS BIGINT) % 101 AS importance, o_orderdate AS published FROM orders WHERE o_orderstatus = 'F') "


def _classics(spark: SparkSession, d: str) -> DataFrame:
    i, t, u = F.col("o_orderkey"), F.concat(F.lit("t"), (F.col("o_custkey") % 6).cast("string")), F.concat(F.lit("u"), (F.col("o_custkey") % 4).cast("string"))
    return table(spark, d, "orders").select(i.alias("event_id"), F.when(i % 5 == 0, F.array(t)).otherwise(F.array(t, u)).alias("topics"), (F.col("o_orderstatus") == "F").alias("evergreen"), (i % 30 == 0).alias("pinned"), (F.floor("o_totalprice") % 101).alias("importance"), F.col("o_orderdate").alias("published"))


@query(_CLASSICS + "SELECT topic, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY pinned DESC, importance DESC, published DESC, event_id) AS place FROM e) WHERE place <= 3")
def reading_list(spark: SparkSession, d: str) -> DataFrame:
    return reviews.reading_list(_classics(spark, d))


@query(_CLASSICS + ", k AS (SELECT DISTINCT topic, event_id FROM e WHERE topic IN ('t1', 't2', 'u3')) SELECT topic, event_id FROM k UNION ALL SELECT 'other', event_id FROM (SELECT DISTINCT event_id FROM e) WHERE event_id NOT IN (SELECT event_id FROM k)")
def classics_by_topic(spark: SparkSession, d: str) -> DataFrame:
    known = spark.range(1).select(F.explode(F.array(F.lit("t1"), F.lit("t2"), F.lit("u3"))).alias("topic"))
    return reviews.classics_by_topic(_classics(spark, d), known)


@query("SELECT n_name AS name, row_number() OVER (ORDER BY n_nationkey % 5 <> 3, CASE WHEN n_nationkey % 5 = 3 THEN -n_nationkey ELSE n_nationkey END, n_name)::INT AS place FROM nation")
def priority_union(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    first = n.where("n_nationkey % 5 = 3").select(F.col("n_name").alias("name"), (-F.col("n_nationkey")).alias("rank")).union(spark.range(1).select(F.lit("nowhere"), F.lit(0)))
    return reviews.priority_union(first, n.select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("rank")))


@query("SELECT user_id || ':' || CAST(ts AS DATE) AS session, CAST(json_extract_string(props, '$.k') AS INT) AS object FROM events WHERE event_type = 'view' INTERSECT SELECT user_id || ':' || CAST(ts AS DATE), CAST(json_extract_string(props, '$.k') AS INT) FROM events WHERE event_type = 'click'")
def intersect_pairs(spark: SparkSession, d: str) -> DataFrame:
    pair = [F.concat_ws(":", "user_id", F.to_date("ts")).alias("session"), F.get_json_object("props", "$.k").cast("int").alias("object")]
    e = table(spark, d, "events")
    return e.where("event_type = 'view'").select(*pair).intersect(e.where("event_type = 'click'").select(*pair))


@query("SELECT page_id, regexp_matches(html, '(?is)<meta\\s[^>]*name=[\"'']?(?:robots|googlebot)[\"'']?[^>]*noimageindex') OR page_id % 3 = 0 AS noindex FROM pages")
def no_image_index(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat("html", F.when(F.col("page_id") % 3 == 0, '<META name="Robots" content="NoImageIndex">').otherwise('<meta name="x" content="noimageindex">'))
    return table(spark, d, "pages").select("page_id", reviews.no_image_index(html).alias("noindex"))


@query("SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 101 >= 75 AS star FROM orders")
def star(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", reviews.star(F.floor("o_totalprice") % 101).alias("star"))


@query("WITH h AS (SELECT CASE WHEN l_partkey % 4 = 0 THEN 'https://news.ycombinator.com/item?id=' || l_orderkey ELSE 'u' || l_suppkey END AS link, l_orderkey * 10 + l_linenumber AS pos, l_orderkey, l_partkey, CAST(l_quantity AS INT) AS points FROM lineitem WHERE l_quantity >= 30) SELECT link, min_by('t' || l_partkey, (pos, CAST(l_orderkey AS VARCHAR), l_partkey)) AS title FROM h GROUP BY link")
def stories(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    hits = table(spark, d, "lineitem").select(F.struct((c("l_orderkey") * 10 + c("l_linenumber")).alias("pos"), c("l_orderkey").cast("string").alias("order"), c("l_partkey").alias("part")).alias("at"), F.concat(F.lit("t"), c("l_partkey").cast("string")).alias("title"), F.when(c("l_partkey") % 4 != 0, F.concat(F.lit("u"), c("l_suppkey").cast("string"))).alias("url"), c("l_orderkey").cast("string").alias("objectID"), F.lit(0).cast("long").alias("created_at_i"), c("l_quantity").cast("int").alias("points"), F.lit(None).cast("int").alias("num_comments"))
    return scans.stories(hits).select("link", "title")


@query("SELECT doc_id, trim(text) AS text, CASE WHEN doc_id % 3 = 0 THEN 'e' || doc_id WHEN doc_id % 3 = 1 THEN 'f' || doc_id ELSE 'p' || doc_id END AS link FROM documents WHERE n_chars >= 100 AND trim(coalesce(text, '')) <> ''")
def posts(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    s = i.cast("string")
    rows_ = table(spark, d, "documents").select(i.alias("uri"), "text", F.lit(None).cast("string").alias("created"), F.col("n_chars").cast("int").alias("likes"), F.when(i % 3 == 0, F.concat(F.lit("e"), s)).otherwise("").alias("embed"), F.when(i % 3 == 1, F.array(F.lit(""), F.concat(F.lit("f"), s))).alias("facets"), F.concat(F.lit("p"), s).alias("permalink"))
    return scans.posts(rows_, 100).select(F.col("uri").alias("doc_id"), "text", "link")


@query("SELECT DISTINCT substr(md5(CAST(o_custkey AS VARCHAR)), 1, 12) AS id FROM orders WHERE o_orderkey % 3 <> 0")
def path_ids(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    line = F.concat(F.lit("site/e/"), F.left(F.md5(F.col("o_custkey").cast("string")), F.lit(12)), F.when(i % 3 != 0, ".html").otherwise(".json"))
    return scans.path_ids(table(spark, d, "orders").select(line.alias("value")))
