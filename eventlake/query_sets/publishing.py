"""Publication, pushes and users. Orders stand in for events; their lines are the items, customers the users."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.operators import feeds
from eventlake.plans.stage import keep, shared_dir
from eventlake.plans.versions import VersionedTable
from eventlake.query_sets.registry import query, table
from eventlake.streaming import jobs, push

_ID = "substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12)"
_EV = f"""WITH src AS (SELECT l_orderkey AS o, string_agg(s, ',' ORDER BY f) AS names, count(*) AS n FROM (SELECT l_orderkey, 'S ' || l_suppkey AS s, min(l_linenumber * 1000000 + l_suppkey) AS f FROM lineitem GROUP BY ALL) GROUP BY 1),
 ev AS (SELECT o_orderkey, {_ID} AS event_id, 'o ' || o_orderkey AS title, CASE WHEN o_orderkey % 13 <> 0 THEN '订单' || o_orderkey ELSE '' END AS summary, o_orderpriority AS category, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 101 END AS importance, o_orderkey % 90 AS heat, o_orderkey % 40 = 0 AS pinned, o_orderdate AS published, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 5 HOUR END AS first_seen, coalesce(names, '') AS names, coalesce(n, 0) AS n, (SELECT max(o_orderdate) FROM orders) AS now FROM orders LEFT JOIN src ON o = o_orderkey)
"""


def events(spark: SparkSession, d: str) -> tuple[DataFrame, object]:
    li = table(spark, d, "lineitem")
    name = F.concat(F.lit(" S  "), F.col("l_suppkey").cast("string"), F.lit(" "))
    rows = li.groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list(F.struct((F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("k"), name.alias("source")))).alias("items"))
    o, i = table(spark, d, "orders"), F.col("o_orderkey")
    now = F.lit(o.agg(F.max("o_orderdate")).first()[0]).cast("timestamp_ntz")
    none = F.array().cast("array<string>")
    empty = F.array().cast("array<struct<k:bigint,source:string>>")
    e = o.join(rows, i == F.col("o"), "left").select(
        i, F.left(F.md5(i.cast("string")), F.lit(12)).alias("event_id"), F.concat(F.lit("o "), i.cast("string")).alias("title"), F.when(i % 13 != 0, F.concat(F.lit("订单"), i.cast("string"))).otherwise("").alias("summary"), F.lit(None).cast("string").alias("reason"),
        F.col("o_orderpriority").alias("category"), F.lit(None).cast("string").alias("category_label"), none.alias("vendors"), none.alias("topics"), F.when(i % 7 != 0, F.floor("o_totalprice") % 101).alias("importance"), (i % 90).alias("heat"), F.lit(None).cast("boolean").alias("star"),
        F.lit(None).cast("string").alias("shelf"), (i % 40 == 0).alias("pinned"), F.col("o_orderdate").alias("published"), F.when(i % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 5 HOURS")).alias("first_seen"), F.coalesce("items", empty).alias("items"),
    )
    return e, now


@query(_EV + "SELECT event_id, title, summary, '' AS reason, heat::INT AS heat, importance::INT AS importance, 'news' AS shelf, CASE WHEN o_orderkey % 2 = 0 THEN 'HN' ELSE 'RSS' END AS source_badge, pinned FROM ev")
def lite_projection(spark: SparkSession, d: str) -> DataFrame:
    e, _ = events(spark, d)
    badge = F.when(F.col("o_orderkey") % 2 == 0, "HN").otherwise("Nowhere")
    return feeds.lite_projection(e, badge).select("event_id", "title", "summary", "reason", "heat", "importance", "shelf", "source_badge", "pinned")


@query(_EV + "SELECT event_id, CASE WHEN summary = '' THEN 'empty' WHEN category NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'category' WHEN coalesce(importance, 50) < 30 THEN 'importance' WHEN NOT (pinned OR coalesce(importance, 50) <> 50) THEN 'signal' WHEN n = 0 THEN 'source' END AS reason FROM ev")
def list_eligibility(spark: SparkSession, d: str) -> DataFrame:
    e, _ = events(spark, d)
    c = F.col
    why = feeds.eligible_reason(c("title"), c("summary"), c("category"), c("importance"), c("pinned"), F.get("items", F.lit(0))["source"], F.coalesce("published", "first_seen"), ["1-URGENT", "2-HIGH", "3-MEDIUM"])
    return e.select("event_id", why.alias("reason"))


_WHY = "CASE WHEN pinned THEN 'pinned' WHEN importance >= 80 THEN 'importance' WHEN importance >= 75 AND n >= 2 THEN 'multi_source' END"


@query(_EV + f"SELECT event_id, names, n AS count, {_WHY} AS reason, coalesce(first_seen, published) AS discovered_at, 'https://x.example/e/' || event_id || '.html' AS detail FROM ev WHERE coalesce(first_seen, published) BETWEEN now - INTERVAL 7 DAY AND now")
def agent_feed(spark: SparkSession, d: str) -> DataFrame:
    e, now = events(spark, d)
    f = feeds.agent_feed(e, now, "https://x.example/")
    return f.select("event_id", F.array_join("sources.names", ",").alias("names"), F.col("sources.count").cast("long").alias("count"), F.col("push.reason").alias("reason"), "discovered_at", F.col("links.detail").alias("detail"))


@query(_EV + """, f AS (SELECT *, coalesce(first_seen, published) AS t, o_orderkey AS position FROM ev WHERE coalesce(first_seen, published) BETWEEN now - INTERVAL 7 DAY AND now),
 g AS (SELECT *, lag((t, coalesce(importance, 0), event_id)) OVER (ORDER BY position) AS last FROM f)
 SELECT event_id, position, concat_ws(',', CASE WHEN summary = '' THEN 'content' END, CASE WHEN position % 5 = 0 THEN 'detail_url' END, CASE WHEN (t, coalesce(importance, 0), event_id) > last THEN 'order' END) AS errors FROM g""")
def feed_errors(spark: SparkSession, d: str) -> DataFrame:
    """A feed in the wrong order, with every fifth link wrong."""
    e, now = events(spark, d)
    at = e.select("event_id", F.col("o_orderkey").alias("position"))
    f = feeds.agent_feed(e, now, "https://x.example").join(at, "event_id")
    wrong = f.withColumn("links", F.when(F.col("position") % 5 == 0, F.struct(F.lit("x").alias("detail"))).otherwise(F.col("links")))
    return feeds.validate_feed(wrong, "https://x.example").withColumn("errors", F.array_join("errors", ","))


@query("SELECT '$.k' AS path, count(*) AS rows FROM events UNION ALL SELECT '$.a[*].body', count(*) FROM events WHERE event_id % 3 = 0 UNION ALL SELECT '$.a[*].b.media', count(*) FROM events WHERE event_id % 5 = 0")
def forbidden_keys(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    inner = F.concat(F.lit('{"k": 1, "a": [{"x": 1}, {'), F.when(i % 3 == 0, '"body": "t"').otherwise('"y": null'), F.when(i % 5 == 0, ', "b": {"media": []}').otherwise(""), F.lit("}]}"))
    return feeds.forbidden_keys(table(spark, d, "events").select("event_id", inner.alias("json")), "json", "event_id", ("k", "body", "media"), 4)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id % 2 = 0 AS strict FROM events")
def json_objects(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    wrapped = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("here: "), "props", F.lit(" thanks")))
    e = e.select("event_id", wrapped.alias("t"))
    return e.select("event_id", F.try_variant_get(feeds.parse_object(F.col("t")), "$.k", "int").alias("k"), feeds.parse_object(F.col("t"), strict=True).isNotNull().alias("strict"))


@query("SELECT page_id, 'body ' || page_id AS body FROM pages")
def jsonld_bodies(spark: SparkSession, d: str) -> DataFrame:
    script = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"articleBody": "body '), F.col("page_id").cast("string"), F.lit('"}]}</script>'))
    return table(spark, d, "pages").select("page_id", F.array_join(feeds.jsonld_bodies(F.concat("html", script)), "|").alias("body"))


@query(_EV + "SELECT 'https://x/' || event_id AS id, concat_ws(',', CASE WHEN o_orderkey % 4 = 0 THEN 'link' END, CASE WHEN o_orderkey % 4 = 0 THEN 'https' END, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'times' END, CASE WHEN summary = '' THEN 'summary' END) AS errors FROM ev")
def atom_errors(spark: SparkSession, d: str) -> DataFrame:
    e, _ = events(spark, d)
    i = F.col("o_orderkey")
    url = F.concat(F.lit("https://x/"), "event_id")
    entries = e.select(url.alias("id"), F.when(i % 4 == 0, "http://y").otherwise(url).alias("link"), F.when(i % 2 == 0, F.coalesce("first_seen", "published")).otherwise(F.col("published")).alias("published"), F.when(i % 2 == 0, F.col("published")).otherwise(F.coalesce("first_seen", "published")).alias("updated"), "title", "summary")
    return feeds.validate_atom(entries).withColumn("errors", F.array_join("errors", ","))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS event_id, count(*) AS rows, CASE WHEN NOT regexp_matches(CAST(l_orderkey AS VARCHAR), '^[0-9]{3}$') THEN 'malformed' ELSE 'duplicate' END AS error FROM lineitem GROUP BY 1 HAVING count(*) > 1 OR NOT regexp_matches(CAST(l_orderkey AS VARCHAR), '^[0-9]{3}$')")
def id_errors(spark: SparkSession, d: str) -> DataFrame:
    return feeds.id_errors(table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("event_id")), pattern="^[0-9]{3}$")


@query("SELECT strftime(o_orderdate, '%G-W%V') AS week_id, count(*) AS items FROM orders GROUP BY 1 HAVING min(o_orderkey) % 3 <> 0")
def weekly_archive_index(spark: SparkSession, d: str) -> DataFrame:
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), "o_orderdate").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("o_orderdate").cast("string"), 2, "0"))
    w = table(spark, d, "orders").groupBy(week.alias("week_id")).agg(F.count("*").alias("items"), (F.min("o_orderkey") % 3 != 0).alias("valid"))
    return feeds.weekly_archive_index(w).select("week_id", "items")


@query("SELECT c_custkey AS user_id, CASE WHEN c_custkey % 9 = 0 THEN 0 ELSE (SELECT count(*) FROM orders WHERE o_orderdate + to_hours(CAST(o_orderkey % 24 AS INT)) > TIMESTAMP '1997-01-01' + to_hours(CAST(c_custkey * 31 AS INT))) END AS new FROM customer")
def new_since_visit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").select(F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int))").alias("first_seen"))
    v = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 9 != 0, F.expr("timestamp_ntz'1997-01-01' + make_dt_interval(0, cast(c_custkey * 31 as int))")).alias("last"))
    return feeds.new_since(e, v)


@query("SELECT p_partkey, array_to_string(list_filter([p_brand, p_type], lambda x: x IN ('Brand#1', 'Brand#2', 'ECONOMY')), ',') AS reasons FROM part")
def match_reasons(spark: SparkSession, d: str) -> DataFrame:
    r = feeds.match_reasons(F.array("p_brand"), F.array("p_type"), F.array(F.lit("Brand#1"), F.lit("Brand#2")), F.array(F.lit("ECONOMY")))
    return table(spark, d, "part").select("p_partkey", F.array_join(r, ",").alias("reasons"))


@query("SELECT o_custkey AS user_id, count(DISTINCT substr(o_orderpriority, 1, 3)) AS topics, least(2, count(DISTINCT o_orderkey)) AS favourites FROM orders GROUP BY 1")
def follow_state(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    u = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.collect_list(F.concat(F.lit(" "), "o_orderpriority")).alias("t"), F.collect_list(F.col("o_orderkey").cast("string")).alias("f"))
    s = feeds.follow_state(F.col("t"), none, F.col("f"), none, (50, 50, 2, 500), (3, 80, 80, 80))
    return u.select("user_id", F.size(s["topics"]).cast("long").alias("topics"), F.size(s["favourites"]).cast("long").alias("favourites"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'unknown' END AS name, 'other' AS page, substr(props, 1, 80) AS object, CAST(least(100000, greatest(0, floor(value * 5000 - 1000))) AS INT) AS value FROM events")
def sanitize_behavior(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("name"), F.lit("x").alias("page"), F.col("props").alias("object"), (F.col("value") * 5000 - 1000).alias("value"))
    return feeds.sanitize_behavior(e, ["view", "click"], ["home"])


# --- pushes ----------------------------------------------------------------------------------------------------------

_POLL = _EV + f""", p AS (SELECT event_id, importance::INT AS importance, {_WHY} IS NOT NULL AS rec, coalesce(first_seen, published) AS t, now, o_orderkey AS o FROM ev),
 s AS (SELECT event_id, CASE o % 11 WHEN 0 THEN 'sent' WHEN 1 THEN 'failed' WHEN 2 THEN 'pending' WHEN 3 THEN 'attempted' ELSE 'seen' END AS status, rec AND o % 2 = 0 AS was FROM p WHERE o % 5 <> 0),
 n AS (SELECT p.*, CASE WHEN s.status IN ('sent', 'attempted', 'failed') THEN s.status WHEN rec AND s.status = 'pending' THEN 'pending' WHEN rec AND NOT coalesce(was, false) THEN CASE WHEN t BETWEEN now - INTERVAL 480 HOUR AND now THEN 'pending' ELSE 'expired' END WHEN NOT rec AND s.status = 'pending' THEN 'seen' ELSE coalesce(s.status, 'seen') END AS status FROM p LEFT JOIN s USING (event_id))
"""


def polled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, object]:
    e, now = events(spark, d)
    why = feeds.push_reason(F.col("pinned"), F.coalesce("importance", F.lit(0)), F.size(feeds.unique_sources(F.col("items"))))
    feed = keep(e.select("event_id", F.col("importance").cast("int").alias("importance"), why.isNotNull().alias("recommended"), F.coalesce("first_seen", "published").alias("discovered"), F.col("o_orderkey").alias("o")), "polled")
    i = F.col("o") % 11
    status = F.when(i == 0, "sent").when(i == 1, "failed").when(i == 2, "pending").when(i == 3, "attempted").otherwise("seen")
    state = feed.where("o % 5 <> 0").select("event_id", "importance", (F.col("recommended") & (F.col("o") % 2 == 0)).alias("recommended"), status.alias("status"), now.alias("last_seen"), F.lit(None).cast("timestamp_ntz").alias("attempted"))
    return state, feed.drop("o"), now


@query(_POLL + "SELECT event_id, status FROM n")
def push_states(spark: SparkSession, d: str) -> DataFrame:
    state, feed, now = polled(spark, d)
    return push.advance(state, feed, now, 480).select("event_id", "status")


@query(_POLL + "SELECT event_id, row_number() OVER (ORDER BY coalesce(importance, 0) DESC, t DESC, event_id DESC)::INT AS place FROM n WHERE status = 'pending' AND t BETWEEN now - INTERVAL 480 HOUR AND now ORDER BY place LIMIT 2")
def push_selection(spark: SparkSession, d: str) -> DataFrame:
    """Three for a run and five for a day, of which three are used up."""
    state, feed, now = polled(spark, d)
    attempts = spark.range(1).select(F.to_date(now + F.expr("INTERVAL 8 HOURS")).alias("day"), F.lit(3).alias("n"))
    return push.select_pushes(keep(push.advance(state, feed, now, 480), "push-state"), feed, attempts, now, max_age_hours=480)


@query("SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 10 = 0 THEN 'gone' WHEN o_orderkey % 10 = 1 THEN 'new' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 10 < 2 OR o_orderkey % 7 = 0")
def feed_changes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), "o_totalprice", "o_orderstatus")
    after = o.where("event_id % 10 <> 0").withColumn("o_orderstatus", F.when(F.col("event_id") % 7 == 0, "?").otherwise(F.col("o_orderstatus")))
    return push.changed(o.where("event_id % 10 <> 1"), after)


@query("""WITH RECURSIVE c AS (SELECT user_id || ':' || event_type AS key, event_id, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
r AS (SELECT key, event_id, at_ms, n, true AS kept, at_ms AS last FROM c WHERE n = 1
 UNION ALL SELECT c.key, c.event_id, c.at_ms, c.n, c.at_ms - last >= 10800000, CASE WHEN c.at_ms - last >= 10800000 THEN c.at_ms ELSE last END FROM r JOIN c ON c.key = r.key AND c.n = r.n + 1)
SELECT key, event_id, at_ms FROM r WHERE kept""")
def stream_click_dedup(spark: SparkSession, d: str) -> DataFrame:
    with jobs.rocks(spark):
        return jobs.drain(jobs.click_dedup(jobs.read_events(spark, d), 3 * 3600 * 1000))


@query("SELECT user_id || ':' || event_type AS event, min(ts) AS first_seen, max(ts) AS last_seen, max(event_id) AS importance, arg_min(props, (ts, props)) AS title FROM events WHERE event_type <> 'error' GROUP BY ALL")
def stream_merged_reports(spark: SparkSession, d: str) -> DataFrame:
    """Events of users and kinds, merged with what is stored as their reports land."""
    top = f"{shared_dir(spark).rstrip('/')}/eventlake/reports-{uuid.uuid4().hex}"
    own = F.concat_ws(":", "user_id", "event_type")
    rows = jobs.read_events(spark, d).select(own.alias("event"), "ts", F.col("event_id").alias("importance"), F.col("props").alias("title"), "event_type")
    target = VersionedTable(spark, f"{top}/table", jobs.EVENT, "event")
    jobs.ingest_reports(rows, target, F.col("event_type") != "error", f"{top}/state")
    return target.read().withColumn("first_seen", F.col("first_seen").cast("timestamp_ntz")).withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The first event of each user and kind that lands."""
    target = f"{shared_dir(spark).rstrip('/')}/eventlake/ingest-{uuid.uuid4().hex}"
    rows = jobs.read_events(spark, d).select(F.concat_ws(":", "user_id", "event_type").alias("key"), "event_id", "user_id", "event_type")
    jobs.ingest(rows, "key", target)
    return spark.read.parquet(target).select("user_id", "event_type", "event_id")
