"""Single rules on whole tables: chunks, bodies, caches, accounts, labels, dates, buckets, and what sinks and scans give back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.functions import scores, text
from eventlake.operators import caches, extract, merge, prefilter, trim
from eventlake.plans.stage import shared_dir
from eventlake.query_sets.registry import query, table
from eventlake.sources import scans, sinks

_SPLIT = r"list_filter(string_split(regexp_replace(coalesce(text, ''), '([。！？.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


@query(rf"""WITH s AS (SELECT doc_id, {_SPLIT} AS s FROM documents), c AS (SELECT doc_id, list_reduce(list_transform(s, lambda x: [x]), lambda a, x: CASE WHEN length(a[len(a)]) + length(x[1]) > 600 THEN a || x ELSE a[1:len(a) - 1] || [a[len(a)] || ' ' || x[1]] END) AS c FROM s WHERE len(s) > 0)
 SELECT doc_id, unnest(generate_series(1, least(6, len(c))))::INT AS place, md5(unnest(c[1:6])) AS chunk FROM c""")
def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = F.posexplode(scores.sentence_chunks(F.col("text"), 600, 6)).alias("at", "chunk")
    return table(spark, d, "documents").select("doc_id", chunks).select("doc_id", (F.col("at") + 1).alias("place"), F.md5("chunk").alias("chunk"))


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n[ \t\n\f\r]*\n'), lambda p: regexp_replace(p, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')), lambda p: p <> '') AS p FROM documents),
 q AS (SELECT doc_id, flatten(list_transform(p, lambda x: list_transform(range((length(x) - 1) // 500 + 1), lambda i: substr(x, i * 500 + 1, 500)))) AS q FROM p),
 c AS (SELECT doc_id, list_reduce(list_transform(q, lambda x: [x]), lambda a, x: CASE WHEN length(a[len(a)]) + length(x[1]) + 2 > 500 THEN a || x ELSE a[1:len(a) - 1] || [a[len(a)] || chr(10) || chr(10) || x[1]] END) AS c FROM q WHERE len(q) > 0)
 SELECT doc_id, unnest(generate_series(1, len(c)))::INT AS place, md5(unnest(c)) AS chunk FROM c""")
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = F.posexplode(scores.paragraph_chunks(F.col("text"), 500)).alias("at", "chunk")
    return table(spark, d, "documents").select("doc_id", chunks).select("doc_id", (F.col("at") + 1).alias("place"), F.md5("chunk").alias("chunk"))


@query("""WITH l AS (SELECT conv_id, list(length(text) ORDER BY turn) AS z, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
 SELECT conv_id, t[i] AS turn, (list_reduce(list_transform(z[1:i], lambda x: [x, 0]), lambda a, s: CASE WHEN a[1] + s[1] > 900 AND a[1] > 0 THEN [s[1], a[2] + 1] ELSE [a[1] + s[1], a[2]] END))[2]::INT AS batch FROM l, generate_series(1, 8) g(i) WHERE i <= len(z)""")
def node_batches(spark: SparkSession, d: str) -> DataFrame:
    """Turns as text nodes, in batches of 900 characters."""
    rows = F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n"))))
    packed = table(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("r")).withColumn("b", scores.batch_numbers(F.transform("r", lambda x: x["n"]), 900))
    return packed.select("conv_id", F.inline(F.arrays_zip(F.transform("r", lambda x: x["turn"]).alias("turn"), F.col("b").alias("batch"))))


@query("""WITH l AS (SELECT l_orderkey AS event_id, list([CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END, CAST(l_quantity AS BIGINT), k] ORDER BY k) AS r FROM (SELECT *, l_linenumber * 1000000000000 + l_suppkey * 1000000 + l_partkey AS k FROM lineitem) GROUP BY 1)
 SELECT event_id, (list_reduce(r, lambda a, s: CASE WHEN (s[1] = 1 AND a[1] = 0) OR s[2] > a[2] THEN s ELSE a END))[3] AS item FROM l""")
def merged_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Lines as reports: their quantity is the length of a body, returned ones hold the original text."""
    k = F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_suppkey") * 1000000 + F.col("l_partkey")
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), k.alias("seq"), k.alias("item"), F.when(F.col("l_returnflag") == "A", "original").otherwise("feed").alias("mode"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("body"))
    return merge.choose_merged_body(items)


@query("""WITH a AS (SELECT o_orderkey AS id, 'w' || o_orderkey % 200 AS week_id, 'm' || o_orderkey % 2 AS model FROM orders)
 SELECT id, CASE WHEN id % 200 >= 150 THEN 'absent' WHEN id % 3 = 0 AND id % 2 = 0 THEN 'hit' ELSE 'changed' END AS reason FROM a""")
def weekly_cache_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Weeks of orders; what is stored was made by one model from inputs of one kind."""
    i = F.col("o_orderkey")
    asked = table(spark, d, "orders").select(i.alias("id"), F.concat(F.lit("w"), (i % 200).cast("string")).alias("week_id"), F.when(i % 3 == 0, "input").otherwise("other").alias("input_hash"), F.lit("b").alias("baseline_hash"), F.lit("p1").alias("prompt_version"), F.lit(2).alias("schema_version"), F.concat(F.lit("m"), (i % 2).cast("string")).alias("model"))
    made = spark.range(150).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("week_id"), F.lit("input").alias("input_hash"), F.lit("b").alias("baseline_hash"), F.lit("p1").alias("prompt_version"), F.lit(2).alias("schema_version"), F.lit("m0").alias("model"))
    stored = made.select(caches.weekly_key().alias("key"), "week_id", F.lit("text").alias("entry"))
    return caches.weekly_lookup(asked, stored).select("id", "reason")


@query("""WITH c AS (SELECT 'r' || user_id % 7 AS run_id, event_type AS purpose, 's' || user_id AS source, ts::DATE AS day, event_type <> 'error' AS success, event_id % 3 <> 0 AS usage_reported, event_id % 100 AS total, 50 AS reserved FROM events)
 SELECT run_id, purpose, source, day, count(*) AS calls, count(*) FILTER (NOT success) AS failures, sum(total)::BIGINT AS total_tokens, sum(CASE WHEN usage_reported THEN total ELSE reserved END)::BIGINT AS accounted_tokens FROM c GROUP BY GROUPING SETS ((run_id), (purpose), (source), (day), ())""")
def usage_accounts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    calls = table(spark, d, "events").select(F.concat(F.lit("r"), (c("user_id") % 7).cast("string")).alias("run_id"), c("event_type").alias("purpose"), F.concat(F.lit("s"), c("user_id").cast("string")).alias("source"), F.to_date("ts").alias("day"), (c("event_type") != "error").alias("success"), (c("event_id") % 3 != 0).alias("usage_reported"), (c("event_id") % 100).alias("total_tokens"), F.lit(50).alias("reserved"))
    return caches.usage_accounts(calls)


@query("""WITH b AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'user' THEN 0 ELSE length(text) END AS n FROM conversations), s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
 SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE left(text, (700 - before)::BIGINT) END AS text FROM s WHERE role = 'user' OR before < 700 OR (before = 700 AND n = 0)""")
def limited_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Turns as blocks: 700 characters of each conversation, and whatever users say."""
    return extract.limit_blocks(table(spark, d, "conversations"), 700, ("user",), "conv_id", "turn", "role").select("conv_id", "turn", "text")


@query("SELECT l_shipmode AS category, count(*) AS records, count(*) FILTER (relabelled) AS relabelled FROM (SELECT l_returnflag AS l_shipmode, l_returnflag IN ('A', 'R') AND l_linestatus <> CASE l_returnflag WHEN 'A' THEN 'F' ELSE 'O' END AS relabelled FROM lineitem) GROUP BY 1")
def relabelled_records(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("category_label"))
    return prefilter.relabel(r, {"A": "F", "R": "O"}).groupBy("category").agg(F.count("*").alias("records"), F.count_if("relabelled").alias("relabelled"))


@query(r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref="(/[^"]+)"[^>]*>(.*?)</a>', 1)) AS path, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref="(/[^"]+)"[^>]*>(.*?)</a>', 2)) AS inner_, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*\bhref="(/[^"]+)"[^>]*>(.*?)</a>', 1), 1) AS pos FROM pages),
 f AS (SELECT page_id, path, min(pos) AS pos, arg_min(trim(inner_), pos) AS title FROM a WHERE trim(inner_) <> '' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos)::INT AS place FROM f)
 SELECT page_id, place, title, 'https://x' || path AS link FROM r WHERE place <= 4""")
def listed_articles(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_listing(table(spark, d, "pages"), r'(/[^"]+)', base="https://x", cap=4)


@query("""SELECT o_orderkey AS id, least(o_orderdate, TIMESTAMP '1996-01-01') AS clamped, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate WHEN o_orderdate + INTERVAL 9 HOUR <= TIMESTAMP '1996-01-02' THEN o_orderdate + INTERVAL 9 HOUR END AS filled,
 (date_trunc('week', o_orderdate + INTERVAL 8 HOUR) - INTERVAL 7 DAY)::DATE AS week, CASE WHEN o_orderdate > TIMESTAMP '1995-12-31 23:00:00' THEN 'hour' WHEN o_orderdate > TIMESTAMP '1995-12-31' THEN 'day' WHEN o_orderdate > TIMESTAMP '1995-12-25' THEN 'week' ELSE 'older' END AS age,
 coalesce(o_orderkey % 5 = 0 AND o_orderdate < TIMESTAMP '1995-12-02', false) AS classic, coalesce(CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 3 DAY END, o_orderdate) AS seen, greatest(o_orderdate, o_orderdate + to_days(CAST(o_orderkey % 3 AS INT) - 1)) AS updated FROM orders""")
def order_times(spark: SparkSession, d: str) -> DataFrame:
    c, now = F.col("o_orderdate"), F.lit("1996-01-01").cast("timestamp_ntz")
    i = F.col("o_orderkey")
    ahead = F.when(c > now, now).otherwise(c)
    return table(spark, d, "orders").select(
        i.alias("id"), scores.clamp_future(c, now, 0).alias("clamped"), scores.backfill_date(F.when(i % 4 != 0, c), c + F.expr("INTERVAL 9 HOURS"), now).alias("filled"), scores.completed_week(c).alias("week"), scores.age_bucket(c, now).alias("age"),
        scores.is_classic(c, i % 5 == 0, now).alias("classic"), scores.discovery_time(c, F.when(i % 4 != 0, c + F.expr("INTERVAL 3 DAYS"))).alias("seen"), scores.entry_updated(c, c, F.array(ahead - F.expr("INTERVAL 9000 DAYS"), c + F.expr("make_dt_interval(cast(o_orderkey % 3 as int) - 1)"))).alias("updated"),
    )


@query(r"""WITH x AS (SELECT doc_id, text, length(text) AS n, source, lang FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, sha256(trim(regexp_replace(source, '[ \t\n\f\r]+', ' ', 'g')) || chr(10) || lang) AS content, CASE WHEN n <= 0 THEN '0' WHEN n <= 3 THEN '1-3' WHEN n <= 8 THEN '4-8' ELSE '9+' END AS bucket, CASE WHEN n < 640 THEN 's' WHEN n < 1024 THEN 'm' ELSE 'l' END AS viewport, greatest(512, n // 3 + 100) AS tokens,
 CASE WHEN n <= 200 THEN text WHEN length(regexp_extract(left(text, 200), '(?s)^(.*[.!?。！？])', 1)) * 2 >= 200 THEN regexp_extract(left(text, 200), '(?s)^(.*[.!?。！？])', 1) WHEN length(regexp_extract(left(text, 200), '(?s)^(.*[,;:，；：])', 1)) * 2 >= 200 THEN regexp_extract(left(text, 200), '(?s)^(.*[,;:，；：])', 1) ELSE '' END AS clipped,
 CASE WHEN lang = 'de' THEN 'search' WHEN lang = 'fr' THEN 'internal' WHEN source = 'src0' THEN 'social' ELSE 'other' END AS referrer FROM x""")
def text_rules(spark: SparkSession, d: str) -> DataFrame:
    t, n = F.col("text"), F.length("text")
    host = F.when(F.col("lang") == "de", "www.google.com").when(F.col("lang") == "fr", "Own.example").when(F.col("source") == "src0", "x.com").otherwise("b.org")
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id", text.content_hash(F.col("source"), F.col("lang")).alias("content"), text.query_bucket(n).alias("bucket"), text.viewport_bucket(n).alias("viewport"), text.token_estimate(n, 100).alias("tokens"),
        text.clip_sentence(t, 200).alias("clipped"), text.referrer_bucket(host, F.lit("own.example"), {"search": "google|bing", "social": r"^x\.com$"}).alias("referrer"),
    )


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/eventlake/files-{uuid.uuid4().hex}"


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 2 = 1")
def current_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Two runs of a catalog; the later one is the current."""
    o, path = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), _folder(spark)
    sinks.write_catalog(o.where("id % 2 = 0"), path, "2024-01-01")
    sinks.write_catalog(o.where("id % 2 = 1"), path, "2024-01-02")
    return sinks.read_current(spark, path)


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def lite_catalog(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    sinks.write_lite(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), "o_orderpriority"), ["id", "price"], path)
    return spark.read.parquet(path)


@query("SELECT 'w' || o_custkey % 5 AS week_id, o_orderkey AS id FROM orders WHERE o_custkey % 5 < 3 OR o_orderkey % 2 = 1")
def weekly_tables(spark: SparkSession, d: str) -> DataFrame:
    """Weeks that are there already stay as they are."""
    o, path = table(spark, d, "orders").select(F.concat(F.lit("w"), (F.col("o_custkey") % 5).cast("string")).alias("week_id"), F.col("o_orderkey").alias("id")), _folder(spark)
    sinks.write_weekly(o.where("week_id < 'w3'"), path)
    sinks.write_weekly(o.where("id % 2 = 1"), path)
    return spark.read.parquet(path).select("week_id", "id")


@query("SELECT event_id, user_id, false AS bad FROM events UNION ALL SELECT NULL, NULL, true FROM events WHERE event_id % 10 = 0")
def behavior_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines: alone or in lists of two, with broken and blank lines between."""
    e, path = table(spark, d, "events").select("event_id", "user_id"), _folder(spark)
    one = F.to_json(F.struct("event_id", "user_id"))
    alone = e.where("event_id % 2 = 0").select(one.alias("value"))
    pair = F.to_json(F.struct(F.collect_list(F.struct("event_id", "user_id")).alias("events")))
    lists = e.where("event_id % 2 = 1").groupBy(F.floor(F.col("event_id") / 4)).agg(pair.alias("value")).select("value")
    broken = e.where("event_id % 10 = 0").select(F.lit('{"event_id": ').alias("value"))
    alone.union(lists).union(broken).union(e.where("event_id % 10 = 5").select(F.lit("  ").alias("value"))).write.text(path)
    return scans.scan_behavior_ndjson(spark, path, "event_id long, user_id long").select("event_id", "user_id", "bad")


@query("SELECT url, split_part(url, '#', 1) AS loc FROM pages WHERE contains(url, '/en/') AND NOT contains(url, '&')")
def sitemap_pages(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    p = table(spark, d, "pages").where("not contains(url, '&')").select(F.col("url").alias("loc"), F.lit("2024-01-01").alias("lastmod"))
    p.write.format("xml").option("rowTag", "url").option("rootTag", "urlset").save(path)
    return scans.scan_sitemap(spark, path, "/en/").select("url", F.element_at(F.split("url", "#"), 1).alias("loc"))


@query("WITH v AS (SELECT DISTINCT (1992 + o_orderkey % 7)::VARCHAR || '/' || o_custkey % 12 || '_' || o_orderkey % 5 AS version, o_orderkey % 7 AS y, o_custkey % 12 AS a, o_orderkey % 5 AS b FROM orders) SELECT version FROM v ORDER BY y DESC, a DESC, b DESC LIMIT 6")
def newest_versions(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    page = F.concat(F.lit('<a href="/v/'), (1992 + k % 7).cast("string"), F.lit("/"), (c % 12).cast("string"), F.lit("_"), (k % 5).cast("string"), F.lit('">'))
    return scans.scan_versioned_index(table(spark, d, "orders").select(page.alias("html")), "html")


@query("SELECT 'w' || o_orderkey % 4 AS week_id, substr(md5(o_orderkey::VARCHAR), 1, 12) AS event_id FROM orders WHERE o_orderkey % 4 IN (1, 3)")
def good_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Of the weeks asked for, one holds a malformed id and is left out."""
    o, path = table(spark, d, "orders"), _folder(spark)
    rows = o.select(F.concat(F.lit("w"), (F.col("o_orderkey") % 4).cast("string")).alias("week_id"), F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 12).alias("event_id"))
    bad = o.where("o_orderkey % 4 = 2").limit(1).select(F.lit("w2").alias("week_id"), F.lit("X").alias("event_id"))
    rows.union(bad).write.partitionBy("week_id").parquet(path)
    return scans.scan_snapshots(spark, path, ["w1", "w2", "w3"]).select("week_id", "event_id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 0 THEN NULL ELSE array_to_string(list_filter([CASE WHEN o_orderkey % 3 <> 0 THEN 'a' END, CASE WHEN o_orderkey % 4 <> 0 THEN 'b' END], lambda x: x IS NOT NULL), ',') END AS tags FROM orders")
def merged_tags(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    own = [F.when(k % 3 != 0, F.array(F.lit(" a"), F.lit("zz"))), F.when(k % 4 != 0, F.array(F.lit("b"), F.lit("a ").substr(3, 1)))]
    return table(spark, d, "orders").select(k.alias("id"), F.array_join(scores.merge_tags(*own, F.array(F.lit("a"), F.lit("b"))), ",").alias("tags"))



@query("""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 5 THEN NULL WHEN 2 THEN date_trunc('day', o_orderdate)::TIMESTAMP WHEN 3 THEN date_trunc('day', o_orderdate)::TIMESTAMP ELSE date_trunc('second', o_orderdate)::TIMESTAMP END AS at,
 CASE WHEN o_orderkey % 6 <> 5 AND year(o_orderdate) >= 2005 THEN date_trunc('second', o_orderdate)::TIMESTAMP END AS meta FROM orders""")
def parsed_dates(spark: SparkSession, d: str) -> DataFrame:
    """Dates of orders in six spellings, one of which is none, and as pages state them."""
    i, c = F.col("o_orderkey") % 6, F.col("o_orderdate")
    said = F.when(i == 0, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).when(i == 1, F.date_format(c, "EEE, d MMM yyyy HH:mm:ss")).when(i == 2, F.date_format(c, "yyyy/MM/dd")).when(i == 3, F.date_format(c, "MMMM d, yyyy")).when(i == 4, F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")).otherwise("soon")
    page = F.concat(F.lit('<meta property="article:published_time" content="'), F.when(i == 5, "soon").otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")), F.lit('">'))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), scores.parse_date_multi(said).cast("timestamp_ntz").alias("at"), scores.meta_date(page).cast("timestamp_ntz").alias("meta"))


@query("SELECT p_partkey AS id, 'a & ' || p_name || ' < b' AS stripped, p_name || ': x' AS reason, 'see ' || p_name || ' at and' AS spoken FROM part")
def cleaned_texts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    markup = F.concat(F.lit("<p class='x'>a &amp; <b>"), n, F.lit("</b>\n &lt; b</p> "))
    reason = F.concat(F.lit("Why:  Why： "), n, F.lit(": x"))
    spoken = F.concat(F.lit("```\ncode\n``` see ["), n, F.lit("](https://x.example/y) at https://z.example <br>and"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.strip_html(markup).alias("stripped"), text.clean_reason(reason, ("Why",)).alias("reason"), text.clean_narration(spoken).alias("spoken"))


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '(\r?\n){2,}'), lambda x: trim(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g'))), lambda x: x <> '') AS p FROM documents),
 b AS (SELECT doc_id, CASE WHEN len(p) = 1 AND length(p[1]) > 1600 THEN list_filter(string_split(regexp_replace(p[1], '([。！？.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') ELSE p END AS b FROM p)
 SELECT doc_id, unnest(generate_series(1, len(b)))::INT AS place, md5(unnest(b)) AS block FROM b""")
def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    blocks = F.posexplode(trim.text_to_blocks(F.col("text"))).alias("at", "block")
    return table(spark, d, "documents").select("doc_id", blocks).select("doc_id", (F.col("at") + 1).alias("place"), F.md5("block").alias("block"))


@query("SELECT o_orderkey::VARCHAR AS id, 'Order ' || o_orderkey || ' & more' AS title FROM orders ORDER BY o_orderdate DESC, o_orderkey::VARCHAR LIMIT 50")
def atom_entries(spark: SparkSession, d: str) -> DataFrame:
    """The newest entries, written as a feed and read back."""
    path, key = _folder(spark), F.col("o_orderkey").cast("string")
    e = table(spark, d, "orders").select(key.alias("id"), F.concat(F.lit("Order "), key, F.lit(" & more")).alias("title"), F.concat(F.lit("https://x.example/"), key).alias("link"), F.col("o_orderdate").alias("updated"), F.lit("s").alias("summary"))
    sinks.write_atom_rows(e, path)
    return spark.read.format("xml").option("rowTag", "entry").schema("id string, title string").load(path)


@query("SELECT o_orderkey AS id, o_orderstatus AS status, NULL AS name FROM orders UNION ALL SELECT c_custkey, NULL, c_name FROM customer")
def united_sources(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return scans.union_sources(o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


@query("SELECT o_orderkey AS event_id FROM orders WHERE length(repeat('x', o_custkey::INT)) >= 80 AND o_orderkey % 3 <> 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 8")
def spoken_next(spark: SparkSession, d: str) -> DataFrame:
    """Orders as events with scripts; every third was spoken already."""
    o = table(spark, d, "orders")
    s = o.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("seen"), F.repeat(F.lit("x"), F.col("o_custkey").cast("int")).alias("script"))
    spoken = s.select("event_id", F.when(F.col("event_id") % 3 == 0, F.sha2("script", 256)).otherwise("old").alias("hash"))
    return trim.narration_queue(s, spoken).select("event_id")
