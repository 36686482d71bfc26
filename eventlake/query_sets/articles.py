"""Articles within pages. Lines of documents stand in for blocks where the rule matters rather than the markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.operators import bodies, extract, trim
from eventlake.plans.stage import keep
from eventlake.query_sets.registry import query, table
from eventlake.sources import scans

_BARE = r"regexp_replace(coalesce(text, ''), '^[ \t\r\n:：]+|[ \t\r\n:：]+$', '', 'g')"
#: Lines of documents as blocks; the patterns of marks, promotions and headings are stand-ins for words of sites.
_LINES = rf"""WITH ln AS (SELECT doc_id AS page_id, generate_subscripts(x, 1) - 1 AS ord, unnest(x) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL)),
 b AS (SELECT page_id, ord, text, CASE WHEN length(text) < 60 THEN 'heading' ELSE 'paragraph' END AS type, {_BARE} AS t, length(text) AS size, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS i, coalesce(sum(length(text)) OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  CASE WHEN ord % 3 = 0 THEN ['l' || length(text) % 5] ELSE [] END AS links, CASE WHEN ord % 3 = 0 THEN length(text) // 2 ELSE 0 END AS link_chars FROM ln)
"""
HEADING, UI, PROMO = "[aeiouéè].*", "[0-9].*", "[dlts].*"


def lines(spark: SparkSession, d: str) -> DataFrame:
    ln = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("ord", "text"))
    n, third = F.length("text"), F.col("ord") % 3 == 0
    links = F.when(third, F.array(F.concat(F.lit("l"), (n % 5).cast("string")))).otherwise(F.array().cast("array<string>"))
    return ln.select("page_id", "ord", "text", F.when(n < 60, "heading").otherwise("paragraph").alias("type"), links.alias("links"), F.when(third, F.floor(n / 2).cast("int")).otherwise(0).alias("link_chars"))


@query(_LINES + rf""", s AS (SELECT *, regexp_matches(t, '(?i)^(?:{HEADING})$') AS h, before >= 300 AND (regexp_matches(t, '(?i)^(?:{HEADING})$') OR regexp_matches(t, '(?i)^(?:{UI})$')) AS stop FROM b), f AS (SELECT page_id, min(i) AS fi FROM s WHERE stop GROUP BY page_id),
 e AS (SELECT s.page_id, s.ord, s.i, f.fi FROM s JOIN f USING (page_id) JOIN s k ON k.page_id = s.page_id AND k.i = f.fi AND k.h WHERE s.i BETWEEN f.fi - 8 AND f.fi - 1 AND s.type = 'heading' AND s.before >= 300 AND regexp_matches(s.t, '(?i)^(?:{PROMO})$') AND NOT EXISTS (SELECT 1 FROM b z WHERE z.page_id = s.page_id AND z.i BETWEEN s.i AND f.fi - 1 AND z.size > 320))
 SELECT f.page_id, CAST(coalesce(min(e.ord), min(s.ord)) AS INT) AS boundary FROM f JOIN s ON s.page_id = f.page_id AND s.i = f.fi LEFT JOIN e ON e.page_id = f.page_id GROUP BY f.page_id""")
def article_tails(spark: SparkSession, d: str) -> DataFrame:
    return trim.tail_boundary(lines(spark, d), 300, HEADING, UI, PROMO)


_PROMO = "(?:tion|license|ung|que)"


@query(_LINES + rf""", p AS (SELECT page_id, ord, links, regexp_replace(lower(regexp_replace(t, '^[\s/\\|>›»·•:：-]+', '')), '[^\p{{L}}\p{{N}}_]+', '', 'g') AS key FROM b WHERE t <> '' AND length(t) <= 240 AND regexp_matches(t, '(?i){_PROMO}')),
 k AS (SELECT page_id, ord, 't:' || key AS k FROM p UNION ALL SELECT page_id, ord, 'l:' || unnest(links) FROM p), w AS (SELECT page_id, k FROM k GROUP BY ALL HAVING count(DISTINCT ord) >= 2)
 SELECT DISTINCT page_id, CAST(ord AS INT) AS ord FROM k JOIN w USING (page_id, k)""")
def repeated_promos(spark: SparkSession, d: str) -> DataFrame:
    return trim.repeated_promos(lines(spark, d), _PROMO)


@query(_LINES + """, c AS (SELECT *, type = 'paragraph' AND length(t) BETWEEN 1 AND 180 AND len(links) > 0 AND link_chars >= 0.15 * greatest(size, 1) AND regexp_matches(t, '(?i)^(?:.*[a-z.]{1,9})$') AS call FROM b), r AS (SELECT *, min(call::INT) OVER (PARTITION BY page_id ORDER BY ord DESC ROWS UNBOUNDED PRECEDING) AS rest FROM c)
 SELECT page_id, CAST(ord AS INT) AS ord FROM r WHERE rest = 0""")
def terminal_promos(spark: SparkSession, d: str) -> DataFrame:
    return trim.terminal_promos(lines(spark, d), ".*[a-z.]{1,9}").select("page_id", "ord")


@query(_LINES + "SELECT page_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY ord)) AS hash FROM b WHERE trim(text) <> '' GROUP BY page_id")
def plain_texts(spark: SparkSession, d: str) -> DataFrame:
    return trim.plain_text(lines(spark, d)).select("page_id", F.md5("text").alias("hash"))


_KEY = r"regexp_replace(lower(regexp_replace(text, '^[\s/\\|>›»·•:：-]+', '')), '[^\p{L}\p{N}_]+', '', 'g')"


@query(_LINES + f""", g AS (SELECT page_id, sum(size) AS chars, count(*) AS blocks, count(*) FILTER (WHERE type = 'heading') AS headings, sum(link_chars) AS linked, count(*) FILTER (WHERE size >= 8) AS n, count(DISTINCT CASE WHEN size >= 8 THEN {_KEY} END) AS k FROM b GROUP BY page_id)
 SELECT page_id, chars::BIGINT AS chars, blocks, headings, round_even(linked / greatest(chars, 1), 4) AS link_ratio, n - k AS repeats, CASE WHEN linked / greatest(chars, 1) > 0.42 OR (n - k >= 3 AND (n - k) / greatest(n, 1) >= 0.12) THEN 'suspect' ELSE 'pass' END AS quality FROM g""")
def body_integrity(spark: SparkSession, d: str) -> DataFrame:
    return trim.integrity(lines(spark, d)).drop("tables", "figures")


_CAND = """WITH c AS (SELECT l_orderkey AS page_id, l_linenumber * 1000000 + l_suppkey * 1000 + l_partkey % 1000 AS candidate, l_suppkey % 4 AS signature, CASE l_linenumber % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'nested_content' WHEN 2 THEN 'main' ELSE 'none' END AS strategy, CAST(l_extendedprice AS BIGINT) % 6000 AS chars, CAST(l_quantity AS BIGINT) AS headings, l_partkey % 3 AS tables, l_partkey % 5 AS figures, l_discount * 5 AS ratio, CASE WHEN l_returnflag = 'R' THEN 'suspect' ELSE 'pass' END AS quality, l_suppkey % 7 AS removed, 10 AS raw, l_linenumber AS depth, CAST(l_quantity AS BIGINT) / 50.0 AS focus FROM lineitem),
 sc AS (SELECT *, round(CASE strategy WHEN 'article' THEN 640 WHEN 'nested_content' THEN 340 WHEN 'main' THEN 260 ELSE 0 END + least(360.0, chars / 12) + least(120, headings * 12 + tables * 40 + figures * 10) + CASE WHEN strategy = 'nested_content' THEN CASE WHEN focus BETWEEN 0.45 AND 0.97 THEN 180 WHEN focus >= 0.25 AND focus < 0.45 THEN 40 WHEN focus < 0.25 THEN -180 WHEN focus > 0.985 THEN -40 ELSE 0 END + least(80, depth * 8) ELSE 0 END - least(240.0, ratio * 480) - least(320.0, removed / raw * 480) - CASE WHEN quality <> 'pass' THEN 600 ELSE 0 END, 2) AS score FROM c)
"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    strategy = F.when(c("l_linenumber") % 4 == 0, "article").when(c("l_linenumber") % 4 == 1, "nested_content").when(c("l_linenumber") % 4 == 2, "main").otherwise("none")
    quality = F.when(c("l_returnflag") == "R", "suspect").otherwise("pass")
    score = trim.extraction_score(strategy, F.bround("l_extendedprice").cast("long") % 6000, c("l_quantity").cast("long"), c("l_partkey") % 3, c("l_partkey") % 5, c("l_discount") * 5, quality, c("l_suppkey") % 7, F.lit(10), c("l_linenumber"), c("l_quantity").cast("long") / 50.0)
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("page_id"), (c("l_linenumber") * 1000000 + c("l_suppkey") * 1000 + c("l_partkey") % 1000).alias("candidate"), (c("l_suppkey") % 4).alias("signature"), quality.alias("quality"), score.alias("score"))


@query(_CAND + "SELECT page_id, candidate, score FROM sc")
def extraction_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("page_id", "candidate", "score")


@query(_CAND + ", o AS (SELECT *, row_number() OVER (PARTITION BY page_id, signature ORDER BY score DESC, candidate) AS r FROM sc) SELECT page_id, candidate, quality FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY quality = 'pass' DESC, score DESC, candidate) AS k FROM o WHERE r = 1) WHERE k = 1")
def chosen_bodies(spark: SparkSession, d: str) -> DataFrame:
    return trim.choose_body(scored(spark, d)).select("page_id", "candidate", "quality")


@query("""WITH f AS (SELECT l_orderkey AS event_id, l_linenumber * 1000000 + l_partkey AS ord, CASE WHEN l_orderkey % 20 = 0 THEN 'rights' WHEN l_suppkey % 9 = 0 THEN 'no_url' WHEN NOT (l_partkey % 3 = 0 OR l_partkey % 3 = 1 OR l_orderkey % 2 = 0) THEN 'cross_site' WHEN l_returnflag = 'A' THEN 'not_retryable' END AS own FROM lineitem),
 p AS (SELECT *, row_number() OVER (PARTITION BY event_id, own IS NULL ORDER BY ord) AS r FROM f) SELECT event_id, ord, coalesce(own, CASE WHEN r > 2 THEN 'limit' END) AS reason FROM p""")
def media_policy(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    host = F.when(c("l_partkey") % 3 == 0, "img.a.com").when(c("l_partkey") % 3 == 1, "cdn.net").when(c("l_orderkey") % 2 == 0, "a.com").otherwise("b.org")
    f = table(spark, d, "lineitem").select(c("l_orderkey").alias("event_id"), (c("l_linenumber") * 1000000 + c("l_partkey")).alias("ord"), host.alias("src_host"), F.lit("a.com").alias("page_host"), F.when(c("l_suppkey") % 9 != 0, "u").otherwise("").alias("src"), (c("l_returnflag") != "A").alias("retryable"), (c("l_orderkey") % 20 == 0).alias("noindex"))
    # the allowed host stands where the page's own would
    f = f.withColumn("page_host", F.when(c("src_host") == "cdn.net", "cdn.net").otherwise(c("page_host")))
    return trim.media_policy(f, c("noindex"), ["cdn.net"], 2).select("event_id", "ord", "reason")


@query("""WITH bl AS (SELECT conv_id, turn AS node, text FROM conversations WHERE turn % 4 <> 3), tx AS (SELECT conv_id, turn AS node, min_by('n' || turn || k, k) AS new FROM conversations, generate_series(0, 1) g(k) WHERE turn % 3 <> 1 GROUP BY ALL)
 SELECT conv_id AS page_id, node, coalesce(new, text) AS text FROM bl LEFT JOIN tx USING (conv_id, node)""")
def node_texts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("node"), "text")
    new = c.where("node % 3 <> 1").select("page_id", "node", F.explode(F.array(F.lit(0), F.lit(1))).alias("place")).withColumn("text", F.concat(F.lit("n"), F.col("node").cast("string"), F.col("place").cast("string")))
    return trim.apply_node_texts(c.where("node % 4 <> 3"), new)[0]


@query("""SELECT conv_id AS page_id, count(*) FILTER (WHERE turn % 4 <> 3 AND turn % 3 <> 1) AS applied, (2 * count(*) FILTER (WHERE turn % 4 = 3 AND turn % 3 <> 1))::BIGINT AS ignored, count(*) FILTER (WHERE turn % 4 <> 3 AND turn % 3 = 1) AS missing FROM conversations GROUP BY conv_id""")
def node_text_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("node"), "text")
    new = c.where("node % 3 <> 1").select("page_id", "node", F.explode(F.array(F.lit(0), F.lit(1))).alias("place")).withColumn("text", F.lit("n"))
    return trim.apply_node_texts(c.where("node % 4 <> 3"), new)[1]


@query("SELECT o_orderkey AS norm, CASE WHEN o_orderkey % 3 <> 2 AND o_orderkey % 700 >= 400 AND (o_orderkey % 4 = 0 OR o_custkey % 90 >= 0.9 * (CAST(floor(o_totalprice) AS BIGINT) % 101)) THEN 'feed' WHEN o_orderkey % 4 <> 0 THEN 'page' END AS origin FROM orders WHERE o_orderkey % 3 <> 2 OR o_orderkey % 4 <> 0")
def feed_bodies(spark: SparkSession, d: str) -> DataFrame:
    o, i = table(spark, d, "orders"), F.col("o_orderkey")
    page = o.where(i % 4 != 0).select(i.alias("norm"), F.lit(1).alias("chars"), (F.floor("o_totalprice") % 101).alias("score"))
    return trim.prefer_feed_body(page, o.where(i % 3 != 2).select(i.alias("norm"), (i % 700).alias("chars"), (F.col("o_custkey") % 90).alias("score")))


@query()
def article_heads(spark: SparkSession, d: str) -> DataFrame:
    return trim.head_cut(lines(spark, d), labels=("a", "e", "i", "o", "u"), ui="[A-Zl].{0,30}", byline="^[DE]", date="[0-9]+")


@query()
def page_regions(spark: SparkSession, d: str) -> DataFrame:
    r = extract.page_regions(table(spark, d, "pages"))
    return trim.region_limits(r.select("page_id", "region", "tag", "depth", "chars", trim.classify_region(F.col("attrs")).alias("c")).select("page_id", "region", "tag", "depth", "chars", "c.*"), least=200)


@query(r"""WITH d AS (SELECT page_id, unnest(regexp_extract_all(html, '<(?:div|article|section)([^>]*)>', 1)) AS attrs FROM pages), w AS (SELECT page_id, trim(regexp_replace(lower(array_to_string(regexp_extract_all(attrs, '(?is)\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', 1), ' ')), '[^a-z0-9]+', ' ', 'g')) AS w FROM d)
 SELECT page_id, count(*) AS regions, count(*) FILTER (WHERE regexp_matches(w, '\b(?:ad|article|post)\b')) AS named FROM w GROUP BY page_id""".replace("'\\b(?:ad|article|post)\\b'", "'" + trim.ARTICLE_NOISE + "'"))
def noisy_regions(spark: SparkSession, d: str) -> DataFrame:
    attrs = F.explode(F.regexp_extract_all("html", F.lit("<(?:div|article|section)([^>]*)>"), F.lit(1))).alias("attrs")
    r = table(spark, d, "pages").select("page_id", attrs).withColumn("c", trim.classify_region(F.col("attrs")))
    return r.groupBy("page_id").agg(F.count("*").alias("regions"), F.count_if("c.noise").alias("named"))


@query("SELECT page_id, src, reason FROM pages, (VALUES ('https://x.example/chart.png', NULL), ('https://x.example/chart.png?w=2', 'duplicate'), ('https://x.example/logo.png', 'decorative'), ('https://x.example/s.png', 'small'), ('https://x.example/b.png', 'limit')) f(src, reason)")
def page_figures(spark: SparkSession, d: str) -> DataFrame:
    """The pages hold no images, so that each is given five; one may stay."""
    images = '<article><img src="https://x.example/chart.png" alt="flow"><img src="https://x.example/chart.png?w=2"><img src="https://x.example/logo.png"><img src="https://x.example/s.png" width="90" height="90"><img src="https://x.example/b.png"></article>'
    pages = table(spark, d, "pages").select("page_id", F.concat("html", F.lit(images)).alias("html"))
    f = extract.page_blocks(pages).where("src is not null").withColumn("caption", F.lit("")).withColumn("next_byline", F.lit(False))
    return trim.select_figures(f, 1).select("page_id", "src", "reason")


@query()
def narration_scripts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("event_id"), F.col("turn").alias("place"), F.col("text"))
    return trim.narration(c)


@query()
def candidate_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each block in every container that may be its page's article."""
    slices = keep(bodies.page_slices(table(spark, d, "pages")), "slices")
    return bodies.candidate_blocks(bodies.candidate_regions(slices), slices).select("page_id", "candidate", "ord", "type", "text")


@query()
def page_bodies(spark: SparkSession, d: str) -> DataFrame:
    return bodies.page_bodies(table(spark, d, "pages"))[0]


@query()
def sql_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of pages by a table function, in SQL."""
    bodies.register_table_functions(spark)
    return spark.sql("SELECT p.page_id, b.ord, b.type, b.text, b.link_chars FROM {pages} p, LATERAL blocks_of(p.html) b", pages=table(spark, d, "pages"))


@query()
def renormalized_catalog(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as stored blocks, trimmed until nothing more goes."""
    rows = F.sort_array(F.collect_list(F.struct("ord", F.struct("type", "text", "links", "link_chars").alias("b"))))
    stored = lines(spark, d).groupBy(F.col("page_id").alias("event_id")).agg(F.transform(rows, lambda x: x["b"]).alias("blocks"))
    return bodies.renormalize(stored).select("event_id", F.size("blocks").alias("blocks"), "removed")


_FEED_TITLE = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


@query(rf"SELECT page_id, regexp_replace(trim({_FEED_TITLE}), '\s+', ' ', 'g') AS title, url || '&x=1' AS link, 'a' || page_id || ' & b' AS summary FROM pages WHERE trim({_FEED_TITLE}) <> '' AND NOT contains({_FEED_TITLE}, '&')")
def feed_items(spark: SparkSession, d: str) -> DataFrame:
    """A feed for each page, with the bare ampersands that feeds have."""
    p = table(spark, d, "pages").withColumn("title", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).where("trim(title) <> '' and not contains(title, '&')")
    doc = F.concat(F.lit("<rss><channel><item><title>"), "title", F.lit("</title><link>"), "url", F.lit("&x=1</link><description>a"), F.col("page_id").cast("string"), F.lit(" & b</description></item></channel></rss>"))
    items, _ = scans.parse_feeds(p.select(F.col("page_id").alias("file"), doc.alias("value")))
    return items.select(F.col("file").alias("page_id"), "title", "link", "summary")
