"""Sources and their entries. Documents stand in for entries, clicks for runs of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.operators import prefilter
from eventlake.query_sets.registry import query, table

_LINK = "'https://' || coalesce(source, '') || '.example.com/' || coalesce(lang, '') || '/' || doc_id"
#: Entries are dated by their number, every ninth not at all; a source's rules follow from its name's length.
_ENTRIES = f"""WITH en AS (SELECT doc_id, source, text AS title, {_LINK} AS link, CASE WHEN doc_id % 9 <> 0 THEN TIMESTAMP '2024-03-01' - to_hours(CAST(doc_id % 400 AS INT)) END AS published FROM documents),
 hay AS (SELECT *, lower(coalesce(title, '') || '  ' || link) AS h, length(source) AS n FROM en),
 j AS (SELECT doc_id, source, CASE WHEN n % 2 = 0 AND published IS NULL THEN 'missing_date' WHEN published < TIMESTAMP '2024-03-01' - to_days(CAST(5 + n % 4 AS INT)) THEN 'time'
  WHEN n % 3 = 0 AND NOT contains(link, '/en/') OR contains(link, '/es/1') THEN 'path'
  WHEN n % 5 <> 0 AND NOT (regexp_matches(h, '(^|[^a-z0-9])(die|le|the)($|[^a-z0-9])') OR contains(h, 'ción')) THEN 'keyword' WHEN contains(h, 'license') OR regexp_matches(h, '(^|[^a-z0-9])sch($|[^a-z0-9])') THEN 'excluded' END AS reason FROM hay)
"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    link = F.concat(F.lit("https://"), F.coalesce("source", F.lit("")), F.lit(".example.com/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"))
    dated = F.when(F.col("doc_id") % 9 != 0, F.expr("timestamp_ntz'2024-03-01' - make_dt_interval(0, cast(doc_id % 400 as int))"))
    return table(spark, d, "documents").select("doc_id", "source", F.col("text").alias("title"), F.lit(None).cast("string").alias("summary"), link.alias("link"), dated.alias("published"))


def configs(e: DataFrame) -> DataFrame:
    n, none = F.length("source"), F.array().cast("array<string>")
    return e.select("source").distinct().where("source is not null").select(
        "source", (5 + n % 4).alias("lookback_days"), (n % 2 == 0).alias("require_published"), F.when(n % 3 == 0, F.array(F.lit("/en/"))).otherwise(none).alias("path_include"),
        F.array(F.lit("/es/1")).alias("path_exclude"), F.when(n % 5 != 0, F.array(*(F.lit(w) for w in ("the", "die", "le", "ción")))).otherwise(none).alias("include_keywords"),
        F.array(F.lit("License"), F.lit("sch")).alias("exclude_keywords"),
    )


def judged(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d).where("source is not null")
    return prefilter.prefilter(e, configs(e), F.lit("2024-03-01").cast("timestamp_ntz"))


@query(_ENTRIES + "SELECT doc_id, reason FROM j WHERE source IS NOT NULL")
def source_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("doc_id", F.col("drop_reason").alias("reason"))


@query(_ENTRIES + "SELECT source, count(*) AS fetched, count(*) FILTER (WHERE reason IS NULL) AS eligible, count(reason) AS prefiltered, " + ", ".join(f"count(*) FILTER (WHERE reason = '{r}') AS {r}" for r in ("missing_date", "time", "path", "keyword", "excluded")) + " FROM j WHERE source IS NOT NULL GROUP BY source")
def source_prefilter_stats(spark: SparkSession, d: str) -> DataFrame:
    return prefilter.prefilter_stats(judged(spark, d))


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN contains(lower(text), 'license') OR contains(lower(text), 'password') THEN 'negative' WHEN NOT (contains(lower(text), 'tion') OR contains(lower(text), 'ung')) THEN 'no_signal' END AS reason FROM documents WHERE text IS NOT NULL")
def rule_prefilter(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", prefilter.rule_reason(F.col("text"), F.col("doc_id") % 10 == 0, ["tion", "ung"], ["license", "password"]).alias("reason"))


@query("SELECT doc_id FROM documents WHERE NOT coalesce(source = (SELECT max(source) FROM documents) AND contains(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))), 'the'), false)")
def drop_empty_releases(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    name = t.agg(F.max("source")).first()[0] or ""
    return t.where(~prefilter.empty_release(F.col("source"), F.col("text"), name, ["the"])).select("doc_id")


_TIER = "CASE {} % 4 WHEN 0 THEN 'low_precision' WHEN 1 THEN 'media_low' WHEN 2 THEN 'official_high' ELSE 'default' END"


@query(f"SELECT d.doc_id AS id, {_TIER.format('d.doc_id')} AS tier FROM documents d LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END) AS s FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id WHERE coalesce(s = 'accepted', false) OR (d.doc_id % 4 > 1 AND NOT coalesce(s = 'rejected', false))")
def fail_closed(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id") % 4
    tier = F.when(i == 0, "low_precision").when(i == 1, "media_low").when(i == 2, "official_high").otherwise("default")
    said = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("status"))
    return prefilter.fail_closed(table(spark, d, "documents").select(F.col("doc_id").alias("id"), tier.alias("tier")), said)


@query("""WITH r AS (SELECT user_id AS source, CAST(ts AS DATE) AS run, count(*) FILTER (WHERE event_type <> 'error') AS candidates, count(*) FILTER (WHERE event_type = 'purchase') AS accepted, count(*) FILTER (WHERE event_type = 'error') > 1 AS failed FROM events GROUP BY ALL),
 n AS (SELECT * FROM r WHERE NOT failed AND candidates > 0), l AS (SELECT source, max(run) AS last FROM n WHERE accepted > 0 GROUP BY source),
 s AS (SELECT source, count(*) AS streak FROM n LEFT JOIN l USING (source) WHERE accepted = 0 AND (last IS NULL OR run > last) GROUP BY source)
 SELECT source, sum(r.candidates)::BIGINT AS candidates, sum(r.accepted)::BIGINT AS accepted, count(*) FILTER (WHERE failed) AS failures, coalesce(round_even(sum(r.accepted) / nullif(sum(r.candidates), 0), 4), 0.0) AS rate, coalesce(any_value(streak), 0) AS streak, CASE WHEN coalesce(any_value(streak), 0) >= 3 THEN 'review' ELSE 'keep' END AS advice FROM r LEFT JOIN s USING (source) GROUP BY source""")
def source_scorecard_runs(spark: SparkSession, d: str) -> DataFrame:
    e, kind = table(spark, d, "events"), F.col("event_type")
    runs = e.groupBy(F.col("user_id").alias("source"), F.to_date("ts").alias("run")).agg(F.count_if(kind != "error").alias("candidates"), F.count_if(kind == "purchase").alias("accepted"), (F.count_if(kind == "error") > 1).alias("failed"))
    return prefilter.scorecard(runs)


@query("SELECT CAST(l_suppkey AS VARCHAR) AS source, o_orderpriority AS category, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY ALL")
def accepted_by_source_category(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    own = j.select(F.col("l_partkey").alias("item"), F.col("l_suppkey").cast("string").alias("source"), F.col("o_orderpriority").alias("category"))
    return prefilter.accepted_by_category(own, table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("item")))


@query("SELECT c_mktsegment AS type, count(*) AS sources, count(*) FILTER (WHERE c_custkey % 5 <> 0) AS enabled, count(*) FILTER (WHERE c_custkey % 5 = 0) AS disabled, count(*) FILTER (WHERE c_custkey % 5 <> 0 AND c_acctbal < 0) AS failing FROM customer GROUP BY 1")
def source_type_groups(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return prefilter.source_type_groups(c.select(F.col("c_mktsegment").alias("type"), (F.col("c_custkey") % 5 != 0).alias("enabled"), (F.col("c_acctbal") < 0).cast("int").alias("fails")))


@query("""WITH l AS (SELECT user_id, max(ts) AS t, arg_max(event_type = 'error', ts) AS failed FROM events GROUP BY user_id), j AS (SELECT c_custkey AS source, c_custkey % 30 AS h, t, failed, (SELECT max(ts) FROM events) AS now FROM customer LEFT JOIN l ON user_id = c_custkey),
 w AS (SELECT *, h * 60 - (epoch_us(now) - epoch_us(t)) / 6e7 AS remain FROM j), x AS (SELECT *, CASE WHEN h = 0 THEN 'every_run' WHEN failed THEN 'retry_after_failure' WHEN t IS NULL THEN 'never_fetched' WHEN remain <= 0 THEN 'interval_elapsed' ELSE 'frequency_gate' END AS why FROM w)
 SELECT source, why <> 'frequency_gate' AS due, why, CASE WHEN why = 'frequency_gate' THEN CAST(greatest(1, floor(remain)) AS BIGINT) END AS minutes_left FROM x""")
def source_due(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("source"), F.col("ts").alias("at"), (F.col("event_type") == "error").alias("failed"))
    now = e.agg(F.max("at")).first()[0]
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("source"), (F.col("c_custkey") % 30).alias("interval_hours"))
    return prefilter.source_due(s, e, F.lit(now).cast("timestamp_ntz"))


@query("SELECT s_suppkey, CASE WHEN contains(lower(s_name || ' ' || n_name), '9') THEN 'nine' WHEN contains(lower(s_name || ' ' || n_name), '_1') THEN 'one' ELSE 'other' END AS badge, coalesce(CASE n_regionkey WHEN 0 THEN 'Zero' WHEN 1 THEN 'One' END, n_name) AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def badges_and_labels(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    badge = prefilter.source_badge(F.col("s_name"), F.col("n_name"), F.lit(""), {"nine": ["9"], "one": ["_1"]}, "other")
    return j.select("s_suppkey", badge.alias("badge"), prefilter.category_label(F.col("n_regionkey").cast("string"), F.col("n_name"), {"0": "Zero", "1": "One"}).alias("label"))
