"""Caches, queues and ledgers. Documents and labels stand in for candidates and decisions, clicks for calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.operators import caches
from eventlake.query_sets.registry import query, table

_NOW = "TIMESTAMP '2024-03-01'"
_C = f"""WITH cand AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS key, n_chars AS content_hash, 'm' AS model, 'r1' AS rule_version FROM documents),
 cache AS (SELECT sha256(CAST(l.doc_id AS VARCHAR)) AS key, CASE WHEN l.doc_id % 7 = 0 THEN -1 ELSE n_chars END AS content_hash, 'm' AS model, CASE WHEN l.doc_id % 11 = 0 THEN 'r0' ELSE 'r1' END AS rule_version,
  CASE WHEN l.doc_id % 13 = 0 THEN 'error' WHEN quality = 1 THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN l.doc_id % 17 <> 0 THEN {_NOW} - to_hours(CAST(l.doc_id % 700 AS INT)) END AS decided FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
 j AS (SELECT doc_id, cand.key, cache.key IS NOT NULL AS found, cache.content_hash IS NOT DISTINCT FROM cand.content_hash AS same, cache.rule_version = cand.rule_version AS ver, status, coalesce((epoch_us({_NOW}) - epoch_us(decided)) / 3.6e9, 1e12) AS age FROM cand LEFT JOIN cache USING (key)),
 looked AS (SELECT doc_id, status, CASE WHEN NOT found THEN 'absent' WHEN NOT same THEN 'content_changed' WHEN NOT ver THEN 'version_invalidated' WHEN status = 'error' THEN CASE WHEN age < 6 THEN 'error_backoff' ELSE 'error_retry' END WHEN age > 504 THEN 'expired' ELSE 'hit' END AS reason FROM j)
"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", caches.url_key(F.col("doc_id").cast("string")).alias("key"), F.col("n_chars").alias("content_hash"), F.lit("m").alias("model"), F.lit("r1").alias("rule_version"))


def cache(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    i = F.col("doc_id")
    status = F.when(i % 13 == 0, "error").when(F.col("quality") == 1, "accepted").otherwise("rejected")
    return j.select(
        caches.url_key(i.cast("string")).alias("key"), F.when(i % 7 == 0, F.lit(-1).cast("long")).otherwise(F.col("n_chars")).alias("content_hash"), F.lit("m").alias("model"),
        F.when(i % 11 == 0, "r0").otherwise("r1").alias("rule_version"), status.alias("status"), F.when(i % 17 != 0, F.expr("timestamp_ntz'2024-03-01' - make_dt_interval(0, cast(doc_id % 700 as int))")).alias("decided"),
        F.struct(F.concat(F.lit("title "), i.cast("string")).alias("title")).alias("enrichment"),
    )


def looked(spark: SparkSession, d: str) -> DataFrame:
    return caches.lookup(candidates(spark, d), cache(spark, d), F.lit("2024-03-01").cast("timestamp_ntz"))


@query(_C + "SELECT doc_id, reason, CASE WHEN reason IN ('hit', 'error_backoff') THEN status END AS status FROM looked")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    return looked(spark, d).select("doc_id", "reason", "status")


@query(_C + "SELECT reason, count(*) AS n FROM looked GROUP BY reason")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return caches.lookup_stats(looked(spark, d))


@query(_C + "SELECT doc_id, CASE WHEN reason = 'hit' AND status = 'accepted' THEN 'title ' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS title FROM looked WHERE NOT coalesce(CASE WHEN reason IN ('hit', 'error_backoff') THEN status END IN ('rejected', 'error'), false)")
def cache_precheck(spark: SparkSession, d: str) -> DataFrame:
    kept = caches.precheck(looked(spark, d)).select("doc_id", F.col("doc_id").cast("string").alias("title"), "enrichment")
    return caches.overlay(kept, "enrichment", ["title"])


@query(_C + f"SELECT key, rule_version, status, decided FROM cache WHERE key NOT IN (SELECT sha256(CAST(doc_id AS VARCHAR)) FROM documents WHERE doc_id % 5 = 0) UNION ALL SELECT key, rule_version, 'accepted', {_NOW} FROM cand WHERE doc_id % 5 = 0")
def cache_remember(spark: SparkSession, d: str) -> DataFrame:
    c = cache(spark, d)
    new = candidates(spark, d).where("doc_id % 5 = 0").select("key", "content_hash", "model", "rule_version", F.lit("accepted").alias("status"), F.lit("2024-03-01").cast("timestamp_ntz").alias("decided"), F.lit(None).cast(c.schema["enrichment"].dataType).alias("enrichment"))
    older = new.withColumn("status", F.lit("rejected")).withColumn("decided", F.lit("2024-02-01").cast("timestamp_ntz"))
    return caches.remember(c, older.union(new)).select("key", "rule_version", "status", "decided")


@query(_C + f"SELECT key, decided FROM cache WHERE decided > {_NOW} - INTERVAL 28 DAY ORDER BY decided DESC, key LIMIT 50")
def cache_prune(spark: SparkSession, d: str) -> DataFrame:
    return caches.prune(cache(spark, d), F.lit("2024-03-01").cast("timestamp_ntz"), newest=50).select("key", "decided")


@query("SELECT l_partkey * 100 + l_linenumber AS item, status FROM lineitem JOIN (SELECT l_orderkey AS o, max(CASE WHEN l_quantity > 25 THEN 'accepted' ELSE 'rejected' END) AS status FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON o = l_orderkey")
def propagate_verdict(spark: SparkSession, d: str) -> DataFrame:
    item = (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("item")
    li = table(spark, d, "lineitem")
    group = li.select(F.col("l_orderkey").alias("group_id"), item, (F.col("l_linenumber") == 1).alias("is_primary"), F.concat_ws(":", "l_orderkey", item).alias("own"), "l_quantity")
    said = group.groupBy("own").agg(F.max(F.when(F.col("l_quantity") > 25, "accepted").otherwise("rejected")).alias("status"))
    named = group.select("group_id", F.col("own").alias("item"), "is_primary")
    return caches.propagate(named, said.withColumnRenamed("own", "item")).select(F.element_at(F.split("item", ":"), -1).cast("long").alias("item"), "status")


@query("SELECT d.doc_id AS id FROM documents d WHERE d.doc_id NOT IN (SELECT l.doc_id FROM labels l JOIN documents e ON e.doc_id = l.doc_id WHERE quality = 1 AND l.doc_id % 3 <> 0)")
def not_completed(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    done = docs.join(table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality"), "id").select("id", "hash", F.when(F.col("id") % 3 != 0, "v2").otherwise("v1").alias("version"), F.when(F.col("quality") == 1, "pass").otherwise("suspect").alias("quality"))
    return caches.not_completed(docs, done, "v2").select("id")


@query("SELECT o_orderkey AS event_id, o_orderstatus = 'F' OR o_orderkey % 100 = 1 AS pinned FROM orders WHERE o_orderkey % 50 <> 7")
def curate(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), (F.col("o_orderstatus") == "F").alias("pinned"))
    return caches.curate(o, o.where("event_id % 100 = 1"), o.where("event_id % 50 = 7"))


@query("SELECT DISTINCT strftime(o_orderdate, '%G-W%V') AS week_id FROM orders ORDER BY 1 DESC LIMIT 26")
def weekly_cache_keep(spark: SparkSession, d: str) -> DataFrame:
    weeks = table(spark, d, "orders").select(F.concat(F.extract(F.lit("YEAROFWEEK"), "o_orderdate").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("o_orderdate").cast("string"), 2, "0")).alias("week_id"))
    return caches.keep_weeks(weeks).distinct()


_CALLS = "SELECT event_id AS call, user_id AS run_id, CAST(ts AS DATE) AS day, event_type AS purpose, ts AS started, CASE WHEN event_id % 4 <> 0 THEN CAST(floor(value) AS BIGINT) END AS total, 40 AS reserved, event_type = 'error' AS failed FROM events"


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("call"), F.col("user_id").alias("run_id"), F.to_date("ts").alias("day"), F.col("event_type").alias("purpose"), F.col("ts").alias("started"),
        F.when(F.col("event_id") % 4 != 0, F.floor("value")).alias("total"), F.lit(40).cast("long").alias("reserved"), (F.col("event_type") == "error").alias("failed"),
    )


@query(f"WITH c AS ({_CALLS}), l AS (SELECT * FROM c WHERE run_id % 10 <> 3 UNION ALL SELECT * FROM c WHERE run_id % 10 = 3 AND call % 2 = 0) SELECT day, purpose, count(*) AS calls, count(*) FILTER (WHERE failed) AS failures, sum(coalesce(total, reserved))::BIGINT AS tokens FROM l GROUP BY GROUPING SETS ((day), (day, purpose))")
def ledger_daily(spark: SparkSession, d: str) -> DataFrame:
    c = calls(spark, d)
    return caches.daily_totals(caches.append_runs(c, c.where("run_id % 10 = 3 and call % 2 = 0")))


@query(f"WITH c AS ({_CALLS}), y AS (SELECT DISTINCT day FROM c ORDER BY day DESC LIMIT 5), r AS (SELECT run_id, max(started) AS t FROM c GROUP BY run_id ORDER BY t DESC, run_id DESC LIMIT 10) SELECT run_id, call, day FROM c WHERE day IN (SELECT day FROM y) AND run_id IN (SELECT run_id FROM r) ORDER BY started DESC, run_id DESC, call DESC LIMIT 100")
def ledger_prune(spark: SparkSession, d: str) -> DataFrame:
    return caches.prune_ledger(calls(spark, d), 5, 10, 100).select("run_id", "call", "day")


@query("SELECT conv_id AS doc_id, (2 * sum(greatest(512, length(text) // 3 + 300)))::BIGINT AS tokens, count(*) AS chunks FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def whole_doc_estimate(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("text is not null").select(F.col("conv_id").alias("doc_id"), F.length("text").alias("chars"))
    return caches.whole_estimate(c, 300)


_E = f"SELECT o_orderkey AS event_id, o_orderdate AS seen, o_orderstatus = 'F' AS translated, CASE WHEN o_orderkey % 3 = 0 THEN (SELECT max(o_orderdate) FROM orders) - to_hours(CAST(o_orderkey % 300 AS INT)) END AS tried, CASE o_orderkey % 3 WHEN 0 THEN 'summary' WHEN 1 THEN 'original' ELSE 'translated' END AS mode, CASE WHEN o_orderkey % 4 > 0 THEN 'v' || o_orderkey % 4 END AS version, o_orderkey % 20 = 0 AS pinned, CAST(floor(o_totalprice) AS BIGINT) % 101 AS importance, o_custkey % 100 AS heat, (SELECT max(o_orderdate) FROM orders) AS now FROM orders"


def queue_events(spark: SparkSession, d: str) -> tuple[DataFrame, object]:
    o, i = table(spark, d, "orders"), F.col("o_orderkey")
    now = F.lit(o.agg(F.max("o_orderdate")).first()[0]).cast("timestamp_ntz")
    mode = F.when(i % 3 == 0, "summary").when(i % 3 == 1, "original").otherwise("translated")
    e = o.withColumn("now", now).select(
        i.alias("event_id"), F.col("o_orderdate").alias("seen"), (F.col("o_orderstatus") == "F").alias("translated"), F.when(i % 3 == 0, F.expr("now - make_dt_interval(0, cast(o_orderkey % 300 as int))")).alias("tried"), mode.alias("mode"),
        F.when(i % 4 > 0, F.concat(F.lit("v"), (i % 4).cast("string"))).alias("version"), (i % 20 == 0).alias("pinned"), (F.floor("o_totalprice") % 101).alias("importance"), (F.col("o_custkey") % 100).alias("heat"),
    )
    return e, now


@query(f"WITH e AS ({_E}) SELECT event_id FROM e WHERE seen > now - INTERVAL 60 DAY AND NOT translated AND (tried IS NULL OR tried <= now - INTERVAL 6 HOUR) ORDER BY seen DESC, event_id LIMIT 30")
def metadata_backfill(spark: SparkSession, d: str) -> DataFrame:
    e, now = queue_events(spark, d)
    return caches.backfill_queue(e, now, 30, days=60).select("event_id")


@query(f"WITH e AS ({_E}) SELECT event_id FROM e WHERE seen > now - INTERVAL 90 DAY AND (mode IN ('summary', 'original') OR coalesce(version <> 'v3', true)) AND (tried IS NULL OR tried <= now - INTERVAL 7 DAY) ORDER BY tried IS NOT NULL, pinned DESC, coalesce(version <> 'v3', true) DESC, mode, importance DESC, heat DESC, seen DESC, event_id LIMIT 25")
def translation_backlog(spark: SparkSession, d: str) -> DataFrame:
    e, now = queue_events(spark, d)
    return caches.translation_backlog(e, now, "v3", 25, days=90).select("event_id")


@query("SELECT l_orderkey AS event_id, count(*) AS figures, max(l_shipdate) AS seen FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY figures DESC, seen DESC, event_id LIMIT 48")
def retry_media_queue(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_shipdate").alias("seen"), (F.col("l_returnflag") == "R").alias("retryable"))
    return caches.retry_media_queue(f)


@query("SELECT o_orderkey AS event_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def catalog_order(spark: SparkSession, d: str) -> DataFrame:
    """The newest of the catalog in its order."""
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200).select(F.col("o_orderkey").alias("event_id"))
