"""Operators of single subjects on small cases, and folds against plain versions."""

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventlake.functions import scores, text
from eventlake.operators import caches, feeds, merge, resolve, weekly
from eventlake.query_sets import weekly as weekly_queries
from eventlake.streaming import jobs, push

SF = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_dates_of_feeds_and_pages(spark):
    for s in ("Mon, 10 Aug 2026 08:00:00 GMT", "2026-08-10T08:00:00.123Z", "2026-08-10T08:00:00Z", "Mon, 10 Aug 2026 03:00:00 EST", "2026-08-10T10:00:00+02:00", "2026-08-10T10:00:00+0200", "2026-08-10 08:00:00"):
        assert str(one(spark, s, scores.parse_date_multi)) == "2026-08-10 08:00:00", s
    for s in ("Aug 10, 2026", "August 10, 2026", "2026-08-10", "10 Aug 2026"):
        assert str(one(spark, s, scores.parse_date_multi)) == "2026-08-10 00:00:00", s
    assert one(spark, "soon", scores.parse_date_multi) is None and one(spark, None, scores.parse_date_multi) is None
    page = '<meta name="date" content="1999-01-01"><script>{"datePublished": "2024-05-06T07:08:09Z"}</script>'
    assert str(one(spark, page, scores.meta_date)) == "2024-05-06 07:08:09"
    assert one(spark, '<time datetime="1999-01-01">', scores.meta_date) is None


def test_strict_urls_and_texts(spark):
    assert one(spark, "http://ex.com/?source=rss&spm=3&utm_x=1&c=", text.norm_url_strict) == "http://ex.com/?spm=3&c="
    assert one(spark, "<p>a&nbsp;&mdash; b&#233;&#x4e2d; &lt;i&gt;</p>", text.strip_html) == "a — bé中 <i>"
    assert one(spark, "a & b &nbsp; &amp; &#12;", text.repair_markup) == "a &amp; b   &amp; &#12;"
    assert one(spark, "OpenAI (Beta) Engineering Blog", text.source_family) == "openai"
    assert one(spark, "某某官方博客", text.source_family) == "某某"
    assert one(spark, "推荐理由：推荐理由: x", lambda c: text.clean_reason(c, ("推荐理由",))) == "x"
    assert one(spark, "/weekly/1", lambda c: text.page_from_path(c, {"week": "^/weekly"})) == "week"
    buckets = [one(spark, h, lambda c: text.referrer_bucket(c, F.lit("a.com"), {"search": "google"})) for h in ("", "A.com", "www.google.de", "b.com")]
    assert buckets == ["direct", "internal", "search", "other"]


def test_scores(spark):
    f = F.lit
    row = spark.range(1).select(
        scores.primary_source_score(f("official_high"), f(2), f(True), f(155), f(420)).alias("a"), scores.personal_score(f(2), f(50), f(60.0), f(3), f(4), f(True)).alias("b"), scores.is_classic(f(datetime(2024, 1, 1)), f(True), f(datetime(2024, 2, 1))).alias("c"),
        scores.completed_week(f(datetime(2024, 1, 10))).alias("d"), scores.entry_updated(f(datetime(2024, 1, 1)), f(None).cast("timestamp"), F.array(f(datetime(2024, 1, 3)))).alias("e"),
    ).first()
    assert row.a == 80 + 10 + 15 + 15 + 4 and abs(row.b - (100 + 18 + 17.5 + 12 + 12.9 + 12 + 10)) < 1e-9 and row.c
    assert str(row.d) == "2024-01-01" and row.e == datetime(2024, 1, 3)


def plain_pick(rows, categories, least, most, cap):
    rows = sorted(rows, key=lambda r: (r["heat"], r["importance"], r["items"], r["published"], r["event_id"]), reverse=True)
    chosen = []
    ok = lambda r: r not in chosen and r["family"] and sum(c["family"] == r["family"] for c in chosen) < cap
    for c in categories:
        chosen += [r for r in rows if r["category"] == c and ok(r)][:1]
    for r in rows:
        if len(chosen) < most and ok(r):
            chosen.append(r)
    chosen.sort(key=lambda r: (r["heat"], r["importance"], r["event_id"]), reverse=True)
    return [r["event_id"] for r in chosen] if len(chosen) >= least else []


def test_weekly_pick_matches_plain_fold(spark):
    rnd = random.Random(9)
    rows = [("w%d" % rnd.randint(1, 4), i, rnd.choice(["a", "a", "a", "b", "c", ""]), rnd.choice("xyz"), rnd.randint(0, 30), rnd.randint(45, 60), rnd.randint(1, 3), rnd.randint(0, 9)) for i in range(400)]
    names = ("week_id", "event_id", "family", "category", "heat", "importance", "items", "published")
    df = spark.createDataFrame(rows, "week_id string, event_id long, family string, category string, heat int, importance int, items int, published int")
    got: dict = {}
    for r in weekly.weekly_pick(df, ["z", "y", "x", "q"], least=3, most=5).orderBy("week_id", "place").collect():
        got.setdefault(r.week_id, []).append(r.event_id)
    each = [dict(zip(names, r, strict=True)) for r in rows]
    assert got == {w: p for w in {r[0] for r in rows} if (p := plain_pick([r for r in each if r["week_id"] == w], ["z", "y", "x", "q"], 3, 5, 2))}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_weekly_pick_on_a_whole_table(spark):
    rows = [r.asDict() | {"items": 1, "event_id": r.event} for r in weekly_queries.events(spark, SF).where("importance >= 45").collect()]
    weeks: dict = {}
    for r in rows:
        weeks.setdefault(r["week_id"], []).append(r)
    got: dict = {}
    for r in weekly_queries.weekly_pick(spark, SF).orderBy("week_id", "place").collect():
        got.setdefault(r.week_id, []).append(r.event_id)
    assert got == {w: p for w, v in weeks.items() if (p := plain_pick(v, weekly_queries.CATEGORIES, 3, 8, 2))}


def test_push_cycle(spark):
    """A silent first run; later ones push what became recommended while young, within the caps, and never twice."""
    now = lambda h: F.lit(datetime(2024, 1, 5, h)).cast("timestamp")
    schema = "event_id string, importance int, recommended boolean, discovered timestamp"
    day = datetime(2024, 1, 5)
    first = spark.createDataFrame([("a", 90, True, day), ("b", 10, False, day)], schema)
    state = push.baseline(first, now(1))
    assert {r.event_id: r.status for r in state.collect()} == {"a": "seen", "b": "seen"}
    feed = spark.createDataFrame([("a", 90, True, day), ("b", 85, True, day), ("c", 99, True, datetime(2023, 12, 1)), ("d", 80, True, day), ("e", 81, True, day), ("f", None, True, day)], schema)
    state = push.advance(state, feed, now(2))
    assert {r.event_id: r.status for r in state.collect()} == {"a": "seen", "b": "pending", "c": "expired", "d": "pending", "e": "pending", "f": "pending"}
    attempts = spark.createDataFrame([(day.date(), 2)], "day date, n int")
    chosen = push.select_pushes(state, feed, attempts, now(2))
    assert [(r.event_id, r.place) for r in chosen.orderBy("place").collect()] == [("b", 1), ("e", 2), ("d", 3)]
    state = push.record_results(push.record_attempts(state, chosen, now(2)), spark.createDataFrame([("b", True), ("e", False)], "event_id string, ok boolean"))
    assert {r.event_id: r.status for r in state.collect()} == {"a": "seen", "b": "sent", "c": "expired", "d": "attempted", "e": "failed", "f": "pending"}
    again = push.advance(state, spark.createDataFrame([("b", 85, True, day), ("f", 1, False, day)], schema), now(3))
    assert {r.event_id: r.status for r in again.collect()} == {"a": "seen", "b": "sent", "c": "expired", "d": "attempted", "e": "failed", "f": "seen"}
    kept, counters = push.trim(again, attempts, F.lit(datetime(2024, 4, 4, 2, 30)).cast("timestamp"))
    assert {r.event_id for r in kept.collect()} == {"b", "f"} and counters.count() == 0


def test_late_rows_and_merges(spark):
    batch = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 20)), (3, None)], "id long, ts timestamp")
    fresh, late = jobs.split_late(batch, F.lit(datetime(2024, 1, 12)).cast("timestamp"))
    assert {r.id for r in fresh.collect()} == {2, 3} and {r.id for r in late.collect()} == {1}
    pairs = spark.createDataFrame([(2, 3), (5, 4)], "a long, b long")
    into = {r.event: r.into for r in resolve.late_merge(spark.range(6), pairs).collect()}
    assert into == {0: 0, 1: 1, 2: 2, 3: 2, 4: 4, 5: 4}
    none = resolve.late_merge(spark.range(2), pairs.limit(0)).collect()
    assert {(r.event, r.into) for r in none} == {(0, 0), (1, 1)}
    rows = [("e", 1, ["v", None, "w"], 5), ("e", 0, None, 9), ("e", 2, ["w", "x"], 1)]
    got = spark.createDataFrame(rows, "event_id string, seq int, vendors array<string>, signal int").groupBy("event_id").agg(merge.in_order("vendors", "seq").alias("v")).first().v
    assert got == ["v", None, "w", "x"]


def test_cache_reasons_at_their_edges(spark):
    c = spark.createDataFrame([(k, "h", "m", "r") for k in "abcdef"], "key string, content_hash string, model string, rule_version string")
    now, t = F.lit(datetime(2024, 2, 1)).cast("timestamp"), datetime
    cache = spark.createDataFrame(
        [("a", "h", "m", "r", "accepted", t(2024, 1, 20), "x"), ("b", "other", "m", "r", "accepted", t(2024, 1, 20), "x"), ("c", "h", "m", "old", "accepted", t(2024, 1, 20), "x"), ("d", "h", "m", "r", "error", t(2024, 1, 31, 20), "x"), ("e", "h", "m", "r", "rejected", None, "x")],
        "key string, content_hash string, model string, rule_version string, status string, decided timestamp, enrichment string",
    )
    got = {r.key: (r.reason, r.status, r.enrichment) for r in caches.lookup(c, cache, now).collect()}
    assert got == {"a": ("hit", "accepted", "x"), "b": ("content_changed", None, None), "c": ("version_invalidated", None, None), "d": ("error_backoff", "error", None), "e": ("expired", None, None), "f": ("absent", None, None)}
    assert {r.key for r in caches.precheck(caches.lookup(c, cache, now)).collect()} == {"a", "b", "c", "e", "f"}


def test_claims_and_anchors(spark):
    grounded = lambda a, n, b: spark.range(1).select(weekly.anchor_grounded(F.lit(a), F.array(*(F.lit(x) for x in n)), F.lit(b), ["数据平台"]).alias("y")).first().y
    assert grounded("Acme ships", ["acme"], "") and grounded("grew 42%", ["q"], "by 42% today") and grounded("the Lakehouse", ["q"], "a lakehouse")
    assert grounded("语义约束上线", ["q"], "新的语义约束") and not grounded("数据平台", ["q"], "数据平台") and not grounded("it is", ["q"], "text") and not grounded("x", ["q"], "x")
    over = lambda s: one(spark, s, lambda c: weekly.overstates(c, ["转向"], ["尚未"]))
    assert over("行业转向") and not over("尚未看到转向") and over("尚未" + "甲" * 20 + "转向") and not over(None)


def test_nested_json_and_bodies(spark):
    rows = spark.createDataFrame([(1, '{"a": {"body": 1}}'), (2, '[{"body": {"body": 2}}]'), (3, "no json"), (4, None)], "id long, j string")
    assert {(r.path, r.rows) for r in feeds.forbidden_keys(rows, "j", "id", ("body",), 4).collect()} == {("$.a.body", 1), ("$[*].body", 1), ("$[*].body.body", 1)}
    assert one(spark, "so: {\"x\": [1]} ok", lambda c: F.try_variant_get(feeds.parse_object(c), "$.x[0]", "int")) == 1
    assert one(spark, "[1]", lambda c: feeds.parse_object(c).isNull()) and one(spark, "nothing", lambda c: feeds.parse_object(c).isNull())
