"""Scans of landed files and sinks, on small files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eventlake.functions import scores, text
from eventlake.sources import scans, sinks


def test_sitemap_and_index(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc>http://x/blog/a-first_post/</loc><lastmod>2024-01-01</lastmod></url><url><loc>http://x/shop/b</loc></url></urlset>")
    assert [(r.url, r.lastmod, r.title) for r in scans.scan_sitemap(spark, str(tmp_path / "s.xml"), "/blog/").collect()] == [("http://x/blog/a-first_post/", "2024-01-01", "A First Post")]
    pages = spark.createDataFrame([("2023/9_1 2024/10_2",), ("2024/9_30 2024/10_2",)], "html string")
    assert [r.version for r in scans.scan_versioned_index(pages, "html", 2).collect()] == ["2024/10_2", "2024/9_30"]


def test_catalogs(spark, tmp_path):
    item = {"id": "i", "source": "s", "link": "HTTP://x/a/", "published": "p", "title": "t"}
    (tmp_path / "new.json").write_text(json.dumps({"events": [{"event_id": "e", "title": "T", "items": [item, item]}]}))
    (tmp_path / "old.json").write_text(json.dumps({"items": [item]}))
    new, old = (scans.scan_catalog_document(spark, str(tmp_path / f"{n}.json")).collect() for n in ("new", "old"))
    assert [(r.event_id, len(r["items"])) for r in new] == [("e", 2)] and [(r.title, len(r["items"]), len(r.event_id)) for r in old] == [("t", 1, 12)]
    (tmp_path / "sources.json").write_text(json.dumps([{"name": "a", "enabled": True}, {"name": "b", "enabled": False}]))
    assert [r.name for r in scans.scan_enabled_sources(spark, str(tmp_path / "sources.json"), "name string, enabled boolean").collect()] == ["a"]


def test_answers_posts_and_batches(spark, tmp_path):
    hits = [{"title": "a", "url": "", "objectID": "1", "created_at_i": 0, "points": 50}, {"title": "b", "url": "u", "objectID": "2", "created_at_i": 60, "points": 31, "num_comments": 2}, {"title": "c", "url": "u", "objectID": "3", "created_at_i": 0, "points": 99}, {"title": "d", "url": "v", "objectID": "4", "points": 3}]
    (tmp_path / "hits.json").write_text(json.dumps({"hits": hits}))
    got = {(r.title, r.link, r.signal, r.comments) for r in scans.scan_story_json(spark, str(tmp_path / "hits.json")).collect()}
    assert got == {("a", "https://news.ycombinator.com/item?id=1", 50, 0), ("b", "u", 31, 2)}
    (tmp_path / "posts.ndjson").write_text("\n".join(json.dumps(p) for p in ({"uri": "1", "text": " x ", "likes": 12, "permalink": "p"}, {"uri": "2", "text": " ", "likes": 99}, {"uri": "3", "text": "y", "likes": 10, "facets": ["", "f"], "permalink": "p"})))
    assert {(r.uri, r.text, r.link) for r in scans.scan_post_json(spark, str(tmp_path / "posts.ndjson")).collect()} == {("1", "x", "p"), ("3", "y", "f")}
    (tmp_path / "batch.json").write_text(json.dumps({"schema_version": 1, "batch_id": "b", "items": [{"title": "t"}, {"title": "u", "category": "c"}]}))
    assert [(r.batch_id, r.place, r.title, r.category) for r in scans.scan_manual_batch(spark, str(tmp_path / "batch.json")).orderBy("place").collect()] == [("b", 0, "t", None), ("b", 1, "u", "c")]
    (tmp_path / "paths.txt").write_text("e/0123456789ab.html\ne/0123456789ab.html\ne/short.html\n")
    assert [r.id for r in scans.scan_path_ids(spark, str(tmp_path / "paths.txt")).collect()] == ["0123456789ab"]


def test_snapshots_of_valid_weeks(spark, tmp_path):
    rows = [("2024-W01", "0" * 12), ("2024-W01", "a" * 12), ("2024-W02", "0" * 12), ("2024-W02", "bad"), ("2024-W03", "0" * 12)]
    spark.createDataFrame(rows, "week_id string, event_id string").write.partitionBy("week_id").parquet(str(tmp_path / "w"))
    assert {r.week_id for r in scans.scan_snapshots(spark, str(tmp_path / "w"), ["2024-W01", "2024-W02"]).collect()} == {"2024-W01"}


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "c")
    for run, n in (("20240101", 1), ("20240102", 2), ("20240102", 3)):
        sinks.write_catalog(spark.createDataFrame([(n,)], "v int"), at, run)
    assert [r.v for r in sinks.read_current(spark, at).collect()] == [3] and spark.read.parquet(at).count() == 2
    e = spark.createDataFrame([("i", "t", "https://x/i", datetime(2024, 1, 2), "s", "b" * 50), ("j", "t", "l", datetime(2024, 1, 1), "s", "b")], "id string, title string, link string, updated timestamp, summary string, body string")
    sinks.write_lite(e, ["id", "title"], str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).columns == ["id", "title"]
    with pytest.raises(ValueError):
        sinks.write_lite(e, e.columns, str(tmp_path / "m"))
    sinks.write_agent_feed(e.select("id"), str(tmp_path / "a"))
    assert {r.value for r in spark.read.text(str(tmp_path / "a")).collect()} == {'{"schema_version":1,"id":"i"}', '{"schema_version":1,"id":"j"}'}
    sinks.write_atom_rows(e, str(tmp_path / "f"), 1)
    back = spark.read.format("xml").option("rowTag", "entry").load(str(tmp_path / "f")).collect()
    assert [r.id for r in back] == ["i"]
    both = scans.union_sources(e.select("id"), e.select("id", "title"))
    assert both.columns == ["id", "title"] and both.count() == 4


def test_small_expressions(spark):
    f, t = F.lit, datetime
    r = spark.range(1).select(
        scores.clamp_future(f(t(2024, 1, 2)), f(t(2024, 1, 1))).alias("a"), scores.backfill_date(f(None).cast("timestamp"), f(t(2024, 1, 3)), f(t(2024, 1, 1))).alias("b"), scores.editorial_time(f(None).cast("timestamp"), f(t(2024, 1, 3))).alias("c"), scores.age_bucket(f(t(2024, 1, 1)), f(t(2024, 1, 3))).alias("d"),
        scores.ordered_union(F.array(f("a"), f("b")), F.array(f("b"), f("c")), 3).alias("e"), scores.merge_tags(F.array(f(" a "), f("x")), F.array(f("b"), f("a")), F.array(f("a"), f("b"))).alias("g"),
        (text.pair_key(f("A b"), f("c")) == text.pair_key(f("c "), f("a  b"))).alias("h"), text.same_site(f("img.a.com"), f("a.com")).alias("i"), text.clip_sentence(f("One two. Three four"), 12).alias("j"), text.clean_narration(f("a [b](http://x) ```c``` <i>d</i>")).alias("k"),
        text.token_estimate(f(3000), 100).alias("l"), text.query_bucket(f(5)).alias("m"), text.viewport_bucket(f(700)).alias("n"), text.clean_page_title(f("A title | Site")).alias("o"), (text.content_hash(f("a"), f("b")) == text.content_hash(f(" a "), f("b\n"))).alias("p"),
    ).first()
    assert r.a == t(2024, 1, 1) and r.b is None and r.c == t(2024, 1, 3) and r.d == "week" and r.e == ["a", "b", "c"] and r.g == ["a", "b"]
    assert r.h and r.i and r.j == "One two." and r.k == "a b d" and r.l == 1100 and r.m == "4-8" and r.n == "m" and r.o == "A title" and r.p


RSS = """\ufeff<?xml version="1.0"?><rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Site</title>
<item><title>Fish & chips&nbsp;today</title><link>https://a.example/1?x=1&y=2</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description>Short</description><content:encoded><![CDATA[<p>Long &amp; <b>rich</b></p>]]></content:encoded></item>
<item><title>Only described</title><link> https://a.example/2 </link><description>R&D &mdash; more</description></item>
<item><title></title><link>https://a.example/3</link></item><item><title>No link</title></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">One &amp; two</title><link rel="self" href="https://b.example/self"/><link rel="alternate" href="https://b.example/1"/><updated>2024-02-03T00:00:00Z</updated><summary>S</summary><content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>Body</p></div></content></entry>
<entry><title>Plain</title><link href="https://b.example/2"/><published>2024-02-01T00:00:00Z</published><updated>2024-02-03T00:00:00Z</updated><summary>Only this</summary></entry></feed>"""


def test_feeds_are_repaired(spark, tmp_path):
    for name, text in {"a.xml": RSS, "b.xml": ATOM, "c.xml": "<rss><channel><item><title>broken</tit", "d.xml": "<rss><channel></channel></rss>"}.items():
        (tmp_path / name).write_text(text)
    items, files = scans.scan_feeds(spark, str(tmp_path))
    got = {(r.file[-5:], r.at): r for r in items.collect()}
    assert {k: (r.title, r.link, r.summary) for k, r in got.items()} == {
        ("a.xml", 0): ("Fish & chips today", "https://a.example/1?x=1&y=2", "Long & rich"), ("a.xml", 1): ("Only described", "https://a.example/2", "R&D — more"),
        ("b.xml", 0): ("One & two", "https://b.example/1", "Body"), ("b.xml", 1): ("Plain", "https://b.example/2", "Only this"),
    }
    assert got["a.xml", 0].feed_content_html == "<p>Long &amp; <b>rich</b></p>" and "<p>Body</p>" in got["b.xml", 0].feed_content_html
    assert (got["a.xml", 0].published, got["a.xml", 1].published, got["b.xml", 1].published) == ("Mon, 01 Jan 2024 10:00:00 GMT", None, "2024-02-01T00:00:00Z")
    assert {r.file[-5:]: (r.bad, r["items"]) for r in files.collect()} == {"a.xml": (False, 2), "b.xml": (False, 2), "c.xml": (True, 0), "d.xml": (False, 0)}
    assert scans.scan_feeds(spark, str(tmp_path), 1)[0].count() == 2
