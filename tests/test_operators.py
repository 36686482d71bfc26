import os
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from eventlake import queries as core
from eventlake.functions import scores, text
from eventlake.operators import events, extract, folds, similar
from eventlake.operators.graph import connected_components
from eventlake.sources import scans, sinks

SF = "/root/testdata/sf0.001"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_urls(spark):
    assert one(spark, "HTTP://Ex.com/a/?utm_source=1&b=2&referrer=x&c=#f", text.norm_url) == "http://ex.com/a?b=2"
    assert one(spark, "http://ex.com?utm_x=1&c=&ref=2", text.norm_url_strict) == "http://ex.com/?c="
    assert one(spark, "http://u:p@ex.com/", text.safe_url) == ""
    assert one(spark, "https://ex.com/a", text.safe_url) == "https://ex.com/a"


def test_bigrams(spark):
    assert one(spark, "a", text.title_bigrams) == ["a"]
    assert one(spark, "!", text.title_bigrams) == []
    assert one(spark, "AbAb", text.title_bigrams) == ["ab", "ba"]


def test_dates(spark):
    for s in ("2024-01-02T03:04:05+00:00", "Tue, 02 Jan 2024 03:04:05 +0000", "2024-01-02 03:04:05"):
        assert str(one(spark, s, scores.parse_date_multi)) == "2024-01-02 03:04:05"
    assert one(spark, "no date", scores.parse_date_multi) is None


def test_chunks(spark):
    df = spark.createDataFrame([(["aa", "bb", "ccccccc", "d"],)], "x array<string>")
    assert df.select(scores.pack_chunks(F.col("x"), 6).alias("y")).first().y == ["aa\n\nbb", "ccccccc", "d"]


def test_components_match_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: v for k, v in label.items() if any(a != b and k in (a, b) for a, b in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_pairs_match_all_pairs(spark):
    rnd = random.Random(2)
    rows = [(i, sorted({rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 6))})) for i in range(60)]
    got = {(r.a, r.b) for r in similar.all_pairs(spark.createDataFrame(rows, "id long, grams array<string>"), 0.3).collect()}
    want = {(i, j) for i, x in rows for j, y in rows if i < j and x and y and len({*x} & {*y}) / len({*x} | {*y}) > 0.3}
    assert got == want


def test_similar_pairs_of_a_group(spark):
    rnd = random.Random(5)
    rows = [(i, sorted({rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 6))}), rnd.choice(["x", "y", None])) for i in range(60)]
    got = {(r.a, r.b) for r in similar.all_pairs(spark.createDataFrame(rows, "id long, grams array<string>, lang string"), 0.3, group="lang").collect()}
    want = {(i, j) for i, x, k in rows for j, y, m in rows if i < j and k and k == m and x and y and len({*x} & {*y}) / len({*x} | {*y}) > 0.3}
    assert got == want


def test_copies_cost_a_row_each(spark):
    rows = [(i, ["ab", "cd", "ef"]) for i in range(300)] + [(300, ["ab", "cd", "xy"]), (301, None), (302, [])]
    got = {(r.a, r.b) for r in similar.similar_pairs(spark.createDataFrame(rows, "id long, grams array<string>"), 0.3).collect()}
    assert got == {(0, i) for i in range(1, 301)}


def test_same_event_rules(spark, tmp_path):
    """Pairs between 0.3 and 0.6 count; nothing behind a first line's 80th character is cut; two items pass the gate."""
    same, other = "word " * 20, " ending alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, "budget vote delayed again", "en"), (2, "budget vote passed", "en"), (3, same + other, "en"), (4, same + " 0123456789 9876543210 1357924680", "en"), (5, "budget vote passed", "de"), (6, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    near = {(r.a, r.b): r.similarity for r in similar.all_pairs(core._title_lines(spark, str(tmp_path)), core.SAME_EVENT).collect()}
    assert set(near) == {(1, 2), (1, 5), (2, 5)} and 0.3 < near[1, 2] < 0.6
    assert {r.id: r.group_id for r in core.same_event_groups(spark, str(tmp_path)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6}
    assert {(r.id, r.other) for r in similar.nearest_sets(core._title_lines(spark, str(tmp_path), "lang"), 3, core.SAME_EVENT, group="lang").collect()} == {(1, 2), (2, 1)}
    gate = spark.range(1).select(events.quality_gate(F.lit(False), F.lit(1), F.lit(1.0), F.lit(2)).alias("ok")).first()
    assert gate.ok


def test_drop_seen_compares_whole_texts(spark, tmp_path):
    start = "the same opening " * 10
    rows = [(1, start + "and an end"), (2, start + "and  another\nend"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, start + "and another end"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in core.drop_seen_whole(spark, str(tmp_path)).collect()} == {1, 3}
    # only behind the 80th character
    assert "da" in {r.gram for r in core.title_line_bigram_df(spark, str(tmp_path)).collect()}


def test_caps_match_greedy(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.randint(0, 5), rnd.randint(0, 99)) for i in range(200)]
    kept, seen = set(), {}
    for i, k, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        if seen.get(k, 0) < 3:
            seen[k] = seen.get(k, 0) + 1
            kept.add(i)
    df = spark.createDataFrame(rows, "id long, k int, v int")
    assert {r.id for r in events.cap_per_key(df, "k", [F.desc("v"), F.asc("id")], 3).collect()} == kept


def test_admission_and_click_gaps(spark):
    q = spark.createDataFrame([("k", i, c) for i, c in enumerate([5, 7, 3, 1])], "key string, at long, cost long")
    rows = folds.admit_skipping(q, "cost", 10, "key").orderBy("at").collect()
    assert [r.admitted for r in rows] == [True, False, True, True]
    both = folds.admit_budgets(q, "cost", {"run": 100, "day": 50}, {"day": 41}).orderBy("at").collect()
    assert [r.admitted for r in both] == [True, False, True, True]
    c = spark.createDataFrame([("k", i, t) for i, t in enumerate([0, 500, 800, 1400, 1600])], "key string, id long, at_ms long")
    assert [r.id for r in folds.click_dedup(c, 750).orderBy("id").collect()] == [0, 2, 4]
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), i, rnd.randint(0, 40_000)) for i in range(400)]
    want, last = set(), {}
    for k, i, t in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if k not in last or t - last[k] >= 90:
            want.add(i)
            last[k] = t
    assert {r.id for r in folds.click_dedup(spark.createDataFrame(rows, "key string, id long, at_ms long"), 90).collect()} == want


def plain_page(rows, size, adjacent, caps, fill):
    """Three passes over rows in order; each takes what its rules admit."""
    chosen = []

    def fits(r, level):
        if r["vendor"] is not None and sum(c["vendor"] == r["vendor"] for c in chosen) >= 4:
            return False
        if r["source"] in caps and sum(c["source"] == r["source"] for c in chosen) >= caps[r["source"]]:
            return False
        if level < 2 and not adjacent and chosen and r["source"] is not None and chosen[-1]["source"] == r["source"]:
            return False
        return level == 2 or sum(c["category"] == r["category"] for c in chosen) < 12 or (level == 1 and r["quality"])

    for level in range(3):
        for r in rows:
            if len(chosen) < size and r not in chosen and fits(r, level):
                chosen.append(r)
    for r in rows if fill else ():
        if len(chosen) < size and r not in chosen:
            chosen.append(r)
    return chosen


def test_diverse_pages_match_plain_passes(spark):
    rnd = random.Random(23)
    rows = [(i, date(2024, 1, 1 + i % 3), rnd.randint(0, 60), rnd.randint(0, 3), 50, rnd.choice(["s1", "s2", "s3", "s4", "s5", None]), rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice("xxxy"), rnd.random() < 0.3) for i in range(240)]
    schema = "event_id long, day date, published int, heat int, importance int, source string, vendor int, category string, quality boolean"
    df = spark.createDataFrame(rows, schema)
    names = ("event_id", "day", "published", "heat", "importance", "source", "vendor", "category", "quality")
    ordered = sorted((dict(zip(names, r, strict=True)) for r in rows), key=lambda r: (r["published"], r["heat"], r["importance"], r["event_id"]), reverse=True)
    want = {}
    for day in {r["day"] for r in ordered}:
        left, page = [r for r in ordered if r["day"] == day], 0
        while left:
            chosen = plain_page(left, min(20, len(left)), False, {"s1": 2}, True)
            want |= {r["event_id"]: (day, page, place) for place, r in enumerate(chosen)}
            left, page = [r for r in left if r not in chosen], page + 1
    assert {r.event_id: (r.day, r.page, r.place) for r in folds.diverse_timeline(df, source_caps={"s1": 2}).collect()} == want
    first = plain_page(ordered, 20, True, {"s1": 2}, False)
    assert [r.event_id for r in folds.diverse_page(df, source_caps={"s1": 2}).orderBy("place").collect()] == [r["event_id"] for r in first]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_diverse_queries_on_a_whole_table(spark):
    rows = [r.asDict() for r in core._feed(spark, SF).collect()]
    ordered = sorted(rows, key=lambda r: (r["published"], r["heat"], r["importance"], r["event_id"]), reverse=True)
    want, days = {}, {}
    for r in ordered:
        days.setdefault(r["day"], []).append(r)
    for day, left in days.items():
        page = 0
        while left:
            chosen = plain_page(left, min(20, len(left)), False, {}, True)
            want |= {r["event_id"]: (day, page, place) for place, r in enumerate(chosen)}
            left, page = [r for r in left if r not in chosen], page + 1
    assert {r.event_id: (r.day, r.page, r.place) for r in core.diverse_timeline(spark, SF).collect()} == want
    assert [r.event_id for r in core.diverse_page(spark, SF).orderBy("place").collect()] == [r["event_id"] for r in plain_page(ordered, 20, True, {"7": 2}, False)]


def test_blocks(spark):
    html = "<nav><p>menu</p></nav><article><h1>T</h1><p>one <a href='x'>link</a><p>two</article><footer>f</footer><p>after"
    rows = extract.page_blocks(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("ord").collect()
    assert [(r.type, r.text, r.region, r.link_chars) for r in rows] == [("heading", "T", 2, 0), ("paragraph", "one link", 2, 4), ("paragraph", "two", 2, 0), ("paragraph", "after", 0, 0)]


def test_feed_files(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<rss><channel><item><title>T1</title><link>http://x/1</link><pubDate>d</pubDate></item><item><title>T2</title></item></channel></rss>")
    assert [r.title for r in scans.scan_feed_items(spark, str(tmp_path / "a.xml")).collect()] == ["T1"]
    (tmp_path / "b.ndjson").write_text('{"id": "a", "n": 1}\n\n{"events": [{"id": "b", "n": 2}, {"id": "c", "n": 3}]}\nnot json\n')
    rows = scans.scan_behavior_ndjson(spark, str(tmp_path / "b.ndjson"), "id string, n int").collect()
    assert {(r.id, r.bad) for r in rows} == {("a", False), ("b", False), ("c", False), (None, True)}


def test_weekly_tables_are_immutable(spark, tmp_path):
    path = str(tmp_path / "w")
    for v in (1, 2):
        sinks.write_weekly(spark.createDataFrame([("2024-W01", v), (f"2024-W0{v + 1}", v)], "week_id string, v int"), path)
    assert {(r.week_id, r.v) for r in spark.read.parquet(path).collect()} == {("2024-W01", 1), ("2024-W02", 1), ("2024-W03", 2)}
