"""Cutting articles out of pages: every rule on known cases, and against plain versions on random blocks."""

import random

from pyspark.sql import functions as F

from eventlake.operators import extract, trim

BLOCKS = "page_id long, ord int, type string, text string, links array<string>, link_chars int"


def blocks(spark, pages):
    return spark.createDataFrame([(p, i, *b) for p, rows in pages.items() for i, b in enumerate(rows)], BLOCKS)


def para(text, links=(), chars=0, kind="paragraph"):
    return kind, text, list(links), chars


def test_tails(spark):
    long_ = para("word " * 100)
    pages = {
        1: [long_, para("Related articles", kind="heading"), para("x")],
        2: [para("Related articles"), long_, para("more")],
        3: [long_, para("Get started with it", kind="heading"), para("short"), para("Related posts", kind="heading"), para("x")],
        4: [long_, para("Get started with it", kind="heading"), para("y" * 400), para("Related posts", kind="heading")],
        5: [long_, para("Try it", kind="heading"), para("1 / 3")],
        6: [],
    }
    got = {r.page_id: r.boundary for r in trim.tail_boundary(blocks(spark, pages)).collect()}
    assert got == {1: 1, 3: 1, 4: 3, 5: 2}
    cut = trim.cut_tail(blocks(spark, pages), trim.tail_boundary(blocks(spark, pages)))
    assert {r.page_id: r["count"] for r in cut.groupBy("page_id").count().collect()} == {1: 1, 2: 3, 3: 1, 4: 3, 5: 2}


def test_heads(spark):
    body = para("This is prose. " * 30)
    pages = {
        1: [para("Category: a Product: b Date: c Reading time 3 min"), body],
        2: [para("Title", kind="heading"), para("Share this article"), para("Follow"), body],
        3: [para("› Home"), para("/ The title", ["a", "b"], 9), para("The title", kind="heading"), body],
        4: [para("The title", kind="heading"), para("By Jane Doe"), para("2024-01-02"), body],
        5: [para("Opening", kind="heading"), body],
        6: [body, para("By Jane Doe")],
        7: [para("The title", kind="heading"), para("", kind="figure"), para("Published on May 1"), body],
        8: [para("By Jane Doe"), para("2024/5/6 | 3 min")],
    }
    got = {r.page_id: r.cut for r in trim.head_cut(blocks(spark, pages)).collect()}
    # an image of unknown size is no portrait: it stays
    assert got == {1: 1, 2: 3, 3: 3, 4: 3, 5: 0, 6: 0, 7: 0, 8: 2}
    sizes = {1: (300, 300, ""), 2: (300, 300, "a chart"), 3: (1200, 1200, ""), 4: (800, 300, ""), 5: (0, 0, "")}
    rows = [(p, i, *b, *((w, h, a) if b[0] == "figure" else (None, None, None))) for p, (w, h, a) in sizes.items() for i, b in enumerate(pages[7])]
    rows += [(6, 0, *para("The title", kind="heading"), None, None, None), (6, 1, *para("", kind="figure"), 300, 300, ""), (6, 2, *para("2024-01-02"), None, None, None), (6, 3, *body, None, None, None)]
    sized = spark.createDataFrame(rows, BLOCKS + ", width int, height int, alt string")
    assert {r.page_id: r.cut for r in trim.head_cut(sized).collect()} == {1: 3, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}


def plain_players(roles):
    gone = set()
    for i, r in enumerate(roles):
        if r not in ("listen", "status", "unsupported"):
            continue
        near = {j: roles[j] for j in range(max(0, i - 4), min(len(roles), i + 9)) if roles[j] not in ("", "blank")}
        kinds = set(near.values())
        if len(near) >= 3 and len(kinds & {"listen", "status", "unsupported"}) >= 2 and kinds & {"time", "list"}:
            gone |= set(near)
    return gone


def test_players_match_plain_windows(spark):
    words = {"listen": "Listen to this article - 3:20", "status": "Audio is ready", "unsupported": "Your browser does not support the audio element", "time": "0:00 / 3:20", "list": "Reading list", "": "Some prose about an audio player.", "blank": " "}
    rnd = random.Random(5)
    roles = {p: [rnd.choice(["", "", "", "", "blank", *words]) for _ in range(rnd.randint(1, 30))] for p in range(60)}
    got = {(r.page_id, r.ord) for r in trim.embedded_ui(blocks(spark, {p: [para(words[r]) for r in v] for p, v in roles.items()})).collect()}
    assert got == {(p, i) for p, v in roles.items() for i in range(len(v)) if i not in plain_players(v)}
    assert len(got) < sum(map(len, roles.values()))


def test_promotions(spark):
    pages = {1: [para("Download the guide", ["/g"], 10), para("prose"), para("Get the free report: download", ["/g"], 10), para("Sign up"), para("sign up!"), para("Book a demo")]}
    assert {r.ord for r in trim.repeated_promos(blocks(spark, pages)).collect()} == {0, 2, 3, 4}
    end = {1: [para("Try it now", ["/t"], 9), para("prose"), para("Get started with it", ["/t"], 9), para("Start building apps today!", ["/t"], 9)], 2: [para("Try it now")]}
    assert {(r.page_id, r.ord) for r in trim.terminal_promos(blocks(spark, end)).collect()} == {(1, 0), (1, 1), (2, 0)}


def test_figures(spark):
    rows = [(1, 0, "https://a.com/x.png?w=1", "", "", 0, 0, False), (1, 1, "https://A.com/x.png", "", "", 0, 0, False), (1, 2, "https://a.com/logo.png", "", "", 0, 0, False), (1, 3, "https://a.com/p.png", "", "", 300, 300, True), (1, 4, "https://a.com/s.png", "", "", 100, 300, False), (1, 5, "https://a.com/chart.png", "flow", "c", 800, 400, False), (1, 6, "https://a.com/logo.png", "", "", 0, 0, False)]
    df = spark.createDataFrame(rows, "page_id long, ord int, src string, alt string, caption string, width int, height int, next_byline boolean")
    assert [r.reason for r in trim.select_figures(df).orderBy("ord").collect()] == [None, "duplicate", "decorative", "author", "small", None, "decorative"]
    assert [r.reason for r in trim.select_figures(df, 1).orderBy("ord").collect()][0] == "limit"


def test_paragraphs_and_scripts(spark):
    split = lambda s: spark.createDataFrame([(s,)], "x string").select(trim.text_to_blocks(F.col("x")).alias("y")).first().y
    assert split("a  b\n\nc\r\n\r\n\r\nd\n\n ") == ["a b", "c", "d"] and split(None) == [] and split("One. Two.") == ["One. Two."]
    assert split("Some words here. " * 120) == ["Some words here."] * 120
    rnd = random.Random(8)
    pool = ["a short one", "x" * 30, "y" * 40, "y" * 25, "another segment of text", "z" * 120]
    rows = [(e, i, rnd.choice(pool)) for e in range(40) for i in range(rnd.randint(1, 12))]
    want = {}
    for e in range(40):
        kept, full = [], False
        for _, _, s in (r for r in rows if r[0] == e):
            again = any(k == s or (len(s) >= 24 and s in k) for k in kept)
            if again or full:
                continue
            if sum(map(len, kept)) + len(s) > 200 or len(kept) >= 8:
                full = True
                continue
            kept.append(s)
        want[e] = " ".join(kept)
    df = spark.createDataFrame(rows, "event_id long, place int, text string")
    assert {r.event_id: r.script for r in trim.narration(df, 200).collect()} == want
    scripts = spark.createDataFrame([(1, 5, "s" * 90), (2, 6, "t" * 90), (3, 7, "short")], "event_id long, seen int, script string")
    spoken = scripts.where("event_id = 1").select("event_id", F.sha2("script", 256).alias("hash"))
    assert [r.event_id for r in trim.narration_queue(scripts, spoken).collect()] == [2]


def test_pages(spark):
    html = '<div class="nav-list"><p>skip</p></div><main><div id="article-body"><h1>T</h1><p>one <a href="/x">link</a><img src="s.png" srcset="m.png 300w, l.png 900w" width="640px" height="240"><p>two</div></main>'
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>open <b>tag"), (None, "<p>x")], "page_id long, html string")
    got = extract.page_blocks(pages).collect()
    assert [(r.type, r.text, r.links, r.src, r.width) for r in got if r.page_id == 1][1:] == [("heading", "T", [], None, None), ("figure", "", [], "l.png", 640), ("paragraph", "one link", ["/x"], None, None), ("paragraph", "two", [], None, None)]
    assert [r.text for r in got if r.page_id == 3] == ["open tag"] and not [r for r in got if r.page_id == 2]
    regions = {r.attrs: (r.tag, r.depth, r.chars) for r in extract.page_regions(pages).collect()}
    assert regions == {'class="nav-list"': ("div", 0, 4), 'id="article-body"': ("div", 1, 11), "": ("main", 0, 11)}
    named = spark.createDataFrame([('class="post-content"',), ('id="related-list"',), (None,)], "a string").select(trim.classify_region(F.col("a")).alias("c")).collect()
    assert [(r.c.article, r.c.noise) for r in named] == [(True, False), (False, True), (False, False)]
    limited = trim.region_limits(spark.createDataFrame([(1, i, 10 * i, i < 4, False) for i in range(60)], "page_id long, region int, chars int, article boolean, noise boolean"), 2, 3)
    assert {(r.kind, r.region) for r in limited.collect()} == {("semantic", 3), ("semantic", 2), ("nested", 59), ("nested", 58), ("nested", 57)}
