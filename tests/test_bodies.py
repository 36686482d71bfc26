"""Candidate bodies: containment against a plain reading of each container by itself, and the choice of bodies."""

import os
import random
import time
from html.parser import HTMLParser

import pytest

from eventlake.operators import bodies
from eventlake.operators.extract import BLOCKS, CONTAINERS, SKIP, VOID

SF = "/root/testdata/sf0.001"


class Events(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events = []

    def handle_starttag(self, tag, attrs):
        self.events.append(("open", tag, dict(attrs)))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.events.append(("open", tag, dict(attrs)))

    def handle_endtag(self, tag):
        self.events.append(("close", tag, None))

    def handle_data(self, data):
        self.events.append(("text", data, None))


def widget(attrs):
    words = " ".join(v or "" for k, v in attrs.items() if k in ("class", "id"))
    return any(x in words for x in ("audio-player", "related-posts"))


def blocks_of(events):
    """What a page of these events alone shows, in order of begins: (type, text)."""
    out, skips, open_, kind, text, begin = [], [], [], None, [], 0

    def flush():
        nonlocal kind, text
        if kind and "".join(text).split():
            out.append((begin, kind, " ".join("".join(text).split())))
        kind, text = None, []

    for i, (what, x, attrs) in enumerate(events):
        if what == "open":
            if x == "img" and not skips and attrs.get("src"):
                out.append((i, "figure", ""))
            if x in VOID:
                continue
            if x in CONTAINERS or x in SKIP or x in BLOCKS:
                flush()
            open_.append(x)
            skips += [len(open_)] if x in SKIP or x == "button" or widget(attrs) else []
            kind, begin = (BLOCKS[x], i) if x in BLOCKS and not skips else (kind, begin)
        elif what == "close":
            if x not in open_:
                continue
            if x in CONTAINERS or x in SKIP or x in BLOCKS:
                flush()
            while open_:
                top = open_.pop()
                skips = [s for s in skips if s <= len(open_)]
                if top == x:
                    break
        elif kind and not skips:
            text.append(x)
    flush()
    return [x[1:] for x in sorted(out)]


def plain(html):
    p = Events()
    p.feed(html or "")
    p.close()
    open_, out = [], []
    for i, (what, tag, attrs) in enumerate(p.events):
        if what == "open" and tag not in VOID:
            open_.append((tag, i))
        elif what == "close" and any(t == tag for t, _ in open_):
            while True:
                t, at = open_.pop()
                if t == tag:
                    break
            if tag in CONTAINERS:
                out.append(blocks_of(p.events[at : i + 1]))
    return sorted(out)


def placed(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, html string")
    slices = bodies.page_slices(df)
    regions = slices.where("kind = 'container'").selectExpr("page_id", "start as candidate", "stop", "'x' as strategy", "depth", "chars as region_chars")
    found = {(r.page_id, r.candidate): [] for r in regions.collect()}
    for r in bodies.candidate_blocks(regions, slices).orderBy("ord").collect():
        found[r.page_id, r.candidate].append((r.type, r.text))
    out = {p: [] for p, _ in pages}
    for (p, _), rows in found.items():
        out[p].append(rows)
    return {p: sorted(x) for p, x in out.items()}


def random_page(r):
    def some(depth):
        out = []
        for _ in range(r.randrange(1, 5)):
            kind = r.choice(["p", "p", "div", "article", "section", "aside", "button", "img", "ul", "widget", "text", "stray"]) if depth < 6 else "p"
            inner = f"t{r.randrange(1000)} <b>x</b>" if kind in ("p", "button") else ""
            if kind == "p":
                out.append(f"<p>{inner}" + r.choice(["</p>", "", "<button>no</button> on</p>"]))
            elif kind == "img":
                out.append('<img src="i.png">')
            elif kind == "ul":
                out.append("<ul><li>one<li>two</ul>")
            elif kind == "widget":
                out.append(f'<div class="{r.choice(["audio-player", "related-posts", "post body"])}">{some(depth + 1)}</div>')
            elif kind == "text":
                out.append("loose")
            elif kind == "stray":
                out.append(r.choice(["</div>", "<section>", "</p>", "<br/>"]))
            else:
                out.append(f"<{kind}>{inner or some(depth + 1)}</{kind}>")
        return "".join(out)

    return some(0)


def test_containment_as_each_container_alone(spark):
    r = random.Random(11)
    pages = [(i, random_page(r)) for i in range(60)] + [(60, ""), (61, None), (62, "<div><p>open")]
    got = placed(spark, pages)
    assert got == {i: plain(html) for i, html in pages}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_containment_on_all_given_pages(spark):
    pages = [(x.page_id, x.html) for x in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert placed(spark, pages) == {i: plain(html) for i, html in pages}


def test_deep_chain_is_linear(spark):
    took = []
    for n in (5_000, 20_000):
        html = "".join(f"<div><p>text {i}</p>" for i in range(n)) + "</div>" * n
        parser, began = bodies._Slices(), time.process_time()
        parser.feed(html)
        parser.close()
        took.append(time.process_time() - began)
        assert sum(r[0] == "container" for r in parser.rows) == n
    assert took[1] < 10 * took[0] + 0.2
    slices = bodies.page_slices(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert bodies.candidate_regions(slices).count() == bodies.NESTED


PROSE = "The quick brown fox jumps over the lazy dog near the river. "


def chosen(spark, **pages):
    df = spark.createDataFrame(list(enumerate(pages.values())), "page_id long, html string")
    best, blocks = bodies.page_bodies(df)
    rows = {list(pages)[x.page_id]: x for x in best.collect()}
    texts = {}
    for b in blocks.orderBy("page_id", "ord").collect():
        texts.setdefault(list(pages)[b.page_id], []).append(b.text)
    return rows, texts


def test_choice(spark):
    para = [f"<p>{k} {PROSE * 3}</p>" for k in range(4)]
    links = "".join(f'<p><a href="/{i}">Some linked story number {i} of the day</a></p>' for i in range(30))
    rows, texts = chosen(
        spark,
        focused=f"<main><div class='sidebar'>{links}</div><div class='post-content'><h1>Title</h1>{''.join(para)}</div></main>",
        nested=f"<div><div>{''.join(para)}</div><div>{links}</div></div>",
        article=f"<body><article>{''.join(para)}<div class='related-posts'><p>{PROSE * 9}</p></div><h2>Related articles</h2><p>More</p></article></body>",
        inside=f"<aside><article>{''.join(para)}</article></aside>",
        structured='<script type="application/ld+json">{"articleBody": "' + PROSE * 12 + '"}</script><div><p>short</p></div>',
        short="<article><p>Too short.</p></article><p>Loose</p>",
        none="<div></div>",
        lead=f"<article><h1>Title</h1><img src='lead.png'><p>Published on May 1</p>{''.join(para)}</article>",
    )
    assert {k: v.strategy for k, v in rows.items()} == {
        "focused": "semantic_container", "nested": "largest_content", "article": "article", "inside": "article", "structured": "jsonld_article_body", "short": "document_fallback", "lead": "article"
    }
    assert texts["focused"][1:] == texts["nested"] == texts["article"] == texts["inside"] == [f"{k} {PROSE * 3}".strip() for k in range(4)]
    assert texts["short"] == ["Too short.", "Loose"] and "none" not in rows
    assert "" in texts["lead"]  # the lead image
    assert rows["focused"].candidates >= 2 and rows["short"].candidates == 0


def test_renormalising_ends_where_nothing_more_goes(spark):
    r = random.Random(2)
    kinds = ["p", "p", "Related articles", "By Jane Doe", "Share this article", "Reading list", "1:20", "Audio ready", "Listen to this article", "Download the guide now", "Try it today"]
    events = []
    for i in range(40):
        blocks = []
        for _ in range(r.randrange(0, 14)):
            k = r.choice(kinds)
            text = PROSE * 4 if k == "p" else k
            blocks.append((r.choice(["heading", "paragraph"]), text, ["/x"] if k.startswith(("Try", "Down")) else [], len(text) if k.startswith(("Try", "Down")) else 0))
        events.append((f"e{i}", blocks if r.random() < 0.95 else None))
    df = spark.createDataFrame(events, "event_id string, blocks array<struct<type:string,text:string,links:array<string>,link_chars:int>>")
    once = spark.createDataFrame(bodies.renormalize(df).collect(), bodies.renormalize(df).schema)
    got, had = {x.event_id: x for x in once.collect()}, dict(events)
    assert len(got) == 40 and sum(x.removed for x in got.values()) > 20
    for e, x in got.items():
        if not had[e]:
            assert x.blocks == had[e] and x.removed == 0
            continue
        assert x.removed == len(had[e]) - len(x.blocks)
        rest = iter(had[e])
        assert all(any(tuple(b) == y for y in rest) for b in x.blocks)  # in order
    assert sum(x.removed for x in bodies.renormalize(once.drop("removed")).collect()) == 0


def test_blocks_by_sql(spark):
    from eventlake.operators.extract import page_blocks

    bodies.register_table_functions(spark)
    pages = spark.createDataFrame([(1, "<article><p>One <a href='/x'>two</a><p>three</article>"), (2, None), (3, "<img src='i' width=3>")], "page_id long, html string")
    pages.createOrReplaceTempView("pages_of_test")
    got = spark.sql("SELECT p.page_id, b.* FROM pages_of_test p, LATERAL blocks_of(p.html) b").collect()
    want = page_blocks(pages).drop("region").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 3
