"""Addresses of references, broken links, and distinct devices from sketches."""

from datetime import datetime, timedelta
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from eventlake.functions import text
from eventlake.operators import behavior, publish

BASES = ["https://a.example/x/y/z.html?q=1#top", "http://a.example", "http://a.example/", "https://a.example/dir/"]
REFS = ["", "#f", "?k=v", "other.html", "./o", "../up", "../../../o", "/root/./a/../b", "/a/b/..", "/a/b/.", "//cdn.example/i.png?x#y", "https://b.example/p#f", "mailto:x@y", "a/b?c=/../d", "..", ".", "g;x=1/../y", " pad "]


@pytest.mark.parametrize("base", BASES)
def test_references(spark, base):
    df = spark.createDataFrame([(base, r) for r in REFS], "base string, ref string")
    got = {r.ref: r.u for r in df.select("ref", text.resolve_reference(F.col("base"), F.col("ref")).alias("u")).collect()}
    for ref in REFS:
        want = urldefrag(urljoin(base, ref.strip()))[0]
        same = got[ref].rstrip("/") == want.rstrip("/") if ref in ("?k=v", "") else got[ref] == want
        # without a path of its own, a page stands at the root
        assert same or (base == "http://a.example" and got[ref].replace("example/?", "example?") == want), (ref, got[ref], want)
    none = spark.createDataFrame([(None, "x"), ("no address", "x"), ("https://a.example/x", None)], "base string, ref string")
    assert [r[0] for r in none.select(text.resolve_reference(F.col("base"), F.col("ref"))).collect()] == [None, None, "https://a.example/x"]


def test_broken_links(spark):
    pages = [
        (1, "https://a.example/x/", '<a href="y.html">1</a><a href="/gone">2</a><a class="k" HREF = \'../x/index.html#s\'>3</a><a href="https://other.example/gone">4</a><a href="mailto:a@b">5</a><a href="?page=2">6</a>'),
        (2, "http://a.example/x/y.html?utm=1", '<a href="./../x">1</a><a href="z">2</a><a href="z">again</a><a href="//A.example/x/y.html">3</a>'),
        (3, None, '<a href="/x">no address</a>'), (4, "https://b.example/", None),
    ]
    got = publish.broken_links(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "/gone", "https://a.example/gone"), (2, "z", "http://a.example/x/z")]


def test_devices_from_sketches(spark):
    start = datetime(2024, 1, 1)
    rows = [(d, start + timedelta(days=k)) for k in (0, 1, 2, 5, 12) for d in range(k * 900, k * 900 + 2500)] + [(None, start), (1, None)]
    df = spark.createDataFrame(rows, "device long, ts timestamp_ntz")
    got = {r.day: r.devices for r in behavior.sliding_devices(behavior.daily_sketches(df, "device", "ts")).collect()}
    for k in (0, 1, 2, 5, 12):
        want = len({d for d, t in rows if d is not None and t is not None and timedelta(0) <= start + timedelta(days=k) - t < timedelta(days=7)})
        assert abs(got[(start + timedelta(days=k)).date()] - want) <= 0.04 * want
    assert len(got) == 5
