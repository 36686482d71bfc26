"""Pages of a long day: few rows are looked at, and the pages are those of a search through all kinds."""

import random

import pytest

from eventlake.operators import bodies, folds


def pages(rows, adjacent, size=20):
    p, out = folds._Page(rows, 4, 12, {"s1": 2}, adjacent), []
    while p.rest:
        out.append(p.take(min(size, len(p.rest)), fill=True))
    return out


@pytest.mark.parametrize("adjacent", [False, True])
def test_pages_are_those_of_a_search_by_kinds(monkeypatch, adjacent):
    r = random.Random(3)
    for few in (1, 3, 40):
        rows = [(r.choice([None, *range(few)]), r.choice([None, *(f"s{i}" for i in range(few))]), r.choice("abc"), r.random() < 0.3) for _ in range(400)]
        got = pages(rows, adjacent)
        for look in (0, 2, 1000):
            monkeypatch.setattr(folds._Page, "LOOK", look, raising=False)
            assert pages(rows, adjacent) == got
        monkeypatch.undo()
        assert sorted(i for page in got for i in page) == list(range(400))


def test_a_step_looks_at_few_rows():
    looked = [0]

    class Counted(dict):
        def items(self):
            looked[0] += len(self)
            return super().items()

    p = folds._Page([(i % 7, f"s{i}", i % 5, False) for i in range(5_000)], 4, 12, {}, False)
    p.left = Counted(p.left)
    while p.rest:
        p.take(min(20, len(p.rest)), fill=True)
    assert looked[0] <= 5_000


def test_stored_blocks_are_written_once(spark, monkeypatch):
    written = []
    real = type(spark.range(0).write).parquet
    monkeypatch.setattr(type(spark.range(0).write), "parquet", lambda self, path, *a, **k: (written.append(path), real(self, path, *a, **k))[1])
    rows = [("e", [("paragraph", f"a paragraph of some length, number {i}", [], 0) for i in range(3)])]
    df = spark.createDataFrame(rows, "event_id string, blocks array<struct<type:string,text:string,links:array<string>,link_chars:int>>")
    out = bodies.renormalize(df)
    held = [c for p in written if ("stored-blocks" in p or "renormalized" in p) for c in spark.read.parquet(p).columns]
    assert held.count("block") == 1 and "text" not in held and out.first().removed + len(out.first().blocks) == 3
