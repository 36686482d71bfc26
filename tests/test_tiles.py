"""Similar pairs by tiles against plain loops, and what is written and shuffled on the way."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventlake import queries as core
from eventlake.functions import text
from eventlake.operators import graph, resolve, tiles


def jaccard(x, y):
    return len(x & y) / len(x | y)


def some_rows(n, seed):
    r = random.Random(seed)
    words = [r.randrange(-(2**62), 2**62) for _ in range(90)]
    return [(i, [sorted(r.sample(words[: r.choice([12, 90])], r.randrange(1, 12))) for _ in range(r.choice([1, 1, 2, 3]))], r.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("self_tile", [True, False])
def test_blocks(monkeypatch, self_tile):
    for name, n in (("BLOCK", 16), ("COLUMNS", 3), ("HITS", 20)):
        monkeypatch.setattr(tiles, name, n)
    rows = some_rows(120, 5)
    side = [2 if self_tile else i % 2 for i, *_ in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows], pa.list_(pa.list_(pa.int64()))), pa.array([x[2] for x in rows]), pa.array(side, pa.int32())], ["id", "sets", "part", "_side"])
    t, got = tiles._Tile(iter([batch]), 0.3, True), []
    for x, y, same in t.pairs:
        i, j, sims = t.similar(x, y, same)
        got += [(min(p, q), max(p, q), s) for p, q, s in zip(x[i].tolist(), y[j].tolist(), sims.tolist(), strict=True)]
    want = {}
    for i, xs, p in rows:
        for j, ys, q in rows:
            best = max(jaccard(set(x), set(y)) for x in xs for y in ys)
            if i < j and p == q and best > 0.3 and (self_tile or i % 2 != j % 2):
                want[i, j] = best
    assert {(a, b): s for a, b, s in got} == want and len(got) == len(want)


def test_links_and_forests(spark):
    rows = some_rows(2500, 6)
    df = spark.createDataFrame(rows, "id long, sets array<array<long>>, part long")
    pairs = tiles.similar_pairs(df, 0.5).collect()
    few, whole = tiles.linking_pairs(df, 0.5).collect(), {(p.a, p.b) for p in pairs}
    assert {(min(p.a, p.b), max(p.a, p.b)) for p in few} <= whole and len(whole) == len(pairs)

    def groups(edges):
        up = list(range(len(rows)))

        def top(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in edges:
            u, v = sorted((top(a), top(b)))
            up[v] = u
        return [top(i) for i in range(len(rows))]

    assert groups(whole) == groups((p.a, p.b) for p in few) and len(few) < len(whole)
    named = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in sorted(whole)] + [(None, "n1"), ("n1", "n1")], "a string, b string").coalesce(1)
    kept = graph.forest(named).collect()
    assert groups((int(r.a[1:]), int(r.b[1:])) for r in kept) == groups(whole)
    assert len(kept) == len(rows) - len(set(groups(whole)))


def test_labels_fall_together_at_once():
    labels = graph.Labels(5)
    labels.grow(8)
    a, b = labels.link(np.array([0, 0, 0, 4, 6]), np.array([1, 2, 1, 3, 6]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(0, 1), (0, 2), (4, 3)] and len(set(labels.of)) == 5
    assert labels.link(np.array([1]), np.array([2]))[0].size == 0


def test_verdicts(spark):
    now, late = F.lit("2024-06-01").cast("timestamp"), F.lit("2024-05-31").cast("timestamp")
    pairs = spark.range(27).select(F.col("id").alias("a"), (F.col("id") + 100).alias("b"))
    kinds = [F.floor(F.col("a") / k) % 3 for k in (1, 3, 9)]
    said = [F.struct(F.when(k < 2, k == 1).alias("same"), F.lit(v).alias("version"), at.alias("decided")) for k, v, at in zip(kinds, ("v1", "v1", "v0"), (now, late, now), strict=True)]
    table = pairs.select("b", "a", F.explode(F.array(*said)).alias("s")).select(F.col("b").alias("a"), F.col("a").alias("b"), "s.*")
    want = {r.a for r in resolve.apply_verdicts(pairs, table, now, "v1").collect()}
    assert {r.a for r in pairs.where(resolve.verdict(said, now, "v1")).collect()} == want and want


def copies(spark, folder, n=400):
    html = F.concat(F.lit("<title>One title of many pages "), (F.col("id") % 100).cast("string"), F.lit("</title>"))
    p = spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("https://a.example/en/"), F.col("id").cast("string")).alias("url"), html.alias("html"))
    p.write.parquet(f"{folder}/pages.parquet")
    p.select(F.col("page_id").alias("doc_id"), F.concat(F.lit("One first line of many documents "), (F.col("page_id") % 50).cast("string")).alias("text")).write.parquet(f"{folder}/documents.parquet")


@pytest.mark.parametrize("name", ["accepted_pairs", "late_merge", "assign_incremental", "same_event_components", "same_event_groups", "related_top3"])
def test_no_list_of_pairs_is_kept(spark, tmp_path, monkeypatch, name):
    """All 79,800 pairs are similar; what is written on the way follows the rows."""
    copies(spark, tmp_path)
    written = []
    real = type(spark.range(0).write).parquet
    monkeypatch.setattr(type(spark.range(0).write), "parquet", lambda self, path, *a, **k: (written.append(path), real(self, path, *a, **k))[1])
    core.queries()[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()
    assert written and max(spark.read.parquet(p).count() for p in written) <= 4 * 400
    assert name != "related_top3" or len(written) <= 4  # no joins in steps


@pytest.mark.parametrize("name", ["title_variant_pairs", "comparable_reports", "comparable_new_pairs", "comparable_event_pairs", "accepted_pairs", "similar_title_pairs"])
def test_pairs_are_neither_joined_nor_shuffled(spark, tmp_path, name):
    copies(spark, tmp_path, 40)
    plan = core.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("MapInArrow")[0]
    assert "MapInArrow" in plan and "Aggregate" not in top and ("Join" not in top or name == "similar_title_pairs")


def test_bigrams_of_long_lines(spark):
    """A title is cleaned once, and not for each of its pieces."""
    lines = ["", "!", "x", "Ab, a\U0001d4b6b", "née  ÉE_9", "\U0001f600a\U0001d4b6\U0001d4b7", "".join(chr(97 + i * i % 26) + chr(97 + i % 25) for i in range(30_000)), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").select("i", text.title_bigrams(F.col("t")).alias("g"))
    got = {r.i: r.g for r in df.collect()}
    for i, t in enumerate(lines):
        s = "".join(c for c in (t or "").lower() if c.isalnum() or c == "_")
        want = list(dict.fromkeys(s[k : k + 2] for k in range(max(1, len(s) - 1)))) if s else []
        assert (got[i] or []) == want, t
    told = df._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace" not in told.split("lambdafunction", 1)[1].split("AS g")[0]
