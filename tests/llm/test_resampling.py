"""Importance resampling against a plain version, with many segments and longer runs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from eventlake.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score string, rank int"


def features(text, runs):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, runs + 1) for i in range(len(words) - k + 1)]


def plain(rows, goal, percent, least, runs, size):
    def bucket(f):
        return zlib.crc32(f.encode()) % size

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, runs)[1]))
    for text in goal:
        t.update(map(bucket, features(text, runs)[1]))
    big_s, big_t = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + size) / ((s[b] + 1) * (big_t + size)))) for b in range(size)]
    out = []
    for i, text in rows:
        n, found = features(text, runs)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    k = percent * len(fit) // 100
    return sorted([(*x[:4], r + 1 if r < k else None) for r, x in enumerate(fit)] + [(*x[:4], None) for x in out if x[4] < least], key=repr)


def rows_of(n):
    r = random.Random(4)
    words = ["The", "der", "Œuvre", "état", "x1", "42", "日本", "is", "of", "co"]
    rows = [(i, r.choice([" ", "-", ". "]).join(r.choice(words) for _ in range(r.choice([0, 3, 25, 40])))) for i in range(n)]
    return [*rows, (None, "the of " * 30), (n, None), (n + 1, ""), (n + 2, "so " * 20000)]


@pytest.mark.parametrize("runs,segment", [(1, 8192), (1, 10), (2, 40)])
def test_as_plain(spark, monkeypatch, runs, segment):
    monkeypatch.setattr(resampling.regular_ranks, "__defaults__", ("score", "doc_id", segment, 16))
    rows, goal = rows_of(300), ["the état is of the œuvre", None, "42 42"]
    df = spark.createDataFrame([(*x, "x", 1) for x in rows], SCHEMA).repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(1, g, "x", 1) for g in goal], SCHEMA), 30, 20, runs, 500)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == plain(rows, goal, 30, 20, runs, 500)
    assert resampling.drawn(df, got).where("rank = 1").count() == got.where("rank is not null").count()


def test_ranks_with_ties(spark):
    r = random.Random(9)
    rows = [(r.randrange(4), i) for i in range(500)] + [(1, None), (1, 7), (1, 7)]
    df = spark.createDataFrame(rows, "score long, doc_id long").repartition(6)
    got = sorted((x["rank"], x["score"], x["doc_id"]) for x in resampling.regular_ranks(df, segment_rows=20, most=8).collect() if x["doc_id"] is not None)
    want = sorted(rows, key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
    assert [(s, i) for _, s, i in got] == [x for x in want if x[1] is not None]
    assert [k for k, _, _ in got] == [k + 1 for k, x in enumerate(want) if x[1] is not None]


def test_empty(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b", "x", 1)], SCHEMA)
    assert resampling.resample(none, some).count() == 0
    assert [tuple(x) for x in resampling.resample(some, none, least=1, percent=100).select("doc_id", "n_features", "rank").collect()] == [(1, 2, 1)]
