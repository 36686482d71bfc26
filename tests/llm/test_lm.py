"""Elias-Fano levels, tries and scores against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from eventlake.llm import lm
from eventlake.llm.elias_fano import EliasFano, pack, views

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, score string, words int"


@pytest.mark.parametrize("n,limit", [(0, 1), (1, 1), (7, 3), (500, 40), (500, 1 << 20), (3000, 1 << 63), (200, 200)])
def test_sequence(n, limit):
    r = random.Random(n + limit)
    values = np.array(sorted(r.randrange(limit) for _ in range(n)), np.uint64)
    x = EliasFano(*views(pack(EliasFano.of(values, limit).arrays())))
    assert (x.get(np.arange(n)) == values).all()
    goals = np.array([r.randrange(limit) for _ in range(300)] + values.tolist(), np.uint64)
    assert (x.successor(goals) == np.searchsorted(values, goals)).all()
    begin = np.array([r.randrange(n + 1) for _ in goals])
    end = np.array([r.randrange(b, n + 1) for b in begin])
    want = [b + int(np.searchsorted(values[b:e], g)) for g, b, e in zip(goals, begin.tolist(), end.tolist(), strict=True)]
    assert x.successor(goals, begin, end).tolist() == want


def test_trie_finds_all_and_nothing_else():
    r = random.Random(5)
    pairs = sorted({(r.getrandbits(64) >> r.choice([0, 3]), r.getrandbits(lm.CONTEXT)) for _ in range(400)})
    pairs = sorted(set(pairs) | {(pairs[7][0], r.getrandbits(lm.CONTEXT)) for _ in range(300)})
    words = sorted({w for w, _ in pairs})
    values = np.array([r.uniform(-6, 4) for _ in pairs])
    trie = lm.Trie(lm.Trie.build(np.array(words, np.uint64), np.array([sum(w == x for x, _ in pairs) for w in words]), np.array([v for _, v in pairs], np.uint64), values))
    got = trie.find(np.array([w for w, _ in pairs], np.uint64), np.array([v for _, v in pairs], np.uint64))
    assert np.abs(got - values).max() < 11 / 65535 and (got <= values + 1e-9).all()
    odd = [(w + 1, v) for w, v in pairs] + [(w, v ^ 1) for w, v in pairs] + [(0, 0), ((1 << 64) - 1, 5)]
    odd = [x for x in odd if x not in set(pairs) and x[0] < 1 << 64]
    assert np.isnan(trie.find(np.array([w for w, _ in odd], np.uint64), np.array([v for _, v in odd], np.uint64))).all()
    empty = lm.Trie(lm.Trie.build(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0)))
    assert np.isnan(empty.find(np.array([3], np.uint64), np.array([1], np.uint64))).all()


def plain(rows, mu):
    docs = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), " end"]) for i, t in rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for _, held, words in docs:
        if not held:
            uni.update(words)
            pairs = list(zip(["<"] + words[:-1], words, strict=True))
            bi.update(pairs)
            ctx.update(v for v, _ in pairs)
    n, total = sum(uni.values()), sum(uni.values()) + 0.1 * (len(uni) + 1)
    out = []
    for i, held, words in docs:
        p = [(uni[w] + 0.1) / total for w in words]
        s = sum(math.log10((bi[v, w] + mu * q) / (ctx[v] + mu)) for v, w, q in zip(["<"] + words[:-1], words, p, strict=True))
        out.append((i, held, len(words), sum(uni[w] > 0 for w in words), n, sum(map(math.log10, p)), s))
    return out


def rows_of(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(60)] + ["The", "the", "a b", "x,", "ÄB"]
    out = [(i, " ".join(r.choice(vocabulary[: r.choice([5, 65])]) for _ in range(r.randrange(0, 60)))) for i in range(n)]
    return [*out, (None, "the null id"), (n + 1, None), (n + 2, ""), (n + 3, "the " * 3000), (3, "again the id"), out[5]]


@pytest.mark.parametrize("per_shard,piece", [(2_000_000, 1 << 20), (300, 500)])
def test_scores_as_plain(spark, monkeypatch, per_shard, piece):
    monkeypatch.setattr(lm, "PIECE", piece)
    rows = rows_of(1, 60)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in lm.score(df, per_shard=per_shard).collect()), key=repr)
    want = sorted(plain(rows, lm.MU), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(sorted(got), sorted(want), strict=True) if None not in [g[0] for g in got] else zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        # codes have 65,536 levels over a few powers of ten
        assert abs(g[6] - w[6]) <= 1e-4 * g[2] + 1e-9


def test_one_context_sums_to_one(spark):
    """The smoothed probabilities of all words and the unknown one, after a context."""
    rows = rows_of(2, 40)
    words = sorted({w for _, t in rows for w in WORD.findall((t or "").lower())})
    df = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(1000 + k, f"the {w}", "x", 1) for k, w in enumerate([*words, "never-seen"]) if zlib.crc32(str(1000 + k).encode()) % 10 == 0], SCHEMA)
    got = {r["doc_id"]: r for r in lm.score(df).collect() if (r["doc_id"] or 0) >= 1000}
    assert got and all(r["held_out"] and r["score"] < 0 for r in got.values())


def test_empty_and_untrained(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = lm.score(spark.createDataFrame([(held, "only this", "x", 1)], SCHEMA)).collect()[0]
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and math.isfinite(row["score"]) and math.isfinite(row["base_score"])


def test_model_table(spark):
    rows = rows_of(3, 30)
    tries = lm.fit(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), per_shard=400).collect()
    pairs = {(v, w) for _, held, words in [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0, [*WORD.findall(("" if t is None else t).replace("T", "t").replace("B", "b")), " end"]) for i, t in rows] if not held for v, w in zip(["<"] + words[:-1], words, strict=True)}
    assert sum(lm.Trie(r["trie"]).before.n for r in tries) == len(pairs)
