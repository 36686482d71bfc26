"""The prefix trie against a plain version, by whole nodes; contraction against sums over chains, stars and bushes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from eventlake.llm import prefix_trie
from eventlake.llm.prefix_trie import contract, expand

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int"


def md5(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}:{text}".encode()).digest()


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, md5(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}
    rebuilt = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - c % 5, [])[:h] + turns[c][h:]
    nodes = {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for n in nodes:
        if n:
            kids[n[:-1]] += 1
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1].encode()) if n else 0
    out = []
    for n, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(n))))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = prefix_trie.prefix_trie(df)
    return sorted((tuple(r) for r in out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def conversations(seed, n, deepest):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if r.random() < 0.1:
            continue
        for t in range(r.choice([1, 2, 3, deepest])):
            rows.append((c, r.choice([t, None]) if r.random() < 0.1 else t, r.choice(["user", "bot", None]), r.choice(["hi", "hé", "", None, "go on"]) if r.random() < 0.9 else f"own {c} {t}"))
    rows += [(None, 1, "user", "nowhere"), rows[0], rows[0]]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,deepest", [(1, 40, 12), (2, 12, 70)])
def test_as_plain(spark, seed, n, deepest):
    rows = conversations(seed, n, deepest)
    assert found(spark, rows) == plain(rows)


def test_long_conversation_in_blocks_and_turnless(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 8)
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr(prefix_trie, "HOT", 2)
    rows = [(0, t, "user", f"t{t}") for t in range(50)] + [(5 * k, 0, "user", f"first {k % 3}") for k in range(1, 30)]
    rows += [(c, 0, "user", "alone") for c in (201, 202, 203, 204, 206, 207)]  # their families have no first conversation
    assert found(spark, rows) == plain(rows)


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


@pytest.mark.parametrize("shape", ["chain", "star", "bush", "broom"])
def test_contraction_sums(spark, shape):
    r = random.Random(3)
    parent = {0: None}
    for i in range(1, 120):
        parent[i] = {"chain": i - 1, "star": 0, "bush": r.randrange(i), "broom": i - 1 if i < 60 else 59}[shape]
    depth, kids = {0: 0}, dict.fromkeys(parent, 0)
    for i in range(1, 120):
        depth[i] = depth[parent[i]] + 1
        kids[parent[i]] += 1
    want = {i: i for i in parent}
    for i in range(119, 0, -1):
        want[parent[i]] += want[i]
    rows = [(f"{i:03}".encode(), None if p is None else f"{p:03}".encode(), depth[i], kids[i], i) for i, p in parent.items()]
    rounds = contract(spark.createDataFrame(rows, "key binary, parent binary, depth long, kids long, v long"), ["v"])
    assert {int(x["key"]): x["v"] for x in expand(rounds, ["v"]).collect()} == want
    if shape == "chain":
        assert len(rounds) <= 16  # not one round per level
