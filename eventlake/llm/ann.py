"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: TURNS learned rotations (iterative quantisation on a bounded sample), each giving a bit per
dimension. So that the angle orders vectors as the inner product does, candidates get one more dimension that brings all
to one length; queries have 0 there. A code splits into m substrings of 16 bits, each indexed by its value. Of two codes
within Hamming radius R at least one substring differs in at most s = R / m bits (pigeonhole), so probing every value that
near in each index finds every code within R = m * s + m - 1. All rows found are ranked by their float vectors in double
precision; so some codes beyond R are ranked as well, and none within it is missed.

s is the smallest number that finds SHARE of the true neighbours of sampled queries in the sample, where neighbours lie
farther apart than in all rows. Candidates are dealt into blocks, queries into groups of at most BLOCK and GROUP rows; each
task indexes one block and probes it for one group, and gives back at most k rows for each query. A block in which fewer
than k rows are found is ranked whole, so every query has k results if there are as many other vectors.

Null, zero and non-finite vectors, and rows without an id, take no part. Vectors of each length are searched apart, among
their own. A row is a query and a candidate of its own whatever other rows share its id: queries that share one each get
their ranks, and only the query's own row is left out. Equal scores go to the smaller id. An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eventlake.llm.vectors import bounded_sample, matrix, usable
from eventlake.plans.stage import keep

#: Rows at most that rotations and probing distance are fitted on.
SAMPLE = 8_000
TURNS = 8
SHARE = 0.9
BLOCK = 32_768
GROUP = 65_536
#: Rows of a block if there are few.
LEAST_BLOCK = 4_096
SCHEMA = "query_row long, query_id long, vec_id long, score double"


def fit_rotations(x: np.ndarray, turns: int = TURNS, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the sample, and turns rotations side by side, each fitted so that signs lie near the rotated vectors."""
    mean = x.mean(axis=0)
    u = x - mean
    d, rng, out = x.shape[1], np.random.default_rng(7), []
    for _ in range(turns):
        r = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(rounds):
            a, _, b = np.linalg.svd(np.where(u @ r >= 0, 1.0, -1.0).T @ u)
            r = (a @ b).T
        out.append(r)
    return mean, np.hstack(out)


def pad(x: np.ndarray, longest: float | None) -> np.ndarray:
    """One more dimension: what brings a candidate to the longest length; 0 for queries."""
    extra = np.zeros(len(x)) if longest is None else np.sqrt(np.maximum(0.0, longest**2 - (x * x).sum(axis=1)))
    return np.hstack([x, extra[:, None]])


class Coder:
    def __init__(self, mean: np.ndarray, rotations: np.ndarray, longest: float):
        self.mean, self.longest = mean, longest
        # whole substrings only: one that is partly empty would be near to every other
        self.tables = max(1, rotations.shape[1] // 16)
        self.rotations = rotations[:, : self.tables * 16]

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Rows of unsigned 16-bit substrings."""
        v = pad(x, None if query else self.longest)
        length = np.linalg.norm(v, axis=1, keepdims=True)
        bit = ((v / np.where(length > 0, length, 1) * self.longest) - self.mean) @ self.rotations >= 0
        full = np.zeros((len(x), self.tables * 16), bool)
        full[:, : bit.shape[1]] = bit
        return np.ascontiguousarray(np.packbits(full, axis=1)).view(np.uint16)


def masks(near: int) -> np.ndarray:
    """All 16-bit numbers with at most so many bits set."""
    return np.array([sum(1 << i for i in c) for n in range(near + 1) for c in combinations(range(16), n)], np.uint16)


class MultiIndex:
    """One index per substring over a block of codes: rows in order of their value, and where each value begins."""

    def __init__(self, codes: np.ndarray):
        self.rows, m = len(codes), codes.shape[1]
        self.order = np.empty(m * self.rows, np.int32)
        self.begins = np.empty((m, (1 << 16) + 1), np.int32)
        for j in range(m):
            order = np.argsort(codes[:, j], kind="stable")
            self.order[j * self.rows : (j + 1) * self.rows] = order
            self.begins[j] = np.searchsorted(codes[order, j], np.arange((1 << 16) + 1)) + j * self.rows
        self.flat, self.base = self.begins.ravel(), np.arange(m)[:, None] * ((1 << 16) + 1)

    def probe(self, query: np.ndarray, flips: np.ndarray) -> np.ndarray:
        """Rows of which a substring differs from the query's by one of the flips."""
        at = (self.base + (query[:, None] ^ flips[None, :])).ravel()
        lo = self.flat[at]
        n = self.flat[at + 1] - lo
        some = np.flatnonzero(n)
        lo, n = lo[some], n[some]
        ends = np.cumsum(n)
        hit = np.zeros(self.rows, bool)
        if len(n):
            hit[self.order[np.repeat(lo - (ends - n), n) + np.arange(ends[-1])]] = True
        return np.flatnonzero(hit)


def fit_near(coder: Coder, x: np.ndarray, k: int, share: float = SHARE, queries: int = 400) -> int:
    """The number of bits within which a substring of `share` of the k nearest of sampled queries lies, in the sample."""
    n = min(queries, len(x))
    if len(x) < 2:
        return 0
    codes, q, least = coder.codes(x, False), coder.codes(x[:n], True), []
    for i in range(n):
        s = (x * x[i]).sum(axis=1)
        s[i] = -np.inf
        best = np.argsort(-s, kind="stable")[: min(k, len(x) - 1)]
        least.append(np.bitwise_count(codes[best] ^ q[i]).min(axis=1))
    return int(np.quantile(np.concatenate(least), share, method="higher"))


def _probe(coder: Coder, near: int, k: int):
    flips = masks(near)

    def go(table: pa.Table) -> pa.Table:
        """Queries (q true) and candidates of one task -> the best k candidates found for each query."""
        is_query = table.column("q").to_numpy().astype(bool)
        row, ids, x = table.column("row").to_numpy(), table.column("vec_id").to_numpy(), matrix(table.column("embedding"))
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if is_query.any() and not is_query.all():
            order = np.flatnonzero(~is_query)
            order = order[np.lexsort((row[order], ids[order]))]
            cand, crow, cx = ids[order], row[order], x[order]
            index = MultiIndex(coder.codes(cx, False))
            for qrow, qid, qx, code in zip(row[is_query], ids[is_query], x[is_query], coder.codes(x[is_query], True), strict=True):
                rows = index.probe(code, flips)
                rows = rows[crow[rows] != qrow]
                if len(rows) < k:
                    rows = np.flatnonzero(crow != qrow)
                score = (cx[rows] * qx).sum(axis=1)
                if len(rows) > k:
                    rows, score = (a[score >= np.partition(score, len(score) - k)[len(score) - k]] for a in (rows, score))
                best = np.argsort(-score, kind="stable")[:k]  # rows are in order of their ids
                out.append((np.full(len(best), qrow), np.full(len(best), qid), cand[rows[best]], score[best]))
        a, b, c, s = (np.concatenate(col) for col in zip(*out, strict=True))
        return pa.table({"query_row": pa.array(a, pa.int64()), "query_id": pa.array(b, pa.int64()), "vec_id": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64())})

    return go


def _search(good: DataFrame, k: int, n: int, nq: int, longest: float) -> DataFrame:
    """All queries against all rows of one length."""
    rows = bounded_sample(good, "row", SAMPLE, n).orderBy(F.xxhash64("row"), "row").limit(2 * SAMPLE).select("row", "embedding").toPandas().sort_values("row")
    x = np.array(rows["embedding"].tolist(), float).reshape(len(rows), -1) if len(rows) else np.array([good.first()["embedding"]], float)
    coder = Coder(*fit_rotations(pad(x, longest)), longest)
    near = fit_near(coder, x, k)
    # a few tasks for each core, as long as a block is worth its index
    tasks = 4 * good.sparkSession.sparkContext.defaultParallelism
    nb, ng = max(-(-n // BLOCK), min(tasks, -(-n // LEAST_BLOCK))), -(-nq // GROUP)
    # every group of queries meets every block: the query set is a given share of the rows, and goes against all of them
    block = F.pmod(F.xxhash64("row", F.lit("block")), F.lit(nb)).cast("int")
    group = F.pmod(F.xxhash64("row", F.lit("group")), F.lit(ng)).cast("int")
    cands = good.select(block.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(ng - 1))).alias("g"), "row", "vec_id", "embedding", F.lit(False).alias("q"))
    asks = good.where("q").select(F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("b"), group.alias("g"), "row", "vec_id", "embedding", F.lit(True).alias("q"))
    return cands.union(asks).groupBy("b", "g").applyInArrow(_probe(coder, near, k), SCHEMA)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows found with the largest inner product with each query row."""
    good = vectors.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), "embedding", F.coalesce(is_query, F.lit(False)).alias("q"))
    good = keep(good.select("*", F.size("embedding").alias("d"), F.monotonically_increasing_id().alias("row")), "vectors")
    square = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)
    lengths = good.groupBy("d").agg(F.count("*").alias("n"), F.sum(F.col("q").cast("long")).alias("nq"), F.max(square).alias("sq")).where("nq > 0").orderBy("d").collect()
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.union, (_search(good.where(F.col("d") == r.d), k, r.n, r.nq, float(np.sqrt(r.sq))) for r in lengths))
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
