"""Connected components over an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.plans.stage import keep

#: Edges looked at together, and nodes that a task keeps labels for.
EDGES, NODES = 1_000_000, 4_000_000


class Labels:
    """Components of numbered nodes within a task."""

    def __init__(self, n: int = 0):
        self.of = np.arange(n)

    def grow(self, n: int) -> None:
        self.of = np.concatenate([self.of, np.arange(len(self.of), n)])

    def link(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joins the components of each p and its q; returns edges enough to do so, of which none closes a circle."""
        a, b = [], []
        while len(use := np.flatnonzero(self.of[p] != self.of[q])):
            p, q = p[use], q[use]
            some = np.full(len(self.of), -1)
            some[self.of[p]] = some[self.of[q]] = np.arange(len(p))  # an edge for each label, so that rounds halve their number
            one = some[some >= 0]
            up: dict[int, int] = {}

            def top(v: int) -> int:
                while (w := up.get(v, v)) != v:
                    up[v] = up.get(w, w)
                    v = w
                return v

            for i, u, v in zip(one.tolist(), self.of[p[one]].tolist(), self.of[q[one]].tolist(), strict=True):
                u, v = top(u), top(v)
                if u != v:
                    up[u] = v
                    a.append(p[i])
                    b.append(q[i])
            new = np.arange(len(self.of))
            for v in up:
                new[v] = top(v)
            self.of = new[self.of]
        return np.array(a, np.int64), np.array(b, np.int64)


def forest(edges: DataFrame) -> DataFrame:
    """(a, b): edges of (a, b) without those that, in their task, join what is joined already. Nothing is shuffled or written,
    so that a long list of edges need not be."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, labels = {}, Labels()

        def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            both = pc.dictionary_encode(pa.concat_arrays([t["a"].combine_chunks(), t["b"].combine_chunks()]))
            at = np.array([known.setdefault(x, len(known)) for x in both.dictionary.to_pylist()], np.int64)
            labels.grow(len(known))
            own = np.asarray(both.indices)
            p, q = labels.link(at[own[: len(t)]], at[own[len(t) :]])
            back = np.full(len(known), -1)
            back[at] = np.arange(len(at))
            return pa.RecordBatch.from_arrays([both.dictionary.take(pa.array(back[p])), both.dictionary.take(pa.array(back[q]))], ["a", "b"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= EDGES:
                yield joined(held)
                held, n = [], 0
                if len(known) > NODES:  # begin anew: some edges too many are no harm
                    known, labels = {}, Labels()
        if n:
            yield joined(held)

    some = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    return some.mapInArrow(go, some.schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node reachable. Nodes without an edge don't appear; nulls and loops are ignored.

    Each round takes the smallest label among neighbours and then follows labels once more (pointer jumping), so a
    chain of n nodes ends in about log n rounds. Every round is one written table, nothing is collected but a count.
    """
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    both = keep(one.union(one.select("b", "a")).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label"))
    labels = keep(labels, "labels")
    for _ in range(max_rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = keep(step.join(up, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old"), "labels")
        moved = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
