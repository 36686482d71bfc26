"""Embedding near-duplicates by an epsilon grid order join.

Within a label, two vectors with cosine of at least c are unit vectors at most sqrt(2 - 2c) apart. Unit vectors are laid
on a grid of that width along the leading principal directions of the data, and sorted by label and the cells of the first
GRID of them; the sorted sequence is cut into intervals of up to INTERVAL rows. Two intervals are compared if their boxes, along
DIMS directions, come within the width (found by an equi-join on the cells of the first two coordinates, then by the distance
of the boxes). Only then vectors move: TILE neighbouring intervals go together to meet TILE others, so that an interval is
sent once for up to TILE partners. Inside a task the join goes on recursively: sequences are halved, pairs of halves whose
boxes are provably distant are skipped, and pieces of up to LEAF rows are compared by their full vectors in double precision.

Rows of equal label and vector are one class before anything is compared, and a class counts as its rows in the links of
others; so a group of copies costs what one row costs. Tasks give back, for each class, how many rows it links with, and
for components only as many links as join them.

Rows with equal ids are rows of their own. Labels may be of any type that has a text. Null labels, and null, zero or
non-finite vectors link with nothing; so do vectors of different lengths. Vectors without an id count as links of others,
and never name a component. The rows of a class are found again by a 64-bit hash of label and vector: of n classes two meet
with probability n^2 / 2^65. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.vectors import bounded_sample, matrix, usable
from eventlake.operators.graph import connected_components
from eventlake.plans.stage import keep

#: Rows at most that the principal directions are fitted on.
SAMPLE = 8_000
GRID, DIMS = 4, 16
INTERVAL, TILE = 512, 8
LEAF = 64
#: What rounding may add to a distance; pairs this near to a bound are compared in full.
SLACK = 1e-9


def principal(x: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Leading directions of a sample of unit vectors, as columns."""
    return np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:dims].T


def _intervals(rows: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows get the number of their interval: a new one at a new label or length, or after `rows` rows."""
        part, seq, held, last = TaskContext.get().partitionId(), -1, 0, None
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("d").to_pylist(), strict=True))
            at = []
            for k in keys:
                if k != last or held >= rows:
                    seq, held, last = seq + 1, 0, k
                held += 1
                at.append((part << 32) + seq)
            yield batch.append_column("interval", pa.array(at, pa.int64()))

    return go


def close(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of rows reach the cosine; those at the edge are worked out one by one."""
    c = (a @ b.T) / (na[:, None] * nb[None, :])
    ok = c >= cosine
    for i, j in np.argwhere(np.abs(c - cosine) < 1e-12):
        ok[i, j] = float((a[i] * b[j]).sum()) / (na[i] * nb[j]) >= cosine
    return ok


def _compare(cosine: float, width: float):
    def go(table: pa.Table) -> pa.Table:
        """Classes of two tiles (side 0 and 1; only side 0 if they are one) -> linked rows of each, and joining links."""
        side, copies = table.column("side").to_numpy(), table.column("copies").to_numpy()
        row, x, p = table.column("row").to_numpy(), matrix(table.column("embedding")), matrix(table.column("p"))
        # in order of cells, so that neighbours in the sequence are neighbours in every direction
        order = np.lexsort([row, *np.floor(p / width).T[::-1]])
        side, row, x, p, copies = side[order], row[order], x[order], p[order], copies[order]
        norm = np.sqrt((x * x).sum(axis=1))
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        same = not len(right)
        links, parent, edges = np.zeros(len(row), np.int64), list(range(len(row))), []

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def walk(a: np.ndarray, b: np.ndarray, one: bool) -> None:
            if not len(a) or not len(b):
                return
            gap = np.maximum(p[b].min(axis=0) - p[a].max(axis=0), p[a].min(axis=0) - p[b].max(axis=0))
            if (np.maximum(gap, 0) ** 2).sum() > (width + SLACK) ** 2:
                return
            if len(a) > LEAF or len(b) > LEAF:
                ha, hb = np.array_split(a, 2), np.array_split(b, 2)
                if one:
                    walk(ha[0], ha[0], True)
                    walk(ha[1], ha[1], True)
                    walk(ha[0], ha[1], False)
                elif len(a) >= len(b):
                    walk(ha[0], b, False)
                    walk(ha[1], b, False)
                else:
                    walk(a, hb[0], False)
                    walk(a, hb[1], False)
                return
            ok = close(x[a], x[b], norm[a], norm[b], cosine)
            if one:
                np.fill_diagonal(ok, False)
                links[a] += ok @ copies[b]
            else:
                links[a] += ok @ copies[b]
                links[b] += copies[a] @ ok
            for i, j in np.argwhere(np.triu(ok) if one else ok):
                s, t = find(int(a[i])), find(int(b[j]))
                if s != t:
                    parent[s] = t
                    edges.append((row[a[i]], row[b[j]]))

        walk(left, left if same else right, same)
        some = np.flatnonzero(links)
        return pa.table({
            "a": pa.array([*row[some].tolist(), *(int(e[0]) for e in edges)], pa.int64()),
            "b": pa.array([*[None] * len(some), *(int(e[1]) for e in edges)], pa.int64()),
            "n": pa.array([*links[some].tolist(), *[0] * len(edges)], pa.int64()),
        })

    return go


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of the input."""
    width = float(np.sqrt(2 - 2 * cosine))
    ok = usable() & F.col("label").isNotNull()
    # a class is named by one of its rows; the numbers are kept in a table, hence the same for all that follows
    all_ = keep(vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding", F.monotonically_increasing_id().alias("row"), F.coalesce(ok, F.lit(False)).alias("ok")), "vectors")
    key = F.when(F.col("ok"), F.xxhash64("label", "embedding")).otherwise(F.col("row"))
    classes = all_.where("ok").groupBy("label", "embedding").agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min(key).alias("key"))
    good = keep(classes.select("row", "label", "copies", "key", F.size("embedding").alias("d"), F.col("embedding").cast("array<double>").alias("embedding")), "vector-classes")
    by_size = good.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not by_size:
        return all_.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    d, n = by_size[0]
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, y: a + y * y))
    # the directions only steer which rows are compared, so that those of the commonest length serve the others as well
    sample = bounded_sample(good.where(F.col("d") == d), "row", SAMPLE, n).orderBy(F.xxhash64("row"), "row").limit(2 * SAMPLE).select("embedding", norm.alias("norm")).toPandas()
    x = np.array(sample["embedding"].tolist(), float).reshape(len(sample), -1) / sample["norm"].to_numpy()[:, None] if len(sample) else np.eye(d)
    axes = principal(x, min(DIMS, *x.shape)).T.tolist()

    def along(axis: list[float]):  # noqa: ANN202
        weights = F.array(*(F.lit(float(a)) for a in axis))
        return F.aggregate(F.zip_with("embedding", weights, lambda u, w: u * w), F.lit(0.0), lambda a, y: a + F.coalesce(y, F.lit(0.0))) / F.col("norm")

    placed = good.withColumn("norm", norm).withColumn("p", F.array(*(along(a) for a in axes)))
    names = [f"c{i}" for i in range(min(GRID, len(axes)))]
    cells = [F.floor(F.col("p")[i] / width).alias(c) for i, c in enumerate(names)]
    ranges = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["label", "d", *names, "row"]
    ordered = placed.select("row", "label", "d", "copies", "embedding", "p", *cells).repartitionByRange(ranges, *order).sortWithinPartitions(*order).drop(*names)
    schema = "row long, label string, d int, copies long, embedding array<double>, p array<double>, interval long"
    seq = keep(ordered.mapInArrow(_intervals(INTERVAL), schema), "intervals")

    low, high = ([f(F.col("p")[i]).alias(f"{name}{i}") for i in range(len(axes))] for name, f in (("lo", F.min), ("hi", F.max)))
    boxes = seq.groupBy("interval").agg(F.first("label").alias("label"), F.first("d").alias("d"), *low, *high)

    # an interval stands in all cells that its first two coordinates cover; its partners are in those or the next ones
    def cover(df: DataFrame, mark: str, more: int) -> DataFrame:
        for i in range(min(2, len(axes))):
            lo, hi = (F.floor((F.col(f"{end}{i}{mark}") + slack) / width) for end, slack in (("lo", -SLACK), ("hi", SLACK)))
            df = df.withColumn(f"cell{i}", F.explode(F.sequence(lo - more, hi + more)))
        return df

    left, right = cover(boxes, "", 0), cover(boxes.toDF(*(f"{c}_" for c in boxes.columns)), "_", 1)
    near = (left["label"] == right["label_"]) & (left["d"] == right["d_"]) & (left["interval"] <= right["interval_"])
    for i in range(min(2, len(axes))):
        near = near & (left[f"cell{i}"] == right[f"cell{i}"])
    apart = [F.greatest(F.col(f"lo{i}") - F.col(f"hi{i}_"), F.col(f"lo{i}_") - F.col(f"hi{i}"), F.lit(0.0)) for i in range(len(axes))]
    near = near & (sum((g * g for g in apart), F.lit(0.0)) <= (width + SLACK) ** 2)
    pairs = keep(left.join(right, near).select("label", "d", F.col("interval").alias("i"), F.col("interval_").alias("j")).distinct(), "interval-pairs")
    tile = [F.floor(F.col(c) / TILE).cast("long").alias(t) for c, t in (("i", "ti"), ("j", "tj"))]
    tiles = pairs.select("label", "d", *tile, "i", "j")
    sides = tiles.select("label", "d", "ti", "tj", F.col("i").alias("interval"), F.lit(0).alias("side")).union(tiles.select("label", "d", "ti", "tj", "j", F.when(F.col("ti") == F.col("tj"), 0).otherwise(1))).distinct()
    inputs = sides.join(seq.select("interval", "row", "copies", "embedding", "p"), "interval").select("label", "d", "ti", "tj", "side", "row", "copies", "embedding", "p")
    found = keep(inputs.groupBy("label", "d", "ti", "tj").applyInArrow(_compare(cosine, width), "a long, b long, n long"), "vector-links")

    counts = found.where("n > 0").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("others"))
    labels = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "row").withColumnRenamed("label", "root")
    linked = good.select("row", "label", "copies", "key").join(counts, "row", "left").join(labels, "row", "left")
    linked = linked.select("key", F.col("label").alias("of"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "row").alias("root"))
    many = linked.where("n_links > 0")  # a class alone says nothing about its row
    rows = all_.select("row", "vec_id", "label", key.alias("key"), "ok")
    both = rows.join(many, (rows["key"] == many["key"]) & (rows["label"] == many["of"]) & rows["ok"], "left").select("vec_id", "row", "n_links", F.coalesce("root", "row").alias("root"))
    component = both.where("n_links > 0").groupBy("root").agg(F.min("vec_id").alias("name"))
    out = both.join(component, "root", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links") > 0, F.col("name")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
