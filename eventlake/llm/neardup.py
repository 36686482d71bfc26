"""MinHash near-duplicates by a signature-coordinate inverted join.

Every document becomes the set of its distinct five-word shingles; equal sets form one class, and only one row per class
goes on. Each class posts its name under every (coordinate, value) pair of its signature of K coordinates. A pair of
classes that collides in at least m of the K is a candidate:

* skip: a class that shares fewer than m of its postings with anyone can't reach the threshold, and drops out;
* prefix: of the rest, each class keeps only its rarest postings, K - m + 1 counted over all its coordinates: two classes
  that collide m times must meet in both prefixes;
* postings of up to SMALL_LIST classes give all their pairs, longer ones give each member with the posting's hub, the
  member whose postings are the most common;
* the collisions of each pair found are counted over all K posted coordinates; those with m or more are confirmed on the
  full shingle sets.

What longer postings hold besides the pairs with their hub is compared in blocks of about BLOCK classes or BLOCK_SHINGLES
shingles for each hub, on the full sets, in tasks that give back only links that join two components. m is set so that a pair at the threshold fails
with a probability of MISS at most, one above it with less; nothing else is lost, no posting is cut short. Postings that
very many classes share are salted before they are joined.

Null, empty and blank texts have an empty set and link with nothing. Shorter texts are one shingle. Texts of any length
are read whole. Repeated rows are one class; rows that share a doc_id but not a text are documents of their own. Null
doc_ids take part in links, and never name a component: one of such rows alone has a null name. Empty tables give an
empty result; further columns are not read. Classes are named by a 64-bit hash of the set, texts by one of the text: of n
of them two meet with probability n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eventlake.llm import shingles as S
from eventlake.llm.names import fresh
from eventlake.operators.graph import connected_components
from eventlake.plans.stage import keep

K = 48
#: With at most this probability a pair at the threshold has fewer colliding coordinates than are asked for.
MISS = 2e-8
SMALL_LIST = 48
#: Classes of a block, and shingles of all its texts together, about.
BLOCK, BLOCK_SHINGLES = 256, 400_000
#: Postings with more classes than this, and at most HOT_LISTS of them, are spread over SALTS keys.
HOT, HOT_LISTS, SALTS = 1_000, 100_000, 32


def needed(coordinates: int, percent: int) -> int:
    """The largest count that a pair at the threshold misses with a probability of MISS at most."""
    p, below = percent / 100, 0.0
    for t in range(coordinates):
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if below > MISS:
            return max(1, t)
    return coordinates


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, body, text -> doc_id, body, n, node, sig (K ints: the upper halves of the least products)."""
    factors = S.multipliers(K)
    for batch in batches:
        rows = []
        for text in batch.column(2):
            u = S.shingle_set(text.as_py())
            if u.size:
                sig = (S.signature(u, factors, 2048) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                rows.append((u.size, S.set_key(u)[0], sig))
            else:
                rows.append((0, None, None))
        n, node, sig = zip(*rows, strict=True) if rows else ((),) * 3
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(sig, pa.list_(pa.int32()))],
            ["doc_id", "body", "n", "node", "sig"],
        )


def _body(text: str = "text"):
    """What stands for a text where it is looked up again."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sign(docs: DataFrame) -> DataFrame:
    """The size, class name and signature of each document's shingle set."""
    return docs.select(F.col("doc_id").cast("long"), _body().alias("body"), "text").mapInArrow(_sign, "doc_id long, body long, n long, node long, sig array<int>")


def _confirm(percent: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """a, b, text a, text b -> the pairs whose sets reach the threshold."""
        for batch in batches:
            a, b, ok, last, left = batch.column(0), batch.column(1), [], None, None
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                if (x := x.as_py()) != last:
                    last, left = x, S.shingle_set(x)
                both, either = S.jaccard_counts(left, S.shingle_set(y.as_py()))
                ok.append(100 * both >= percent * either)
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], ["a", "b"])

    return go


def _block_links(percent: int):
    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        """One pair of blocks: links between different labels, only as many as join components."""
        pdf = pdf.drop_duplicates("node")
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        sets = [S.shingle_set(t) for t in pdf["text"]]
        node, label, block = pdf["node"].to_numpy(), pdf["label"].tolist(), pdf["block"].to_numpy()
        sizes = np.array([s.size for s in sets])
        parent = {x: x for x in label}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        left, right = np.flatnonzero(block == p), np.flatnonzero(block == q)
        if left.size and right.size:
            flat = np.concatenate([sets[j] for j in right])
            owner = np.repeat(np.arange(right.size), sizes[right])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for i in left:
                # how often each text of the other block meets a shingle of this one
                lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=right.size)
                ok = 100 * both >= percent * (sizes[i] + sizes[right] - both)
                for j in right[ok]:
                    x, y = find(label[i]), find(label[j])
                    if x != y:
                        parent[x] = y
                        out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return go


def collisions(a: str, b: str):
    """In how many coordinates two signatures collide."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _posting_counts(posts: DataFrame, classes: int) -> DataFrame:
    """node, post, c: the postings that more than one class has, with how many have it.

    The hot ones are so few that every task can know them: their number is bounded by HOT_LISTS whatever the input is.
    """
    shared = keep(posts.groupBy("post").agg(F.count("*").alias("c")).where("c > 1"), "shared-posts")
    hot = shared.where(F.col("c") > max(HOT, classes * K // HOT_LISTS)).select("post", F.lit(SALTS).alias("salts"))
    spread = shared.join(F.broadcast(hot), "post", "left").select("post", "c", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    mine = posts.join(F.broadcast(hot), "post", "left").select("node", "post", F.when(F.col("salts").isNotNull(), F.pmod("node", F.lit(SALTS))).otherwise(0).cast("int").alias("salt"))
    return mine.join(spread, ["post", "salt"]).select("node", "post", "c")


def _classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, body, n, node) of every row, and (node, component, name) of every class: its component's smallest doc_id."""
    if percent < 80:
        raise ValueError("signatures of this length serve thresholds of 80 percent or more")
    match = needed(K, percent)
    signed = keep(sign(docs), "minhash")
    full = signed.where("n > 0")
    # the row that lends its text, one with a doc_id if there is any
    lends = F.max(F.struct("doc_id", "body")).alias("lends")
    reps = full.groupBy("node").agg(F.min("doc_id").alias("first_id"), lends, F.first("sig").alias("sig"), F.first("n").alias("n"))
    reps = keep(reps.select("node", "first_id", F.col("lends.doc_id").alias("text_id"), F.col("lends.body").alias("body"), "sig", "n"), "classes")

    posts = reps.select("node", F.posexplode("sig").alias("at", "value")).select("node", F.xxhash64("at", "value").alias("post"))
    met = _posting_counts(posts, reps.count()).groupBy("node").agg(F.count("*").alias("m"), F.sum("c").alias("weight"), F.sort_array(F.collect_list(F.struct("c", "post"))).alias("by")).where(F.col("m") >= match)
    prefix = keep(met.select("node", "weight", F.inline(F.slice("by", F.lit(1), (F.col("m") - (match - 1)).cast("int")))), "prefix")

    small = prefix.where(F.col("c") <= SMALL_LIST).select("post", "node")
    pairs = small.join(small.withColumnRenamed("node", "b"), "post").where("node < b").select(F.col("node").alias("a"), "b")
    long_ = prefix.where(F.col("c") > SMALL_LIST)
    hubs = long_.groupBy("post").agg(F.count("*").alias("met"), F.max_by("node", F.struct("weight", "node")).alias("hub")).where("met > 1")
    hubs = hubs.select("post", "hub", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    stars = keep(long_.withColumn("salt", F.pmod("node", F.lit(SALTS)).cast("int")).join(hubs, ["post", "salt"]).select("hub", "node").distinct(), "stars")
    near = pairs.union(stars.where("hub <> node").select(F.least("hub", "node"), F.greatest("hub", "node"))).distinct()

    sigs = reps.select("node", "sig")
    near = near.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b").where(collisions("sa", "sb") >= match).select("a", "b")
    near = keep(near, "near")
    texts = _texts(docs, near.select("a").union(near.select("b")).union(stars.select("node")).distinct(), reps)
    with_text = near.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    links = keep(with_text.select("a", "b", "ta", "tb").mapInArrow(_confirm(percent), "a long, b long"), "links")
    labels = connected_components(links)

    star = stars.join(labels, "node", "left").join(reps.select("node", "n"), "node").select("hub", "node", F.coalesce("label", "node").alias("label"), "n")
    sums = star.groupBy("hub").agg(F.count("*").alias("m"), F.sum("n").alias("held"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("hub", "m", "held")
    open_ = keep(star.drop("n").join(sums, "hub"), "open-stars")
    if not open_.isEmpty():
        # a block is bounded by what its texts hold as well as by their number
        nb = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("int")
        placed = open_.withColumn("nb", nb).withColumn("block", F.pmod(F.xxhash64("node"), "nb").cast("int"))
        cells = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("hub", "node", "label", "block", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"))
        # a pair of blocks under one label has nothing left to join
        mixed = cells.groupBy("hub", "p", "q").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("hub", "p", "q")
        cells = cells.join(mixed, ["hub", "p", "q"]).join(texts, "node")
        more = cells.groupBy("hub", "p", "q").applyInPandas(_block_links(percent), "a long, b long")
        labels = connected_components(links.union(keep(more, "block-links")))

    grouped = reps.select("node", "first_id").join(labels, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("component"))
    names = grouped.join(grouped.groupBy("component").agg(F.min("first_id").alias("name")), "component").select("node", "component", "name")
    return signed.select("doc_id", "body", "n", "node"), names


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs. Links need 100 * intersection >= percent * union."""
    rows, names = _classes(docs, percent)
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rest = rows.where("n > 0").join(names, "node").select("doc_id", F.col("n").alias("n_shingles"), F.col("name").alias("component_id"))
    return rest.union(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _texts(docs: DataFrame, nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """node, text of the classes that need a look at their full set."""
    wanted = reps.select("node", F.struct("text_id").alias("id"), "body").join(nodes.toDF("node"), "node", "left_semi")
    # by body and doc_id, so that copies of a text don't all come
    text = docs.select(_body().alias("body"), F.struct(F.col("doc_id").cast("long").alias("text_id")).alias("id"), "text").join(wanted, ["body", "id"]).select("node", "text")
    return keep(text.dropDuplicates(["node"]), "texts")


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """All columns of docs, without the rows whose component has a row of smaller doc_id.

    Of rows of one component that share its smallest doc_id, the first in order of the other columns stays. Rows without a
    doc_id or without words all stay.
    """
    rows, names = _classes(docs, percent)
    rows = keep(rows.where("n > 0 and doc_id is not null").join(names, "node").select("doc_id", "body", "component", "name"), "components")
    gone = rows.where("doc_id > name").select("doc_id", "body").distinct()
    tied = rows.where("doc_id = name").groupBy("component").agg(F.count("*").alias("c"), F.collect_set("body").alias("bodies"), F.first("doc_id").alias("doc_id")).where("c > 1")
    tied = tied.select("component", "doc_id", F.explode("bodies").alias("body"))
    body, place, group = (fresh(docs, n) for n in ("body", "place", "component"))
    named = docs.withColumn(body, _body())

    def keys(df: DataFrame, *more: str) -> DataFrame:
        return df.select(F.col("doc_id"), F.col("body").alias(body), *(F.col(m).alias(group) for m in more))

    left = named.join(keys(gone), ["doc_id", body], "left_anti").select(*docs.columns, body)
    if tied.isEmpty():
        return left.select(*docs.columns)
    order = [F.col(c).asc_nulls_last() for c in docs.columns if c != "doc_id"]
    again = left.join(keys(tied, "component"), ["doc_id", body]).withColumn(place, F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return left.join(keys(tied), ["doc_id", body], "left_anti").select(*docs.columns).union(again.where(F.col(place) == 1).select(*docs.columns))
