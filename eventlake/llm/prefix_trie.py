"""The prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns; its identity is a sum of hashes of (place, turn), so that running sums give
every prefix of a conversation without holding it. Places in a conversation come from sorted ranges of all turns and
counts of the ranges before; running sums come from blocks of BLOCK places and sums of the blocks before. So no
conversation, however long, has to fit in a task.

Subtree totals (`contract`): each round rakes all leaves into their parents by partial sums and splices out every second
node of unary chains, whose sums wait on the edge above the child that takes their place. A bit of the depth, another one
in each round, says which nodes of a chain go, so that neighbours never go together. Rounds grow with the logarithm of
depth, not with depth. `expand` walks the rounds backwards: a spliced node's total is its own sum and that of the child
that replaced it, with what waited between the two. Every join of both has one row of a key on each side, so no family of children meets in a task.

The ids that end at a node are hashed in order from chunks of CHUNK ids, made in parallel; the last step streams a node's
chunks through one hash, as such a hash is sequential by nature, and holds one chunk at a time.

Turns are ordered by turn (null first), ties by a hash of role and text; null role and text are empty; repeated rows are
turns of their own. Rows without conv_id are left out. An empty table gives an empty result, otherwise the root is there.
Only conv_id, turn, role and text are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eventlake.plans.stage import keep

#: Places summed up in one window; ids joined in one chunk.
BLOCK, CHUNK = 1024, 4096
#: A node with more children hands its id to them over so many salted copies.
HOT, SALTS = 1000, 64
#: A prefix is known by three sums of 44 bits.
LANES, LANE_BITS = 3, 44
EMPTY = hashlib.sha256(b"").hexdigest()


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", *parts)))


def _lane(place: Column, turn: Column, k: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(k), place.cast("long"), turn), 64 - LANE_BITS)


def _key(depth: Column, lanes: list[Column]) -> Column:
    return _digest(depth.cast("string"), *(F.pmod(x, F.lit(1 << LANE_BITS)).cast("string") for x in lanes))


def _root() -> Column:
    return _key(F.lit(0), [F.lit(0)] * LANES)


def placed_turns(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, run, at, turn_hash, bytes) in sorted runs, and spans (conv_id, run, first, before, len): a turn's
    place is at - first + before + 1."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    slim = convs.where("conv_id is not null").select("conv_id", "turn", _digest(F.octet_length(role).cast("string"), role, text).alias("turn_hash"), F.octet_length(text).cast("long").alias("bytes"))
    order = (F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("turn_hash"))
    runs = keep(slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn").withColumn("at", F.monotonically_increasing_id()), "turns")
    runs = runs.withColumn("run", F.shiftright("at", 33))
    of_conv = W.partitionBy("conv_id")
    spans = runs.groupBy("conv_id", "run").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(of_conv.orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return runs, keep(spans.select("conv_id", "run", "first", before.alias("before"), F.sum("n").over(of_conv).alias("len")), "spans")


def rebuilt(convs: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, turn_hash, bytes, last) of conversations whose first h turns are those of their family's first
    conversation, h = crc32(conv_id) % most; and all conversations (conv_id, total). With family 1 they stay as they are."""
    runs, spans = placed_turns(convs)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    lens = spans.where("before = 0").select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("of"), h.alias("h"), "len")
    firsts = lens.select(F.col("conv_id").alias("of"), F.col("len").alias("first_len"))
    head = F.least("h", F.coalesce("first_len", F.lit(0)))
    shapes = keep(lens.join(firsts, "of", "left").select("conv_id", "of", "h", head.alias("head"), (head + F.greatest(F.col("len") - F.col("h"), F.lit(0))).alias("total")), "shapes")
    # `family` rows at most
    followers = shapes.where("head > 0").groupBy("of").agg(F.collect_list(F.struct("conv_id", "head", "total")).alias("followers")).withColumnRenamed("of", "conv_id")
    where = spans.join(shapes, "conv_id").join(followers, "conv_id", "left").drop("len", "of")
    placed = runs.join(where, ["conv_id", "run"]).withColumn("place", F.col("at") - F.col("first") + F.col("before") + 1)
    own = F.struct("conv_id", (F.col("place") - F.col("h") + F.col("head")).alias("depth"), "total")
    tail = F.when(F.col("place") > F.col("h"), F.array(own))
    heads = F.transform(F.filter("followers", lambda x: F.col("place") <= x["head"]), lambda x: F.struct(x["conv_id"].alias("conv_id"), F.col("place").alias("depth"), x["total"].alias("total")))
    kind = "array<struct<conv_id:bigint,depth:bigint,total:bigint>>"
    to = F.explode(F.concat(*(F.coalesce(x.cast(kind), F.array().cast(kind)) for x in (tail, heads))))
    rows = placed.select(to.alias("to"), "turn_hash", "bytes").select("to.*", "turn_hash", "bytes")
    return rows.select("conv_id", "depth", "turn_hash", "bytes", "total", (F.col("depth") == F.col("total")).alias("last")), shapes.select("conv_id", "total")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, bytes, last: for each turn, the node that it leads to and the one above."""
    block = F.floor(F.col("depth") / BLOCK).cast("long")
    names = [f"lane{k}" for k in range(LANES)]
    laned = turns.withColumn("block", block).select("*", *(_lane(F.col("depth"), F.col("turn_hash"), k).alias(n) for k, n in enumerate(names)))
    so_far = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    summed = laned.select("*", *(F.sum(n).over(so_far).alias(f"sum_{n}") for n in names))
    # blocks after the first are rare; sums of blocks stay below 2 ** 44, and so below 2 ** 63 for 500 million turns
    blocks = laned.where(F.col("total") >= BLOCK).groupBy("conv_id", "block").agg(*(F.pmod(F.sum(n), F.lit(1 << LANE_BITS)).alias(n) for n in names))
    earlier = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select("conv_id", "block", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"before_{n}") for n in names)).where("block > 0")
    rows = summed.join(offsets, ["conv_id", "block"], "left")
    sums = [F.col(f"sum_{n}") + F.coalesce(F.col(f"before_{n}"), F.lit(0)) for n in names]
    above = [s - F.col(n) for s, n in zip(sums, names, strict=True)]
    return rows.select("conv_id", "depth", _key(F.col("depth"), sums).alias("key"), _key(F.col("depth") - 1, above).alias("parent"), "bytes", "last")


def trie_nodes(members: DataFrame, convs: DataFrame) -> DataFrame:
    """key, parent, depth, conv_id, n_convs, kids, saved: one row per node, the root among them."""
    inner = members.groupBy("key").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(_root().alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("bytes"))
    nodes = keep(inner.unionByName(root), "trie")
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("kids"))
    return nodes.join(kids, "key", "left").select("key", "parent", "depth", "conv_id", "n_convs", F.coalesce("kids", F.lit(0)).alias("kids"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))


def contract(nodes: DataFrame, values: list[str]) -> list[DataFrame]:
    """Rounds of raking and splicing over nodes (key, parent, depth, kids and the values) until nothing is left.

    Each round is a written table of the nodes that were there: state `raked` (its values are its totals), `spliced`
    (they lack those of `kid` and the gap of nodes spliced out before between the two) or `rest`.
    """
    deepest = nodes.agg(F.max("depth")).first()[0]
    bits = max(1, int(deepest or 0).bit_length())
    waiting = [f"wait_{v}" for v in values]
    live = nodes.select("key", "parent", "depth", "kids", *values, *(F.lit(0).cast("long").alias(w) for w in waiting))
    rounds: list[DataFrame] = []
    while True:
        bit = len(rounds) % bits
        leaf = F.col("kids") == 0
        family = live.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(
            *(F.sum(F.when(leaf, F.col(v) + F.col(w)).otherwise(0)).alias(f"add_{v}") for v, w in zip(values, waiting, strict=True)),
            *(F.max(F.when(~leaf, F.col(w))).alias(f"gap_{v}") for v, w in zip(values, waiting, strict=True)), F.count_if(~leaf).alias("stay"), F.max(F.when(~leaf, F.col("key"))).alias("kid"), F.max(F.when(~leaf, F.col("depth"))).alias("kid_depth"),
        )
        odd = [F.shiftright(F.col(c), bit).bitwiseAND(F.lit(1)) for c in ("depth", "kid_depth")]
        splice = (F.col("stay") == 1) & F.col("parent").isNotNull() & (odd[0] == 1) & (odd[1] == 0)
        state = F.when(leaf, "raked").when(splice, "spliced").otherwise("rest")
        after = live.join(family, "key", "left").select(
            "key", "parent", "depth", F.coalesce("stay", F.lit(0)).alias("kids"), *((F.col(v) + F.coalesce(f"add_{v}", F.lit(0))).alias(v) for v in values), *waiting, *(f"gap_{v}" for v in values), F.when(splice, F.col("kid")).alias("kid"), state.alias("state")
        )
        rounds.append(keep(after, "round"))
        if rounds[-1].where("state = 'rest'").isEmpty():
            return rounds
        out = rounds[-1].where("state = 'spliced'").select(F.col("kid").alias("key"), F.col("parent").alias("up"), *((F.col(v) + F.col(w)).alias(f"more_{v}") for v, w in zip(values, waiting, strict=True)))
        live = rounds[-1].where("state = 'rest'").join(out, "key", "left").select(
            "key", F.coalesce("up", "parent").alias("parent"), "depth", "kids", *values, *((F.col(w) + F.coalesce(f"more_{v}", F.lit(0))).alias(w) for v, w in zip(values, waiting, strict=True))
        )


def expand(rounds: list[DataFrame], values: list[str]) -> DataFrame:
    """key and the values, summed over the subtree of each node."""
    totals = None
    for r in reversed(rounds):
        known = r.where("state = 'raked'").select("key", *values)
        if totals is not None:
            below = totals.select(F.col("key").alias("kid"), *(F.col(v).alias(f"below_{v}") for v in values))
            opened = r.where("state = 'spliced'").join(below, "kid").select("key", *((F.col(v) + F.col(f"gap_{v}") + F.col(f"below_{v}")).alias(v) for v in values))
            known = keep(known.unionByName(opened).unionByName(totals), "totals")
        totals = known
    return totals


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order, joined by commas, CHUNK of one key at most."""
    key, ids = None, []

    def flush(out: list[tuple[bytes, int, str]]) -> None:
        if ids:
            out.append((key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def batch(out: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())], names=["key", "first", "ids"])

    for b in batches:
        out: list[tuple[bytes, int, str]] = []
        for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != key or len(ids) >= CHUNK:
                flush(out)
                key = k
            ids.append(c)
        if out:
            yield batch(out)
    out = []
    flush(out)
    if out:
        yield batch(out)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per key over its chunks, which come in order."""
    key, state = None, None

    def batch(out: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["key", "ends_sha256"])

    for b in batches:
        out: list[tuple[bytes, str]] = []
        for k, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            if k != key:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if out:
            yield batch(out)
    if state is not None:
        yield batch([(key, state.hexdigest())])


def end_hashes(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 from (key, conv_id), conv_ids ascending."""
    parts = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_chunks, "key binary, first long, ids string")
    return parts.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashes, "key binary, ends_sha256 string")


def with_parent_ids(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id; the children of a node with many are dealt over salted copies of it."""
    up = nodes.where("kids > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("up_id"), "kids")
    hot = up.where(F.col("kids") > HOT).select("parent", F.col("up_id").alias("hot_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    cold = up.where(F.col("kids") <= HOT).select(F.col("parent").alias("probe"), "up_id")
    salted = nodes.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS))).join(hot, ["parent", "salt"], "left")
    # those who know their parent's id look for something that isn't there, each elsewhere
    probe = F.when(F.col("hot_id").isNull() & F.col("parent").isNotNull(), F.col("parent")).otherwise(_digest(F.lit("none"), F.hex("key")))
    return salted.withColumn("probe", probe).join(cold, "probe", "left").select(*nodes.columns, F.coalesce("hot_id", "up_id").alias("parent_conv_id"))


def prefix_trie(convs: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, all_convs = rebuilt(convs, family, most)
    members = keep(prefixes(turns), "prefixes")
    nodes = keep(trie_nodes(members, all_convs), "nodes")
    values = ["saved", "leaves"]
    totals = expand(contract(nodes.withColumn("leaves", (F.col("kids") == 0).cast("long")), values), values)
    ends = members.where("last").select("key", "conv_id").unionByName(all_convs.where("total = 0").select(_root().alias("key"), "conv_id"))
    rows = with_parent_ids(nodes.drop("saved")).join(totals, "key").join(end_hashes(ends), "key", "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
