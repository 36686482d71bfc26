"""Mixing sources to target weights by entropy balancing.

Each document of size z (its words) gets a rate r, its expected number of copies. The rates stay as near to 1 in relative
entropy as the constraints allow: in every source the sum of r * z must meet the target, and no rate may pass CAP. Their
form is r = min(CAP, exp(lambda * z / mean size)), with one lambda per source. It is the root of the dual's gradient,
found by Newton steps inside a shrinking bracket; each step is one distributed sum over (source, size) counts. The rates
are rounded to copies by a hash of the document; a small set of documents per source, at most about ADJUST, then takes up
what rounding has left over.

Sources weigh 1, 2, 3, 1, 2, 3 ... in order of code point, null last. Null text has size 0. A document of size 0 is
taken 0 times. Repeated rows share their hash. An empty table gives an empty result. A clash of names with size,
source_size, target or taken is the caller's; only doc_id, source and text are read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eventlake.llm.names import fresh
from eventlake.plans.stage import keep

#: No document is taken more often, and no source's target is larger than so many times its size.
CAP = 3
#: About how many documents of a source even out what rounding leaves over.
ADJUST = 400
TOLERANCE = 1e-9
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(by_source: DataFrame) -> DataFrame:
    """source, source_size -> with the weight and target of each. The table has one row per source, so one task orders it.

    Above water level t a source would get t * weight; it gets CAP * source_size at most. With the sources in order of
    CAP * source_size / weight, those up to some place are full and the rest share what is left by weight.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weighed = by_source.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("most", F.lit(float(CAP)) * F.col("source_size"))
    level = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_ = level.rowsBetween(W.unboundedPreceding, -1), W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(all_)
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    filled = weighed.withColumn("t", left / rest).withColumn("full", F.col("t") * F.col("weight") >= F.col("most"))
    # the first source that isn't full sets the level for itself and all that follow
    least = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "t"))).over(all_)["t"]
    return filled.select("source", "source_size", F.least("most", F.coalesce(least * F.col("weight"), F.col("most"))).alias("target"))


def rate(z, lam):  # noqa: ANN001, ANN201
    return F.least(F.lit(float(CAP)), F.exp(F.least(lam * z, F.lit(5.0))))


def solve(counts: DataFrame, goals: DataFrame, rounds: int = 60) -> DataFrame:
    """source, lam: from counts (source, size, n) and goals (source, source_size, target). A full source has a null lam."""
    mean = counts.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = goals.join(mean, goals["source"].eqNullSafe(mean["source"])).select(goals["source"], "target", "mean", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), (F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12)).alias("full"))
    state = keep(state.where("target > 0 or mean > 0"), "dual")
    for _ in range(rounds):
        z = F.col("size") / F.col("mean")
        r = rate(z, F.col("lam"))
        joined = counts.alias("c").join(state.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")) & ~F.col("full") & (F.col("mean") > 0))
        sums = joined.groupBy(F.col("s.source").alias("g_source")).agg(
            F.sum(F.col("n") * F.col("size") * r).alias("got"),
            F.sum(F.when(r < CAP, F.col("n") * F.col("size") * z * r).otherwise(0.0)).alias("slope"),
        )
        both = state.join(sums, state["source"].eqNullSafe(sums["g_source"]), "left")
        miss = F.col("got") - F.col("target")
        lo = F.when(miss <= 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(miss >= 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - miss / F.col("slope")
        # outside the bracket, or without a slope: halve the bracket, or widen it
        inside = (F.col("slope") > 0) & (F.col("nlo").isNull() | (newton > F.col("nlo"))) & (F.col("nhi").isNull() | (newton < F.col("nhi"))) & (F.abs(newton - F.col("lam")) <= 4)
        middle = (F.col("nlo") + F.col("nhi")) / 2
        step = F.when(inside, newton).when(F.col("nlo").isNotNull() & F.col("nhi").isNotNull(), middle).when(miss < 0, F.col("lam") + 4).otherwise(F.col("lam") - 4)
        near = F.abs(miss) <= TOLERANCE * F.col("target")
        new = both.withColumn("nlo", lo).withColumn("nhi", hi).select("source", "target", "mean", F.when(F.col("got").isNull() | near, F.col("lam")).otherwise(step).alias("lam"), F.col("nlo").alias("lo"), F.col("nhi").alias("hi"), "full", F.coalesce(~near, F.lit(False)).alias("off"))
        state = keep(new, "dual")
        if not state.where("off").limit(1).count():
            break
        state = state.drop("off")
    return state.select("source", "mean", F.when(~F.col("full"), F.col("lam")).alias("lam"))


def _even_out(pdf: pd.DataFrame) -> pd.DataFrame:
    """Copies of one source's adjusting documents, largest first, so that what is owed shrinks to the smallest size."""
    pdf = pdf.sort_values(["size", "u", "doc_id"], ascending=[False, True, True], na_position="last")
    z, r = pdf["size"].to_numpy(), pdf["rate"].to_numpy()
    owed, after = float(pdf["owed"].iloc[0]), float((z * r).sum())
    # scale so that the documents to come are expected to meet what is owed
    copies = []
    for size, want in zip(z.tolist(), r.tolist(), strict=True):
        share = want * owed / after if after > 0 else 0.0
        c = int(min(CAP, max(0, round(share)))) if size else 0
        copies.append(c)
        owed -= c * size
        after -= want * size
    return pdf.assign(copies=copies)[["doc_id", "source", "size", "copies"]]


def mix(docs: DataFrame, adjust: int = ADJUST) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies for every document."""
    sized = keep(sizes(docs), "sizes")
    counts = keep(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    by_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    goals = keep(targets(by_source.select("source", "source_size")), "targets")
    lam = solve(counts, goals)
    params = goals.alias("g").join(lam.alias("l"), F.col("g.source").eqNullSafe(F.col("l.source")), "left").join(by_source.alias("b"), F.col("g.source").eqNullSafe(F.col("b.source")))
    params = params.select(F.col("g.source").alias("p_source"), F.col("g.source_size"), "target", "mean", "lam", "docs")
    z = F.col("size") / F.col("mean")
    r = F.when(F.col("size") == 0, 0.0).when(F.col("lam").isNull(), float(CAP)).otherwise(rate(z, F.col("lam")))
    u = (F.pmod(F.xxhash64("doc_id", "source", "size"), F.lit(1 << 40)) / float(1 << 40)).alias("u")
    rated = sized.withColumn("u", u).join(params, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source").withColumn("rate", r)
    # a second, independent hash picks the documents that even out
    pick = F.pmod(F.xxhash64(F.lit("adjust"), "doc_id"), F.lit(1 << 40)) / float(1 << 40) < F.lit(float(adjust)) / F.col("docs")
    rated = keep(rated.withColumn("adjusts", pick & (F.col("rate") < CAP)), "rates")
    plain = rated.where(~F.col("adjusts")).withColumn("copies", (F.floor("rate") + (F.col("u") < F.col("rate") - F.floor("rate")).cast("long")).cast("long"))
    taken = plain.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("sum")).withColumnRenamed("source", "t_source")
    owed = goals.join(taken, F.col("source").eqNullSafe(F.col("t_source")), "left").select(F.col("source").alias("o_source"), (F.col("target") - F.coalesce("sum", F.lit(0))).alias("owed"))
    some = rated.where("adjusts").join(owed, F.col("source").eqNullSafe(F.col("o_source")))
    evened = some.select("doc_id", "source", "size", "u", "rate", "owed", "source_size", "target").groupBy("source").applyInPandas(lambda p: _even_out(p).assign(source_size=p["source_size"].iloc[0], target=p["target"].iloc[0]), "doc_id long, source string, size long, copies long, source_size long, target double")
    cols = ["doc_id", "source", "size", "source_size", "target", "copies"]
    return plain.select(*cols).union(evened.select(*cols))


def take(docs: DataFrame) -> DataFrame:
    """docs with each document repeated as the mix takes it, and left out where it takes none; all columns stay.

    Rows without a doc_id are taken once. Rows that share a doc_id are taken as often as the first of them.
    """
    n = fresh(docs, "mix_copies")
    copies = mix(docs.where("doc_id is not null")).where("copies > 0").groupBy("doc_id").agg(F.min("copies").cast("int").alias(n))
    taken = docs.join(copies, "doc_id").withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
    return taken.union(docs.where("doc_id is null"))
