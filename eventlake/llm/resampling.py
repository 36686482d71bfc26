"""Resampling documents towards a target distribution, by hashed word runs and Gumbel scores.

Features are the runs of up to `runs` consecutive words of a lower-cased text (A-Z only), each hashed into one of `size`
buckets. A bucket's gain is the log ratio of its smoothed shares in the target and in the corpus, scaled and floored; a
document's weight is the sum of gains over its features, read from one array. The score adds Gumbel noise that a hash of
the id fixes, so that the highest scores are a sample without replacement, the same in every run.

The exact ranks come from parallel sorting by regular sampling: every task sorts its rows into a run, rows at regular
places of all runs give regular splitters, the segments between splitters are exchanged and merged locally by windows, and
prefix sums of the segments' counts turn places into ranks. There are SEGMENTS segments and runs at most, so
2 * SEGMENTS ** 2 rows at most are looked at for splitters, and no segment holds more than about twice its share, unless
more rows than that are equal in score and id.

Null texts have no words. A null id is hashed as an empty one and comes before others among ties. Documents with fewer
than `least` words are scored but not drawn. Repeated rows are ranked one by one, in any order among equals. An empty
target gains by the smoothing alone; an empty corpus gives an empty result. Only id and text are read, so other columns
can have any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eventlake.plans.stage import keep

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10_000
#: About so many rows make a segment, up to so many segments; beyond that segments grow.
SEGMENT_ROWS = 8192
SEGMENTS = 1024


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def features(found: Column, runs: int) -> Column:
    """All runs of 1 to `runs` consecutive words, joined by one space."""
    if runs == 1:
        return found

    def of(k: Column) -> Column:
        starts = F.when(F.size(found) >= k, F.sequence(F.lit(1), F.size(found) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(found, i, k), " "))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(runs)), of))


def bucketed(found: Column, runs: int, size: int) -> Column:
    """Buckets of a column of words: a column, so that they aren't split again for every run."""
    return F.transform(features(found, runs), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(size)).cast("int"))


def bucket_counts(texts: DataFrame, runs: int = 1, size: int = BUCKETS, text: str = "text") -> DataFrame:
    """bucket, n: at most `size` rows, added up within tasks first."""
    return texts.select(words(F.col(text)).alias("words")).select(F.explode(bucketed(F.col("words"), runs, size)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, runs: int = 1, size: int = BUCKETS) -> DataFrame:
    """One row with the array `gains`, one long per bucket."""
    corpus = bucket_counts(docs, runs, size).withColumnRenamed("n", "s")
    wanted = bucket_counts(target, runs, size).withColumnRenamed("n", "t")
    every = docs.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus, "bucket", "left").join(wanted, "bucket", "left").na.fill(0, ["s", "t"])
    s, t = F.col("x.s").cast("double"), F.col("x.t").cast("double")
    in_all = both.agg(F.collect_list(F.struct("bucket", "s", "t")).alias("rows"), F.sum("s").cast("double").alias("all_s"), F.sum("t").cast("double").alias("all_t"))
    gain = F.floor(1000 * F.log((t + 1) * (F.col("all_s") + size) / ((s + 1) * (F.col("all_t") + size))))
    one = in_all.select(F.explode("rows").alias("x"), "all_s", "all_t").select(F.col("x.bucket").alias("bucket"), gain.cast("long").alias("gain"))
    return one.agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "gain"))), lambda x: x["gain"]).alias("gains"))


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, fixed by the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, runs: int = 1, size: int = BUCKETS, seed: str = "2024") -> DataFrame:
    """doc_id, n_words, n_features, weight, score for every document."""
    # `size` numbers, as one constant of the plan
    found = gains(docs, target, runs, size).first()["gains"]
    table = F.split(F.lit(",".join(map(str, found))), ",").cast("array<bigint>")
    split = docs.select("doc_id", words(F.col("text")).alias("words"))
    n_words = F.size("words")
    weight = F.aggregate(bucketed(F.col("words"), runs, size), F.lit(0).cast("long"), lambda total, b: total + F.get(table, b))
    n = sum((F.greatest(n_words - k, F.lit(0)) for k in range(runs)), F.lit(0)).cast("long")
    rows = split.select("doc_id", n_words.alias("n_words"), n.alias("n_features"), weight.alias("weight"))
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def regular_ranks(rows: DataFrame, score: str = "score", key: str = "doc_id", segment_rows: int = SEGMENT_ROWS, most: int = SEGMENTS) -> DataFrame:
    """rows with `rank`, 1 for the highest score, ties to the smaller key, by sorting with regular samples."""
    total = rows.count()
    segments = max(1, min(most, math.ceil(total / segment_rows)))
    order = (F.col(score).desc(), F.col(key).asc_nulls_first())
    runs = keep(rows.coalesce(segments).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "runs")
    # the lower 33 bits of `at` count a run's rows
    step = max(1, total // (segments * segments))
    regular = runs.where((F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1) % step == 0)
    place = F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))
    sampled = regular.agg(F.sort_array(F.collect_list(place)).alias("all"))
    cut = F.transform(F.sequence(F.lit(1), F.lit(segments - 1)), lambda i: F.get(F.col("all"), (i * F.size("all") / segments).cast("int"))) if segments > 1 else None
    splitters = sampled.select(cut.alias("cut")).first()["cut"] if cut is not None else []
    if splitters:
        table = F.array(*[F.struct(F.lit(x["s"]).cast("long").alias("s"), F.lit(x["k"]).cast(rows.schema[key].dataType).alias("k")) for x in splitters])
        halves = [1 << i for i in reversed(range(len(splitters).bit_length()))]
        # the number of splitters below the row, found by halving
        segment = F.aggregate(F.array(*map(F.lit, halves)), F.lit(0), lambda at, half: F.when((at + half <= len(splitters)) & (F.get(table, at + half - 1) < place), at + half).otherwise(at))
    else:
        segment = F.lit(0)
    dealt = runs.withColumn("segment", segment)
    merged = dealt.withColumn("place", F.row_number().over(W.partitionBy("segment").orderBy(*order)))
    before = dealt.groupBy("segment").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # one row per segment, SEGMENTS at most
    return merged.join(F.broadcast(before.select("segment", "before")), "segment").select(*rows.columns, (F.col("before") + F.col("place")).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, runs: int = 1, size: int = BUCKETS, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score, rank: the rank is null where a document isn't drawn."""
    scored = keep(weigh(docs, target, runs, size, seed), "scores")
    fit = scored.where(F.col("n_words") >= least)
    drawn = fit.count() * percent // 100
    cols = ("doc_id", "n_features", "weight", "score")
    ranked = regular_ranks(fit).select(*cols, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(F.col("n_words") < least).select(*cols, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, resampled: DataFrame) -> DataFrame:
    """The documents that were drawn, with all their columns; rows that share a drawn id all come."""
    return docs.join(resampled.where("rank is not null").select("doc_id").distinct(), "doc_id", "left_semi")
