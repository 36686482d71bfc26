"""Quality classifier: a weak-label model over heuristic labellers, whose posterior labels train a hashed linear scorer.

Ten heuristics vote good (1), bad (0) or nothing on each document. How often each pattern of votes occurs is counted over
all documents (at most 3^10 patterns); on these counts expectation-maximisation estimates the share of good documents and
each labeller's accuracy. The posterior of each pattern is the soft label of its documents. A logistic scorer over hashed
shapes of words (letters, digits and punctuation, with runs shortened) is trained with these labels on a sample of about
SAMPLE documents, twice as many at most, and scores every document from 0 to 1; one below the threshold is rejected.

Null and empty texts have no words: one labeller calls them bad, all others are silent. Texts of any length are read
whole. Repeated rows are each scored, and equal texts alike. An empty table gives an empty result, and its model scores
everything 0.5. No label, lang, source or id enters a score; columns of any name pass through `keep_good`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from eventlake.llm.tokens import slices
from eventlake.plans.stage import keep

#: Documents that the linear scorer is fitted on: a bound on the fit. The vote counts cover all documents.
SAMPLE = 20_000
BUCKETS = 1 << 12
LABELLERS = ("shouting", "symbols", "odd_ends", "repetition", "stutter", "lines", "table", "word_length", "empty", "prose")
THRESHOLD = 0.3
#: Words within which a repeated word counts, and words of a passage that counts if it comes again anywhere.
WINDOW = 200
PASSAGE = 8


def _classes() -> bytes:
    out = bytearray(range(256))
    for b in range(256):
        if 97 <= b <= 122 or b >= 128:
            out[b] = 97
        elif 65 <= b <= 90:
            out[b] = 65
        elif 48 <= b <= 57:
            out[b] = 48
        elif b < 33:
            out[b] = 10 if b == 10 else 32
    return bytes(out)


#: Bytes to letter, capital, digit, space, line feed; punctuation stays.
CLASSES = _classes()


def shape(data: bytes) -> bytes:
    """The text's shape: classes of bytes, with each run of one class shortened to one byte."""
    a = np.frombuffer(data.translate(CLASSES), np.uint8)
    if not a.size:
        return b""
    keep_ = np.ones(a.size, bool)
    keep_[1:] = a[1:] != a[:-1]
    return a[keep_].tobytes()


def repeated(words: list[bytes]) -> float:
    """How much of a text repeats, whatever its length: the mean share over consecutive windows, or that of passages.

    The last window ends with the text. In clean prose the share of words seen before grows with the text, that within a
    window doesn't, nor do passages come again; a copied stretch longer than a window shows in its passages.
    """
    n = len(words)
    if n < 20:
        return 0.0
    if n <= WINDOW:
        return 1 - len(set(words)) / n
    at = [*range(0, n - WINDOW, WINDOW), n - WINDOW]
    near = 1 - sum(len(set(words[i : i + WINDOW])) for i in at) / (WINDOW * len(at))
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    passages = np.zeros(n - PASSAGE + 1, np.uint64)
    for k in range(PASSAGE):
        passages = passages * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - PASSAGE + 1 + k]
    return max(near, 1 - len(np.unique(passages)) / len(passages))


def votes_and_shapes(text: str | None) -> tuple[np.ndarray, Counter]:
    """The labellers' votes (1, 0, or -1 for none) and how often each word shape occurs."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    v = np.full(len(LABELLERS), -1, np.int8)
    n = len(words)
    if not n:
        v[8] = 0
        return v, Counter()
    short = shape(data)
    shapes = Counter(short.split())
    classes = data.translate(CLASSES)
    lower, upper, digit, blank = (classes.count(c) for c in (b"a", b"A", b"0", b" "))
    blank += classes.count(b"\n")
    plain = sum(data.count(c) for c in (b".", b",", b"'", b'"', b"-", b"?", b":", b";", b"(", b")"))
    capitals = upper / max(1, lower + upper)
    symbols = (len(data) - lower - upper - digit - blank - plain) / max(1, len(data) - blank)
    odd = sum(c for s, c in shapes.items() if s[-1:] in b"!%*$#&@~^=+<>_") / n
    again = repeated(words)
    stutter = sum(map(bytes.__eq__, words[1:], words[:-1])) / max(1, n - 1)
    bars = words.count(b"|") / n
    mean = (len(data) - blank) / n
    lines = [x for x in data.split(b"\n") if x]
    lines_again = 1 - len(set(lines)) / len(lines) if len(lines) >= 6 else 0.0
    for i, bad in enumerate((capitals >= 0.5, symbols >= 0.08, odd >= 0.3, again >= 0.75, stutter >= 0.2, lines_again >= 0.4, bars >= 0.15, not 2 <= mean <= 25)):
        if bad:
            v[i] = 0
    if capitals < 0.3 and symbols < 0.05 and odd < 0.1 and again < 0.65 and stutter < 0.1 and bars < 0.05 and lines_again < 0.3:
        v[9] = 1
    # steps of the repeated shares stand beside the shapes, as features that hold for the whole text
    shapes[b"=again%d" % (again * 8)] = shapes[b"=stutter%d" % (stutter * 8)] = shapes[b"=lines%d" % (lines_again * 8)] = n
    return v, shapes


def hashed(shapes: Counter) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features: how often each word shape occurs, against the number of words, and a constant."""
    total = max(1, max(shapes.values(), default=1))
    at: Counter = Counter()
    for s, c in shapes.items():
        at[1 + xxhash.xxh3_64_intdigest(s) % (BUCKETS - 1)] += c
    keys = np.fromiter(at.keys(), np.int32, len(at))
    vals = np.sqrt(np.fromiter(at.values(), np.float32, len(at)) / total)
    return np.concatenate([[0], keys]).astype(np.int32), np.concatenate([[1.0], vals]).astype(np.float32)


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, how often each labeller's votes are right, and the posterior of every pattern seen."""

    good: float
    accuracy: np.ndarray
    posterior: dict[str, float]


def fit_label_model(patterns: list[str], counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation on the counts of vote patterns (one character for each labeller: 1, 0 or '-').

    In either class a labeller votes good, bad or nothing with probabilities of its own. It starts from the patterns
    without a bad vote as good ones.
    """
    m = len(LABELLERS)
    if not patterns:
        return LabelModel(0.5, np.full(m, 0.5), {})
    v = np.array([["-01".index(c) for c in p] for p in patterns])
    w = np.asarray(counts, float)
    one = (v[:, :, None] == np.arange(3)).astype(float)
    p = np.where((v == 1).any(axis=1), 0.05, 0.95)
    good = 0.5
    for _ in range(rounds):
        # a few imaginary documents keep every probability above 0
        classes = [(np.einsum("p,pmo->mo", w * q, one) + 0.2) / ((w * q).sum() + 0.6) for q in (p, 1 - p)]
        good = float(np.clip((w @ p + 1) / (w.sum() + 2), 0.01, 0.99))
        lg, lb = (np.log(share) + np.einsum("pmo,mo->p", one, np.log(c)) for share, c in zip((good, 1 - good), classes, strict=True))
        new = 1 / (1 + np.exp(np.clip(lb - lg, -500, 500)))
        done, p = np.abs(new - p).max() < 1e-9, new
        if done:
            break
    right = np.einsum("p,pm->m", w * p, one[:, :, 2]) + np.einsum("p,pm->m", w * (1 - p), one[:, :, 1])
    spoke = np.einsum("p,pm->m", w, one[:, :, 1] + one[:, :, 2])
    return LabelModel(good, (right + 0.5) / (spoke + 1), dict(zip(patterns, p.tolist(), strict=True)))


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray

    def score(self, keys: np.ndarray, vals: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[keys] @ vals, -30, 30))))


def fit_scorer(keys: list, vals: list, labels: np.ndarray, rounds: int = 300, rate: float = 1.0, ridge: float = 1e-5) -> Scorer:
    """Logistic regression with soft labels by gradient steps scaled per weight."""
    w = np.zeros(BUCKETS)
    if len(labels):
        flat, x = np.concatenate(keys), np.concatenate(vals).astype(float)
        row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        past = np.full(BUCKETS, 1e-8)
        for _ in range(rounds):
            z = np.bincount(row, w[flat] * x, len(keys))
            g = np.bincount(flat, (1 / (1 + np.exp(-z)) - labels)[row] * x, BUCKETS) / len(keys) + ridge * w
            past += g * g
            w -= rate * g / np.sqrt(past)
    return Scorer(w)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """carried column, text -> carried column, votes, keys and values of the features."""
    for batch in batches:
        for part in slices(batch, 1):
            votes, keys, vals = [], [], []
            for t in part.column(1):
                v, s = votes_and_shapes(t.as_py())
                k, x = hashed(s)
                votes.append("".join("1" if i == 1 else "0" if i == 0 else "-" for i in v.tolist()))
                keys.append(k)
                vals.append(x)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(votes, pa.string()), pa.array(keys, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float32()))], ["carry", "votes", "keys", "vals"])


def features(docs: DataFrame, *carry: str) -> DataFrame:
    """The carried columns as one, votes, keys, vals."""
    rows = docs.select(F.struct(*carry).alias("carry"), "text")
    made = [StructField("votes", StringType()), StructField("keys", ArrayType(IntegerType())), StructField("vals", ArrayType(FloatType()))]
    return rows.mapInArrow(_features, StructType([rows.schema["carry"], *made]))


def fit(feats: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, Scorer, DataFrame]:
    """Both models from kept features, and the patterns' posteriors as a table."""
    spark = feats.sparkSession
    counted = feats.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    model = fit_label_model([r.votes for r in counted], np.array([r.n for r in counted]))
    total = sum(r.n for r in counted)
    # the sample is a threshold on a hash, so that a document is in it whatever the partitions are
    share = min(1.0, sample / max(1, total))
    place = F.xxhash64("votes", "keys", "vals")
    rows = feats.select("votes", "keys", "vals", place.alias("h")).where(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000)).orderBy("h", "votes").limit(2 * sample).toPandas()
    labels = np.array([model.posterior[v] for v in rows["votes"]])
    scorer = fit_scorer(rows["keys"].tolist(), rows["vals"].tolist(), labels)
    table = spark.createDataFrame([(p, float(x)) for p, x in model.posterior.items()], "votes string, posterior double")
    return model, scorer, table


def _scorer(model: Scorer):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [model.score(k.values.to_numpy(), x.values.to_numpy()) for k, x in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.float64())], ["carry", "votes", "score"])

    return go


def _scored(feats: DataFrame, scorer: Scorer) -> DataFrame:
    made = [StructField("votes", StringType()), StructField("score", DoubleType())]
    return feats.mapInArrow(_scorer(scorer), StructType([feats.schema["carry"], *made]))


def classify(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, votes, posterior, score, keep for every document."""
    feats = keep(features(docs, "doc_id"), "quality-features")
    _, scorer, table = fit(feats)
    # at most 3^10 patterns of votes exist, so this side is small whatever the input
    return _scored(feats, scorer).join(F.broadcast(table), "votes").select("carry.doc_id", "votes", "posterior", "score", (F.col("score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of the documents whose score reaches the threshold. Texts are written beside their features, so that
    these are worked out once."""
    feats = keep(features(docs, *docs.columns), "quality-features")
    _, scorer, _ = fit(feats)
    return _scored(feats, scorer).where(F.col("score") >= threshold).select("carry.*")
