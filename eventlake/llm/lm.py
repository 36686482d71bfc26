"""Language-model scores from n-gram tries in Elias-Fano levels.

The model is a bigram one over all words of the training documents: p(w | v) = (c(v w) + MU * p(w)) / (c(v) + MU), with
p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)), which leaves mass for unknown words. The logarithm splits into a part of (v, w),
kept in the trie, and one of v alone, added where v is counted as a word.

Words are known by 64 bits of a hash. Spark counts them first (N, V and the frequent ones). Then each task packs PIECE
tokens: their distinct (word, word before) pairs, with the documents that hold them, go in blocks to the shard of the
word. A shard is a range of hashes; the pairs of frequent words are dealt over all shards by both words, so no word fills
one. A shard merges its blocks into a trie: level 1 holds the words, level 2 under each word the words seen before it, as
offsets from the word's own base, so that the level rises throughout; pointers from 1 to 2 rise as well. All three are
Elias-Fano sequences beside 16-bit codes of the smoothed counts, in one flat buffer that is searched where it lies. Each
block's pairs are then looked up, trained or not, by successor search within the range of their word, and the shard
sends one sum per document back. What moves is 5 bytes per distinct pair and 2 to 6 per document that holds it; nothing
is kept to the most frequent, and the number of shards follows the tokens.

Null texts are empty: one end token. A null id counts as empty text and so as held out. Repeated rows are scored one by
one. Very long texts are packed in several pieces. Without training documents every word is unknown, and nothing fails;
an empty table gives an empty result. The rows must come in the same order when a task is run again, as from files: write
them first where they come from a shuffle. Only doc_id and text are read, so other columns can have any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm.elias_fano import EliasFano, pack, views
from eventlake.plans.stage import keep

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Weight of the words' own probabilities against counts of pairs: near the likeliest for held-out documents (README).
MU = 300.0
#: Tokens packed together, at most; documents in them, at most; training tokens per shard, about.
PIECE, DOCS, SHARD = 1 << 20, 1 << 12, 2_000_000
#: Words that are dealt over all shards, at most; a less frequent one is wholly in its shard.
FREQUENT = 1 << 20
#: Bits of the word before that a trie keeps.
CONTEXT = 40
CODES = (1 << 16) - 1
#: Not a word, as it begins with a space.
END = " end"

BLOCK = "shard int, part long, ids binary, trained binary, words binary, n_pairs binary, before binary, n_docs binary, docs binary, counts binary"
SUMS = "part long, ids binary, trained binary, docs binary, score binary, base binary, known binary, tokens binary"
ROWS = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens(text: Column) -> Column:
    """Hashes of the words and of the end."""
    found = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))
    return F.concat(F.transform(found, lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(END))))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of equal width, so that sorted hashes come in order of their shards."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b << np.uint64(23)) ^ (b >> np.uint64(11))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return starts, np.diff(starts, append=len(x))


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the spans, one span behind the other."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum())) if len(starts) else np.zeros(0, np.int64)


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : CONTEXT // 8]).tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) * 8 // CONTEXT, 8), np.uint8)
    wide[:, : CONTEXT // 8] = np.frombuffer(raw, np.uint8).reshape(-1, CONTEXT // 8)
    return wide.view("<u8").ravel().astype(np.uint64)


def _packer(shards: int, hot: np.ndarray) -> Callable:
    """Blocks of (shard, part) from rows (doc_id, trained, tokens)."""

    def blocks(part: int, ids: list, trained: list, pieces: list[np.ndarray]) -> Iterator[tuple]:
        lengths = np.array([len(p) for p in pieces])
        words = np.concatenate(pieces).view(np.uint64)
        doc = np.repeat(np.arange(len(pieces)), lengths)
        known, rank = np.unique(words, return_inverse=True)
        # 0 stands for the begin of a text, a word before for its rank and 1
        before = np.concatenate([[0], rank[:-1] + 1])
        before[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = 0
        context = np.concatenate([np.zeros(1, np.uint64), known >> np.uint64(64 - CONTEXT)])
        is_hot, flags = np.isin(known, hot), np.array(trained, np.uint16)
        head = (np.array([x or 0 for x in ids], np.int64), np.array([x is None for x in ids], np.uint8))
        first = True
        for a in range(0, len(words), PIECE):
            # ranks have 25 bits at most: a piece of 2 ** 20 tokens of a longer text is ranked with that text
            cut = slice(a, a + PIECE)
            wide = max(1, int(len(known) + 1).bit_length())
            if 2 * wide + 12 > 63:
                raise ValueError("a text has more distinct words than a piece can rank")
            key = (rank[cut].astype(np.int64) << (wide + 12)) | (before[cut].astype(np.int64) << 12) | doc[cut]
            key.sort()
            at, count = _runs(key)
            entry = key[at]
            pair_at, n_docs = _runs(entry >> 12)
            pair = entry[pair_at] >> 12
            w, v = pair >> wide, pair & ((1 << wide) - 1)
            to = shard_of(known[w], shards)
            warm = is_hot[w]
            to[warm] = shard_of(_mix(known[w[warm]], context[v[warm]]), shards)
            order = np.argsort(to, kind="stable")
            to, w, v, pair_at, n_docs = to[order], w[order], v[order], pair_at[order], n_docs[order]
            starts, lengths_ = _runs(to)
            for s, n in zip(starts.tolist(), lengths_.tolist(), strict=True):
                of = slice(s, s + n)
                places = _spans(pair_at[of], n_docs[of])
                docs = (entry[places] & 4095).astype(np.uint16)
                word_at, n_pairs = _runs(w[of])
                yield (
                    int(to[s]), part, *((head[0].tobytes(), np.stack([flags.astype(np.uint8), head[1]]).tobytes()) if first else (b"", b"")), known[w[of][word_at]].tobytes(), n_pairs.astype(np.uint32).tobytes(),
                    _five(context[v[of]]), n_docs[of].astype(np.uint16).tobytes(), (docs | flags[docs] << np.uint16(15)).tobytes(), count[places].astype(np.uint32).tobytes(),
                )
                first = False

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        schema = pa.schema([("shard", pa.int32()), ("part", pa.int64()), *((c, pa.binary()) for c in BLOCK.replace(" binary", "").split(", ")[2:])])
        top, seq, size = TaskContext.get().partitionId() << 32, 0, 0
        ids, trained, pieces = [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            for row in blocks(top | seq, ids, trained, pieces):
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)
            for x in (ids, trained, pieces):
                x.clear()

        for batch in batches:
            lists = batch.column(2)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, (doc_id, train) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                some = flat[offsets[i] : offsets[i + 1]].copy()
                if pieces and (size + len(some) > PIECE or len(pieces) == DOCS):
                    yield from flush()
                    seq, size = seq + 1, 0
                ids.append(doc_id)
                trained.append(train)
                pieces.append(some)
                size += len(some)
        if pieces:
            yield from flush()

    return go


class Trie:
    """Words, and under each the words before it with codes of smoothed counts; levels lie in one buffer."""

    def __init__(self, buffer):  # noqa: ANN001
        arrays = views(buffer)
        self.base, self.scale = arrays[0].tolist()
        self.first = arrays[1]
        self.words, self.pointers, self.before = (EliasFano(*arrays[2 + 4 * k : 6 + 4 * k]) for k in range(3))
        self.codes = arrays[14]

    @staticmethod
    def build(words: np.ndarray, n_before: np.ndarray, before: np.ndarray, values: np.ndarray) -> bytes:
        """Of sorted words, the number of words before each, those words sorted within each, and their values."""
        low, high = (float(values.min()), float(values.max())) if len(values) else (0.0, 0.0)
        scale = (high - low) / CODES or 1.0
        first = words[:1] if len(words) else np.zeros(1, np.uint64)
        starts = np.concatenate([[0], np.cumsum(n_before)]).astype(np.uint64)
        base = np.repeat(np.arange(len(words), dtype=np.uint64) << np.uint64(CONTEXT), n_before)
        levels = (
            EliasFano.of(words - first[0], int(words[-1] - first[0]) + 1 if len(words) else 1),
            EliasFano.of(starts, len(before) + 1),
            EliasFano.of(base + before, max(1, len(words)) << CONTEXT),
        )
        # rounded down, so that the probabilities of a context add up to one at most
        codes = np.floor((values - low) / scale * (1 + 1e-12)).clip(0, CODES).astype(np.uint16)
        return pack([np.array([low, scale]), first, *(a for x in levels for a in x.arrays()), codes])

    def find(self, words: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Values of the pairs, nan where there is none."""
        out = np.full(len(words), np.nan)
        if not self.words.n or not self.before.n:
            return out
        last = self.words.get(np.array([self.words.n - 1]))[0]
        inside = np.flatnonzero((words >= self.first[0]) & (words - self.first[0] <= last))
        at = self.words.successor(words[inside] - self.first[0])
        same = self.words.get(at) == words[inside] - self.first[0]
        inside, at = inside[same], at[same]
        begin, end = (self.pointers.get(at + k).astype(np.int64) for k in (0, 1))
        goal = (at.astype(np.uint64) << np.uint64(CONTEXT)) + before[inside]
        place = self.before.successor(goal, begin, end)
        there = place < end
        inside, place, goal = inside[there], place[there], goal[there]
        hit = self.before.get(place) == goal
        out[inside[hit]] = self.base + self.scale * self.codes[place[hit]]
        return out


class Blocks:
    """The blocks of one shard, taken apart and merged."""

    def __init__(self, table: pa.Table, hot: np.ndarray, hot_counts: np.ndarray):
        def all_of(name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
            arrays = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
            return np.concatenate(arrays), np.array([len(a) for a in arrays])

        words, _ = all_of("words", np.uint64)
        n_pairs, _ = all_of("n_pairs", np.uint32)
        before = np.concatenate([_from_five(x) for x in table.column("before").to_pylist()])
        n_docs, _ = all_of("n_docs", np.uint16)
        docs, self.per_block = all_of("docs", np.uint16)
        self.counts = all_of("counts", np.uint32)[0].astype(np.float64)
        self.docs, trained = (docs & 4095).astype(np.int64), docs >> 15
        self.words, inverse = np.unique(words, return_inverse=True)
        pairs, which = np.unique(np.repeat(inverse.astype(np.uint64) << np.uint64(CONTEXT), n_pairs) | before, return_inverse=True)
        self.word, self.before = (pairs >> np.uint64(CONTEXT)).astype(np.int64), pairs & np.uint64((1 << CONTEXT) - 1)
        self.pair = np.repeat(which, n_docs)
        self.seen = np.bincount(self.pair, self.counts * trained, len(pairs))
        self.word_seen = np.bincount(self.word, self.seen, len(self.words))
        if len(hot):
            at = np.searchsorted(hot, self.words).clip(0, len(hot) - 1)
            self.word_seen = np.where(hot[at] == self.words, hot_counts[at], self.word_seen)

    def trie(self, total: float, mu: float) -> bytes:
        """total: N + 0.1 * (V + 1)."""
        some = self.seen > 0
        at, n = _runs(self.word[some])
        smoothed = np.log10(self.seen[some] + mu * (self.word_seen[self.word[some]] + 0.1) / total)
        return Trie.build(self.words[self.word[some][at]], n, self.before[some], smoothed)


def _summer(hot: np.ndarray, hot_counts: np.ndarray, total: float, n_trained: int, end: int, mu: float) -> Callable:
    """Sums per document from the blocks of a shard."""

    def go(table: pa.Table) -> pa.Table:
        b = Blocks(table, hot, hot_counts)
        trie = Trie(b.trie(total, mu))
        p = (b.word_seen + 0.1) / total
        value = trie.find(b.words[b.word], b.before)
        value = np.where(np.isnan(value), np.log10(mu * p)[b.word], value)
        # each word is the context of the next one; the end of a text stands for its begin here
        context = np.where(b.words == np.uint64(end), np.log10(n_trained + mu), np.log10(b.word_seen + mu))
        n_blocks = len(b.per_block)
        place = np.repeat(np.arange(n_blocks, dtype=np.int64) * DOCS, b.per_block) + b.docs
        # one column at a time, over places of all blocks: a value per pair, then per document that holds it
        each = {"score": value - context[b.word], "base": np.log10(p)[b.word], "known": (b.word_seen > 0)[b.word], "tokens": np.ones(len(b.word), bool)}
        sums = {}
        for name in list(each):
            weight = each.pop(name)[b.pair] * b.counts
            sums[name] = np.bincount(place, weight, n_blocks * DOCS).reshape(n_blocks, DOCS)
        out = {name: [] for name in SUMS.replace(" long", "").replace(" binary", "").split(", ")}
        for i, (part, ids, trained) in enumerate(zip(*(table.column(c).to_pylist() for c in ("part", "ids", "trained")), strict=True)):
            present = np.flatnonzero(sums["tokens"][i])
            for name, x in (("part", part), ("ids", ids), ("trained", trained), ("docs", present.astype(np.uint16).tobytes())):
                out[name].append(x)
            for name, x in sums.items():
                out[name].append(x[i][present].astype(np.float64 if name in ("score", "base") else np.uint32).tobytes())
        return pa.table({"part": pa.array(out.pop("part"), pa.int64()), **{name: pa.array(x, pa.binary()) for name, x in out.items()}})

    return go


def _gather(table: pa.Table) -> pa.Table:
    """Rows of a part's documents from the sums of all shards."""
    columns = {c: table.column(c).to_pylist() for c in table.column_names}
    at = next(i for i, x in enumerate(columns["ids"]) if x)
    ids = np.frombuffer(columns["ids"][at], np.int64)
    trained, null = np.frombuffer(columns["trained"][at], np.uint8).reshape(2, -1)
    docs = np.concatenate([np.frombuffer(x, np.uint16) for x in columns["docs"]])
    sums = {c: np.bincount(docs, np.concatenate([np.frombuffer(x, k) for x in columns[c]]), len(ids)) for c, k in (("score", np.float64), ("base", np.float64), ("known", np.uint32), ("tokens", np.uint32))}
    return pa.table([
        pa.array(ids, mask=null.astype(bool)), pa.array(trained == 0), pa.array(sums["tokens"].astype(np.int64)), pa.array(sums["known"].astype(np.int64)), pa.array(sums["base"]), pa.array(sums["score"])
    ], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


class Counted:
    """What the training documents hold in all: number of tokens, distinct tokens and documents, and the frequent words."""

    def __init__(self, docs: DataFrame, per_shard: int = SHARD):
        trained = docs.where(~held_out(F.col("doc_id")))
        counts = keep(trained.select(F.explode(tokens(F.col("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")), "vocabulary")
        self.n_tokens, self.n_words = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).collect()[0])
        self.shards = max(1, math.ceil(self.n_tokens / per_shard))
        # above a quarter of a shard's tokens; FREQUENT words at most, as every task knows them
        frequent = counts.where(F.col("n") > self.n_tokens / min(4 * self.shards, FREQUENT)).collect()
        hot = np.array([x["w"] for x in frequent], np.int64).view(np.uint64)
        order = np.argsort(hot)
        self.hot, self.hot_counts = hot[order], np.array([x["n"] for x in frequent], np.float64)[order]
        end = docs.sparkSession.range(1).select(F.xxhash64(F.lit(END)).alias("w"))
        self.end = end.collect()[0]["w"] & ((1 << 64) - 1)
        self.n_docs = sum(x["n"] for x in frequent if x["w"] & ((1 << 64) - 1) == self.end) or (counts.join(F.broadcast(end), "w").agg(F.sum("n")).collect()[0][0] or 0)

    @property
    def total(self) -> float:
        return self.n_tokens + 0.1 * (self.n_words + 1)


def _blocks(docs: DataFrame, counted: Counted) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out(F.col("doc_id"))).alias("trained"), tokens(F.col("text")).alias("tokens")).mapInArrow(_packer(counted.shards, counted.hot), BLOCK)


def fit(docs: DataFrame, mu: float = MU, per_shard: int = SHARD) -> DataFrame:
    """shard, trie: the tries of all shards, each a buffer that `Trie` opens."""
    c = Counted(docs, per_shard)
    hot, hot_counts, total = c.hot, c.hot_counts, c.total

    def go(table: pa.Table) -> pa.Table:
        return pa.table({"shard": table.column("shard").slice(0, 1), "trie": pa.array([Blocks(table, hot, hot_counts).trie(total, mu)], pa.binary())})

    return _blocks(docs, c).groupBy("shard").applyInArrow(go, "shard int, trie binary")


def score(docs: DataFrame, mu: float = MU, per_shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document."""
    c = Counted(docs, per_shard)
    sums = _blocks(docs, c).groupBy("shard").applyInArrow(_summer(c.hot, c.hot_counts, c.total, c.n_docs, c.end, mu), SUMS)
    rows = sums.groupBy("part").applyInArrow(_gather, ROWS)
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(c.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
