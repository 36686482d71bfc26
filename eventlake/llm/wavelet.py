"""Token ids in wavelet-matrix shards: one compressed file per shard with access, counting and occurrence lookup.

A shard holds the ids of consecutive documents. Plane k has bit k of every id (the highest first); after each plane the
ids are stably parted into zeros and ones. A plane is stored in chunks of CHUNK bits, each compressed by itself, with the
number of ones before each of them (its ranks). So looking up one place unpacks one or two chunks per plane, not the file.

Documents are written in ascending doc_id order (null first), each with the end id. Null text counts as empty. Repeated
doc_ids stand next to each other, ordered by text. A text of any length is one document of one shard. An empty table
writes no shard and reads as an empty result. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eventlake.llm.tokens import run_encoder, slices
from eventlake.plans.stage import keep

MAGIC = b"WMX2"
#: Ids after which a shard is closed; a longer document has a shard of its own length.
SHARD_TOKENS = 1 << 20
CHUNK = 1 << 17
CHUNK_BYTES = CHUNK // 8
END_ID = 2
#: Bytes of pieces that a writing worker remembers: it runs alone in its executor's slot and has no other large state.
REMEMBER = 192 << 20
#: Characters that are encoded together: a distinct piece is looked up once for all of them.
SLICE = 6_000_000


class WaveletMatrix:
    """Bit planes of a sequence of unsigned ids: their zeros, the ones before each chunk, and access to chunks."""

    def __init__(self, n: int, zeros: list[int], ranks: np.ndarray, chunk: Callable[[int, int], np.ndarray]):
        self.n, self.zeros, self.ranks, self._chunk = n, zeros, ranks, chunk
        self.depth, self._unpacked = len(zeros), {}

    @staticmethod
    def build(ids: np.ndarray) -> WaveletMatrix:
        x, planes, zeros = ids, [], []
        for k in range(max(1, int(ids.max(initial=0)).bit_length()) - 1, -1, -1):
            bit = ((x >> x.dtype.type(k)) & x.dtype.type(1)).astype(bool)
            planes.append(np.packbits(bit, bitorder="little"))
            low = x[np.flatnonzero(~bit)]
            zeros.append(len(low))
            x = np.concatenate([low, x[np.flatnonzero(bit)]])
        at = np.arange(0, len(planes[0]), CHUNK_BYTES)
        ones = [np.add.reduceat(np.bitwise_count(p), at, dtype=np.int64) if len(p) else np.zeros(0, np.int64) for p in planes]
        ranks = np.array([np.concatenate([[0], np.cumsum(o)]) for o in ones])
        return WaveletMatrix(len(ids), zeros, ranks, lambda k, c: planes[k][c * CHUNK_BYTES : (c + 1) * CHUNK_BYTES])

    def chunks(self, k: int) -> int:
        return self.ranks.shape[1] - 1

    def chunk(self, k: int, c: int) -> np.ndarray:
        """Bytes of one chunk; the last one used of each plane is kept unpacked."""
        held = self._unpacked.get(k)
        if held is None or held[0] != c:
            held = self._unpacked[k] = (c, self._chunk(k, c))
        return held[1]

    def _rank(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        c, left = divmod(i, CHUNK)
        ones = int(self.ranks[k, c])
        if left:
            bits, (whole, rest) = self.chunk(k, c), divmod(left, 8)
            ones += int(np.bitwise_count(bits[:whole]).sum(dtype=np.int64))
            ones += (int(bits[whole]) & ((1 << rest) - 1)).bit_count() if rest else 0
        return ones

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.depth):
            c, left = divmod(i, CHUNK)
            bit, ones = int(self.chunk(k, c)[left >> 3]) >> (left & 7) & 1, self._rank(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the token's occurrences in [lo, hi) lie below the last plane."""
        if token < 0 or token >> self.depth:
            return 0, 0
        for k in range(self.depth):
            a, b = self._rank(k, lo), self._rank(k, hi)
            lo, hi = (self.zeros[k] + a, self.zeros[k] + b) if token >> (self.depth - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often a token stands in [lo, hi)."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def _select(self, k: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) such bit of plane k."""
        marks = self.ranks[k] if bit else np.minimum(np.arange(self.ranks.shape[1]) * CHUNK, self.n) - self.ranks[k]
        c = int(np.searchsorted(marks, j, "right")) - 1
        bits = np.unpackbits(self.chunk(k, c), bitorder="little")
        return c * CHUNK + int(np.flatnonzero(bits == bit)[j - int(marks[c])])

    def select(self, token: int, j: int) -> int:
        """Place of the j-th (from 0) occurrence of a token; -1 if there are fewer."""
        lo, hi = self._range(token, 0, self.n)
        if not 0 <= j < hi - lo:
            return -1
        i = lo + j
        for k in range(self.depth - 1, -1, -1):
            bit = token >> (self.depth - 1 - k) & 1
            i = self._select(k, bit, i - self.zeros[k] if bit else i)
        return i

    def _bits(self, k: int) -> np.ndarray:
        whole = np.concatenate([np.zeros(0, np.uint8), *(self._chunk(k, c) for c in range(self.chunks(k)))])
        return np.unpackbits(whole, count=self.n, bitorder="little").view(bool)

    def places(self, token: int) -> np.ndarray:
        """All places of a token in ascending order."""
        lo, hi = self._range(token, 0, self.n)
        at = np.arange(lo, hi)
        for k in range(self.depth - 1, -1, -1):
            if not len(at):
                break
            bit = self._bits(k)
            at = np.flatnonzero(bit)[at - self.zeros[k]] if token >> (self.depth - 1 - k) & 1 else np.flatnonzero(~bit)[at]
        return at

    def all(self) -> np.ndarray:
        """Every id, from the lowest plane upwards: each plane undoes its own parting."""
        v = np.zeros(self.n, np.uint16 if self.depth <= 16 else np.uint32)
        for low, k in enumerate(range(self.depth - 1, -1, -1)):
            bit = self._bits(k)
            out = np.empty_like(v)
            out[np.flatnonzero(~bit)] = v[: self.zeros[k]]
            out[np.flatnonzero(bit)] = v[self.zeros[k] :] | v.dtype.type(1 << low)
            v = out
        return v


def dump(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """One shard as one file: head, sizes of the chunks, ranks, documents, chunks."""
    m, z = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1)
    docs = z.compress(json.dumps([doc_ids, lengths.tolist()]).encode())
    chunks = [z.compress(m.chunk(k, c).tobytes()) for k in range(m.depth) for c in range(m.chunks(k))]
    sizes = np.array([len(c) for c in chunks], "<u4").tobytes()
    head = json.dumps({"n": m.n, "zeros": m.zeros, "docs": len(docs)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, sizes, m.ranks.astype("<u4").tobytes(), docs, *chunks])


def load(file: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, whose chunks are unpacked as they are needed, the doc_ids and the lengths of a shard's documents."""
    if file[:4] != MAGIC:
        raise ValueError("not a wavelet shard")
    at = 8 + struct.unpack("<I", file[4:8])[0]
    head, z = json.loads(file[8:at]), zstandard.ZstdDecompressor()
    n, zeros = head["n"], head["zeros"]
    depth, each = len(zeros), -(-n // CHUNK)
    sizes = np.frombuffer(file, "<u4", depth * each, at).astype(np.int64)
    at += sizes.size * 4
    ranks = np.frombuffer(file, "<u4", depth * (each + 1), at).astype(np.int64).reshape(depth, each + 1)
    at += ranks.size * 4
    docs, lengths = json.loads(z.decompress(file[at : at + head["docs"]], max_output_size=1 << 31))
    ends = at + head["docs"] + np.cumsum(sizes)

    def chunk(k: int, c: int) -> np.ndarray:
        end = int(ends[k * each + c])
        return np.frombuffer(z.decompress(file[end - int(sizes[k * each + c]) : end], max_output_size=CHUNK_BYTES), np.uint8)

    return WaveletMatrix(n, zeros, ranks, chunk), docs, np.array(lengths, np.int64)


def _writer(path: str, shard_tokens: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = run_encoder(path, REMEMBER)
        end = np.array([END_ID], enc.dtype).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        raw: list[bytes] = []
        held = 0

        def shard() -> pa.RecordBatch:
            lengths = np.array([len(r) // enc.width for r in raw], np.int64)
            file = dump(np.frombuffer(b"".join(raw), enc.dtype), docs, lengths)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([int(lengths.sum())], pa.int64()), pa.array([file], pa.binary())], ["part", "seq", "n_tokens", "file"])

        for batch in batches:
            for rows in slices(batch, 1, SLICE):
                for doc, r in zip(rows.column(0).to_pylist(), enc.batch(rows.column(1)), strict=True):
                    docs.append(doc)
                    raw.append(r + end)
                    held += len(r) // enc.width + 1
                    if held >= shard_tokens:
                        yield shard()
                        docs, raw, held, seq = [], [], 0, seq + 1
        if docs:
            yield shard()

    return go


def write_shards(docs: DataFrame, path: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards to the shared folder: one row is one file, in the order of (part, seq).

    The files are the cells of a binary column, so that any store that Spark writes to can hold them.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return keep(ordered.mapInArrow(_writer(path, shard_tokens), "part int, seq int, n_tokens long, file binary"), "wavelet")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, file in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            m, docs, lengths = load(file.as_py())
            ids, ends = m.all().astype("<u4"), np.cumsum(lengths)
            begins = ends - lengths
            crc = [zlib.crc32(ids[a:b].data) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            k = len(docs)
            cols = [pa.array([part] * k, pa.int32()), pa.array([seq] * k, pa.int32()), pa.array(docs, pa.int64()), pa.array(begins, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])


def _starts(shards: DataFrame) -> DataFrame:
    """part, seq, from: ids before each shard. One task orders one row per partition that wrote; the rest is by part."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("sum"))
    before = parts.select("part", F.coalesce(F.sum("sum").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.coalesce(F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return shards.select("part", "seq", "n_tokens", inner.alias("inner")).join(before, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("from"), "n_tokens")


def read_digest(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the shard files."""
    rows = shards.select("part", "seq", "file").mapInArrow(_read, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    starts = _starts(shards).select("part", "seq", "from")
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("from") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def count_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: how often each of the given tokens stands in all shards. Two chunks per plane and token are unpacked."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                m, _, _ = load(file.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int32()), pa.array([m.count(t) for t in tokens], pa.int64())], ["token", "n"])

    return shards.select("file").mapInArrow(go, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """token, doc_id, at: every occurrence of the given tokens, and its place within its document."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                m, docs, lengths = load(file.as_py())
                ends = np.cumsum(lengths)
                for t in tokens:
                    at = m.places(t)
                    doc = np.searchsorted(ends, at, "right")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t), pa.int32()), pa.array(docs, pa.int64()).take(pa.array(doc)), pa.array(at - (ends - lengths)[doc], pa.int64())], ["token", "doc_id", "at"])

    return shards.select("file").mapInArrow(go, "token int, doc_id long, at long")


def tokens_at(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """start, token: the token at each wanted place (column start) of the whole sequence; places outside give no row."""
    spans = _starts(shards).where("n_tokens > 0").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("from") / SHARD_TOKENS), F.floor((F.col("from") + F.col("n_tokens") - 1) / SHARD_TOKENS))))
    asked = wanted.select(F.col("start").cast("long").alias("start")).distinct().withColumn("bucket", F.floor(F.col("start") / SHARD_TOKENS))
    inside = (F.col("start") >= F.col("from")) & (F.col("start") < F.col("from") + F.col("n_tokens"))
    placed = asked.join(spans, "bucket").where(inside).select(F.col("part").alias("p"), F.col("seq").alias("s"), "start", (F.col("start") - F.col("from")).alias("at"))

    def go(places: pa.Table, files: pa.Table) -> pa.Table:
        found = []
        if places.num_rows and files.num_rows:
            m, _, _ = load(files.column("file")[0].as_py())
            found = [m.access(i) for i in places.column("at").to_pylist()]
        return pa.table({"start": places.column("start").slice(0, len(found)), "token": pa.array(found, pa.int32())})

    return placed.groupBy("p", "s").cogroup(shards.select("part", "seq", "file").groupBy("part", "seq")).applyInArrow(go, "start long, token int")
