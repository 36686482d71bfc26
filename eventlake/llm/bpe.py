"""BPE encoding and decoding of whole texts, long ones by tree concatenation.

A text of up to LEAF characters is encoded in one piece. A longer one is halved until its parts are that short; the parts
are rows of their own, encoded in parallel, and joined pairwise as a tree. Where two halves meet, a window of tokens on
both sides is encoded anew and grows until its outer tokens agree with both halves, or until it has reached white space
on a side (no token spans white space) or the end of a half. Then the left half's tokens up to the window, the window's
and the right half's from there on are the encoding of the whole: between tokens that agree, neither side can change. An
added token such as an end mark is matched as a string before anything is split, so a window always holds as many
characters on both sides as the longest one has: one that a cut went through lies in it whole.

Null counts as empty, and has no ids and decodes to the empty text. Repeated rows and doc_ids each keep their row; equal
long texts are encoded once, and so are equal texts that lie near each other. An empty table gives an empty result. Other
columns pass through untouched where `carry` names them, whatever their names are, but for those of the results.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from eventlake.llm.tokens import PieceEncoder, encoder, slices, strings, tokenizer
from eventlake.plans.stage import keep

#: Characters up to which a text is encoded in one piece.
LEAF = 32768
#: Tokens of each side in the first window.
WINDOW = 4


class Part:
    """A text without white space, its ids, and where its tokens begin and end."""

    __slots__ = ("text", "ids", "begins", "ends")

    def __init__(self, text: str, ids: list[int], begins: list[int], ends: list[int]):
        self.text, self.ids, self.begins, self.ends = text, ids, begins, ends


def encode_part(tok: Tokenizer, text: str) -> Part:
    e = tok.encode(text, add_special_tokens=False)
    return Part(text, e.ids, [a for a, _ in e.offsets], [b for _, b in e.offsets])


@cache
def reach(tok: Tokenizer) -> int:
    """Characters of the longest added token."""
    return max((len(t.content) for t in tok.get_added_tokens_decoder().values()), default=0)


def _cut_before(p: Part, i: int) -> bool:
    """Whether token i begins where a character begins that doesn't combine with the one before."""
    return i == 0 or (p.begins[i] >= p.ends[i - 1] and not unicodedata.combining(p.text[p.begins[i]]))


def join(tok: Tokenizer, left: Part, right: Part, window: int = WINDOW) -> Part:
    """The encoding of the two texts together."""
    if not left.ids or not right.ids:
        return encode_part(tok, left.text + right.text)
    shift, text, far = len(left.text), left.text + right.text, reach(tok)
    w = window
    while True:
        i = max(0, len(left.ids) - w)
        while i and (left.begins[i] > shift - far or not _cut_before(left, i)):
            i -= 1
        j = min(len(right.ids), w)
        while j < len(right.ids) and (right.begins[j] < far or not _cut_before(right, j)):
            j += 1
        a = left.begins[i]
        b = shift + (right.begins[j] if j < len(right.ids) else len(right.text))
        if i == 0:
            a = 0
        mid = encode_part(tok, text[a:b])
        mine = list(zip(mid.ids, (x + a for x in mid.begins), (x + a for x in mid.ends), strict=True))
        # the first token must be the left half's own, unless the window begins with the text
        left_ok = i == 0 or (bool(mine) and mine[0] == (left.ids[i], left.begins[i], left.ends[i]))
        k = len(mine)
        right_ok = j == len(right.ids)
        if not right_ok:
            theirs = {(right.ids[x], right.begins[x] + shift, right.ends[x] + shift): x for x in range(j)}
            # one shared token that isn't the window's last, as that one ends where the window does
            for k in range(len(mine) - 2, 0, -1):
                if mine[k][1] < shift:
                    break
                x = theirs.get(mine[k])
                if x is not None and mine[k][1] >= mine[k - 1][2]:
                    right_ok, j = True, x
                    break
        if left_ok and right_ok:
            head, tail = slice(0, i), slice(j, None)
            mine = mine[:k]
            return Part(
                text,
                left.ids[head] + [m[0] for m in mine] + right.ids[tail],
                left.begins[head] + [m[1] for m in mine] + [x + shift for x in right.begins[tail]],
                left.ends[head] + [m[2] for m in mine] + [x + shift for x in right.ends[tail]],
            )
        w *= 2


def join_all(tok: Tokenizer, parts: list[Part]) -> Part:
    """Joins neighbours, then neighbours of the results, up to the whole."""
    while len(parts) > 1:
        parts = [join(tok, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def tokens_by_id(tok: Tokenizer) -> list[str]:
    return [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size())]


def decode(names: list[str], ids: list[int]) -> str:
    """What the tokenizer's decode gives for a tokenizer without a decoder step: its tokens with spaces between."""
    return " ".join([names[i] for i in ids])


def _digest(names: list[str], numbers: list[str], ids: np.ndarray) -> tuple[int, str, str]:
    listed = ids.tolist()
    text = " ".join([numbers[i] for i in listed])
    return len(listed), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(decode(names, listed).encode("utf-8", "surrogatepass")).hexdigest()


#: The result columns, with a digest and without.
OUT = {
    True: [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())],
    False: [StructField("ids", ArrayType(IntegerType()))],
}


def _columns(rows: list[tuple], digest: bool) -> list[pa.Array]:
    types = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32())]
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ((),) * len(types), types, strict=True)]


def _result(names: list[str], numbers: list[str], ids: np.ndarray, digest: bool) -> tuple:
    return _digest(names, numbers, ids) if digest else (ids.astype(np.int32),)


def _short(path: str, digest: bool):
    """carried columns, text -> the carried columns and the result; equal texts of a slice are encoded once."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        names = tokens_by_id(enc.tok)
        numbers = [str(i) for i in range(len(names))]
        for batch in batches:
            for part in slices(batch, 1):
                coded = part.column(1).dictionary_encode()
                found = [_result(names, numbers, np.frombuffer(r, enc.dtype), digest) for r in enc.batch(strings(coded.dictionary))]
                columns = [c.take(coded.indices) for c in _columns(found, digest)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["carry", *(f.name for f in OUT[digest])])

    return go


def _leaves(path: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """key, at, leaf -> key, at, the runs without white space at both ends, and the ids of what lies between."""
        enc = encoder(path)
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                first, space, rest = _head(text)
                if not space:
                    out.append((first, None, None))
                    continue
                middle, last = _tail(rest)
                out.append((first, enc.batch([middle])[0], last))
            head, mid, tail = zip(*out, strict=True) if out else ((),) * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(head, pa.string()), pa.array(mid, pa.binary()), pa.array(tail, pa.string()), _ids(enc, head), _ids(enc, tail)], ["key", "at", "head", "mid", "tail", "head_ids", "tail_ids"])

    return go


def _head(text: str) -> tuple[str, str, str]:
    """What stands before the first space, the space, what follows."""
    return text.partition(" ")


def _tail(text: str) -> tuple[str, str]:
    before, _, last = text.rpartition(" ")
    return before, last


def _ids(enc: PieceEncoder, runs: tuple[str | None, ...]) -> pa.Array:
    """(id, begin, end) of each run's tokens, one after the other."""
    flat = []
    for run in runs:
        p = encode_part(enc.tok, run) if run else None
        flat.append(np.array([p.ids, p.begins, p.ends], np.int32).tobytes() if p else None)
    return pa.array(flat, pa.binary())


def _assemble(path: str, digest: bool):
    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        """All leaves of one text: runs that a cut went through are joined as a tree; the rest stays as it is."""
        tok = tokenizer(path)
        dtype = "<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4"
        names = tokens_by_id(tok)

        def part(run: str, raw: bytes | None) -> Part:
            ids, begins, ends = np.frombuffer(raw or b"", np.int32).reshape(3, -1).tolist()
            return Part(run, ids, begins, ends)

        done: list[np.ndarray] = []
        open_: list[Part] = []

        def close() -> None:
            if open_:
                done.append(np.array(join_all(tok, open_).ids, np.int64))
                open_.clear()

        for r in pdf.sort_values("at").itertuples():
            if r.head:
                open_.append(part(r.head, r.head_ids))
            if r.mid is not None:
                close()
                done.append(np.frombuffer(r.mid, dtype).astype(np.int64))
                if r.tail:
                    open_.append(part(r.tail, r.tail_ids))
        close()
        ids = np.concatenate(done) if done else np.zeros(0, np.int64)
        row = _result(names, [str(i) for i in range(len(names))], ids, digest)
        return pd.DataFrame([[pdf["key"].iloc[0], *row]], columns=["key", *(f.name for f in OUT[digest])])

    return go


def encode(docs: DataFrame, path: str, digest: bool = False, carry: tuple[str, ...] = ("doc_id",), leaf: int = LEAF) -> DataFrame:
    """The carried columns with ids; with `digest`, the ids' number and hash and the decoded text's hash instead."""
    out = [f.name for f in OUT[digest]]
    if clash := set(out) & set(carry):
        raise ValueError(f"carried columns are named like results: {sorted(clash)}")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*carry).alias("carry"), text.alias("text"))
    long_ = F.length("text") > leaf
    schema = StructType([rows.schema["carry"], *OUT[digest]])
    short = rows.where(~long_).mapInArrow(_short(path, digest), schema)
    longs = rows.where(long_).withColumn("key", F.md5("text"))
    one = longs.select("key", "text").dropDuplicates(["key"])
    # halved until short enough: a power of two of equal parts
    parts = F.pow(2.0, F.ceil(F.log2(F.length("text") / F.lit(leaf)))).cast("int")
    size = F.ceil(F.length("text") / parts).cast("int")
    cut = one.withColumn("size", size).withColumn("at", F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / F.col("size")).cast("int") - 1)))
    # long texts are few and heavy, so the number of partitions is set rather than left to their bytes
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = cut.select("key", "at", F.expr("substring(text, at * size + 1, size)").alias("leaf")).repartition(n, "key", "at")
    done = leaves.mapInArrow(_leaves(path), "key string, at int, head string, mid binary, tail string, head_ids binary, tail_ids binary")
    whole = done.repartition(n, "key").groupBy("key").applyInPandas(_assemble(path, digest), StructType([StructField("key", StringType()), *OUT[digest]]))
    both = short.union(longs.select("carry", "key").join(keep(whole, "long-texts"), "key").select("carry", *out))
    return both.select("carry.*", *out)


def decode_texts(encoded: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with the text that the ids decode to; null ids decode to the empty text."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = tokens_by_id(tokenizer(path))
        for batch in batches:
            texts = pa.array([decode(names, ids or []) for ids in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["carry", "decoded"])

    rows = encoded.select(F.struct(*carry).alias("carry"), "ids")
    return rows.mapInArrow(go, StructType([rows.schema["carry"], StructField("decoded", StringType())])).select("carry.*", "decoded")
