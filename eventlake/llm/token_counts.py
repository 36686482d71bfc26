"""Token counts by offset-mapped attribution.

Each document is encoded once, as a whole. Its tokens have character spans, and so do its sections; a token counts for
the section that it overlaps, found by an interval join of the two sorted lists of spans. A token that crosses a boundary
goes whole to the section with the largest overlap in characters; among equals to the earliest. So the counts of a
document's sections sum to the number of its tokens.

By default sections are lines, each with the line feed that ends it. Null and empty texts have one empty section without
tokens. Repeated rows are each counted; a null doc_id is passed on. An empty table gives an empty result. Texts of any
length are encoded whole; a task holds the tokens of about SLICE characters, or of one text, at a time. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.tokens import slices, strings, tokenizer

SLICE = 200_000
SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def line_ends(text: str) -> np.ndarray:
    """Ends of the lines of a text, each with its line feed; a text without any has one end."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array(ends)


def attribute(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of token spans with the sections that end at cuts: (section of each token, whether it crosses)."""
    first = np.minimum(np.searchsorted(cuts, starts, "right"), len(cuts) - 1)
    last = np.minimum(np.searchsorted(cuts, np.maximum(ends - 1, starts), "right"), len(cuts) - 1)
    crossing, section = last > first, first.copy()
    for i in np.flatnonzero(crossing):
        bounds = np.concatenate([[starts[i]], cuts[first[i] : last[i]], [ends[i]]])
        section[i] = first[i] + int(np.argmax(np.diff(bounds)))
    return section, crossing


@cache
def byte_lengths(path: str) -> np.ndarray | None:
    """Bytes of text that each id stands for, where a tokenizer cuts the text's bytes and nothing else; else None."""
    tok = tokenizer(path)
    if tok.normalizer is not None or type(tok.pre_tokenizer).__name__ != "ByteLevel" or tok.pre_tokenizer.add_prefix_space:
        return None
    added = tok.get_added_tokens_decoder()
    return np.array([len(added[i].content.encode()) if i in added else len(tok.id_to_token(i) or "") for i in range(tok.get_vocab_size())])


def token_spans(path: str, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First and last character (exclusive) of each token of each text, encoded as a whole.

    For a tokenizer of bytes they follow from the ids: the bytes add up, and a character begins at each byte that doesn't
    continue one. That is quicker than the library's offsets, which it builds as pairs of Python numbers.
    """
    tok, sizes = tokenizer(path), byte_lengths(path)
    coded = tok.encode_batch(texts, add_special_tokens=False) if sizes is None else tok.encode_batch_fast(texts, add_special_tokens=False)
    for text, e in zip(texts, coded, strict=True):
        if sizes is None:
            spans = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(e)).reshape(-1, 2)
            yield spans[:, 0], spans[:, 1]
            continue
        n = sizes[np.array(e.ids, np.int64)] if len(e) else np.zeros(0, np.int64)
        ends, data = np.cumsum(n), text.encode()
        starts = ends - n
        if len(data) != len(text):
            char = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1
            starts, ends = char[starts], char[ends - 1] + 1
        yield starts, ends


def _counter(path: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                found = []
                texts = strings(part.column(1))
                for text, (starts, ends) in zip(texts, token_spans(path, texts), strict=True):
                    cuts = line_ends(text)
                    section, crossing = attribute(starts, ends, cuts)
                    k = len(cuts)
                    found.append((np.arange(k), np.concatenate([[0], cuts[:-1]]), cuts, np.bincount(section, minlength=k), np.bincount(section[crossing], minlength=k)))
                n, columns = np.array([len(f[0]) for f in found]), [np.concatenate(c) for c in zip(*found, strict=True)]
                doc = part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))
                yield pa.RecordBatch.from_arrays([doc, pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return go


def section_tokens(docs: DataFrame, path: str) -> DataFrame:
    """One row for each section of each document: its span, its tokens, and how many of these cross a boundary."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_counter(path), SCHEMA)
