"""Encoding whole texts with the tokenizers library, at the speed of the distinct pieces in them.

A byte-pair encoder that first splits text never merges across the boundary between a non-space and a space, so a text's
ids are those of its space-delimited pieces, one after the other. Each worker keeps the ids of pieces it has seen; new ones
are encoded together in one call, and told apart by what stands between them: a special token that the tokenizer itself
cuts at or, for tokenizers that keep white space, line breaks and the spaces that their tokens begin with.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Collection, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Bytes of pieces and their ids that a worker remembers; beyond it, only those of the texts at hand stay.
REMEMBER = 64 << 20
#: What Python adds to the bytes of a remembered piece and its ids.
ENTRY = 160
#: Pieces that are joined into one text for the tokenizer, which is quicker on short texts.
TOGETHER = 200
#: The same for pieces of runs.
WORDS = 50
#: Marks that the tokenizers cut off behind a letter, whatever follows.
MARKS = frozenset(",.;:!?")


@cache
def tokenizer(path: str) -> Tokenizer:
    """Loaded once in each Python worker, and kept to the one core that its task has."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class PieceEncoder:
    """ids of texts as little-endian unsigned 16-bit (or, for large vocabularies, 32-bit) bytes, for tokenizers that drop
    white space, so that every piece stands alone."""

    def __init__(self, path: str, remember: int = REMEMBER, cut: str = "<|endoftext|>"):
        self.tok, self.remember, self.cut = tokenizer(path), remember, cut
        self.dtype = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = np.dtype(self.dtype).itemsize
        self.cut_id = self.tok.token_to_id(cut)
        self.marks = {m: self.ids(m).tobytes() for m in MARKS}
        self.seen: dict[str, bytes] = {}
        self.held = 0

    def ids(self, text: str) -> np.ndarray:
        """The ids of one text. Nothing here needs offsets, and the library is quicker without them."""
        return self._ids([text])

    def _ids(self, texts: list[str]) -> np.ndarray:
        """The ids of these texts, one after the other."""
        return np.concatenate([np.zeros(0, self.dtype), *(np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False))])

    def _cut(self, ids: np.ndarray, at: np.ndarray, skip: int) -> list[bytes]:
        """Slices before, between and after the places, less so many ids at the start of all but the first."""
        raw, ends = ids.tobytes(), [*(at * self.width).tolist(), ids.nbytes]
        return [raw[a:b] for a, b in zip([0, *(x + skip * self.width for x in ends[:-1])], ends, strict=True)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Each text by itself, in one call where none holds the cutting token."""
        plain = [t for t in texts if self.cut not in t and t]
        ids = self._ids([self.cut.join(plain[i : i + TOGETHER]) + self.cut for i in range(0, len(plain), TOGETHER)])
        done = dict(zip(plain, self._cut(ids[:-1], np.flatnonzero(ids[:-1] == self.cut_id), 1), strict=True)) if plain else {}
        return [done[t] if t in done else self.ids(t).tobytes() for t in texts]

    def learn(self, pieces: list[str]) -> None:
        """A piece that ends in a small letter and a mark is its stem and the mark, so that only stems are encoded."""
        tails = {p for p in pieces if p[-1:] in MARKS and p[-2:-1].islower() and p[-2] <= "\u024f"}
        stems = {p[:-1] for p in tails if p[:-1] not in self.seen}
        stems.update(p for p in pieces if p not in tails)
        self.seen.update(zip(stems, self._encode(list(stems)), strict=True))
        self.seen.update((p, self.seen[p[:-1]] + self.marks[p[-1]]) for p in tails)

    def learn_all(self, new: set[str]) -> None:
        """Remember these pieces; where they don't fit beside the others, the others are forgotten."""
        missing = [p for p in new if p not in self.seen]
        if self.held + _size(missing) > self.remember:
            self.seen = {p: self.seen[p] for p in new if p in self.seen}
            self.held = _size(self.seen)
        self.learn(missing)
        self.held += _size(missing)

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. The batch should be small enough that its pieces fit in memory beside the remembered ones.

        Pieces are numbered by Arrow, so that Python handles each distinct one once; ids are then gathered by number.
        """
        column = pa.array(texts, pa.large_string())
        cut = pc.split_pattern(pc.replace_substring(column, "\n", " "), " ")
        begins = np.asarray(cut.offsets)[:-1]
        coded = cut.flatten().dictionary_encode()
        at, distinct = coded.indices.to_numpy().astype(np.int64), strings(coded.dictionary)
        self.learn_all(set(distinct))
        ids = [self.seen[p] for p in distinct]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        flat = np.frombuffer(b"".join(ids), self.dtype)
        n = size[at]
        ends = np.cumsum(n)
        raw = flat[np.repeat(np.cumsum(size)[at] - ends, n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        to = (ends[np.append(begins[1:], len(at)) - 1] * self.width).tolist() if len(begins) else []
        return [raw[a:b] for a, b in zip([0, *to[:-1]], to, strict=True)] if to else []


class RunEncoder:
    """ids of texts for byte-level tokenizers, which keep white space and first split text by GPT-2's expression.

    That expression never matches across these places, whatever stands around them, so a text's ids are those of its
    pieces between them: where white space follows something else; before a space that something else follows; behind a
    line break that stands alone between other characters; where a letter is followed by a digit or mark. Places are
    found on UTF-8 bytes. A character that may be white space or no letter gives no place, so pieces only become longer.
    An added token is matched before that split: it is a piece, and what lies between two of them is split by itself.
    """

    _SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    #: Bits of a byte: white space; a space; end, then begin, of another character than white space; end of a letter;
    #: a digit or mark; a line break or tab.
    _WHITE, _SPACE, _END, _BEGIN, _LETTER, _MARK, _BREAK = 1, 2, 4, 8, 16, 32, 64

    def __init__(self, path: str, remember: int = REMEMBER):
        self.tok, self.remember = tokenizer(path), remember
        made = json.loads(self.tok.to_str())
        added = self.tok.get_added_tokens_decoder().values()
        if made["normalizer"] or {k: (made["pre_tokenizer"] or {}).get(k) for k in self._SPLIT} != self._SPLIT or any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("not a plain byte-level tokenizer")
        self.added = re.compile(b"|".join(re.escape(t.content.encode()) for t in sorted(added, key=lambda t: -len(t.content))) or b"(?!)")
        self.dtype = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = np.dtype(self.dtype).itemsize
        self.line = self.tok.token_to_id("\u010a")
        self.begins = np.array([(self.tok.id_to_token(i) or "").startswith("\u0120") for i in range(self.tok.get_vocab_size())])
        self.seen: dict[str, bytes] = {}
        self.held = 0
        self.bits = np.zeros(256, np.uint8)
        for b in range(256):
            c = chr(b)
            if c in " \t\n\v\f\r":
                self.bits[b] = self._WHITE | (self._SPACE if c == " " else self._BREAK)
            elif b < 0x80 and not c.isspace():
                self.bits[b] = self._END | self._BEGIN | (self._LETTER if c.isalpha() else self._MARK)
            elif 0xC3 <= b <= 0xE0 or 0xE4 <= b:  # other leads also begin some kind of white space
                self.bits[b] = self._BEGIN

    def _places(self, data: np.ndarray, texts: np.ndarray, tokens: list[tuple[int, int]]) -> np.ndarray:
        """Where pieces begin, in rising order, given where texts begin and where added tokens lie."""
        bounds = np.append(texts, np.array(tokens, np.int64))
        f = self.bits[data]
        high = np.flatnonzero(data >= 0x80)
        lead = data[high - 1] if len(high) else data[:0]
        # ends of characters of two bytes, none of them white space from U+00C0 on, and up to U+024F letters but for two signs
        two = (lead >= 0xC3) & (lead <= 0xDF)
        letter = two & ((lead < 0xC9) | (lead == 0xC9) & (data[high] < 0x90)) & ~((lead == 0xC3) & ((data[high] == 0x97) | (data[high] == 0xB7)))
        f[high] |= two * np.uint8(self._END) | letter * np.uint8(self._LETTER)
        cut = np.zeros(len(data) + 1, bool)
        a, b = f[:-1], f[1:]
        cut[:-2] = (a << 2) & b & self._BEGIN
        cut[bounds[bounds > 0] - 1] = False  # what follows this space is no part of its text
        cut[1:-1] |= ((a >> 2) & b & self._WHITE | (a << 1) & b & self._MARK).astype(bool)
        cut[2:-1] |= ((f[:-2] << 4) & f[1:-1] & (f[2:] << 3) & self._BREAK).astype(bool)
        for begin, end in tokens:
            cut[begin:end] = False
        cut[bounds] = True
        return np.flatnonzero(cut[:-1])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Words are encoded many in a text: with a space before them as they are, as a token begins with a space exactly
        where a word does; others parted by line breaks, which are tokens of their own beside words."""
        spaced, words, rest = [], [], []
        for p in pieces:
            w = p.split()
            before = len(p) - len(w[0]) if len(w) == 1 else 2
            (words if before == 0 else spaced if before == 1 and p[0] == " " else rest).append(p)
        for many, gap in ((spaced, ""), (words, "\n")):
            ids = np.concatenate([np.zeros(0, self.dtype), *self._ids([gap.join(many[i : i + WORDS]) + gap for i in range(0, len(many), WORDS)])])
            ends = np.flatnonzero(ids == self.line) + 1 if gap else np.append(np.flatnonzero(self.begins[ids]), len(ids))[1:]
            if len(ends) != len(many):
                rest += many
                continue
            raw, to, drop = ids.tobytes(), (ends * self.width).tolist(), len(gap) * self.width
            self.seen.update(zip(many, [raw[a : b - drop] for a, b in zip([0, *to], to, strict=False)], strict=True))
        self.seen.update(zip(rest, [ids.tobytes() for ids in self._ids(rest)], strict=True))

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces; where new ones don't fit beside the others, only these stay remembered."""
        found = list(map(self.seen.get, pieces))
        missing = [p for p, ids in zip(pieces, found, strict=True) if ids is None]
        if self.held + _size(missing) > self.remember:
            self.seen = {p: ids for p, ids in zip(pieces, found, strict=True) if ids is not None}
            self.held = _size(self.seen)
        self._learn(missing)
        self.held += _size(missing)
        return [self.seen[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]

    def batch(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 16-bit (or, for large vocabularies, 32-bit) bytes.

        Arrow numbers the pieces, so that Python handles each distinct one once, and puts their ids together by number.
        """
        column = pc.fill_null(texts, "").cast(pa.large_string())
        at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        if at[0] == at[-1]:
            return [b""] * len(column)
        buffer = column.buffers()[2].slice(int(at[0]), int(at[-1] - at[0]))
        data, at = np.frombuffer(buffer, np.uint8), at - at[0]
        tokens = [m.span() for a, b in zip(at.tolist(), at[1:].tolist()) for m in self.added.finditer(buffer, a, b)]
        places = self._places(data, at, tokens)
        cut = pa.Array.from_buffers(pa.large_string(), len(places), [None, pa.py_buffer(np.append(places, len(data))), buffer])
        coded = cut.dictionary_encode()
        ids = pa.array(self._known(strings(coded.dictionary)), pa.large_binary()).take(coded.indices)
        raw = ids.buffers()[2].to_pybytes() if ids.buffers()[2] else b""
        to = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[np.searchsorted(places, at)].tolist()
        return [raw[a:b] for a, b in zip(to, to[1:])]


def _size(pieces: Collection[str]) -> int:
    """About the bytes that these take with their ids, of which there are as many bytes at most in practice."""
    return ENTRY * len(pieces) + 2 * sum(map(len, pieces))


@cache
def run_encoder(path: str, remember: int = REMEMBER) -> RunEncoder:
    """One in each Python worker, as with `encoder`."""
    return RunEncoder(path, remember)


def strings(column: pa.Array) -> list[str]:
    """The values of a column without nulls, much quicker than by to_pylist."""
    return column.to_numpy(zero_copy_only=False).tolist()


@cache
def encoder(path: str, remember: int = REMEMBER) -> PieceEncoder:
    """One in each Python worker, whose later tasks find the pieces that earlier ones learnt."""
    return PieceEncoder(path, remember)


def slices(batch: pa.RecordBatch, text: int, chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch, in order, whose texts hold at most so many characters together, or one row.

    Python strings and results exist for one part at a time, so a task's memory doesn't grow with the batch.
    """
    sizes = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + chars, "right")))
        yield batch.slice(begin, end - begin)
        begin = end
