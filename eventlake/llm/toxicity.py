"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around what they catch.

The lexicon is learned: words and word beginnings that labelled toxic documents hold far more often than clean ones. It
is a trie; the automaton for up to one edit runs over trie and word at the same time and is built lazily, so a word costs
one look-up per character and most die after two or three. Only entries of FUZZY_FROM characters or more allow an
edit. Edited matches have a weight for each entry, and those of the first character one more, since chance neighbours are
among them. So that edits have a weight where no labelled text is misspelled, each text is also learned from with its
caught words misspelled, at a place that a hash of the text picks: half of the texts at the first character. Each caught
word is weighed by its context: WINDOW words on either side tell quotation (quotation marks, words of reporting) from abuse
(words of address). A logistic scorer over these counts turns them into a score from 0 to 1; its Newton steps add up
gradient and curvature in tasks, and the fit depends on the labelled texts alone, however they are dealt.

Lexicon and scorer are fitted on about SAMPLE labelled documents outside the held-out fold, twice as many at most; every
term of theirs that tells toxic from clean well enough is an entry. A term counts once for toxic documents of one sketch,
so that copies of a document don't make its chance words entries. Only texts enter a score. Null and empty texts have no
words, and get the score of a document in which nothing is caught; texts of any length are read whole. Repeated rows are
each scored; labels that repeat or contradict each other count each; null labels are left out. Without labels every score
is that of a prior of PRIOR. An empty table gives an empty result; columns but doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.llm import shingles as S
from eventlake.llm.tokens import slices
from eventlake.llm.vectors import matrix
from eventlake.plans.stage import keep

#: Labelled documents that lexicon and scorer are fitted on: a bound on the fit, not on what is scored.
SAMPLE = 20_000
#: An entry stands in so many different toxic documents at least, in so many times the share of clean ones, with such a z.
SEEN, TIMES, Z = 5, 6.0, 5.0
FUZZY_FROM = 5
WINDOW = 5
PRIOR = 0.1
REMEMBER = 300_000
#: The fit's rows are at most twice as many as feature rows of the sample; so many tasks share them, and take so many at a time.
TASKS, ROWS = 16, 1024
PREFIXES = range(4, 9)

#: Words that report another's speech, and words that address a person, in the languages of the corpus.
REPORTING = frozenset("said says say wrote called quote quoted quotes word term sagte schrieb nannte zitat wort dijo escribió llamó cita palabra dit écrit appelé citation mot".split())
ADDRESS = frozenset("you your you're youre u ur du dich dir dein ihr euch tú tu te ti usted ustedes vosotros toi vous votre".split())
QUOTES = "\"“”„«»‹›‘’`"
_STRIP = "\"“”„«»‹›‘’`'.,;:!?()[]{}<>|%*$#&@~^=+-_/\\"


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    #: Entry that ends here: as a whole word, as a beginning.
    word: int = -1
    begins: int = -1


class Automaton:
    """Entries ("idiot" a word, "lowei*" a beginning) and a lazily built automaton for up to one edit.

    The first character must match, unless `first` allows the edit there too, and a beginning's last one to be missing.
    """

    def __init__(self, entries: list[str], first: bool = False):
        self.entries, self.root, self.first = entries, Node(), first
        self.fuzzy = [len(e.rstrip("*")) >= FUZZY_FROM for e in entries]
        for i, e in enumerate(entries):
            node = self.root
            for c in e.rstrip("*"):
                node = node.next.setdefault(c, Node())
            if e.endswith("*"):
                node.begins = i
            else:
                node.word = i
        #: States are sets of (trie node, edits used); every step from them is kept.
        self.states: list[dict[int, tuple[Node, int]]] = []
        self.known: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.hit: list[tuple[int, int]] = []
        self.end: list[tuple[int, int]] = []
        self.start = self._state([(self.root, 0)])

    def _state(self, pairs: list[tuple[Node, int]]) -> int:
        best: dict[int, tuple[Node, int]] = {}
        for node, e in pairs:
            if e <= 1 and (id(node) not in best or best[id(node)][1] > e):
                best[id(node)] = (node, e)
        key = frozenset((i, e) for i, (_, e) in best.items())
        if key not in self.known:
            self.known[key] = len(self.states)
            self.states.append(best)
            self.steps.append({})

            def found(kind: str) -> tuple[int, int]:
                got = [(e, getattr(n, kind)) for n, e in best.values() if getattr(n, kind) >= 0 and (e == 0 or self.fuzzy[getattr(n, kind)])]
                return min(got) if got else (2, -1)

            self.hit.append(found("begins"))
            # a last character of the entry may be missing at the end of the word
            closing = found("word")
            missing = [(1, m.word) for n, e in best.values() if e == 0 and n is not self.root for m in n.next.values() if m.word >= 0 and self.fuzzy[m.word]]
            if self.first:
                missing += [(1, m.begins) for n, e in best.values() if e == 0 and n is not self.root for m in n.next.values() if m.begins >= 0 and self.fuzzy[m.begins]]
            self.end.append(min([closing, *missing]))
        return self.known[key]

    def _step(self, state: int, c: str) -> int:
        out: list[tuple[Node, int]] = []
        for node, e in self.states[state].values():
            if c in node.next:
                out.append((node.next[c], e))
            if e == 0 and (self.first or node is not self.root):
                out.append((node, 1))  # one character too many
                for d, n in node.next.items():
                    if d != c:
                        out.append((n, 1))  # another character
                    if c in n.next:
                        out.append((n.next[c], 1))  # one left out
        new = self._state(out) if out else -1
        self.steps[state][c] = new
        return new

    def match(self, word: str) -> tuple[int, int]:
        """(edits, entry) of the best match; (2, -1) if there is none."""
        state, best = self.start, (2, -1)
        for c in word:
            nxt = self.steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                return best
            best = min(best, self.hit[state])
            if best[0] == 0:
                return best
        return min(best, self.end[state])


def plain(token: str) -> str:
    return token.strip(_STRIP)


def _terms(text: str) -> set[str]:
    out = set()
    for w in {plain(t) for t in text.lower().split()}:
        if len(w) >= 3:
            out.add(w)
            out.update(w[:k] + "*" for k in PREFIXES if len(w) >= k)
    return out


def _toxic_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> its terms, each with the document's sketch: the least hash of its shingles, which near copies share."""
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if terms := sorted(_terms(text or "")):
                sketch = int(S.shingle_set(text)[:1].view(np.int64)[0])
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([sketch] * len(terms), pa.int64())], ["term", "sketch"])


def _clean_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> how many documents of this task hold each term."""
    for batch in batches:
        held: Counter = Counter()
        for text in batch.column(0).to_pylist():
            held.update(_terms(text or ""))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"])


def telling(train: DataFrame, n_toxic: int, n_clean: int) -> list[tuple[str, int, float]]:
    """(term, toxic documents, z) of the terms that tell toxic documents from clean ones. Bounded by the sample's words."""
    toxic = train.where("toxic = 1").select("text").mapInArrow(_toxic_terms, "term string, sketch long").distinct().groupBy("term").agg(F.count("*").alias("x")).where(F.col("x") >= SEEN)
    clean = train.where("toxic = 0").select("text").mapInArrow(_clean_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("y"))
    x, y = F.col("x"), F.coalesce("y", F.lit(0))
    a, b = (x + 0.5) / (n_toxic + 1), (y + 0.5) / (n_clean + 1)
    z = (a - b) / F.sqrt((x + y + 1) / (n_toxic + n_clean + 2) * (1 / (n_toxic + 1) + 1 / (n_clean + 1)))
    rows = toxic.join(clean, "term", "left").select("term", "x", z.alias("z")).where((a >= TIMES * b) & (F.col("z") > Z))
    return [(r.term, r.x, r.z) for r in rows.collect()]


def choose(found: list[tuple[str, int, float]]) -> list[str]:
    """Terms by how much they tell, without those that say what a chosen one says already."""
    by = {t: x for t, x, _ in found}
    chosen: list[str] = []
    begins: set[str] = set()
    for term, x, _ in sorted(found, key=lambda s: (-s[2], s[0])):
        stem = term.rstrip("*")
        # a longer beginning, or the whole word, that nearly as many documents hold says it more exactly
        if term.endswith("*") and (by.get(stem, 0) >= 0.97 * x or any(v >= 0.97 * x for t, v in by.items() if t.endswith("*") and len(t) == len(term) + 1 and t.startswith(stem))):
            continue
        if any(stem[:k] in begins for k in range(1, len(stem) + 1)):
            continue
        chosen.append(term)
        if term.endswith("*"):
            begins.add(stem)
    return chosen


#: Counts per document besides those of single entries, exact and with an edit.
EXTRA = ("exact", "fuzzy", "first", "abuse", "quoted", "share")


def misspell(word: str, place: int) -> str:
    """The word with another, no, or one more character at the place."""
    at, kind = place % len(word), place // len(word) % 3
    return word[:at] + ("0", "", "0" + word[at])[kind] + word[at + 1 :]


class Catcher:
    """Features of a text. Each task builds its own from the entries."""

    def __init__(self, entries: list[str]):
        self.automaton, self.wide, self.seen = Automaton(entries), Automaton(entries, first=True), {}

    def caught(self, word: str) -> tuple[int, int]:
        """(0, entry) exact, (1, entry) with an edit behind the first character, (2, entry) with one of the first, or (2, -1)."""
        best = self.automaton.match(word)
        if best[1] < 0 and len(word) >= FUZZY_FROM - 1:
            best = (2, self.wide.match(word)[1])
        return best

    def misspelled(self, text: str | None) -> str:
        """The text with each exact match of an entry that allows edits misspelled, at the first character or one behind it."""
        out = []
        pick = zlib.crc32((text or "").encode("utf-8", "surrogatepass"))
        for w in (text or "").lower().split():
            edits, entry = self.automaton.match(plain(w))
            if entry >= 0 and edits == 0 and self.automaton.fuzzy[entry]:
                stem = self.automaton.entries[entry].rstrip("*")
                at, turn = w.index(stem), pick // 2
                place = 0 if pick % 2 else 1 + turn % (len(stem) - 1)
                w = w[:at] + misspell(stem, place + turn % 3 * len(stem)) + w[at + len(stem) :]
            out.append(w)
        return " ".join(out)

    def features(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        seen, match = self.seen, self.caught
        if len(seen) > REMEMBER:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = match(plain(w))
        n = 2 * len(self.automaton.entries)
        x = np.zeros(n + len(EXTRA))
        for i, w in enumerate(words):
            edits, entry = seen[w]
            if entry < 0:
                continue
            if edits:
                x[n // 2 + entry] += 1
            if edits == 2:
                x[n + 2] += 1
                continue
            window = words[max(0, i - WINDOW) : i + WINDOW + 1]
            quoted = any(c in QUOTES for c in (w[0], w[-1])) or any(plain(v) in REPORTING for v in window) or _inside_quotes(words, i)
            if edits == 0 and not quoted:
                x[entry] += 1
            x[n + (1 if edits else 0)] += 1
            x[n + 3] += not quoted and any(plain(v) in ADDRESS for v in window)
            x[n + 4] += quoted
        x[n + 5] = x[: n // 2].sum() / max(10, len(words)) * 50
        return np.log1p(x)


def _inside_quotes(words: list[str], i: int) -> bool:
    """An opening mark before and a closing one after, within the window."""
    before = any(w[0] in QUOTES for w in words[max(0, i - WINDOW) : i])
    return before and any(w[-1] in QUOTES or w.rstrip(".,;:!?")[-1:] in tuple(QUOTES) for w in words[i : i + WINDOW + 1])


@dataclass(frozen=True)
class Model:
    entries: list[str]
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def _sums(w: np.ndarray):
    """x, toxic, n -> one row per task: gradient and curvature of the log loss at w, summed over the rows."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = np.zeros(len(w)), np.zeros((len(w), len(w)))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                a = np.hstack([matrix(part.column(0)), np.ones((part.num_rows, 1))])
                y, n = (part.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
                p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
                g += a.T @ (n * (p - y))
                h += (a * (n * p * (1 - p))[:, None]).T @ a
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()]), pa.array([h.tobytes()])], ["g", "h"])

    return go


def fit_scorer(rows: DataFrame, size: int, ridge: float = 1e-3, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps over rows x (so many numbers), toxic, n; a row stands for n equal ones."""
    n, low, high = rows.agg(F.sum("n"), F.min("toxic"), F.max("toxic")).collect()[0]
    if not n or low == high:
        p = PRIOR if not n else float(np.clip(low, 0.01, 0.99))
        return np.zeros(size), float(np.log(p / (1 - p)))
    few = rows.select("x", F.col("toxic").cast("double"), F.col("n").cast("double")).coalesce(TASKS)
    w, pen = np.zeros(size + 1), np.full(size + 1, ridge * n)
    pen[-1] = 1e-6
    for _ in range(rounds):
        sums = few.mapInArrow(_sums(w), "g binary, h binary").collect()
        g = sum(np.frombuffer(r["g"]) for r in sums) + pen * w
        h = sum(np.frombuffer(r["h"]).reshape(len(w), -1) for r in sums) + np.diag(pen)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _features(entries: list[str]):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Catcher(entries)
        for batch in batches:
            for part in slices(batch, 0):
                texts, toxic = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = [c.features(t) for t in texts] + [c.features(c.misspelled(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(toxic + toxic, part.schema.field(1).type)], ["x", "toxic"])

    return go


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon and scorer from labelled documents outside the held-out fold."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int"))
    total = usable.count()
    share = int(min(1.0, sample / max(1, total)) * 1_000_000)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    some = usable.where(place < share).orderBy(place, "doc_id", "toxic").limit(2 * sample)
    # the sample's size is bounded by the parameter, so this side of the join is small whatever the tables are
    # of texts that share a doc_id the smallest stands for all, so that the sample stays as large as its labels are
    own = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    train = keep(own.join(F.broadcast(some), "doc_id").select("text", "toxic"), "toxic-sample")
    n = dict(train.groupBy("toxic").count().collect())
    entries = choose(telling(train, n.get(1, 0), n.get(0, 0)))
    # most clean documents have no feature at all: equal rows are one row with a count
    rows = keep(train.mapInArrow(_features(entries), "x array<double>, toxic int").groupBy("x", "toxic").agg(F.count("*").alias("n")), "toxic-features")
    return Model(entries, *fit_scorer(rows, 2 * len(entries) + len(EXTRA)))


def _scorer(model: Model):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Catcher(model.entries)
        for batch in batches:
            for part in slices(batch, 1):
                x = [c.features(t) for t in part.column(1).to_pylist()]
                scores = model.score(np.array(x).reshape(len(x), -1)) if len(model.weights) else np.full(len(x), 1 / (1 + np.exp(-model.bias)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return go


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
