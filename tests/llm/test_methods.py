"""The methods behind the operators against plain versions, and the stages of the pipeline against the same."""

import math
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from eventlake.llm import bpe, mixing, quality, toxicity
from tests.llm.test_llm import plain_components, plain_linked, shingles

WORD = public_tokenizers.path("word_bpe_49k.json")


def plain_em(patterns, counts, rounds=200):
    """Expectation-maximisation with loops; it starts from the patterns with a bad vote as bad ones."""
    post = [0.05 if "0" in p else 0.95 for p in patterns]
    for _ in range(rounds):
        good = min(0.99, max(0.01, (sum(n * q for n, q in zip(counts, post, strict=True)) + 1) / (sum(counts) + 2)))
        table = []
        for side in (post, [1 - q for q in post]):
            weight = sum(n * q for n, q in zip(counts, side, strict=True))
            table.append([{o: (sum(n * q for p, n, q in zip(patterns, counts, side, strict=True) if p[k] == o) + 0.2) / (weight + 0.6) for o in "-01"} for k in range(10)])
        for i, p in enumerate(patterns):
            a = good * math.prod(table[0][k][p[k]] for k in range(10))
            b = (1 - good) * math.prod(table[1][k][p[k]] for k in range(10))
            post[i] = a / (a + b)
    return post


def test_label_model_matches_plain_em():
    rnd = random.Random(31)
    patterns = sorted({"".join(rnd.choices("-01", (8, 1, 1), k=10)) for _ in range(60)})
    counts = [rnd.randint(1, 50) for _ in patterns]
    got = quality.fit_label_model(patterns, np.array(counts)).posterior
    assert all(abs(got[p] - w) < 1e-5 for p, w in zip(patterns, plain_em(patterns, counts), strict=True))


def test_quality_of_odd_rows(spark):
    rows = [(1, None, 1), (1, "", 2), (2, "   ", 3), (None, "one", 4), (None, "one", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, votes int")
    got = quality.classify(df).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id is None}) == 1
    assert quality.keep_good(df).columns == df.columns and quality.keep_good(df, 0.0).count() == 5


def plain_lambda(sizes, target):
    """The root of the dual's gradient by halving."""
    mean = sum(sizes) / len(sizes)
    lo, hi = -400.0, 400.0
    for _ in range(300):
        mid = (lo + hi) / 2
        got = sum(z * min(3.0, math.exp(min(5.0, mid * z / mean))) for z in sizes)
        lo, hi = (mid, hi) if got < target else (lo, mid)
    return lo, mean


def test_mix_matches_plain_dual(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 60)), rnd.choice(["a", "b", "b", "c", "d", "d", "d", None])) for i in range(600)] + [(7, "w w w", "a"), (None, "w", "a"), (600, None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes: dict = {}
    for _, t, s in rows:
        sizes.setdefault(s, []).append(len((t or "").split()))
    counts = mixing.sizes(df).groupBy("source", "size").agg(F.count("*").alias("n"))
    by = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = {r.source: r.target for r in mixing.targets(by).collect()}
    # targets: weights 1, 2, 3, ... in order of name, null last, filled up to 3 times the size
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full, want = sum(map(sum, sizes.values())), set(), {}
    while True:
        left = total - sum(3 * sum(sizes[s]) for s in full)
        share = left / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and share * weight[s] > 3 * sum(sizes[s])}
        if not more:
            break
        full |= more
    want = {s: 3 * sum(sizes[s]) if s in full else share * weight[s] for s in names}
    assert all(abs(goals[s] - want[s]) < 1e-6 for s in names)
    for r in mixing.solve(counts, mixing.targets(by)).collect():
        if r.lam is not None:
            lam, mean = plain_lambda(sizes[r.source], want[r.source])
            assert abs(r.lam - lam) < 1e-4 and abs(r.mean - mean) < 1e-9
    # few adjusting documents: each other one is taken as often as its tilted rate says, rounded down or up
    runs = [sorted((r.doc_id is None, r.doc_id, r.source or "", r.copies) for r in mixing.mix(df, adjust=1).collect()) for _ in range(2)]
    assert runs[0] == runs[1]
    off = 0
    lams = {s: plain_lambda(sizes[s], want[s]) for s in names if s not in full}
    text = {i: t for i, t, _ in rows[:600]}
    for null, i, s, c in runs[0]:
        s = s or None
        if null or i == 7 or i == 600 or s in full:
            continue
        z = len(text[i].split())
        rate = min(3.0, math.exp(lams[s][0] * z / lams[s][1])) if z else 0.0
        off += not math.floor(rate) <= c <= math.ceil(rate)
    assert off <= 12


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_matches_plain_edit_distance():
    entries = ["idiot", "lowei*", "scum", "moron", "trash*", "abcabc", "lower"]
    automaton = toxicity.Automaton(entries, first=True)

    def plain(word, entry):
        stem, begins = entry.rstrip("*"), entry.endswith("*")
        heads = [word[:k] for k in range(len(word) + 1)] if begins else [word]
        if stem in heads:
            return 0
        return 1 if len(stem) >= toxicity.FUZZY_FROM and any(lev(h, stem) <= 1 for h in heads) else 2

    rnd = random.Random(17)
    words = [toxicity.misspell(e.rstrip("*"), rnd.randint(0, 40)) + rnd.choice(["", "", "s", "x"]) for e in entries for _ in range(150)]
    words += ["".join(rnd.choices("abcdeilmorstuw", k=rnd.randint(0, 8))) for _ in range(500)]
    for w in words:
        each = [plain(w, e) for e in entries]
        edits, entry = automaton.match(w)
        assert edits == min(each) and (edits == 2 or each[entry] == edits), w


def test_context_tells_quotation_from_abuse():
    c = toxicity.Catcher(["idiot"])
    n = 2
    texts = {"you are an idiot": (1, 0), 'he said "idiot" loudly': (0, 1), "they wrote that one two three idiot": (0, 1), "idiot said one two": (0, 1), "they wrote one two three four five six idiot": (0, 0), "“an old idiot of mine” it was": (0, 1), "you one two three four five idiot": (0, 0), "": (0, 0)}
    for t, (abuse, quoted) in texts.items():
        x = c.features(t)
        assert (x[n + 3] > 0, x[n + 4] > 0) == (bool(abuse), bool(quoted)), t


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, "you idiot", 2), (None, "idiot " * 30_000, 3), (2, "", 4)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0


# --- the pipeline ----------------------------------------------------------------------------------------------------

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, body int, place int, secret_key string, mix_copies int, votes string, row int, key string"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    rnd = random.Random(44)
    vocabulary = ["".join(rnd.choices("abcdefghilmnorstu", k=2 + k % 8)) + ("." if k % 11 == 0 else "") for k in range(900)]
    prose = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    texts = [prose(60 + i % 90) for i in range(160)]
    texts += [texts[3], texts[3], texts[5] + " end", "BUY!! NOW!! " * 40, "on%%% in*** to$$$ " * 30, None, "", " ", prose(30) + " password=hunter22 " + prose(20), prose(40) + " login: alice123 https://db.example.com", prose(12_000)]
    rows = [(i, t, "en", rnd.choice(["a", "b", "b", "c", None]), len(t) if t else None, 1, 2, "k", 3, "v", 4, "x") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "a", 1, 9, 9, "k", 3, "v", 4, "x"), (5, prose(70), "en", "b", 1, 9, 9, None, None, None, None, None), (None, prose(50), None, None, None, None, None, None, None, None, None, None)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    return path, spark.read.parquet(f"{path}/documents.parquet")


def plain_masked(text):
    if text is None:
        return None
    out, past = "", 0
    for a, b in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in plain_linked(text).split(",") if x)):
        if b > past:
            out += text[past : max(a, past)] + "[secret]"
            past = b
    return out + text[past:]


def key(r):
    return tuple((v is None, str(v)) for v in r)


def test_stages_match_plain_versions(spark, table):
    path, docs = table
    rows = docs.collect()
    good = corpus_pipeline.classify_quality(spark, docs, path)
    assert good.columns == docs.columns
    verdict = {}
    for r in quality.classify(docs).collect():
        verdict.setdefault(r.doc_id, set()).add(r.keep)
    kept = good.collect()
    assert {r.doc_id for r in kept} == {i for i, v in verdict.items() if True in v}
    clean = [r for r in rows if r.text and len(r.text.split()) >= 30 and "!!" not in r.text and "%%%" not in r.text]
    assert len([r for r in kept if r in clean]) >= len(clean) - 1 and not any("%%%" in (r.text or "") for r in kept)

    one = corpus_pipeline.drop_near_copies(spark, docs, path)
    assert one.columns == docs.columns
    sets = {i: shingles(r.text) for i, r in enumerate(rows)}
    low, groups = plain_components(sets, 80), {}
    for i in sets:
        groups.setdefault(low[i], []).append(rows[i])
    want = []
    for members in groups.values():
        ids = [r.doc_id for r in members if r.doc_id is not None]
        plain = [r for r in members if r.doc_id is None or not shingles(r.text)]
        want += plain
        if len(plain) < len(members):
            want.append(min((r for r in members if r.doc_id == min(ids)), key=lambda r: tuple((v is None, v) for v in r[1:])))
    assert sorted(one.collect(), key=key) == sorted(want, key=key)

    masked = corpus_pipeline.mask_secrets(spark, docs, path)
    assert masked.columns == docs.columns
    plain = [r.asDict() | {"text": plain_masked(r.text), "n_chars": len(plain_masked(r.text)) if r.text is not None else None} for r in rows]
    assert sorted((key(r) for r in masked.collect())) == sorted(key(tuple(r.values())) for r in plain)

    mixed = corpus_pipeline.mix_sources(spark, docs, path)
    assert mixed.columns == docs.columns
    taken: dict = {}
    for r in mixing.mix(docs.where("doc_id is not null")).where("copies > 0").collect():
        taken[r.doc_id] = min(taken.get(r.doc_id, 9), r.copies)
    want = [r for r in rows for _ in range(1 if r.doc_id is None else taken.get(r.doc_id, 0))]
    assert sorted(mixed.collect(), key=key) == sorted(want, key=key)

    coded = corpus_pipeline.encode(spark, docs, path).collect()
    tok = bpe.tokenizer(WORD)
    want = [(r.doc_id, r.source, (ids := tok.encode(r.text or "", add_special_tokens=False).ids), len(ids)) for r in rows]
    assert sorted((tuple(r) for r in coded), key=key) == sorted(want, key=key)


def test_pipeline_runs_its_stages_in_order(spark, table):
    path, docs = table
    got = corpus_pipeline.run(spark, path).collect()
    assert got and set(got[0].asDict()) == {"doc_id", "source", "ids", "n_tokens"} and all(r.n_tokens == len(r.ids) for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "secret scans", "mixing sources", "BPE encoding"]
    assert 165 not in {r.doc_id for r in got} and 160 not in {r.doc_id for r in got}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, docs.limit(0), path)
        assert none.columns == docs.columns and none.count() == 0
    assert corpus_pipeline.encode(spark, docs.limit(0), path).count() == 0
