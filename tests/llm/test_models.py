"""Toxicity and language model: held-out accuracy, brute-force scores, odd rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from claimspark.llm import language_model as lm
from claimspark.llm import toxicity as toxic
from claimspark.llm.queries import op6_toxicity, op9_bloom_lm
from claimspark.llm.text import ALNUM, SPACED, words
from tests.llm.conftest import ODD

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def held(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds == 0


def test_held_out_labels_are_found(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = op6_toxicity(spark, LARGER).collect()
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id, 5) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    known = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in known) / len(known) >= 0.97


def test_noisy_or_of_sentences_and_their_places(documents):
    model = toxic.Model(np.sort(np.array([words(pa.array(["scum"]), ALNUM).hashes()[0]])), np.array([5.0]), -4.0)
    text = "Nice é day. You SCUM! scum scum?\nbye"
    row = toxic.toxicity(documents([(1, text)]), model).first()
    p = lambda z: 1 / (1 + math.exp(-z))
    assert row.score == pytest.approx(1 - (1 - p(1)) * (1 - p(6)))  # the other two sentences say nothing
    assert [text.encode()[s.start : s.end].decode() for s in row.sentences] == ["You SCUM", "scum scum"]
    assert [s.probability for s in row.sentences] == pytest.approx([p(1), p(6)])


def test_training_finds_the_words_that_matter(spark, documents):
    """Clean texts hold none of three words (or their longer forms), toxic ones one or two; copies must not mislead."""
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for k in range(300):
        text = [f"w{x}" for x in rng.integers(0, 400, 60)]
        if k % 4 == 0:
            text[rng.integers(0, 60)] = ["badword", "badwordish", "nasty", "vile"][rng.integers(0, 4)]
        rows.append((k, " ".join(text) + ". bye"))
        marks.append((k, int(k % 4 == 0)))
    rows += [(1000 + k, rows[0][1]) for k in range(50)]  # copies of one toxic text
    marks += [(1000 + k, 1) for k in range(50)]
    model = toxic.train(documents(rows), spark.createDataFrame(marks, "doc_id bigint, toxic int"))
    scores = {r.doc_id: r.score for r in toxic.toxicity(documents(rows), model).collect()}
    wrong = [k for k, y in marks if (scores[k] >= 0.5) != y]
    assert len(wrong) <= 3 and len(model.hashes) < 25


def test_toxicity_of_odd_rows_and_without_labels(spark, odd, documents):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxic.train(odd, none)
    assert not len(model.hashes) and {r.score for r in toxic.toxicity(odd, model).collect()} == {0.0}
    labels = spark.createDataFrame([(7, 1), (6, 0), (1, 0), (None, 1), (2, None), (8, 0), (3, 1)], "doc_id bigint, toxic int")
    model = toxic.train(odd, labels, folds=1_000_003, least_association=0.1)
    assert len(model.hashes)
    scored = toxic.toxicity(odd, model)
    assert scored.columns == [*odd.columns, "score", "sentences"]
    by_id = {r.doc_id: r.score for r in scored.collect()}
    assert len(by_id) == len({r[0] for r in ODD}) and by_id[3] == by_id[4] == by_id[5] == 0.0
    assert toxic.toxicity(documents([]), model).count() == 0
    assert not len(toxic.train(documents([]), labels).hashes)


def test_only_telling_features_reach_the_driver(spark, documents, monkeypatch):
    """Common words are counted where they are; those of the fit are the words told apart by their contexts."""
    rows = [(k, " ".join(f"w{(k * 7 + x) % 90}" for x in range(40)) + (f" w{k} badword." if k % 2 else ".")) for k in range(200)]
    seen = []
    fit = toxic.fit
    monkeypatch.setattr(toxic, "fit", lambda labels, found, sentences, known, *a: seen.append((labels, found, known)) or fit(labels, found, sentences, known, *a))
    marks = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id bigint, toxic int")
    toxic.train(documents(rows), marks)
    ((labels, found, known),) = seen
    assert len(labels) == len(found) == sum(not held(k, 5) for k, _ in rows)
    assert len(known) and (np.diff(known.astype(object)) > 0).all()
    assert np.isin(np.concatenate(found), known).all() and sum(map(len, found)) < 10 * len(rows)
    # The same by hand.
    pairs = {0: set(), 1: set()}
    for k, text in rows:
        if not held(k, 5):
            w = words(pa.array([text]), ALNUM)
            f, of = toxic.features(w)
            before = np.r_[np.uint64(0), w.hashes()[:-1]][of]
            pairs[k % 2] |= set(zip(f.tolist(), np.where(of > 0, before, 0).tolist(), strict=True))
    n = {y: Counter(f for f, _ in pairs[y]) for y in pairs}
    toxic_n, clean_n = (np.array([n[y][f] for f in n[1]]) for y in (1, 0))
    told = toxic.association(toxic_n, clean_n, len(pairs[1]), len(pairs[0])) >= 15.0
    assert known.tolist() == sorted(f for f, t in zip(n[1], told, strict=True) if t)


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def expected_base(rows, train):
    count = Counter(t for x in train for t in tokens(x))
    n, v = sum(count.values()), len(count)
    return [
        (len(tokens(x)), sum(count[t] > 0 for t in tokens(x)), n, sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x)))
        for x in rows
    ]


@pytest.mark.parametrize("flush", [lm.FLUSH, 700])
def test_base_scores_are_exact(spark, flush):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150")
    data = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    model = lm.train(docs.where(~toxic.held_out("doc_id", 10)), flush=flush)
    got = sorted(lm.score(docs, model, flush=flush).collect(), key=lambda r: r.doc_id)
    want = expected_base([t for _, t in data], [t for k, t in data if not held(k, 10)])
    for r, (n, known, total, base) in zip(got, want, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0


def test_filter_never_forgets_and_seldom_invents():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 39, 20_000).astype(np.uint64) * np.uint64(2))
    levels = rng.integers(1, 8, len(keys))
    f = lm.Filter.from_bytes(lm.Filter.of(keys, levels, 12).to_bytes())
    assert (f.levels(keys) >= levels).all() and (f.levels(keys) == levels).mean() > 0.97
    assert (f.levels(rng.integers(0, 1 << 39, 20_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)) == 0).mean() > 0.97


def test_names_and_counts_come_back_from_bytes():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    short = lm.names(keys, 9)
    assert (lm.lengthened(lm.shortened(short)) == short).all() and len(lm.shortened(short)) == 5000
    assert (short == (keys & np.uint64((1 << 55) - 1)) >> np.uint64(15)).all()
    for values in ([], [1, 2, 3], [1, 1 << 40]):
        back = lm.from_whole_numbers(lm.whole_numbers(np.array(values, np.int64)), len(values))
        assert back.tolist() == values


def test_places_beyond_sixteen_bits(spark, documents):
    """A block with more distinct words than 16 bits can name, some of them frequent."""
    texts = [" ".join(f"w{k * 10_000 + j} the" for j in range(10_000)) for k in range(9)]
    docs = documents([*enumerate(texts)]).coalesce(1)
    rows = sorted(lm.score(docs, lm.train(docs)).collect(), key=lambda r: r.doc_id)
    for r, (n, known, total, base) in zip(rows, expected_base(texts, texts), strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base, rel=1e-9)


def test_scores_follow_the_model(spark, documents):
    """Against the same formula from exact pairs, up to the filter's rare false members."""
    texts = ["a b c a b", "a b b", "c a b", "b a c"] * 5
    docs = documents([(k, t) for k, t in enumerate(texts)])
    model = lm.train(docs)
    q = lambda c: 0 if c == 0 else 1 if c == 1 else 0.75 * 2 ** (int(math.log2(c)) + 1)
    single = Counter(t for x in texts for t in tokens(x))
    pairs = Counter(p for x in texts for p in zip(["<s>", *tokens(x)], tokens(x), strict=False))
    single_q = lambda t: len(texts) if t == "<s>" else q(single[t])
    n, v = sum(single.values()), len(single)
    for r in lm.score(docs, model).collect():
        want = 0.0
        for a, b in zip(["<s>", *tokens(texts[r.doc_id])], tokens(texts[r.doc_id]), strict=False):
            p2 = min(1.0, q(pairs[a, b]) / max(1.0, single_q(a)))
            want += math.log10(0.6 * p2 + 0.4 * (q(single[b]) + 0.1) / (n + 0.1 * (v + 1)))
        assert r.score == pytest.approx(want, rel=1e-6)


def trained_levels(documents, texts):
    """The model of ``texts``, all their words and pairs with counts, and the level each has in the filters' table."""
    model = lm.train(documents([*enumerate(texts)]))
    token, sizes = lm.chain(words(pa.array(texts), SPACED))
    (single, n), (both, m) = (np.unique(x, return_counts=True) for x in (token, lm.pairs_of(token, sizes)))
    keys, counts = np.concatenate([single, both]), np.concatenate([n, m])
    of = (keys >> np.uint64(64 - model.bits)).astype(int)
    levels = np.zeros(len(keys), np.int64)
    for r in model.segments.collect():
        own = of == r.segment
        levels[own] = lm.Filter.from_bytes(r.filter).levels(lm.names(keys[own], model.bits))
    return model, counts, levels, np.arange(len(keys)) >= len(single)


def test_the_filter_is_a_table_that_grows_with_the_ngrams(documents):
    sizes = []
    for n in (2_000, 40_000):
        texts = [" ".join(f"w{k}_{j % 50}" for j in range(100)) for k in range(n // 50)]  # each word and nearly each pair twice
        model, counts, levels, is_pair = trained_levels(documents, texts)
        often = (counts > 1) | ~is_pair
        assert (levels >= lm.level(counts))[often].all()
        sizes.append(8 * sum(len(r.filter) for r in model.segments.collect()))
        assert sizes[-1] >= 12 * lm.level(counts)[often].sum()
    assert sizes[1] > 10 * sizes[0]


def test_pairs_that_came_once_are_in_the_filter(spark, documents):
    texts = [f"a{k} b{k} c{k}" for k in range(300)]
    model, counts, levels, is_pair = trained_levels(documents, texts)
    assert (counts[is_pair] == 1).sum() == 1200 and (levels >= lm.level(counts)).all()
    seen, unseen = ("a7 b7 c7", "a7 b8 c9")  # the same words' counts, other pairs
    rows = {r.doc_id: r.score for r in lm.score(documents([(0, seen), (1, unseen)]), lm.train(documents([*enumerate(texts)]))).collect()}
    assert rows[0] > rows[1] + 2


def test_language_model_of_odd_rows(odd, documents):
    model = lm.train(odd)
    rows = lm.score(odd, model).collect()
    assert len(rows) == len(ODD) and {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert lm.score(documents([]), model).count() == 0
    model = lm.train(documents([]))
    rows = lm.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == pytest.approx(0) for r in rows)


def test_every_document_has_a_score(spark):
    rows = op9_bloom_lm(spark, SF).collect()
    assert all(r.held_out == held(r.doc_id, 10) and math.isfinite(r.score) for r in rows)
