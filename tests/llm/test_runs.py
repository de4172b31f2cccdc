"""Periodic runs against a search of every period, on random words and through the query."""

from __future__ import annotations

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimspark.llm import runs
from claimspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(words, least=6, exponent=4):
    """(start, length, period) of all runs, by every period and every stretch."""
    found, n = [], len(words)
    for q in range(1, n // exponent + 1):
        at = 0
        while at + q < n:
            if words[at] != words[at + q]:
                at += 1
                continue
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - at
            if length >= max(least, exponent * q):
                stretch = words[at : at + length]
                if not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                    found.append((at, length, q))
            at = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    """The query's row by the contract, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(kept)),
    )


def found(texts, **options):
    """Runs of each of a few lists of words, searched together."""
    names = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    token = runs.mix(np.array([names[w] for t in texts for w in t], np.uint64))
    got = runs.find_runs(token, np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64), **options)
    return [[tuple(r) for r in got[got[:, 0] == k, 1:].tolist()] for k in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(
    st.lists(
        st.lists(
            st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 9), st.integers(0, 3)), max_size=4
        ),
        min_size=1,
        max_size=4,
    )
)
def test_runs_are_those_of_a_full_search(plans):
    texts = [[w for root, times, cut in plan for w in (root * times)[: len(root) * times - cut]] for plan in plans]
    assert found(texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("period", [1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 100, 257])
@pytest.mark.parametrize("extra", [-1, 0, 1])
def test_every_scale_and_the_edge_of_four_periods(period, extra):
    rng = np.random.default_rng(period)
    root = list(range(period))
    run = (root * 5)[: 4 * period + extra]
    head, tail = [1000 + int(x) for x in rng.integers(0, 900, 50)], [2000 + int(x) for x in rng.integers(0, 900, 50)]
    words = head + run + tail
    assert found([words, run, []]) == [brute(words), brute(run), []]


def test_runs_within_runs_and_long_ones():
    inner = [1, 1, 1, 1, 1, 1, 2, 3]
    words = inner * 400 + [9] * 500 + list(range(100, 130)) * 6
    assert found([words]) == [brute(words)]
    assert found([[5] * 100_000]) == [[(0, 100_000, 1)]]


def test_exponent_below_four_is_refused():
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(4, np.uint64), np.array([0, 4]), exponent=3)


def test_odd_rows(spark, documents):
    loop = "a b C\td " * 5
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, loop), (5, loop), (5, loop), (6, "w " * 50_000), (7, "é ü 🎉 " * 9 + "x")]
    got = {}
    for r in runs.periodic_runs(documents(rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    assert got[1] == got[2] == got[3] == [(0, [], "")]
    assert got[None] == [(20, [(0, 20, 4)], "a b C d")] and got[5] == got[None] * 2
    assert got[6] == [(50_000, [(0, 50_000, 1)], "w")]
    assert got[7] == [(28, [(0, 27, 3)], "é ü 🎉 x")]
    assert runs.digests(runs.periodic_runs(documents([]))).collect() == []


def test_query_equals_the_full_search(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted(expected(d.doc_id, d.text) for d in docs if len(d.text or "") < 20_000)
    ids = {w[0] for w in want}
    got = sorted(tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF).collect() if r.doc_id in ids)
    assert got == want and sum(w[1] for w in want) > 5


def test_planted_loops_follow_the_rule(spark, documents):
    rows = [(k, " \tw0 w1\nw2  w3 w4 w5 w6 w7 w8 w9 wa wb ") for k in range(200)] + [(None, "a a a a a a"), (900, None), (901, "")]
    got = runs.digests(runs.periodic_runs(runs.with_planted_loops(documents(rows)))).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in got), key=key) == sorted((expected(*r) for r in rows), key=key)
