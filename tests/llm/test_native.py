"""Exact deduplication and the curriculum mix against plain Python versions."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from claimspark.llm.curriculum import SCHEDULES, curriculum_mix, mixed_documents, time_of
from claimspark.llm.exact_dedup import exact_duplicates, without_duplicates
from tests.llm.conftest import ODD


def expected_duplicates(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    keep = {body: min(g, key=lambda x: (x[0], x[1], x[2] or 0))[2] for body, g in groups.items()}
    out = []
    for doc_id, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        out.append((doc_id, keep[body], len(groups[body]), hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_duplicates_of_odd_rows(odd, weak):
    """With a digest of two values the content alone has to tell texts apart."""
    digest = (lambda body: (F.length(body) % 2).cast("string")) if weak else (lambda body: F.sha2(body, 256))
    found = exact_duplicates(odd, digest=digest).collect()
    got = sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=repr)
    assert got == sorted((x[:3] for x in expected_duplicates(ODD)), key=repr)
    if not weak:
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == expected_duplicates(ODD)
    kept = [r.doc_id for r in found if r.kept]
    assert len(kept) == len({x[1] for x in expected_duplicates(ODD)})


def test_a_repeated_row_is_kept_once(documents):
    rows = [(1, "a b"), (1, "a b"), (1, "a b")]
    assert [r.kept for r in exact_duplicates(documents(rows)).collect()].count(True) == 1
    assert without_duplicates(documents(rows)).count() == 1


def test_without_duplicates_keeps_columns_and_clean_rows(odd):
    left = without_duplicates(odd)
    assert left.columns == odd.columns
    assert {r.doc_id for r in left.collect()} == {2, 5, None, 6, 7, 8}


def test_a_hot_text_goes_through_few_rows(spark, documents):
    df = documents([(k, "same text" if k % 3 else f"text {k}") for k in range(3000)]).repartition(12)
    found = {r.group_size for r in exact_duplicates(df).collect()}
    assert found == {2000, 1}


def test_empty_tables(documents):
    none = documents([])
    assert exact_duplicates(none).count() == 0
    assert without_duplicates(none).count() == 0
    assert curriculum_mix(none).count() == 0
    assert mixed_documents(none).count() == 0


def water_fill(sizes, weights, share, cap):
    """Resharing the excess round by round."""
    target = dict.fromkeys(sizes, 0.0)
    left, open_ = share * sum(sizes.values()), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        for s in list(open_):
            target[s] += left * weights[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def test_curriculum_targets_and_takes(documents):
    rows = [(k, "w " * (k % 17), ["a", "b", "c", None][k % 4 if k % 5 else 0]) for k in range(400)]
    got = curriculum_mix(documents(rows)).collect()
    sizes = defaultdict(int)
    for k, _, s in rows:
        sizes[s] += k % 17
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [5, 2, 1, 5], strict=True))
    want = water_fill(sizes, weights, 1.5, 2.0)
    source = {k: s for k, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 2 * r.size
        assert (r.position is None) == (r.taken == 0)
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        assert want[s] - 1 <= taken[s] <= want[s] + 1e-6
    placed = [r.position for r in got if r.position is not None]
    assert placed == sorted(placed) and 0 <= placed[0] and placed[-1] <= 1
    again = curriculum_mix(documents(rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_curriculum_of_odd_rows(odd):
    got = {(r.doc_id, r.size): r.taken for r in curriculum_mix(odd).collect()}
    assert got[(3, 0)] == got[(4, 0)] == got[(5, 0)] == 0
    assert got[(7, 60_000)] > 0


@pytest.mark.parametrize("schedule", SCHEDULES)
def test_schedules_are_inverted(spark, schedule):
    def done(t):
        area = 0.0
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
            to = min(max(t, t0), t1)
            area += (to - t0) * (w0 + w0 + (w1 - w0) * (to - t0) / (t1 - t0)) / 2
        return area

    shares = [k / 20 for k in range(21)]
    df = spark.createDataFrame([(x,) for x in shares], "share double").select("share", time_of(F.col("share"), schedule).alias("t"))
    for r in df.collect():
        assert done(r.t) / done(1.0) == pytest.approx(r.share, abs=1e-9)


def test_mixed_documents_hold_the_words_taken(documents):
    rows = [(k, f"word{k} " * (1 + k % 9), "ab"[k % 2]) for k in range(60)] + [(99, None, "a"), (100, "", "b")]
    docs = documents(rows)
    wanted = {r.doc_id: r.taken for r in curriculum_mix(docs).collect()}
    words = defaultdict(int)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert {k: v for k, v in wanted.items() if v} == dict(words)
