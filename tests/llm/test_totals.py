"""Running totals and source targets without a task that sees all rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimspark.llm import curriculum
from claimspark.llm.totals import running_totals


def test_running_totals_over_many_tasks(spark):
    rows = spark.range(5000).selectExpr("id", "id * 7919 % 611 AS k", "id % 10 AS x", "id / 4.0D AS y")
    got = running_totals(rows, [F.desc("k"), F.col("id")], {"xs": F.col("x"), "ys": F.col("y"), "n": F.lit(1)}, "t")
    xs, ys = 0, 0.0
    for n, r in enumerate(sorted(got.collect(), key=lambda r: (-r.k, r.id))):
        assert (r.xs, r.n) == (xs, n) and r.ys == pytest.approx(ys)
        xs, ys = xs + r.x, ys + r.y
    assert running_totals(rows.where("id < 0"), [F.col("id")], {"xs": F.col("x")}, "t").collect() == []


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Resharing round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if cap * sizes[s] - target[s] <= level * weight[s]}
        if not full:
            for s in open_:
                target[s] += level * weight[s]
            break
        for s in full:
            left -= cap * sizes[s] - target[s]
            target[s] = cap * sizes[s]
        open_ -= full
        left += sum(target[s] for s in open_)
        for s in open_:
            target[s] = 0.0
    return target


def test_targets_of_many_sources(spark):
    sizes = {f"s{k}": (k * 37) % 101 for k in range(700)} | {None: 900, "hot": 40_000}
    df = spark.createDataFrame([*sizes.items()], "source string, size bigint")
    got = {r.source: r for r in curriculum.source_targets(df, (5, 2, 1), 1.5, 2.0).collect()}
    want = plain_targets(sizes)
    assert {s: r.target for s, r in got.items()} == pytest.approx(want)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    assert [got[s].place for s in names] == list(range(len(names)))


def test_no_task_sees_all_rows(spark, documents):
    rows = [(None if k % 3 else k, f"word {k}", "hot" if k % 2 else f"s{k}") for k in range(600)]
    docs = documents(rows)
    for df in (curriculum.curriculum_mix(docs), curriculum.mixed_documents(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "SinglePartition" not in plan and not any(x in plan for x in ("Python", "InArrow", "InPandas"))


def test_null_ids_of_a_source_spread_over_tasks(spark, documents):
    docs = documents([(None, f"w{k} x y", "hot") for k in range(3000)])
    sizes = docs.select("doc_id", "source", curriculum.words_in(F.col("text")).alias("size"), F.lit("").alias("order_key"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("source"), F.col("order_key"), F.col("doc_id"), F.col("size"), F.col("row")]
    placed = running_totals(sizes, order, {"words": F.col("size")}, "t")
    assert sorted(r.words for r in placed.collect()) == [3 * k for k in range(3000)]
    dealt = sizes.repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 1000


def test_the_mix_keeps_rows_of_one_id_apart(spark, documents):
    """One id with four words in two sources, in either order, between words that fix the targets."""
    rows = [(7, "a b c d", "a"), (7, "e f g h", "z"), (1, "p q r s " * 5, "m")]
    amounts = sorted(r.taken for r in curriculum.curriculum_mix(documents(rows)).collect())
    for some in (rows, rows[::-1], [rows[1], rows[0], rows[2]]):
        taken = {}
        for r in curriculum.mixed_documents(documents(some).coalesce(1)).collect():
            taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
        assert sorted(taken.values()) == amounts == [8, 8, 26]


def test_mixed_documents_come_in_the_order_they_are_due(spark, documents):
    """The last source's weight grows: more of its words are due in the second half of the run."""
    rows = [(k, "w " * 5, f"s{k % 3}") for k in range(600)]
    out = [r.source for r in curriculum.mixed_documents(documents(rows)).collect()]
    halves = [out[: len(out) // 2].count("s2"), out[len(out) // 2 :].count("s2")]
    assert halves[1] > 1.5 * halves[0] > 0


def test_clashing_columns_stay(spark):
    names = ("_words", "_size", "_nth", "_left", "_copy", "position", "taken", "row", "doc", "copies", "size", "one")
    df = spark.createDataFrame([(k, "a b c", "s", *range(len(names))) for k in range(5)], ["doc_id", "text", "source", *names])
    out = curriculum.mixed_documents(df)
    assert out.columns == df.columns and {tuple(r)[3:] for r in out.collect()} == {tuple(range(len(names)))}
