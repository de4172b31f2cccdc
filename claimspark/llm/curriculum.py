"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.scratch import keyed, stored
from claimspark.llm.totals import running_totals

WORD = r"[^\x20\x09-\x0D]+"

Schedule = Sequence[tuple[float, float]]

#: How a source's weight changes over the run: (time, weight) knots from 0 to 1, straight in between.
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 0.25), (0.5, 1.0), (1.0, 2.0)),
)


def time_of(share: Column, schedule: Schedule) -> Column:
    """The time by which a source with this schedule has been asked for ``share`` (0 to 1) of its words.

    The integral of a straight piece is a parabola, so each piece is inverted in closed form. It is written without a
    difference of nearly equal numbers and holds for pieces of constant weight as well.
    """
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False)]
    total, done, time = sum(areas), 0.0, F.lit(schedule[-1][0])
    pieces = []
    for ((t0, w0), (t1, w1)), area in zip(zip(schedule, schedule[1:], strict=False), areas, strict=True):
        rest = share * F.lit(total) - F.lit(done)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / (t1 - t0)) * rest))
        pieces.append((share * F.lit(total) <= F.lit(done + area), F.lit(t0) + F.lit(2.0) * rest / (F.lit(w0) + root)))
        done += area
    return reduce(lambda later, piece: F.when(*piece).otherwise(later), reversed(pieces), time)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Per source: source_size, its place in the order of names, the words of all sources before it, and its target in words.

    Raising one level for all sources, target = least(cap * size, level * weight), is where resharing the excess ends.
    Sources fill up in the order of cap * size / weight, so the level follows from running totals in that order. There may
    be as many sources as documents: they are range-sorted over all tasks, and only totals come together.
    """
    named = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix_sources")
    by_name = running_totals(
        named, [F.col("source").asc_nulls_last()], {"place": F.lit(1), "words_before": F.col("source_size")}, "mix_by_name"
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = by_name.withColumn("weight", weight).withColumn("full_at", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
    by_level = stored(
        running_totals(
            weighed,
            [F.col("full_at"), F.col("source").asc_nulls_last()],
            {"full_size": F.col("source_size"), "full_weight": F.col("weight")},
            "mix_by_level",
        ),
        "mix_levels",
    )
    whole = by_level.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(float(share)) * F.lit(whole["size"]) - F.lit(float(cap)) * F.col("full_size")) / (
        F.lit(whole["weight"]) - F.col("full_weight")
    )
    levels = by_level.withColumn("level", level)
    is_open = F.col("full_at") > F.col("level")
    open_level = levels.where(is_open).agg(F.max("level")).first()[0]
    return levels.select(
        "source",
        "source_size",
        "place",
        "words_before",
        F.when(is_open, F.lit(open_level).cast("double") * F.col("weight"))
        .otherwise(F.lit(float(cap)) * F.col("source_size"))
        .alias("target"),
    )


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def planned(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``sizes`` (row, doc_id, source, size, order_key) with source_size, place, target, before and taken.

    ``before`` are the words of the source's documents before this one, which stand in the order of their keys; ``row``
    tells equal ones apart. It is one running total over all rows in order of source and key, less the words of the sources
    before, so a source with a third of all rows, or with a third of null ids, is spread like any other.
    """
    order = [F.col("source").asc_nulls_last(), "order_key", F.col("doc_id").asc_nulls_last(), "size", "row"]
    totals = running_totals(sizes, [F.col(c) if isinstance(c, str) else c for c in order], {"words": F.col("size")}, "mix_order")
    targets = source_targets(sizes, weights, share, cap).withColumnRenamed("source", "in_source")
    rounds = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0)
    rest = F.floor("target") - rounds * F.col("source_size")
    return (
        totals.join(targets, F.col("source").eqNullSafe(F.col("in_source")))
        .withColumn("before", F.col("words") - F.col("words_before"))
        .withColumn("taken", rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before"))))
        .drop("in_source", "words", "words_before")
    )


def due(words_before: Column, words: Column, schedules: Sequence[Schedule]) -> Column:
    """When the middle of the next ``words`` of a source is due, after ``words_before`` that the mix took of it."""
    demand = F.floor("target")
    share_due = (words_before + F.least(words, demand - words_before) / F.lit(2.0)) / demand
    return reduce(
        lambda other, k: F.when(F.col("place") % len(schedules) == k, time_of(share_due, schedules[k])).otherwise(other),
        range(1, len(schedules)),
        time_of(share_due, schedules[0]),
    )


def order_key(doc_id: Column) -> Column:
    return F.coalesce(F.md5(doc_id.cast("string")), F.lit(""))


def curriculum_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    schedules: Sequence[Schedule] = SCHEDULES,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, position; sorted by position.

    ``size`` counts words. Sources in the order of their names take ``weights`` and ``schedules`` in turn and share
    ``share`` times all words, none more than ``cap`` times its own. A source's documents stand in the order of the MD5
    of their ids, which no rerun changes; the mix goes through them from the start, again when it comes to the end, and
    ends within a document where the target is met, so ``taken`` adds up to the whole words of the target. ``position``
    (0 to 1) is when the middle of the words first taken of a document is due: the inverse of the source's integrated schedule.

    A null text has no words and takes nothing. A null source is a source of its own, last in order. Null ids come first in
    their source; rows equal in id and size may stand in either order, with the same words taken in all. Documents the
    mix doesn't reach have taken 0 and a null position and come last. An empty table gives an empty result.
    """
    sizes = stored(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            words_in(F.col("text")).alias("size"),
            order_key(F.col("doc_id")).alias("order_key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "mix_sizes",
    )
    return (
        planned(sizes, weights, share, cap)
        .withColumn("position", F.when(F.col("taken") > 0, due(F.col("before"), F.col("size"), schedules)))
        .orderBy(F.col("position").asc_nulls_last(), "order_key", "row")
        .select("doc_id", "size", "source_size", "target", "taken", "position")
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    schedules: Sequence[Schedule] = SCHEDULES,
) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, see ``curriculum_mix``: a row once per time it is taken, all columns kept,
    sorted by when each of them is due.

    Where a source's target ends within a document, that last copy holds the words taken so far, joined by blanks, and
    its ``n_chars``, where there is one, follows. Documents that aren't taken go; those without any word have nothing to take
    and go as well. Rows are taken by a key of their own, so rows that share an id, or have none, keep their own amounts.
    """
    rows = keyed(docs, "mix_input")
    doc = F.col("doc")
    sizes = stored(
        rows.select(
            "row", doc["doc_id"].alias("doc_id"), doc["source"].alias("source"), words_in(doc["text"]).alias("size"),
            order_key(doc["doc_id"]).alias("order_key"),
        ),
        "mix_sizes",
    )
    # The words of the copy, and those the mix took of the source before it.
    copy = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("taken") / F.col("size")) - 1).cast("int")))
    taken = stored(
        planned(sizes, weights, share, cap)
        .where("taken > 0")
        .select("*", copy.alias("copy"))
        .withColumn("left", F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size")))
        .withColumn("position", due(F.col("copy") * F.col("source_size") + F.col("before"), F.col("left"), schedules))
        .groupBy("row", "size")
        .agg(F.collect_list(F.struct("position", "copy", "left")).alias("copies")),  # at most the cap, rounded up
        "mix_taken",
    )
    cut = F.array_join(F.slice(F.regexp_extract_all(doc["text"], F.lit(f"({WORD})")), 1, F.col("one.left").cast("int")), " ")
    text = F.when(F.col("one.left") < F.col("size"), cut).otherwise(doc["text"])
    columns = [
        text.alias(c) if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else doc[c].alias(c)
        for c in docs.columns
    ]
    return (
        rows.join(taken, "row")
        .select("row", "doc", "size", F.explode("copies").alias("one"))
        .orderBy("one.position", "row", "one.copy")
        .select(*columns)
    )
