"""Exact duplicates by skew-safe combining: locally, per salt, then over the salts, with full content as the key."""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.scratch import keyed, slots, stored

BLANKS = " \t\n\x0b\x0c\r"


def sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def with_body(rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """``rows`` (doc_id, text and more) with chars, body (the text without blanks) and digest in place of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    body = rows.withColumn("chars", F.length(text)).withColumn("body", F.translate(text, BLANKS, "")).drop("text")
    return body.withColumn("digest", digest(F.col("body")))


def combined(rows: DataFrame, *last: str) -> DataFrame:
    """One row per content: digest, body, best and n. ``best`` is the row to keep: the most code points, then the smallest id
    (null last), then the smallest of the columns ``last``.

    Grouped by digest *and* content within each salt, the map task, and then over the salts. Partial aggregation leaves
    one row per content and map task, so content with a third of all rows never meets in one task.
    """
    salts = isqrt(slots(rows.sparkSession)) + 1
    best = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", *last)
    salted = (
        rows.withColumn("salt", F.spark_partition_id() % salts)
        .groupBy("digest", "salt", "body")
        .agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    )
    return salted.groupBy("digest", "body").agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without blanks. Of equal texts the one with the most code points stays, then
    the smallest id. The way back from the groups (see ``combined``) to their rows is a join of narrow rows, which adaptive
    execution splits where a group is large.

    A null text is empty, and empty texts are equal. A null id sorts last. Of rows that repeat the kept id in a group those with
    fewer code points aren't kept, and of rows that repeat its length as well one is. An empty table gives an empty result;
    other columns are ignored.
    """
    rows = with_body(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), digest)
    classes = combined(rows).select(
        "digest",
        F.xxhash64("body").alias("route"),
        F.col("best.doc_id").alias("keep_id"),
        (-F.col("best.less")).alias("most"),
        F.col("n").alias("group_size"),
    )
    members = (
        rows.select("doc_id", "chars", "digest", F.xxhash64("body").alias("route"))
        .groupBy("doc_id", "chars", "digest", "route")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("most")) & (F.col("nth") == 1)
    return (
        members.join(classes, ["digest", "route"])
        .select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth"))
        .select("doc_id", "keep_id", "group_size", first.alias("kept"), F.col("digest").alias("text_sha256"))
    )


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each content, with all its columns: of equal texts the one with the most code points, then the
    smallest id (null last), then the text with the smallest digest. Rows equal in all that are copies, of which one stays."""
    rows = keyed(docs, "dedup_input")
    doc = F.col("doc")
    # Of rows with the same id and length the texts differ in blanks only; a digest of them decides, whatever their order.
    bodies = with_body(rows.select("row", doc[id_col].alias("doc_id"), doc[text_col].alias("text"), F.sha2(doc[text_col].cast("string"), 256).alias("own")), sha256)
    kept = stored(combined(bodies, "own", "row").select(F.col("best.row").alias("row")), "dedup_kept")
    return rows.join(kept, "row", "left_semi").select("doc.*")
