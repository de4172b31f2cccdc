"""Exact top-k inner products by branch and bound over blocks of dimensions in vertical layout."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.scratch import stored


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and vec, the components times ``scale`` rounded down; rows with a null or non-finite component go."""
    unfit = "exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    return (
        vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
        .where(F.col("vec").isNotNull() & F.col("vec_id").isNotNull() & ~F.expr(f"coalesce({unfit}, true)"))
        .select("vec_id", F.expr(f"transform(vec, x -> floor({scale} * x))").alias("vec"))
    )


def layout(vecs: pa.ChunkedArray, width: int) -> np.ndarray:
    """One array per dimension: ``width`` x rows; vectors that are shorter count as 0 beyond their end."""
    vecs = vecs.combine_chunks()
    lengths = np.diff(vecs.offsets.to_numpy())
    out = np.zeros((len(vecs), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = vecs.flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(out.T)


def best_of_block(
    queries: np.ndarray, own: np.ndarray, columns: np.ndarray, order: np.ndarray, k: int, step: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores (a row per query) of all candidates of a block that can be among the ``k`` best of any of a few queries.

    ``queries`` has a row per query, ``columns`` a row per dimension, and ``own`` marks a query's own row. Scores grow by
    ``step`` dimensions at a time, in ``order``. What the remaining dimensions can add lies within the product of the remaining
    norms of query and candidate. Candidates whose upper bound is below a query's k-th best lower bound can't be among
    its best; the arrays are compacted to those that some query still needs.

    Products of numbers whose norms multiply to less than 2 ** 52 are whole numbers that doubles hold, sums of any part of them
    as well, and are computed as such; others as 64-bit integers.
    """
    queries, columns = queries[:, order], columns[order]
    squares, own_squares = columns.astype(np.float64) ** 2, queries.astype(np.float64) ** 2
    most = np.sqrt(own_squares.sum(axis=1).max(initial=0) * squares.sum(axis=0).max(initial=0))
    if most < 2.0**52:
        queries, columns = queries.astype(np.float64), columns.astype(np.float64)
    alive = np.arange(columns.shape[1])
    score = np.zeros((len(queries), len(alive)), columns.dtype)
    for at in range(0, len(order), step):
        end = min(at + step, len(order))
        score += queries[:, at:end] @ columns[at:end]
        if end == len(order) or len(alive) <= k:
            continue
        # One unit over the rounding of the square root keeps the bound above the exact integer.
        bound = np.sqrt(own_squares[:, end:].sum(axis=1)[:, None] * squares[end:].sum(axis=0)) * (1 + 1e-9) + 1
        low = np.where(own, -np.inf, score - bound)
        floor = np.partition(low, len(alive) - k, axis=1)[:, len(alive) - k]
        stay = ((score + bound >= floor[:, None]) & ~own).any(axis=0)
        if stay.sum() < 0.8 * len(alive):
            alive, score, own = alive[stay], score[:, stay], own[:, stay]
            columns, squares = columns[:, stay], squares[:, stay]
    return alive, score.astype(np.int64)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    block_rows: int = 1024,
    query_rows: int = 2048,
    step: int = 8,
    together: int = 32,
) -> DataFrame:
    """Each query's ``k`` highest inner products with all other vectors: query_id, rank, vec_id, score.

    Rows of both sides are dealt to blocks in turn, and each pair of blocks is one task's work, ``together`` queries at a time; a
    block's size is set by ``block_rows`` and ``query_rows``, so memory doesn't grow with the tables, whatever they repeat. A
    task returns k rows per query of its block, and the best of all blocks follow from a ranking that is cut before the
    shuffle.

    Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Fewer than k
    candidates give fewer rows, ties go to the smaller id, and rows with a query's own id are no candidates for it. An
    empty vector scores 0 with all. A row that repeats is a candidate each time, and an id with several rows asks with each of
    them and has the k best pairs of all. Scores are exact within 64 bits.
    """
    row = F.monotonically_increasing_id().alias("row")
    found = stored(quantised(vectors, id_col, vector_col, scale).select("*", row), "vectors")
    asked = stored(quantised(queries, id_col, vector_col, scale).select("*", row), "queries")
    sizes = found.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("w")).first()
    n_queries = asked.count()
    blocks = -(-sizes["n"] // block_rows) or 1
    query_blocks = -(-n_queries // query_rows) or 1
    width = max(sizes["w"] or 0, 1)

    def spread(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        key = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias(own)
        return df.select("vec_id", "vec", key, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    candidates = spread(found, "block", blocks, "query_block", query_blocks)
    questions = spread(asked, "query_block", query_blocks, "block", blocks)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asking = left.column("vec_id").combine_chunks(), right.column("vec_id").combine_chunks()
        # Numbers in the order of the ids, whatever kind they are.
        places = pc.rank(pa.concat_arrays([ids, asking]), tiebreaker="dense").to_numpy()
        by_id, by_query = places[: len(ids)], places[len(ids) :]
        columns, rows = layout(left.column("vec"), width), layout(right.column("vec"), width).T
        order = np.argsort(-columns.astype(np.float64).var(axis=1), kind="stable") if len(ids) else np.arange(width)
        which, found_, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(rows) if len(ids) else 0, together):
            own = by_query[at : at + together][:, None] == by_id
            alive, score = best_of_block(rows[at : at + together], own, columns, order, k, step)
            for n in range(len(score)):
                mine = ~own[n, alive]
                candidate, value = alive[mine], score[n, mine]
                if len(value) > k:
                    good = value >= np.partition(value, len(value) - k)[len(value) - k]
                    candidate, value = candidate[good], value[good]
                best = np.lexsort((by_id[candidate], -value))[:k]
                which.append(np.full(len(best), at + n))
                found_.append(candidate[best])
                scores.append(value[best])
        return pa.table(
            [asking.take(pa.array(np.concatenate(which))), ids.take(pa.array(np.concatenate(found_))), pa.array(np.concatenate(scores))],
            ["query_id", "vec_id", "score"],
        )

    kind = vectors.schema[id_col].dataType.simpleString()
    near = (
        candidates.groupBy("block", "query_block")
        .cogroup(questions.groupBy("block", "query_block"))
        .applyInArrow(search, f"query_id {kind}, vec_id {kind}, score bigint")
    )
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
