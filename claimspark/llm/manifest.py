"""Merkle manifest of a dataset: a tree per source, a tree of their roots, and a witness for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from claimspark.llm.scratch import slots, stored

#: Nodes of a run, which become one node.
FAN = 3


def combined(digests: Sequence[bytes]) -> bytes:
    """SHA-256 of digests as hexadecimal text, one after the other."""
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


def leaf_of(*columns: Column) -> Column:
    """SHA-256 of the values: ``-`` for null, otherwise their UTF-8 byte count, a colon, and the value as text."""
    texts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


class OpenSubtrees:
    """A block of leaves under append: subtrees that wait for siblings, and what each leaf's witness has so far.

    A witness is the digests of the siblings on the way up, left to right in each run, and a step per run: the place in
    the run and its length. A leaf starts with nothing; when the last sibling of a run completes it, all leaves below the
    run's nodes get the other nodes' digests, and the run becomes a node that waits one level higher.
    """

    def __init__(self, levels: int):
        self.waiting: list[list[tuple[bytes, int, int]]] = [[] for _ in range(levels + 1)]
        self.siblings: list[bytearray] = []
        self.steps: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        n = len(self.siblings)
        self.siblings.append(bytearray())
        self.steps.append(bytearray())
        self.waiting[0].append((digest, n, n + 1))
        level = 0
        while level < len(self.waiting) - 1 and len(self.waiting[level]) == FAN:
            self.complete(level)
            level += 1

    def complete(self, level: int) -> None:
        run = self.waiting[level]
        for place, (_, first, end) in enumerate(run):
            others = b"".join([d for k, (d, _, _) in enumerate(run) if k != place])
            step = 4 * place + len(run)
            for leaf in range(first, end):
                self.siblings[leaf] += others
                self.steps[leaf].append(step)
        self.waiting[level + 1].append((combined([d for d, _, _ in run]), run[0][1], run[-1][2]))
        self.waiting[level] = []

    def root(self, alone: bool) -> bytes:
        """The block's root once nothing more is appended. ``alone``: it is a whole tree, which ends where one node is left;
        other blocks go up all their levels, so that their roots are on one level."""
        for level in range(len(self.waiting) - 1):
            higher = any(self.waiting[level + 1 :])
            if alone and len(self.waiting[level]) == 1 and not higher:
                return self.waiting[level][0][0]
            if self.waiting[level]:
                self.complete(level)
        return self.waiting[-1][0][0]


def folded(leaf: bytes, siblings: bytes, steps: bytes) -> bytes:
    """The root that follows from a leaf and its witness."""
    at = 0
    for step in steps:
        place, n = divmod(step, 4)
        others = [siblings[k : k + 32] for k in range(at, at + 32 * (n - 1), 32)]
        leaf = combined([*others[:place], leaf, *others[place:]])
        at += 32 * (n - 1)
    return leaf


def numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``rows`` with ``rank``, the place from 0 among the rows of the same ``tree`` in ``order``; trees may have any size.

    Rows are range-sorted over all tasks. A rank is the place within the task's rows of the tree plus the tree's rows
    in the tasks before; those counts have a row per tree and one more per task boundary.
    """
    keys = [F.col("tree").asc_nulls_first(), *order]
    dealt = rows.repartitionByRange(slots(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = stored(
        dealt.withColumn("part", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id()), "leaves"
    )
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        placed.groupBy("tree", "part")
        .agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n"))
        .select(
            F.col("tree").alias("of_tree"),
            F.col("part").alias("of_part"),
            (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_line")).alias("shift"),
        )
    )
    return (
        placed.join(counts, (F.col("part") == F.col("of_part")) & F.col("tree").eqNullSafe(F.col("of_tree")))
        .withColumn("rank", F.col("line") + F.col("shift"))
        .drop("part", "line", "of_part", "of_tree", "shift")
    )


def appended(nodes: DataFrame, levels: int) -> DataFrame:
    """``nodes`` (tree, rank, digest and more) with siblings, steps and root within their blocks of 3 ** ``levels`` ranks.

    A task takes its blocks one after the other, in order, and holds one of them.
    """
    ready = (
        nodes.withColumn("block", F.floor(F.col("rank") / FAN**levels))
        .repartition("tree", "block")
        .sortWithinPartitions("tree", "block", "rank")
    )
    names = [f.name for f in ready.schema]
    tree, block, digest = (names.index(c) for c in ("tree", "block", "digest"))

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, subtrees, held = None, OpenSubtrees(levels), []

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                root = subtrees.root(alone=key[1] == 0)
                rows = pa.Table.from_batches(held)
                for name, values in (
                    ("siblings", [bytes(x) for x in subtrees.siblings]),
                    ("steps", [bytes(x) for x in subtrees.steps]),
                    ("root", [root] * rows.num_rows),
                ):
                    rows = rows.append_column(name, pa.array(values, pa.binary()))
                yield from rows.combine_chunks().to_batches()

        for batch in batches:
            keys = list(zip(batch.column(tree).to_pylist(), batch.column(block).to_pylist(), strict=True))
            digests = batch.column(digest).to_pylist()
            start = 0
            while start < len(keys):
                if keys[start] != key:
                    yield from close()
                    key, subtrees, held = keys[start], OpenSubtrees(levels), []
                end = start
                while end < len(keys) and keys[end] == key:
                    subtrees.append(digests[end])
                    end += 1
                held.append(batch.slice(start, end - start))
                start = end
        yield from close()

    more = [StructField(c, BinaryType()) for c in ("siblings", "steps", "root")]
    return ready.mapInArrow(append, StructType([*ready.schema.fields, *more]))


def with_witnesses(leaves: DataFrame, levels: int) -> DataFrame:
    """``leaves`` (tree, rank, digest and more) with the witness of each to its tree's root: siblings, steps, root.

    Roots of blocks are appended to trees of their own, and so on until every tree is one block. Going back down, what a
    block's root was given is added to the witnesses in the block.
    """
    rounds = [stored(appended(leaves, levels), "witnesses")]
    while not rounds[-1].where("block > 0").isEmpty():
        roots = rounds[-1].where(F.col("rank") == F.col("block") * FAN**levels)
        nodes = roots.select("tree", F.col("block").alias("rank"), F.col("root").alias("digest"))
        rounds.append(stored(appended(nodes, levels), "witnesses"))
    found = rounds.pop()
    while rounds:
        above = found.select(
            F.col("tree").alias("of_tree"),
            F.col("rank").alias("of_block"),
            F.col("siblings").alias("later"),
            F.col("steps").alias("later_steps"),
            F.col("root").alias("last_root"),
        )
        found = (
            rounds.pop()
            .join(above, (F.col("block") == F.col("of_block")) & F.col("tree").eqNullSafe(F.col("of_tree")))
            .withColumn("siblings", F.concat("siblings", "later"))
            .withColumn("steps", F.concat("steps", "later_steps"))
            .withColumn("root", F.col("last_root"))
            .drop("of_tree", "of_block", "later", "later_steps", "last_root")
        )
    return found.drop("block")


def manifest(rows: DataFrame, levels: int = 5) -> DataFrame:
    """``rows`` (tree, id, digest and more) with siblings, steps, subroot and root.

    The rows of a tree are its leaves, ordered by id (null last) and digest. While several nodes remain, every three of them in
    order become one, the last of a level also from two or one; a tree of one leaf is that leaf. The trees' roots, ordered by
    ``tree`` (null first), make up one more tree in the same way. ``siblings`` (32 bytes each) and ``steps`` lead from a
    leaf to the root, see ``folded``.

    Blocks of 3 ** ``levels`` leaves are appended to each on its own, wherever they are, so a tree with a third of all rows
    is spread like many trees. Rows that repeat are leaves of their own. An empty table gives an empty result.
    """
    leaves = numbered(rows, [F.col("id").asc_nulls_last(), F.col("digest")])
    within = stored(with_witnesses(leaves, levels), "trees").withColumnRenamed("root", "subroot")
    subroots = within.where("rank = 0").select(F.col("tree").alias("of"), F.col("subroot").alias("digest"))
    ranked = numbered(subroots.withColumn("tree", F.lit(0)), [F.col("of").asc_nulls_first()])
    above = with_witnesses(ranked, levels).select(
        "of", F.col("siblings").alias("later"), F.col("steps").alias("later_steps"), "root"
    )
    return (
        within.join(above, F.col("tree").eqNullSafe(F.col("of")))
        .withColumn("siblings", F.concat("siblings", "later"))
        .withColumn("steps", F.concat("steps", "later_steps"))
        .drop("of", "later", "later_steps", "rank")
    )


def document_leaf(text: Column) -> Column:
    return leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)


def document_manifest(docs: DataFrame, levels: int = 5) -> DataFrame:
    """The manifest of documents, a tree per source, with ``altered``: the leaf of a text that was tampered with, or null.

    Tampering deletes the new lines of texts whose id has an even CRC-32; a null id has none and stays. Columns other than
    doc_id, source, lang, n_chars and text aren't part of a leaf. A null is told apart from an empty text.
    """
    rows = docs.select(
        F.col("source").alias("tree"),
        F.col("doc_id").alias("id"),
        document_leaf(F.col("text")).alias("digest"),
        F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, document_leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("altered"),
    )
    return manifest(stored(rows, "digests"), levels)


def verified(found: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of ``document_manifest``."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("leaf", "siblings", "steps")]
            roots = [folded(*x) for x in zip(*columns, strict=True)]
            yield batch.set_column(batch.schema.get_field_index("leaf"), "leaf", pa.array(roots, pa.binary()))

    as_text = lambda c: F.lower(F.hex(c))
    ready = found.select(
        F.col("id").alias("doc_id"),
        F.coalesce("altered", "digest").alias("leaf"),
        F.col("digest").alias("own"),
        "subroot",
        "root",
        "siblings",
        "steps",
    )
    return ready.mapInArrow(fold, ready.schema).select(
        "doc_id",
        as_text("own").alias("leaf"),
        as_text("subroot").alias("subroot"),
        as_text("root").alias("root"),
        F.sha2(as_text("siblings"), 256).alias("proof_sha256"),
        as_text("leaf").alias("folded_root"),
        (F.col("leaf") == F.col("root")).alias("verified"),
    )
