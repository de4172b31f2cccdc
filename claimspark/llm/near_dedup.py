"""Near duplicates: DartMinHash signatures, banded joining, exact verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.scratch import keyed, stored
from claimspark.llm.text import SPACED, mix, slices, words

#: Nodes whose texts are looked for by a broadcast, 16 bytes each; beyond it by a join.
MOST_NAMED = 1_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_FEW = np.uint64(0xD6E8FEB86659FD93)


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text as (row, shingle, count), by row and shingle.

    A shingle is ``size`` consecutive words with A-Z lower-cased. A text with fewer words is one shingle of all of them, so
    texts with the same words always have the same shingles, those without any word included.
    """
    w = words(column, SPACED)
    n, h, counts = len(w.first) - 1, w.hashes(), w.counts
    short = counts < size
    begins = np.flatnonzero(np.arange(len(h)) + size <= w.first[w.row + 1]) if len(h) else np.zeros(0, np.int64)
    value = np.zeros(len(begins), np.uint64)
    for k in range(size):
        value = value * _STEP + h[begins + k]
    few = np.full(n, _FEW, np.uint64)
    for k in range(size - 1):  # words of short texts one by one, with their number
        has = np.flatnonzero(short & (counts > k))
        few[has] = mix(few[has] * _STEP + h[w.first[has] + k])
    alone = np.flatnonzero(short)
    row = np.concatenate([w.row[begins], alone])
    value = mix(np.concatenate([value, few[alone] + counts[alone].astype(np.uint64)]))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.r_[True, (np.diff(row) > 0) | (value[1:] != value[:-1])][: len(row)]
    first = np.flatnonzero(new)
    return row[first], value[first], np.diff(np.r_[first, len(row)])


def content_keys(n: int, row: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, in two parts, of the shingles and counts of each of ``n`` rows: equal for equal content."""
    out = []
    for step in (_STEP, _FEW):
        total = np.zeros(n, np.uint64)
        np.add.at(total, row, mix((shingle ^ step) + count.astype(np.uint64) * step))
        out.append(mix(total))
    return out[0], out[1]


def dart_signatures(n: int, row: np.ndarray, element: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """``n`` x ``k`` signatures of weighted sets, equal in a coordinate with probability of the weighted Jaccard similarity.

    Darts fall on the plane of weight and rank of each element at unit density, the same for every set: per strip of the
    weight axis (0 to 1, 1 to 2, 2 to 4, ...) they come as a Poisson process along the rank, with hashed gaps, a hashed
    weight within the strip and a hashed coordinate. A set gets the darts below its elements' weights, up to the rank
    where it expects k (ln k + 3) of them, and each coordinate keeps the earliest. So the work is in proportion to the
    darts, not to elements times coordinates. Sets with an empty coordinate throw again, twice as far.
    """
    total = np.bincount(row, weight, n)
    reach = k * (log(k) + 3) / np.maximum(total, 1e-300)
    best = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    open_rows = np.flatnonzero(total > 0)
    strips = []
    low, high = 0.0, 1.0
    while (over := np.flatnonzero(weight > low)).size:
        strips.append((over, low, high - low))
        low, high = high, 2 * high
    item = np.concatenate([s[0] for s in strips]) if strips else np.zeros(0, np.int64)
    start = np.concatenate([np.full(len(s[0]), s[1]) for s in strips]) if strips else np.zeros(0)
    width = np.concatenate([np.full(len(s[0]), s[2]) for s in strips]) if strips else np.zeros(0)
    while len(open_rows):
        wanted = np.zeros(n, bool)
        wanted[open_rows] = True
        own = np.flatnonzero(wanted[row[item]])
        seed = mix(element[item[own]] + mix(np.float64(start[own]).view(np.uint64)))
        rank, of, wide, from_ = np.zeros(len(own)), row[item[own]], width[own], start[own]
        most, limit = weight[item[own]], reach[row[item[own]]]
        while len(seed):
            seed = mix(seed + _STEP)
            rank = rank - np.log(((seed >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / wide
            live = np.flatnonzero(rank < limit)
            if len(live) < len(seed):
                seed, rank, of, wide, from_, most, limit = (x[live] for x in (seed, rank, of, wide, from_, most, limit))
            dart = mix(seed ^ _FEW)
            place = of * k + ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            # The rank decides; its last bits make room for the dart's name.
            value = (rank.view(np.uint64) & ~np.uint64(0xFFFF)) | (dart & np.uint64(0xFFFF))
            if (most < from_ + wide).any():
                inside = from_ + wide * ((mix(dart) >> np.uint64(11)).astype(np.float64) * 2.0**-53) < most
                place, value = place[inside], value[inside]
            np.minimum.at(best, place, value)
        reach = reach * 2
        empty = (best.reshape(n, k) == np.iinfo(np.uint64).max).any(axis=1)
        open_rows = open_rows[empty[open_rows]]
    return best.reshape(n, k)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of ``rows`` coordinates, different between bands."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows)
    key = np.broadcast_to(mix(np.arange(k // rows, dtype=np.uint64) + np.uint64(1)), (n, k // rows)).copy()
    for r in range(rows):
        key = mix(key * _STEP + parts[:, :, r])
    return key


def weighted_jaccard(texts: pa.Array, others: pa.Array, size: int) -> np.ndarray:
    """Similarity of the shingle counts of each pair of texts."""
    n = len(texts)
    a, b = shingles(texts, size), shingles(others, size)
    row = np.concatenate([a[0], b[0]])
    shingle = np.concatenate([a[1], b[1]])
    count = np.concatenate([a[2], b[2]])
    order = np.lexsort((shingle, row))
    row, shingle, count = row[order], shingle[order], count[order]
    both = np.flatnonzero((row[1:] == row[:-1]) & (shingle[1:] == shingle[:-1]))
    common = np.bincount(row[both], np.minimum(count[both], count[both + 1]), n)
    return common / (np.bincount(row, count, n) - common)


def sketches(column: pa.Array, size: int, most: int) -> list[np.ndarray]:
    """The ``most`` smallest 32-bit hashes of each text's shingles, a shingle that occurs n times counting as n of them.

    Texts with no more than that keep all, so comparing them is exact but for hashes that happen to be equal.
    """
    row, shingle, count = shingles(column, size)
    one = np.repeat(np.arange(len(row)), count)
    nth = np.arange(len(one)) - np.repeat(np.cumsum(count) - count, count)
    value = (mix(shingle[one] + nth.astype(np.uint64) * _FEW) >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((value, row[one]))
    cuts = np.searchsorted(row[one], np.arange(len(column) + 1))
    value = value[order]
    return [np.unique(value[a:b])[:most] for a, b in zip(cuts, cuts[1:], strict=False)]


def close_pairs(
    left: list[np.ndarray], right: list[np.ndarray], most: int, similarity: float
) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pair of sketches can belong to texts of the given similarity, and whether it surely does.

    Of two sketches the one that ends first is complete for the other one up to there; the estimate counts what both have
    up to that end. Complete sketches are compared as they are. For others the estimate can be off by five standard
    errors either way, which is wrong with a probability below one in a million.
    """
    _, of = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    by_value = np.argsort(of, kind="stable")
    of, row = of[by_value], row[by_value]
    shared = np.bincount(of) > 1
    row, column = row[shared[of]], (np.cumsum(shared) - 1)[of[shared[of]]]
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(shared.sum()), 4096):  # so that memory doesn't grow with the texts
        a, b = np.searchsorted(column, (at, at + 4096))
        has = np.zeros((len(left) + len(right), min(4096, int(shared.sum()) - at)), np.float32)
        has[row[a:b], column[a:b] - at] = 1
        common += has[: len(left)] @ has[len(left) :].T
    end = lambda xs: np.array([x[-1] if len(x) >= most else 1 << 32 for x in xs], np.float64)
    ends_l, ends_r = end(left), end(right)
    to_l = np.stack([np.searchsorted(y, ends_l, "right") for y in right], axis=1)  # of y up to the end of x
    to_r = np.stack([np.searchsorted(x, ends_r, "right") for x in left], axis=0)
    first_l = ends_l[:, None] <= ends_r[None, :]
    sizes_l, sizes_r = np.array([len(x) for x in left])[:, None], np.array([len(y) for y in right])[None, :]
    seen = np.where(first_l, sizes_l + to_l, to_r + sizes_r) - common
    whole = np.minimum(ends_l[:, None], ends_r[None, :]) >= 1 << 32
    slack = np.where(whole, 0.0, 5 * np.sqrt(similarity * (1 - similarity) / np.maximum(seen, 1)))
    return common >= (similarity - slack) * seen - 1e-6, common >= (similarity + slack) * seen - 1e-6


def connecting(a: np.ndarray, b: np.ndarray, main: int) -> np.ndarray:
    """Places of pairs of labels (a, b) that are enough to connect what all of them connect, those with ``main`` first.

    So other blocks with the same ``main`` choose the same pairs of labels.
    """
    names, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    above = list(range(len(names)))

    def root(k: int) -> int:
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    pairs, first = np.unique(np.stack([of[: len(a)], of[len(a) :]]), axis=1, return_index=True)
    order = np.argsort(~(names[pairs] == main).any(axis=0), kind="stable")
    pairs, first = pairs[:, order], first[order]
    needed = []
    for x, y, k in zip(*pairs.tolist(), first.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            above[x] = y
            needed.append(k)
    return np.array(needed, np.int64)


def components(edges: DataFrame) -> DataFrame:
    """node, label: the same label for nodes that edges (u, v) connect, whatever way round.

    Every node moves to its smallest neighbour and edges move with their ends, until none is left; nodes are hashes, so
    the graph shrinks by a good part each round. Every round is written, and so are its labels.
    """
    steps: list[DataFrame] = []
    left = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    while not left.isEmpty():
        ends = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = ends.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label"))
        labels = stored(smallest, "labels")
        steps.append(labels)
        left = stored(
            left.join(labels.withColumnRenamed("node", "u").withColumnRenamed("label", "x"), "u")
            .join(labels.withColumnRenamed("node", "v").withColumnRenamed("label", "y"), "v")
            .where("x <> y")
            .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
            .distinct(),
            "edges",
        )
    if not steps:
        return left.select(F.col("u").alias("node"), F.col("v").alias("label"))
    found = steps[0]
    for labels in steps[1:]:
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("later"))
        found = stored(
            found.join(later, "label", "left").select("node", F.coalesce("later", "label").alias("label")), "components"
        )
    return found


def tile_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one (bucket, left_tile, right_tile) at a time, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in ("bucket", "left_tile", "right_tile")]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            if any(last.column(c)[0].as_py() != k[0] for c, k in zip(("bucket", "left_tile", "right_tile"), keys, strict=True)):
                yield pa.Table.from_batches(held)
                held = []
        for a, b in zip(np.r_[0, new], np.r_[new, batch.num_rows], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def smallest() -> Column:
    """What ``min`` takes to find the row with the smallest id, null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")


def labelled(
    source: DataFrame,
    similarity: float = 0.8,
    shingle_words: int = 5,
    bands: int = 42,
    rows: int = 7,
    sketch_size: int = 2048,
    tile: int = 1024,
) -> DataFrame:
    """The label of the class of each row of ``source`` (row, doc_id, text): row, doc_id, label; see ``near_duplicates``.

    ``row`` tells rows apart, whatever ids they have; ``source`` is a written table, in which it doesn't change. Content is
    known by 128 bits, and a node, a number of its own for each content, is made from the row that stands for it.
    """
    kind = source.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                found = shingles(part.column("text"), shingle_words)
                content, more = content_keys(n, *found)
                _, one, of = np.unique(content, return_index=True, return_inverse=True)  # copies here are signed once
                new = np.full(n, -1)
                new[one] = np.arange(len(one))
                mine = new[found[0]] >= 0
                signature = dart_signatures(
                    len(one), new[found[0][mine]], found[1][mine], found[2][mine].astype(np.float64), bands * rows
                )
                keys = band_keys(signature, rows)[of]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"),
                        part.column("doc_id"),
                        pa.array(content.view(np.int64)),
                        pa.array(more.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(keys.ravel().view(np.int64))),
                    ],
                    ["row", "doc_id", "content", "more", "bands"],
                )

    signed = stored(
        source.select("row", "doc_id", "text").mapInArrow(
            sign, f"row bigint, doc_id {kind}, content bigint, more bigint, bands array<bigint>"
        ),
        "signatures",
    )
    nodes = signed.groupBy("content", "more").agg(F.first("bands").alias("bands"), F.min(smallest()).alias("text"))
    # The hash of one 64-bit number is one-to-one, and scattered numbers make components quick to find.
    nodes = stored(nodes.withColumn("node", F.xxhash64("text.row")), "nodes")
    members = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    # Grouping by the band as well leaves the join below its own shuffles, whose large partitions Spark can split.
    buckets = (
        members.groupBy("bucket", "band")
        .agg(F.min("node").alias("hub"), F.max("node").alias("top"))
        .where("hub <> top")
        .select("bucket", "hub")
    )
    shared = stored(members.select("node", "bucket").join(buckets, "bucket"), "buckets")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """node, text of the distinct nodes in ``wanted``. Texts are the bulk of the data: while the wanted numbers are few they are
        said to all tasks and texts stay where they are; beyond that both are shuffled."""
        rows_of = stored(wanted.join(nodes.select("node", F.col("text.row").alias("row")), "node").select("node", "row"), "wanted")
        few = rows_of.limit(MOST_NAMED + 1).count() <= MOST_NAMED
        return source.select("row", "text").join(F.broadcast(rows_of) if few else rows_of, "row").select("node", "text")

    def pairs_across(marked: DataFrame) -> DataFrame:
        """Pairs of nodes that share a bucket but no component, and whose sketches are close.

        A bucket's nodes outside its largest component are compared with all its nodes. Both sides are cut into tiles, a
        pair of tiles is one piece of work, and only close pairs become rows.
        """
        by_label = marked.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
        plan = (
            by_label.groupBy("bucket")
            .agg(
                F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("n_labels")
            )
            .where("n_labels > 1")
            .select(
                F.col("bucket").alias("in_bucket"),
                F.col("main.label").alias("main"),
                F.ceil((F.col("n_all") - F.col("main.n")) / tile).cast("int").alias("left_tiles"),
                F.ceil(F.col("n_all") / tile).cast("int").alias("right_tiles"),
            )
        )
        rest = stored(marked.join(plan, F.col("bucket") == F.col("in_bucket")).drop("in_bucket"), "mixed")
        kind = "node bigint, sketch binary"

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    own = [x.tobytes() for x in sketches(part.column("text"), shingle_words, sketch_size)]
                    yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(own, pa.binary())], ["node", "sketch"])

        drawn = stored(texts_of(rest.select("node").distinct()).mapInArrow(sketch, kind), "sketches")
        every = rest.join(drawn, "node")
        own = lambda tiles: F.pmod(F.xxhash64("node"), F.col(tiles)).cast("int")
        others = lambda tiles: F.explode(F.sequence(F.lit(0), F.col(tiles) - 1))
        columns = ("bucket", "left_tile", "right_tile", "is_left", "node", "label", "main", "sketch")
        left = every.where("label <> main").withColumn("left_tile", own("left_tiles")).withColumn("right_tile", others("right_tiles"))
        right = every.withColumn("right_tile", own("right_tiles")).withColumn("left_tile", others("left_tiles"))
        tiles = left.withColumn("is_left", F.lit(True)).select(*columns).union(
            right.withColumn("is_left", F.lit(False)).select(*columns)
        )
        keys = ("bucket", "left_tile", "right_tile")
        found = stored(
            tiles.repartition(*keys)
            .sortWithinPartitions(*keys)
            .mapInArrow(compare_tiles, "u bigint, v bigint, low bigint, high bigint, sure boolean"),
            "close",
        )
        # One sure link is enough to connect two components.
        sure = found.where("sure").groupBy("low", "high").agg(F.min(F.struct("u", "v")).alias("pair")).select("pair.u", "pair.v")
        return sure.union(found.where("NOT sure").select("u", "v")).distinct()

    def compare_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in tile_groups(batches):
            is_left = group.column("is_left").to_numpy(zero_copy_only=False)
            node, label = group.column("node").to_numpy(), group.column("label").to_numpy()
            own = [np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("sketch")]
            a, b = np.flatnonzero(is_left), np.flatnonzero(~is_left)
            if not len(a) or not len(b):
                continue
            close, sure = close_pairs([own[k] for k in a], [own[k] for k in b], sketch_size, similarity)
            # Pairs of two nodes outside the largest component come up twice; once is enough.
            once = (label[b] == group.column("main").to_numpy()[b])[None, :] | (node[a][:, None] < node[b][None, :])
            apart = once & (label[a][:, None] != label[b][None, :])
            x, y = np.nonzero(sure & apart)
            needed = connecting(label[a[x]], label[b[y]], group.column("main")[0].as_py())
            unsure = np.nonzero(close & ~sure & apart)
            i, j = a[np.r_[x[needed], unsure[0]]], b[np.r_[y[needed], unsure[1]]]
            columns = [
                pa.array(np.minimum(node[i], node[j])),
                pa.array(np.maximum(node[i], node[j])),
                pa.array(np.minimum(label[i], label[j])),
                pa.array(np.maximum(label[i], label[j])),
                pa.array(np.arange(len(i)) < len(needed)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["u", "v", "low", "high", "sure"])

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) of nodes whose texts are similar enough."""
        pairs = stored(pairs, "pairs")
        texts = stored(texts_of(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()), "texts")
        both = (
            pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text")), "u")
            .join(texts.select(F.col("node").alias("v"), F.col("text").alias("other")), "v")
            .select("u", "v", "text", "other")
        )

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    alike = weighted_jaccard(part.column("text"), part.column("other"), shingle_words)
                    yield part.select(["u", "v"]).filter(pa.array(alike >= similarity - 1e-12))

        return stored(both.mapInArrow(compare, "u bigint, v bigint"), "links")

    tested = stored(shared.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct(), "tested")
    links = linked(tested)
    found = components(links)
    marked = shared.join(found, "node", "left").select("node", "bucket", F.coalesce("label", "node").alias("label"))
    more = linked(stored(pairs_across(stored(marked, "marked")), "across").join(tested, ["u", "v"], "left_anti"))
    if not more.isEmpty():
        found = components(links.unionByName(more))
    labels = nodes.join(found, "node", "left").select("content", "more", F.coalesce("label", "node").alias("label"))
    return stored(signed.select("row", "doc_id", "content", "more").join(labels, ["content", "more"]).select("row", "doc_id", "label"), "classed")


def near_duplicates(
    docs: DataFrame,
    similarity: float = 0.8,
    shingle_words: int = 5,
    bands: int = 42,
    rows: int = 7,
    sketch_size: int = 2048,
    tile: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the smallest doc_id of its class), class_size.

    Two texts are linked if the weighted Jaccard similarity of their shingles, weighted by how often each occurs, is at
    least ``similarity``; classes are what links connect. With the default bands a pair at 0.8 shares one with
    probability 0.99995, closer pairs more surely. Texts with the same shingle counts are one node from the start.

    Within a band's bucket all nodes are first compared with its smallest. Then, in buckets whose nodes fell into several
    components, every pair of nodes from different components is looked at too, so no link within a bucket is missed,
    while a bucket of copies of one text costs one comparison each. For these pairs sketches of ``sketch_size`` hashes
    decide which are worth comparing (see ``close_pairs``), block by block of ``tile`` nodes; of pairs that are sure to be
    links as many are kept as connect the components, of the others all. Every link is confirmed on whole texts.

    A null text is empty; texts without words are alike. Null ids come last in a class. Rows that repeat an id are rows of
    their own. An empty table gives an empty result; other columns are ignored. Content keys have 128 bits.
    """
    source = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    classed = labelled(stored(source, "near_input"), similarity, shingle_words, bands, rows, sketch_size, tile)
    sizes = (
        classed.groupBy("label", F.pmod("label", F.lit(7)).alias("spread"))
        .agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
        .drop("spread")
    )
    return classed.join(sizes, "label").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their class, with all columns: the smallest id, null ids last. Of several rows of
    a class under one id one stays."""
    rows = keyed(docs, "near_input")
    doc = F.col("doc")
    classed = labelled(rows.select("row", doc[id_col].alias("doc_id"), doc[text_col].cast("string").alias("text")), **options)
    kept = stored(classed.groupBy("label").agg(F.min(smallest()).alias("best")).select(F.col("best.row").alias("row")), "near_kept")
    return rows.join(kept, "row", "left_semi").select("doc.*")


def exact_links(texts: list[str], similarity: float = 0.8, shingle_words: int = 5) -> pd.DataFrame:
    """All linked pairs of a small list by brute force, for tests and for measuring recall."""
    row, shingle, count = shingles(pa.array(texts, pa.string()), shingle_words)
    bags = [dict(zip(shingle[row == k].tolist(), count[row == k].tolist(), strict=True)) for k in range(len(texts))]
    out = []
    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            common = sum(min(c, b[s]) for s, c in a.items() if s in b)
            alike = common / (sum(a.values()) + sum(b.values()) - common)
            if alike >= similarity - 1e-12:
                out.append((j, i, alike))
    return pd.DataFrame(out, columns=["i", "j", "similarity"])
