"""Best-fit packing of token sequences in bulk-synchronous supersteps."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.scratch import slots, stored
from claimspark.llm.text import SPACED, slices, words

#: The one kind of tokenizer whose texts are put together from words: what it does before it looks at single words.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = r'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])'
_SPLIT = (
    f'Sequence(pretokenizers=[Split(pattern=Regex("{_WORD_PATTERN}"), behavior=Removed, invert=True), '
    "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])"
)
#: White space beyond ASCII blanks, the start of special tokens, and a letter whose small form has two characters.
_ODD = re.compile("[\x1c-\x1f\x85\xa0İ]|<\\|")
_BEYOND_LATIN = re.compile("[ɐ-\U0010ffff]")


class Vocabulary:
    """Token ids by word hash: sorted hashes, and for each the place and number of its ids in one pool.

    When more than ``most`` words are known, those that no batch had since the last time go, or all if these are few.
    """

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.used = np.zeros(0, bool)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.filled = 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted ``keys``, and which of them are known."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        self.used[at[known]] = True
        return at, known

    def add(self, keys: np.ndarray, ids: list[np.ndarray]) -> None:
        """Ids of new, sorted ``keys``."""
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.concatenate(ids)
        if self.filled + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.filled], np.zeros(self.filled + len(new), np.uint32)])
        self.pool[self.filled : self.filled + len(new)] = new
        at = np.searchsorted(self.keys, keys)
        self.start = np.insert(self.start, at, self.filled + np.cumsum(length) - length)
        self.length = np.insert(self.length, at, length)
        self.used = np.insert(self.used, at, True)
        self.keys = np.insert(self.keys, at, keys)
        self.filled += len(new)

    def shrink(self) -> None:
        """Called between batches."""
        if len(self.keys) <= self.most:
            return
        keep = self.used
        if 2 * keep.sum() > self.most:
            self.clear()
            return
        start, length = self.start[keep], self.length[keep]
        self.pool = self.pool[gathered(start, length)]
        self.filled = len(self.pool)
        self.keys, self.start, self.length = self.keys[keep], np.cumsum(length) - length, length
        self.used = np.zeros(len(length), bool)


def gathered(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ..., ``length`` of them, for each start, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Token ids of whole texts.

    A tokenizer that lower-cases and never joins across blanks gives a word the same ids wherever it stands, and most
    words of a corpus come again and again. So a batch's distinct words are looked up, those not known yet are tokenized in
    one call, and the ids of all its texts are gathered at once by places. Words of Latin letters are lower-cased and split
    here, by the tokenizer's own pattern; in the simple range up to U+024F that is the same in any version of Unicode.
    Other words go through the whole tokenizer, those with unusual white space or special tokens one by one. With
    tokenizers of another kind whole texts do.
    """

    def __init__(self, path: str, most_words: int = 1_500_000):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        blanks = any(re.search(r"\s", t.content) or t.lstrip or t.rstrip for t in self.tokenizer.get_added_tokens_decoder().values())
        simple = str(self.tokenizer.normalizer) == _NORMAL and str(self.tokenizer.pre_tokenizer) == _SPLIT
        self.by_words = simple and not blanks
        self.bare = Tokenizer(self.tokenizer.model)  # for words that are lower-cased and split
        self.bare.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.pattern = regex.compile(_WORD_PATTERN)
        self.known = Vocabulary(most_words)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def look_up(self, tokenizer, parts: list[str]) -> list[np.ndarray]:
        """Ids of each of a list of words: all in one call, then cut where the tokenizer says a word ends."""
        out: list[np.ndarray] = []
        for at in range(0, len(parts), 20_000):
            some = parts[at : at + 20_000]
            encoding = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(encoding.ids, np.uint32)
            cuts = np.searchsorted(np.array(encoding.word_ids, np.int64), np.arange(len(some) + 1)).tolist()
            out += [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def learn(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of words: of letters as they are, of others from the parts the pattern finds."""
        ids: dict[str, np.ndarray] = {}
        latin: list[str] = []
        others: list[str] = []
        for t in texts:
            if _ODD.search(t):
                ids[t] = self.whole(t)
            else:
                (latin if t.isascii() or not _BEYOND_LATIN.search(t) else others).append(t)
        ids.update(zip(others, self.look_up(self.tokenizer, others), strict=True))
        low = [t.lower() for t in latin]
        find = self.pattern.findall
        split = {t: [t] if t.isalpha() else find(t) for t in set(low)}
        parts = list({p for ps in split.values() for p in ps})
        of_part = dict(zip(parts, self.look_up(self.bare, parts), strict=True))
        none = np.zeros(0, np.uint32)
        for t, small in zip(latin, low, strict=True):
            ps = split[small]
            ids[t] = of_part[ps[0]] if len(ps) == 1 else np.concatenate([of_part[p] for p in ps]) if ps else none
        return [ids[t] for t in texts]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column, one after the other, and how many each has; nulls are empty."""
        if not self.by_words:
            every = [self.whole(t or "") for t in column.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *every]), np.array([len(x) for x in every], np.int64)
        w = words(column, SPACED, fold=False)
        keys, first, of = np.unique(w.hashes(), return_index=True, return_inverse=True)
        self.known.shrink()
        new = np.flatnonzero(~self.known.find(keys)[1])
        if len(new):
            cut = first[new]
            texts = [w.data[a:b].tobytes().decode() for a, b in zip(w.start[cut].tolist(), w.end[cut].tolist(), strict=True)]
            self.known.add(keys[new], self.learn(texts))
        at, _ = self.known.find(keys)
        length = self.known.length[at][of]
        ids = self.known.pool[gathered(self.known.start[at][of], length)]
        sums = np.concatenate([[0], np.cumsum(length)])
        return ids, np.diff(sums[w.first])


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One per worker process, so that words stay known from task to task."""
    return Encoder(path)


def token_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (),
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, the columns ``keep``, piece, start, length, ids_crc32, and the ids if
    asked for.

    ``tokenizer`` is the path of a vocabulary file that every executor has. A document is its tokens and ``end_id``; a
    null or empty text is ``end_id`` alone. Only documents longer than ``capacity`` are cut.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, lengths = ids_of.encode(part.column("text"))
                ends = np.cumsum(lengths)
                ids = np.insert(ids, ends, end_id)
                lengths = lengths + 1
                pieces = -(-lengths // capacity)
                row = np.repeat(np.arange(len(lengths)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(capacity, lengths[row] - piece * capacity)
                cuts = np.r_[0, np.cumsum(length)]
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
                columns = [
                    *[part.column(c).take(pa.array(row)) for c in ("doc_id", *keep)],
                    pa.array(piece, pa.int32()),
                    pa.array(piece * capacity),
                    pa.array(length),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", *keep, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))
    schema = f"{kinds}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return rows.mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))


def here(df: DataFrame) -> DataFrame:
    """A table of counts by size, at most some capacity rows, known and in one partition from here on."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema).coalesce(1)


def dealt(df: DataFrame, size: str, order: Sequence[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``df`` written with ``part`` and ``line``; and ``shift`` and ``n``, the number of rows, by size and part.

    Line and shift make a row's rank: its place from 0 among the rows of its ``size`` in ``order``. Rows are range-sorted over
    all tasks, so equal sizes spread over as many tasks as they fill. A rank is the place in the task plus the rows of that
    size in the tasks before; those counts have one row per size and task boundary, at most capacity + tasks for whole
    numbers up to the capacity, and pass through the driver.
    """
    parts = -(-slots(df.sparkSession) // 8)  # rows are narrow
    in_order = df.repartitionByRange(parts, size, *order).sortWithinPartitions(size, *order)
    placed = stored(
        in_order.withColumn("part", F.spark_partition_id()).withColumn("line", F.monotonically_increasing_id()), name
    )
    before = Window.partitionBy(size).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    known = here(placed.groupBy(size, "part").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n")))
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_line")
    return placed, known.select(size, "part", shift.alias("shift"), "n")


def places_of(by_gap: DataFrame, longest: int) -> DataFrame:
    """The places that gaps have for documents of up to ``longest`` tokens: gap, size, of_one (places of that size in a gap) and
    n (in all gaps of that length), and other columns of ``by_gap``.

    A gap that is long enough for several documents is cut into places of ``longest``; what is over goes to its last one.
    """
    others = [c for c in by_gap.columns if c not in ("gap", "n")]
    times = F.greatest(F.lit(1), F.floor(F.col("gap") / longest)).cast("bigint")
    last = F.struct((F.col("gap") - (times - 1) * longest).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("of_one"))
    full = F.struct(F.lit(longest).cast("bigint").alias("size"), (times - 1).alias("of_one"))
    return (
        by_gap.select("*", F.explode(F.array(last, full)).alias("place"))
        .where("place.of_one > 0")
        .select("gap", "place.size", "place.of_one", (F.col("n") * F.col("place.of_one")).alias("n"), *others)
    )


def sweep(left: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Which documents find a place in a superstep, and which places: from counts by size.

    ``left`` (length, first, n) are documents with ranks from ``first`` up to ``n`` of their length, ``places`` (size, n, gap
    and more) counts of open places. From long to short, every document looks for a place that is long enough and none
    before it took, and takes the first of them. With D documents and G places at or above a size that makes U = D + min(0,
    min(G - D)) matches at or above it, the minimum over all sizes down to it: a match is lost wherever documents outnumber
    places. Of a length, the documents of the lowest ranks are matched, and match number k is with place number k.

    The result is ``left`` with matched and match (the number of its first match), and ``places`` with place_number (that of
    its first place). Sizes are whole numbers up to the capacity, which bounds the rows of these windows for any input.
    """
    documents = (F.col("n") - F.col("first")).alias("documents")
    both = (
        places.select("size", F.col("n").alias("places"))
        .unionByName(left.select(F.col("length").alias("size"), "first", "n", documents), allowMissingColumns=True)
        .coalesce(1)  # counts by size
        .groupBy("size")
        .agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("places", "documents")],
            *[F.max(c).alias(c) for c in ("first", "n")],  # of the one row that ``left`` has of a length, null elsewhere
        )
    )
    down = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        both.withColumn("g", F.sum("places").over(down))
        .withColumn("d", F.sum("documents").over(down))
        .withColumn("u", F.col("d") + F.least(F.lit(0), F.min(F.col("g") - F.col("d")).over(down)))
        .withColumn("u_before", F.coalesce(F.lag("u").over(Window.orderBy(F.desc("size"))), F.lit(0)))
    )
    of_length = runs.where("n IS NOT NULL").select(
        F.col("size").alias("length"), "first", "n", (F.col("u") - F.col("u_before")).alias("matched"), F.col("u_before").alias("match")
    )
    larger = Window.orderBy(F.desc("size"), F.desc("gap"), "of_one").rowsBetween(Window.unboundedPreceding, 0)
    return of_length, places.withColumn("place_number", F.sum("n").over(larger) - F.col("n"))


def pack(
    pieces: DataFrame,
    capacity: int = 4096,
    bands: Sequence[int] = (1, 2, 3, 4, 5, 6, 9, 14, 24, 48),
    last_rounds: int = 8,
) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to ``capacity``) with sequence_id and offset, by best fit.

    Lengths are taken from ``capacity`` down in bands that end below ``capacity`` divided by the next of ``bands``. A superstep
    range-sorts the open gaps, sweeps over documents and the gaps' places by size (see ``sweep``), joins those of the same
    match, and updates the gaps. What finds no place opens new sequences, in order of length and as many documents in each as
    fit of the longest. Below the last band nothing is left to fill gaps with, so there new sequences are opened for the tokens that are left, and the superstep
    goes on placing documents, ``last_rounds`` times at most.

    Documents and gaps stay distributed: ranks and matches are found by range sorts and joins on unique numbers, and what is
    broadcast or passes through the driver are counts by size, some ``capacity`` rows for any input. The sweep over them stays
    in one partition, without shuffles and broadcasts: each of those costs the driver threads and buffers, however small the
    table. Equal lengths and repeated rows are told apart by their rank. An empty table gives an empty result. Other columns
    are kept.
    """
    spark = pieces.sparkSession
    key = "piece_row"
    while key in pieces.columns:
        key += "_"
    named = stored(pieces.withColumn(key, F.monotonically_increasing_id()), "pack_pieces")
    lines, shifts = dealt(named.select("length", F.col(key).alias("_row")), "length", ["_row"], "pack_documents")
    by_length = shifts.groupBy("length").agg(F.sum("n").alias("n"))
    wrong = by_length.where(f"length IS NULL OR NOT length BETWEEN 1 AND {capacity}").limit(5).collect()
    if wrong:
        raise ValueError(f"lengths outside 1 to {capacity}: {[r['length'] for r in wrong]}")
    rank = (F.col("line") + F.col("shift")).alias("rank")
    docs = stored(lines.join(F.broadcast(shifts), ["length", "part"]).select("length", "_row", rank), "pack_ranked")
    tops = [capacity // s for s in bands]
    limits = [(top, low) for top, low in zip(tops, [*tops[1:], 0], strict=True) if top > low]
    number_of_band = band_of(limits)
    totals = by_length.groupBy(number_of_band.alias("band")).agg(
        F.max("length").alias("longest"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("length")).alias("tokens")
    )
    filled = sorted(totals.collect(), key=lambda r: r["band"])  # a row per band
    steps: list[DataFrame] = []
    gaps = spark.createDataFrame([], "sequence_id bigint, gap bigint")
    opened = 0

    for rest in filled:
        band, last = rest["band"], rest is filled[-1]
        own = docs.where((F.col("length") > limits[band][1]) & (F.col("length") <= limits[band][0]))
        left = by_length.where(number_of_band == band).select("length", F.lit(0).cast("bigint").alias("first"), "n")
        for turn in range(last_rounds if last else 1):
            # Once sequences are open for what is left, supersteps go on while they place a tenth of it.
            finish = not last or turn == last_rounds - 1 or (turn > 1 and 10 * placed_now < rest["n"])
            if turn == 1:
                more = -(-rest["tokens"] // capacity)
                fresh = spark.range(opened, opened + more).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("bigint").alias("gap"))
                gaps, opened = gaps.unionByName(fresh), opened + more
            numbered = None
            found = left.withColumns({"matched": F.lit(0).cast("bigint"), "match": F.lit(0).cast("bigint")})
            if opened:
                lines, shifts = dealt(gaps, "gap", ["sequence_id"], "pack_gaps")
                gaps = lines.select("sequence_id", "gap")
                parts = F.collect_list(F.struct("part", "shift")).alias("parts")  # a size is in several only at their boundaries
                by_gap = shifts.where(F.col("gap") > limits[band][1]).groupBy("gap").agg(F.sum("n").alias("n"), parts)
                found, places = sweep(left, places_of(by_gap, rest["longest"]))
                # Of the places only those of a match become rows: the numbers below the documents that look for one.
                wanted = places.where(F.col("place_number") < rest["n"]).select("gap", "place_number", "of_one", F.inline("parts"))
                start = F.col("place_number") + (F.col("line") + F.col("shift")) * F.col("of_one")
                end = F.least(start + F.col("of_one"), F.lit(rest["n"])) - 1
                numbered = (
                    lines.join(F.broadcast(wanted), ["gap", "part"])
                    .where(start < rest["n"])
                    .select("sequence_id", F.explode(F.sequence(start, end)).alias("number"))
                )
            counts = with_waiting(found, capacity).collect()  # by length
            found = spark.createDataFrame(counts, FOUND).coalesce(1)
            waiting = [r for r in counts if r["waiting"]]
            placed_now = sum(r["matched"] for r in counts)
            rest = {
                "longest": max((r["length"] for r in waiting), default=0),
                "n": sum(r["waiting"] for r in waiting),
                "tokens": sum(r["waiting"] * r["length"] for r in waiting),
            }
            # A match number, or for those without one a new sequence, from the document's rank among those of its length.
            after = F.col("rank") - F.col("first") - F.col("matched")
            taken = own.join(F.broadcast(found.withColumnRenamed("length", "of_length")), F.col("length") == F.col("of_length")).where(
                F.col("rank") >= F.col("first")
            )
            fresh = (F.lit(opened) + F.floor((F.col("before") + after) / F.col("of_one"))).cast("bigint")
            step = taken.where((after >= 0) & F.lit(finish)).select("_row", "length", fresh.alias("sequence_id"))
            if numbered is not None and placed_now:
                number = (F.col("match") + F.col("rank") - F.col("first")).alias("number")
                matches = taken.where(after < 0).select("_row", "length", number)
                found_place = matches.join(numbered, "number").drop("number")
                step = step.unionByName(found_place) if finish and waiting else found_place
            steps.append(stored(step, "pack_step"))
            if finish and waiting:
                opened += -(-rest["n"] // max(r["of_one"] for r in waiting))
            if last and (finish or not rest["n"]):
                break
            gaps = with_gaps_left(gaps, steps[-1], capacity)
            left = found.where("waiting > 0").select("length", (F.col("first") + F.col("matched")).alias("first"), "n")
    if not steps:
        return pieces.withColumn("sequence_id", F.lit(None).cast("bigint")).withColumn("offset", F.lit(None).cast("bigint"))
    placed = steps[0]
    for step in steps[1:]:
        placed = placed.unionByName(step)
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "_row")  # at most capacity rows
    placed = placed.withColumn("offset", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    where = placed.select("_row", "sequence_id", "offset")
    return named.join(where, named[key] == where["_row"]).select(*[named[c] for c in pieces.columns], "sequence_id", "offset")


def with_waiting(found: DataFrame, capacity: int) -> DataFrame:
    """A sweep's rows by length with waiting, the documents without a match, before, those of greater lengths, and of_one, how many
    of the longest of them go in a sequence."""
    down = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)  # at most capacity rows
    longest = F.max(F.when(F.col("waiting") > 0, F.col("length"))).over(down)  # of the lengths so far, which is the first's
    return (
        found.withColumn("waiting", F.col("n") - F.col("first") - F.col("matched"))
        .withColumn("before", F.sum("waiting").over(down) - F.col("waiting"))
        .withColumn("of_one", F.floor(F.lit(capacity) / longest))
        .select("length", "first", "matched", "match", "n", "waiting", "before", "of_one")
    )


#: Columns of ``with_waiting``.
FOUND = ", ".join(f"{c} bigint" for c in ("length", "first", "matched", "match", "n", "waiting", "before", "of_one"))


def with_gaps_left(gaps: DataFrame, step: DataFrame, capacity: int) -> DataFrame:
    """Gaps after the documents of ``step`` went in; sequences that weren't there yet are new."""
    taken = step.select("sequence_id", (-F.col("length")).alias("gap"), F.lit(0).alias("old"))
    every = gaps.select("sequence_id", "gap", F.lit(1).alias("old")).unionByName(taken).groupBy("sequence_id")
    full = F.sum("gap") + F.when(F.max("old") == 0, F.lit(capacity)).otherwise(F.lit(0))
    return every.agg(full.alias("gap")).where("gap > 0")


def band_of(limits: Sequence[tuple[int, int]]):
    """The number of the band that ``length`` is in."""
    found = F.lit(None).cast("int")
    for k, (_, low) in reversed(list(enumerate(limits))):
        found = F.when(F.col("length") > low, F.lit(k)).otherwise(found)
    return found


def sequences(packed: DataFrame) -> DataFrame:
    """Whole sequences from ``pack`` of pieces with ids: sequence_id, ids, and the length of each document part in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # at most capacity tokens
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.length").alias("lengths")
    )
