"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.scratch import slots, stored
from claimspark.llm.text import SPACED, Words, mix, slices, words

#: Tokens that no word of a text can be.
START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000002)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
#: Probes per level, on a circle of 2 ** 32 places.
_HASHES, _CIRCLE = 5, np.uint64(0xFFFFFFFF)
#: Bytes that name a pair within its segment. A segment of ten million pairs mistakes one unseen pair in 100,000 for one of
#: them, well below what the filter does.
NAME_BYTES = 5
#: Tokens that a task counts, or puts in a block, at once.
FLUSH = 1 << 20
#: Tokens of a block that are scored at once.
_CHUNK = 1 << 17


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised count: 1 for 1, 2 for 2 and 3, 3 for 4 to 7, and so on."""
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1


def typical(levels: np.ndarray) -> np.ndarray:
    """The count a level stands for, 0 for level 0."""
    return np.where(levels <= 1, levels, 0.75 * 2.0**levels)


def chain(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of the texts in order, one end after each, and how many each text has."""
    n = len(w.first) - 1
    token = np.empty(len(w.start) + n, np.uint64)
    token[np.arange(len(w.start)) + w.row] = w.hashes()
    token[w.first[1:] + np.arange(n)] = END
    return token, w.counts + 1


def pairs_of(token: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The key of each token with the one before it, which for the first of a text is its start."""
    key = np.empty_like(token)
    key[1:] = token[:-1]
    key[np.cumsum(sizes) - sizes] = START
    key *= _PAIR
    key += token
    return mix(key)


def names(keys: np.ndarray, bits: int) -> np.ndarray:
    """What tells keys of a segment (their leading ``bits``) apart: the ``NAME_BYTES`` bytes after those bits."""
    return (keys << np.uint64(bits)) >> np.uint64(64 - 8 * NAME_BYTES)


def shortened(name: np.ndarray) -> bytes:
    return name.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES].tobytes()


def lengthened(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // NAME_BYTES, 8), np.uint8)
    out[:, :NAME_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, NAME_BYTES)
    return out.view("<u8").ravel()


def whole_numbers(values: np.ndarray) -> bytes:
    """Counts as 32-bit numbers, or as 64-bit ones where one needs it."""
    return values.astype("<u4" if not len(values) or values.max() < 1 << 32 else "<i8").tobytes()


def from_whole_numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if len(raw) == 4 * n else "<i8").astype(np.int64)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs; sorts ``keys`` in place."""
    keys.sort()
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[new], np.diff(np.r_[new, len(keys)])


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where in sorted keys each segment begins, and the end."""
    starts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.r_[np.searchsorted(keys, starts), len(keys)]


def rows_by(column: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(value, rows) of every run of rows that agree in a column, row by row as they come; nothing is gathered."""
    flat = (row for batch in batches for row in zip(*batch.columns, strict=True))
    row = next(flat, None)
    while row is not None:
        value = row[column].as_py()

        def same() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[column].as_py() == value:
                yield row
                row = next(flat, None)

        yield value, same()
        for _ in same():  # what the caller left
            pass


def raw(cell) -> bytes:
    return cell.as_buffer().to_pybytes()


class Filter:
    """Bloom filter of (name, level): a name is a member up to the level of its count, and each level has probes of its own."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # True or False

    @classmethod
    def of(cls, name: np.ndarray, levels: np.ndarray, entry_bits: int) -> Filter:
        made = cls(np.zeros(-(-max(1, int(levels.sum()) * entry_bits) // 64) * 64, bool))
        for at in range(1, int(levels.max(initial=0)) + 1):
            a, b = made.probes(name[levels >= at], at)
            for _ in range(_HASHES):
                a = (a + b) & _CIRCLE
                made.bits[made.places(a)] = True
        return made

    @classmethod
    def from_bytes(cls, data: bytes) -> Filter:
        return cls(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little").view(bool))

    def to_bytes(self) -> bytes:
        return np.packbits(self.bits, bitorder="little").tobytes()

    def probes(self, name: np.ndarray, at_level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the probes of a level begin on a circle of 2 ** 32, and how far apart they are."""
        spread = mix(name ^ mix(np.full(1, at_level, np.uint64)))
        return spread >> np.uint64(32), spread | np.uint64(1)

    def places(self, a: np.ndarray) -> np.ndarray:
        return (a * np.uint64(len(self.bits)) >> np.uint64(32)).astype(np.int64)

    def levels(self, name: np.ndarray) -> np.ndarray:
        """The level up to which each name is a member: never too low for names put in, seldom too high."""
        out = np.zeros(len(name), np.int8)
        alive = np.arange(len(name))
        for at in range(1, 63):
            a, b = self.probes(name[alive], at)
            for _ in range(_HASHES):
                a = (a + b) & _CIRCLE
                member = self.bits[self.places(a)]
                a, b, alive = a[member], b[member], alive[member]
            if not len(alive):
                break
            out[alive] = at
        return out


@dataclass
class Model:
    tokens: int  # N
    distinct: int  # V
    texts: int  # ends, and so starts
    bits: int  # of a key that name its segment
    segments: DataFrame  # segment, words, counts, filter
    weight: float  # of pairs against single words


def ngram_counts(docs: DataFrame, text_col: str, bits: int, flush: int) -> DataFrame:
    """Counts of words and pairs, a row per task, ``flush`` tokens and segment: sorted, each distinct one once."""
    fields = ("words", "word_counts", "once", "often", "often_counts")
    schema = pa.schema([("segment", pa.int32()), *[(c, pa.binary()) for c in fields]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        pairs: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            word, n = counted(np.concatenate(tokens))
            tokens.clear()
            pair, m = counted(np.concatenate(pairs))
            pairs.clear()
            of_words, of_pairs, name = cuts(word, bits), cuts(pair, bits), names(pair, bits)
            columns: list[list] = [[] for _ in range(6)]
            for s in range(1 << bits):
                a, b, c, d = of_words[s], of_words[s + 1], of_pairs[s], of_pairs[s + 1]
                if a < b or c < d:
                    many = m[c:d] > 1
                    own = name[c:d]
                    values = (
                        s, word[a:b].tobytes(), whole_numbers(n[a:b]), shortened(own[~many]), shortened(own[many]),
                        whole_numbers(m[c:d][many]),
                    )
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for part in slices(batch, "text"):
                token, sizes = chain(words(part.column(0), SPACED))
                tokens.append(token)
                pairs.append(pairs_of(token, sizes))
                if sum(map(len, tokens)) >= flush:
                    yield send()
        if tokens:
            yield send()

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(count, "segment int, " + ", ".join(f"{c} binary" for c in fields))


def train(
    docs: DataFrame, text_col: str = "text", entry_bits: int = 12, weight: float = 0.6, flush: int = FLUSH
) -> Model:
    """A model of the texts of ``docs``: exact counts of their words, and a filter of all words and pairs.

    Words and neighbouring pairs go to segments by the leading bits of their hashes, counted ``flush`` tokens at a time. A
    segment's counts are added up and put in a filter of its own, with ``entry_bits`` for each level of each entry, those
    that came once too; so the model grows with the corpus, and it stays a table of segments of which a task holds one at
    a time. An empty table gives a model that knows no word.
    """
    bits = max(4, (4 * slots(docs.sparkSession) - 1).bit_length())
    schema = pa.schema(
        [("segment", pa.int32()), *[(c, pa.binary()) for c in ("words", "counts", "filter")]]
        + [(c, pa.int64()) for c in ("tokens", "distinct", "texts")]
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, rows in rows_by(0, batches):
            parts: list[list[np.ndarray]] = [[] for _ in range(4)]
            for _, word, n, once, often, m in rows:
                word = np.frombuffer(raw(word), np.uint64)
                one, many = lengthened(raw(once)), lengthened(raw(often))
                parts[0].append(word)
                parts[1].append(from_whole_numbers(raw(n), len(word)))
                parts[2] += [one, many]
                parts[3] += [np.ones(len(one), np.int64), from_whole_numbers(raw(m), len(many))]
            word, n = added(*(np.concatenate(x) for x in parts[:2]))
            pair, m = added(*(np.concatenate(x) for x in parts[2:]))
            made = Filter.of(np.concatenate([names(word, bits), pair]), level(np.concatenate([n, m])), entry_bits)
            ends = int(n[word == END].sum())
            values = (segment, word.tobytes(), whole_numbers(n), made.to_bytes(), int(n.sum()), len(word), ends)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, schema.types, strict=True)], schema=schema)

    sent = ngram_counts(docs, text_col, bits, flush).repartition("segment").sortWithinPartitions("segment")
    made = stored(
        sent.mapInArrow(
            merge, "segment int, words binary, counts binary, filter binary, tokens bigint, distinct bigint, texts bigint"
        ),
        "lm_segments",
    )
    sums = made.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "distinct", "texts")]).first()
    return Model(sums["tokens"], sums["distinct"], sums["texts"], bits, made.select("segment", "words", "counts", "filter"), weight)


def in_blocks(rows: DataFrame, flush: int) -> DataFrame:
    """Tokens of the texts in blocks of about ``flush``, a row each: ids of its texts, how many tokens each has, the distinct
    tokens of the block from frequent to rare, and which of them each token is.

    Most places fit 16 bits; where they hold 65535, the place is in ``more``, in order.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        tokens: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            unique, of, n = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            of = place[of]
            all_ids = pa.concat_arrays(ids)
            blobs = (
                np.concatenate(sizes).astype("<u4"), unique[order], np.minimum(of, 65535).astype("<u2"), of[of >= 65535].astype("<u4")
            )
            columns = [
                pa.ListArray.from_arrays(pa.array([0, len(all_ids)], pa.int32()), all_ids),
                *(pa.array([x.tobytes()], pa.binary()) for x in blobs),
            ]
            for x in (ids, sizes, tokens):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_ids", "sizes", "words", "places", "more"])

        for batch in batches:
            for part in slices(batch, "text"):
                token, n = chain(words(part.column("text"), SPACED))
                ids.append(part.column("doc_id"))
                sizes.append(n)
                tokens.append(token)
                if sum(map(len, tokens)) >= flush:
                    yield send()
        if ids:
            yield send()

    made = rows.mapInArrow(gather, f"doc_ids array<{kind}>, sizes binary, words binary, places binary, more binary")
    return stored(made.withColumn("block", F.monotonically_increasing_id()), "lm_blocks")


@dataclass
class Block:
    sizes: np.ndarray
    words: np.ndarray
    of: np.ndarray  # which word each token is

    @classmethod
    def opened(cls, sizes: bytes, unique: bytes, places: bytes, more: bytes) -> Block:
        of = np.frombuffer(places, "<u2").astype(np.uint32)
        of[of == 65535] = np.frombuffer(more, "<u4")
        return cls(np.frombuffer(sizes, "<u4").astype(np.int64), np.frombuffer(unique, np.uint64), of)

    def pairs(self, bits: int) -> np.ndarray:
        """Segment and name of each token's pair, as one number."""
        return pairs_of(self.words[self.of], self.sizes) >> np.uint64(64 - bits - 8 * NAME_BYTES)


def answers(blocks: DataFrame, model: Model) -> DataFrame:
    """For each block and segment the exact counts and the levels of the block's distinct words in that segment and the levels
    of its distinct pairs, all in the order of their hashes.

    Questions of all blocks stream past a segment, one block's at a time.
    """
    bits = model.bits

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *blobs in zip(*batch.columns, strict=True):
                b = Block.opened(*map(raw, blobs))
                pair, _ = counted(b.pairs(bits))
                word = np.sort(b.words)
                of_words = cuts(word, bits)
                of_pairs = cuts(pair << np.uint64(64 - bits - 8 * NAME_BYTES), bits)
                pair &= np.uint64((1 << 8 * NAME_BYTES) - 1)
                some = np.flatnonzero((np.diff(of_words) > 0) | (np.diff(of_pairs) > 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.int32()),
                        pa.array([block.as_py()] * len(some), pa.int64()),
                        pa.array([word[of_words[s] : of_words[s + 1]].tobytes() for s in some], pa.binary()),
                        pa.array([shortened(pair[of_pairs[s] : of_pairs[s + 1]]) for s in some], pa.binary()),
                    ],
                    ["segment", "block", "words", "pairs"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for segment, rows in rows_by(0, batches):
            known, counts, members = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
            for _, block, word, pair, n, data in rows:
                word = np.frombuffer(raw(word), np.uint64)
                if not block.is_valid:  # the segment comes before all questions
                    known, counts = word, from_whole_numbers(raw(n), len(word))
                    members = Filter.from_bytes(raw(data))
                    continue
                pair = lengthened(raw(pair))
                found = np.zeros(len(word), np.int64)
                if len(known):
                    near = np.minimum(np.searchsorted(known, word), len(known) - 1)
                    found = np.where(known[near] == word, counts[near], 0)
                levels = [members.levels(x) if members else np.zeros(len(x), np.int8) for x in (names(word, bits), pair)]
                values = [block.as_py(), segment, whole_numbers(found), *(x.tobytes() for x in levels)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in zip(values, [pa.int64(), pa.int32(), *[pa.binary()] * 3], strict=True)],
                    ["block", "segment", "counts", "word_levels", "pair_levels"],
                )

    asked = blocks.select("block", "sizes", "words", "places", "more").mapInArrow(
        ask, "segment int, block bigint, words binary, pairs binary"
    )
    nothing = F.lit(None).cast("binary")
    segments = model.segments.select(
        "segment", F.lit(None).cast("bigint").alias("block"), "words", nothing.alias("pairs"), "counts", "filter"
    )
    both = segments.unionByName(asked, allowMissingColumns=True)
    return (
        both.repartition("segment")
        .sortWithinPartitions("segment", F.col("block").asc_nulls_first())
        .mapInArrow(answer, "block bigint, segment int, counts binary, word_levels binary, pair_levels binary")
    )


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", flush: int = FLUSH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``base_score`` uses the exact counts of the model's words. ``score`` uses the filter alone: a word's probability is that of
    the pair with the word before, mixed with its own, both from quantised counts. A null text is empty; its only token is
    its end. The model is not broadcast, since it grows with the corpus: texts are cut into blocks of about ``flush`` tokens
    (a longer text is one of its own), each block's distinct words and pairs are looked up in the segments, and the
    answers come back to the block. Rows are scored one by one, whatever ids they have. An empty table gives no rows; a model
    of no texts knows no word.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    blocks = in_blocks(rows, flush)
    bits, texts, weight, tokens = model.bits, model.texts, model.weight, model.tokens
    scale = tokens + 0.1 * (model.distinct + 1)

    def scored(block: Block, parts: list[tuple[bytes, bytes, bytes]]) -> list[np.ndarray]:
        order = np.argsort(block.words)
        count, single = np.empty(len(order), np.int64), np.empty(len(order))
        count[order] = np.concatenate([from_whole_numbers(n, len(x)) for n, x, _ in parts])
        single[order] = typical(np.frombuffer(b"".join(x for _, x, _ in parts), np.int8).astype(np.int64))
        both = np.frombuffer(b"".join(x for _, _, x in parts), np.int8)
        pair = block.pairs(bits)
        by_pair = np.argsort(pair)
        pair = pair[by_pair]
        new = np.r_[True, pair[1:] != pair[:-1]]
        of_pair = np.empty(len(pair), np.int8)  # the level of each token's pair
        of_pair[by_pair] = both[np.cumsum(new) - 1]
        first = np.cumsum(block.sizes) - block.sizes
        row = np.repeat(np.arange(len(first)), block.sizes)
        base, lm, known = np.zeros(len(first)), np.zeros(len(first)), np.zeros(len(first), np.int64)
        log = np.log10((count + 0.1) / scale)
        for at in range(0, len(row), _CHUNK):
            own, of = row[at : at + _CHUNK], block.of[at : at + _CHUNK]
            before = single[block.of[np.maximum(np.arange(at, at + len(of)) - 1, 0)]]
            begins = first[(first >= at) & (first < at + len(of))] - at
            before[begins] = texts
            p1 = (single[of] + 0.1) / scale
            p2 = np.minimum(1.0, typical(of_pair[at : at + _CHUNK].astype(np.int64)) / np.maximum(before, 1.0))
            a, b = own[0], own[-1] + 1
            base[a:b] += np.bincount(own - a, log[of], b - a)
            lm[a:b] += np.bincount(own - a, np.log10(weight * p2 + (1 - weight) * p1), b - a)
            known[a:b] += np.bincount(own - a, count[of] > 0, b - a).astype(np.int64)
        return [known, base, lm]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows_ in rows_by(0, batches):
            block, ids, parts = None, None, []
            for _, segment, doc_ids, sizes, unique, places, more, *found in rows_:
                if segment.as_py() < 0:  # the block comes before its answers
                    block, ids = Block.opened(*map(raw, (sizes, unique, places, more))), doc_ids.values
                else:
                    parts.append(tuple(map(raw, found)))
            columns = [ids, pa.array(block.sizes, pa.int64()), *map(pa.array, scored(block, parts))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    found = stored(answers(blocks, model), "lm_answers")  # the questions go from disk before blocks and answers meet
    asking = blocks.withColumn("segment", F.lit(-1)).unionByName(found, allowMissingColumns=True)
    order = ("block", "segment", "doc_ids", "sizes", "words", "places", "more", "counts", "word_levels", "pair_levels")
    return (
        asking.select(*order)
        .repartition("block")
        .sortWithinPartitions("block", "segment")
        .mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
        .select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
    )
