"""Periodic runs of words: minimizers on growing scales seed them, direct lag scans find those with short periods."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.llm.text import SPACED, mix, slices, words

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Periods up to this one are looked for by comparing words that far apart.
DIRECT = 8
#: Words turned into text at once when a text is collapsed.
_CHUNK = 1 << 16


def smaller_period(root: np.ndarray) -> np.ndarray:
    """For each row, one period of a run, whether a part of it repeated gives the same."""
    width = root.shape[1]
    found = np.zeros(len(root), bool)
    for p in range(1, width // 2 + 1):
        if width % p == 0:
            found |= (root[:, p:] == root[:, :-p]).all(axis=1)
    return found


def short_runs(token: np.ndarray, row: np.ndarray, least: int, exponent: int) -> list[np.ndarray]:
    """(start, end, period) of runs with periods up to ``DIRECT``: per lag, stretches of words equal to the word a lag on."""
    found = []
    for lag in range(1, min(DIRECT, len(token) - 1) + 1):
        same = np.zeros(len(token) + 2, np.int8)
        same[1 : len(token) - lag + 1] = (token[:-lag] == token[lag:]) & (row[:-lag] == row[lag:])
        turn = np.diff(same)
        start, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1) + lag
        long = end - start >= max(least, exponent * lag)
        start, end = start[long], end[long]
        if len(start):
            first = ~smaller_period(token[start[:, None] + np.arange(lag)])
            found.append(np.stack([start[first], end[first], np.full(first.sum(), lag)]))
    return found


def window_minima(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values: of a block's rest and of the next block's beginning."""
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    blocks = full.reshape(-1, width)
    begin = np.minimum.accumulate(blocks, axis=1).ravel()
    rest = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(rest[:n], begin[width - 1 : width - 1 + n])


def seeds(gram: np.ndarray, first: np.ndarray, row: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances, over scale / 2 and up to ``scale``, at which the same minimizer comes again in a text.

    A minimizer is the place of the smallest hash of ``scale`` words among scale / 2 consecutive places. A run of four
    periods holds a window of places and the same window a period later; what is smallest in one is smallest in the other, and
    since the hashed stretch is no shorter than the period, it doesn't occur in between. So every run has a seed.
    """
    width = scale // 2
    reach = width + scale - 1  # words that a window's hashes cover
    bits = np.uint64(len(gram).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    # The place in the last bits breaks ties to the left, in a window as in its repetition.
    least = window_minima((gram & ~low) | np.arange(len(gram), dtype=np.uint64), width)
    inside = np.flatnonzero(np.arange(len(least)) + reach <= first[row[: len(least)] + 1])
    place = (least[inside] & low).astype(np.int64)
    place = place[np.r_[True, place[1:] != place[:-1]][: len(place)]]
    order = np.lexsort((gram[place], row[place]))
    place = place[order]
    near = np.diff(place)
    same = (gram[place[1:]] == gram[place[:-1]]) & (row[place[1:]] == row[place[:-1]]) & (near > width) & (near <= scale)
    return place[:-1][same], near[same]


def equal_from(token: np.ndarray, at: int, lag: int, end: int) -> int:
    """How many words from ``at`` on equal the word a lag on, before ``end``."""
    n, step = 0, 64
    while at + lag + n < end:
        stop = min(at + n + step, end - lag)
        other = token[at + n : stop] != token[at + n + lag : stop + lag]
        if other.any():
            return n + int(other.argmax())
        n, step = stop - at, 2 * step
    return n


def equal_before(token: np.ndarray, at: int, lag: int, begin: int) -> int:
    """How many words before ``at`` equal the word a lag on, from ``begin`` on."""
    n, step = 0, 64
    while at - n > begin:
        stop = max(at - n - step, begin)
        other = (token[stop : at - n] != token[stop + lag : at - n + lag])[::-1]
        if other.any():
            return n + int(other.argmax())
        n, step = at - stop, 2 * step
    return n


def extended(
    token: np.ndarray, first: np.ndarray, row: np.ndarray, place: np.ndarray, lag: np.ndarray, least: int, exponent: int
) -> list[np.ndarray]:
    """(start, end, period) of the long enough runs around seeds; seeds within a run already extended are passed over."""
    found, done, last = [], -1, (-1, -1)
    order = np.lexsort((place, lag, row[place]))
    for at, q in zip(place[order].tolist(), lag[order].tolist(), strict=True):
        doc = int(row[at])
        if (doc, q) == last and at < done:
            continue
        done, last = at + equal_from(token, at, q, int(first[doc + 1])), (doc, q)
        start, end = at - equal_before(token, at, q, int(first[doc])), done + q
        if end - start >= max(least, exponent * q) and not smaller_period(token[None, start : start + q])[0]:
            found.append(np.array([[start], [end], [q]]))
    return found


def find_runs(token: np.ndarray, first: np.ndarray, least: int = 6, exponent: int = 4) -> np.ndarray:
    """Runs in texts of ``token`` that begin at ``first`` (n + 1 places): rows (text, start, length, period), sorted.

    A run is a stretch with smallest period q, of at least ``least`` and ``exponent`` (4 or more) times q tokens, that no
    neighbour extends. Scales double; a scale only looks at texts that are long enough for its periods.
    """
    if exponent < 4:
        raise ValueError("a seed is only certain in runs of four periods or more")
    sizes = np.diff(first)
    row = np.repeat(np.arange(len(sizes)), sizes)
    found = short_runs(token, row, least, exponent)
    gram, width, scale = token, 1, 2 * DIRECT
    live = np.arange(len(sizes))
    own, begins, texts = token, first, row
    origin = np.arange(len(token))
    while len(live := live[sizes[live] >= exponent * (scale // 2 + 1)]):
        if len(live) < len(begins) - 1:  # shorter texts go
            keep = np.isin(row[origin], live)
            origin, own, gram = origin[keep], own[keep], gram[keep]
            begins = np.r_[0, np.cumsum(sizes[live])]
            texts = np.repeat(np.arange(len(live)), sizes[live])
        while width < scale:  # hashes of twice as many words, from those of two halves
            after = np.zeros_like(gram)
            after[:-width] = gram[width:]
            gram, width = mix(gram * _STEP + after), 2 * width
        for start, end, q in extended(own, begins, texts, *seeds(gram, begins, texts, scale), least, exponent):
            found.append(np.array([origin[start], origin[end - 1] + 1, q]))
        scale *= 2
    if not found:
        return np.zeros((0, 4), np.int64)
    start, end, q = np.concatenate(found, axis=1)
    doc = row[start]
    runs = np.stack([doc, start - first[doc], end - start, q], axis=1)
    return runs[np.lexsort((q, start))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(change[:-1]) == 0


def periodic_runs(
    docs: DataFrame, least: int = 6, exponent: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs and collapsed.

    Words are what blanks separate; case counts. ``runs`` lists (start, length, period) in words from 0 by start and period,
    see ``find_runs``. ``collapsed`` is the text without the words that any run holds after its first period, joined by one
    space.

    Each row is worked on alone, whole, in slices of bounded size; nothing is shuffled. A null or empty text has no words, no
    runs and an empty ``collapsed``. Rows that repeat, and null ids, give a row each. An empty table gives an empty result, other
    columns are ignored. Words are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spot = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), SPACED, fold=False)
                runs = find_runs(w.hashes(), w.first, least, exponent)
                cuts = np.searchsorted(runs[:, 0], np.arange(part.num_rows + 1))
                texts = []
                for k, (a, b) in enumerate(zip(w.first, w.first[1:], strict=False)):
                    kept = kept_words(b - a, runs[cuts[k] : cuts[k + 1]])
                    pieces = []
                    for at in range(a, b, _CHUNK):
                        end = min(at + _CHUNK, b)
                        chunk = w.data[w.start[at] : w.end[end - 1]].tobytes().split()
                        pieces += compress(chunk, kept[at - a : end - a]) if len(runs) else chunk
                    texts.append(b" ".join(pieces))
                spans = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], fields=list(spot))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(w.counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans),
                        pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        search,
        f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string",
    )


def with_planted_loops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in which one text of ten, by the CRC-32 h of its id, goes round in a circle from some word on.

    With n words and g = h div 10, every word from a = g mod n on is replaced by the circle of the 1 + (n - a) div (3 + g
    mod 8) words that begin at a. Such texts become words joined by one space. Null ids stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)

    def circle(words_: Column) -> Column:
        n = F.size(words_).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        times = F.ceil((n - a) / p).cast("int")
        tail = F.flatten(F.array_repeat(F.slice(words_, (a + 1).cast("int"), p.cast("int")), times))
        return F.array_join(F.concat(F.slice(words_, F.lit(1), a.cast("int")), F.slice(tail, F.lit(1), (n - a).cast("int"))), " ")

    # As the variable of a lambda the words of a text are found once.
    found = F.array(F.regexp_extract_all(text_col, F.lit(r"([^\x20\x09-\x0D]+)")))
    has_words = F.coalesce(F.regexp_like(text_col, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    looped = F.when((h % 10 == 0) & has_words, F.get(F.transform(found, circle), F.lit(0)))
    return docs.withColumn(text_col, F.coalesce(looped, F.col(text_col).cast("string")))


def digests(found: DataFrame) -> DataFrame:
    """The number of runs, the one with most periods, and digests of all runs and of the collapsed text."""
    best = F.expr(
        "aggregate(runs, get(runs, 0), (b, r) -> if(r.length * b.period > b.length * r.period, r, b))"
    )  # in order of start and period, so the first of equals stays
    listed = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr(listed), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
