"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, trained from document labels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from claimspark.llm.scratch import stored
from claimspark.llm.text import ALNUM, Words, mix, slices, words

_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))


def sentence_starts(w: Words) -> np.ndarray:
    """Numbers of the words that begin a sentence: the first of a text, and those with an end mark before them."""
    if not len(w.start):
        return np.zeros(0, np.int64)
    marks = np.concatenate([[0], np.cumsum(_ENDS[w.data])])[w.start]
    new = np.r_[True, (np.diff(marks) > 0) | (np.diff(w.row) > 0)]
    return np.flatnonzero(new)


#: Besides whole words, beginnings of this many bytes of longer words count: a word has many endings.
BEGINNINGS = (5, 6, 7)


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of the beginnings of longer words, and the word each belongs to."""
    found, of = [w.hashes()], [np.arange(len(w.start))]
    for length in BEGINNINGS:
        long = np.flatnonzero(w.end - w.start > length)
        found.append(mix(w.hashes_of(w.start[long], w.start[long] + length) + np.uint64(length)))
        of.append(long)
    return np.concatenate(found), np.concatenate(of)


@dataclass
class Model:
    """Weights by feature hash, and the bias a sentence with any of them starts from."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def evidence(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sentences with a feature of the model: the first word of each, its last word, and its logit.

        A sentence without one is no evidence, however many there are.
        """
        none = np.zeros(0, np.int64)
        if not len(self.hashes) or not len(w.start):
            return none, none, np.zeros(0)
        found, of = features(w)
        near = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[near] == found)
        starts = sentence_starts(w)
        which, place = np.unique(np.searchsorted(starts, of[hit], "right") - 1, return_inverse=True)
        logit = self.bias + np.bincount(place, self.weights[near[hit]], len(which))
        return starts[which], np.r_[starts, len(w.start)][which + 1] - 1, logit


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def association(toxic: np.ndarray, clean: np.ndarray, all_toxic: int, all_clean: int) -> np.ndarray:
    """Likelihood ratio (G squared) of each feature for the toxic label, 0 for features of clean texts."""
    share = all_toxic / max(1, all_toxic + all_clean)
    of_toxic, of_clean = (toxic + clean) * share, (toxic + clean) * (1 - share)
    term = lambda seen, expected: 2 * seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))
    return np.where(toxic > of_toxic, term(toxic, of_toxic) + term(clean, of_clean), 0.0)


def telling_features(sample: DataFrame, least: float) -> np.ndarray:
    """Features that speak for the toxic label, by the number of different contexts each has in texts of either label.

    A context is the word before. Copies of a text repeat its contexts and so count once. Counted by Spark: a sample has
    millions of pairs, of which only the telling features come to the driver.
    """
    pair = F.explode(F.arrays_zip("found", "contexts")).alias("pair")
    counted = stored(
        sample.select("toxic", pair)
        .select("toxic", "pair.found", "pair.contexts")
        .distinct()
        .groupBy("found")
        .agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean")),
        "toxicity_features",
    )
    all_toxic, all_clean = (int(n or 0) for n in counted.agg(F.sum("toxic"), F.sum("clean")).first())

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = (batch.column(c).to_numpy() for c in ("toxic", "clean"))
            told = association(toxic, clean, all_toxic, all_clean) >= least
            yield pa.RecordBatch.from_arrays([batch.column("found").filter(pa.array(told))], ["found"])

    known = counted.where("toxic > 0").mapInArrow(telling, "found bigint").toArrow()
    return np.sort(known.column("found").to_numpy().view(np.uint64))


def fit(labels: np.ndarray, found: list[np.ndarray], sentences: list[np.ndarray], known: np.ndarray, steps: int, decay: float) -> Model:
    """Gradient descent (Adam) on the likelihood of document labels, over the sentences with ``known`` features.

    With sentence probabilities p and S = -sum log(1 - p) = sum softplus(logit), noisy-or gives 1 - exp(-S), whose
    derivative by a logit is p times a factor of the document.
    """
    if not len(known) or not labels.any():
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    flat = np.concatenate(found)
    word = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    use = np.flatnonzero(known[word] == flat)
    word = word[use]
    doc = np.repeat(np.arange(len(labels)), [len(x) for x in found])[use]
    pairs, sentence = np.unique(np.stack([doc, np.concatenate(sentences)[use]]), axis=1, return_inverse=True)
    doc_of, sentence = pairs[0], sentence.ravel()
    toxic = labels.astype(bool)
    balance = np.where(toxic, 0.5 / toxic.sum(), 0.5 / max(1, (~toxic).sum()))
    state = np.r_[np.zeros(len(known)), -2.0]
    mean, square = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, steps + 1):
        logit = state[-1] + np.bincount(sentence, state[word], len(doc_of))
        total = np.bincount(doc_of, softplus(logit), len(labels))
        pull = np.where(toxic, -1.0 / np.expm1(np.clip(total, 1e-6, 500.0)), 1.0) * balance
        slope = pull[doc_of] * np.exp(-softplus(-logit))
        gradient = np.r_[np.bincount(word, slope[sentence], len(known)) + decay * state[:-1], slope.sum()]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        rate = 0.1 * min(1.0, 2 * (1 - step / (steps + 1)))
        state -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(known, state[:-1], float(state[-1]))


def held_out(id_col: str, folds: int):
    """Whether a row is in the fold that nothing is learned from; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0


def train(
    docs: DataFrame,
    labels: DataFrame,
    folds: int = 5,
    sample_per_label: int = 2500,
    steps: int = 150,
    least_association: float = 15.0,
    decay: float = 1e-6,
) -> Model:
    """A model from the labelled documents outside the held-out fold.

    The classifier is fitted on at most ``sample_per_label`` documents of each label, those with the smallest hashes of
    their ids, and on the words and beginnings of words that are associated with the toxic label there at the level of
    one in ten thousand (``least_association``). The sample's features are written and counted by Spark; the driver gets
    those words of the sample that are associated. Labels other than 0 and 1 are left out; a document labelled both ways
    counts as toxic. Without labels, or without any telling word, the model scores everything 0.
    """
    known = (
        labels.select(F.col("doc_id").alias("label_id"), "toxic")
        .where(F.col("toxic").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out("label_id", folds))
        .groupBy("label_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    chosen = [
        known.where(F.col("toxic") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(sample_per_label) for y in (0, 1)
    ]
    sample = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most twice sample_per_label rows of two numbers

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), ALNUM)
                found, of = features(w)
                order = np.argsort(of, kind="stable")
                found, of = found[order], of[order]
                sentence = np.searchsorted(sentence_starts(w), of, "right")
                before = np.where(of > w.first[w.row[of]], w.hashes()[of - 1], 0) if len(of) else found
                cuts = pa.array(np.searchsorted(of, w.first), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("toxic").cast(pa.int32()),
                        pa.ListArray.from_arrays(cuts, pa.array(found.view(np.int64))),
                        pa.ListArray.from_arrays(cuts, pa.array(sentence.astype(np.int32))),
                        pa.ListArray.from_arrays(cuts, pa.array(before.astype(np.uint64).view(np.int64))),
                    ],
                    ["toxic", "found", "sentences", "contexts"],
                )

    listing = (
        docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
        .join(sample, F.col("doc_id") == F.col("label_id"))
        .select("doc_id", "text", "toxic")
        .mapInArrow(listed, "toxic int, found array<bigint>, sentences array<int>, contexts array<bigint>")
    )
    texts = stored(listing, "toxicity_sample")
    known = telling_features(texts, least_association)
    shared = docs.sparkSession.sparkContext.broadcast(known)  # bounded by the words of the sample

    def of_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        telling = shared.value
        for batch in batches:
            found = batch.column("found")
            use = np.flatnonzero(np.isin(found.flatten().to_numpy().view(np.uint64), telling))
            lengths = np.diff(found.offsets.to_numpy())
            cuts = pa.array(np.searchsorted(use, np.r_[0, np.cumsum(lengths)]), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, batch.column(c).flatten().take(pa.array(use))) for c in ("found", "sentences")]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *lists], ["toxic", "found", "sentences"])

    rows = texts.select("toxic", "found", "sentences").mapInArrow(of_known, "toxic int, found array<bigint>, sentences array<int>").toArrow()
    found, sentences = ([x.values.to_numpy(zero_copy_only=False) for x in rows.column(c)] for c in ("found", "sentences"))
    return fit(rows.column("toxic").to_numpy(), [x.view(np.uint64) for x in found], sentences, known, steps, decay)


def toxicity(docs: DataFrame, model: Model, text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``sentences``, those with a probability of ``at_least`` on their own.

    Sentences are given as (start, end, probability) in bytes of the text in UTF-8, from their first word to the end of
    their last one. Sentences end at ``.``, ``!``, ``?`` or a new line. The document's score is the noisy-or of all its
    sentences with a word of the model. A null or empty text and one without words score 0. Rows are scored one by one, whatever they repeat.
    Columns of ``docs`` that are called ``score`` or ``sentences`` give way.
    """
    docs = docs.drop("score", "sentences")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the words of the sample
    place = docs.columns.index(text_col)
    spot = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for part in slices(batch, text_col):
                n = part.num_rows
                spots: list[list[dict]] = [[] for _ in range(n)]
                w = words(part.column(place), ALNUM)
                first, last, logit = fitted.evidence(w)
                row = w.row[first]
                total = np.bincount(row, softplus(logit), n).astype(np.float64)  # of nothing it is whole numbers
                p = np.exp(-softplus(-logit))
                for k in np.flatnonzero(p >= at_least):
                    base = w.offsets[row[k]]
                    spots[row[k]].append(
                        {"start": int(w.start[first[k]] - base), "end": int(w.end[last[k]] - base), "probability": p[k]}
                    )
                columns = [*part.columns, pa.array(-np.expm1(-total)), pa.array(spots, pa.list_(spot))]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "score", "sentences"])

    found = ArrayType(
        StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("probability", DoubleType())])
    )
    out = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("sentences", found)])
    return docs.mapInArrow(score, out)
