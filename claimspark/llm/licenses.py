"""License notices by an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.text import ALNUM, Words, slices, word_hash, words


@dataclass(frozen=True)
class Template:
    """Words that mark a license. ``exact``: they must stand consecutively; else a block must hold most of them."""

    label: str
    text: str
    exact: bool = False


# Phrases every scan counts.
PHRASES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)

# Opening words of common licenses and the notices that refer to them.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("mit", "released under the mit license"),
    Template("apache", "licensed under the apache license version 2 0"),
    Template("gpl", "licensed under the gnu general public license version 3"),
    Template("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("cc", "licensed under cc by nc 4 0"),
    Template("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("mpl", "subject to the terms of the mozilla public license v 2 0"),
    Template("reserved", "all rights reserved no part of this publication may be reproduced or distributed"),
)


def tokens(template: Template) -> list[str]:
    w = words(pa.array([template.text]), ALNUM)
    return [w.text(k) for k in range(len(w.start))]


class Join:
    """Templates by their tokens in the order of global frequency, rarest first.

    A block that holds at least ``need`` of a template's n distinct tokens holds one of its n - need + 1 rarest, so only
    blocks around those are looked at (prefix filter). Of these, blocks with fewer than ``need`` template tokens near
    (length filter) or within reach of a prefix token (positional filter) can't qualify and go before the windows of
    the rest are counted exactly.
    """

    def __init__(self, templates: Sequence[Template], threshold: float, slack: float, frequency: dict[str, int]):
        self.templates, self.frequency = templates, frequency
        self.words = [tokens(t) for t in templates]
        vocabulary = sorted({w for ws in self.words for w in ws})
        hashes = np.array([word_hash(w) for w in vocabulary], np.uint64)
        order = np.argsort(hashes)
        self.vocabulary = [vocabulary[k] for k in order]
        self.hashes = hashes[order]
        place = {w: k for k, w in enumerate(self.vocabulary)}
        self.ids = [[place[w] for w in ws] for ws in self.words]
        self.sets = [np.array(sorted(set(ids))) for ids in self.ids]
        self.need = [len(s) if t.exact else ceil(threshold * len(s) - 1e-9) for t, s in zip(templates, self.sets, strict=True)]
        self.window = [len(ids) if t.exact else ceil(slack * len(ids)) for t, ids in zip(templates, self.ids, strict=True)]
        rare = lambda k: (frequency.get(self.vocabulary[k], 0), self.vocabulary[k])
        self.prefix = [sorted(s, key=rare)[: len(s) - n + 1] for s, n in zip(self.sets, self.need, strict=True)]

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Places (numbers of words) and tokens of all template words in the texts, compared by content."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = w.hashes()
        near = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        at = np.flatnonzero(self.hashes[near] == h)
        token = near[at]
        lengths = np.array([len(x.encode()) for x in self.vocabulary])
        same = (w.end[at] - w.start[at]) == lengths[token]
        for step in range(int(lengths.max())):  # byte by byte over all hits, so equal hashes alone don't decide
            letters = np.array([x.encode()[step] if step < len(x.encode()) else 0 for x in self.vocabulary], np.uint8)
            live = np.flatnonzero(same & (step < lengths[token]))
            same[live] = w.data[w.start[at[live]] + step] == letters[token[live]]
        return at[same], token[same]

    def links(self, w: Words) -> list[tuple[int, int, int, int, float]]:
        """(row, template, first word, word after the last, containment), words counted from 0 in their row."""
        at, token = self.hits(w)
        row = w.row[at]
        found: list[tuple[int, int, int, int, float]] = []
        by_token = [at[token == k] for k in range(len(self.vocabulary))]
        token_at = np.full(len(w.start) + 1, -1, np.int32)
        token_at[at] = token
        for t, template in enumerate(self.templates):
            if template.exact:
                ids = self.ids[t]
                offset = ids.index(self.prefix[t][0])
                begin = by_token[self.prefix[t][0]] - offset
                begin = begin[(begin >= 0) & (begin + len(ids) <= len(w.start))]
                if len(begin):
                    begin = begin[w.row[begin] == w.row[begin + len(ids) - 1]]
                for step, k in enumerate(ids):
                    begin = begin[token_at[begin + step] == k]
                found += [(int(r), t, int(b), int(b) + len(ids), 1.0) for b, r in zip(begin - w.first[w.row[begin]], w.row[begin], strict=True)]
                continue
            anchors = np.unique(np.concatenate([by_token[k] for k in self.prefix[t]]))
            if not len(anchors):
                continue
            mine = np.isin(token, self.sets[t])
            p, k, r = at[mine], token[mine], row[mine]
            reach = self.window[t]
            right = np.minimum(np.searchsorted(anchors, p), len(anchors) - 1)
            left = np.maximum(right - 1, 0)
            near = ((np.abs(anchors[right] - p) < reach) & (w.row[anchors[right]] == r)) | (
                (np.abs(anchors[left] - p) < reach) & (w.row[anchors[left]] == r)
            )
            p, k, r = p[near], k[near], r[near]
            cuts = np.flatnonzero((np.diff(p) >= reach) | (np.diff(r) > 0)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(p)], strict=True):
                if b - a >= self.need[t]:
                    found += self.windows(t, p[a:b] - w.first[r[a]], k[a:b], int(r[a]))
        return found

    def windows(self, t: int, places: np.ndarray, tokens: np.ndarray, row: int) -> list[tuple[int, int, int, int, float]]:
        """Blocks of ``window`` words with enough distinct tokens; those that overlap are one link with the best share."""
        count: dict[int, int] = {}
        found: list[list] = []
        low = 0
        for high in range(len(places)):
            count[tokens[high]] = count.get(tokens[high], 0) + 1
            while places[high] - places[low] >= self.window[t]:
                count[tokens[low]] -= 1
                if not count[tokens[low]]:
                    del count[tokens[low]]
                low += 1
            if len(count) >= self.need[t]:
                share = len(count) / len(self.sets[t])
                if found and places[low] < found[-1][3]:
                    found[-1][3], found[-1][4] = int(places[high]) + 1, max(found[-1][4], share)
                else:
                    found.append([row, t, int(places[low]), int(places[high]) + 1, share])
        return [tuple(x) for x in found]


def token_frequency(docs: DataFrame, templates: Sequence[Template], text_col: str = "text") -> dict[str, int]:
    """How often each template word stands in all texts; one number per word of the templates comes to the driver."""
    join = Join(templates, 1.0, 1.0, {})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(join.vocabulary), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(join.hits(words(part.column(0), ALNUM))[1], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(join.vocabulary, pa.string()), pa.array(total)], ["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "word string, n bigint")
    return {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def license_links(
    docs: DataFrame,
    templates: Sequence[Template] = PHRASES + NOTICES,
    threshold: float = 0.8,
    slack: float = 1.25,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: its id, n_words and ``links``, every block that meets a template.

    Words are runs of letters and digits with A-Z lower-cased. A block is ``slack`` times as many consecutive words as
    the template has; it meets the template when it holds ``threshold`` of its distinct words. Exact templates need all
    their words in a row. A link is (label, exact, first, after, containment), in words counted from 0.

    A null text is empty and has no words. Equal or null ids give one row each, an empty table gives none. Templates
    without words never meet. Other columns are ignored. Frequencies come from all texts; they only order the work.
    """
    templates = [t for t in templates if tokens(t)]
    join = Join(templates, threshold, slack, token_frequency(docs, templates, text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    link = pa.struct(
        [("label", pa.string()), ("exact", pa.bool_()), ("first", pa.int64()), ("after", pa.int64()), ("containment", pa.float64())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"), ALNUM)
                per_row: list[list] = [[] for _ in range(part.num_rows)]
                for row, t, first, after, share in sorted(join.links(w)):
                    per_row[row].append((templates[t].label, templates[t].exact, first, after, share))
                links = [[dict(zip(link.names, x, strict=True)) for x in xs] for xs in per_row]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(w.counts, pa.int64()), pa.array(links, pa.list_(link))],
                    ["doc_id", "n_words", "links"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        scan,
        f"doc_id {kind}, n_words bigint, "
        "links array<struct<label:string,exact:boolean,first:bigint,after:bigint,containment:double>>",
    )


def summary(found: DataFrame) -> DataFrame:
    """Counts and labels per document, from ``license_links``; ``score`` is the best containment of its links, else 0."""
    base = "filter(links, x -> x.exact)"
    labels = "concat_ws(',', array_sort(array_distinct(transform({}, x -> x.label))))"
    return found.select(
        "doc_id",
        "n_words",
        F.expr(f"cast(size({base}) as bigint)").alias("n_base"),
        F.expr(f"array_min(transform({base}, x -> x.first))").alias("first_word"),
        F.expr(f"array_max(transform({base}, x -> x.first))").alias("last_word"),
        F.expr(labels.format(base)).alias("base_labels"),
        F.expr(labels.format("links")).alias("labels"),
        F.expr("coalesce(array_max(transform(links, x -> x.containment)), 0D)").alias("score"),
    )
