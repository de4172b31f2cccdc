"""Merkle manifest against trees built level by level, over blocks of several sizes."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

from claimspark.llm import manifest
from tests.llm.conftest import ODD


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes):
    """The root of a list of nodes and, for each, (left, right) siblings of its run per level."""
    ways = [[] for _ in nodes]
    below = [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, under = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at : at + 3]
            for k, leaves in enumerate(below[at : at + 3]):
                for leaf in leaves:
                    ways[leaf].append((run[:k], run[k + 1 :]))
            above.append(h(*run))
            under.append([x for leaves in below[at : at + 3] for x in leaves])
        nodes, below = above, under
    return nodes[0], ways


def expected(rows):
    """The query's rows by the contract from (doc_id, source, lang, n_chars, text)."""
    trees = defaultdict(list)
    for r in rows:
        leaf = h(*map(field, r))
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
        other = h(*map(field, (*r[:4], r[4].replace("\n", "")))) if tampered else leaf
        trees[r[1]].append(((r[0] is None, r[0] or 0), leaf, other))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    found = {s: climb([leaf for _, leaf, _ in sorted(trees[s])]) for s in names}
    root, above = climb([found[s][0] for s in names]) if names else (None, [])
    out = []
    for s, up in zip(names, above, strict=True):
        for ((nameless, doc_id), leaf, other), way in zip(sorted(trees[s]), found[s][1], strict=True):
            now, proof = other, []
            for left, right in way + up:
                proof += left + right
                now = h(*left, now, *right)
            out.append((None if nameless else doc_id, leaf, found[s][0], root, h(*proof), now, now == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree int, rank int, block string, root int, of int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], SCHEMA)


def got(spark, rows, levels):
    found = manifest.verified(manifest.document_manifest(frame(spark, rows), levels))
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_trees_of_all_sizes(spark, levels):
    rows = [(k * 1000 + j, f"s{k}", "en", j, f"a\nb {j}") for k, n in enumerate([1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 82]) for j in range(n)]
    result = got(spark, rows, levels)
    assert result == expected(rows)
    assert {r[6] for r in result} == {True, False}


def test_one_leaf_is_its_own_root(spark):
    ((_, leaf, subroot, root, proof, folded, ok),) = got(spark, [(3, "s", None, None, "no new line")], 2)
    assert leaf == subroot == root == folded and ok and proof == h()


def test_more_sources_than_a_block_holds(spark):
    rows = [(k, f"source {k % 40}", "en", k, "x\ny") for k in range(130)]
    assert got(spark, rows, 1) == expected(rows)


def test_odd_rows(spark):
    rows = [(i, None if k % 3 == 0 else "é" if k % 3 == 1 else "", "l" if k % 2 else None, None, t) for k, (i, t) in enumerate(ODD)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (4, "", "", 0, "-"), (-5, "z", "x", -1, "\n\n")]
    assert got(spark, rows, 1) == expected(rows)
    assert got(spark, [], 2) == []


def test_a_hot_source_is_spread_over_tasks(spark):
    rows = [(k, "hot" if k % 3 else f"s{k % 17}", "en", k, f"t\n{k}") for k in range(3000)]
    docs = frame(spark, rows)
    leaves = docs.selectExpr("source AS tree", "doc_id AS id", "unhex(sha2(text, 256)) AS digest")
    numbered = manifest.numbered(leaves, [leaves["id"], leaves["digest"]])
    hot = [r.rank for r in numbered.where("tree = 'hot'").collect()]
    assert sorted(hot) == list(range(2000))
    sizes = [r["count"] for r in manifest.appended(numbered, 2).groupBy("tree", "block").count().collect()]
    assert max(sizes) == 9
    assert got(spark, rows, 3) == expected(rows)


def test_witnesses_grow_with_each_append():
    subtrees, leaves = manifest.OpenSubtrees(3), [bytes([k]) * 32 for k in range(11)]
    for k, leaf in enumerate(leaves):
        subtrees.append(leaf)
        assert len(subtrees.siblings[0]) == 32 * (2 * (k >= 2) + 2 * (k >= 8))
    root = subtrees.root(alone=True)
    for leaf, siblings, steps in zip(leaves, subtrees.siblings, subtrees.steps, strict=True):
        assert manifest.folded(leaf, bytes(siblings), bytes(steps)) == root
        assert manifest.folded(b"?" * 32, bytes(siblings), bytes(steps)) != root
    assert root.hex() == climb([x.hex() for x in leaves])[0]
