"""The manifest against a tree built in plain Python."""

import collections
import hashlib
import random
import zlib

import pytest

from refweave.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _hash(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [_hash(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def _way(levels, i):
    out = []
    for nodes in levels[:-1]:
        j = i ^ 1
        out.append((j < i, nodes[j]) if j < len(nodes) else (None, ""))
        i //= 2
    return out


def expected(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, _leaf(r), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in langs}
    top = _levels([trees[g][-1][0] for g in langs])
    out = []
    for n, g in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            way = _way(trees[g], i) + _way(top, n)
            node = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                node = _leaf((*r[:3], r[3] + 1, r[4]))
            for left, other in way:
                node = _hash(other, node) if left else _hash(node, other) if other else _hash(node)
            root = top[-1][0]
            out.append((r[0], leaf, trees[g][-1][0], root, _hash(*(d for _, d in way)), node, node == root))
    return sorted(out, key=str)


def _rows(n):
    draw = random.Random(n)
    # One language holds most rows; ids repeat.
    return [(i % (n - n // 10), "s", "en" if i % 3 else draw.choice(["de", "fr", None, ""]), i % 40, f"t{i % 50}") for i in range(n)]


ODD = [
    (1, "a", "en", 3, "x"), (2, None, None, None, None), (None, "", "", 1, "é\U0001f600"), (2, "a", "en", 3, "x"),
    (2, "a", "en", 3, "x"), (7, "q", "de", 2**63 - 1, ""), (14, "q", "de", None, "y" * 200_000),
]


@pytest.mark.parametrize("rows, levels", [([], 10), (ODD[:1], 10), (ODD, 10), (_rows(3000), 10), (_rows(300), 2), (_rows(65), 1)])
def test_manifest(spark, rows, levels):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sorted((tuple(r) for r in merkle.documents_manifest(docs, levels).collect()), key=str)
    assert found == expected(rows)
    if len(rows) > 10:
        assert {r[-1] for r in found} == {True, False}


def test_other_columns_do_not_matter(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 as leaf", "2 as rank", "3 as tree", "4 as members", "5 as digest")
    found = merkle.documents_manifest(docs)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected(ODD)


def test_equal_subtrees_are_stored_once(spark):
    rows = [(1, "a", "en", 3, "x")] * 64
    docs = spark.createDataFrame(rows, SCHEMA)
    leaves = merkle.ranked(docs.selectExpr("lang as tree", f"'{_leaf(rows[0])}' as digest"), [])
    packs, _ = merkle.build(leaves, 2)
    assert packs[0].count() == 16 and merkle._by_digest(packs[0]).count() == 1
    assert sorted((tuple(r) for r in merkle.documents_manifest(docs, 2).collect()), key=str) == expected(rows)
