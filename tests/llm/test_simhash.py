import random

import numpy as np
import pytest
import xxhash

from refweave.llm import simhash
from refweave.llm.graph import components


def brute_components(fps, radius):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def brute_fingerprint(text, width=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [words[i : i + width] for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdéß", k=5)) for _ in range(60)]
    base = [" ".join(rng.choices(vocab, k=rng.choice([1, 3, 4, 90, 300]))) for _ in range(40)]
    near = [b.replace(" ", "\n", 2) + " tail" for b in base[:25]]
    return [None, "", " \t\n", "One", "one", *base, *near, base[0].upper(), *base[:5], "x " * 70_000]


def test_components_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: (r[1] & (2**64 - 1), r[2]) for r in simhash.near_duplicates(df, "doc_id", "text").collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    assert [got[i][0] for i in range(len(rows))] == fps
    group = brute_components(fps, 4)
    least = [min(j for j in range(len(rows)) if group[j] == group[i]) for i in range(len(rows))]
    assert [got[i][1] for i in range(len(rows))] == least


@pytest.mark.parametrize("size", [4096, 6])
def test_links_keep_all_components_when_shards_are_dealt_anew(spark, size):
    rng = random.Random(size)
    centres = [rng.getrandbits(64) for _ in range(30)]
    fps = set(centres)
    for c in centres[:10]:
        for _ in range(12):
            c ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(c)
    # One dense group: all within a few bits.
    fps |= {centres[0] ^ (1 << a | 1 << b) for a in range(12) for b in range(12)}
    fps = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    got = dict(map(tuple, components(simhash.links(simhash._one_kind(df), 4, size)).collect()))
    group = brute_components([x & (2**64 - 1) for x in fps], 4)
    least = [min(fps[j] for j in range(len(fps)) if group[j] == group[i]) for i in range(len(fps))]
    assert [got.get(x, x) for x in fps] == least


def test_tree_edges_are_distances():
    fp = np.array(random.Random(5).sample(range(1 << 16), 500), np.uint64)
    forest = simhash.BKForest(np.arange(500) % 7, fp)
    parent, distance = forest.edges // 65, forest.edges % 65
    assert (np.bitwise_count(fp[parent] ^ fp[forest.children]) == distance).all()
    assert len(np.unique(forest.edges)) == len(forest.edges) == 493


def test_empty_table_and_null_keys(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(empty, "doc_id", "text").count() == 0
    df = spark.createDataFrame([(None, "a b c d e"), (None, None), (4, "a b c d e"), (4, "a b c d e")], "doc_id bigint, text string")
    got = [tuple(r)[::2] for r in simhash.near_duplicates(df, "doc_id", "text").collect()]
    assert sorted(got, key=str) == [(4, 4), (4, 4), (None, 4), (None, None)]


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = dict(map(tuple, components(df).collect()))
    assert got == {i: 0 if i < 500 else 1000 for e in edges for i in e}


def jaccard(a, b, width=5):
    x, y = ({tuple(t.split()[i : i + width]) for i in range(max(1, len(t.split()) - width + 1))} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_with_edits(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(4000)]
    base = [rng.choices(vocab, k=rng.choice([60, 200, 500])) for _ in range(60)]
    rows, group = [], []
    for g, words in enumerate(base):
        for _ in range(rng.randrange(1, 6)):
            copy = list(words)
            for _ in range(len(words) // 90):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy))
            group.append(g)
    df = spark.createDataFrame(list(enumerate(rows)), "id bigint, text string")
    got = dict(map(tuple, simhash.near_copies(df, "id", "text").collect()))
    near = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(rows[i], rows[j]) >= 0.8]
    assert np.mean([got[i] == got[j] for i, j in near]) > 0.98
    assert all(group[i] == group[got[i]] and got[i] <= i for i in got)


def test_distinct_texts_with_near_fingerprints_stay_apart(spark):
    rng = random.Random(9)
    digits = [f"{n:02x}" for n in range(256)]
    dumps = [" ".join(rng.choices(digits, k=300_000)) for _ in range(2)]
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(4000)]
    rows = [*dumps, dumps[0].upper()]
    for _ in range(40):
        words = rng.choices(vocab, k=300)
        copy = list(words)
        for at in range(0, 300, 30):
            copy[at + rng.randrange(30)] = rng.choice(vocab)
        rows += [" ".join(words), " ".join(copy)]
    df = spark.createDataFrame(list(enumerate(rows)), "id bigint, text string")
    got = dict(map(tuple, simhash.near_copies(df, "id", "text").collect()))
    assert [got[i] for i in range(3)] == [0, 1, 0]
    far = [i for i in range(3, len(rows), 2) if jaccard(rows[i], rows[i + 1]) < 0.8]
    assert len(far) > 20
    assert all(got[i] != got[i + 1] for i in far)


@pytest.mark.parametrize("share", [0.1, 0.2])
def test_near_copies_with_a_changed_passage(spark, share):
    rng = random.Random(10)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(4000)]
    rows, n = [], 300
    for _ in range(100):
        words = rng.choices(vocab, k=n)
        size = int(n * share)
        extra = rng.choices(vocab, k=size)
        at = rng.randrange(n - size)
        rows += [words, words + extra, extra + words, words[size:], words[:at] + extra[: size // 2] + words[at + size // 2 :]]
    rows = [" ".join(words) for words in rows]
    df = spark.createDataFrame(list(enumerate(rows)), "id bigint, text string")
    got = dict(map(tuple, simhash.near_copies(df, "id", "text").collect()))
    near = [(i - i % 5, i) for i in range(len(rows)) if i % 5 and jaccard(rows[i - i % 5], rows[i]) >= 0.8]
    assert len(near) >= 300 * (share < 0.2) + 90
    assert np.mean([got[i] == got[j] for i, j in near]) > 0.98


def test_no_pair_is_compared_twice(spark, monkeypatch):
    """A group of near copies takes few comparisons, unlike texts that share bands one a pair, sets of other sizes none."""
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(4000)]
    base, other, rows = rng.choices(vocab, k=300), rng.choices(vocab, k=300), []
    for _ in range(60):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(300)] = rng.choice(vocab)
        rows.append(copy)
    rows += [other[:200] + rng.choices(vocab, k=80) for _ in range(40)] + [other[:200], other + other[:250:-1] * 3]
    compared, verified = [], simhash.verified

    def counted(pairs, *args):
        compared.append([(r.a, r.b) for r in pairs.collect()])
        return verified(pairs, *args)

    monkeypatch.setattr(simhash, "verified", counted)
    df = spark.createDataFrame([(n, " ".join(words)) for n, words in enumerate(rows)], "id bigint, text string")
    got = dict(map(tuple, simhash.near_copies(df, "id", "text").collect()))
    assert [got[i] for i in range(60)] == [0] * 60 and all(got[i] == i for i in range(60, len(rows)))
    pairs = [tuple(sorted(p)) for found in compared for p in found]
    assert len(pairs) == len(set(pairs)) and len(compared) > 2
    assert sum(b < 60 for _, b in pairs) <= 2 * 60
    sizes = [len(simhash.shingle_set(" ".join(words))) for words in rows]
    assert all(min(sizes[a], sizes[b]) >= 0.8 * max(sizes[a], sizes[b]) for a, b in pairs)


@pytest.mark.parametrize("chunk", [None, 8000])
def test_dense_group_takes_few_comparisons_and_loses_no_link(spark, monkeypatch, chunk):
    """Many texts with few to many edits of one text, most of them less similar than 0.8: links as by brute force."""
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(4000)]
    base, rows = rng.choices(vocab, k=150), []
    for n in range(400):
        copy = list(base)
        for _ in range(2 + n % 6):
            copy[rng.randrange(150)] = rng.choice(vocab)
        rows.append(" ".join(copy))
    if chunk:
        monkeypatch.setattr(simhash, "_MET", chunk)
    compared, verified = [], simhash.verified

    def counted(pairs, *args):
        compared.append([tuple(sorted((r.a, r.b))) for r in pairs.collect()])
        return verified(pairs, *args)

    monkeypatch.setattr(simhash, "verified", counted)
    df = spark.createDataFrame(list(enumerate(rows)), "id bigint, text string")
    got = dict(map(tuple, simhash.near_copies(df, "id", "text").collect()))
    sets = [simhash.shingle_set(t) for t in rows]
    in_bands = [set(simhash.bands(s)) for s in sets]
    near = [(i, j) for i in range(400) for j in range(i) if in_bands[i] & in_bands[j] and simhash.jaccard(sets[i], sets[j]) >= 0.8]
    root = connected(list(range(400)), near)
    assert [got[i] for i in range(400)] == root
    assert len(set(root)) > 20
    pairs = [p for found in compared for p in found]
    assert len(pairs) == len(set(pairs))
    # Members of a band that are still apart meet once; only bands too large for a task have rounds before.
    assert len(compared) == 3 if not chunk else len(compared) > 3
    assert len(compared[-1]) < 400


def connected(root, pairs):
    """Smallest node connected with each."""
    for i, j in pairs:
        root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


def test_similar_sets_are_connected_whatever_their_sizes():
    rng = np.random.default_rng(13)
    base, sets = rng.integers(0, 2**64, 400, np.uint64), []
    for _ in range(150):
        own = rng.integers(0, 2**64, rng.integers(0, 70), np.uint64)
        sets.append(np.unique(np.concatenate([rng.permutation(base)[: rng.integers(300, 401)], own])))
    sets += [np.unique(rng.integers(0, 2**64, 120_000, np.uint64))] * 2 + [base[:1], base[:1]]
    root = np.arange(len(sets))
    root[3] = 2  # connected already
    for side in (np.arange(len(sets)), np.arange(len(sets)) % 2):
        found = list(simhash.similar(root, side, sets))
        assert all(simhash.jaccard(sets[i], sets[j]) >= 0.8 and side[i] != side[j] for i, j in found)
        near = [(i, j) for i in range(len(sets)) for j in range(i) if side[i] != side[j] and simhash.jaccard(sets[i], sets[j]) >= 0.8]
        assert connected(root.tolist(), found) == connected(root.tolist(), near)
        assert len(found) < len(sets) and len(found) < len(near)
