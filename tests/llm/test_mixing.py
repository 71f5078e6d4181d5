import random

import pytest

from refweave.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size int"


def rows(n=3000):
    rng = random.Random(2)
    sources = ["b", "a", "é", None, "tiny", "zero"]
    out = []
    for i in range(n):
        s = rng.choices(sources, [30, 10, 10, 5, 1, 1])[0]
        words = 0 if s == "zero" else min(int(rng.paretovariate(1.1) * 20), 4000)
        out.append((i, " ".join(["w"] * words) if rng.random() > 0.01 else None, s, 7))
    return [*out, out[5], out[5], (None, "a b", "a", 1), (None, "a b", "a", 1)]


def brute_targets(sizes, weights, share, limit):
    """Water level by bisection."""
    low, high = 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(limit * s, w * level) for s, w in zip(sizes, weights)) < share * sum(sizes):
            low = level
        else:
            high = level
    return [min(limit * s, w * high) for s, w in zip(sizes, weights)]


@pytest.mark.parametrize("leaf", [8192, 5])
def test_targets_are_met(spark, monkeypatch, leaf):
    monkeypatch.setattr(mixing, "LEAF", leaf)
    data = rows(3000 if leaf > 5 else 150)
    df = spark.createDataFrame(data, SCHEMA)
    got = mixing.mix(df, "doc_id", "source", "text").collect()
    size = {}
    for _, text, source, _ in data:
        size[source] = size.get(source, 0) + len((text or "").split())
    names = sorted([s for s in size if s is not None]) + [None]
    want = dict(zip(names, brute_targets([size[s] for s in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)))
    assert len(got) == len(data)
    of = {}
    for i, text, source, _ in data:
        of.setdefault(i, (source, len((text or "").split())))
    taken, largest = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
    for r in got:
        source, n = of[r.doc_id]
        assert r.size == n and r.source_size == size[source]
        assert abs(r.target - want[source]) <= 1e-6 * max(1, want[source])
        assert r.taken in (0, n, 2 * n)
        taken[source] += r.taken
        largest[source] = max(largest[source], n)
    for s in names:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix(df.repartition(3), "doc_id", "source", "text").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_pivot_keeps_the_sum_and_is_fair():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 500) for _ in range(40)]
    counts = [0] * 40
    for _ in range(3000):
        p, held = mixing.pivot(sizes, [0.3] * 40, [rng.random() for _ in sizes])
        assert abs(sum(s * x for s, x in zip(sizes, p)) - 0.3 * sum(sizes)) < 1e-6
        assert all(x in (0, 1) for i, x in enumerate(p) if i != held)
        for i, x in enumerate(p):
            counts[i] += x
    assert all(abs(c / 3000 - 0.3) < 0.05 for c in counts)


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA), "doc_id", "source", "text").count() == 0
