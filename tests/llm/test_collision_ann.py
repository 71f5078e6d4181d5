import numpy as np

from refweave.llm import collision_ann as ann

SCHEMA = "vec_id bigint, embedding array<float>, rank int"


def brute(rows, k=5):
    out = []
    good = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    for q, a in {i: a for i, a in good if i % 50 == 0}.items():
        near = sorted(
            (-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i)
            for i, b in good if i != q and len(a) == len(b)
        )
        out += [(q, r, i, -s) for r, (s, i) in enumerate(near[:k], 1)]
    return out


def run(spark, rows, blocks=1):
    df = spark.createDataFrame(rows, SCHEMA)
    return [tuple(r) for r in ann.nearest(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding").collect()]


def as_rows(a):
    return [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(a)]


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 900)
    monkeypatch.setattr(ann, "QUERIES", 13)
    rows = as_rows(np.random.default_rng(1).standard_normal((2000, 64)))
    got, want = run(spark, rows), brute(rows)
    assert len(got) == len(want)
    scores = {(q, i): s for q, _, i, s in want}
    hits = [scores[q, i] for q, _, i, _ in got if (q, i) in scores]
    assert len(hits) >= 0.9 * len(want)
    exact = dict(as_rows_vectors(rows))
    for q, _, i, s in got:
        a, b = exact[q], exact[i]
        assert abs(s - (a @ b) / np.sqrt((a @ a) * (b @ b))) < 1e-12


def as_rows_vectors(rows):
    return [(i, np.array(v)) for i, v, _ in rows]


def test_odd_rows_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = as_rows(rng.standard_normal((60, 8)))
    rows += [(100, None, 1), (150, [0.0] * 8, 1), (200, [float("nan")] * 8, 1), (250, [1.0, None] * 4, 1), (None, [1.0] * 8, 1)]
    rows += [(300, [float("inf")] * 8, 1), (350, [1.0, 2.0], 1), (351, [2.0, 1.0], 1), (400, [1.0] * 3, 1)]
    rows += [(60 + i, rows[7][1], 1) for i in range(9)]  # equal vectors
    rows += [(52, rows[50][1], 1)]  # a repeated key
    got, want = sorted(run(spark, rows)), sorted(brute(rows))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert run(spark, []) == []


def test_a_very_common_vector(spark):
    rows = as_rows(np.random.default_rng(3).standard_normal((300, 16)))
    rows += [(1000 + i, rows[0][1], 1) for i in range(400)]
    got = {(q, r): i for q, r, i, _ in run(spark, rows)}
    assert [got[0, r] for r in range(1, 6)] == [1000, 1001, 1002, 1003, 1004]


def test_few_vectors_are_verified():
    """Recall on isotropic vectors, whose neighbours are hardly nearer than others, and on clusters."""
    rng = np.random.default_rng(5)
    lines = rng.standard_normal((ann.PROJECTIONS, 64))
    centres = rng.standard_normal((20, 64))[rng.integers(0, 20, 8000)]
    for vectors in (rng.standard_normal((8000, 64)), centres + rng.standard_normal((8000, 64)) * 0.3):
        ids = np.arange(8000)
        block = ann.Block(ids, vectors, lines)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        hits, verified = 0, 0
        for q in range(0, 8000, 100):
            found, scores, n = block.search(q, vectors[q], 5)
            cosines = unit @ unit[q]
            cosines[q] = -2
            hits += len(set(found) & set(np.argsort(-cosines)[:5]))
            verified += n
        assert hits >= 0.9 * 400
        assert verified < 0.08 * 80 * 8000


def test_other_key_types(spark):
    rows = [(f"k{i}", [float(i), 1.0, 2.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "name string, v array<double>")
    found = ann.nearest(df, df.where("name = 'k8'"), "name", "v", k=2).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in found] == [("k8", 1, "k7"), ("k8", 2, "k6")]
