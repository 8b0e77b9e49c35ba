import numpy as np

from quarryline.llm import knn
from quarryline.llm.knn import nearest, quantise, similar_pairs

SCHEMA = "vec_id long, embedding array<float>, provider string, model_version string, score double, block int"


def brute(rows, k, dim, floor=-1.0):
    seen = {}
    for i, e, p, m, *_ in rows:
        if i is not None and e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e) and any(e):
            seen[p, m, i] = max(seen.get((p, m, i), e), e)
    out = set()
    for (p, m, i), e in seen.items():
        a = np.asarray(e, np.float32).astype(float)
        scored = []
        for (p2, m2, j), f in seen.items():
            if (p, m) == (p2, m2) and i != j:
                b = np.asarray(f, np.float32).astype(float)
                scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9), j))
        out |= {(p, m, i, n + 1, j) for n, (s, j) in enumerate(sorted(scored)[:k]) if -s >= floor}
    return out


def sample(n=220, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[40:70] = x[40]  # equal vectors
    x[70:74] = x[71] + rng.normal(size=(4, dim)).astype(np.float32) * 0.01
    rows = [(i, x[i].tolist(), "p" if i % 3 else None, "m", 0.5, 1) for i in range(n)]
    rows += rows[:5] + [(500, None, "p", "m", 0.0, 0), (501, [0.0] * dim, "p", "m", 0.0, 0), (502, [1.0] * (dim - 1), "p", "m", 0.0, 0), (503, [float("nan")] * dim, "p", "m", 0.0, 0), (504, [1.0, None] + [1.0] * (dim - 2), "p", "m", 0.0, 0), (None, [1.0] * dim, "p", "m", 0.0, 0)]
    return rows


def got(df):
    return {(r.provider, r.model_version, r.vec_id, r.hit_no, r.neighbour) for r in df.collect()}


def test_equals_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(nearest(df, 5, dim=8)) == brute(rows, 5, 8)


def test_many_blocks_and_a_floor(spark, monkeypatch):
    monkeypatch.setattr(knn, "PART", 32)
    monkeypatch.setattr(knn, "LARGEST_PART", 64)
    rows = sample(300, 8, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(nearest(df, 3, dim=8)) == brute(rows, 3, 8)
    pairs = {(r.vec_a, r.vec_b) for r in similar_pairs(df, 3, 0.8, dim=8).collect()}
    assert pairs == {(min(i, j), max(i, j)) for _, _, i, _, j in brute(rows, 3, 8, 0.8)}


def test_empty_and_single(spark):
    assert nearest(spark.createDataFrame([], SCHEMA), dim=8).count() == 0
    assert nearest(spark.createDataFrame(sample()[:1], SCHEMA), dim=8).count() == 0


def test_quantisation_bound():
    x = np.random.default_rng(0).normal(size=(50, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, scale, rest = quantise(x)
    approx = (codes * scale[:, None]) @ (codes * scale[:, None]).T
    bound = rest[:, None] + rest[None, :] + rest[:, None] * rest[None, :]
    assert (abs(approx - x @ x.T) <= bound + 1e-12).all()
