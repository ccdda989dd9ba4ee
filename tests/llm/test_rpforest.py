import numpy as np
import pandas as pd
import pytest

from loomgeno.llm import rpforest
from tests.llm.helpers import union_find


def brute(rows, least=0.9):
    ok, vecs = [], []
    for k, (_, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            ok.append(k)
            vecs.append(np.array(v, dtype=np.float64))
    pairs = []
    for p, a in enumerate(vecs):
        for q in range(p):
            b = vecs[q]
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                pairs.append((ok[q], ok[p]))
    root = union_find(range(len(rows)), pairs)
    degree = np.zeros(len(rows), dtype=int)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    comp = {}
    for k, r in root.items():
        if rows[k][0] is not None:
            comp[r] = min(comp.get(r, rows[k][0]), rows[k][0])
    return sorted(((i, int(degree[k]), comp.get(root[k]), i == comp.get(root[k])) for k, (i, _) in enumerate(rows)), key=str)


def rows_of(df):
    return [(r.vec_id, None if r.embedding is None else list(r.embedding)) for r in df.select("vec_id", "embedding").collect()]


def got(df, **options):
    return sorted(map(tuple, rpforest.link(df, **options).collect()), key=str)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert got(df) == brute(rows_of(df))


@pytest.mark.parametrize("block", [7, 1024])
def test_deep_trees_recall(spark, block):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((150, 32))
    near = [b + 0.3 * rng.standard_normal(32) / 32**0.5 * np.linalg.norm(b) for b in base for _ in range(4)]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate([*base, *near])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    have, want = got(df, trees=16, leaf_rows=12, block=block), brute(rows)
    n, m = sum(r[1] for r in have), sum(r[1] for r in want)
    assert 0.95 * m <= n <= m
    assert all(h[1] <= w[1] for h, w in zip(sorted(have), sorted(want)))


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 400}])
def test_recall_on_20000_vectors(spark, options):
    """Against every pair: with the query's own parameters, and with trees as deep as some 200,000 vectors have."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((8000, 64))
    cosines = rng.uniform(0.86, 0.99, 12000)
    noise = rng.standard_normal((12000, 64))
    own = base[rng.integers(0, 8000, 12000)]
    own = own / np.linalg.norm(own, axis=1, keepdims=True)
    noise -= (noise * own).sum(axis=1, keepdims=True) * own
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.concatenate([base, cosines[:, None] * own + np.sqrt(1 - cosines**2)[:, None] * noise]).astype(np.float32)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    pairs = []
    for at in range(0, len(u), 2000):
        a, b = np.nonzero(u[at : at + 2000] @ u.T >= 0.9)
        pairs += [(i + at, j) for i, j in zip(a.tolist(), b.tolist()) if i + at < j]
    degree = np.bincount(np.array(pairs).ravel(), minlength=len(u))
    root = union_find(range(len(u)), pairs)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    out = rpforest.link(df, **options).toPandas().sort_values("vec_id")
    links = out.n_links.to_numpy()
    assert (links <= degree).all() and len(pairs) > 9000
    assert links.sum() >= (0.98 if not options else 0.9) * degree.sum()
    assert all(root[c] == root[i] for i, c in zip(out.vec_id, out.component_id))


def test_links_at_the_threshold(spark):
    """Pairs a hair above and below it, that 16 bits can't tell apart."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(40):
        a = rng.standard_normal(24)
        a /= np.linalg.norm(a)
        n = rng.standard_normal(24)
        n -= (n @ a) * a
        n /= np.linalg.norm(n)
        c = 0.9 + (1 if k % 2 else -1) * 10.0 ** -rng.integers(5, 10)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * n).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    have = got(df)
    assert have == brute(rows) and sum(r[1] for r in have) == 40


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (None, [1.0, -0.0]), (9, [2.0, 0.0]),
            (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0]), (None, [0.0, -1.0]), (12, [1e-40, 0.0]), (13, [3e38, 1e30]), (14, [-0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as n", "2 as label", "'x' as v")
    assert got(df) == brute(rows_of(df))
    assert got(df.limit(0)) == []
    assert got(df.where("vec_id < 4")) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_dense_group_of_copies(spark):
    rng = np.random.default_rng(2)
    c = rng.standard_normal(16)
    rows = [(i, [float(np.float32(x)) for x in (c + 0.01 * rng.standard_normal(16))]) for i in range(120)] + [(200 + i, [float(np.float32(x)) for x in c]) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    have, want = got(df, trees=16, leaf_rows=10, block=16), brute(rows)
    assert [(r[0], r[2], r[3]) for r in have] == [(r[0], r[2], r[3]) for r in want]
    assert sum(r[1] for r in want) >= sum(r[1] for r in have) >= 0.98 * sum(r[1] for r in want)
