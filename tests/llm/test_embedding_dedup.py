import numpy as np
from gradelake.llm import embedding_dedup as E


def brute(ids, x, t):
    ok = [v is not None and len(v) > 0 and all(a is not None and np.isfinite(a) for a in v) and any(v) for v in x]
    n, links, parent = len(ids), [0] * len(ids), list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(x[i]) == len(x[j]):
                a, b = np.float32(x[i]).astype(float), np.float32(x[j]).astype(float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= t:
                    links[i] += 1
                    links[j] += 1
                    parent[root(i)] = root(j)
    low = {}
    for i in range(n):
        low[root(i)] = min(low.get(root(i), ids[i]), ids[i])
    return sorted((ids[i], links[i], low[root(i)], ids[i] == low[root(i)]) for i in range(n))


def vectors(seed, n, dim):
    r = np.random.default_rng(seed)
    base = r.standard_normal((12, dim))
    x = [(base[r.integers(12)] + r.standard_normal(dim) * r.choice([0.2, 0.33, 0.5, 2])).tolist() for _ in range(n)]
    x += [x[0], x[0], [2 * a for a in x[1]], None, [0.0] * dim, [float("nan")] * dim, [None] + [1.0] * (dim - 1), [], [1.0, 2.0], [1.0, 2.1], [float("inf")] + [1.0] * (dim - 1)]
    return x


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    for seed, dim in ((1, 8), (2, 32)):
        x = vectors(seed, 250, dim)
        ids = list(np.random.default_rng(seed).permutation(len(x)).tolist())
        df = spark.createDataFrame([(i, v, 1) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, cell int").repartition(4)
        got = sorted(tuple(r) for r in E.near_vectors(df, cells=9).collect())
        assert got == brute(ids, x, 0.9)


def test_empty(spark):
    assert E.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    p = df.toPandas()
    x = np.stack(p.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    want = dict(zip(p.vec_id, near.sum(1) - 1))
    assert {r.vec_id: r.n_links for r in E.near_vectors(df).collect()} == want


def test_the_query_finds_links_across_many_borders(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(E, "CELL", 150, raising=False)
    r = np.random.default_rng(6)
    x = (r.standard_normal((3000, 4)) @ r.standard_normal((4, 64)) + 0.02 * r.standard_normal((3000, 64))).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = ((y @ y.T >= 0.9).sum(1) - 1).tolist()
    assert sum(want) > 3000
    got = {r.vec_id: r.n_links for r in E.op9(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(x))] == want
