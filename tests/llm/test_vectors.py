"""Embedding searches and joins against brute force; components."""

import numpy as np
import pytest

from agora.llm import components, embedding_dedup, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def vectors(spark, seed=3, n=400, size=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, size))
    for k in range(0, 120):
        x[n - 1 - k] = x[k % 5] + r.normal(size=size) * 0.02 * (k % 4)
    rows = [(i, [float(v) for v in row], i % 3 if i < n - 120 else 0, "clash") for i, row in enumerate(x.astype(np.float32))]
    rows += [(n, None, 1, ""), (n + 1, [0.0] * size, 1, ""), (n + 2, [float("nan")] * size, 1, ""), (n + 3, [1.0, None] + [1.0] * (size - 2), 1, ""), (n + 4, rows[0][1], None, ""), (n + 5, [], 1, "")]
    return spark.createDataFrame(rows, SCHEMA), rows, n


def test_nearest_recall_and_scores(spark):
    df, rows, n = vectors(spark)
    found = nearest.search(df, df.filter("vec_id % 10 = 0"), 5, index_rows=64).collect()
    u = {r[0]: np.array(r[1], float) / np.linalg.norm(r[1]) for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    hits = total = 0
    for q in [i for i in u if i % 10 == 0]:
        want = sorted(((-round(float(u[q] @ v), 12), i) for i, v in u.items() if i != q))[:5]
        got = sorted((r["rank"], r.vec_id, r["score"]) for r in found if r.query_id == q)
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert all(abs(s - float(u[q] @ u[i])) < 1e-12 for _, i, s in got)
        hits += len({g[1] for g in got} & {w[1] for w in want})
        total += 5
    assert hits >= 0.9 * total


def test_nearest_of_equal_vectors_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(k, [1.0, 1.0]) for k in range(1, 60)] + [(7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for index_rows in (4, 1000):
        got = nearest.search(df, df.filter("vec_id = 0"), 8, index_rows=index_rows).orderBy("rank").collect()
        assert [r.vec_id for r in got] == [1, 2, 3, 4, 5, 6, 7, 7] and len({r["score"] for r in got}) == 1


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in nearest.search(df, df.filter("vec_id = 0"), 5).collect()] == [(1, 1), (2, 2)]
    assert nearest.search(df.limit(0), df.limit(0), 5).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_embedding_dedup_is_exact(spark, seed, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 32)
    monkeypatch.setattr(embedding_dedup, "SMALL", 4)
    df, rows, n = vectors(spark, seed)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df.withColumnRenamed("score", "kept")).collect()}
    assert len(got) == len(rows)
    x = np.array([r[1] for r in rows[:n]], float)
    u, label = x / np.linalg.norm(x, axis=1)[:, None], np.array([r[2] for r in rows[:n]])
    linked = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    comp = np.arange(n)
    for _ in range(n):
        comp = np.minimum(comp, np.where(linked, comp[None, :], n).min(axis=1))
    assert [got[i].n_links for i in range(n)] == list(linked.sum(axis=1))
    assert [got[i].component_id for i in range(n)] == list(comp)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(n, n + 6))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
