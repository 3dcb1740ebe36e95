import math
from collections import defaultdict

import numpy as np
import pytest

import sparkscrub.llm.projection_passes as passes
from sparkscrub.llm.entry import op5_projection_passes
from sparkscrub.llm.projection_passes import near_vectors


def _usable(row):
    e = row["embedding"]
    return (
        row["vec_id"] is not None and row["label"] is not None and e is not None and len(e) > 0
        and all(x is not None and math.isfinite(x) for x in e) and any(x != 0 for x in e)
    )


def _brute(rows, least=0.98):
    """(id, links, component) per row, comparing all pairs of rows."""
    good = [i for i, r in enumerate(rows) if _usable(r)]
    linked = defaultdict(set)
    for n, i in enumerate(good):
        for j in good[n + 1 :]:
            a, b = rows[i], rows[j]
            if a["label"] == b["label"] and len(a["embedding"]) == len(b["embedding"]):
                x, y = np.array(a["embedding"], float), np.array(b["embedding"], float)
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= least:
                    linked[i].add(j), linked[j].add(i)
    found = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        ids = [rows[j]["vec_id"] for j in seen if rows[j]["vec_id"] is not None]
        component = min(ids) if ids else None
        found.append((r["vec_id"], len(linked[i]), component, r["vec_id"] == component))
    return sorted(found, key=str)


def _same(df, **options):
    found = sorted((tuple(r) for r in near_vectors(df, **options).collect()), key=str)
    assert found == _brute(df.collect())


def test_query_against_all_pairs(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    found = sorted((tuple(r) for r in op5_projection_passes(spark, "/root/testdata/sf0.001").collect()), key=str)
    assert found == _brute(spark.read.parquet(path).collect())


def _table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string, key string")


def test_large_groups_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(passes, "_CHUNK", 8)
    rng = np.random.default_rng(1)
    rows = []
    for g, size in enumerate([60, 25, 2, 1]):
        center = rng.standard_normal(16)
        for k in range(size):
            e = center + 0.02 * (k % 40) * rng.standard_normal(16) / 4 if k % 3 else center
            rows.append((len(rows), [float(x) for x in e], g % 2, "x", "y"))
    _same(_table(spark, rows).repartition(5))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    e = [1.0, 2.0, 3.0]
    rows = [
        (1, e, 1), (1, e, 1), (2, e, 1), (3, [2.0, 4.0, 6.0], 1), (4, e, 2), (5, e, None), (6, None, 1),
        (7, [], 1), (8, [0.0, 0.0, 0.0], 1), (9, [-0.0, 0.0, 0.0], 1), (10, [1.0, nan, 1.0], 1),
        (11, [inf, 1.0, 1.0], 1), (12, [1.0, None, 1.0], 1), (13, [1.0, 2.0], 1), (14, [-1.0, -2.0, -3.0], 1),
        (None, e, 1), (None, None, None), (15, [1e-30, 2e-30, 3e-30], 1), (16, [1e30, 2e30, 3e30], 1),
    ]
    _same(_table(spark, [(*r, "x", "y") for r in rows]))


def test_empty(spark):
    assert near_vectors(_table(spark, [])).count() == 0
    assert near_vectors(_table(spark, [(1, [0.0], 1, "x", "y")])).collect() == [(1, 0, 1, True)]


def test_exact_at_the_limit(spark):
    angle = math.acos(0.98)
    rows = [(0, [1.0, 0.0], 1, "x", "y")]
    for k, d in enumerate([-0.001, 0.001]):
        rows.append((k + 1, [math.cos(angle + d), math.sin(angle + d)], 1, "x", "y"))
    found = {r["vec_id"]: r["n_links"] for r in near_vectors(_table(spark, rows)).collect()}
    assert found[0] == 1


def test_recall_in_a_dense_label(spark):
    """8,000 vectors with a median cosine of 0.95 and 300 planted pairs; a window of 4 stands for a larger label."""
    rng = np.random.default_rng(5)
    n, d = 8000, 64
    centre = rng.standard_normal(d)
    x = centre / np.linalg.norm(centre) + 0.2294 * rng.standard_normal((n, d)) / math.sqrt(d)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(300):
        side = rng.standard_normal(d)
        side -= (side @ x[k]) * x[k]
        x[n - 1 - k] = 0.9815 * x[k] + math.sqrt(1 - 0.9815**2) * side / np.linalg.norm(side)
    x = x.astype(np.float32).astype(float)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    rows = [(i, [float(v) for v in e], 1, "x", "y") for i, e in enumerate(x)]
    found = {r["vec_id"]: r for r in near_vectors(_table(spark, rows).repartition(4), window=4).collect()}
    i, j = np.nonzero(np.triu(near))
    together = [found[int(a)]["component_id"] == found[int(b)]["component_id"] for a, b in zip(i, j, strict=True)]
    assert len(together) >= 290 and sum(together) >= 0.99 * len(together)
    assert all(r["n_links"] <= near[k].sum() for k, r in found.items())


@pytest.mark.parametrize("seed", range(2))
def test_random_clusters(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(30):
        center = rng.standard_normal(32)
        for _ in range(rng.integers(1, 9)):
            e = center + rng.uniform(0, 0.3) * rng.standard_normal(32)
            rows.append((int(len(rows)), [float(x) for x in e], int(rng.integers(0, 2)), "x", "y"))
    _same(_table(spark, rows).repartition(4), seed=seed)
