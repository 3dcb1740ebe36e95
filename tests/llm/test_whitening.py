import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscrub.llm import whitening
from sparkscrub.llm.entry import QUERIES

SF = "/root/testdata/sf0.001"


def symmetric(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.asarray(values)) @ q.T


@pytest.mark.parametrize("seed", range(30))
def test_counts_below_a_shift(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 12))
    values = rng.standard_normal(d)
    v = symmetric(values, seed)
    for shift in rng.standard_normal(8):
        assert whitening.negatives(v, shift) == (values < shift).sum()
    zero_diagonal = np.array([[0.0, 2.0, 0.0], [2.0, 0.0, 1.0], [0.0, 1.0, 0.0]])
    assert whitening.negatives(zero_diagonal, 0.0) == 1


@pytest.mark.parametrize(
    "values",
    [
        [5.0, 4.0, 3.0, 2.0, 1.0],
        [7.0],
        [3.0, 3.0, 3.0, 1.0, 1.0],
        [1e6, 1e6 * (1 + 1e-9), 1e6 * (1 + 1e-12), 1.0],
        [1.0, 1e-3, 1e-6, 1e-8],
        list(np.geomspace(1, 1e5, 64)),
        list(1 + np.arange(64) * 1e-10),
    ],
)
def test_leading_eigenvalues(values):
    v = symmetric(values, 3)
    v = (v + v.T) / 2
    found, vectors = whitening.leading(v, 32)
    expected = np.linalg.eigvalsh(v)[::-1][: len(found)]
    assert len(found) == min(32, len(values))
    scale = max(values)
    assert np.abs(found - expected).max() < 1e-12 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12
    assert np.abs(v @ vectors - vectors * found).max() < 1e-11 * scale


def test_no_variance_no_components():
    assert len(whitening.leading(np.zeros((4, 4)), 3)[0]) == 0
    x = np.random.default_rng(0).standard_normal((3, 8))
    assert len(whitening.leading((x - x.mean(0)).T @ (x - x.mean(0)), 8)[0]) == 2


def brute(vectors, components):
    """By whole numbers of any size and the library's own eigenvectors."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(row[j] for row in x) for j in range(d)]
    deviation = [sum((n * row[j] - s[j]) ** 2 for j in range(d)) for row in x]
    y = np.array([[(n * row[j] - s[j]) / n for j in range(d)] for row in x])
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, deviation, y @ u / np.sqrt(e), e / np.trace(v)


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    good = [r for r in rows if r["embedding"] and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    n, deviation, w, share = brute([r["embedding"] for r in good], 32)
    at = {r["vec_id"]: i for i, r in enumerate(good)}
    found = QUERIES["op12_whitening"](spark, SF).collect()
    assert len(found) == 32 * n and {r["vec_id"] for r in found} == set(at)
    got = np.zeros((n, 32))
    for r in found:
        i, k = at[r["vec_id"]], r["component"] - 1
        got[i, k] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[i]
        assert abs(r["explained"] - share[k]) < 1e-9 * share[k] and r["identity_error"] < 1e-9
    got *= np.sign((got * w).sum(axis=0))
    assert np.abs(got - w).max() < 1e-6


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(3).tolist(), "n") for i in range(40)]
    odd = [
        (100, None, "n"), (101, [], "n"), (102, [1.0, None, 2.0], "n"), (103, [1.0, float("nan"), 2.0], "n"),
        (104, [float("inf"), 0.0, 0.0], "n"), (105, [1.0, 2.0], "n"), (106, [1e30, 0.0, 0.0], "n"),
        (None, good[0][1], "n"), good[1],
    ]
    schema = "vec_id long, embedding array<float>, n string"
    df = spark.createDataFrame(good + odd, schema).repartition(5)
    found = whitening.whiten(df).collect()
    kept = [*good, odd[-2], odd[-1]]
    assert len(found) == 3 * len(kept) and {r["n"] for r in found} == {42}
    assert {r["vec_id"] for r in found} == {i for i, *_ in kept}
    floats = [np.array(v, np.float32).tolist() for _, v, _ in kept]
    _, deviation, _, share = brute(floats, 3)
    assert sorted((r["deviation"]) for r in found if r["component"] == 1) == sorted(deviation)
    assert np.allclose([r["explained"] for r in found if r["vec_id"] == 5], share)
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(df.where("vec_id = 3")).count() == 0
    assert whitening.whiten(df.where("vec_id >= 100 AND vec_id < 105")).count() == 0


def test_great_entries_stay_exact(spark):
    rows = [(i, [float(2**40 + i), float(-(2**45) + 7 * i), 0.5]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = {r["vec_id"]: r for r in whitening.whiten(df, 1).collect()}
    n, deviation, _, share = brute([v for _, v in rows], 1)
    assert [found[i]["deviation"] for i in range(9)] == deviation
    assert all(abs(r["explained"] - share[0]) < 1e-6 for r in found.values())
    far = spark.createDataFrame([(1, [2.0**40]), (2, [-(2.0**40)])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(far).collect()} == {None}


def test_sums_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.standard_normal(6).tolist()) for i in range(500)], "vec_id long, embedding array<double>")
    one = whitening.fit(whitening.usable_vectors(df.coalesce(1)), 4)
    many = whitening.fit(whitening.usable_vectors(df.repartition(37, F.col("vec_id"))), 4)
    assert one.sums == many.sums and np.allclose(one.values, many.values, rtol=1e-12)
