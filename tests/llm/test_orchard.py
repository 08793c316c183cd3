import hashlib

import numpy as np
import pytest

from pricefold.llm import orchard

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=8, rounds=10, seed="3", scale=1024, dims=64):
    """rows: (vec_id, components). Sorted result rows, comparing each vector with all centroids."""
    keep = [(i, [int(np.floor(scale * x)) for x in e]) for i, e in rows if e is not None and len(e) == dims and all(x is not None and np.isfinite(x) for x in e)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = sorted(keep, key=lambda r: (r[0] is None, sha(f"{seed}:{r[0]}") if r[0] is not None else "", r[1]))
    centroids = [e for _, e in first[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(e, c)), n) for n, c in enumerate(centroids)) for _, e in keep]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            own = [e for (_, e), (_, c) in zip(keep, found) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    total = sum(d for d, _ in found)
    inner = {n: sum(d for d, c in found if c == n) for n in range(len(centroids))}
    return sorted(((i, c, d, inner[c], total, sha(",".join(map(str, centroids[c])))) for (i, _), (d, c) in zip(keep, found)), key=str)


def result(spark, rows, dims=64, **kw):
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).selectExpr("*", "1 AS cluster", "2 AS terms", "3 AS distance").repartition(3)
    return sorted((tuple(r) for r in orchard.clustered(orchard.whole_vectors(df, dims), **kw).collect()), key=str)


def random_rows(n, dims, seed, spread=1.0, clusters=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(clusters, dims))
    return [(i, (base[i % clusters] + spread * rng.normal(size=dims)).tolist()) for i in range(n)]


@pytest.mark.parametrize("dims, spread", [(64, 0.3), (2, 0.2)])
def test_equals_brute_force(spark, monkeypatch, dims, spread):
    monkeypatch.setattr(orchard, "STEP_ROWS", 50)
    rows = random_rows(400, dims, 1, spread)
    assert result(spark, rows, dims) == brute(rows, dims=dims)


def test_ties_repeated_rows_and_few_rows(spark):
    grid = [(i, [float(i % 4) / 1024, float(i // 4 % 4) / 1024]) for i in range(64)]  # equal points, distances that tie
    assert result(spark, grid, 2) == brute(grid, dims=2)
    same = [(7, [1.0, -2.0])] * 5 + [(7, [0.5, 0.5]), (8, [1.0, -2.0])]
    assert result(spark, same, 2) == brute(same, dims=2)
    few = [(3, [0.25, 1.0]), (4, [-0.3, 1.0])]
    assert result(spark, few, 2) == brute(few, dims=2)


def test_nulls_lengths_and_empty_tables(spark):
    good = random_rows(30, 3, 5)
    rows = good + [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, [1.0]), (105, []), (106, [0.0] * 4), (None, [0.1, 0.2, 0.3])]
    assert result(spark, rows, 3) == brute(rows, dims=3)
    assert result(spark, [], 3) == [] and result(spark, [(1, None)], 3) == []


def test_components_beyond_the_exact_range_are_an_error(spark):
    with pytest.raises(Exception, match="range of exact distances"):
        result(spark, [(1, [1e30, 0.0])], 2)
    large = [(i, [2.0**16 * (-1) ** i - i, 2.0**16 - 3 * i]) for i in range(12)]
    assert result(spark, large, 2) == brute(large, dims=2)


def test_search_looks_at_few_centroids():
    """Near vectors in a plane: the lists are left long before their ends, with the same answers."""
    rng = np.random.default_rng(2)
    centroids = rng.integers(-100_000, 100_000, (200, 2))
    vectors = rng.integers(-100_000, 100_000, (2_000, 2))
    nearest, distance, looked = orchard.Orchard(centroids).search(vectors)
    all_ = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert np.array_equal(nearest, all_.argmin(axis=1)) and np.array_equal(distance, all_.min(axis=1))
    assert looked < 0.5 * all_.size
