import random

import numpy as np
import pytest

from pricefold.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, every=50):
    """rows: (vec_id, ints). Sorted result rows by comparing each query with all."""
    out = []
    for q, e in rows:
        if q % every == 0:
            all_ = [(-sum(a * b for a, b in zip(e, f)), i) for i, f in rows if i != q]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(all_)[:k], 1)]
    return sorted(out)


def result(spark, vectors, k=5):
    terms = topk.quantised(vectors)
    return sorted(tuple(r) for r in topk.top_k(terms, terms.where("vec_id % 50 = 0"), k).collect())


def ints(rows):
    return [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows]


def random_rows(n, dims, seed, clusters=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(max(clusters, 1), dims))
    return [(i, [float(np.float32(x)) for x in (base[i % clusters] if clusters else 0) + rng.normal(size=dims) * (0.2 if clusters else 1)]) for i in range(n)]


@pytest.mark.parametrize("clusters", [0, 7])
def test_equals_brute_force(spark, monkeypatch, clusters):
    monkeypatch.setattr(topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "TRAVERSED", 32)
    rows = random_rows(500, 16, 1, clusters)
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).selectExpr("*", "1 AS shard", "2 AS terms")
    assert result(spark, df) == brute(ints(rows))


def test_ties_repeated_rows_and_few_rows(spark):
    same = [(i, [0.5, -0.25]) for i in (0, 7, 3, 50, 9, 11, 12)]
    df = spark.createDataFrame([(i, e, 0) for i, e in same], SCHEMA)
    assert result(spark, df) == brute(ints(same))
    few = spark.createDataFrame([(50, [1.0], 0), (2, [1.0], 0), (2, [1.0], 0)], SCHEMA)
    assert result(spark, few) == [(50, 1, 2, 65536), (50, 2, 2, 65536)]
    alone = spark.createDataFrame([(50, [1.0], 0)], SCHEMA)
    assert result(spark, alone) == []


def test_nulls_infinities_and_lengths(spark):
    rows = [(0, [1.0, 2.0], 0), (1, None, 0), (2, [1.0, None], 0), (3, [float("nan"), 1.0], 0), (4, [float("inf"), 1.0], 0), (None, [1.0, 1.0], 0), (5, [1.0], 0), (6, [1.0, 1.0, 9.0], 0), (7, [], 0), (8, [float("-inf")], 0)]
    got = result(spark, spark.createDataFrame(rows, SCHEMA))
    assert got == [(0, 1, 6, 256 * 256 + 512 * 256), (0, 2, 5, 65536), (0, 3, 7, 0)]
    assert result(spark, spark.createDataFrame([], SCHEMA)) == []


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(-(2**22), 2**22) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame([(i, [x / 256 * 64 for x in e]) for i, e in rows], "vec_id long, embedding array<double>")
    big = [(i, [x * 64 for x in e]) for i, e in rows]
    assert result(spark, df) == brute(big)


def test_few_vectors_are_probed_to_the_end():
    """The bound prunes: the traversal of later blocks uses fewer terms than there are."""
    rows = random_rows(3000, 24, 3, 40)
    v = np.array([e for _, e in ints(rows)], float).T
    q = v[:, 0]
    ids, scores = topk.maxscore(np.arange(3000), np.ascontiguousarray(v), 0, q, 5)
    all_ = q @ v
    all_[0] = -np.inf
    order = np.lexsort((np.arange(3000), -all_))[:5]
    assert ids.tolist() == order.tolist() and scores.tolist() == all_[order].tolist()
