import math
from collections import Counter

from pricefold.llm import mixing


def test_copies_follow_the_poisson_distribution(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "'t' AS text", "'s' AS source")
    rate = spark.createDataFrame([("s", 1.7)], "source string, rate double")
    n = Counter(r["count"] for r in mixing.replicate(docs, rate).groupBy("doc_id").count().collect())
    n[0] = 40_000 - sum(n.values())
    for k in range(6):
        p = math.exp(-1.7) * 1.7**k / math.factorial(k)
        assert abs(n[k] - 40_000 * p) < 5 * math.sqrt(40_000 * p * (1 - p))


def test_large_rates(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "'t' AS text", "'s' AS source")
    rate = spark.createDataFrame([("s", 1300.0)], "source string, rate double")
    n = [r["count"] for r in mixing.replicate(docs, rate).groupBy("doc_id").count().collect()]
    mean = sum(n) / 300
    assert abs(mean - 1300) < 5 * math.sqrt(1300 / 300)
    assert 900 < sum((x - mean) ** 2 for x in n) / 299 < 1800


def test_sources_reach_their_share(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "'t' AS text", "if(id % 3 = 0, 'big', concat('s', id % 10)) AS source")
    out = {r["source"]: r["count"] for r in mixing.mixed_corpus(docs, weights={"big": 3.0, "s1": 1.0}).groupBy("source").count().collect()}
    assert set(out) == {"big", "s1"}
    assert abs(out["big"] - 22_500) < 800 and abs(out["s1"] - 7_500) < 500
    even = {r["source"]: r["count"] for r in mixing.mixed_corpus(docs, alpha=0.0).groupBy("source").count().collect()}
    assert max(even.values()) < 1.2 * min(even.values())


def test_join_without_broadcast_gives_the_same(spark, monkeypatch):
    docs = spark.range(2_000).selectExpr("id AS doc_id", "'t' AS text", "concat('s', id % 30) AS source")
    key = ["doc_id", "copy", "shuffle_key"]
    one = sorted(mixing.mixed_corpus(docs).select(key).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 5)
    assert sorted(mixing.mixed_corpus(docs).select(key).collect()) == one


def test_edges(make_docs):
    rows = [(i, "t", "a" if i % 2 else None) for i in range(400)] + [(None, None, "a")] * 3 + [(None, "x", None), (5, "t", "a"), (5, "t", "a")]
    docs = make_docs(rows, clashing=True).selectExpr("*", "'own' AS shuffle_key")
    out = mixing.mixed_corpus(docs)
    assert out.columns == [*docs.columns, "copy_", "shuffle_key_"]
    got = out.collect()
    by_id = Counter(r.doc_id for r in got if r.doc_id is not None and r.doc_id != 5)
    assert got and set(r.copy_ for r in got) >= {1}
    # repeated rows draw alike, each for itself
    again = Counter(r.doc_id for r in mixing.mixed_corpus(docs).collect() if r.doc_id is not None and r.doc_id != 5)
    assert by_id == again
    assert sum(r.doc_id == 5 for r in got) % 3 == 0
    assert mixing.mixed_corpus(make_docs([])).count() == 0


def test_rows_of_a_partition_are_in_shuffled_order(make_docs):
    out = mixing.mixed_corpus(make_docs([(i, "t", "a") for i in range(500)]))
    parts = out.rdd.mapPartitions(lambda rows: [[r.shuffle_key for r in rows]]).collect()
    assert all(p == sorted(p) for p in parts)
    first = [r.doc_id for r in out.collect()]
    assert first != sorted(first)
