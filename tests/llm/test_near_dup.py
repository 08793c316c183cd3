import random
from collections import defaultdict
from itertools import combinations

import numpy as np
from conftest_llm import words

from pricefold.llm import near_dup
from pricefold.llm.common import words_of
from pricefold.llm.components import components


def brute(rows):
    """doc_id -> (n_shingles, component) by comparing all pairs of texts."""

    def shingles(text):
        w = words_of(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus():
    """Copies, near copies of several strengths (a large group among them) and unrelated texts."""
    rng = random.Random(5)
    rows, i = [], 0
    for group, size in enumerate((1, 2, 3, 60, 5, 1, 1)):
        base = words(rng.randint(30, 90), group)
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
            rows.append((i := i + 1, " ".join(own)))
    rng.shuffle(rows)
    return rows


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_equals_brute_force(make_docs):
    rows = corpus()
    assert result(near_dup.near_duplicates(make_docs(rows, clashing=True))) == brute(rows)


def test_components_across_buckets_in_small_blocks(make_docs, monkeypatch):
    """A chain of variants: the bucket's smallest text links to few, so most links come from the cross step."""
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    base = words(60, 77)
    rows = []
    for i in range(24):  # neighbours differ in one word, ends in many
        own = [f"v{j}" if j < 2 * i else w for j, w in enumerate(base)]
        rows.append(((i * 7) % 24, " ".join(own)))
    rng = random.Random(3)
    for i in range(24, 60):  # variants of the same text at random distances
        own = list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(60)] = f"r{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    expect = brute(rows)
    assert 1 < len({c for _, c in expect.values()}) < 40
    assert result(near_dup.near_duplicates(make_docs(rows))) == expect


def test_edges(make_docs):
    long_text = " ".join(words(30_000, 9))
    rows = [(3, None), (4, ""), (5, " \t\n"), (7, "One two"), (6, "one  TWO"), (8, "one two three"), (9, long_text), (10, long_text + " end"), (None, "one two"), (11, "É é"), (12, "é É")]
    got = near_dup.near_duplicates(make_docs(rows + [(6, "one  TWO")])).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None}
    assert len(got) == len(rows) + 1
    assert by[3] == (0, 3, True) and by[4] == (0, 4, True) and by[5] == (0, 5, True)
    assert by[6] == (1, 6, True) and by[7] == (1, 6, False) and by[8] == (1, 8, True)
    assert by[10][1] == 9 and by[9][0] == 30_000 - 4 and not by[10][2]
    assert by[11][1] == 11 and by[12][1] == 12  # only A-Z is folded
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_empty_table(make_docs):
    assert near_dup.near_duplicates(make_docs([])).count() == 0
    assert near_dup.deduplicated(make_docs([])).count() == 0


def test_deduplicated_keeps_one_of_each_group(make_docs):
    rows = corpus()
    docs = make_docs(rows + [rows[0]] + [(None, "x y"), (None, None)], clashing=True)
    kept = near_dup.deduplicated(docs)
    assert kept.columns == docs.columns
    expect = sorted({c for _, c in brute(rows).values()})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == expect
    assert kept.where("doc_id IS NULL").count() == 2


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    other = np.unique(np.concatenate((base[:700], rng.integers(0, 2**63, 200, dtype=np.uint64))))
    sig = near_dup.minhash(np.concatenate((base, other)), np.array([0, len(base), len(base) + len(other)]))
    true = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.15


def test_sequential_test_misses_rarely():
    """At similarity 0.75 the pruning bound is far below the expected matches; at 0.3 it prunes at once."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (20_000, near_dup.HASHES), dtype=np.uint8)
    same = np.where(rng.random(a.shape) < 0.75, a, a + 1).astype(np.uint8)
    assert len(near_dup.bayes_keeps(a, same)) >= 19_990
    other = np.where(rng.random(a.shape) < 0.3, a, a + 1).astype(np.uint8)
    assert len(near_dup.bayes_keeps(a, other)) < 20


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = defaultdict(set)
    for k, v in got.items():
        groups[v].add(k)
    assert groups == {1: set(range(1, 61)), 100: set(range(100, 160)), 200: {200, 201, 202}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
