import math
import zlib
from collections import Counter

import pytest
from conftest_llm import words

from pricefold.llm import ppm
from pricefold.llm.common import words_of

ORDER = ppm.ORDER


class Brute:
    """PPM with dictionaries, one symbol at a time."""

    def __init__(self, texts):
        self.contexts = [{} for _ in range(ORDER + 1)]
        for t in texts:
            s = self.symbols(t)
            for p in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    d = self.contexts[k].setdefault(tuple(s[p - k : p]), Counter())
                    d[s[p]] += 1

    @staticmethod
    def symbols(t):
        return [ppm.FILL] * ORDER + list(" ".join(words_of(t)).encode()) + [ppm.END]

    def probability(self, context, symbol):
        out, excluded = 1.0, set()
        for k in range(ORDER, -1, -1):
            d = self.contexts[k].get(tuple(context[len(context) - k :]))
            if d is None:
                continue
            total = sum(v for s, v in d.items() if s not in excluded)
            left = [s for s in d if s not in excluded]
            if symbol in left:
                return out * (d[symbol] - ppm.DISCOUNT) / total
            if left:
                out *= ppm.DISCOUNT * len(left) / total
            excluded |= set(d)
        return out / (ppm.SYMBOLS - len(excluded))

    def score(self, t):
        s = self.symbols(t)
        return sum(math.log10(self.probability(s[p - ORDER : p], s[p])) for p in range(ORDER, len(s)))


def corpus():
    rows = [(i, " ".join(words(5 + 17 * (i % 5), i % 37))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "É ñandú\tThe  THE\nthe"), (103, "zzz qqq 12345 %%%"), (104, "x")]
    return rows


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


@pytest.fixture(scope="module")
def scored(make_docs):
    rows = corpus()
    return rows, ppm.score(make_docs(rows, clashing=True)).collect()


def test_score_equals_brute_force(scored):
    rows, got = scored
    model = Brute([t for i, t in rows if not held(i)])
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(model.score(dict(rows)[r.doc_id]), rel=1e-5)


def test_no_context_is_dropped(make_docs):
    """A corpus of more contexts (over 2^18 of all orders) than a model on the driver once held."""
    import random

    rng = random.Random(12)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2500))) for i in range(100)]
    model = Brute([t for i, t in rows if not held(i)])
    assert sum(len(c) for c in model.contexts) > 1 << 18
    for r in ppm.score(make_docs(rows)).collect():
        assert r.score == pytest.approx(model.score(dict(rows)[r.doc_id]), rel=1e-5)


def test_base_equals_brute_force(scored):
    rows, got = scored
    count = Counter()
    for i, t in rows:
        if not held(i):
            count.update([*words_of(t), "\n"])
    n, v = sum(count.values()), len(count)
    for r in got:
        tokens = [*words_of(dict(rows)[r.doc_id]), "\n"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel=1e-9)


def test_probabilities_sum_to_one():
    """Over all symbols, in seen and unseen contexts, of a trie trimmed or whole."""
    import numpy as np

    texts = [" ".join(words(60, s)) for s in range(20)]
    raw = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    sym, bounds, _ = ppm.normalised(np.frombuffer(b"".join(raw), np.uint8), offs)
    key, n = np.unique(ppm.context_keys(sym, bounds), return_counts=True)
    for cutoff in (1, 6):
        levels = []
        for k in range(ORDER + 1):
            own = ((key >> np.uint64(9 + 8 * (ORDER - k))) if k else np.zeros(len(key), np.uint64)) << np.uint64(9) | (key & np.uint64(511))
            cells, at = np.unique(own, return_inverse=True)
            count = np.bincount(at, n)
            _, name = np.unique(cells >> np.uint64(9), return_inverse=True)
            stay = (np.bincount(name, count) >= cutoff)[name] if k else np.ones(len(cells), bool)
            levels.append((cells[stay], count[stay]))
        trie = ppm.Trie(levels).open()
        for context in (*[int(x) >> 9 for x in key[:: len(key) // 40]], 0, 0x4142434445):
            every = np.array([(context << 9) | s for s in range(ppm.SYMBOLS)], np.uint64)
            assert (10 ** trie.log10(every).astype(float)).sum() == pytest.approx(1, abs=1e-5)


def test_bounded_number_of_contexts(make_docs):
    docs = make_docs([(i, " ".join(words(200, i))) for i in range(20)])
    trie = ppm.train(docs, contexts=300)
    kept = sum(len(level["names"]) for level in trie.levels)
    assert 100 < kept <= 301
    whole = ppm.train(docs)
    assert sum(len(level["names"]) for level in whole.levels) > 1000


def test_edges(make_docs):
    assert ppm.score(make_docs([])).count() == 0
    only_held = [(i, "some text") for i in range(60) if held(i)][:3]
    for r in ppm.score(make_docs(only_held)).collect():
        assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3)
        assert r.score == pytest.approx(-10 * math.log10(ppm.SYMBOLS), rel=1e-6) and r.base_score == pytest.approx(0)
    long_text = " ".join(words(60_000, 3))
    got = ppm.score(make_docs([(0, long_text), (2, long_text), (2, long_text), (None, "a b")])).collect()
    assert len(got) == 4 and len({r.score for r in got if r.n_tokens == 60_001}) == 1


def test_very_frequent_words(make_docs):
    """A word that one text holds more often than an entry can say."""
    import numpy as np

    got = {r.doc_id: r for r in ppm.score(make_docs([(0, "the " * 70_001 + "a"), (2, "a the b")])).collect()}
    assert not held(0) and not held(2)
    n, v = 70_003 + 4, 4
    log = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    assert (got[0].n_tokens, got[0].n_known, got[0].train_tokens) == (70_003, 70_003, n)
    assert got[0].base_score == pytest.approx(70_001 * log(70_002) + 2 * log(2), rel=1e-9)
    assert got[2].base_score == pytest.approx(log(70_002) + 2 * log(2) + log(1), rel=1e-9)
