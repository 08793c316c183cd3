import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from conftest_llm import words
from tokenizers import Tokenizer

from pricefold.llm import rank_merge
from pricefold.llm.common import text_bytes

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["'s", "'re", "'", "''", " ", "  ", "\n", "\t", "a", "é", "ß", "中", "1", "²", "!", "…", "<|endoftext|>", "<|endof", "aaaa", "'ll", " '", "'ve", "’", "ᲊ", "x", "S", "Don't", "\x00", "\x85", "\x1c", " ", "😀"]


def pieces_of(seed, n=2000, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(most))) for _ in range(n)]


def one_by_one(symbols, vocab):
    """Merge the leftmost pair of lowest rank until none is left."""
    symbols = list(symbols)
    while len(symbols) > 1:
        ranks = vocab.ranked(np.array(symbols[:-1]), np.array(symbols[1:]))
        i = int(np.argmin(ranks))
        if ranks[i] == rank_merge.NEVER:
            break
        symbols[i : i + 2] = [int(vocab.results[ranks[i]])]
    return symbols


@pytest.fixture(scope="module")
def vocab():
    return rank_merge.vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def counts(spark, rows, vocab, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS n_tokens", "'x' AS n_bytes", "1 AS over_limit")
    return sorted(map(tuple, rank_merge.count_tokens(df.repartition(3), vocab, **kw).collect()), key=str)


def test_counts_equal_the_library(spark, vocab, library):
    texts = pieces_of(1) + [" ".join(words(300, i)) for i in range(20)]
    want = [(i, len(t.encode()), n, n > 512) for i, (t, n) in enumerate(zip(texts, (len(e) for e in library.encode_batch(texts, add_special_tokens=False))))]
    assert counts(spark, list(enumerate(texts)), vocab) == sorted(want, key=str)


def test_ids_equal_the_library_with_special_strings_as_text(vocab):
    texts = pieces_of(2)
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    want = [i for e in library.encode_batch(texts, add_special_tokens=False) for i in e.ids]
    data, offs = text_bytes(pa.array(texts))
    got = rank_merge.Encoder(vocab).tokens(data, offs)
    assert got.tolist() == want
    assert int(vocab.lengths[got].sum()) == len(data)


@pytest.mark.parametrize("long", [4, 2048])
def test_merging_together_is_merging_one_by_one(monkeypatch, vocab, long):
    monkeypatch.setattr(rank_merge, "LONG", long)
    monkeypatch.setattr(rank_merge, "BLOCK", 8)
    rng = random.Random(3)
    rows = [vocab.byte_ids[np.frombuffer("".join(rng.choice("abehtr ") for _ in range(rng.randrange(1, 60))).encode(), np.uint8)] for _ in range(200)]
    rows += [vocab.byte_ids[np.frombuffer(b"a" * n, np.uint8)] for n in range(1, 40)]
    first = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    out, bounds = rank_merge.merged(np.concatenate(rows), first, vocab)
    assert [out[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [one_by_one(r, vocab) for r in rows]


def test_nulls_empty_repeated_and_long_texts(spark, vocab, library):
    long = [" ".join(words(40_000, 9)), "z" * 30_000, "中" * 5_000, "=" * 9_000 + "\n" * 9_000]
    rows = [(1, None), (2, ""), (None, "tor ba"), (3, "tor ba"), (3, "tor ba"), *[(10 + i, t) for i, t in enumerate(long)]]
    got = counts(spark, rows, vocab, limit=3)
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False)), len(library.encode(t or "", add_special_tokens=False)) > 3) for i, t in rows]
    assert got == sorted(want, key=str)
    assert counts(spark, [], vocab) == []


def test_memo_begins_anew(monkeypatch, vocab):
    texts = [" ".join(words(50, i)) for i in range(40)]
    whole = rank_merge.Encoder(vocab).counts(*text_bytes(pa.array(texts)))
    monkeypatch.setattr(rank_merge, "MEMO_STRINGS", 20)
    encoder = rank_merge.Encoder(vocab)
    assert [int(encoder.counts(*text_bytes(pa.array([t])))[0]) for t in texts] == whole.tolist()
    assert len(encoder.memo.known) <= 20 + 60


def test_spans_with_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(rank_merge, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"abcabxabc", np.uint8)
    starts, ends = np.array([0, 3, 6, 0]), np.array([3, 6, 9, 2])
    reps, which = rank_merge.distinct_spans(data, starts, ends)
    text = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert [text[reps[w]] for w in which] == text


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        rank_merge.vocabulary(public_tokenizers.path("word_bpe_49k.json"))
