import random
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from conftest_llm import words
from tokenizers import Tokenizer

from pricefold.llm import alignment, rank_merge

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BITS = ["'s", " ", "  ", "\n", "\t", "a", "é", "中", "1", "!", "…", "<|endoftext|>", "<s>", "<0x41>", "aaaa", "’", "x", "Don't", "ab", "word", "</s>", "<unk>", "0", "😀"]
ODD = ["a\x00b", "a▁b", "▁", " ", "  ", "a ", "a  ", "\x85", "\x1c", "̀a", "﻿a", "ﬁ"]


def brute(texts):
    """Rows without ids, by the two libraries text by text and a table of all links."""
    library, sp = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    library.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(rank_merge.byte_symbols())}
    found, count = [], Counter()
    for t in texts:
        raw = (" " + (t or "")).encode()
        e, right = library.encode(" " + (t or ""), add_special_tokens=False), sp.encode(t or "")
        left = e.ids
        names = [sp.id_to_piece(i) for i in right]
        a = [bytes(byte[c] for c in x) for x in e.tokens]
        b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(right, names)]
        if not t or b"".join(a) != raw or b"".join(b) != raw:
            found.append(None)
            continue
        end_a, end_b = np.cumsum([len(x) for x in a]).tolist(), np.cumsum([len(x) for x in b]).tolist()
        links, groups, i, j = [], [], 0, 0
        for at in sorted(set(end_a) & set(end_b)):
            n, m = end_a.index(at, i) + 1, end_b.index(at, j) + 1
            groups.append(",".join(map(str, left[i:n])) + "|" + ",".join(map(str, right[j:m])))
            links.append((left[n - 1], right[m - 1]))
            i, j = n, m
        count.update(links)
        found.append((len(left), len(right), links, ";".join(groups)))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else (x[0], x[1], len(x[2]), len(x[2]), sum(count[k] == best[k[1]] for k in x[2]), sum(count[k] for k in x[2]), x[3]) for x in found]


@pytest.fixture(scope="module")
def specs():
    return rank_merge.vocabulary(BYTE), alignment.pieces(PIECE)


def rows(spark, texts, specs, parts=5):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' AS a", "1 AS b", "2 AS groups", "3 AS pair", "4 AS n")
    return [tuple(r)[1:] for r in sorted(alignment.align(df.repartition(parts), *specs).collect(), key=lambda r: r[0])]


@pytest.mark.parametrize("fan_in, cells, tokens", [(16, 1 << 16, 1 << 20), (2, 50, 40)])
def test_equals_brute_force(spark, monkeypatch, specs, fan_in, cells, tokens):
    monkeypatch.setattr(alignment, "FAN_IN", fan_in)
    monkeypatch.setattr(alignment, "SLICE", cells)
    monkeypatch.setattr(alignment, "STEP_TOKENS", tokens)
    rng = random.Random(4)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(40))) for _ in range(500)] + ODD + [None, ""] + [" ".join(words(200, i)) for i in range(10)]
    assert rows(spark, texts, specs) == brute(texts)


def test_without_cutting_at_spaces(spark, specs):
    """A model that is not cut into words gives the same, text by text."""
    whole = alignment.Pieces(specs[1].model, specs[1].bytes_of, False)
    texts = [" ".join(words(50, i)) + "  \n a" for i in range(10)] + ODD
    assert rows(spark, texts, (specs[0], whole)) == brute(texts)


def test_repeated_rows_null_ids_long_texts_and_empty_table(spark, specs):
    long = [" ".join(words(30_000, 9)), "z" * 5_000]
    texts = ["tor ba", "tor ba", *long]
    df = spark.createDataFrame([(None, "tor ba"), (None, "tor ba"), (5, long[0]), (6, long[1])], "doc_id long, text string")
    got = sorted((tuple(r) for r in alignment.align(df, *specs).collect()), key=lambda r: (r[0] or 0))
    assert [r[1:] for r in got] == brute(texts)
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), *specs).collect() == []
    assert rows(spark, [None, ""], specs) == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    table = alignment.PerfectHash.of(keys)
    assert np.array_equal(np.sort(table.index(keys)), np.arange(len(keys)))
    other = np.setdiff1d(rng.integers(0, 1 << 63, 1000, dtype=np.uint64), keys)
    assert (table.index(other) == -1).all()
    empty = alignment.PerfectHash.of(keys[:0])
    assert (empty.index(keys[:3]) == -1).all() and len(empty.keys) == 0
