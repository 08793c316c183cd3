import random

import numpy as np
from conftest_llm import words

from pricefold.llm import chunks


def buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw])))


def pieces(text):
    data, offs = buffer([text])
    ends, _ = chunks.cut(data, offs)
    return [bytes(data[a:b]) for a, b in zip([0, *ends[:-1]], ends)]


def test_gear_equals_its_definition():
    data = np.frombuffer(bytes(random.Random(1).randrange(256) for _ in range(500)), np.uint8)
    g = chunks._GEAR
    expect = [sum(int(g[data[i - k]]) << 2 * k for k in range(16) if i >= k) % 2**32 for i in range(500)]
    assert chunks.gear(data).tolist() == expect


def test_chunks_cover_texts_and_do_not_depend_on_neighbours():
    texts = [" ".join(words(300, 1)), "", "ab", "x" * 1000, " ".join(words(50, 2))]
    data, offs = buffer(texts)
    ends, first = chunks.cut(data, offs)
    starts = np.concatenate(([0], ends[:-1]))
    for d, t in enumerate(texts):
        own = [bytes(data[a:b]) for a, b in zip(starts[first[d] : first[d + 1]], ends[first[d] : first[d + 1]])]
        assert b"".join(own) == t.encode() and own == (pieces(t) if t else [])
        assert all(len(p) <= chunks.MOST for p in own)


def test_insertion_moves_few_cuts():
    text = " ".join(words(2000, 3))
    a, b = pieces(text), pieces(text[:7000] + "INSERTED" + text[7000:])
    assert len(set(b) - set(a)) <= 6


def test_digest_depends_on_bytes_only():
    data, offs = buffer(["one two three", "xx one two three"])
    a = chunks.digests(data, np.array([0]), np.array([13]))
    b = chunks.digests(data, np.array([16]), np.array([29]))
    assert a == b and a != chunks.digests(data, np.array([1]), np.array([13]))


def corpus():
    rng = random.Random(7)
    shared = [" ".join(words(70, 900 + k)) for k in range(12)]
    rows, holds = [], {}
    for d in range(120):
        text = words(rng.choice((30, 150, 600)), 3000 + d)
        if d < 60:
            k = d % 12
            text.insert(rng.randrange(len(text)), shared[k])
            holds[d] = k
        rows.append((d, " ".join(text)))
    return rows, holds, shared


def test_planted_passages_are_found_and_clean_texts_left(make_docs):
    rows, holds, shared = corpus()
    got = chunks.repeated_passages(make_docs(rows, clashing=True)).collect()
    assert {r.doc_id for r in got} == set(holds)
    texts = dict(rows)
    for r in got:
        k = holds[r.doc_id]
        part = texts[r.doc_id][r.start : r.end]
        assert part in " ".join((texts[r.doc_id][: texts[r.doc_id].index(shared[k])][-8:], shared[k])) or shared[k][10:-60] in part or part[8:-8] in shared[k]
        assert r.first_doc == k and r.redundant == (r.doc_id != k)
        assert r.n_words >= chunks.MIN_WORDS


def test_without_redundant(make_docs):
    rows, holds, shared = corpus()
    docs = make_docs(rows + [(999, None)])
    out = chunks.without_redundant(docs, chunks.repeated_passages(docs))
    assert out.columns == docs.columns and out.count() == len(rows) + 1
    left = {r.doc_id: r.text for r in out.collect()}
    texts = dict(rows)
    for d, t in texts.items():
        if d in holds and d >= 12:
            assert len(t) - len(left[d]) > 250 and shared[holds[d]][100:250] not in left[d]
        else:
            assert left[d] == t


def test_a_line_seen_elsewhere_makes_no_passage_redundant(make_docs):
    """A short line of an unrelated earlier document, within a passage of two later ones: the first of these keeps the passage."""
    line, passage = " ".join(words(14, 61)), words(80, 62)
    passage = " ".join([*passage[:40], line, *passage[40:]])
    rows = [(1, " ".join([*words(60, 63), line, *words(60, 64)])), (2, " ".join([*words(50, 65), passage])), (3, " ".join([passage, *words(50, 66)]))]
    docs = make_docs(rows)
    found = chunks.repeated_passages(docs)
    assert {(r.doc_id, r.first_doc, r.redundant) for r in found.collect()} == {(2, 2, False), (3, 2, True)}
    left = {r.doc_id: r.text for r in chunks.without_redundant(docs, found).collect()}
    assert left[1] == rows[0][1] and left[2] == rows[1][1] and line not in left[3]


def test_lines_of_different_documents_are_no_passage(make_docs):
    """Every chunk of a text stands in some other document, but no 25 words of it in the same one."""
    text = words(120, 70)
    rows = [(k, " ".join([*words(60, 80 + k), *text[at : at + 22], *words(60, 200 + k)])) for k, at in enumerate(range(0, 98, 5))]
    assert chunks.repeated_passages(make_docs([(99, " ".join(text)), *rows])).where("doc_id = 99").count() == 0


def test_edges(make_docs):
    long_text = " ".join(words(30_000, 5))
    rows = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, long_text), (5, long_text), (None, long_text)]
    # Repeated rows of one doc_id, and a text without an id, are not another document.
    assert chunks.repeated_passages(make_docs(rows)).count() == 0
    got = chunks.repeated_passages(make_docs([*rows, (6, long_text)])).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.first_doc, r.redundant) for r in got if r.doc_id) == [(False, 5, 5, False), (False, 5, 5, False), (False, 6, 5, True)]
    assert [(r.first_doc, r.redundant) for r in got if r.doc_id is None] == [(5, True)]
    assert all((r.start, r.end) == (0, len(long_text)) for r in got)
    assert chunks.repeated_passages(make_docs([])).count() == 0


def test_periodic_texts_are_cut(make_docs):
    rows = [(1, "the " * 400), (2, " ".join(words(30, 1)) + " " + "the " * 200), (3, " ".join(words(40, 2)))]
    assert {r.doc_id for r in chunks.repeated_passages(make_docs(rows)).collect()} == {1, 2}
