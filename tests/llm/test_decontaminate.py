import random

from conftest_llm import words

from pricefold.llm import decontaminate
from pricefold.llm.common import words_of


def brute(docs, items):
    def shingles(text):
        w = words_of(text)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    out = []
    for d, t in docs:
        own = shingles(t)
        for i, u in items:
            item = shingles(u)
            n = len(item & own)
            if item and 100 * n >= 75 * len(item):
                out.append((d, i, len(item), n))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.item_id, r.n_item_shingles, r.n_common) for r in df.collect()), key=str)


def corpus():
    rng = random.Random(3)
    items = [(i, " ".join(words(rng.choice((5, 7, 12, 20, 33, 64, 120)), 100 + i))) for i in range(40)]
    docs = []
    for d in range(60):
        text = words(rng.choice((3, 40, 400, 3000)), 1000 + d)
        if d % 3 == 0:
            item = items[rng.randrange(len(items))][1].split()
            if d % 2:
                for _ in range(max(1, len(item) // 40)):
                    item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(text))
            text = text[:at] + item + text[at:]
        if d % 7 == 0:  # an item in two halves, far apart
            item = items[rng.randrange(len(items))][1].split()
            text = item[: len(item) // 2 + 2] + text + item[len(item) // 2 - 2 :]
        docs.append((d, " ".join(text).upper() if d % 5 == 0 else " ".join(text)))
    return docs, items


def test_equals_brute_force(spark, make_docs):
    docs, items = corpus()
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id")
    assert len(brute(docs, items)) > 15
    assert found(decontaminate.contaminated(make_docs(docs, clashing=True), bench)) == brute(docs, items)


def test_blocks_of_items_give_the_same(spark, make_docs, monkeypatch):
    docs, items = corpus()
    blocks = list(decontaminate.item_blocks(spark.createDataFrame(items, "item_id long, text string"), most=200))
    assert len(blocks) > 3 and sum(len(b.ids) for b in blocks) == len(items)
    monkeypatch.setattr(decontaminate, "item_blocks", lambda b: iter(blocks))
    assert found(decontaminate.contaminated(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"))) == brute(docs, items)


def test_edges(spark, make_docs):
    docs = [(1, None), (2, ""), (3, "Two Words"), (4, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (5, "two words more")]
    items = [(1, None), (2, ""), (3, "two words"), (None, "a b c d e f")]
    out = found(decontaminate.contaminated(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")))
    assert out == sorted([(3, 3, 1, 1), (4, None, 2, 2), (4, None, 2, 2), (None, None, 2, 2)], key=str)


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    assert decontaminate.contaminated(make_docs([(1, "a b")]), none).count() == 0
    assert decontaminate.contaminated(make_docs([]), one).count() == 0
    assert decontaminate.decontaminated(make_docs([]), one).count() == 0


def test_decontaminated_filters_rows(spark, make_docs):
    docs, items = corpus()
    frame = make_docs(docs + [(None, None), (7, "clean row")], clashing=True)
    out = decontaminate.decontaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    bad = {d for d, *_ in brute(docs, items)}
    assert out.columns == frame.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted([d for d, _ in docs if d not in bad] + [7])
    assert out.where("doc_id IS NULL").count() == 1
