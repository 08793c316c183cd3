import random

import pytest
from conftest_llm import words

import corpus_pipeline
from pricefold.llm import queries

INSULTS = ["idiot", "worthless", "pathetic", "moron"]
CARD = "4111111111111111"


@pytest.fixture(scope="module")
def planted(spark, make_docs, tmp_path_factory):
    """A folder of tables with planted cases, and the doc_ids of each kind."""
    rng = random.Random(12)
    sf = tmp_path_factory.mktemp("tables")
    rows, labels, ids = [], [], {"toxic": set(), "copies": set(), "leaks": set(), "clean": set(), "pii": set()}
    items = [(i, " ".join(words(30, 700 + i))) for i in range(5)]
    for d in range(300):
        text = words(rng.choice((20, 60, 200)), 8000 + d)
        if d % 4 == 0:
            kind = "toxic"
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        elif d % 25 == 1:
            kind = "leaks"
            text[5:5] = items[d % 5][1].split()
        elif d % 10 == 3:
            kind = "pii"
            text.insert(3, CARD)
        else:
            kind = "clean"
        ids[kind].add(d)
        labels.append((d, 1, int(kind == "toxic")))
        rows.append((d, " ".join(text), f"s{d % 3}"))
    for d in range(300, 340):  # near copies of one clean document
        text = rows[2][1].split()
        if d % 2:
            text[rng.randrange(len(text))] = "other"
        ids["copies"].add(d)
        rows.append((d, " ".join(text), "s0"))
    rows += [(None, None, None), (None, "", "s1")]
    make_docs(rows, clashing=True).write.parquet(str(sf / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(sf / "benchmark.parquet"))
    return str(sf), ids, dict((r[0], r[1]) for r in rows if r[0] is not None)


def test_stages_keep_columns_and_take_effect(spark, planted):
    sf, ids, texts = planted
    docs = corpus_pipeline.table(spark, sf, "documents")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), name)
        assert docs.columns[: len(names)] == names and (name == "mixing" or docs.columns == names)
        left[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    after = {n: {d for d in v if d is not None} for n, v in left.items()}
    clean = ids["clean"] | ids["pii"]
    assert len(ids["toxic"] & after["toxicity"]) <= 2 and clean | ids["leaks"] | ids["copies"] <= after["toxicity"] | set(list(ids["copies"])[:0])
    assert after["near_duplicates"] == after["toxicity"] - ids["copies"]
    assert after["decontamination"] == after["near_duplicates"] - ids["leaks"]
    assert after["pii"] == after["decontamination"]
    assert all(v.count(None) == 2 for n, v in left.items() if n != "mixing")
    pii = corpus_pipeline.STAGES[3][1](spark, corpus_pipeline.table(spark, sf, "documents"), sf)
    new = {r.doc_id: (r.text, r.n_chars) for r in pii.collect()}
    assert all(CARD not in new[d][0] for d in ids["pii"]) and len({new[d][0].split()[3] for d in ids["pii"]}) == 1
    assert all(new[d] == (t, len(t)) for d, t in texts.items() if d not in ids["pii"])


def test_run_equals_its_stages(spark, planted):
    sf, ids, _ = planted
    out = corpus_pipeline.run(spark, sf)
    docs = corpus_pipeline.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), name)
    key = ["doc_id", "text", "copy_", "shuffle_key"]
    assert sorted(out.select(key).collect(), key=str) == sorted(docs.select(key).collect(), key=str)


def test_empty_tables(spark, planted, tmp_path):
    sf = planted[0]
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(queries.ORACLES) <= set(names)
