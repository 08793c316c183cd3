import random

import numpy as np
import pytest
from conftest_llm import words

from pricefold.llm import toxicity

INSULTS = ["idiot", "worthless", "pathetic", "moron"]
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        text = words(rng.choice((8, 30, 120)), 5000 + i)
        toxic = int(rng.random() < 0.25)
        for _ in range(2 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark, make_docs):
    rows, labels = corpus()
    return rows, labels, toxicity.train(make_docs(rows, clashing=True), spark.createDataFrame(labels, LABELS))


def scores(make_docs, model, texts):
    got = toxicity.score(make_docs(list(enumerate(texts))), model)
    return [r.score for r in got.orderBy("doc_id").collect()]


def test_held_out_accuracy(make_docs, fitted):
    import zlib

    rows, labels, model = fitted
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    got = scores(make_docs, model, [rows[i][1] for i in held])
    right = sum((s >= 0.5) == bool(labels[i][2]) for i, s in zip(held, got))
    assert right >= 0.97 * len(held)


def test_gapped_and_inserted_characters(make_docs, fitted):
    model = fitted[2]
    clean = " ".join(words(20, 77))
    tricks = ["id-iot", "i.d.i.o.t", "idxiot", "w o r t h l e s s", "wor*thless", "pathe.tic", "mo-ron", "IDIOT!!", "moron,", "%%%idiot###", "i - d - i - o - t"]
    got = scores(make_docs, model, [f"{clean} {t} and {t} {clean}" for t in tricks] + [clean])
    assert all(s >= 0.5 for s in got[:-1]), dict(zip(tricks, got))
    assert got[-1] < 0.5


def test_kernel_equals_enumeration():
    """The folded look-ups equal the sum over all subsequences of three symbols with their gap weights."""

    def features(word):
        s = [(toxicity._START, 0)]
        place, gap = 0, False
        for b in word.encode():
            if chr(b).isalnum() or b >= 128:
                place += 2 if gap else 1
                s.append((b, place))
                gap = False
            else:
                gap = len(s) > 0
        s.append((toxicity._END, place + 1))
        out = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, len(s)):
                    span = s[k][1] - s[i][1]
                    if span < toxicity.SPAN:
                        f = (s[i][0], s[j][0], s[k][0])
                        out[f] = out.get(f, 0) + toxicity.LAMBDA ** (span - 2)
        return out

    for word in ("idiot", "i-d.iot", "abababa", "é1", "a"):
        data, starts, ends = toxicity._encode([word])
        sym, place, bounds = toxicity.symbol_stream(data, starts, ends)
        total = sum(float(w.sum()) for _, _, w in toxicity.triples(sym, place, bounds))
        assert total == pytest.approx(sum(features(word).values()), rel=1e-5), word


def test_edges(spark, make_docs, fitted):
    model = fitted[2]
    got = scores(make_docs, model, [None, "", " \n", "%%% ---", "x", " ".join(words(40_000, 8))])
    assert all(0 <= s < 0.5 for s in got) and got[0] == got[1] == got[2]
    docs = make_docs([(None, "idiot moron"), (1, "idiot moron"), (1, "idiot moron")], clashing=True)
    out = toxicity.score(docs, model)
    assert out.columns == [*docs.columns, "score_"] and len({r.score_ for r in out.collect()}) == 1
    assert toxicity.score(make_docs([]), model).count() == 0
    none = spark.createDataFrame([], LABELS)
    blank = toxicity.train(make_docs([(1, "a")]), none)
    assert scores(make_docs, blank, ["idiot"])[0] < 1e-9
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 0, 0), (2, 0, 0), (3, 1, 5)], LABELS)
    assert scores(make_docs, toxicity.train(make_docs([(2, "a b"), (2, None)]), odd), ["a"])[0] < 0.5


def test_without_toxic_keeps_columns(spark, make_docs):
    rows, labels = corpus()
    docs = make_docs(rows + [(None, None)], clashing=True)
    out = toxicity.without_toxic(docs, spark.createDataFrame(labels, LABELS))
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert None in kept
    wrong = sum((i in kept) == bool(t) for i, _, t in labels)
    assert wrong <= 0.03 * len(labels)


def test_newton_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = x[:, 0] - 0.5 * x[:, 1] > 0
    w = toxicity.newton(lambda w: toxicity.block_sums(x, y.astype(float), (~y).astype(float), w), 5)
    assert ((x @ w[:-1] + w[-1] > 0) == y).mean() > 0.97


def samples(spark, rows, witnesses=toxicity.WITNESSES):
    return toxicity.samples_of(spark.createDataFrame(rows, "key long, toxic int, units array<string>"), witnesses)


def test_every_unit_stays_and_toxic_texts_have_their_witnesses(spark):
    rows = [(1, 1, ["idiot", "alone", "the", "of", "and"]), (2, 1, ["idiot", "the", "of", "and", "rare"]), (2, 1, ["idiot", "the", "of", "and", "rare"]), (3, 0, ["the", "of", "and", "once"]), (4, 0, ["the", "of", "and"])]
    got = {r.unit: (r.pos, r.neg) for r in samples(spark, rows, 3).collect()}
    assert got == {"idiot": (3, 0), "alone": (1, 0), "rare": (2, 0), "and": (3, 2), "the": (0, 2), "of": (0, 2), "once": (0, 1)}


def test_fit_on_spark_equals_one_block(spark):
    """Brute force: the same SVM solved over all samples at once, by gradient descent on the explicit kernel's Nyström features."""
    rows = [(i, int(i % 4 == 0), words(12, i) + (["idiot", "worth-less"] if i % 4 == 0 else [])) for i in range(80)]
    found = samples(spark, rows)
    weight, bias = toxicity.fit_units(found, landmarks=40)
    table = found.where("pos + neg > 0").toPandas()
    toxic = found.where("odds > 0").toPandas().sort_values(["odds", "unit"], ascending=[False, True]).unit[:20].tolist()
    clean = found.where("odds <= 0 AND neg > 0").toPandas().sort_values(["neg", "unit"], ascending=[False, True]).unit[: 40 - len(toxic)].tolist()
    space = toxicity.Landmarks(sorted(toxic + clean))
    phi, pos, neg = space.features(table.unit.tolist()).astype(float), table.pos.to_numpy(float), table.neg.to_numpy(float)
    x, reg = np.hstack([phi, np.ones((len(phi), 1))]), np.append(np.ones(phi.shape[1]), 1e-3)

    def gradient(w):
        f = x @ w
        return reg * w + 2 * toxicity.C * x.T @ (pos * np.minimum(f - 1, 0) + neg * np.maximum(f + 1, 0))

    w = np.zeros(x.shape[1])
    rate = 1 / (2 * toxicity.C * np.linalg.norm((x.T * (pos + neg)) @ x, 2) + 1)
    momentum, last = w.copy(), 1.0
    for _ in range(20_000):
        new = momentum - rate * gradient(momentum)
        now = (1 + (1 + 4 * last**2) ** 0.5) / 2
        momentum, w, last = new + (last - 1) / now * (new - w), new, now
    want, b = space.folded(w)
    data, starts, ends = toxicity._encode(table.unit.tolist())
    got = toxicity.margins(data, starts, ends, weight, bias)
    assert got == pytest.approx(toxicity.margins(data, starts, ends, want, b), abs=2e-2)


def test_landmarks_take_little_memory(spark):
    """A unit's rows of the table are copied for a few units at a time only: the driver builds the space too."""
    import tracemalloc

    units = sorted({a + b + c for a, b, c in zip(words(900, 1), words(900, 2), words(900, 3))})[:384]
    tracemalloc.start()
    space = toxicity.Landmarks(units)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert space.n == 384 and peak < 4 * space.table.nbytes + (30 << 20)
    assert np.array_equal(space.in_blocks(units, space.kernel), space.kernel(units))


def test_steps_of_the_fit_send_the_driver_one_row(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    rows = [(i, int(i % 4 == 0), words(12, i) + (["idiot", "worth-less"] if i % 4 == 0 else [])) for i in range(40)]
    found, sent, collect = samples(spark, rows), [], Frame.collect
    monkeypatch.setattr(Frame, "collect", lambda self: (sent.append((self.columns, out := collect(self))), out)[1])
    weight, _ = toxicity.fit_units(found, landmarks=20)
    assert weight.any()
    assert {len(out) for columns, out in sent if columns == ["s"]} == {1}


def test_vectors_are_added_in_order_of_their_parts():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array([np.full(2, x).tobytes() for x in v])], names=["part", "s"]) for p, v in (([2, 0], [1.0, 1e16]), ([1], [-1e16]))]
    assert np.frombuffer(next(toxicity.added(batches)).column("s")[0].as_py()).tolist() == [1.0, 1.0]


def test_rows_of_the_fit_hold_one_sample_each(spark, monkeypatch):
    """Spark bounds a batch by rows: blocks of samples in a row made batches that grew with the sample."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    rows = [(i, int(i % 4 == 0), words(12, i) + (["idiot", "worth-less"] if i % 4 == 0 else [])) for i in range(40)]
    found, cached, cache = samples(spark, rows), [], Frame.cache
    monkeypatch.setattr(Frame, "cache", lambda self: (cached.append(self), cache(self))[1])
    toxicity.fit_units(found, landmarks=20)
    held = [f for f in cached if "phi" in f.columns][0]
    assert held.count() == found.where("pos + neg > 0").count()
    assert held.selectExpr("max(length(phi))").first()[0] <= 4 * 20


def traced(f):
    """(result, peak bytes of Python memory)."""
    import tracemalloc

    tracemalloc.start()
    out = f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_features_of_samples_take_little_memory():
    units = sorted({a + b + c for a, b, c in zip(words(3000, 1), words(3000, 2), words(3000, 3))})
    space, some = toxicity.Landmarks(units[:384]), units[384 : 384 + toxicity.BLOCK]
    got, peak = traced(lambda: space.features(some))
    assert len(some) == toxicity.BLOCK and peak < 10 * got.nbytes + (8 << 20)
    assert got == pytest.approx(space.kernel(some) @ space.root, abs=1e-4)


def test_scoring_a_step_takes_little_memory():
    from pricefold.llm import common

    texts = [" ".join(a + b + c for a, b, c in zip(words(20_000, 3 * i), words(20_000, 3 * i + 1), words(20_000, 3 * i + 2))) for i in range(12)]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8)[: common.STEP_BYTES], np.cumsum([0] + [len(r) for r in raw])
    offs = np.minimum(offs, len(data))
    weight = np.random.default_rng(0).normal(size=1 << toxicity.CELL_BITS).astype(np.float32)
    got, peak = traced(lambda: toxicity._features(data, offs, weight, 0.1))
    assert len(data) == common.STEP_BYTES and peak < 25 * len(data), peak / len(data)


def test_blocks_of_bytes_and_units_change_nothing(monkeypatch):
    from pricefold.llm import common

    data, starts, ends = toxicity._encode([*words(3000, 5), "x" * 5000, "id-iot", "\u00e9"])
    weight = np.random.default_rng(0).normal(size=1 << toxicity.CELL_BITS).astype(np.float32)
    whole = common.word_hashes(data, starts, ends), toxicity.margins(data, starts, ends, weight, 0.1)
    monkeypatch.setattr(common, "HASH_BYTES", 100)
    monkeypatch.setattr(toxicity, "UNITS", 7)
    assert np.array_equal(common.word_hashes(data, starts, ends), whole[0])
    assert np.array_equal(toxicity.margins(data, starts, ends, weight, 0.1), whole[1])
    assert len(toxicity.margins(data, starts[:0], ends[:0], weight, 0.1)) == 0


def test_batches_of_the_fit_are_small_and_the_session_keeps_its_setting(spark, make_docs, monkeypatch):
    """Batches of 10,000 samples or texts took tens of MB in the JVM and again in each Python worker."""
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, collect, to_arrow = spark.conf.get(key, None), Frame.collect, Frame.toArrow
    monkeypatch.setattr(Frame, "collect", lambda self: (seen.append(spark.conf.get(key, None)) if self.columns == ["s"] else None, collect(self))[1])
    monkeypatch.setattr(Frame, "toArrow", lambda self: (seen.append(spark.conf.get(key, None)), to_arrow(self))[1])
    rows, labels = corpus(80)
    toxicity.train(make_docs(rows), spark.createDataFrame(labels, LABELS))
    assert len(seen) > 2 and {int(n or 10_000) for n in seen} == {toxicity.BLOCK}
    assert spark.conf.get(key, None) == before


@pytest.mark.parametrize("own, inside", [(None, 7), ("3", 3), ("50", 7), ("0", 7), ("-1", 7)])
def test_arrow_rows(spark, own, inside):
    import pyarrow as pa

    from pricefold.llm.common import arrow_rows

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    sizes = spark.range(0, 60, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    try:
        spark.conf.unset(key) if own is None else spark.conf.set(key, own)
        with pytest.raises(ValueError), arrow_rows(spark, 7):
            assert max(r.n for r in sizes.collect()) == inside
            raise ValueError
        assert spark.conf.get(key, None) == own
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_scoring_a_batch_takes_little_memory(make_docs, monkeypatch):
    """A batch of many MB of text is scored about 1 MB at a time."""
    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    texts = [" ".join(a + b + c for a, b, c in zip(words(3000, 3 * i), words(3000, 3 * i + 1), words(3000, 3 * i + 2))) for i in range(150)]
    weight = np.random.default_rng(0).normal(size=1 << toxicity.CELL_BITS).astype(np.float32)
    model, run, map_in_arrow = toxicity.Model(weight, 0.1, np.append(np.ones(toxicity.FEATURES), -3.0)), [], Frame.mapInArrow
    monkeypatch.setattr(Frame, "mapInArrow", lambda self, f, *a, **b: (run.append(f), map_in_arrow(self, f, *a, **b))[1])
    docs = make_docs([])
    toxicity.score(docs, model)
    batch = pa.RecordBatch.from_arrays([pa.array(texts) if c == "text" else pa.nulls(len(texts), pa.string()) for c in docs.columns], names=[f"c{i}" for i in range(len(docs.columns))])
    assert sum(map(len, texts)) > 4 << 20
    got, peak = traced(lambda: [b.column("p").to_pylist() for b in run[0]([batch])])
    assert peak < 48 << 20, peak
    monkeypatch.setattr(toxicity, "TEXT_BYTES", 1 << 30)
    assert [p for part in got for p in part] == [p for b in run[0]([batch]) for p in b.column("p").to_pylist()]
