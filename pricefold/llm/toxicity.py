"""Toxicity: subsequence string-kernel support vector machine with Nyström landmarks.

Kernel. A unit (a word, or a run of one-letter words such as "i d i o t") is the sequence ^ s1 ... sn $ of
its symbols: bytes of letters and digits. Its features are all subsequences of three symbols that span at most
``SPAN`` places, weighted LAMBDA ** (skipped places); other characters are no symbols, and a run of them is one
skipped place. So "id-iot" and "idxiot" share most of the features of "idiot". The kernel of two units is the inner
product of their features, scaled by the lengths of both.

Model. A text is toxic for a few of its units. Every unit of a clean labelled text is a clean sample, weighted by the
number of clean texts that hold it; of a toxic text the ``WITNESSES`` units with the strongest evidence over the
whole sample are toxic samples. All units take part, however rare. ``LANDMARKS`` units span the Nyström space; a squared-hinge SVM is fitted there by
Newton steps: tasks hold the samples' Nyström features and add up the loss, gradient and Hessian at given weights, which
are of fixed size and the only things that reach the driver, besides the landmarks. As the kernel's
features are explicit, the fitted function folds to one weight per feature: scoring a unit is a few table look-ups.
A text's score is a logistic function, fitted on the same training texts, of its three highest unit margins, the number of units that lean toxic, and its length.

The fit uses at most ``SAMPLE`` labelled texts (lowest hash of doc_id); scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricefold.llm.common import arrow_rows, crc_bucket, lowered, steps, stored, word_hashes, word_spans

SAMPLE = 8_000
LANDMARKS = 384
SPAN = 5
LAMBDA = 0.6
C = 10.0
#: Numbers that describe a text: see _features.
FEATURES = 5
#: Features are hashed to this many cells.
CELL_BITS = 18
#: Units of a toxic text that are toxic samples.
WITNESSES = 2
#: Tasks of the fit, and samples in a block of features.
FIT_TASKS = 12
BLOCK = 512
#: Units that margins takes at once.
UNITS = 8192
#: Bytes of text that are turned into features at once: each needs some 20 bytes of memory.
TEXT_BYTES = 1 << 20

_START, _END = 1, 2
#: Offsets (second symbol from the first, third from the second) whose span fits.
_OFFSETS = [(a, b) for a in range(1, SPAN - 1) for b in range(1, SPAN - a)]


def symbol_stream(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, places, bounds) of units data[starts[u]:ends[u]], each as ^ symbols $."""
    n = ends - starts
    at = np.concatenate(([0], np.cumsum(n)))
    idx = np.repeat(starts - at[:-1], n) + np.arange(at[-1])
    unit = np.repeat(np.arange(len(n)), n)
    b = data[idx]
    good = ((b >= 97) & (b <= 122)) | ((b >= 48) & (b <= 57)) | (b >= 128)
    before = np.zeros(len(b), bool)
    before[1:] = ~good[:-1] & (unit[1:] == unit[:-1])
    # A symbol is one place on from the last one, or two where others stand between.
    step = good + (good & before).astype(np.int64)
    kept = np.bincount(unit[good], minlength=len(n)) if len(n) else n
    bounds = np.concatenate(([0], np.cumsum(kept + 2)))
    sym = np.empty(bounds[-1], np.uint32)
    gap = np.ones(bounds[-1], np.int64)
    sym[bounds[:-1]] = _START
    sym[bounds[1:] - 1] = _END
    inner = np.ones(bounds[-1], bool)
    inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
    sym[inner] = b[good]
    gap[inner] = step[good]
    return sym, np.cumsum(gap), bounds


def triples(sym: np.ndarray, place: np.ndarray, bounds: np.ndarray):
    """For each pair of offsets: (rows of the stream, cells, weights) of the subsequences that start there."""
    unit = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    one, two, three = sym * np.uint32(0x9E3779B1), sym * np.uint32(0x85EBCA77), sym * np.uint32(0xC2B2AE3D)
    two, three = (two << np.uint32(7)) ^ (two >> np.uint32(9)), (three << np.uint32(13)) ^ (three >> np.uint32(5))
    power = (LAMBDA ** np.arange(SPAN)).astype(np.float32)
    for a, b in _OFFSETS:
        far = a + b
        if len(sym) <= far:
            continue
        span = place[far:] - place[:-far]
        rows = np.flatnonzero((unit[far:] == unit[:-far]) & (span < SPAN))
        key = (one[rows] + two[rows + a]) ^ three[rows + far]
        key *= np.uint32(0x27D4EB2F)
        yield rows, key >> np.uint32(32 - CELL_BITS), power[span[rows] - 2]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, bounds[:-1]) if len(bounds) > 1 else values[:0]


def unit_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the units of lower-cased texts: words, with runs of one-symbol words joined."""
    starts, ends, first = word_spans(data, offs)
    if not len(starts):
        return starts, ends, first
    # Symbols of a word: bytes of a character beyond ASCII count once.
    lead = ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 192)
    run = np.concatenate(([0], np.cumsum(lead)))
    short = run[ends] - run[starts] <= 1
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    joined = np.zeros(len(starts), bool)
    joined[1:] = short[1:] & short[:-1] & (text[1:] == text[:-1])
    head = np.flatnonzero(~joined)
    tail = np.concatenate((head[1:], [len(starts)])) - 1
    return starts[head], ends[tail], np.searchsorted(head, first)


def distinct_units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one example, number of its class for each unit)."""
    _, example, inverse = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return example, inverse


def margins(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    """The fitted function of each unit, clipped to [-2, 2]; UNITS of them at a time."""
    parts = [np.zeros(0, np.float32)]
    for at in range(0, len(starts), UNITS):
        sym, place, bounds = symbol_stream(data, starts[at : at + UNITS], ends[at : at + UNITS])
        total = np.zeros(len(sym), np.float32)
        square = np.zeros(len(sym), np.float32)
        for rows, cell, w in triples(sym, place, bounds):
            total[rows] += w * weight[cell]
            square[rows] += w * w
        parts.append(np.clip(_sums(total, bounds) / np.sqrt(np.maximum(_sums(square, bounds), 1e-12)) + bias, -2, 2))
    return np.concatenate(parts)


@dataclass
class Model:
    weight: np.ndarray  # per cell
    bias: float
    text: np.ndarray  # of the logistic function: the text features, then the constant


def _features(data: np.ndarray, offs: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    """Per text, over its distinct units: the three highest margins (-2 where there is none), log(1 + the
    sum of sigmoid(4 margin)), and log(1 + units)."""
    data = lowered(data)
    starts, ends, first = unit_spans(data, offs)
    n = len(offs) - 1
    out = np.full((n, FEATURES), -2.0)
    out[:, 3:] = 0
    if not len(starts):
        return out
    example, inverse = distinct_units(data, starts, ends)
    f = margins(data, starts[example], ends[example], weight, bias)
    text = np.repeat(np.arange(n), np.diff(first))
    pair = np.unique(text * len(example) + inverse)
    text, f = pair // len(example), f[pair % len(example)].astype(float)
    out[:, 3] = np.log1p(np.bincount(text, 1 / (1 + np.exp(-4 * f)), n))
    out[:, 4] = np.log1p(np.bincount(text, minlength=n))
    order = np.lexsort((-f, text))
    text, f = text[order], f[order]
    rank = np.arange(len(text)) - np.searchsorted(text, text)
    top = rank < 3
    out[text[top], rank[top]] = f[top]
    return out


def _probability(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ text[:-1] + text[-1], -30, 30)))


# ---------------------------------------------------------------- training


def block_sums(phi: np.ndarray, pos: np.ndarray, neg: np.ndarray, w: np.ndarray, c: float = C) -> np.ndarray:
    """Loss, gradient and Hessian (flat, without the penalty) of the squared hinge at weights w (bias last).

    Row i of phi is a toxic sample pos[i] and a clean one neg[i] times.
    """
    x = np.hstack([phi, np.ones((len(phi), 1), phi.dtype)])
    f = (x @ w.astype(x.dtype)).astype(float)
    ap, an = pos * (f < 1), neg * (f > -1)
    loss = c * ((ap * (1 - f) ** 2).sum() + (an * (1 + f) ** 2).sum())
    slope, bend = 2 * c * (ap * (f - 1) + an * (f + 1)), 2 * c * (ap + an)
    near = bend > 0  # the others lie beyond the margin and add nothing
    x, slope, bend = x[near], slope[near].astype(x.dtype), bend[near].astype(x.dtype)
    grad, hess = x.T @ slope, (x.T * bend) @ x
    return np.concatenate(([loss], grad.astype(float), hess.astype(float).ravel()))


def newton(sums, m: int, rounds: int = 30) -> np.ndarray:
    """Weights and bias of the squared-hinge SVM over m features; sums(w): block_sums added over all samples."""
    reg = np.ones(m + 1)
    reg[-1] = 1e-3

    def at(w):
        s = sums(w)
        return s[0] + 0.5 * (reg * w * w).sum(), s[1 : m + 2] + reg * w, s[m + 2 :].reshape(m + 1, m + 1) + np.diag(reg)

    w = np.zeros(m + 1)
    loss, grad, hess = at(w)
    for _ in range(rounds):
        move, step = np.linalg.solve(hess, grad), 1.0
        while True:
            new = at(w - step * move)
            if new[0] <= loss or step < 1e-4:
                break
            step /= 2
        if new[0] > loss:
            break
        before = loss
        w, (loss, grad, hess) = w - step * move, new
        if before - loss < 1e-6 * max(1.0, before):
            break
    return w


def _encode(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [u.encode() for u in units]
    ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
    return np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends


def _rows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit, cell, weight) of the units' features, scaled to length 1."""
    sym, place, bounds = symbol_stream(data, starts, ends)
    unit = np.repeat(np.arange(len(starts)), np.diff(bounds))
    parts = [(unit[r], k, w) for r, k, w in triples(sym, place, bounds)]
    u, k, w = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    scale = 1 / np.sqrt(np.maximum(np.bincount(u, w.astype(float) ** 2, len(starts)), 1e-12))
    return u, k, (w * scale[u]).astype(np.float32)


class Landmarks:
    """The Nyström space of some units: features of a unit are its kernel with the landmarks, whitened."""

    def __init__(self, units: list[str]):
        self.n = len(units)
        u, k, w = _rows(*_encode(units))
        self.cells, at = np.unique(k, return_inverse=True)
        self.table = np.zeros((len(self.cells), self.n), np.float32)
        np.add.at(self.table, (at, u), w)
        self.where = np.full(1 << CELL_BITS, -1, np.int64)
        self.where[self.cells] = np.arange(len(self.cells))
        values, vectors = np.linalg.eigh(self.in_blocks(units, self.kernel).astype(float))
        good = values > 1e-6 * values.max()
        self.root = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)

    def kernel(self, units: list[str]) -> np.ndarray:
        u, k, w = _rows(*_encode(units))
        k = self.where[k]
        u, k, w = u[k >= 0], k[k >= 0], w[k >= 0]
        order = np.argsort(u, kind="stable")
        u, k, w = u[order], k[order], w[order]
        out = np.zeros((len(units), self.n), np.float32)
        if len(u):
            heads = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
            out[u[heads]] = np.add.reduceat(self.table[k] * w[:, None], heads)
        return out

    def in_blocks(self, units: list[str], of, block: int = 32) -> np.ndarray:
        """Rows of ``of`` for a few units at a time: a unit's rows of the table are copied, so many at once take much memory."""
        return np.concatenate([of(units[i : i + block]) for i in range(0, len(units), block)])

    def features(self, units: list[str], block: int = 256) -> np.ndarray:
        return self.in_blocks(units, lambda some: self.in_blocks(some, self.kernel) @ self.root, block) if units else np.zeros((0, self.root.shape[1]), np.float32)

    def folded(self, w: np.ndarray) -> tuple[np.ndarray, float]:
        """(weight per cell, bias) of the fitted function."""
        weight = np.zeros(1 << CELL_BITS, np.float32)
        weight[self.cells] = self.table @ (self.root.astype(float) @ w[:-1])
        return weight, float(w[-1])


def samples_of(units: DataFrame, witnesses: int = WITNESSES) -> DataFrame:
    """(unit, pos, neg, odds) from (key, toxic, units) of the training texts.

    neg: clean texts that hold the unit; pos: toxic texts in which it is one of the strongest units. A unit's evidence is the number of
    toxic texts that hold it times the log of its rate in them over its rate in clean ones; equal evidence goes by the unit.
    odds: the same from pos and neg. Equal rows of a text (same key) count each.
    """
    each = stored(units.select("key", "toxic", F.explode("units").alias("unit")).groupBy("key", "toxic", "unit").agg(F.count("*").alias("n")), "units")
    counts = stored(each.groupBy("unit").agg(F.sum(F.expr("n * toxic")).alias("pos"), F.sum(F.expr("n * (1 - toxic)")).alias("neg")), "counts")

    def evidence(counts: DataFrame) -> DataFrame:
        total = counts.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("neg")).first()  # two numbers
        rate = lambda c: (F.col(c) + 0.5) / (total[c] + 1)
        return counts.withColumn("odds", F.col("pos") * F.log(rate("pos") / rate("neg")))

    strongest = Window.partitionBy("key").orderBy(F.desc("odds"), "unit")
    seen = each.where("toxic = 1").join(evidence(counts).select("unit", "odds"), "unit").withColumn("rank", F.row_number().over(strongest))
    witness = seen.where(F.col("rank") <= witnesses).groupBy("unit").agg(F.sum("n").alias("pos"))
    return evidence(stored(counts.select("unit", "neg").join(witness, "unit", "left").select("unit", F.coalesce("pos", F.lit(0)).alias("pos"), "neg"), "samples"))


def added(batches):
    """One row: the sum of the vectors ``s`` (doubles as bytes), in the order of ``part``."""
    rows = sorted((p, s) for b in batches for p, s in zip(b.column("part").to_pylist(), b.column("s").to_pylist()))
    yield pa.RecordBatch.from_arrays([pa.array([sum(np.frombuffer(s) for _, s in rows).tobytes()])], names=["s"])


def fit_units(samples: DataFrame, landmarks: int = LANDMARKS) -> tuple[np.ndarray, float]:
    """(weight per cell, bias) fitted on samples (unit, pos, neg, odds); zeros if one class is missing.

    Landmarks: the toxic samples of strongest evidence, up to half, and the commonest clean ones.
    """
    zero = np.zeros(1 << CELL_BITS, np.float32), 0.0
    toxic = [r["unit"] for r in samples.where("odds > 0").orderBy(F.desc("odds"), "unit").limit(landmarks // 2).select("unit").collect()]
    clean = [r["unit"] for r in samples.where("odds <= 0 AND neg > 0").orderBy(F.desc("neg"), "unit").limit(landmarks - len(toxic)).select("unit").collect()]
    if not toxic or not clean:
        return zero
    marks = sorted(toxic + clean)
    space = Landmarks(marks)
    m = space.root.shape[1]

    def features(batches):
        own = Landmarks(marks)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                phi = pa.array([x.tobytes() for x in own.features(rows.column("unit").to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([phi, *(rows.column(c).cast(pa.float64()) for c in ("pos", "neg"))], names=["phi", "pos", "neg"])

    used = samples.where("pos + neg > 0").select("unit", "pos", "neg").repartition(FIT_TASKS)  # a bounded sample's units
    # A sample a row and BLOCK of them in a batch, so a task holds about 1 MB of them whatever the sample's size.
    held = used.mapInArrow(features, "phi binary, pos double, neg double").cache()

    def sums(w):
        def add(batches):
            total = np.zeros(1 + (m + 1) + (m + 1) ** 2)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    rows = batch.slice(at, BLOCK)
                    phi = np.frombuffer(b"".join(rows.column("phi").to_pylist()), np.float32).reshape(-1, m)
                    total += block_sums(phi, rows.column("pos").to_numpy(), rows.column("neg").to_numpy(), w)
            # The Hessian is symmetric: half of it, which keeps a task's result small.
            half = total[m + 2 :].reshape(m + 1, m + 1)[np.triu_indices(m + 1)]
            row = [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.concatenate((total[: m + 2], half)).tobytes()])]
            yield pa.RecordBatch.from_arrays(row, names=["part", "s"])

        # FIT_TASKS rows of fixed size, added in a task: the driver gets one of them a step.
        parts = np.frombuffer(held.mapInArrow(add, "part int, s binary").repartition(1).mapInArrow(added, "s binary").collect()[0]["s"])
        hess = np.zeros((m + 1, m + 1))
        hess[np.triu_indices(m + 1)] = parts[m + 2 :]
        return np.concatenate((parts[: m + 2], (hess + np.triu(hess, 1).T).ravel()))

    with arrow_rows(samples.sparkSession, BLOCK):
        w = newton(sums, m)
    held.unpersist()
    return space.folded(w)


def fit_texts(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression of the label on the text features, by Newton steps."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return np.append(np.zeros(FEATURES), np.log(p / (1 - p)) if len(y) else -30.0)
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(FEATURES + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z.T * (p * (1 - p) + 1e-9)) @ z + ridge * np.eye(FEATURES + 1)
        move = np.linalg.solve(hess, z.T @ (p - y) + ridge * w)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def _units_of_texts(batches):
    for rows, data, offs in steps(batches, most=TEXT_BYTES):
        data = lowered(data)
        starts, ends, first = unit_spans(data, offs)
        raw = data.tobytes()
        units = [list({raw[s:e] for s, e in zip(starts[a:b], ends[a:b])}) for a, b in zip(first[:-1], first[1:])]
        units = [[u.decode("utf-8", "replace") for u in us] for us in units]
        yield pa.RecordBatch.from_arrays([rows.column("key"), rows.column("toxic"), pa.array(units, pa.list_(pa.string()))], names=["key", "toxic", "units"])


def training_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int = 0) -> DataFrame:
    """(key, toxic, text): at most ``sample`` labelled texts outside the held-out fold, by lowest hash of doc_id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(crc_bucket(F.col("_id")) != held_out).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(known), "_id").select(F.xxhash64("_id", "text").alias("key"), "toxic", "text")  # at most SAMPLE rows


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int = 0) -> Model:
    """Fit on the labelled rows of ``docs`` (doc_id, text) whose crc32(doc_id) mod 5 is not ``held_out``.

    Only the text and labels.toxic are used. Null texts count as empty, null ids and labels are left out, repeated
    labels of an id count as toxic if any is. With no rows, or one class only, the model gives the class rate.
    """
    spark = docs.sparkSession
    texts = training_texts(docs, labels, sample, held_out).cache()
    units = texts.mapInArrow(_units_of_texts, "key long, toxic int, units array<string>")
    with arrow_rows(spark, BLOCK):
        weight, bias = fit_units(samples_of(units))
    sent = spark.sparkContext.broadcast(cloudpickle.dumps((weight, bias)))

    names = [f"x{i}" for i in range(FEATURES)]

    def featured(batches):
        weight, bias = cloudpickle.loads(sent.value)
        for rows, data, offs in steps(batches, most=TEXT_BYTES):
            x = _features(data, offs, weight, bias)
            yield pa.RecordBatch.from_arrays([rows.column("toxic"), *(pa.array(x[:, i]) for i in range(FEATURES))], names=["toxic", *names])

    with arrow_rows(spark, BLOCK):
        x = texts.mapInArrow(featured, "toxic int" + "".join(f", {x} double" for x in names)).toArrow()
    texts.unpersist()
    return Model(weight, bias, fit_texts(np.stack([x[c].to_numpy() for c in names], axis=1), x["toxic"].to_numpy().astype(float)))


# ---------------------------------------------------------------- scoring


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a last column ``score`` (double, 0 to 1) of each whole text, within each task.

    Null and empty texts get the score of a text without units; equal texts get equal scores; columns pass through
    (an own column score keeps its name, the added one then ends in an underscore).
    """
    name = "score"
    while name in docs.columns:
        name += "_"
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = names.index("text")
    own = own.withColumn(f"c{text}", F.col(f"c{text}").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def scored(batches):
        m = cloudpickle.loads(sent.value)
        for rows, data, offs in steps(batches, f"c{text}", TEXT_BYTES):
            p = _probability(_features(data, offs, m.weight, m.bias), m.text)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(p)], names=[*rows.schema.names, "p"])

    schema = T.StructType([*own.schema.fields, T.StructField("p", T.DoubleType())])
    return own.mapInArrow(scored, schema).toDF(*names, name)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, columns unchanged."""
    names = docs.columns
    scored = score(docs, train(docs, labels))
    return scored.where(F.col(scored.columns[-1]) < threshold).select(*[F.col(f"`{c}`") for c in names])
