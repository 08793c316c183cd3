"""Boosted regression trees of many folds at once: a job adds up one level of the current tree of every fold.

The fit is that of Spark ML's ``GBTRegressor`` (squared error, variance gain, every feature at every node, candidate thresholds by weighted
quantiles), which fits one model at a time: each level of each tree is a job of its own with three broadcasts of the driver. Here the number of jobs is
that of one model, whatever the number of folds; the driver gets a histogram a node, as many as the folds have, whatever the number of rows.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The functions below run on executors; ship them by value so executors need no package path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins of a feature, as in Spark ML; a byte holds one.
BINS = 32
#: Rows of a fold from which thresholds are taken, as in Spark ML; all rows are fitted.
CANDIDATE_ROWS = 10_000
STEP_SIZE = 0.1
#: Trees after which the rows' fits so far are stored with the rows.
STORE_EVERY = 10
EPSILON = np.finfo(float).eps


@dataclass
class Trees:
    """A fold's trees as heaps (node 1 is the root, 2i and 2i + 1 are below i): feature (-1 at leaves), the last bin and the threshold that go left, and value."""

    depth: int
    feature: list[np.ndarray] = field(default_factory=list)
    last: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def add(self) -> None:
        n = 2 ** (self.depth + 1)
        for held, empty in ((self.feature, np.full(n, -1)), (self.last, np.zeros(n, int)), (self.threshold, np.zeros(n)), (self.value, np.zeros(n))):
            held.append(empty)

    def since(self, t: int) -> Trees:
        """The same places without the trees before ``t``, for tasks that need the others only."""
        return Trees(self.depth, *([None] * t + held[t:] for held in (self.feature, self.last, self.threshold, self.value)))

    def nodes(self, t: int, x: np.ndarray, binned: bool) -> np.ndarray:
        """The node of tree ``t`` that each row of ``x`` ends in."""
        node, rows = np.ones(len(x), int), np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[t][node]
            left = x[rows, np.maximum(f, 0)] <= (self.last if binned else self.threshold)[t][node]
            node = np.where(f < 0, node, 2 * node + ~left)
        return node

    def fitted(self, x: np.ndarray, start: int = 0, stop: int | None = None, binned: bool = False, so_far: np.ndarray | float = 0.0) -> np.ndarray:
        """``so_far`` and the trees from ``start`` to ``stop``; the first counts fully, the others by the step size."""
        out = np.zeros(len(x)) + so_far
        for t in range(start, len(self.value) if stop is None else stop):
            out = out + self.value[t][self.nodes(t, x, binned)] * (STEP_SIZE if t else 1.0)
        return out


def thresholds(values: np.ndarray, weights: np.ndarray, total: float, most: int) -> np.ndarray:
    """At most ``most`` thresholds between distinct values, nearest to equal shares of the ``total`` weight; zeros have what weight the others leave."""
    full = values != 0
    distinct, at = np.unique(values[full], return_inverse=True)
    if not len(distinct):
        return np.zeros(0)
    w = np.bincount(at, weights[full], len(distinct))
    if (rest := total - w.sum()) > EPSILON * full.sum() * 100:
        place = np.searchsorted(distinct, 0.0)
        distinct, w = np.insert(distinct, place, 0.0), np.insert(w, place, rest)
    between = (distinct[:-1] + distinct[1:]) / 2.0 + 0.0
    if len(between) <= most:
        return between
    share = total / (most + 1)
    found, target, now = [], share, float(w[0])
    for i, weight in enumerate(w[1:].tolist()):
        before, now = now, now + weight
        if abs(before - target) < abs(now - target):
            found.append(between[i])
            target += share
    return np.array(found)


def candidates(rows: DataFrame, features: list[str], totals: dict, keys: list[str], seed: int) -> dict[int, list[np.ndarray]]:
    """Thresholds of every feature of every fold. totals: fold to (rows, weight)."""
    share = {k: min(1.0, max(BINS**2, CANDIDATE_ROWS) / n) for k, (n, _) in totals.items()}
    if min(share.values()) < 1:
        drawn = " ".join(f"WHEN {k} THEN {s!r}D" for k, s in share.items())
        rows = rows.where(f"(CAST(pmod(xxhash64({', '.join(keys)}, fold, {seed}), 9007199254740992) AS DOUBLE) + 0.5D) / 9007199254740992.0D < CASE fold {drawn} END")

    def found(table: pa.Table) -> pa.Table:
        k = table["fold"][0].as_py()
        n, weight = totals[k]
        w = table["w"].to_numpy()
        out = [thresholds(table[c].to_numpy(), w, share[k] * weight, min(BINS, n) - 1).tolist() for c in features]
        return pa.table({"fold": pa.array([k] * len(out), pa.int32()), "j": pa.array(range(len(out)), pa.int32()), "at": pa.array(out, pa.list_(pa.float64()))})

    got = rows.select("fold", "w", *features).groupBy("fold").applyInArrow(found, "fold int, j int, at array<double>").collect()
    at = {(r["fold"], r["j"]): np.array(r["at"], float) for r in got}
    return {k: [at.get((k, j), np.zeros(0)) for j in range(len(features))] for k in totals}


def binned(rows: DataFrame, features: list[str], at: dict[int, list[np.ndarray]]) -> RDD:
    """Blocks (fold, bins a row, weights, targets, fits so far) of the rows, in their partitions and order."""

    def pack(batches):
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            for k in np.unique(fold).tolist():
                own = np.flatnonzero(fold == k)
                x = np.stack([np.searchsorted(t, batch.column(c).to_numpy()[own]) for c, t in zip(features, at[k])], axis=1).astype(np.uint8)
                w, y = (batch.column(c).to_numpy()[own] for c in ("w", "y"))
                yield pa.RecordBatch.from_pydict({"fold": pa.array([k], pa.int32()), "x": [x.tobytes()], "w": [w.tobytes()], "y": [y.tobytes()]})

    packed = rows.select("fold", "w", "y", *features).mapInArrow(pack, "fold int, x binary, w binary, y binary")
    return packed.rdd.map(lambda r: (r[0], bytes(r[1]), bytes(r[2]), bytes(r[3]), bytes(len(r[2]))))


def histograms(blocks: RDD, models: dict[int, Trees], asked: dict[int, list[int]], k: int, stored: int, grown: int) -> dict[int, np.ndarray]:
    """For each fold and each of its nodes ``asked`` of the tree that grows: weight, sums of the targets and their squares and rows, by feature and bin.

    ``grown`` trees are done, ``stored`` of them are in the blocks. The sums of the tasks are added in the order of the partitions.
    """

    sent = {fold: models[fold].since(stored) for fold in asked}

    def sums(part):
        out = {}
        for fold, x, w, y, fits in part:
            if fold not in asked:
                continue
            model, x, w, y = sent[fold], np.frombuffer(x, np.uint8).reshape(-1, k), np.frombuffer(w), np.frombuffer(y)
            if grown:
                y = 2.0 * (y - model.fitted(x, stored, grown, True, np.frombuffer(fits)))
            place = np.full(2 ** (model.depth + 1), -1)
            place[asked[fold]] = range(len(asked[fold]))
            slot = place[model.nodes(grown, x, True)]
            here = slot >= 0
            slot, x, w, y = slot[here], x[here], w[here], y[here]
            h = np.empty((len(asked[fold]), k, BINS, 4))
            for j in range(k):
                cell = slot * BINS + x[:, j]
                for s, v in enumerate((w, w * y, w * y * y, None)):
                    h[:, j, :, s] = np.bincount(cell, v, h.shape[0] * BINS).reshape(-1, BINS)
            out[fold] = out[fold] + h if fold in out else h
        at = TaskContext.get().partitionId()
        return [(fold, (at, h)) for fold, h in out.items()]

    def added(parts):
        first, *rest = (h for _, h in sorted(parts, key=lambda p: p[0]))
        total = first.copy()
        for h in rest:
            total += h
        return total

    return dict(blocks.mapPartitions(sums).groupByKey(min(len(asked), blocks.getNumPartitions())).mapValues(added).collect())


def impurity(s: np.ndarray) -> np.ndarray:
    """Variance of the targets, from (weight, sum, sum of squares, ...) in the last dimension; 0 without weight."""
    with np.errstate(all="ignore"):
        return np.where(s[..., 0] == 0, 0.0, (s[..., 2] - s[..., 1] * s[..., 1] / s[..., 0]) / s[..., 0])


def best_split(h: np.ndarray, counts: list[int], whole: np.ndarray | None):
    """(gain, feature, last bin to the left, left sums, right sums) of the largest gain, the first of equal ones; None without a valid split."""
    best = None
    for j, n in enumerate(counts):
        if not n:
            continue
        left = np.cumsum(h[j, : n + 1], axis=0)
        left, right = left[:-1], left[-1] - left[:-1]
        whole = left[0] + right[0] if whole is None else whole
        total = left[:, 0] + right[:, 0]
        with np.errstate(all="ignore"):
            gain = impurity(whole) - left[:, 0] / total * impurity(left) - right[:, 0] / total * impurity(right)
        gain[(left[:, 3] < 1) | (right[:, 3] < 1) | ~(gain >= 0)] = -np.inf
        i = int(np.argmax(gain))
        if gain[i] > (best[0] if best else -np.inf):
            best = (gain[i], j, i, left[i], right[i])
    return best


def fit(rows: DataFrame, features: list[str], totals: dict[int, tuple[int, float]], keys: list[str], trees: int, depth: int, seed: int) -> dict[int, Trees]:
    """The boosted trees of every fold of ``rows``: columns fold, w, y, ``keys`` and ``features``. totals: fold to (rows, weight)."""
    if not totals:
        return {}
    at = candidates(rows, features, totals, keys, seed)
    held = binned(rows, features, at).persist(StorageLevel.MEMORY_AND_DISK)
    models, stored, old = {k: Trees(depth) for k in totals}, 0, None
    for grown in range(trees):
        for m in models.values():
            m.add()
        nodes: dict[int, dict] = {k: {1: None} for k in models}  # to the sums of their rows, once known
        for level in range(depth):
            nodes = {k: v for k, v in nodes.items() if v}
            if not nodes:
                break
            sums = histograms(held, models, {k: list(v) for k, v in nodes.items()}, len(features), stored, grown)
            if old is not None:
                old.unpersist()
                old = None
            for k, asked in nodes.items():
                m, below = models[k], {}
                for h, (node, whole) in zip(sums[k], asked.items()):
                    split = best_split(h, [len(t) for t in at[k]], whole)
                    if whole is None:
                        s = h[0].sum(axis=0)
                        m.value[-1][node] = s[1] / s[0] if s[0] else 0.0
                    if split is None or split[0] <= 0:
                        continue
                    _, j, last, *sides = split
                    m.feature[-1][node], m.last[-1][node], m.threshold[-1][node] = j, last, at[k][j][last]
                    for child, s in zip((2 * node, 2 * node + 1), sides):
                        m.value[-1][child] = s[1] / s[0] if s[0] else 0.0
                        if level + 1 < depth and abs(impurity(s)) >= EPSILON:
                            below[child] = s
                nodes[k] = below
        if (grown + 1) % STORE_EVERY == 0 and grown + 1 < trees:
            old, held = held, with_fits(held, models, len(features), stored, grown + 1).persist(StorageLevel.MEMORY_AND_DISK)
            stored = grown + 1
    held.unpersist()
    return models


def with_fits(blocks: RDD, models: dict[int, Trees], k: int, stored: int, grown: int) -> RDD:
    """The blocks with the fits of ``grown`` trees, of which they have ``stored``."""
    sent = {fold: m.since(stored) for fold, m in models.items()}

    def advanced(b):
        fold, x, w, y, fits = b
        return fold, x, w, y, sent[fold].fitted(np.frombuffer(x, np.uint8).reshape(-1, k), stored, grown, True, np.frombuffer(fits)).tobytes()

    return blocks.map(advanced)


def predicted(rows: DataFrame, features: list[str], models: dict[int, Trees], keep: list[str]) -> DataFrame:
    """Columns ``keep`` (with fold) of the rows and ``prediction`` of their fold's trees."""
    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.select(*keep).dtypes)

    def ask(batches):
        for batch in batches:
            fold, x = batch.column("fold").to_numpy(), np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in features], axis=1)
            out = np.empty(len(x))
            for k in np.unique(fold).tolist():
                own = fold == k
                out[own] = models[k].fitted(x[own])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out)], names=[*keep, "prediction"])

    return rows.select(*keep, *features).mapInArrow(ask, f"{schema}, prediction double")
