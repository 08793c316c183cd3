"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Containment of a short item in a long text has a tiny Jaccard similarity, so neither whole texts are
compared with items nor items with items. Items are partitioned by size: class S holds items of S/2 + 1 to S
shingles. For each class a text is seen through windows of 2 S shingles, one every S, so a passage of up to S
shingles lies within one window, and the similarity of item and window is bounded below by the class alone.
Window signatures of all classes come from one pass: minima of small blocks are merged to larger ones.
An item and a text become candidates when one of ``HASHES`` minima agrees; candidates are verified exactly:
|item and text shingles in common| >= 0.75 * |item shingles|, over the whole text.

Items of up to ``TINY`` shingles are a class whose signature is the whole set.
The items are taken in blocks of at most ``BLOCK_SHINGLES`` (a stated query set), each of which is sent to the
executors and meets all texts in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricefold.llm.common import mixed, shingle_hashes, shingle_sets, steps, word_hashes, word_spans, lowered

SHINGLE = 5
THRESHOLD_PCT = 75
#: At the threshold a window shares at least 17.6 % of its shingles with the item: (1 - 0.176) ** 64 < 1e-5.
HASHES = 64
TINY = 8
#: 16 MB of item shingles and as much of signatures at most.
BLOCK_SHINGLES = 1 << 21

_ids = np.arange(1, HASHES + 1, dtype=np.uint64)
_A = (mixed(_ids + np.uint64(1 << 33)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mixed(_ids + np.uint64(1 << 34)) >> np.uint64(32)).astype(np.uint32)


def _minima(h: np.ndarray, j: int) -> np.ndarray:
    return h * _A[j] + _B[j]


def _item_sets(batches):
    for rows, data, offs in steps(batches):
        hashes, first = shingle_sets(data, offs, SHINGLE)
        raw = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([rows.column("item_id"), pa.array(raw, pa.binary())], names=["item_id", "set"])


class ItemIndex:
    """One block of items: sets, and for each size class and hash the sorted minima."""

    def __init__(self, ids: list, sets: list[np.ndarray]):
        self.ids, self.sets = ids, sets
        n = np.array([len(s) for s in sets])
        size = np.maximum(2 * TINY, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
        self.classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for c in np.unique(size[n > TINY]):
            members = np.flatnonzero((size == c) & (n > TINY))
            sig = np.stack([[_minima((sets[i] >> np.uint64(32)).astype(np.uint32), j).min() for i in members] for j in range(HASHES)])
            order = np.argsort(sig, axis=1, kind="stable")
            self.classes[int(c)] = (members, np.take_along_axis(sig, order, 1), order)
        tiny = np.flatnonzero((n > 0) & (n <= TINY))
        keys = np.concatenate([sets[i] for i in tiny]) if len(tiny) else np.empty(0, np.uint64)
        owner = np.repeat(tiny, n[tiny]) if len(tiny) else tiny
        order = np.argsort(keys, kind="stable")
        self.tiny_keys, self.tiny_owner = keys[order], owner[order]

    def _pairs(self, found: set, keys: np.ndarray, owners: np.ndarray, values: np.ndarray, docs: np.ndarray, bits: int) -> None:
        """Add (text, item) wherever a value occurs among the sorted keys; a bit table of the low bits goes first."""
        table = np.zeros(1 << bits, bool)
        mask = values.dtype.type((1 << bits) - 1)
        table[keys & mask] = True
        hit = np.flatnonzero(table[values & mask])
        lo, hi = np.searchsorted(keys, values[hit], "left"), np.searchsorted(keys, values[hit], "right")
        for k in np.flatnonzero(hi > lo):
            d = int(docs[hit[k]])
            found.update((d, int(owners[x])) for x in range(lo[k], hi[k]))

    def candidates(self, shingles: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) candidates of texts with shingles[first[d]:first[d + 1]], in text order."""
        found: set[tuple[int, int]] = set()
        n = np.diff(first)
        if not len(shingles):
            return found
        if len(self.tiny_keys):
            self._pairs(found, self.tiny_keys, self.tiny_owner, shingles, np.repeat(np.arange(len(n)), n), 20)
        if not self.classes:
            return found
        h = (shingles >> np.uint64(32)).astype(np.uint32)
        # Bounds of the blocks of each stride: starts in the level below, and the text of each block.
        levels = []
        stride, count, base = min(self.classes), n, first[:-1]
        while True:
            blocks = -(-count // (stride if not levels else 2))
            doc = np.repeat(np.arange(len(n)), blocks)
            at = np.concatenate(([0], np.cumsum(blocks)))
            inner = np.arange(at[-1]) - at[doc]
            levels.append((stride, base[doc] + inner * (stride if not levels else 2), doc))
            if stride >= max(self.classes):
                break
            stride, count, base = stride * 2, blocks, at[:-1]
        for j in range(HASHES):
            low = _minima(h, j)
            for size, starts, doc in levels:
                low = np.minimum.reduceat(low, starts)
                if size in self.classes:
                    window = low.copy()
                    same = doc[1:] == doc[:-1]
                    window[:-1][same] = np.minimum(low[:-1][same], low[1:][same])
                    members, keys, order = self.classes[size]
                    self._pairs(found, keys[j], members[order[j]], window, doc, 16)
        return found

    def matches(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, shingles in common) of the verified pairs."""
        starts, ends, first = word_spans(data, offs)
        shingles, first = shingle_hashes(word_hashes(lowered(data), starts, ends), first, SHINGLE)
        last, own = -1, shingles[:0]
        for d, i in sorted(self.candidates(shingles, first)):
            if d != last:
                last, own = d, np.unique(shingles[first[d] : first[d + 1]])
            item = self.sets[i]
            at = np.searchsorted(own, item)
            common = int(np.count_nonzero(own[np.minimum(at, len(own) - 1)] == item))
            if 100 * common >= THRESHOLD_PCT * len(item):
                yield d, i, common


def item_blocks(benchmark: DataFrame, most: int = BLOCK_SHINGLES) -> Iterator[ItemIndex]:
    """Indexes of all items with at least one word, in blocks of bounded size."""
    sets = benchmark.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _item_sets, T.StructType([T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("set", T.BinaryType())])
    )
    ids, own, total = [], [], 0
    for row in sets.where("length(set) > 0").toLocalIterator():
        s = np.frombuffer(row["set"], np.uint64)
        if ids and total + len(s) > most:
            yield ItemIndex(ids, own)
            ids, own, total = [], [], 0
        ids.append(row["item_id"])
        own.append(s)
        total += len(s)
    if ids:
        yield ItemIndex(ids, own)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per pair of a text of ``docs`` (doc_id, text) and an item of ``benchmark`` (item_id, text) it contains.

    Columns: doc_id, item_id, n_item_shingles, n_common (long), containment (double, at least 0.75). Sets are
    distinct 5-word shingles, A-Z lower-cased; a text or item of one to four words is one shingle, so short items
    match only texts that are the same few words. Null and empty texts and items match nothing; null ids are
    kept as they are; repeated rows give repeated results; other columns are ignored.
    """
    spark = docs.sparkSession
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType)]
    schema = T.StructType([*fields, T.StructField("n_item_shingles", T.LongType()), T.StructField("n_common", T.LongType()), T.StructField("containment", T.DoubleType())])
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for index in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(index))

        def search(batches, sent=sent):
            index = cloudpickle.loads(sent.value)
            for rows, data, offs in steps(batches):
                found = list(index.matches(data, offs))
                if found:
                    n = [len(index.sets[i]) for _, i, _ in found]
                    doc = rows.column("doc_id").take(pa.array([d for d, _, _ in found], pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [doc, pa.array([index.ids[i] for _, i, _ in found]), pa.array(n, pa.int64()), pa.array([c for _, _, c in found], pa.int64()), pa.array([c / k for (_, _, c), k in zip(found, n)])],
                        names=[f.name for f in schema],
                    )

        out = out.unionByName(texts.mapInArrow(search, schema))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item of ``benchmark`` (as :func:`contaminated` finds them), columns unchanged.

    A filter within each task, without a shuffle; rows are decided one by one, whatever their doc_id.
    """
    spark, names = docs.sparkSession, docs.columns
    out = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{names.index('text')}"
    for index in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(index))

        def clean(batches, sent=sent):
            index = cloudpickle.loads(sent.value)
            for rows, data, offs in steps(batches, text):
                keep = np.ones(rows.num_rows, bool)
                keep[[d for d, _, _ in index.matches(data, offs)]] = False
                yield rows.filter(pa.array(keep))

        out = out.mapInArrow(clean, out.schema)
    return out.toDF(*names)
