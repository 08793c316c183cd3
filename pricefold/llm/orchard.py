"""Centroid clustering of integer vectors; the nearest centroid is found by Orchard search.

Each centroid has the list of all others, nearest first. A search starts at some centroid and walks down its list: a
centroid that is nearer to the vector (or as near and of smaller number) is jumped to at once and its list walked
from the start, centroids seen before being skipped. By the triangle inequality nothing beyond twice the current
distance can be nearer, so the walk stops at the first entry strictly beyond it; entries at just that distance can tie and are looked at.

Rounds are Spark jobs over the stored vectors: tasks search whole batches side by side and return sums for each centroid,
which Spark adds up; only the centroids pass through the driver. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.llm.common import stored

#: Greatest size of a component: squared distances of vectors of 64 components then fit into a long.
MOST = 2**27
#: Vectors searched side by side.
STEP_ROWS = 8_192


def whole_vectors(vectors: DataFrame, dims: int = 64, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, terms): floor(scale * x) of vectors with exactly ``dims`` components, none null or non-finite; others are left out.

    Null and repeated ids stay. Components beyond 2 ** 27 after scaling are an error: their distances would not fit into a long.
    """
    x = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), x.alias("x")).where(f"x IS NOT NULL AND size(x) = {dims}")
    rows = rows.where("NOT exists(x, v -> v IS NULL OR isnan(v) OR abs(v) = double('Infinity'))")
    whole = f"CASE WHEN abs({scale} * v) <= {MOST} THEN floor({scale} * v) ELSE raise_error('a component is beyond the range of exact distances') END"
    return rows.select("vec_id", F.expr(f"transform(x, v -> CAST({whole} AS INT))").alias("terms"))


def _packed(rows: DataFrame) -> DataFrame:
    """(vec_id, terms): the components as 32-bit numbers in a binary cell."""

    def pack(batches):
        for batch in batches:
            terms = batch.column("terms")
            flat = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            offs = np.concatenate(([0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64) * 4
            cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offs), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), cells.cast(pa.binary())], names=["vec_id", "terms"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(pack, f"vec_id {kind}, terms binary")


def _matrix(cells: pa.Array, dims: int) -> np.ndarray:
    cells = cells.cast(pa.large_binary())
    if not len(cells):
        return np.zeros((0, dims), np.int64)
    offs = np.frombuffer(cells.buffers()[1], np.int64)[cells.offset : cells.offset + len(cells) + 1]
    data = np.frombuffer(cells.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    return np.frombuffer(data.tobytes(), np.int32).astype(np.int64).reshape(len(cells), dims)


class Orchard:
    """Sorted neighbour lists of the centroids and the search over them."""

    def __init__(self, centroids: np.ndarray):
        self.centroids, k = centroids, len(centroids)
        apart = np.stack([((centroids - c) ** 2).sum(axis=1) for c in centroids])
        numbers = np.arange(k)
        order = np.stack([np.lexsort((numbers, apart[c], numbers != c)) for c in range(k)])
        self.near, self.apart = order[:, 1:], np.take_along_axis(apart, order, axis=1)[:, 1:]

    def distance(self, vectors: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((vectors - self.centroids[c]) ** 2).sum(axis=1)

    def search(self, vectors: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest centroid, squared distance, distances computed); ties go to the smaller number. ``start``: where each search begins."""
        n, k = len(vectors), len(self.centroids)
        now = np.zeros(n, np.int64) if start is None else start.astype(np.int64).copy()
        best = self.distance(vectors, now)
        looked = n
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), now] = True
        at, live = np.zeros(n, np.int64), np.arange(n)
        while True:
            live = live[at[live] < k - 1]
            c, place = now[live], at[live]
            # Squares: beyond twice the distance is beyond four times its square.
            go = self.apart[c, place] <= 4 * best[live]
            live, c, place = live[go], c[go], place[go]
            if not len(live):
                return now, best, looked
            other = self.near[c, place]
            at[live] += 1
            fresh = ~seen[live, other]
            rows, other, c = live[fresh], other[fresh], c[fresh]
            seen[rows, other] = True
            d = self.distance(vectors[rows], other)
            looked += len(rows)
            nearer = (d < best[rows]) | ((d == best[rows]) & (other < c))
            rows = rows[nearer]
            now[rows], best[rows], at[rows] = other[nearer], d[nearer], 0


def _searched(batches, orchard: Orchard, dims: int):
    """(batch slice, vectors, nearest, distance). A search begins where the one of the vector before it would most often end: at the step's commonest centroid."""
    common = 0
    for batch in batches:
        for at in range(0, batch.num_rows, STEP_ROWS):
            rows = batch.slice(at, STEP_ROWS)
            v = _matrix(rows.column("terms"), dims)
            c, d, _ = orchard.search(v, np.full(len(v), common))
            common = int(np.bincount(c).argmax()) if len(c) else common
            yield rows, v, c, d


def _round(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of the means of their vectors; one without vectors stays."""
    k, dims = centroids.shape

    def sums(batches):
        orchard = Orchard(centroids)
        total, count = np.zeros((k, dims), object), np.zeros(k, np.int64)
        for _, v, c, _ in _searched(batches, orchard, dims):
            part = np.zeros((k, dims), np.int64)
            np.add.at(part, c, v)
            total += part
            count += np.bincount(c, minlength=k)
        for c in np.flatnonzero(count):
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([count[c]]), pa.array([[str(x) for x in total[c]]])], names=["cluster", "n", "sums"])

    parts = packed.mapInArrow(sums, "cluster int, n long, sums array<string>")
    flat = parts.select("cluster", "n", F.posexplode("sums").alias("j", "s"))
    rows = flat.groupBy("cluster", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # k * dims numbers
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["j"]] = int(r["s"]) // r["n"]
    return out


def first_centroids(rows: DataFrame, k: int, seed: str = "3") -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``; equal ids by their components, null ids last; all vectors, if fewer."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    picked = rows.withColumn("_key", key).orderBy(F.asc_nulls_last("_key"), "terms").limit(k).collect()  # k rows
    return np.array([r["terms"] for r in picked], np.int64) if picked else np.zeros((0, 0), np.int64)


def clustered(rows: DataFrame, k: int = 8, rounds: int = 10, seed: str = "3") -> DataFrame:
    """vec_id, cluster (int), distance, cluster_inertia, inertia (long), centroid_sha256 of every row of (vec_id, terms array<int>).

    ``rounds`` times every vector goes to its nearest centroid (squared Euclidean distance, ties to the smaller number) and every centroid
    that has vectors becomes the floor of their mean; then vectors are assigned once more. distance is squared; cluster_inertia and inertia are its sums
    over the cluster and over all. centroid_sha256 is the hash of the centroid's components, in decimal, joined by commas.
    All vectors have the same number of components, as :func:`whole_vectors` makes them. Repeated rows count each for itself; with fewer than
    k vectors there are as many centroids as vectors; no vectors give an empty result.
    """
    spark = rows.sparkSession
    kind = rows.schema["vec_id"].dataType.simpleString()
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    packed = stored(_packed(rows), "vectors")
    for _ in range(rounds):
        new = _round(packed, centroids)
        if (new == centroids).all():  # the other rounds would change nothing
            break
        centroids = new
    dims = centroids.shape[1]

    def assign(batches):
        orchard = Orchard(centroids)
        for rows, _, c, d in _searched(batches, orchard, dims):
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(c, pa.int32()), pa.array(d)], names=["vec_id", "cluster", "distance"])

    found = stored(packed.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "clusters")
    own = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # k rows
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = F.element_at(F.array(*[F.lit(own.get(c, 0)).cast("long") for c in range(len(centroids))]), F.col("cluster") + 1)
    digest = F.element_at(F.array(*[F.lit(d) for d in digests]), F.col("cluster") + 1)
    return found.select("vec_id", "cluster", "distance", inertia.alias("cluster_inertia"), F.lit(sum(own.values())).cast("long").alias("inertia"), digest.alias("centroid_sha256"))
