"""Exact top-k inner-product search by MaxScore over dealt shards.

Vectors are dealt into shards of ``SHARD_ROWS`` rows and the query set into blocks of ``QUERY_ROWS``; every
(shard, query block) is one task row. A shard is a term-major index: the postings of term t are the components t of
its vectors, with their least and greatest impact. For a query, term t can add at most U_t = max(q_t * least, q_t * greatest).
With theta, the score of the k-th best found so far, the terms of smallest U whose sum stays below theta are
non-essential: a vector needs more than they can give. Essential postings are traversed for a block of
vectors at a time; the others are probed, greatest bound first, only for vectors that can still reach theta.
theta rises from block to block, so fewer terms stay essential. The best of all shards are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
#: Vectors of a shard whose essential postings are traversed at once.
TRAVERSED = 2_048


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, terms): floor(scale * x) as longs. Rows with a null id, a null vector, or null or non-finite components are left out."""
    x = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    rows = rows.where("NOT exists(x, v -> v IS NULL OR isnan(v) OR abs(v) = double('Infinity'))")
    return rows.select("vec_id", F.expr(f"transform(x, v -> floor({scale} * v))").alias("terms"))


def _packed(rows: DataFrame, block: str, n: int) -> DataFrame:
    """(block, ids, terms): the rows dealt evenly into n blocks, each one row of binary arrays (shorter vectors end in zeros)."""

    def pack(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        ids = t.column("vec_id").to_numpy()
        own = [np.asarray(v, np.int64) for v in t.column("terms").to_pylist()]
        dense = np.zeros((len(own), max(map(len, own))), np.int64)
        for i, v in enumerate(own):
            dense[i, : len(v)] = v
        small = np.abs(dense).max(initial=0) < 1 << 15
        yield pa.RecordBatch.from_arrays(
            [t.column("block").chunk(0)[:1], pa.array([ids.tobytes()]), pa.array([dense.astype(np.int16 if small else np.int64).tobytes()]), pa.array([2 if small else 8], pa.int32())],
            names=["block", "ids", "terms", "width"],
        )

    dealt = rows.repartition(n).withColumn("block", F.spark_partition_id())
    return dealt.mapInArrow(pack, "block int, ids binary, terms binary, width int").withColumnRenamed("block", block)


def _matrix(ids: pa.Scalar, terms: pa.Scalar, width: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids.as_buffer(), np.int64)
    raw = np.frombuffer(terms.as_buffer(), np.int16 if width.as_py() == 2 else np.int64)
    return ids, raw.reshape(len(ids), -1).astype(np.int64)


def maxscore(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the k best rows but those with the query's own id: greatest score first, ties by smaller id.

    vectors: (terms, rows), of a type in which all sums are exact.
    """
    least, greatest = vectors.min(axis=1), vectors.max(axis=1)
    bound = np.maximum(query * least, query * greatest)
    order = np.argsort(-bound, kind="stable")
    query, postings = query[order], vectors[order]
    # rest[i]: the most that terms i, i + 1, ... can add
    rest = np.concatenate((np.cumsum(bound[order][::-1])[::-1], [0]))
    best_ids, best = ids[:0], vectors[0, :0]
    for at in range(0, len(ids), TRAVERSED):
        rows = slice(at, at + TRAVERSED)
        own = ids[rows]
        alive = np.flatnonzero(own != query_id)
        if len(best) < k:
            scores = query @ postings[:, rows]
        else:
            theta = best[-1]
            # After the first i terms a vector's partial score can grow by rest[i]: the terms from the first i with
            # rest[i] < theta on are non-essential.
            essential = int(np.argmax(rest < theta)) if (rest < theta).any() else len(query)
            scores = query[:essential] @ postings[:essential, rows]
            alive = alive[scores[alive] + rest[essential] >= theta]
            for t in range(essential, len(query)):
                if not len(alive):
                    break
                scores[alive] += query[t] * postings[t, rows][alive]
                alive = alive[scores[alive] + rest[t + 1] >= theta]
        if len(alive):
            all_ids, all_scores = np.concatenate((best_ids, own[alive])), np.concatenate((best, scores[alive]))
            top = np.lexsort((all_ids, -all_scores))[:k]
            best_ids, best = all_ids[top], all_scores[top]
    return best_ids, best


def _search(k: int):
    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                col = lambda c: batch.column(c)[i]  # noqa: B023, E731
                ids, v = _matrix(col("ids"), col("terms"), col("width"))
                qids, q = _matrix(col("q_ids"), col("q_terms"), col("q_width"))
                d = min(v.shape[1], q.shape[1])
                v, q = v[:, :d], q[:, :d]
                if not d:
                    v, q = np.zeros((len(ids), 1), np.int64), np.zeros((len(qids), 1), np.int64)
                # Doubles are exact below 2 ** 53; beyond, whole numbers of any size.
                exact = float(np.abs(v).max()) * float(np.abs(q).max()) * max(d, 1) < 2**52
                kind = np.float64 if exact else object
                v, q = np.ascontiguousarray(v.T.astype(kind)), q.astype(kind)
                out = [[], [], [], []]
                for n, (qid, terms) in enumerate(zip(qids, q)):
                    found, scores = maxscore(ids, v, int(qid), terms, k)
                    out[0].append(np.full(len(found), n))
                    out[1].append(np.full(len(found), qid))
                    out[2].append(found)
                    out[3].append(np.array([int(s) for s in scores], np.int64))
                a, b, c, s = (np.concatenate(x).astype(np.int64) for x in out)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), col("query_block").as_py(), np.int32)), pa.array(a), pa.array(b), pa.array(c), pa.array(s)], names=["query_block", "query_row", "query_id", "vec_id", "score"])

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (long) of each query's ``k`` highest integer inner products.

    vectors, queries: (vec_id, terms array<long>) as :func:`quantised` makes them. A query meets every row but those with its
    own id; fewer than k rows give fewer results; ties go to the smaller vec_id. Vectors of different lengths are
    compared as if the shorter ended in zeros. Repeated rows are candidates, and queries, each for itself. Scores
    must fit into a long. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    n, m = vectors.count(), queries.count()
    if not n or not m:
        return spark.createDataFrame([], schema)
    shards, blocks = -(-n // SHARD_ROWS), -(-m // QUERY_ROWS)
    v = _packed(vectors, "shard", shards).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = _packed(queries, "query_block", blocks).select("query_block", F.col("ids").alias("q_ids"), F.col("terms").alias("q_terms"), F.col("width").alias("q_width"))
    q = q.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    cells = v.repartition(shards * blocks, "shard", "query_block").join(q.repartition(shards * blocks, "shard", "query_block"), ["shard", "query_block"])
    found = cells.mapInArrow(_search(k), "query_block int, query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_block", "query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
