"""Shared helpers: held-out split, shared scratch tables, vectorised words and shingles of Arrow text columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one vectorised step holds at once; a single longer text is one step.
STEP_BYTES = 4 << 20
#: Bytes that word_hashes takes at once: each needs some 40 bytes of memory.
HASH_BYTES = 256 << 10


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def crc_bucket(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


# ---------------------------------------------------------------- shared tables


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by the driver and the executors: ``spark.checkpoint.dir``.

    Unset is accepted on a local master only (tests), where a scratch folder is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="pricefold-llm-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/pricefold-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Jobs that run inside exchange Arrow batches of at most ``most`` rows; the session's own setting holds again afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    if not 0 < int(before or 0) <= most:
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


# ---------------------------------------------------------------- Arrow text


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    if data is None or not len(offs) or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def steps(batches, column: str = "text", most: int = STEP_BYTES, rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``most`` bytes of text and at most ``rows`` rows each: (rows, bytes, offsets)."""
    for batch in batches:
        data, offs = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = min(max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1), at + rows)
            yield batch.slice(at, end - at), data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
            at = end


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words; text d has words first[d]..first[d + 1]."""
    solid = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, from differences of a running polynomial; about HASH_BYTES at a time."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        end = max(at + 1, int(np.searchsorted(ends, lo + HASH_BYTES, side="right")))
        hi = int(ends[end - 1])
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, hi - lo), out=run[1:])
        s, e = starts[at:end] - lo, ends[at:end] - lo
        out[at:end] = mixed((run[e] - run[s]) * _powers(_INVERSE, hi - lo)[s] + (e - s).astype(np.uint64))
        at = end
    return out


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): every ``size``-word shingle of each text in order; a shorter text is one shingle, a text without words none."""
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    to = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(to[-1], np.uint64)
    if len(words) >= size:
        run = np.zeros(len(words) - size + 1, np.uint64)
        for j in range(size):
            run = run * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - size + 1 + j]
        run = mixed(run)
        for d in np.flatnonzero(count >= size):
            out[to[d] : to[d + 1]] = run[first[d] : first[d] + n[d]]
    for d in np.flatnonzero((count > 0) & (count < size)):
        h = np.array([count[d]], np.uint64)
        for w in words[first[d] : first[d + 1]]:
            h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + w)
        out[to[d]] = h[0]
    return out, to


def distinct_runs(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each run values[first[d]:first[d + 1]], with the new bounds."""
    parts = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:])]
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
    return (np.concatenate(parts) if parts else values[:0]), bounds.astype(np.int64)


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): sorted distinct shingles of each text, A-Z lower-cased."""
    starts, ends, first = word_spans(data, offs)
    return distinct_runs(*shingle_hashes(word_hashes(lowered(data), starts, ends), first, size))


def words_of(text: str | None) -> list[str]:
    """Words of one text as the vectorised path sees them (used by tests and small helpers)."""
    low = (text or "").translate(str.maketrans(UPPER, LOWER))
    return re.findall(WORD, low)
