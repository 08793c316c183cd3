"""Substring deduplication by content-defined chunking with a gear rolling hash.

A chunk ends where the gear hash of the last ``WINDOW`` bytes falls below a threshold (one place in ``AVERAGE``), at
least ``LEAST`` and at most ``MOST`` bytes after the last end. Cuts depend on nearby bytes only, so an insertion moves no cuts but those next to it.
The fewest neighbouring chunks with ``MIN_WORDS`` words from each chunk on, and those up to each chunk, are a span. Spans whose bytes stand in more than one
document are shared, so all chunks of one have a common other document; the first document (smallest doc_id) keeps them. A run
of chunks in shared spans is a repeated passage; redundant are those of its chunks that lie in a span first seen elsewhere.

Texts are chunked twice and never moved. The first pass sends one digest per span to an aggregation; the second sends only
spans that a filter of fixed size takes for shared, to a join that confirms them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricefold.llm.common import _BASE, _INVERSE, _powers, mixed, steps, stored, word_spans

#: With such chunks a passage of 50 words (some 300 bytes) loses about 60 bytes at its ends.
AVERAGE, LEAST, WINDOW = 20, 8, 16
#: Cuts a text that repeats a word over and over, where the hash may never fall below the threshold; a prime, so that
#: such cuts come at every place of the repeated part.
MOST = 97
MIN_WORDS = 25
#: 8 MB, whatever the corpus.
FILTER_BITS = 1 << 26

_GEAR = (mixed(np.arange(256, dtype=np.uint64) + np.uint64(0x6765617200)) >> np.uint64(32)).astype(np.uint32)
_CUT = np.uint32((1 << 32) // AVERAGE)


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - k]] << 2 k over the last 16 bytes, modulo 2 ** 32, by doubling the window."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8):
        longer = h.copy()
        longer[width:] += h[:-width] << np.uint32(2 * width)
        h = longer
    return h


def cut(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, first): ends of the chunks of all texts; text d has chunks first[d]..first[d + 1], an empty text none."""
    places = np.flatnonzero(gear(data) < _CUT) + 1
    bounds = np.searchsorted(places, offs)
    ends, count = [], np.zeros(len(offs), np.int64)
    for d in range(len(offs) - 1):
        lo, hi = int(offs[d]), int(offs[d + 1])
        if hi == lo:
            continue
        # The window of the first places reaches into the text before.
        last, n = lo, len(ends)
        for p in [*places[bounds[d] : bounds[d + 1]].tolist(), hi]:
            while p - last > MOST:
                last += MOST
                ends.append(last)
            if p - last >= LEAST and p < hi and p - lo >= WINDOW:
                ends.append(p)
                last = p
        ends.append(hi)
        count[d + 1] = len(ends) - n
    return np.array(ends, np.int64), np.cumsum(count)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digest of the bytes of each chunk or span (in order of both their starts and ends)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lo, hi = int(starts[0]), int(ends[-1])
    run = np.zeros(hi - lo + 1, np.uint64)
    np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, hi - lo), out=run[1:])
    s, e = starts - lo, ends - lo
    return mixed((run[e] - run[s]) * _powers(_INVERSE, hi - lo)[s] + (e - s).astype(np.uint64))


def _spans(data: np.ndarray, offs: np.ndarray, min_words: int):
    """(starts, ends, first, words, spans): chunks of all texts, starts of words, and the spans as (first chunk, last chunk, text, digest).

    A span has ``min_words`` words, one of which may begin before it.
    """
    ends, first = cut(data, offs)
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    words, word_ends, _ = word_spans(data, offs)
    # Whether the first byte starts a word depends on the byte before, so it counts as one wherever it is part of a word.
    k = np.searchsorted(words, starts, side="right") + min_words - 1
    inside = np.searchsorted(words, starts, side="right") - 1
    if len(words):
        k -= (inside >= 0) & (word_ends[inside] > starts)
    at = np.flatnonzero(k < np.searchsorted(words, offs[1:])[text])
    last = np.searchsorted(ends, words[k[at]], side="right")
    # Up to each chunk: from the last one on that has the words by then.
    begin = np.searchsorted(k, np.searchsorted(words, ends)) - 1
    to = np.flatnonzero(begin >= 0)
    to = to[text[begin[to]] == text[to]]
    pairs = np.unique(np.concatenate((at * len(ends) + last, begin[to] * len(ends) + to)))
    at, last = pairs // max(len(ends), 1), pairs % max(len(ends), 1)
    return starts, ends, first, words, (at, last, text[at], digests(data, starts[at], ends[last]))


def _digest_rows(min_words: int):
    def rows_of(batches):
        for rows, data, offs in steps(batches):
            _, _, _, _, (_, _, text, digest) = _spans(data, offs, min_words)
            yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), rows.column("doc_id").take(pa.array(text))], names=["digest", "doc_id"])

    return rows_of


def _bit(digest: np.ndarray) -> np.ndarray:
    return (digest >> np.uint64(64 - 26)).astype(np.int64)


def shared_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(digest, first_doc): digests that occur in at least two documents, and the smallest doc_id with each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    found = rows.mapInArrow(_digest_rows(min_words), "digest long, doc_id long")
    return found.groupBy("digest").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").drop("last_doc")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The repeated passages of ``docs`` (doc_id, text), one row per part that is alike redundant or not; documents without one have no row.

    Columns: doc_id, start, end (code points, end exclusive), n_words, n_chunks (long), first_doc (smallest doc_id with any of
    its spans), redundant (boolean: every chunk lies in a span first seen in another document, so this part can go).
    Parts have ``min_words`` words; shorter ones are the rest beside a redundant one, which stays, and have no row. Null and empty texts have none;
    rows without a doc_id are compared with the others and have a null id; repeated rows of one doc_id are one document, but
    each has its rows of the result; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = stored(shared_spans(docs, min_words), "shared")
    # Bit of a digest: its highest 26 bits.
    bit = F.shiftrightunsigned("digest", 64 - 26)
    packed = shared.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(digest, 38) & 63 as int))")).alias("m")).toArrow()  # FILTER_BITS / 64 rows at most
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[packed["w"].to_numpy()] = packed["m"].to_numpy()
    sent = spark.sparkContext.broadcast(table.tobytes())

    def candidates(batches):
        bits = np.frombuffer(sent.value, np.int64)
        for rows, data, offs in steps(batches):
            starts, ends, first, words, (begin, last, text, digest) = _spans(data, offs, min_words)
            b = _bit(digest)
            hit = np.flatnonzero((bits[b >> 6] >> (b & 63)) & 1)
            if not len(hit):
                continue
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            text, begin, last = text[hit], begin[hit], last[hit]
            at, word = points[offs[text]], np.searchsorted(words, offs[text])
            columns = [begin - first[text], last - first[text], points[starts[begin]] - at, points[ends[last]] - at, np.searchsorted(words, starts[begin]) - word, np.searchsorted(words, ends[last]) - word]
            yield pa.RecordBatch.from_arrays(
                [rows.column("row").take(pa.array(text)), rows.column("doc_id").take(pa.array(text)), pa.array(digest[hit].view(np.int64)), *(pa.array(c.astype(np.int32)) for c in columns)],
                names=["row", "doc_id", "digest", "pos", "last", "start", "end", "before", "after"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = rows.mapInArrow(candidates, "row long, doc_id long, digest long, pos int, last int, start int, end int, before int, after int").join(shared, "digest")
    spans = spans.withColumn("redundant", ~F.col("first_doc").eqNullSafe(F.col("doc_id")))
    upto = Window.partitionBy("row").orderBy("pos", "last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("row").orderBy("pos", "last").rowsBetween(Window.unboundedPreceding, -1)
    apart = lambda last: F.coalesce(F.col("pos") > F.max(last).over(earlier) + 1, F.lit(True))
    # Runs of chunks in any span, and runs in redundant ones, which lie within them.
    found = spans.withColumn("new_run", apart(F.col("last"))).withColumn("new_cut", F.col("redundant") & apart(F.when(F.col("redundant"), F.col("last"))))
    found = found.withColumn("run", F.sum(F.col("new_run").cast("int")).over(upto)).withColumn("cut", F.when(F.col("redundant"), F.sum(F.col("new_cut").cast("int")).over(upto)))
    bounds = [F.first("doc_id").alias("doc_id"), *(F.min(c).alias(c) for c in ("pos", "start", "before", "first_doc")), *(F.max(c).alias(c) for c in ("last", "end", "after"))]
    cuts = found.groupBy("row", "run", "cut").agg(*bounds)
    cut_of = F.when(F.col("cut").isNotNull(), F.struct("pos", "last", "start", "end", "before", "after", "first_doc"))
    runs = cuts.groupBy("row", "run").agg(*bounds, F.sort_array(F.collect_list(cut_of)).alias("cuts"))
    named = "named_struct('start', {}, 'end', {}, 'n_words', cast({} as bigint), 'n_chunks', cast({} as bigint), 'first_doc', {}, 'redundant', {})"
    cut_part = named.format("c.start", "c.end", "c.after - c.before", "c.last - c.pos + 1", "c.first_doc", "true")
    lo = lambda own, cut: f"if(k = 0, {own}, cuts[k - 1].{cut})"
    hi = lambda own, cut: f"if(k = size(cuts), {own}, cuts[k].{cut})"
    kept = named.format(lo("start", "end"), hi("end", "start"), f"{hi('after', 'before')} - {lo('before', 'after')}", f"{hi('last + 1', 'pos')} - {lo('pos - 1', 'last')} - 1", "doc_id", "false")
    parts = runs.select("doc_id", F.expr(f"inline(concat(transform(cuts, c -> {cut_part}), transform(sequence(0, size(cuts)), k -> {kept})))"))
    return parts.where((F.col("n_words") >= min_words) & (F.col("n_chunks") > 0)).select("doc_id", "start", "end", "n_words", "n_chunks", "first_doc", "redundant")


def without_redundant(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the redundant ``passages`` cut out of ``text``; a document keeps its row even if nothing is left."""
    spans = passages.where("redundant AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_cut_id")).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_cut"))
    joined = docs.join(spans, docs["doc_id"].cast("long") == spans["_cut_id"], "left")
    left = (
        "array_join(transform(sequence(0, size(_cut)), k -> substring(text, if(k = 0, 0, _cut[k - 1].end) + 1,"
        " if(k < size(_cut), _cut[k].start, length(text)) - if(k = 0, 0, _cut[k - 1].end))), '')"
    )
    return joined.withColumn("text", F.expr(f"if(_cut IS NULL, text, {left})")).select(*docs.columns)
