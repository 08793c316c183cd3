"""Language-model scoring by prediction by partial matching (PPM) over a byte-context trie.

Text. A document is its words (A-Z lower-cased) with one space between them and an end symbol.

Training. Every training text gives its sequences of ``ORDER`` context bytes and the byte (or end) that follows; their
counts are summed over the whole corpus. Shorter contexts are sums of longer ones, so one count table is the whole
trie. No context is dropped: the tables of all orders stay on Spark and grow with the corpus.

Prediction (escape method D with full exclusion). In a context with T occurrences of d distinct symbols, a symbol seen c
times has (c - 0.5) / T; else the model escapes with 0.5 d / T to the next shorter context, where the symbols of the
longer one are excluded from T and d. Below order 0 the symbols that are left are equally likely. As the symbols of a context
are among those of its suffix, what is excluded is a property of the longer context, computed once. A table has the
prediction of each distinct (context, symbol) of all texts, built from order 0 up by one join an order. Each batch of texts asks
for its distinct ones and gets one number for each back, packed by buckets of the table.

Base. A unigram score from counts of all words of the training texts. A batch asks for its distinct words in the same way, and
says how often its training texts hold them; a bucket adds these up before it answers.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricefold.llm.common import crc_bucket, lowered, mixed, steps, stored, word_hashes, word_spans

ORDER = 5
#: Taken from each symbol's count for the escape (method D).
DISCOUNT = 0.5
#: End of a text; all byte values are symbols as well.
END = 256
SYMBOLS = 257
#: Contexts before the start of a text are filled with this byte, which no word holds.
FILL = 10
#: Bytes of text that are one array, and of how many such steps the counts are added up before they leave the task.
STEP_TEXT, COUNT_STEPS = 2 << 20, 8
#: Bytes of text that ask together, and predictions in a bucket, on average.
GROUP_BYTES, BUCKET_CELLS = 12 << 20, 1 << 17


def normalised(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(symbols, bounds, words): of each text its words joined by single spaces, then END; words are spans of the lower-cased bytes."""
    low = lowered(data)
    starts, ends, first = word_spans(low, offs)
    n = ends - starts
    last = np.zeros(len(starts), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    width = n + ~last
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    size = np.bincount(text, width, len(offs) - 1).astype(np.int64) + 1
    bounds = np.concatenate(([0], np.cumsum(size)))
    out = np.full(bounds[-1], 32, np.uint16)
    out[bounds[1:] - 1] = END
    # Word w starts where the widths of all before it, and one END for each earlier text, end.
    to = np.concatenate(([0], np.cumsum(width)))[:-1] + text
    idx = np.repeat(to - starts, n)
    solid = np.zeros(len(low) + 1, np.int8)
    solid[starts] += 1
    solid[ends] -= 1
    where = np.flatnonzero(np.cumsum(solid[:-1]))
    out[where + idx] = low[where]
    return out, bounds, (low, starts, ends, first)


def context_keys(sym: np.ndarray, bounds: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Key of each symbol: its ``order`` context bytes, nearest in the highest bits, shifted by nine bits, and the symbol."""
    key = np.zeros(len(sym), np.uint64)
    for k in range(1, order + 1):
        shift = np.uint64(8 * (order - k) + 9)
        back = (sym[:-k] & np.uint16(255)).astype(np.uint64)
        back <<= shift
        key[k:] |= back
    # The first symbols of a text look back beyond its start: set those bytes to FILL.
    for j in range(order):
        at = bounds[:-1] + j
        at = at[at < bounds[1:]]
        outside = np.uint64(((1 << 8 * (order - j)) - 1) << 9)
        fill = np.uint64(sum(FILL << 8 * i for i in range(order - j)) << 9)
        key[at] = (key[at] & ~outside) | fill
    return key | sym


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys by one sort, which is faster here than the hash table of np.unique."""
    return np.unique(keys, return_counts=True)[0]


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    key, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    n = np.bincount(back, np.concatenate([n for _, n in parts]), len(key)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])


def _counted(batches):
    """(key, n) of the training texts, summed over COUNT_STEPS steps of text."""
    parts = []
    for _, data, offs in steps(batches, most=STEP_TEXT):
        sym, bounds, _ = normalised(data, offs)
        parts.append(np.unique(context_keys(sym, bounds), return_counts=True))
        if len(parts) == COUNT_STEPS:
            yield _added(parts)
            parts = []
    if parts:
        yield _added(parts)


class Trie:
    """The model in memory, for small corpora: sorted arrays of the contexts of each order, and a hash table of the predictions of the longest ones."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels[k]: (keys, counts) of the cells of the kept contexts of k bytes; key: context, then nine bits of symbol."""
        self.levels = []
        for key, n in levels:
            order = np.argsort(key)
            cells, count = key[order].astype(np.uint64), n[order].astype(np.float64)
            names, inverse = np.unique(cells >> np.uint64(9), return_inverse=True)
            distinct = np.bincount(inverse, minlength=len(names)).astype(float)
            self.levels.append({"cells": cells, "count": count, "names": names, "total": np.bincount(inverse, count, len(names)), "distinct": distinct})
        # What the next shorter context loses when this one's symbols are excluded.
        for k in range(1, ORDER + 1):
            up, own = self.levels[k - 1], self.levels[k]
            name = own["cells"] >> np.uint64(9)
            short = ((name >> np.uint64(8)) if k > 1 else np.zeros(len(name), np.uint64)) << np.uint64(9) | (own["cells"] & np.uint64(511))
            lost = up["count"][np.searchsorted(up["cells"], short)] if len(short) else np.zeros(0)
            own["lost"] = np.bincount(np.searchsorted(own["names"], name), lost, len(own["names"]))

    def open(self) -> Trie:
        """Build, where it is used, the open-addressed table: key of ORDER context bytes and a symbol, and its log10 probability."""
        top = self.levels[ORDER]
        name = np.searchsorted(top["names"], top["cells"] >> np.uint64(9)) if len(top["cells"]) else np.zeros(0, int)
        value = np.log10((top["count"] - DISCOUNT) / top["total"][name]).astype(np.float32)
        bits = max(4, int(np.ceil(np.log2(max(len(value), 1) * 2.5))))
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.values = np.zeros(1 << bits, np.float32)
        left = np.arange(len(value))
        slot = self._slot(top["cells"])
        while len(left):
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            at, who = np.unique(slot[left[free]], return_index=True)
            self.keys[at] = top["cells"][left[free][who]]
            self.values[at] = value[left[free][who]]
            placed = self.keys[slot[left]] == top["cells"][left]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
        self.mask = (1 << bits) - 1
        return self

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol of each key in its context."""
        out = np.empty(len(key), np.float32)
        slot = self._slot(key)
        left = np.arange(len(key))
        seen = self.keys[slot]
        hit = seen == key
        out[hit] = self.values[slot[hit]]
        left = left[~hit & (seen != np.uint64(2**64 - 1))]
        absent = [np.flatnonzero(~hit & (seen == np.uint64(2**64 - 1)))]
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            seen = self.keys[slot[left]]
            hit = seen == key[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            absent.append(left[~hit & (seen == np.uint64(2**64 - 1))])
            left = left[~hit & (seen != np.uint64(2**64 - 1))]
        rest = np.concatenate(absent)
        if len(rest):
            distinct, back = np.unique(key[rest], return_inverse=True)
            out[rest] = self.slow(distinct)[back]
        return out

    def slow(self, key: np.ndarray) -> np.ndarray:
        """The same, order by order from the longest context down."""
        out = np.zeros(len(key))
        open_ = np.ones(len(key), bool)
        lost_total, lost_distinct = np.zeros(len(key)), np.zeros(len(key))
        sym = key & np.uint64(511)
        for k in range(ORDER, -1, -1):
            level = self.levels[k]
            if not len(level["names"]):
                continue
            name = (key >> np.uint64(9 + 8 * (ORDER - k))) if k else np.zeros(len(key), np.uint64)
            at = np.minimum(np.searchsorted(level["names"], name), len(level["names"]) - 1)
            here = open_ & (level["names"][at] == name)
            cell = (name << np.uint64(9)) | sym
            c = np.minimum(np.searchsorted(level["cells"], cell), len(level["cells"]) - 1)
            found = here & (level["cells"][c] == cell)
            left = level["distinct"][at] - lost_distinct
            whole = level["total"][at] - lost_total
            with np.errstate(divide="ignore", invalid="ignore"):
                out[found] += np.log10((level["count"][c] - DISCOUNT) / whole)[found]
                escape = here & ~found & (left > 0)
                out[escape] += np.log10(DISCOUNT * left / whole)[escape]
            open_ &= ~found
            on = here & ~found
            lost_distinct[on] = level["distinct"][at][on]
            lost_total[on] = level["lost"][at][on] if k else 0
        # Symbols that no context of the text has seen, alike.
        order0 = len(self.levels[0]["cells"])
        out[open_] -= np.log10(max(SYMBOLS - order0, 1))
        return out


def _short(k: int) -> str:
    """SQL: a key of k + 1 context bytes without the farthest one."""
    return "shiftleft(shiftrightunsigned(key, 17), 9) | (key & 511)" if k >= 0 else "key"


def _levels(cells: DataFrame) -> list[DataFrame]:
    """(key, n) of each order from the rows (key, n) of the longest one."""
    levels = [stored(cells.groupBy("key").agg(F.sum("n").alias("n")), "ngrams")]
    for k in range(ORDER - 1, -1, -1):
        levels.insert(0, stored(levels[0].select(F.expr(_short(k)).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n")), "ngrams"))
    return levels


def train(docs: DataFrame, contexts: int | None = None) -> Trie:
    """Trie in memory of the texts of ``docs`` (text), for small corpora; ``score`` does not use it.

    Null texts are empty ones (they still have an end); no rows give the uniform model. With ``contexts`` the rarest
    contexts are left out, by a count cutoff, until no more than these are left.
    """
    levels = _levels(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted, "key long, n long"))
    # A context has at most 257 rows, so a window by context is never large.
    whole = [c.withColumn("total", F.sum("n").over(Window.partitionBy(F.expr("shiftrightunsigned(key, 9)")))) for c in levels]
    cutoff = 1
    if contexts is not None:
        sizes = None
        for c in whole:
            own = c.groupBy(F.expr("shiftrightunsigned(key, 9)").alias("context")).agg(F.first("total").alias("total")).groupBy("total").agg(F.count("*").alias("n"))
            sizes = own if sizes is None else sizes.unionByName(own)
        # Contexts by number of occurrences: few rows, as n rows of different totals need n * n / 2 occurrences.
        room = contexts
        for row in sizes.groupBy("total").agg(F.sum("n").alias("n")).orderBy(F.desc("total")).toLocalIterator():
            room -= row["n"]
            if room < 0:
                cutoff = row["total"] + 1
                break
    cells = [c.where(F.col("total") >= cutoff if k else F.lit(True)).select("key", "n").toArrow() for k, c in enumerate(whole)]
    return Trie([(c["key"].to_numpy().astype(np.uint64), c["n"].to_numpy()) for c in cells])


def predictions(rows: DataFrame) -> DataFrame:
    """(key, p): log10 probability of each distinct (context, symbol) of all ``rows`` (text, held_out), learnt from those not held out."""
    count = lambda which: rows.where(which).select("text").mapInArrow(_counted, "key long, n long")
    levels = _levels(count("NOT held_out").unionByName(count("held_out").withColumn("n", F.lit(0).cast("long"))))
    context = Window.partitionBy(F.expr("shiftrightunsigned(key, 9)"))
    seen = F.col("n") > 0
    log = lambda over, under: F.log10(over) - F.log10(under)
    below = None
    for k, cells in enumerate(levels):
        own = cells.withColumn("total", F.sum("n").over(context)).withColumn("kinds", F.sum(seen.cast("long")).over(context))
        if not k:
            # Symbols that no context of the text has seen, alike.
            own = own.withColumn("after", -F.log10(F.greatest(SYMBOLS - F.col("kinds"), F.lit(1)).cast("double"))).withColumn("before", F.col("after"))
        else:
            short = below.select(F.col("key").alias("short"), *[F.col(c).alias(f"{c}_") for c in ("n", "total", "kinds", "after", "start")])
            own = cells.withColumn("short", F.expr(_short(k))).join(short, "short")
            own = own.withColumn("total", F.sum("n").over(context)).withColumn("kinds", F.sum(seen.cast("long")).over(context))
            # The next shorter context without the symbols of this one.
            whole = F.col("total_") - F.sum(F.when(seen, F.col("n_")).otherwise(0)).over(context)
            left = F.col("kinds_") - F.col("kinds")
            escape = F.when(left > 0, log(DISCOUNT * left, whole)).otherwise(0.0) + F.col("after_")
            own = own.withColumn("after", F.when(F.col("n_") > 0, log(F.col("n_") - DISCOUNT, whole)).otherwise(escape)).withColumn("before", F.col("start_"))
        start = F.when(F.col("total") == 0, F.col("before")).when(seen, log(F.col("n") - DISCOUNT, F.col("total"))).otherwise(log(DISCOUNT * F.col("kinds"), F.col("total")) + F.col("after"))
        # after: of the symbol once this context has been left; start: from this context on.
        below = own.select("key", "n", "total", "kinds", "after", start.alias("start"))
    return stored(below.select("key", F.col("start").cast("float").alias("p")), "predictions")


# ---------------------------------------------------------------- scoring

_END_WORD = mixed(np.array([1 << 40], np.uint64))[0]


def _steps_of(table: pa.Table):
    """(training flags, keys, bounds, words, their texts, tokens) of the texts of a table, about STEP_TEXT at a time."""
    for rows, data, offs in steps(table.combine_chunks().to_batches(), most=STEP_TEXT):
        sym, bounds, (low, starts, ends, first) = normalised(data, offs)
        train = ~rows.column("held_out").to_numpy(zero_copy_only=False)
        yield train, context_keys(sym, bounds), bounds, word_hashes(low, starts, ends), np.repeat(np.arange(len(train)), np.diff(first)), np.diff(first) + 1


def _by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, places) of sorted keys."""
    bucket = (keys % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    names, heads = np.unique(bucket[order], return_index=True)
    return zip(names.tolist(), np.split(order, heads[1:]))


def _deflated(values: np.ndarray) -> bytes:
    """Eight-byte numbers, byte by byte."""
    return zlib.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _inflated(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel()


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys, as differences."""
    return _deflated(np.diff(keys, prepend=np.uint64(0)))


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(_inflated(raw), dtype=np.uint64)


#: Buckets of words have the numbers below 0, and n (how often the training texts hold each).
ASKED = "part long, bucket int, keys binary, n binary"
#: found: single-precision predictions of keys, or counts of words; new: training words of the bucket, in one of its rows.
ANSWERED = "part long, bucket int, found binary, new long"
TEXTS = "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, new long"


def _asker(buckets: int, word_buckets: int):
    def asked(table: pa.Table) -> pa.Table:
        keys, words, counts = [], [np.array([_END_WORD])], [np.zeros(1, np.int64)]
        for train, key, _, word, text, _ in _steps_of(table):
            keys.append(_distinct(key))
            own, back = np.unique(word, return_inverse=True)
            words.append(own)
            counts.append(np.bincount(back, train[text], len(own)).astype(np.int64))
            counts[0] += train.sum()
        keys = _distinct(np.concatenate(keys))
        words, back = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.bincount(back, np.concatenate(counts), len(words)).astype(np.int64)
        rows = [(b, _packed(keys[at]), None) for b, at in _by_bucket(keys, buckets)]
        rows += [(-1 - b, _packed(words[at]), _deflated(counts[at])) for b, at in _by_bucket(words, word_buckets)]
        part = np.full(len(rows), table.column("part")[0].as_py(), np.int64)
        bucket, key, n = zip(*rows)
        return pa.table({"part": part, "bucket": pa.array(bucket, pa.int32()), "keys": pa.array(key, pa.binary()), "n": pa.array(n, pa.binary())})

    return asked


def _answered(asked: pa.Table, cells: pa.Table) -> pa.Table:
    new = np.zeros(asked.num_rows, np.int64)
    if not asked.num_rows:
        found = []
    elif asked.column("bucket")[0].as_py() < 0:
        sets = [_unpacked(raw) for raw in asked.column("keys").to_pylist()]
        words, back = np.unique(np.concatenate(sets), return_inverse=True)
        n = np.concatenate([_inflated(raw) for raw in asked.column("n").to_pylist()]).astype(float)
        count = np.bincount(back, n, len(words)).astype(np.int64)
        found = [_deflated(c) for c in np.split(count[back], np.cumsum([len(s) for s in sets])[:-1])]
        new[0] = (count > 0).sum()
    else:
        keys, p = cells.column("key").to_numpy().astype(np.uint64), cells.column("p").to_numpy()
        order = np.argsort(keys)
        keys, p = keys[order], p[order]
        found = [p[np.searchsorted(keys, _unpacked(raw))].tobytes() for raw in asked.column("keys").to_pylist()]
    return pa.table({"part": asked.column("part"), "bucket": asked.column("bucket"), "found": pa.array(found, pa.binary()), "new": pa.array(new)})


def _scorer(buckets: int, word_buckets: int):
    def scored(table: pa.Table, answers: pa.Table) -> pa.Table:
        parts = []
        for _, key, bounds, word, text, tokens in _steps_of(table):
            own, back = np.unique(key, return_inverse=True)
            own_words, back_words = np.unique(word, return_inverse=True)
            parts.append((own, back.astype(np.int32), bounds, own_words, back_words.astype(np.int32), text, tokens))
        keys = _distinct(np.concatenate([p[0] for p in parts]))
        words = np.unique(np.concatenate([np.array([_END_WORD]), *(p[3] for p in parts)]))
        given = dict(zip(answers.column("bucket").to_pylist(), answers.column("found").to_pylist()))
        predicted, count = np.empty(len(keys), np.float32), np.empty(len(words), np.int64)
        for b, at in _by_bucket(keys, buckets):
            predicted[at] = np.frombuffer(given[b], np.float32)
        for b, at in _by_bucket(words, word_buckets):
            count[at] = _inflated(given[-1 - b]).view(np.int64)
        end = count[np.searchsorted(words, _END_WORD)]
        out = []
        for own, back, bounds, own_words, back_words, text, tokens in parts:
            score = np.add.reduceat(predicted[np.searchsorted(keys, own)][back].astype(float), bounds[:-1])
            c = count[np.searchsorted(words, own_words)][back_words]
            known = np.bincount(text, c > 0, len(tokens)).astype(np.int64) + (end > 0)
            logs = np.bincount(text, np.log10(c + 0.5), len(tokens)) + np.log10(end + 0.5)
            out.append((tokens.astype(np.int64), known, logs, score))
        tokens, known, logs, score = (np.concatenate(x) for x in zip(*out))
        new = np.zeros(len(tokens), np.int64)
        new[0] = sum(answers.column("new").to_pylist())
        return pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("held_out"), "n_tokens": tokens, "n_known": known, "logs": logs, "score": score, "new": new})

    return scored


def score(docs: DataFrame, fold: int = 1) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text), learning from those whose crc32(doc_id as text) mod 5 is not ``fold``.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens (long), base_score, score (double; log10 of the model's
    probability of the whole text). Null and empty texts are the end symbol alone; a null doc_id counts as the empty
    text in crc32; repeated rows are scored, and learnt from, each. With no training rows N and V are 0 and the model
    is uniform. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (crc_bucket(F.col("doc_id")) == fold).alias("held_out"))
    model = predictions(rows)
    # All three numbers grow with the input; odd ones spread the keys.
    groups = (rows.select(F.sum(F.octet_length("text"))).first()[0] or 0) // GROUP_BYTES + 1
    buckets, word_buckets = max(model.count() // BUCKET_CELLS, groups // 8) | 1, groups // 4 | 1
    texts = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    asked = texts.groupBy("part").applyInArrow(_asker(buckets, word_buckets), ASKED)
    cells = model.withColumn("bucket", F.expr(f"cast(key % {buckets} as int)"))
    answers = asked.groupBy("bucket").cogroup(cells.groupBy("bucket")).applyInArrow(_answered, ANSWERED)
    texts = stored(texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_scorer(buckets, word_buckets), TEXTS), "scores")
    # Two numbers of the whole table, as scalar subqueries.
    train_tokens = texts.select(F.coalesce(F.sum(F.expr("if(held_out, 0, n_tokens)")), F.lit(0))).scalar()
    vocabulary = texts.select(F.coalesce(F.sum("new"), F.lit(0))).scalar()
    base = F.col("logs") - F.col("n_tokens") * F.log10(train_tokens + F.lit(0.5) * (vocabulary + 1))
    return texts.select("doc_id", "held_out", "n_tokens", "n_known", train_tokens.alias("train_tokens"), base.alias("base_score"), "score")
