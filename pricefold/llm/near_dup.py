"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes its set of word shingles; equal sets are one class, represented by
   the smallest doc_id (a group of copies costs one row from here on).
2. Classes get a MinHash signature; ``bands`` keys of ``rows`` hashes each propose candidates.
3. In each bucket every class is compared with the bucket's smallest one (a star, never all pairs).
   Signatures are compared batch by batch; a pair is dropped as soon as the posterior probability
   that its similarity reaches the threshold is below ``miss``. Survivors are verified on full sets.
4. Buckets that still hold several components are finished exactly: the members outside the
   bucket's largest component are compared with all others of a different component, in blocks
   of ``BLOCK`` rows, so no task holds a bucket, no pair within a component is formed, and only links leave a task.
5. Components of the verified links give the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.llm.common import mixed, shingle_sets, steps, stored
from pricefold.llm.components import components

SHINGLE = 5
THRESHOLD_PCT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Hashes compared at once, and the chance that such a step drops a pair that reaches the threshold.
BATCH, MISS = 32, 1e-6
#: Rows of one side of a block comparison.
BLOCK = 256
#: Bits of the filter that selects the texts whose full sets are needed (2 MB, whatever the corpus).
FILTER_BITS = 1 << 24

_ids = np.arange(1, HASHES + 1, dtype=np.uint64)
_A = (mixed(_ids) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mixed(_ids + np.uint64(1 << 20)) >> np.uint64(32)).astype(np.uint32)


def minhash(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, HASHES) uint32 signatures of non-empty runs of distinct shingle hashes."""
    out = np.empty((len(first) - 1, HASHES), np.uint32)
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    buf = np.empty_like(h)
    for j in range(HASHES):
        np.multiply(h, _A[j], out=buf)
        np.add(buf, _B[j], out=buf)
        out[:, j] = np.minimum.reduceat(buf, first[:-1]) if len(h) else 0
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys; equal exactly where the rows of the band are equal (up to 64-bit collisions)."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(7), s.shape[:2]).copy()
    for r in range(ROWS):
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + s[:, :, r])
    return out.view(np.int64)


def least_matches(threshold_pct: int = THRESHOLD_PCT, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes seen, fewest matches that keep the pair) after each batch.

    Uniform prior on the similarity s; a hash byte matches with probability s + (1 - s) / 256.
    """
    s = (np.arange(20000) + 0.5) / 20000
    p = s + (1 - s) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            like = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(like - like.max())
            if w[s >= threshold_pct / 100].sum() / w.sum() >= miss:
                out.append((n, m))
                break
    return out


LEAST_MATCHES = least_matches()


def bayes_keeps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of the signature bytes a and b whose similarity can still reach the threshold."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    at = 0
    for n, least in LEAST_MATCHES:
        matches[alive] += (a[alive, at:n] == b[alive, at:n]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
        at = n
    return alive


def _signed(batches):
    for rows, data, offs in steps(batches):
        hashes, first = shingle_sets(data, offs, SHINGLE)
        n = np.diff(first)
        full = n > 0
        sig = minhash(hashes, np.concatenate((first[:-1][full], first[-1:]))) if full.any() else np.empty((0, HASHES), np.uint32)
        one, two = mixed(hashes + np.uint64(1)), mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        starts = first[:-1][full]
        key = np.stack([np.add.reduceat(one, starts), np.bitwise_xor.reduceat(two, starts), n[full].astype(np.uint64)], axis=1) if full.any() else np.empty((0, 3), np.uint64)
        where = np.cumsum(full) - 1
        low, bands = (sig & np.uint32(255)).astype(np.uint8), band_keys(sig)
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id"),
                pa.array(n.astype(np.int64)),
                pa.array([key[i].tobytes() if f else None for f, i in zip(full, where)], pa.binary()),
                pa.array([bands[i].tobytes() if f else None for f, i in zip(full, where)], pa.binary()),
                pa.array([low[i].tobytes() if f else None for f, i in zip(full, where)], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "key", "bands", "sig"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (digest of the set; null for empty texts), bands, sig of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _signed, "doc_id long, n_shingles long, key binary, bands binary, sig binary"
    )


def _unpacked(bands: str):
    """The keys of a packed row of bands (little-endian) as an array of longs, with the band's number mixed in by band_keys."""
    return F.expr(f"transform(sequence(0, {BANDS - 1}), k -> xxhash64(k, substring({bands}, 8 * k + 1, 8)))")


def _bayes_pairs(batches):
    for x in batches:
        a, b = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        keep = pa.array(bayes_keeps(a, b))
        yield pa.RecordBatch.from_arrays([x.column("a").take(keep), x.column("b").take(keep)], names=["a", "b"])


def _linked(batches):
    for x in batches:
        keep = []
        for i, (s, t) in enumerate(zip(x.column("set_a"), x.column("set_b"))):
            s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
            lo, hi = sorted((len(s), len(t)))
            if 100 * lo >= THRESHOLD_PCT * hi:
                both = np.concatenate((s, t))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * common >= THRESHOLD_PCT * (lo + hi - common):
                    keep.append(i)
        keep = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([x.column("a").take(keep), x.column("b").take(keep)], names=["a", "b"])


def _needed_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(class_id, set): full shingle sets, as sorted bytes, of the classes in ``needed`` (class_id).

    The texts are read again rather than kept; a filter of fixed size picks the rows, so
    that texts without candidates are not shuffled. Its false positives go in the join.
    """
    bit = F.pmod(F.xxhash64("class_id"), F.lit(FILTER_BITS))
    packed = needed.select(bit.alias("p")).groupBy((F.col("p") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("m"))
    table = np.zeros(FILTER_BITS // 64, np.int64)
    packed = packed.toArrow()  # at most FILTER_BITS / 64 rows
    table[packed["w"].to_numpy()] = packed["m"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(table.tobytes())

    def sets(batches):
        bits = np.frombuffer(sent.value, np.int64)
        for x in batches:
            p = x.column("p").to_numpy(zero_copy_only=False)
            hit = (bits[p >> 6] >> (p & 63)) & 1 == 1
            for rows, data, offs in steps([x.filter(pa.array(hit))]):
                hashes, first = shingle_sets(data, offs, SHINGLE)
                raw = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([rows.column("class_id"), pa.array(raw, pa.binary())], names=["class_id", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("class_id"), F.col("text").cast("string").alias("text")).where("class_id IS NOT NULL AND text IS NOT NULL")
    found = rows.withColumn("p", bit).mapInArrow(sets, "class_id long, set binary").where("length(set) > 0")
    # A repeated row counts once, on the map side already.
    found = found.groupBy("class_id", F.xxhash64("set").alias("h")).agg(F.first("set").alias("set")).drop("h")
    return found.join(needed, "class_id", "left_semi")


def _check(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) that the sequential test keeps."""
    sig = classes.select("class_id", "sig")
    full = pairs.join(sig.select(F.col("class_id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("class_id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return full.mapInArrow(_bayes_pairs, "a long, b long")


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the threshold."""
    full = pairs.join(sets.select(F.col("class_id").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("class_id").alias("b"), F.col("set").alias("set_b")), "b")
    return full.mapInArrow(_linked, "a long, b long")


def _cross_pairs(rows: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(left row, right rows) of one block: rows of different components that share a band and that the test keeps."""
    side, comp = rows.column("side").to_numpy(), rows.column("component").to_numpy()
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
    bands = np.frombuffer(b"".join(rows.column("bands").to_pylist()), np.int64).reshape(-1, BANDS)
    left = np.flatnonzero(side == 0)
    within = bool(rows.column("within")[0].as_py())
    right = left if within else np.flatnonzero(side == 1)
    for n, i in enumerate(left):
        other = right[n + 1 :] if within else right
        other = other[comp[other] != comp[i]]
        other = other[(bands[other] == bands[i]).any(axis=1)]
        if len(other):
            yield i, other[bayes_keeps(np.broadcast_to(sig[i], (len(other), HASHES)), sig[other])]


def _block_members(rows: pa.Table) -> pa.Table:
    """Rows of the block that are in any candidate pair."""
    found = np.zeros(rows.num_rows, bool)
    for i, other in _cross_pairs(rows):
        if len(other):
            found[i] = True
            found[other] = True
    return rows.filter(pa.array(found)).select(["main", "class_id"])


def _block_links(rows: pa.Table) -> pa.Table:
    """Verified links of the block; none that joins components which its other links join already."""
    ids, comp = rows.column("class_id").to_numpy(), rows.column("component").to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in rows.column("set").to_pylist()]
    size = np.array([len(s) for s in sets])
    label = dict.fromkeys(comp.tolist())

    def root(c):
        while label[c] is not None:
            c = label[c]
        return c

    a, b = [], []
    for i, other in _cross_pairs(rows):
        lo, hi = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
        other = other[100 * lo >= THRESHOLD_PCT * hi]
        if not len(other):
            continue
        flat = np.concatenate([sets[j] for j in other])
        at = np.searchsorted(sets[i], flat)
        same = sets[i][np.minimum(at, len(sets[i]) - 1)] == flat
        common = np.add.reduceat(same.astype(np.int64), np.concatenate(([0], np.cumsum(size[other])[:-1])))
        for j in other[100 * common >= THRESHOLD_PCT * (size[i] + size[other] - common)]:
            x, y = root(int(comp[i])), root(int(comp[j]))
            if x != y:
                label[max(x, y)] = min(x, y)
                a.append(int(ids[i]))
                b.append(int(ids[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _jobs(members: DataFrame) -> DataFrame:
    """The block comparisons that each member takes part in: columns i, j, within, side are added.

    members: main, class_id, component. The rest (members outside the component main) meets main block by block,
    and itself; main never meets itself. A row is copied once per opposite block of BLOCK rows.
    """
    sizes = members.groupBy("main").agg(F.ceil(F.sum(F.expr("int(component = main)")) / BLOCK).cast("int").alias("n_main"), F.ceil(F.sum(F.expr("int(component <> main)")) / BLOCK).cast("int").alias("n_rest"))
    m = members.join(sizes.where("n_rest > 0"), "main")
    m = m.withColumn("block", F.expr("int(pmod(xxhash64(class_id), if(component = main, n_main, n_rest)))"))
    jobs = F.expr(
        "if(component = main,"
        " transform(sequence(0, n_rest - 1), r -> named_struct('i', r, 'j', -1 - block, 'side', 1)),"
        " concat(if(n_main = 0, array(), transform(sequence(0, greatest(n_main, 1) - 1), q -> named_struct('i', block, 'j', -1 - q, 'side', 0))),"
        " transform(sequence(0, n_rest - 1), s -> named_struct('i', least(block, s), 'j', greatest(block, s), 'side', int(s < block)))))"
    )
    rows = m.select("main", "class_id", "component", F.explode(jobs).alias("x")).select("main", "class_id", "component", "x.*")
    return rows.withColumn("within", F.expr("i = j"))


def _cross_links(members: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Verified links (a, b) between different components that share a bucket. members: band, class_id, component.

    Buckets are gathered by their largest component ("main"), so that a class meets the others once
    and not in each of its buckets. Signatures alone pick the members of any candidate pair; only
    these are compared again with their full sets.
    """
    parts = members.groupBy("band", "component").agg(F.count("*").alias("n"))
    stats = parts.groupBy("band").agg(F.sum("n").alias("total"), F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("k"))
    # Two members were compared by the star already.
    mixed_buckets = stats.where("k > 1 AND total > 2").select("band", F.col("top.component").alias("main"))
    group = stored(members.join(mixed_buckets, "band").select("main", "class_id", "component").distinct(), "group")
    sig = classes.select("class_id", "sig", "bands")
    key = ["main", "i", "j"]
    picked = _jobs(group).join(sig, "class_id").groupBy(*key).applyInArrow(_block_members, "main long, class_id long").distinct()
    picked = stored(group.join(picked, ["main", "class_id"], "left_semi"), "picked")
    full = _jobs(picked).join(sig.join(sets, "class_id"), "class_id")
    return full.groupBy(*key).applyInArrow(_block_links, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and key (digest of the set) of every row of ``docs`` (doc_id, text).

    Texts link where 100 * |intersection| >= 75 * |union| of their distinct 5-word shingles (A-Z lower-cased;
    under five words: the whole sequence is the one shingle). component_id is the smallest doc_id reachable by
    links; kept marks doc_id = component_id. Null and empty texts, and texts without words, have no shingles and
    link with nothing. Rows with a null doc_id link with nothing: component_id is null, kept is true. Repeated
    rows get equal results; rows that share a doc_id with different texts are grouped by their own text.
    Other columns are ignored. A link is missed only if all 32 bands differ (below 1e-5 at the threshold) or a
    Bayesian step fails (MISS a step).
    """
    spark = docs.sparkSession
    t = stored(signatures(docs), "signatures")
    usable = t.where("key IS NOT NULL AND doc_id IS NOT NULL")
    firsts = usable.groupBy("key").agg(F.min("doc_id").alias("class_id"))
    classes = stored(usable.join(firsts.select("key", F.col("class_id").alias("doc_id")), ["key", "doc_id"]).groupBy("key", "doc_id").agg(F.first("bands").alias("bands"), F.first("sig").alias("sig")).withColumnRenamed("doc_id", "class_id"), "classes")
    banded = classes.select("class_id", F.explode(_unpacked("bands")).alias("band"))
    hubs = banded.groupBy("band").agg(F.min("class_id").alias("hub"), F.max("class_id").alias("last")).where("hub < last").drop("last")
    members = stored(banded.join(hubs, "band"), "members")
    star = members.where("class_id <> hub").select(F.col("hub").alias("a"), F.col("class_id").alias("b")).distinct()
    sets = stored(_needed_sets(docs, members.select("class_id").distinct()), "sets")
    links = stored(_verify(_check(star, classes), sets), "links")
    labels = components(links)
    known = members.join(labels.select(F.col("id").alias("class_id"), "component"), "class_id", "left").select("band", "class_id", F.coalesce("component", "class_id").alias("component"))
    more = stored(_cross_links(known, classes, sets), "more")
    if not more.isEmpty():
        labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    classed = classes.select("key", "class_id").join(labels.select(F.col("id").alias("class_id"), "component"), "class_id", "left").select("key", F.coalesce("component", "class_id").alias("component"))
    out = t.select("doc_id", "n_shingles", "key").join(classed, "key", "left")
    # A row without shingles has no key; one without an id has no component.
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "key")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate group, columns unchanged.

    Kept: the document with the group's smallest doc_id, once if its row repeats; all rows without an id.
    """
    mine = {c: f"_own_{i}" for i, c in enumerate(docs.columns)}
    found = near_duplicates(docs)
    keep = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept_id")).distinct()
    named = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in mine.items()])
    own_id, own_text = mine["doc_id"], mine["text"]
    joined = named.join(keep, F.col(own_id).cast("long") == F.col("_kept_id"), "left_semi")
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        joined = joined.withColumn("_text_hash", F.sha2(F.coalesce(own_text, F.lit("")), 256)).dropDuplicates([own_id, "_text_hash"]).drop("_text_hash")
    rest = named.where(F.col(own_id).cast("long").isNull())
    return joined.unionByName(rest).select(*[F.col(n).alias(c) for c, n in mine.items()])
