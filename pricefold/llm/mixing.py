"""Mixing sources to target weights by Poisson replication.

Every document of a source with n rows gets a Poisson number of copies with mean
rate = total * share / n, by inverting the distribution at a uniform number hashed from
(seed, doc_id): the result is the same in every run and on every cluster. The copies are
dealt over all partitions by a hash and sorted by it within each, which is a global shuffle
without a sampling pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rates above this are the sum of several draws, so that exp(-rate) stays far from underflow.
LARGEST_RATE = 500.0
#: Sources up to this number are sent to all executors; more are joined by shuffle.
BROADCAST_SOURCES = 10_000
ALPHA = 0.5
SEED = 17


def rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, alpha: float = ALPHA, total: float | None = None) -> DataFrame:
    """(source, n, rate): mean copies of a document of each source.

    ``weights``: target share of each named source (normalised; sources without one get none).
    Without it a source's share follows n ** alpha: 1 keeps the mix, 0 makes all sources equal.
    ``total``: rows wanted, by default as many as there are. Null sources count as the source ''.
    """
    n = docs.groupBy(F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        n = n.withColumn("share", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        share = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k or ""), F.lit(float(v)))]) if weights else F.lit(None)
        n = n.withColumn("share", F.coalesce(F.element_at(share, F.col("source")), F.lit(0.0)) if weights else F.lit(0.0))
    shares, rows = n.select(F.sum("share")).scalar(), n.select(F.sum("n")).scalar()
    wanted = rows if total is None else F.lit(float(total))
    rate = F.when(F.col("share") > 0, wanted * F.col("share") / shares / F.col("n")).otherwise(F.lit(0.0))
    return n.select("source", "n", rate.alias("rate"))


def _cdf(rate: str) -> str:
    """P(copies <= k) for k = 0, 1, ... until the rest is below 2 ** -53, the spacing of the uniform numbers."""
    steps = f"CAST(ceil({rate} + 12 * sqrt({rate}) + 40) AS INT)"
    return (
        f"aggregate(sequence(1, {steps}), named_struct('p', exp(-{rate}), 'c', array(exp(-{rate}))), (s, k) -> "
        f"named_struct('p', s.p * {rate} / k, 'c', array_append(s.c, element_at(s.c, -1) + s.p * {rate} / k)), s -> s.c)"
    )


def replicate(docs: DataFrame, rate: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as drawn, with columns ``copy`` (from 1) and ``shuffle_key`` added, globally shuffled.

    rate: (source, rate) from :func:`rates`. Rows with a null doc_id draw by their text (null: empty). Repeated
    rows draw alike and keep each their copies. Own columns copy and shuffle_key pass through; the added
    ones then end in an underscore. An empty table gives an empty one.
    """
    names = list(docs.columns)
    added = []
    for name in ("copy", "shuffle_key"):
        while name in names:
            name += "_"
        added.append(name)
    own = docs.toDF(*[f"own{i}" for i in range(len(names))])  # no name of the user's meets one used here
    of = lambda c: F.col(f"own{names.index(c)}").cast("string")
    parts = rate.where("rate > 0").select("source", F.ceil(F.col("rate") / LARGEST_RATE).cast("int").alias("draws"), "rate")
    parts = parts.withColumn("each", F.col("rate") / F.col("draws")).select("source", "draws", F.expr(_cdf("each")).alias("cdf"))
    few = parts.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    who = F.coalesce(of(doc_id), F.concat(F.lit("text:"), F.md5(F.coalesce(of(text), F.lit("")))))
    rows = own.withColumn("who", who).withColumn("key", F.coalesce(of(source), F.lit("")))
    rows = rows.join(F.broadcast(parts) if few else parts, F.col("key") == F.col("source"))
    uniform = f"CAST(conv(substr(md5(concat('{seed}|', who, '|', j)), 1, 13), 16, 10) AS DOUBLE) / 4503599627370496D"
    # The inverse of the distribution: as many steps of it as lie at or below the uniform number.
    count = f"aggregate(sequence(1, draws), 0, (t, j) -> t + element_at(transform(array({uniform}), u -> size(filter(cdf, c -> c <= u))), 1))"
    drawn = rows.withColumn("n", F.expr(count)).where("n > 0").drop("cdf", "draws", "source", "key")
    copies = drawn.withColumn("copy", F.explode(F.expr("sequence(1, n)")))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}|shuffle|"), F.col("who"), F.lit("|"), F.col("copy"))))
    dealt = copies.select(*own.columns, "copy", "shuffle_key").repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
    return dealt.toDF(*names, *added)


def mixed_corpus(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """``docs`` replicated to the target weights of their ``source`` and shuffled; see :func:`replicate`."""
    return replicate(docs, rates(docs, weights=weights, alpha=alpha), seed=seed)
