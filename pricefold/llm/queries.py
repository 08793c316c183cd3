"""Registered queries of the training-data operators: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricefold.llm.alignment import align, pieces
from pricefold.llm.chunks import repeated_passages
from pricefold.llm.common import crc_bucket, table
from pricefold.llm.decontaminate import contaminated
from pricefold.llm.mixing import mixed_corpus
from pricefold.llm.near_dup import near_duplicates
from pricefold.llm.orchard import clustered, whole_vectors
from pricefold.llm.pii import pseudonymise
from pricefold.llm.pii_oracle import oracle as pii_oracle
from pricefold.llm.ppm import score as ppm_score
from pricefold.llm.rank_merge import count_tokens, vocabulary
from pricefold.llm.secrets import secrets
from pricefold.llm.topk import quantised, top_k
from pricefold.llm.toxicity import score, train
from pricefold.llm.warc import archived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


#: DuckDB: words of a text (A-Z lower-cased) and its distinct 5-word shingles.
SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SQL_SHINGLES = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END"


@_query("op5_minhash_near_dup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLES["op5_minhash_near_dup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
n AS (SELECT doc_id, {SQL_SHINGLES} AS gs FROM d),
s AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS g FROM n),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n
          HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(gs)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


@_query("op2_poisson_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixed_corpus(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copy", "shuffle_key", "text")


ORACLES["op2_poisson_mixing"] = r"""
WITH n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT s, (SELECT sum(n) FROM n) * sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM n) / n AS rate FROM n),
p AS (SELECT s, ceil(rate / 500.0)::INT AS draws, rate / ceil(rate / 500.0) AS each FROM r),
c AS (SELECT s, draws, [list_sum([exp(-each + j * ln(each) - lgamma(j + 1)) FOR j IN range(0, k + 1)])
             FOR k IN range(0, ceil(each + 12 * sqrt(each) + 40)::INT + 1)] AS cdf FROM p),
d AS (SELECT doc_id, source, text, cdf, draws, coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))) AS who
      FROM documents JOIN c ON coalesce(source, '') = s),
m AS (SELECT doc_id, source, text, who,
             list_sum([len([x FOR x IN cdf IF x <= ('0x' || substr(md5('17|' || who || '|' || j), 1, 13))::BIGINT / 4503599627370496.0])
                       FOR j IN range(1, draws + 1)])::INT AS copies FROM d)
SELECT doc_id, source, copy::INT AS copy, md5('17|shuffle|' || who || '|' || copy) AS shuffle_key, text
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM m)
"""


@_query("op4_feistel_pseudonyms")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op4_feistel_pseudonyms"] = pii_oracle()


@_query("op6_minhash_containment")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op6_minhash_containment"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {SQL_WORDS} AS w FROM documents),
ds AS (SELECT rid, doc_id, unnest({SQL_SHINGLES}) AS g FROM d),
i AS (SELECT row_number() OVER () AS iid, item_id, {SQL_WORDS} AS w FROM benchmark),
n AS (SELECT iid, item_id, {SQL_SHINGLES} AS gs FROM i),
s AS (SELECT iid, item_id, len(gs) AS n_item_shingles, unnest(gs) AS g FROM n)
SELECT doc_id, item_id, n_item_shingles, count(*) AS n_common, count(*) / n_item_shingles::DOUBLE AS containment
FROM ds JOIN s USING (g) GROUP BY rid, doc_id, iid, item_id, n_item_shingles
HAVING 100 * count(*) >= 75 * n_item_shingles
"""


@_query("op10_subsequence_svm")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.withColumn("held_out", crc_bucket(F.col("doc_id")) == 0), model)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


@_query("op7_maxscore_topk")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


ORACLES["op7_maxscore_topk"] = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_sum([q.e[i] * c.e[i] FOR i IN range(1, least(len(q.e), len(c.e)) + 1)])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query("op9_warc_segments")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _sql_base32(sha: str) -> str:
    """DuckDB: four groups of ten hex digits are eight base-32 digits each."""
    groups = " || ".join(f"to_base(('0x' || substr({sha}, {at}, 10))::BIGINT, 32, 8)" for at in (1, 11, 21, 31))
    return f"translate({groups}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"


ORACLES["op9_warc_segments"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, {_sql_base32('sha1(payload)')} AS payload_digest,
             min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f
"""


@_query("op8_credential_linking")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = "filter(spans, s -> s.kind IN ('assign', 'access', 'hex'))"
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))


@_query("op1_ppm_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_score(table(spark, sf_dir, "documents"))


@_query("op3_gear_chunks")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


#: Vocabularies of the public tokenizers that the queries count with.
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


@_query("op11_rank_merge_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary(public_tokenizers.path(BYTE_BPE)))


@_query("op12_orchard_clusters")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(whole_vectors(table(spark, sf_dir, "embeddings")))


def _sql_rounds(rounds: int) -> str:
    """DuckDB: (number, centroid) after each round as tables c0, c1, ...; the assignments that lead there as a0, a1, ..."""
    distance = "list_sum([(v.e[i] - c.m[i]) * (v.e[i] - c.m[i]) FOR i IN range(1, 65)])::BIGINT"
    out = []
    for r in range(rounds + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT rid, arg_min(c, row(d, c)) AS c, min(d) AS d FROM (SELECT v.rid, c.c, {distance} AS d FROM v, c{r} c) GROUP BY rid)")
        if r < rounds:
            mean = "((s - (((s % n) + n) % n)) // n)::BIGINT"
            sums = f"SELECT a.c, u.i, sum(v.e[u.i]) AS s, count(*) AS n FROM a{r} a JOIN v USING (rid), (SELECT unnest(range(1, 65)) AS i) u GROUP BY a.c, u.i"
            new = f"SELECT c, list({mean} ORDER BY i) AS m FROM ({sums}) GROUP BY c"
            out.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN ({new}) n USING (c))")
    return ",\n".join(out)


ORACLES["op12_orchard_clusters"] = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), e) - 1 AS c, e AS m FROM v ORDER BY sha256('3:' || vec_id), e LIMIT 8),
{_sql_rounds(10)}
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a10 JOIN v USING (rid) JOIN c10 USING (c)
"""


@_query("op13_perfect_hash_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte, piece = vocabulary(public_tokenizers.path(BYTE_BPE)), pieces(public_tokenizers.path(PIECE_BPE))
    found = align(table(spark, sf_dir, "documents"), byte, piece)
    return found.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
