"""Queries of the vector retrieval family."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import sets, vectors
from ledgerleaf.operators import retrieval

from .base import query, table

#: Queries are the rows whose id is divisible by 100, against all rows.
_PAIRS = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS q_label FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, q_label, vec_id AS chunk_id, label, list_cosine_similarity(q, embedding::DOUBLE[]) AS sim FROM q, embeddings)
"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where("vec_id % 100 = 0")
    return rows.select(F.col("vec_id").alias("query_id"), vectors.doubles(F.col("embedding")).alias("q"), F.col("label").alias("q_label"), F.array("label", ((F.col("label") + 1) % 10).cast("int")).alias("scope"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), vectors.doubles(F.col("embedding")).alias("v"), "label")


@query(
    "v4_scoped_topk",
    f"WITH {_PAIRS}, r AS (SELECT query_id, chunk_id, label, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s WHERE label IN (q_label, (q_label + 1) % 10) AND sim >= 0.1) SELECT query_id, chunk_id, label, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS similarity FROM r WHERE rank <= 5",
)
def v4_scoped_topk(spark: SparkSession, d: str) -> DataFrame:
    pairs = retrieval.scored_pairs(_queries(spark, d), _chunks(spark, d), on="label")
    return retrieval.top_k(pairs, 5, 0.1).select("query_id", "chunk_id", "label", "rank", F.round("similarity", 6).alias("similarity"))


@query("v5_plain_match", f"WITH {_PAIRS}, r AS (SELECT query_id, chunk_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(sim, 6) AS similarity FROM r WHERE rank <= 8")
def v5_plain_match(spark: SparkSession, d: str) -> DataFrame:
    pairs = retrieval.best_pairs(_queries(spark, d).drop("scope"), _chunks(spark, d), 8)
    return retrieval.top_k(pairs, 8).select("query_id", "chunk_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("v1_normalise", "SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))), 6) AS total FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def v1_normalise(spark: SparkSession, d: str) -> DataFrame:
    unit = vectors.normalise(vectors.doubles(F.col("embedding")))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("v3_cosine_distance", f"WITH {_PAIRS} SELECT query_id, label, count(*) AS n, round(min(1 - sim), 6) AS nearest, round(max(1 - sim), 6) AS farthest FROM s WHERE chunk_id <> query_id GROUP BY query_id, label")
def v3_cosine_distance(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.tallies(_queries(spark, d).select("query_id", "q"), _chunks(spark, d), "label", [])
    return found.select("query_id", "label", "n", F.round(1 - F.col("most"), 6).alias("nearest"), F.round(1 - F.col("least"), 6).alias("farthest"))


@query("v9_vector_validity", "SELECT label, count(*) AS n, sum(CASE WHEN len(e) = 64 AND abs(sqrt(list_sum(list_transform(e, lambda x: x * x))) - 1) <= 1e-6 THEN 1 ELSE 0 END)::BIGINT AS n_valid FROM (SELECT label, embedding::DOUBLE[] AS e FROM embeddings) GROUP BY label")
def v9_vector_validity(spark: SparkSession, d: str) -> DataFrame:
    ok = vectors.valid(vectors.doubles(F.col("embedding")), 64)
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("n_valid"))


@query("v13_source_issue", f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s), h AS (SELECT query_id, count(DISTINCT label) AS n_c, max(query_id % 200 = 0) AS scoped, count(DISTINCT chunk_id // 10) AS n_d, count(DISTINCT chunk_id) AS n_b FROM r WHERE rank <= 8 GROUP BY query_id) SELECT query_id, CASE WHEN n_c > 1 AND NOT scoped THEN 'needs_scope' WHEN n_b > n_d THEN 'conflicting_sources' ELSE 'none' END AS issue FROM h")
def v13_source_issue(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.top_k(retrieval.best_pairs(_queries(spark, d).drop("scope"), _chunks(spark, d), 8), 8)
    hits = hits.select("query_id", "label", F.expr("chunk_id div 10").alias("document_id"), (F.col("chunk_id") % 10).alias("byte_hash"))
    return retrieval.source_issue(hits, "label", F.col("query_id") % 200 == 0)


@query("v14_status_ladder", f"WITH {_PAIRS}, h AS (SELECT query_id, any_value(q_label) AS q_label, count(*) FILTER (WHERE sim >= 0.5 AND chunk_id <> query_id) AS n_evidence FROM s GROUP BY query_id) SELECT query_id, n_evidence, CASE WHEN query_id % 700 = 0 AND query_id > 0 THEN 'invalid_query' WHEN q_label = 9 THEN 'release_changed' WHEN q_label = 8 THEN 'configuration_mismatch' WHEN n_evidence = 0 THEN 'insufficient_evidence' WHEN q_label = 7 THEN 'needs_scope' WHEN n_evidence > 50 THEN 'insufficient_evidence' WHEN q_label % 2 = 0 THEN 'uncalibrated' ELSE 'ok' END AS status FROM h")
def v14_status_ladder(spark: SparkSession, d: str) -> DataFrame:
    queries = _queries(spark, d)
    tallied = retrieval.tallies(queries.drop("scope"), _chunks(spark, d), "label", [0.5])
    near = tallied.groupBy("query_id").agg(F.sum(F.col("at_least")[0]).alias("n_evidence"))
    found = queries.select("query_id", "q_label").join(near, "query_id", "left").na.fill(0, ["n_evidence"])  # a query may be alone
    rows = found.select(
        "query_id",
        "n_evidence",
        ((F.col("query_id") % 700 == 0) & (F.col("query_id") > 0)).alias("intent_without_policy"),
        F.when(F.col("q_label") == 9, 2).otherwise(1).alias("n_releases"),
        (F.col("q_label") != 8).alias("configuration_equal"),
        F.lit(True).alias("vector_valid"),
        F.when(F.col("q_label") == 7, "needs_scope").otherwise("none").alias("issue"),
        F.greatest(F.col("n_evidence") - 50, F.lit(0)).alias("n_gaps"),
        F.when(F.col("q_label") % 2 == 0, "uncalibrated-1").otherwise("policy-1").alias("policy_id"),
    )
    return retrieval.retrieval_status(rows).select("query_id", "n_evidence", "status")


_GRID = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]


@query("v15_calibration", f"WITH {_PAIRS}, g AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6])::DOUBLE AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE label = q_label) AS recovered, count(*) FILTER (WHERE label <> q_label) AS false_positives FROM g, s WHERE sim >= threshold AND chunk_id <> query_id GROUP BY threshold), a AS (SELECT g.threshold, coalesce(recovered, 0) AS recovered, coalesce(false_positives, 0) AS false_positives FROM g LEFT JOIN c USING (threshold)) SELECT *, row_number() OVER (ORDER BY recovered DESC, false_positives, threshold DESC) = 1 AS best FROM a")
def v15_calibration(spark: SparkSession, d: str) -> DataFrame:
    found = retrieval.tallies(_queries(spark, d).drop("scope"), _chunks(spark, d), "label", _GRID)
    return retrieval.calibrate_tallies(found, F.col("label") == F.col("q_label"), _GRID)


@query("m1_ranking_metrics", f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM s WHERE chunk_id <> query_id AND sim >= 0.1), k AS (SELECT query_id, count(*) AS n_selected, sum(CASE WHEN label = q_label THEN 1 ELSE 0 END)::BIGINT AS n_hits FROM r WHERE rank <= 5 GROUP BY query_id), c AS (SELECT query_id, CASE WHEN query_id % 300 = 0 THEN 0 ELSE n - 1 END AS n_gold FROM q JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) t ON t.label = q_label) SELECT query_id AS case_id, coalesce(n_selected, 0) AS n_selected, coalesce(n_hits, 0) AS n_hits, round(coalesce(n_hits, 0) / 5.0, 6)::DOUBLE AS precision, CASE WHEN n_gold <> 0 THEN round(coalesce(n_hits, 0)::DOUBLE / n_gold, 9) END AS recall, n_gold = 0 AND coalesce(n_selected, 0) = 0 AS unsupported_detected FROM c LEFT JOIN k USING (query_id)")
def m1_ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    queries, chunks = _queries(spark, d), _chunks(spark, d)
    ranked = retrieval.top_k(retrieval.best_pairs(queries.drop("scope"), chunks, 5, 0.1, others=True), 5, 0.1)
    sizes = chunks.groupBy(F.col("label").alias("q_label")).agg(F.count("*").alias("n"))
    cases = queries.join(sizes, "q_label").select(F.col("query_id").alias("case_id"), F.when(F.col("query_id") % 300 == 0, 0).otherwise(F.col("n") - 1).alias("n_gold"))
    out = retrieval.ranking_metrics(ranked.select(F.col("query_id").alias("case_id"), (F.col("label") == F.col("q_label")).alias("relevant")), cases, 5)
    return out.withColumn("recall", F.round("recall", 9))


@query("f1_scope_containment", "SELECT lang, count(*) AS n FROM documents WHERE list_has_all(['en', 'de', 'src1', 'src2', 'src3'], [lang, source]) GROUP BY lang")
def f1_scope_containment(spark: SparkSession, d: str) -> DataFrame:
    asked = F.array(*(F.lit(x) for x in ("en", "de", "src1", "src2", "src3")))
    return table(spark, d, "documents").where(sets.within(F.array("lang", "source"), asked)).groupBy("lang").agg(F.count("*").alias("n"))


@query("f2_any_key_overlap", "SELECT source, count(*) AS n FROM documents WHERE list_has_any(['fr', 'src1', 'src2'], [lang, source]) GROUP BY source")
def f2_any_key_overlap(spark: SparkSession, d: str) -> DataFrame:
    asked = F.array(*(F.lit(x) for x in ("fr", "src1", "src2")))
    return table(spark, d, "documents").where(sets.any_of(F.array("lang", "source"), asked)).groupBy("source").agg(F.count("*").alias("n"))
