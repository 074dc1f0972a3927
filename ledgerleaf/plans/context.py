"""Queries of whole retrieval and context assembly."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions.vectors import doubles
from ledgerleaf.operators import context

from .base import query, table

_HINTS = "CASE WHEN vec_id % 5 = 0 THEN NULL ELSE ['h' || (vec_id % 4)] END"
_RETRIEVE = f"""
WITH RECURSIVE c AS (SELECT vec_id, embedding::DOUBLE[] AS e, label, vec_id % 6 AS version, {_HINTS} AS hints FROM embeddings),
q AS (SELECT vec_id AS query_id, e AS q, [label, (label + 1) % 10] AS want_scope, CASE WHEN vec_id % 200 = 0 THEN ['h1', 'h2'] ELSE [] END AS want_hints, CASE WHEN vec_id % 300 = 0 THEN [0, 1, 2, 3] ELSE [] END AS want_versions FROM c WHERE vec_id % 100 = 0),
fit AS (SELECT query_id, vec_id AS chunk_id, version, list_dot_product(q, e) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(e, e))) AS sim FROM q, c
  WHERE list_contains(want_scope, label) AND (len(want_hints) = 0 OR len(list_intersect(coalesce(hints, []), want_hints)) > 0) AND (len(want_versions) = 0 OR list_contains(want_versions, version))),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS rank FROM fit WHERE sim >= 0.1) WHERE rank <= 5),
needs AS (SELECT vec_id AS src, vec_id + 6 AS dst FROM c WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, vec_id + 1 FROM c WHERE vec_id % 7 = 0 UNION ALL SELECT vec_id, vec_id - 12 FROM c WHERE vec_id % 4 = 0),
r AS (SELECT query_id, chunk_id AS root, chunk_id AS node, version FROM hits UNION SELECT r.query_id, r.root, f.chunk_id, r.version FROM r JOIN needs n ON n.src = r.node JOIN fit f ON f.query_id = r.query_id AND f.chunk_id = n.dst AND f.version = r.version),
near AS (SELECT query_id, root, string_agg(node::VARCHAR, ',' ORDER BY node) AS neighbours FROM r WHERE node <> root GROUP BY ALL)
SELECT h.query_id, CAST(h.rank AS INTEGER) AS rank, h.chunk_id, round(h.sim, 6) AS similarity, coalesce(neighbours, '') AS neighbours FROM hits h LEFT JOIN near ON near.query_id = h.query_id AND near.root = h.chunk_id
"""


@query("v7_neighbour_retrieval", _RETRIEVE)
def v7_neighbour_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Scope, hints and versions before the ranking; required chunks of the same version after it, whatever their score."""
    strings = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    longs = lambda *xs: F.array(*map(F.lit, xs)).cast("array<long>")
    hints = F.when(F.col("vec_id") % 5 != 0, F.array(F.concat(F.lit("h"), F.col("vec_id") % 4)))
    own = table(spark, d, "embeddings")
    chunks = own.select(F.col("vec_id").alias("chunk_id"), doubles(F.col("embedding")).alias("v"), F.array("label").alias("scope"), (F.col("vec_id") % 6).alias("version"), hints.alias("hints"))
    queries = own.where("vec_id % 100 = 0").select(
        F.col("vec_id").alias("query_id"),
        doubles(F.col("embedding")).alias("q"),
        F.array("label", (F.col("label") + 1) % 10).alias("want_scope"),
        F.when(F.col("vec_id") % 200 == 0, strings("h1", "h2")).otherwise(strings()).alias("want_hints"),
        F.when(F.col("vec_id") % 300 == 0, longs(0, 1, 2, 3)).otherwise(longs()).alias("want_versions"),
        longs().alias("want_chunks"),
    )
    edge = lambda when, step: own.where(when).select(F.col("vec_id").alias("src"), (F.col("vec_id") + step).alias("dst"))
    needs = edge("vec_id % 3 = 0", 6).union(edge("vec_id % 7 = 0", 1)).union(edge("vec_id % 4 = 0", -12))
    found = context.retrieve_among(queries, chunks, needs, 5, 0.1)
    return found.select("query_id", "rank", "chunk_id", F.round("similarity", 6).alias("similarity"), F.array_join("neighbours", ",").alias("neighbours"))


@query("f5_parameter_issues", "SELECT CASE WHEN l_linenumber NOT IN (3, 5, 7) THEN 'bad_k' WHEN NOT (l_discount * 20 - 0.5 BETWEEN -1 AND 1) THEN 'bad_threshold' WHEN l_quantity > 32 THEN 'too_many_filters' WHEN l_partkey % 200 > 128 THEN 'too_many_chunks' ELSE 'none' END AS issue, count(*) AS n FROM lineitem GROUP BY 1")
def f5_parameter_issues(spark: SparkSession, d: str) -> DataFrame:
    k = F.when(F.col("l_linenumber") == 7, 8).otherwise(F.when(F.col("l_linenumber") == 1, F.lit(None)).otherwise(F.col("l_linenumber")))
    issue = context.parameter_issue(k, F.col("l_discount") * 20 - 0.5, F.col("l_quantity"), F.col("l_partkey") % 200)
    return table(spark, d, "lineitem").groupBy(issue.alias("issue")).agg(F.count("*").alias("n"))


@query("f4_configuration", "WITH a AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 14 <> 0 THEN p_size END AS p_size FROM part), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'other' ELSE p_brand END AS brand, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS size FROM part WHERE p_partkey % 13 <> 0) SELECT p_partkey, k IS NOT NULL AND p_brand IS NOT DISTINCT FROM brand AND p_size IS NOT DISTINCT FROM size AS configuration_equal FROM a LEFT JOIN b ON k = p_partkey")
def f4_configuration(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    own = part.withColumn("p_size", F.when(F.col("p_partkey") % 14 != 0, F.col("p_size")))
    asked = part.where("p_partkey % 13 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size"))).withColumn("p_brand", F.when(F.col("p_partkey") % 11 == 0, "other").otherwise(F.col("p_brand")))
    return context.configured(own, asked, ["p_brand", "p_size"], "p_partkey").select("p_partkey", "configuration_equal")


@query("c3_first_spans", "WITH m AS (SELECT l_orderkey AS request, l_suppkey % 3 AS locator, l_returnflag AS text, min({'at': l_linenumber, 'id': l_partkey}) AS f FROM lineitem GROUP BY 1, 2, 3) SELECT request, locator, text, f.at AS position, f.id AS span_id FROM m")
def c3_first_spans(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), (F.col("l_suppkey") % 3).alias("locator"), F.col("l_returnflag").alias("text"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("span_id"))
    return context.first_spans(rows)


@query("c4_citations", "SELECT doc_id, coalesce(n_chars % 5 >= 1 AND length(trim(source)) > 0 AND length(trim(text)) > 0 AND doc_id % 6 <> 0, false) AS resolvable FROM documents")
def c4_citations(spark: SparkSession, d: str) -> DataFrame:
    digest = F.when(F.col("doc_id") % 6 == 0, F.upper(F.sha2("text", 256))).otherwise(F.sha2("text", 256))
    return table(spark, d, "documents").select("doc_id", context.resolvable(F.col("n_chars") % 5, F.col("source"), F.col("text"), digest).alias("resolvable"))


_SERIAL = """
WITH f AS (SELECT l_orderkey AS g, count(DISTINCT l_returnflag) = 1 AS rf, count(DISTINCT l_linestatus) = 1 AS ls, min(l_returnflag) AS rv, min(l_linestatus) AS lv FROM lineitem GROUP BY 1),
x AS (SELECT f.*, l_linenumber AS o, 'l_returnflag=' || l_returnflag || '; l_linestatus=' || l_linestatus || '; l_partkey=' || l_partkey || '; l_linenumber=' || l_linenumber AS plain, l_returnflag || '|' || l_linestatus || '|' || l_partkey || '|' || l_linenumber AS compact,
  CASE WHEN rf THEN '' ELSE 'l_returnflag=' || l_returnflag || '; ' END || CASE WHEN ls THEN '' ELSE 'l_linestatus=' || l_linestatus || '; ' END || 'l_partkey=' || l_partkey || '; l_linenumber=' || l_linenumber AS rest FROM lineitem JOIN f ON f.g = l_orderkey)
SELECT g AS l_orderkey, md5(string_agg(plain, chr(10) ORDER BY o, plain)) AS plain, md5(string_agg(compact, chr(10) ORDER BY o, plain)) AS compact,
  md5(CASE WHEN any_value(rf) OR any_value(ls) THEN concat_ws('; ', CASE WHEN any_value(rf) THEN 'l_returnflag=' || any_value(rv) END, CASE WHEN any_value(ls) THEN 'l_linestatus=' || any_value(lv) END) || chr(10) ELSE '' END || string_agg(rest, chr(10) ORDER BY o, plain)) AS common FROM x GROUP BY g
"""


@query("c6_serialised_groups", _SERIAL)
def c6_serialised_groups(spark: SparkSession, d: str) -> DataFrame:
    out = context.serialised(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber"], ["l_returnflag", "l_linestatus"], ["l_partkey", "l_linenumber"])
    return out.select("l_orderkey", *(F.md5(c).alias(c) for c in ("plain", "compact", "common")))


@query("c8_stray_dependencies", "WITH m AS (SELECT DISTINCT l_suppkey AS subject, l_partkey AS chunk_id FROM lineitem WHERE l_quantity > 10) SELECT subject, chunk_id, chunk_id + 3 AS needed FROM m WHERE (subject, chunk_id + 3) NOT IN (SELECT subject, chunk_id FROM m)")
def c8_stray_dependencies(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_suppkey").alias("subject"), F.col("l_partkey").alias("chunk_id")).distinct()
    needs = members.select(F.col("chunk_id").alias("src"), (F.col("chunk_id") + 3).alias("dst")).distinct()
    return context.stray_dependencies(members, needs)


_NARROW = """
WITH RECURSIVE c AS (SELECT o_orderkey AS request, o_custkey % 50 AS subject, o_orderkey % 7 AS claim FROM orders),
f AS (SELECT p_partkey % 50 AS subject, p_partkey % 7 AS claim, p_partkey AS chunk_id FROM part WHERE p_partkey % 7 <> 6),
j AS (SELECT c.*, chunk_id FROM c LEFT JOIN f USING (subject, claim)),
v AS (SELECT request, subject, bool_or(chunk_id IS NULL) AS vague FROM j GROUP BY ALL),
n AS (SELECT p_partkey AS src, 2 * p_partkey + 1 AS dst FROM part WHERE 2 * p_partkey + 1 IN (SELECT p_partkey FROM part)),
r AS (SELECT request, chunk_id FROM j WHERE request IN (SELECT request FROM v WHERE NOT vague) UNION SELECT r.request, n.dst FROM r JOIN n ON n.src = r.chunk_id),
a AS (SELECT * FROM r UNION SELECT request, p_partkey FROM v JOIN part ON p_partkey % 50 = subject WHERE vague)
SELECT request, count(*) AS n, CAST(sum(chunk_id) AS BIGINT) AS total FROM a GROUP BY request
"""


@query("c10_narrowed_chunks", _NARROW)
def c10_narrowed_chunks(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("subject"), (F.col("p_partkey") % 7).alias("claim"), F.col("p_partkey").alias("chunk_id"))
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") % 50).alias("subject"), (F.col("o_orderkey") % 7).alias("claim"))
    needs = part.select(F.col("chunk_id").alias("src"), (2 * F.col("chunk_id") + 1).alias("dst")).join(part.select(F.col("chunk_id").alias("dst")), "dst", "left_semi")
    own, chunks = context.narrowed_classes(claims, part.where("claim <> 6"), needs, part.select("subject", "chunk_id"))
    sums = chunks.groupBy("class_id").agg(F.count("*").alias("n"), F.sum("chunk_id").alias("total"))
    return own.join(sums, "class_id").select("request", "n", "total")


_FLAT = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


@query("c12_rendered_fields", f"SELECT conv_id, turn, list_bool_and(list_transform(CASE WHEN turn % 3 = 2 THEN [substr(text, 3, 10), 'zzqq'] ELSE [substr(text, 3, 10), '  ' || substr(text, 20, 5) || ' '] END, lambda v: contains({_FLAT.format('text')}, {_FLAT.format('v')}))) AS shown FROM conversations WHERE text IS NOT NULL")
def c12_rendered_fields(spark: SparkSession, d: str) -> DataFrame:
    cutout = lambda a, n: F.substring("text", a, n)
    values = F.when(F.col("turn") % 3 == 2, F.array(cutout(3, 10), F.lit("zzqq"))).otherwise(F.array(cutout(3, 10), F.concat(F.lit("  "), cutout(20, 5), F.lit(" "))))
    rows = table(spark, d, "conversations").where("text IS NOT NULL").withColumn("values", values)
    return context.rendered(rows).select("conv_id", "turn", "shown")


_SLOTS = """
WITH dr AS (SELECT DISTINCT l_orderkey AS request, l_linenumber AS claim FROM lineitem), ci AS (SELECT DISTINCT l_orderkey AS request, l_partkey AS e FROM lineitem),
ev AS (SELECT DISTINCT l_orderkey AS request, l_partkey AS e FROM lineitem WHERE l_quantity <= 40),
ve AS (SELECT request, claim, count(*) AS n FROM (SELECT l_orderkey AS request, l_linenumber AS claim FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT l_orderkey, l_linenumber + 1 FROM lineitem WHERE l_linestatus = 'O') GROUP BY ALL),
b AS (SELECT coalesce(dr.request, ve.request) AS request, CASE WHEN dr.request IS NULL THEN 'verdict_without_claim' WHEN coalesce(n, 0) <> 1 THEN 'not_one_verdict' END AS fault FROM dr FULL JOIN ve ON dr.request = ve.request AND dr.claim = ve.claim)
SELECT request, fault, count(*) AS n FROM b WHERE fault IS NOT NULL GROUP BY ALL UNION ALL SELECT request, 'unknown_evidence', count(*) FROM ci WHERE (request, e) NOT IN (SELECT request, e FROM ev) GROUP BY 1
"""


@query("c15_slot_faults", _SLOTS)
def c15_slot_faults(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("claim"), F.col("l_partkey").alias("evidence_id"), "l_returnflag", "l_linestatus", "l_quantity")
    verdicts = lines.where("l_returnflag <> 'R'").select("request", "claim").union(lines.where("l_linestatus = 'O'").select("request", F.col("claim") + 1))
    return context.slot_faults(lines, verdicts, lines.where("l_quantity <= 40").select("request", "evidence_id").distinct())


@query("j15_two_branches", "WITH x AS (SELECT c_custkey AS request, ['RAG', 'Symbolic', 'Hybrid'][c_custkey % 3 + 1] AS route, CASE WHEN c_custkey % 5 = 0 THEN 'unavailable' WHEN c_nationkey < 5 THEN 'insufficient' ELSE 'ok' END AS doc, CASE WHEN c_custkey % 7 = 0 THEN 'unavailable' WHEN c_nationkey > 20 THEN 'insufficient' ELSE 'ok' END AS sym FROM customer), y AS (SELECT request, route, CASE WHEN route <> 'Symbolic' THEN doc END AS documents, CASE WHEN route <> 'RAG' THEN sym END AS symbolic FROM x) SELECT *, CASE WHEN coalesce(documents, 'ok') = 'ok' AND coalesce(symbolic, 'ok') = 'ok' THEN 'ok' WHEN coalesce(documents, 'ok') = 'unavailable' OR coalesce(symbolic, 'ok') = 'unavailable' THEN 'unavailable' ELSE 'insufficient' END AS status FROM y")
def j15_two_branches(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("request"), "c_nationkey")
    route = F.element_at(F.array(*map(F.lit, ("RAG", "Symbolic", "Hybrid"))), (F.col("request") % 3 + 1).cast("int"))
    documents = c.where("request % 5 <> 0").select("request", F.when(F.col("c_nationkey") < 5, "insufficient").otherwise("ok").alias("status"))
    symbolic = c.where("request % 7 <> 0").select("request", F.when(F.col("c_nationkey") > 20, "insufficient").otherwise("ok").alias("status"))
    return context.gathered(c.select("request", route.alias("route")), documents, symbolic)


_PARTS = """
WITH RECURSIVE l AS (SELECT l_orderkey AS k, l_quantity::BIGINT AS size, l_linenumber = 1 AS header, l_returnflag = 'R' AS joined, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem),
h AS (SELECT k, sum(size)::BIGINT AS head FROM l WHERE header GROUP BY k),
w AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, size ROWS UNBOUNDED PRECEDING) AS block FROM l WHERE NOT header),
b AS (SELECT k, block, sum(size)::BIGINT AS size, count(*) AS n, row_number() OVER (PARTITION BY k ORDER BY block) AS i FROM w GROUP BY k, block),
r AS (SELECT b.k, i, 1 AS part, coalesce(head, 0) + size AS used, size, n FROM b LEFT JOIN h USING (k) WHERE i = 1
  UNION ALL SELECT b.k, b.i, CASE WHEN r.used + b.size <= 80 THEN r.part ELSE r.part + 1 END, CASE WHEN r.used + b.size <= 80 THEN r.used + b.size ELSE coalesce(head, 0) + b.size END, b.size, b.n FROM r JOIN b ON b.k = r.k AND b.i = r.i + 1 LEFT JOIN h ON h.k = b.k)
SELECT r.k, CAST(part AS BIGINT) AS part, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(any_value(head), 0) + sum(size) AS BIGINT) AS size FROM r LEFT JOIN h ON h.k = r.k GROUP BY r.k, part
"""


@query("i16_table_parts", _PARTS)
def i16_table_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("long").alias("size"), (F.col("l_linenumber") == 1).alias("header"), (F.col("l_returnflag") == "R").alias("joined"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return context.table_parts(rows, ["k"], ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "size"], 80)
