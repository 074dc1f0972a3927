"""Queries of releases, guards, ledgers, reports, sessions and published files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.operators import releases
from ledgerleaf.operators.common import new_dir
from ledgerleaf.sources import commits, sinks, tables

from .base import query, table


@query("r1_draft_faults", "WITH m AS (SELECT l_suppkey AS release, l_partkey AS id FROM lineitem), u AS (SELECT release, id, count(*) AS n FROM m GROUP BY ALL), s AS (SELECT release, count(*) AS n FROM u GROUP BY 1) SELECT release, 'named_twice' AS fault, count(*) AS n FROM u WHERE n > 1 GROUP BY 1 UNION ALL SELECT release, 'unknown_member', count(*) FROM u WHERE id % 50 = 0 GROUP BY 1 UNION ALL SELECT s_suppkey, 'other_count', coalesce(n, 0) FROM supplier LEFT JOIN s ON release = s_suppkey WHERE coalesce(n, 0) <> CASE WHEN s_suppkey % 2 = 0 THEN coalesce(n, 0) ELSE 7 END")
def r1_draft_faults(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("release"), F.col("l_partkey").alias("id"))
    sizes = members.groupBy("release").agg(F.count_distinct("id").alias("n"))
    declared = table(spark, d, "supplier").join(sizes, F.col("s_suppkey") == F.col("release"), "left").select(F.col("s_suppkey").alias("release"), F.when(F.col("s_suppkey") % 2 == 0, F.coalesce("n", F.lit(0))).otherwise(7).alias("n_declared"))
    known = members.where("id % 50 <> 0").select("id").distinct()
    return releases.membership_faults(members, known, declared)


@query("r3_pointer_moves", "WITH e AS (SELECT event_id % 40 AS space, event_id AS seq, user_id AS release, CASE WHEN event_id % 4 = 0 THEN 'rollback' ELSE 'activate' END AS action, user_id % 3 <> 0 AS ok FROM events), f AS (SELECT *, min(CASE WHEN action = 'activate' AND ok THEN seq END) OVER (PARTITION BY space, release) AS first FROM e), a AS (SELECT *, (action = 'activate' AND ok) OR (action = 'rollback' AND coalesce(first < seq, false)) AS applied FROM f), x AS (SELECT *, last_value(CASE WHEN applied THEN release END IGNORE NULLS) OVER (PARTITION BY space ORDER BY seq ROWS UNBOUNDED PRECEDING) AS active FROM a), y AS (SELECT *, lag(active) OVER (PARTITION BY space ORDER BY seq) AS prev FROM x) SELECT space, seq, release, action, applied, active, CASE WHEN applied AND prev <> release THEN prev END AS superseded FROM y")
def r3_pointer_moves(spark: SparkSession, d: str) -> DataFrame:
    """Activation and rollback (R3, R4)."""
    events = table(spark, d, "events").select((F.col("event_id") % 40).alias("space"), F.col("event_id").alias("seq"), F.col("user_id").alias("release"), F.when(F.col("event_id") % 4 == 0, "rollback").otherwise("activate").alias("action"))
    return releases.pointer_moves(events, events.where("release % 3 <> 0").select("release"))


_WRITES = """
WITH n AS (SELECT count(*) FILTER (WHERE p_size <= 25) AS a, count(*) FILTER (WHERE p_size > 25) AS b FROM part), s AS (SELECT count(*) AS s FROM supplier)
SELECT CAST(version AS BIGINT) AS version, action, release, active, superseded, CASE WHEN action = 'draft' THEN CASE release WHEN 'r1' THEN a ELSE b END END AS n_parts, CASE WHEN action = 'draft' THEN s END AS n_suppliers
FROM n, s, (VALUES (0, 'draft', 'r1', NULL, NULL), (1, 'activate', 'r1', 'r1', NULL), (2, 'draft', 'r2', 'r1', NULL), (3, 'activate', 'r2', 'r2', 'r1'), (4, 'rollback', 'r1', 'r1', 'r2')) v(version, action, release, active, superseded)
UNION ALL SELECT 5, 'read', 'r1', NULL, NULL, a, s FROM n, s
"""


@query("r1_release_writes", _WRITES)
def r1_release_writes(spark: SparkSession, d: str) -> DataFrame:
    """Two releases created with their members, activated, and one rolled back; the log replayed, and what a reader then gets."""
    folder = new_dir(spark, "releases")
    part, supplier = table(spark, d, "part"), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    none = supplier.where("id IS NULL")
    for name, own in (("r1", "p_size <= 25"), ("r2", "p_size > 25")):
        commits.create_release(spark, folder, name, {"parts": part.where(own).select(F.col("p_partkey").alias("id")), "suppliers": supplier}, ["parts"])
        commits.activate(spark, folder, name, none)
    commits.rollback(spark, folder, "r1", none)
    n = lambda k: F.col("members")[k]
    log = commits.history(spark, folder).select("version", "action", "release", "active", "superseded", n("parts").alias("n_parts"), n("suppliers").alias("n_suppliers"))
    blank = F.lit(None).cast("string")
    counts = commits.active_part(spark, folder, "parts").agg(F.count("*").alias("p")).crossJoin(commits.active_part(spark, folder, "suppliers").agg(F.count("*").alias("s")))  # one row each
    return log.unionByName(counts.select(F.lit(5).cast("long").alias("version"), F.lit("read").alias("action"), F.lit("r1").alias("release"), blank.alias("active"), blank.alias("superseded"), F.col("p").alias("n_parts"), F.col("s").alias("n_suppliers")))


@query("r6_designations", "SELECT CASE WHEN o_orderstatus <> 'O' THEN 'not_a_draft' WHEN o_orderkey % 5 = 0 THEN 'already_research' WHEN o_totalprice < 50000 THEN 'review_missing' WHEN o_custkey % 7 = 0 THEN 'authorisation_missing' ELSE 'designated' END AS state, count(*) AS n FROM orders GROUP BY 1")
def r6_designations(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "draft").otherwise("published")
    kind = F.when(F.col("o_orderkey") % 5 == 0, "research").otherwise("ordinary")
    state = releases.designation(status, kind, F.col("o_totalprice") >= 50_000, F.col("o_custkey") % 7 != 0)
    return table(spark, d, "orders").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


_SPANS = """
WITH s AS (SELECT l_orderkey AS id, (l_linenumber - 1) * 10 AS start, l_linenumber * 10 - CASE WHEN l_partkey % 9 = 0 THEN 1 WHEN l_partkey % 11 = 0 THEN -2 WHEN l_partkey % 61 = 0 THEN 10 ELSE 0 END AS stop FROM lineitem WHERE l_suppkey % 10 <> 3 OR l_linenumber <> 1),
w AS (SELECT *, start - lag(stop) OVER (PARTITION BY id ORDER BY start, stop) AS step FROM s),
f AS (SELECT id, min(start) AS low, max(stop) AS high, bool_or(stop <= start) AS e, coalesce(bool_or(step > 0), false) AS g, coalesce(bool_or(step < 0), false) AS o FROM w GROUP BY id), n AS (SELECT o_orderkey AS id, count(l_linenumber) * 10 AS size FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT n.id, CASE WHEN low IS NULL THEN 'none' WHEN e THEN 'empty_span' WHEN low <> 0 THEN 'late_start' WHEN g THEN 'gap' WHEN o THEN 'overlap' WHEN high <> size THEN 'wrong_end' ELSE 'covered' END AS coverage FROM n LEFT JOIN f ON f.id = n.id
"""


@query("r8_span_coverage", _SPANS)
def r8_span_coverage(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    odd = F.when(F.col("l_partkey") % 9 == 0, 1).when(F.col("l_partkey") % 11 == 0, -2).when(F.col("l_partkey") % 61 == 0, 10).otherwise(0)
    spans = lines.where("l_suppkey % 10 <> 3 OR l_linenumber <> 1").select(F.col("l_orderkey").alias("id"), ((F.col("l_linenumber") - 1) * 10).alias("start"), (F.col("l_linenumber") * 10 - odd).alias("stop"))
    sizes = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(F.col("o_orderkey").alias("id")).agg((F.count("l_linenumber") * 10).alias("size"))
    return releases.span_coverage(spans, sizes)


@query("g5_root_guards", "WITH a AS (SELECT o_custkey AS subject_id, o_orderkey % 300 AS owner_id, min(o_orderkey % 3) AS curriculum FROM orders GROUP BY 1, 2), c AS (SELECT p_partkey AS owner_id, p_partkey % 3 AS own, p_partkey % 8 <> 0 AS reviewed FROM part), j AS (SELECT a.*, own, reviewed, CASE WHEN own IS NULL THEN 'unknown_course' WHEN own <> curriculum THEN 'wrong_curriculum' WHEN NOT reviewed THEN 'identity_unreviewed' END AS reason FROM a LEFT JOIN c ON c.owner_id = a.owner_id) SELECT subject_id, owner_id, CASE WHEN reason IS NOT NULL THEN 'unknown' WHEN (subject_id + owner_id) % 2 = 0 THEN 'eligible' ELSE 'unknown' END AS outcome, CASE WHEN reason = 'identity_unreviewed' THEN 'partial' WHEN reason IS NOT NULL THEN 'absent' WHEN (subject_id + owner_id) % 2 = 0 THEN 'complete' ELSE 'absent' END AS coverage, reason FROM j")
def g5_root_guards(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("subject_id"), (F.col("o_orderkey") % 300).alias("owner_id")).agg(F.min(F.col("o_orderkey") % 3).alias("curriculum"))
    courses = table(spark, d, "part").select(F.col("p_partkey").alias("owner_id"), (F.col("p_partkey") % 3).alias("curriculum"), (F.col("p_partkey") % 8 != 0).alias("reviewed"))
    results = asked.where("(subject_id + owner_id) % 2 = 0").select("subject_id", "owner_id", F.lit("eligible").alias("outcome"), F.lit("complete").alias("coverage"))
    return releases.guarded(asked, courses, results)


@query("g11_term_listing", "WITH c AS (SELECT p_brand || p_type AS curriculum, CASE WHEN p_partkey % 53 <> 0 THEN p_size % 4 END AS year, p_size % 3 AS term, p_partkey % 41 <> 0 AS reviewed, CASE WHEN p_partkey % 6 <> 0 THEN p_size % 5 END AS units FROM part), w AS (SELECT curriculum FROM c GROUP BY 1 HAVING bool_and(reviewed AND year IS NOT NULL)) SELECT curriculum, year, term, count(*) AS n, CASE WHEN count(units) = count(*) THEN CAST(sum(units) AS BIGINT) END AS units FROM c WHERE curriculum IN (SELECT curriculum FROM w) GROUP BY 1, 2, 3")
def g11_term_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.concat("p_brand", "p_type").alias("curriculum"), F.when(F.col("p_partkey") % 53 != 0, F.col("p_size") % 4).alias("year"), (F.col("p_size") % 3).alias("term"), (F.col("p_partkey") % 41 != 0).alias("reviewed"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_size") % 5).alias("units"))
    return releases.term_listing(rows)


@query("g13_ledger_faults", "WITH c AS (SELECT p_partkey AS course_id, p_brand, p_name, p_size FROM part) SELECT course_id, 'identity_twice' AS fault FROM c WHERE (p_brand, p_name) IN (SELECT p_brand, p_name FROM c GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT course_id, CASE WHEN course_id % 9 = 0 THEN 'not_reviewed' ELSE 'review_of_other_content' END FROM c WHERE course_id % 9 = 0 OR course_id % 7 = 0")
def g13_ledger_faults(spark: SparkSession, d: str) -> DataFrame:
    content = F.concat_ws("|", "p_name", "p_brand", "p_size")
    courses = table(spark, d, "part").select(F.col("p_partkey").alias("course_id"), "p_brand", "p_name", content.alias("content"))
    seen = F.when(F.col("course_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    reviews = courses.where("course_id % 9 <> 0").select("course_id", F.sha2(seen, 256).alias("digest"))
    return releases.ledger_faults(courses, reviews, ["p_brand", "p_name"])


@query("g15_exported_rules", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'verified_none' WHEN p_partkey % 4 = 1 THEN 'unresolved' WHEN p_partkey % 4 = 2 THEN 'all_of' ELSE 'unresolved' END AS rule, p_partkey % 4 = 1 AS course_free FROM part")
def g15_exported_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    reason = F.when(k == 0, "reviewed_empty").when(k == 1, F.concat(F.lit("standing:"), F.col("p_size")))
    out = releases.exported_rule(F.when(k == 2, "all_of"), reason)
    return table(spark, d, "part").select("p_partkey", *(c.alias(n) for n, c in out.items()))


@query("g17_result_states", "SELECT CASE WHEN n > 5 OR strlen(body) > 60 THEN 'too_large' WHEN l = 0 THEN 'no_rule' WHEN r THEN 'unresolved' ELSE 'resolved' END AS state, count(*) AS n FROM (SELECT l_orderkey, count(*) AS n, string_agg(l_partkey::VARCHAR || ':' || l_returnflag, ',') AS body, max(l_linenumber) % 3 AS l, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) GROUP BY 1")
def g17_result_states(spark: SparkSession, d: str) -> DataFrame:
    """Bounds on a result's conditions and bytes (G17), and the state its rule is in (G19)."""
    entry = F.concat_ws(":", "l_partkey", "l_returnflag")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("body"), (F.max("l_linenumber") % 3).alias("l"), F.collect_set(F.when(F.col("l_returnflag") == "R", "rule_unresolved")).alias("unknown"))
    state = releases.result_state(F.col("n"), F.col("body"), F.col("unknown"), F.when(F.col("l") == 0, "absent").otherwise("complete"), 5, 60)
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("m5_pooled_report", 'WITH p AS (SELECT l_orderkey AS "case", l_suppkey AS chunk, bool_or(l_returnflag <> \'R\') AS yes, bool_and(l_returnflag <> \'R\') AS every FROM lineitem GROUP BY 1, 2), s AS (SELECT "case", count(*) FILTER (WHERE yes) AS n_relevant, count(*) FILTER (WHERE yes AND NOT every) AS n_disputed FROM p GROUP BY 1), f AS (SELECT DISTINCT l_orderkey AS "case", l_linestatus AS run, l_suppkey + l_partkey % 2 AS chunk FROM lineitem), h AS (SELECT f."case", run, count(*) AS n_found, count(*) FILTER (WHERE yes) AS n_hits FROM f LEFT JOIN p ON p."case" = f."case" AND p.chunk = f.chunk GROUP BY 1, 2) SELECT h.*, n_relevant, n_disputed, n_hits::DOUBLE / n_found AS precision, CASE WHEN n_relevant > 0 THEN n_hits::DOUBLE / n_relevant END AS recall FROM h JOIN s ON s."case" = h."case"')
def m5_pooled_report(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    runs = lines.select(F.col("l_orderkey").alias("case"), F.col("l_linestatus").alias("run"), (F.col("l_suppkey") + F.col("l_partkey") % 2).alias("chunk"))
    return releases.pooled_report(runs, lines.select(F.col("l_orderkey").alias("case"), F.col("l_suppkey").alias("chunk"), (F.col("l_returnflag") != "R").alias("relevant")))


@query("m9_near_leakage", "WITH b AS (SELECT item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS t FROM benchmark WHERE text IS NOT NULL), a AS (SELECT doc_id AS item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS t FROM documents WHERE doc_id % 20 = 0 UNION ALL SELECT item_id + 10000000, t FROM b), d AS (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))) AS t FROM documents), x AS (SELECT item_id, doc_id, len(list_intersect(a.t, d.t)) AS n, len(a.t) + len(d.t) AS m FROM a, d WHERE len(a.t) > 0 AND least(len(a.t), len(d.t)) >= 0.8 * greatest(len(a.t), len(d.t)) - 1e-9) SELECT item_id, doc_id, round(n / (m - n), 9) AS similarity FROM x WHERE n / (m - n) >= 0.8 - 1e-12")
def m9_near_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items, and a stated set of documents as further ones, against all documents: Jaccard of 0.8 or more."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("tokens")
    texts = table(spark, d, "documents").select("doc_id", words)
    items = table(spark, d, "benchmark").where("text IS NOT NULL").select((F.col("item_id") + 10_000_000).alias("item_id"), words).union(texts.where("doc_id % 20 = 0"))
    return releases.near_leaks(items, texts, 0.8).select("item_id", "doc_id", F.round("similarity", 9).alias("similarity"))


@query("m17_unbound_traces", "WITH t AS (SELECT o_orderkey AS id, o_custkey AS release, CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE o_orderstatus END AS digest FROM orders WHERE o_orderkey % 13 <> 0), r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey END AS release, o_orderstatus AS digest FROM orders WHERE o_orderkey % 19 <> 0), b AS (SELECT coalesce(t.id, r.id) AS id, CASE WHEN r.id IS NULL THEN 'trace_without_run' WHEN t.id IS NULL THEN 'run_without_trace' WHEN t.digest IS DISTINCT FROM r.digest THEN 'other_digest' WHEN t.release IS DISTINCT FROM r.release THEN 'other_release' END AS fault FROM t FULL JOIN r ON t.id = r.id) SELECT * FROM b WHERE fault IS NOT NULL")
def m17_unbound_traces(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("release"), F.col("o_orderstatus").alias("digest"))
    traces = rows.where("id % 13 <> 0").withColumn("digest", F.when(F.col("id") % 10 == 0, "x").otherwise(F.col("digest")))
    runs = rows.where("id % 19 <> 0").withColumn("release", F.when(F.col("id") % 17 != 0, F.col("release")))
    return releases.unbound(traces, runs, "id", ["release", "digest"])


@query("t5_effective_facts", "WITH s AS (SELECT o_custkey AS subject, o_orderkey % 9 AS course, o_orderstatus AS state, o_orderdate < TIMESTAMP '1997-01-01' AS k FROM orders), a AS (SELECT DISTINCT c_custkey AS subject, c_nationkey % 9 AS course, 'H' AS state FROM customer WHERE c_custkey % 3 = 0), e AS (SELECT subject, course, state FROM s WHERE k AND (subject, course) NOT IN (SELECT subject, course FROM a) UNION ALL SELECT * FROM a) SELECT subject, course, string_agg(DISTINCT state, ',' ORDER BY state) AS states, count(DISTINCT state) > 1 AS conflict FROM e GROUP BY 1, 2")
def t5_effective_facts(spark: SparkSession, d: str) -> DataFrame:
    stated = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), (F.col("o_orderkey") % 9).alias("course"), F.col("o_orderstatus").alias("state"), "o_orderdate")
    assumed = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("subject"), (F.col("c_nationkey") % 9).cast("long").alias("course"), F.lit("H").alias("state"))
    found = releases.effective_facts(stated, assumed, F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return found.select("subject", "course", F.array_join("states", ",").alias("states"), "conflict")


_UPLOADS = "WITH e AS (SELECT user_id AS session, event_id % 60 AS upload, event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'delete' WHEN 1 THEN 'confirm' WHEN 2 THEN 'confirm' ELSE 'add' END AS action FROM events), s AS (SELECT session, upload, bool_or(action = 'delete') AS gone, min(seq) FILTER (WHERE action = 'add') AS added, max(seq) FILTER (WHERE action = 'confirm') AS ok FROM e GROUP BY 1, 2), f AS (SELECT user_id AS session, event_id % 60 AS upload, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1, 2), k AS (SELECT s.*, CASE WHEN gone THEN 'deleted' WHEN added IS NULL THEN 'unknown' WHEN ok > added THEN 'confirmed' ELSE 'pending' END AS state FROM s) SELECT k.session, k.upload, state, CASE WHEN state = 'confirmed' THEN coalesce(n, 0) ELSE 0 END AS n_facts FROM k LEFT JOIN f ON f.session = k.session AND f.upload = k.upload"


@query("t7_upload_replay", _UPLOADS)
def t7_upload_replay(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 7
    events = table(spark, d, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 60).alias("upload"), F.col("event_id").alias("seq"), F.when(k == 0, "delete").when(k.isin(1, 2), "confirm").otherwise("add").alias("action"))
    facts = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("session"), (F.col("event_id") % 60).alias("upload"))
    return releases.upload_replay(events, facts)


@query("t9_evictions", "WITH s AS (SELECT c_nationkey AS shard, c_custkey AS session, c_custkey % 3 = 0 AS empty, c_acctbal AS last_access FROM customer), r AS (SELECT *, count(*) OVER (PARTITION BY shard) - 4 AS over_by, row_number() OVER (PARTITION BY shard ORDER BY empty DESC, last_access, session) AS place FROM s) SELECT shard, session FROM r WHERE empty AND place <= over_by")
def t9_evictions(spark: SparkSession, d: str) -> DataFrame:
    sessions = table(spark, d, "customer").select(F.col("c_nationkey").alias("shard"), F.col("c_custkey").alias("session"), (F.col("c_custkey") % 3 == 0).alias("empty"), F.col("c_acctbal").alias("last_access"))
    return releases.evictions(sessions, "shard", 4)


@query("v12_stale_embeddings", "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 11 = 0 THEN 'no_chunk' WHEN doc_id % 7 = 0 THEN 'no_embedding' ELSE 'stale' END AS fault FROM documents WHERE text IS NOT NULL AND ((doc_id % 11 = 0) <> (doc_id % 7 = 0) OR (doc_id % 5 = 0 AND doc_id % 11 <> 0 AND doc_id % 7 <> 0))")
def v12_stale_embeddings(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("content_hash"))
    embedded = chunks.where("chunk_id % 7 <> 0").withColumn("content_hash", F.when(F.col("chunk_id") % 5 == 0, "old").otherwise(F.col("content_hash")))
    return releases.stale(embedded, chunks.where("chunk_id % 11 <> 0"))


@query("v11_hashed_vectors", "WITH c AS (SELECT p_partkey, i, ('0x' || substr(sha256(p_name || ':' || i), 1, 8))::BIGINT / 2147483648.0 - 1.0 AS x FROM part, (SELECT unnest(range(16)) AS i)), n AS (SELECT p_partkey, sqrt(sum(x * x)) AS norm, max(x) AS high, min(x) AS low FROM c GROUP BY 1) SELECT p_partkey, round(high / norm, 9) AS high, round(low / norm, 9) AS low FROM n")
def v11_hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", releases.hashed_vector(F.col("p_name"), 16).alias("v"))
    return rows.select("p_partkey", F.round(F.array_max("v"), 9).alias("high"), F.round(F.array_min("v"), 9).alias("low"))


_REPAIRS = "WITH c AS (SELECT p_partkey % 30 AS doc, p_partkey AS cell, p_name || ' ' || p_brand AS text FROM part), r AS (SELECT p_partkey AS repair, p_partkey % 30 AS doc, CASE WHEN p_partkey % 4 = 0 THEN 'zz' ELSE upper(p_brand) END AS value, CASE WHEN p_partkey % 9 = 0 THEN [] WHEN p_partkey % 5 = 0 THEN [p_partkey, -1] ELSE [p_partkey, p_partkey + 30] END AS cells FROM part WHERE p_partkey < (SELECT max(p_partkey) - 40 FROM part)), x AS (SELECT repair, doc, unnest(cells) AS cell FROM r), t AS (SELECT repair, string_agg(text, ' ' ORDER BY text) AS texts, count(*) FILTER (WHERE text IS NULL) AS lost FROM x LEFT JOIN c ON c.doc = x.doc AND c.cell = x.cell GROUP BY 1), f AS (SELECT r.repair, CASE WHEN t.repair IS NULL THEN 'no_cells' WHEN lost > 0 THEN 'unknown_cell' WHEN NOT contains(lower(texts), lower(value)) THEN 'not_in_cells' END AS fault FROM r LEFT JOIN t ON t.repair = r.repair) SELECT * FROM f WHERE fault IS NOT NULL"


@query("i10_repair_faults", _REPAIRS)
def i10_repair_faults(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    k = F.col("p_partkey")
    cells = part.select((k % 30).alias("doc"), k.alias("cell"), F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    last = part.agg((F.max("p_partkey") - 40).alias("last"))
    cited = F.when(k % 9 == 0, F.array().cast("array<bigint>")).when(k % 5 == 0, F.array(k, F.lit(-1).cast("long"))).otherwise(F.array(k, k + 30))
    repairs = part.join(F.broadcast(last), k < F.col("last")).select(k.alias("repair"), (k % 30).alias("doc"), F.when(k % 4 == 0, "zz").otherwise(F.upper("p_brand")).alias("value"), cited.alias("cells"))
    return releases.repair_faults(repairs, cells)


@query("i20_course_checks", "SELECT p_partkey AS course_id, CASE p_partkey % 4 WHEN 0 THEN 'printed' WHEN 1 THEN 'squeezed' WHEN 2 THEN 'title' ELSE 'missing' END AS method FROM part")
def i20_course_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("see PX-"), k, F.lit(" here"))).when(k % 4 == 1, F.concat(F.lit("see p x "), k)).when(k % 4 == 2, F.concat(F.lit("on "), F.upper("p_name"))).otherwise("nothing")
    part = table(spark, d, "part").select(k.alias("course_id"), k.alias("doc"), F.concat(F.lit("PX-"), k).alias("code"), F.col("p_name").alias("title"), text.alias("text"))
    return releases.course_checks(part.drop("text"), part.select("doc", "text"))


_SEMANTIC = """
WITH c AS (SELECT p_partkey AS course_id, p_brand AS curriculum, p_size % 6 AS term, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS pool, 'PX ' || p_partkey AS code, CASE WHEN p_partkey % 19 = 0 THEN repeat(p_name || ' ', 20) ELSE p_name END AS title, CASE WHEN p_partkey % 4 <> 0 THEN p_size % 5 END AS units FROM part),
l AS (SELECT *, code || ' ' || title || ' (' || coalesce(units::VARCHAR, '?') || ' units)' AS line FROM c),
p AS (SELECT 'course' AS kind, course_id::VARCHAR AS key, line AS text FROM l UNION ALL SELECT 'term', curriculum || '/' || term, string_agg(line, chr(10) ORDER BY code, course_id) FROM l GROUP BY curriculum, term UNION ALL SELECT 'pool', curriculum || '/' || pool, string_agg(line, chr(10) ORDER BY code, course_id) FROM l WHERE pool IS NOT NULL GROUP BY curriculum, pool),
s AS (SELECT *, CAST(greatest(ceil(length(text) / 3), ceil(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 1.8::DOUBLE)) AS BIGINT) AS tokens FROM p)
SELECT kind, key, md5(text) AS digest, tokens, tokens <= 150 AS fits FROM s
"""


@query("i14_semantic_chunks", _SEMANTIC)
def i14_semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    courses = table(spark, d, "part").select(k.alias("course_id"), F.col("p_brand").alias("curriculum"), (F.col("p_size") % 6).alias("term"), F.when(k % 3 == 0, F.col("p_type")).alias("pool"), F.concat(F.lit("PX "), k).alias("code"), F.when(k % 19 == 0, F.repeat(F.concat("p_name", F.lit(" ")), 20)).otherwise(F.col("p_name")).alias("title"), F.when(k % 4 != 0, F.col("p_size") % 5).alias("units"))
    out = releases.semantic_chunks(courses, 150)
    rows = out["chunks"].withColumn("fits", F.lit(True)).union(out["rejects"].withColumn("fits", F.lit(False)))
    return rows.select("kind", "key", F.md5("text").alias("digest"), "tokens", "fits")


@query("i7_section_health", "WITH s AS (SELECT l_orderkey AS doc, l_linestatus AS section, CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS code, CASE WHEN l_partkey % 15 <> 0 THEN l_quantity END AS units FROM lineitem) SELECT doc, section, CASE WHEN count(code) = 0 THEN 'fail' WHEN count(code) > count(DISTINCT code) OR count(units) < count(*) THEN 'warn' ELSE 'ok' END AS health FROM s GROUP BY 1, 2")
def i7_section_health(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linestatus").alias("section"), F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("code"), F.when(F.col("l_partkey") % 15 != 0, F.col("l_quantity")).alias("units"), F.col("l_linenumber").alias("term"))
    return releases.section_health(rows)


@query("s5_record_lines", "SELECT event_id, user_id, event_type, value FROM events")
def s5_record_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON lines, with blank ones between, and read back."""
    path = new_dir(spark, "records")
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    rows.select(F.explode(F.array(F.to_json(F.struct("*")), F.lit(""))).alias("line")).write.text(path)
    return tables.read_records(spark, path, rows.schema)


@query("s4_json_documents", "SELECT r_regionkey, r_name, n FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) ON n_regionkey = r_regionkey")
def s4_json_documents(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document for each region, in folders, read back whole."""
    path = new_dir(spark, "documents")
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.count("*").alias("n"))
    rows.withColumn("folder", F.col("r_regionkey")).repartition("folder").write.partitionBy("folder").json(path)
    return tables.read_json_documents(spark, path, rows.schema).select("r_regionkey", "r_name", "n")


@query("s7_checked_swap", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0")
def s7_checked_swap(spark: SparkSession, d: str) -> DataFrame:
    """Two loads into one table: the second replaces the first at once."""
    folder = new_dir(spark, "versions")
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    bad = rows.where("c_name IS NULL")
    tables.swap_checked(folder, rows, bad)
    tables.swap_checked(folder, rows.where("c_custkey % 3 = 0"), bad)
    return tables.current_version(spark, folder)


@query("s13_review_csv", "SELECT p_partkey, '\"' || p_name || '\", ' || p_brand AS name, p_type || '; ' || p_size AS tags FROM part")
def s13_review_csv(spark: SparkSession, d: str) -> DataFrame:
    path = new_dir(spark, "review")
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit('"'), "p_name", F.lit('", '), "p_brand").alias("name"), F.array("p_type", F.col("p_size").cast("string")).alias("tags"))
    sinks.write_review_csv(rows, ["p_partkey", "name", "tags"], path)
    return spark.read.option("header", "true").option("escape", '"').schema("p_partkey long, name string, tags string").csv(path)


@query("s15_published_parts", "SELECT 'nation' AS part, count(*) AS n_rows, 0::BIGINT AS n_faults FROM nation UNION ALL SELECT 'supplier', count(*), 0 FROM supplier")
def s15_published_parts(spark: SparkSession, d: str) -> DataFrame:
    """Two tables published with a manifest, and checked against it."""
    folder = new_dir(spark, "published")
    parts = {n: table(spark, d, n) for n in ("nation", "supplier")}
    sinks.publish(parts, folder)
    faults = sinks.altered(spark, folder, list(parts)).groupBy("part").agg(F.count("*").alias("f"))
    sizes = [spark.read.parquet(f"{folder}/{n}").agg(F.lit(n).alias("part"), F.count("*").alias("n_rows")) for n in parts]
    return sizes[0].union(sizes[1]).join(faults, "part", "left").select("part", "n_rows", F.coalesce("f", F.lit(0)).alias("n_faults"))


@query("f7_projection", "SELECT c_custkey, c_name, CAST(NULL AS DOUBLE) AS score, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def f7_projection(spark: SparkSession, d: str) -> DataFrame:
    return tables.projected(table(spark, d, "customer"), {"c_custkey": "long", "c_name": "string"}, {"score": "double", "c_nationkey": "long"})
