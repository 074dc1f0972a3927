"""Queries of ledgers, releases, folds, plans, sessions and streams."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import text, vectors
from ledgerleaf.operators import folds, governance, planning, retrieval
from ledgerleaf.operators.common import cut
from ledgerleaf.streaming import state

from . import rules as rule_plans
from .base import query, table


@query("f11_visibility", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0) AND lang IN ('en', 'de')")
def f11_visibility(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "labels").where("toxic = 0")
    return governance.visible(table(spark, d, "documents"), members, "doc_id", F.col("lang").isin("en", "de")).select("doc_id", "source")


@query("r2_release_violations", "SELECT 'length_mismatch' AS check, doc_id::VARCHAR AS subject FROM documents WHERE length(text) <> n_chars UNION ALL SELECT 'blank_text', doc_id::VARCHAR FROM documents WHERE trim(text) = '' UNION ALL SELECT 'unlabelled_source', source FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source HAVING count(quality) < count(*) * 0.4 UNION ALL SELECT 'duplicate_content', sha256(text) FROM documents GROUP BY text HAVING count(*) > 1")
def r2_release_violations(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    labelled = docs.join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count("quality").alias("k"), F.count("*").alias("n"))
    checks = {
        "length_mismatch": docs.where("length(text) <> n_chars").select(F.col("doc_id").alias("s")),
        "blank_text": docs.where("trim(text) = ''").select(F.col("doc_id").alias("s")),
        "unlabelled_source": labelled.where("k < n * 0.4").select(F.col("source").alias("s")),
        "duplicate_content": docs.groupBy(F.sha2("text", 256).alias("s")).count().where("count > 1").select("s"),
    }
    return governance.violations(checks, "s")


@query("r7_transitions", "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 13 = 0 THEN 'conflict_missing' WHEN o_orderstatus = 'F' THEN 'replayed' WHEN o_orderkey % 3 = 0 THEN 'conflict_changed' WHEN o_orderstatus = 'P' THEN 'conflict_illegal' ELSE 'applied' END AS result FROM orders")
def r7_transitions(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    asked = orders.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("expected"), F.lit("F").alias("proposed"))
    current = orders.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("state"))
    return governance.transitions(asked, current, spark.createDataFrame([("O", "F")], "from_state string, to_state string"))


@query("r9_evidence_state", "WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), r AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, 'new' AS s FROM e UNION ALL SELECT r.user_id, e.rn, CASE WHEN s = 'new' AND event_type = 'view' THEN 'seen' WHEN s = 'seen' AND event_type = 'click' THEN 'tried' WHEN s = 'tried' AND event_type = 'purchase' THEN 'bought' ELSE s END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) SELECT user_id AS key, max_by(s, rn) AS state FROM r GROUP BY user_id")
def r9_evidence_state(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    return governance.evidence_state(events, {"new:view": "seen", "seen:click": "tried", "tried:purchase": "bought"}, "new")


@query("g10_supersession", "WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS category, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 2 END AS supersedes, CASE WHEN o_orderkey * 2 % 3 = 0 THEN o_orderkey * 2 END AS superseded_by FROM orders), j AS (SELECT r.*, o.id AS o_id, o.category AS o_category, o.superseded_by AS o_by, count(*) OVER (PARTITION BY r.supersedes) AS n FROM r LEFT JOIN r o ON r.supersedes = o.id WHERE r.supersedes IS NOT NULL) SELECT 'unknown_target' AS code, id::VARCHAR AS subject FROM j WHERE o_id IS NULL UNION ALL SELECT 'not_mutual', id::VARCHAR FROM j WHERE o_id IS NOT NULL AND o_by IS DISTINCT FROM id UNION ALL SELECT 'other_category', id::VARCHAR FROM j WHERE o_category <> category UNION ALL SELECT 'several_successors', id::VARCHAR FROM j WHERE n > 1")
def g10_supersession(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("category"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey div 2 END").alias("supersedes"), F.expr("CASE WHEN o_orderkey * 2 % 3 = 0 THEN o_orderkey * 2 END").alias("superseded_by"))
    return governance.supersession_faults(rows)


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    field = F.when(F.col("event_type") == "view", "row").when(F.col("event_type") == "click", "code").when(F.col("event_type") == "purchase", "title").otherwise("units")
    return table(spark, d, "events").select(F.col("user_id").alias("locator"), field.alias("field"), F.col("event_id").alias("seq"), F.round("value", 3).cast("string").alias("new_value"))


@query("i11_ledger_latest", "WITH e AS (SELECT user_id AS locator, CASE event_type WHEN 'view' THEN 'row' WHEN 'click' THEN 'code' WHEN 'purchase' THEN 'title' ELSE 'units' END AS field, event_id AS seq FROM events), f AS (SELECT locator, seq, unnest(CASE WHEN field = 'row' THEN ['code', 'title', 'units'] ELSE [field] END) AS field FROM e) SELECT locator, field, max(seq) AS seq FROM f GROUP BY ALL")
def i11_ledger_latest(spark: SparkSession, d: str) -> DataFrame:
    return governance.latest_by_field(_ledger(spark, d)).select("locator", "field", "seq")


@query("i11_ledger_classes", "WITH e AS (SELECT event_id, user_id AS locator, event_type AS field, CASE WHEN event_id % 4 = 0 THEN 'old' ELSE 'now' END AS old_value, CASE WHEN event_id % 9 = 0 THEN 'other' ELSE 'doc' END AS document FROM events) SELECT CASE WHEN document = 'other' THEN 'other_document' WHEN locator % 5 = 0 OR field = 'view' THEN 'orphan' WHEN old_value <> 'now' THEN 'stale' ELSE 'applied' END AS class, count(*) AS n FROM e GROUP BY 1")
def i11_ledger_classes(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    entries = events.select(F.col("user_id").alias("locator"), F.col("event_type").alias("field"), F.when(F.col("event_id") % 4 == 0, "old").otherwise("now").alias("old_value"), F.when(F.col("event_id") % 9 == 0, "other").otherwise("doc").alias("document"))
    current = events.where("user_id % 5 <> 0 AND event_type <> 'view'").select(F.col("user_id").alias("locator"), F.col("event_type").alias("field"), F.lit("now").alias("value"), F.lit("doc").alias("document")).distinct()
    return governance.classify_entries(entries, current).groupBy("class").agg(F.count("*").alias("n"))


@query("i6_audit", "SELECT 'no_lines' AS check, 'error' AS severity, o_orderkey::VARCHAR AS subject FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'total_differs', 'error', o_orderkey::VARCHAR FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE q > 250 UNION ALL SELECT 'duplicate_part', 'warning', l_orderkey::VARCHAR FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1) GROUP BY l_orderkey")
def i6_audit(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    checks = {
        "no_lines": orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.col("o_orderkey").alias("s")),
        "total_differs": lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q")).where("q > 250").join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(F.col("l_orderkey").alias("s")),
        "duplicate_part": lines.groupBy("l_orderkey", "l_partkey").count().where("count > 1").select(F.col("l_orderkey").alias("s")).distinct(),
    }
    severity = F.when(F.col("check") == "duplicate_part", "warning").otherwise("error")
    return governance.violations(checks, "s").select("check", severity.alias("severity"), "subject")


@query("i12_review_state", "WITH s AS (SELECT source, count(*) AS n, count(quality) AS k FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source) SELECT source, CASE WHEN k = 0 THEN 'pending' WHEN k < n THEN 'partial' ELSE 'reviewed' END AS state FROM s")
def i12_review_state(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("k"))
    return sums.select("source", F.when(F.col("k") == 0, "pending").when(F.col("k") < F.col("n"), "partial").otherwise("reviewed").alias("state"))


@query("i19_skip_unchanged", "SELECT doc_id FROM documents WHERE NOT (lang IN ('en', 'fr') AND doc_id % 10 <> 0)")
def i19_skip_unchanged(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "documents").select("doc_id", "lang", F.sha2(F.concat_ws("|", "text", "lang"), 256).alias("run_key"))
    done = runs.where("lang IN ('en', 'fr') AND doc_id % 10 <> 0").select("doc_id", "run_key")
    return runs.join(done, ["doc_id", "run_key"], "left_anti").select("doc_id")


@query("i21_page_classes", "SELECT page_id, CASE WHEN length(regexp_replace(html, '<[^>]*>', '', 'g')) = 0 THEN 'blank' WHEN length(regexp_replace(html, '<[^>]*>', '', 'g')) * 2 < length(html) THEN 'markup' ELSE 'text' END AS class FROM pages")
def i21_page_classes(spark: SparkSession, d: str) -> DataFrame:
    bare = F.length(F.regexp_replace("html", "<[^>]*>", ""))
    return table(spark, d, "pages").select("page_id", F.when(bare == 0, "blank").when(bare * 2 < F.length("html"), "markup").otherwise("text").alias("class"))


_PACKED = """
WITH RECURSIVE l AS (SELECT doc_id AS owner, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
t AS (SELECT owner, pos, CAST(greatest(ceil(length(line) / 3), ceil(len(list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '')) * 1.8::DOUBLE)) AS BIGINT) AS n FROM l),
r AS (SELECT owner, pos, n, 0::BIGINT AS chunk, n AS used FROM t WHERE pos = 0
  UNION ALL SELECT t.owner, t.pos, t.n, CASE WHEN used + t.n > 400 THEN chunk + 1 ELSE chunk END, CASE WHEN used + t.n > 400 THEN t.n ELSE used + t.n END FROM r JOIN t ON t.owner = r.owner AND t.pos = r.pos + 1)
SELECT owner, chunk, min(pos) AS first, max(pos) AS last, count(*) AS n_items, CAST(sum(n) AS BIGINT) AS n_tokens FROM r GROUP BY owner, chunk
"""


@query("i13_packed_chunks", _PACKED)
def i13_packed_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every document's lines packed into chunks of 400 estimated tokens at most."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("owner"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return folds.pack(lines.select("owner", "pos", text.token_estimate(F.col("line")).alias("n_tokens")), 400)


@query("c1_context_packing")
def c1_context_packing(spark: SparkSession, d: str) -> DataFrame:
    """The eight nearest chunks of each query, each with its two successors, admitted whole under a budget of 900 tokens."""
    rows = table(spark, d, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    hits = cut(retrieval.top_k(retrieval.best_pairs(queries, rows.withColumnRenamed("vec_id", "chunk_id"), 8), 8).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank")))
    sizes = rows.select(F.col("vec_id").alias("member"), (F.col("vec_id") % 200 + 50).alias("n_tokens"))
    each = hits.withColumn("member", F.explode(F.array("chunk_id", F.col("chunk_id") + 1, F.col("chunk_id") + 2))).join(sizes, "member", "left")
    members = F.array_sort(F.collect_list(F.struct(F.col("member").alias("chunk_id"), "n_tokens")))
    return folds.assemble_context(each.groupBy("query_id", "rank", "chunk_id").agg(members.alias("members")), 900)


@query("c5_group_parts", "SELECT l_orderkey AS step, count(*) AS n, count(*) = max(l_linenumber) AND min(l_linenumber) = 1 AND count(DISTINCT l_linenumber) = count(*) AS complete FROM lineitem GROUP BY 1")
def c5_group_parts(spark: SparkSession, d: str) -> DataFrame:
    n, p = F.count("*"), "l_linenumber"
    complete = (n == F.max(p)) & (F.min(p) == 1) & (F.count_distinct(p) == n)
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("step")).agg(n.alias("n"), complete.alias("complete"))


@query("c13_first_failure", "SELECT o_custkey AS request, coalesce(min_by(o_orderstatus, o_orderkey) FILTER (WHERE o_orderstatus <> 'F'), 'ok') AS status, count(*) AS n_topics FROM orders GROUP BY o_custkey")
def c13_first_failure(spark: SparkSession, d: str) -> DataFrame:
    bad = F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey"))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("request")).agg(F.coalesce(F.min_by("o_orderstatus", bad), F.lit("ok")).alias("status"), F.count("*").alias("n_topics"))


def _plan_courses(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    term = F.expr("dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
    terms = orders.withColumn("term", term.cast("long"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    rows = lines.join(terms.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    units = F.when(F.col("l_partkey") % 40 != 0, F.col("l_quantity"))
    return rows.groupBy(F.col("o_custkey").alias("plan_id"), "term", F.col("l_partkey").alias("course")).agg(F.max(units).alias("units"))


@query("p4_load", "WITH o AS (SELECT o_orderkey, o_custkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS term FROM orders), c AS (SELECT o_custkey AS plan_id, term, l_partkey, max(CASE WHEN l_partkey % 40 <> 0 THEN l_quantity END) AS u FROM lineitem JOIN o ON o_orderkey = l_orderkey GROUP BY ALL), s AS (SELECT plan_id, term, sum(u) AS total, bool_or(u IS NULL) AS partial FROM c GROUP BY ALL) SELECT plan_id, term, CASE WHEN NOT partial THEN total END AS units, CASE WHEN partial THEN 'unknown' WHEN total > 120 THEN 'over' ELSE 'within' END AS load FROM s")
def p4_load(spark: SparkSession, d: str) -> DataFrame:
    return planning.load_status(_plan_courses(spark, d), 120.0)


@query("t1_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1800 SECOND THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id AS key, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY ALL")
def t1_sessions(spark: SparkSession, d: str) -> DataFrame:
    return folds.sessions(table(spark, d, "events").select(F.col("user_id").alias("key"), "ts"), 1800).select("key", "session", "n")


_LIMIT = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, 0::BIGINT AS rn, []::BIGINT[] AS adm, 0::BIGINT AS event_id, false AS admitted, 0::BIGINT AS wait_s FROM (SELECT DISTINCT user_id FROM e) UNION ALL
 SELECT e.user_id, e.rn, CASE WHEN len(list_filter(adm, lambda x: x > t - 86400000000)) < 2 THEN list_append(list_filter(adm, lambda x: x > t - 86400000000), t) ELSE list_filter(adm, lambda x: x > t - 86400000000) END, e.event_id, len(list_filter(adm, lambda x: x > t - 86400000000)) < 2, CASE WHEN len(list_filter(adm, lambda x: x > t - 86400000000)) < 2 THEN 0 ELSE greatest(1, CAST(ceil((list_filter(adm, lambda x: x > t - 86400000000)[1] + 86400000000 - t) / 1000000) AS BIGINT)) END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id AS person, event_id, admitted, wait_s FROM r WHERE rn > 0"""


@query("t2_rate_limit", _LIMIT)
def t2_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Two admitted events a day for each user."""
    events = table(spark, d, "events").select(F.col("user_id").alias("person"), "event_id", "ts")
    return folds.rate_limit(events, 2, 86_400).select("person", "event_id", "admitted", "wait_s")


def _stream_folder(spark: SparkSession) -> str:
    cut(spark.range(1))  # makes sure that the shared folder is set
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


@query("t1_session_stream", "WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1800 SECOND THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id AS key, count(*) AS n FROM s GROUP BY user_id, session")
def t1_session_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same sessions from a stream over the events, run until it is drained."""
    events = state.stream_of(spark, f"{d}/events.parquet").select(F.col("user_id").alias("key"), "ts")
    return state.run_once(state.session_stream(events, 1800), _stream_folder(spark), "complete").select("key", "n")


_CLOSED = """
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1800 SECOND THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id AS key, count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 1800 SECOND <= (SELECT max(ts) - INTERVAL 600 SECOND FROM events)
"""


@query("t1_closed_sessions", _CLOSED)
def t1_closed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark has passed, each put out once and its state dropped (append mode)."""
    events = state.stream_of(spark, f"{d}/events.parquet").select(F.col("user_id").alias("key"), "ts")
    return state.run_once(state.session_stream(events, 1800), _stream_folder(spark)).select("key", "n")


@query("t6_turn_stream", "SELECT user_id, event_type, count(*) > 0 AS seen FROM events GROUP BY ALL")
def t6_turn_stream(spark: SparkSession, d: str) -> DataFrame:
    """The first of each kind of a user's messages from a stream that refuses repeated ones."""
    events = state.stream_of(spark, f"{d}/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    kept = state.run_once(state.distinct_turns(events, ["user_id", "event_type"], "1000 days"), _stream_folder(spark))
    return kept.select("user_id", "event_type", F.lit(True).alias("seen"))


#: Answers that a pool runs and lets wait, and how many pools there are.
RUNNING, WAITING, POOLS = 2, 2, 5
_ADMIT = f"""WITH RECURSIVE e AS (SELECT event_id % {POOLS} AS pool, event_id AS request, user_id AS account, epoch_us(ts) AS t, (event_id % 7 + 1) * 3600000000 AS takes, row_number() OVER (PARTITION BY event_id % {POOLS} ORDER BY ts, event_id) AS rn FROM events),
r AS (
  SELECT DISTINCT pool, 0::BIGINT AS rn, []::STRUCT(r BIGINT, a BIGINT)[] AS held, NULL::BIGINT AS request, NULL::VARCHAR AS state, NULL::BIGINT AS wait_us FROM e
  UNION ALL
  SELECT pool, rn, CASE WHEN state IN ('admitted', 'waiting') THEN list_append(held, {{'r': t + wait_us + takes, 'a': account}}) ELSE held END, request, state, wait_us
  FROM (SELECT pool, rn, request, account, t, takes, held, CASE WHEN no IS NOT NULL THEN NULL WHEN len(held) < {RUNNING} THEN 0 ELSE list_sort(list_transform(held, lambda h: h.r))[len(held) - {RUNNING} + 1] - t END AS wait_us,
      coalesce(no, CASE WHEN len(held) < {RUNNING} THEN 'admitted' ELSE 'waiting' END) AS state
    FROM (SELECT *, CASE WHEN list_contains(list_transform(held, lambda h: h.a), account) THEN 'account_busy' WHEN len(held) >= {RUNNING + WAITING} THEN 'answers_busy' END AS no
      FROM (SELECT e.pool, e.rn, e.request, e.account, e.t, e.takes, list_filter(r.held, lambda h: (h.r > e.t)) AS held FROM r JOIN e ON e.pool = r.pool AND e.rn = r.rn + 1)))
)
SELECT pool, request, state, wait_us FROM r WHERE rn > 0"""


def _asked(events: DataFrame) -> DataFrame:
    return events.select((F.col("event_id") % POOLS).alias("pool"), F.col("event_id").alias("request"), F.col("user_id").alias("account"), "ts", ((F.col("event_id") % 7 + 1) * 3600).alias("takes_s"))


@query("t3_admissions", _ADMIT)
def t3_admissions(spark: SparkSession, d: str) -> DataFrame:
    """Requests of five pools: two answers run at once, two more wait, and each account has one at a time."""
    return folds.admissions(_asked(table(spark, d, "events")), RUNNING, WAITING)


@query("t3_admission_stream", _ADMIT)
def t3_admission_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stateful stream."""
    return state.run_once(state.admission_stream(_asked(state.stream_of(spark, f"{d}/events.parquet")), RUNNING, WAITING), _stream_folder(spark)).select("pool", "request", "state", "wait_us")


@query("t2_rate_limit_stream", _LIMIT)
def t2_rate_limit_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same admissions from a stateful stream."""
    events = state.stream_of(spark, f"{d}/events.parquet").select(F.col("user_id").alias("person"), "event_id", "ts")
    return state.run_once(state.rate_limit_stream(events, 2, 86_400), _stream_folder(spark)).select("person", "event_id", "admitted", "wait_s")


_MERGED = """
WITH RECURSIVE e AS (SELECT user_id AS session, event_type AS course, CASE event_id % 3 WHEN 0 THEN 'taken_unknown' WHEN 1 THEN 'passed' ELSE 'failed' END AS state, CASE WHEN event_id % 10 = 0 THEN 'upload' ELSE 'statement' END AS source, event_id AS seq, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events),
r AS (SELECT session, course, 0::BIGINT AS i, []::STRUCT(state VARCHAR, source VARCHAR, seq BIGINT)[] AS kept FROM (SELECT DISTINCT session, course FROM e)
  UNION ALL SELECT e.session, e.course, e.i, CASE WHEN e.state = 'taken_unknown' AND len(list_filter(kept, lambda f: f.state <> 'taken_unknown')) > 0 THEN kept
    WHEN len(list_filter(kept, lambda f: f.source <> 'statement' AND f.state = e.state)) > 0 THEN list_filter(kept, lambda f: f.source <> 'statement')
    ELSE list_append(list_filter(kept, lambda f: f.source <> 'statement'), {'state': e.state, 'source': e.source, 'seq': e.seq}) END FROM r JOIN e ON e.session = r.session AND e.course = r.course AND e.i = r.i + 1),
z AS (SELECT session, course, unnest(kept) AS f FROM r WHERE (session, course, i) IN (SELECT session, course, max(i) FROM e GROUP BY 1, 2))
SELECT session, course, f.state AS state, f.source AS source, f.seq AS seq FROM z
"""


@query("t4_fact_merge", _MERGED)
def t4_fact_merge(spark: SparkSession, d: str) -> DataFrame:
    """What stands of every user's statements about each kind of course."""
    kinds = F.when(F.col("event_id") % 3 == 0, "taken_unknown").when(F.col("event_id") % 3 == 1, "passed").otherwise("failed")
    source = F.when(F.col("event_id") % 10 == 0, "upload").otherwise("statement")
    return folds.merge_facts(table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("course"), kinds.alias("state"), source.alias("source"), F.col("event_id").alias("seq")))


@query("t6_idempotent_turns", "SELECT user_id, event_type, min(event_id) AS event_id, count(*) - 1 AS n_refused FROM events GROUP BY ALL")
def t6_idempotent_turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), (F.count("*") - 1).alias("n_refused"))


@query("t8_dialogue_buffer")
def t8_dialogue_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation's turns through a buffer of four exchanges and 4,000 bytes."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("message"), F.col("turn").alias("seq"), F.octet_length("text").cast("long").alias("size"), (F.col("turn") == 0).alias("pinned"))
    return folds.bounded_dialogue(turns, 4, 4000)


@query("t10_follow_up", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS refers_to FROM conversations")
def t10_follow_up(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.expr("last_value(CASE WHEN role = 'user' THEN turn END) IGNORE NULLS OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("refers_to"))
