"""Queries of named operations, facts, margins, clauses, boxes and decisions."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import text
from ledgerleaf.operators import capabilities, governance, ingestion

from . import governed
from . import rules as rule_plans
from .base import query, table

#: What this library offers by name.
OPERATIONS = {"rule_outcome": ("subject_id", "course_id"), "affected_courses": ("course_id",), "term_listing": ("curriculum", "year", "term")}


@query("z1_call_states", "WITH c AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'rule_outcome' WHEN 1 THEN 'affected_courses' WHEN 2 THEN 'term_listing' ELSE 'drop_tables' END AS op, event_id % 5 AS k FROM events) SELECT event_id, CASE WHEN op = 'drop_tables' THEN 'unsupported' WHEN op = 'term_listing' OR (op = 'rule_outcome' AND k IN (1, 2)) OR k = 3 THEN 'missing_argument' WHEN k = 4 OR (op = 'affected_courses' AND k < 1) THEN 'unknown_argument' ELSE 'ok' END AS state FROM c")
def z1_call_states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 5
    name = F.element_at(F.array(*map(F.lit, ("rule_outcome", "affected_courses", "term_listing", "drop_tables"))), (F.col("event_id") % 4 + 1).cast("int"))
    given = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(n).alias("key"), F.when(on, v).alias("value")) for n, v, on in (("course_id", F.when(k == 3, "").otherwise("7"), F.lit(True)), ("subject_id", F.lit("8"), k.isin(0, 3, 4)), ("other", F.lit("x"), k == 4)))), lambda e: e.value.isNotNull()))
    return capabilities.call_states(table(spark, d, "events").select("event_id", name.alias("operation"), given.alias("arguments")), OPERATIONS).select("event_id", "state")


@query("p1_rule_facts", "WITH s AS (SELECT o_custkey AS subject, o_orderkey % 40 AS course, ['passed', 'failed', 'not_passed', 'not_taken', 'enrolled', 'not_enrolled', 'taken_unknown'][o_orderkey % 7 + 1] AS state FROM orders), l AS (SELECT subject, list_sort(list_distinct(list(course) FILTER (WHERE state = 'passed'))) AS p, list_sort(list_distinct(list(course) FILTER (WHERE state IN ('failed', 'not_passed', 'not_taken')))) AS f, list_sort(list_distinct(list(course) FILTER (WHERE state = 'enrolled'))) AS e, list_sort(list_distinct(list(course) FILTER (WHERE state = 'not_enrolled'))) AS n FROM s GROUP BY 1) SELECT subject, coalesce(array_to_string(p, ','), '') AS passed, coalesce(array_to_string(f, ','), '') AS failed, coalesce(array_to_string(e, ','), '') AS enrolled, coalesce(array_to_string(n, ','), '') AS not_enrolled FROM l")
def p1_rule_facts(spark: SparkSession, d: str) -> DataFrame:
    states = F.array(*map(F.lit, ("passed", "failed", "not_passed", "not_taken", "enrolled", "not_enrolled", "taken_unknown")))
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), (F.col("o_orderkey") % 40).alias("course"), F.element_at(states, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("state"))
    found = capabilities.rule_facts(rows)
    return found.select("subject", *(F.array_join(c, ",").alias(c) for c in ("passed", "failed", "enrolled", "not_enrolled")))


_MARGINS = """
WITH l AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
p AS (SELECT doc, i // 4 AS page, i % 4 AS place, line, count(*) OVER (PARTITION BY doc, i // 4) AS n FROM l),
o AS (SELECT doc, page, regexp_replace(lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))), '\\d+', '#', 'g') AS line FROM p WHERE place < n * 0.25::DOUBLE OR place >= n * 0.75::DOUBLE)
SELECT doc, sha256(line) AS line, count(DISTINCT page) AS n_pages FROM o WHERE line <> '' GROUP BY doc, line HAVING count(DISTINCT page) >= 3
"""


@query("w8_page_margins", _MARGINS)
def w8_page_margins(spark: SparkSession, d: str) -> DataFrame:
    """Pages of four lines, whose outer quarters are the first and the last."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    sizes = lines.groupBy("doc", F.expr("i div 4").alias("page")).agg(F.count("*").alias("of"))
    rows = lines.withColumn("page", F.expr("i div 4")).join(sizes, ["doc", "page"]).select("doc", "page", (F.col("i") % 4).alias("place"), "of", "line")
    return capabilities.repeated_margins(rows, 0.25).select("doc", F.sha2("line", 256).alias("line"), "n_pages")


@query("w10_clause_targets", "WITH c AS (SELECT user_id, event_id, ts, CASE event_id % 5 WHEN 0 THEN 'Except where ' || event_type WHEN 1 THEN 'unless ' || event_type ELSE event_type || ' provided' END AS t FROM events), f AS (SELECT *, regexp_matches(t, '(?i)^\\s*(except|unless|provided|however)\\b') AS opens FROM c) SELECT event_id, CASE WHEN opens THEN last_value(CASE WHEN NOT opens THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS target FROM f")
def w10_clause_targets(spark: SparkSession, d: str) -> DataFrame:
    t = F.expr("CASE event_id % 5 WHEN 0 THEN concat('Except where ', event_type) WHEN 1 THEN concat('unless ', event_type) ELSE concat(event_type, ' provided') END")
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", t.alias("t"))
    return capabilities.clause_targets(rows, ["user_id"], ["ts", "event_id"], "event_id", "t").select("event_id", "target")


@query("a13_enclosing_boxes", "WITH b AS (SELECT l_orderkey AS k, CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 1 THEN 'TOPLEFT' WHEN l_orderkey % 2 = 0 THEN 'BOTTOMLEFT' ELSE 'TOPLEFT' END AS o, l_partkey AS l, l_partkey + l_quantity AS r, l_suppkey AS x, l_suppkey + 4 AS y FROM lineitem), c AS (SELECT *, CASE WHEN o = 'BOTTOMLEFT' THEN y ELSE x END AS t, CASE WHEN o = 'BOTTOMLEFT' THEN x ELSE y END AS b FROM b), s AS (SELECT k, count(DISTINCT o) = 1 AS one, min(o) AS o, min(l) AS l, max(r) AS r, min(t) AS t0, max(t) AS t1, min(b) AS b0, max(b) AS b1 FROM c GROUP BY k) SELECT k, CASE WHEN one THEN l END AS \"left\", CASE WHEN one THEN r END AS \"right\", CASE WHEN one THEN CASE WHEN o = 'BOTTOMLEFT' THEN t1 ELSE t0 END END AS top, CASE WHEN one THEN CASE WHEN o = 'BOTTOMLEFT' THEN b0 ELSE b1 END END AS bottom FROM s")
def a13_enclosing_boxes(spark: SparkSession, d: str) -> DataFrame:
    origin = F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") == 1), "TOPLEFT").when(F.col("l_orderkey") % 2 == 0, "BOTTOMLEFT").otherwise("TOPLEFT")
    low, high = F.col("l_suppkey"), F.col("l_suppkey") + 4
    up = F.col("origin") == "BOTTOMLEFT"
    boxes = table(spark, d, "lineitem").withColumn("origin", origin).select(F.col("l_orderkey").alias("k"), "origin", F.col("l_partkey").alias("left"), (F.col("l_partkey") + F.col("l_quantity")).alias("right"), F.when(up, high).otherwise(low).alias("top"), F.when(up, low).otherwise(high).alias("bottom"))
    return capabilities.enclosing_boxes(boxes, ["k"])


@query("i11_put_into_effect", "WITH e AS (SELECT user_id AS locator, CASE event_type WHEN 'view' THEN 'row' WHEN 'click' THEN 'code' WHEN 'purchase' THEN 'title' ELSE 'units' END AS field, event_id AS seq, round(value, 3)::VARCHAR AS v FROM events), f AS (SELECT locator, seq, v, unnest(CASE WHEN field = 'row' THEN ['code', 'title', 'units'] ELSE [field] END) AS field FROM e), m AS (SELECT locator, field, max_by(v, seq) AS v FROM f GROUP BY ALL), p AS (SELECT locator, max(v) FILTER (WHERE field = 'code') AS c, max(v) FILTER (WHERE field = 'title') AS t, max(v) FILTER (WHERE field = 'units') AS u FROM m GROUP BY 1) SELECT c_custkey AS id, coalesce(c, 'C' || c_custkey) AS code, coalesce(t, c_name) AS title, coalesce(u, '3') AS units, coalesce(c, t, u) IS NOT NULL AS decided FROM customer LEFT JOIN p ON locator = c_custkey")
def i11_put_into_effect(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("C"), F.col("c_custkey")).alias("code"), F.col("c_name").alias("title"), F.lit("3").alias("units"))
    return capabilities.put_into_effect(rows, governance.latest_by_field(governed._ledger(spark, d)), "id", ["code", "title", "units"])


@query("f6_request_status", "WITH r AS (SELECT s_nationkey AS release, count(*) AS n, min(s_name) AS name FROM supplier GROUP BY 1), q AS (SELECT c_custkey AS request, c_nationkey AS release, CASE WHEN c_custkey % 4 = 0 THEN 'x' END AS other FROM customer) SELECT request, CASE WHEN coalesce(n, 0) <> 1 THEN 'release_changed' WHEN other IS NOT NULL THEN 'configuration_mismatch' ELSE 'ok' END AS status FROM q LEFT JOIN r USING (release)")
def f6_request_status(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers are releases by nation; what a customer asks for is that nation's supplier, some with another name."""
    releases = table(spark, d, "supplier").select(F.col("s_nationkey").alias("release"), "s_name")
    names = releases.groupBy("release").agg(F.min("s_name").alias("s_name"))
    requests = table(spark, d, "customer").select(F.col("c_custkey").alias("request"), F.col("c_nationkey").alias("release")).join(names, "release", "left")
    asked = requests.select("request", "release", F.when(F.col("request") % 4 == 0, "x").otherwise(F.col("s_name")).alias("s_name"))
    return capabilities.request_status(asked, releases, ["s_name"])


@query("s19_release_curricula", "SELECT p_partkey AS id, p_name AS title, CAST(p_size AS BIGINT) AS units FROM part WHERE p_brand = 'Brand#5'")
def s19_release_curricula(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    ledgers = part.select(F.col("p_partkey").alias("id"), F.to_json(F.struct(F.col("p_name").alias("title"), F.col("p_size").alias("units"))).alias("body"))
    return capabilities.release_curricula(part.select(F.col("p_brand").alias("release"), F.col("p_partkey").alias("id")), ledgers, "Brand#5", "title string, units long")


@query("x11_content_hashes", "SELECT doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS hash FROM documents WHERE text IS NOT NULL")
def x11_content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query("x26_plain_filenames", "SELECT page_id, regexp_matches(n, '^[A-Za-z0-9][A-Za-z0-9._ -]*$') AND NOT contains(n, '..') AS plain FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'page ' || page_id || '.html' WHEN 2 THEN '..' || page_id ELSE 'a..b' || page_id END AS n FROM pages)")
def x26_plain_filenames(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('page ', page_id, '.html') WHEN 2 THEN concat('..', page_id) ELSE concat('a..b', page_id) END")
    return table(spark, d, "pages").select("page_id", text.plain_filename(name).alias("plain"))


@query("j2_without_urgent_orders", "SELECT c_custkey, c_mktsegment FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000 WHERE o_orderkey IS NULL")
def j2_without_urgent_orders(spark: SparkSession, d: str) -> DataFrame:
    """A coverage check by outer join that finds some."""
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
    rows = table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.where("o_orderkey IS NULL").select("c_custkey", "c_mktsegment")


@query("j4_without_large_sales", "SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 44)")
def j4_without_large_sales(spark: SparkSession, d: str) -> DataFrame:
    sold = table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity > 44")
    return table(spark, d, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_brand")


_NONE_CELL = "CASE p_partkey % 10 WHEN 0 THEN 'None.' WHEN 1 THEN '— N/A —' WHEN 2 THEN 'no  Pre-requisite(s) required' WHEN 3 THEN '--' WHEN 4 THEN 'none?' WHEN 5 THEN 'PX ' || p_partkey WHEN 6 THEN 'n . a' WHEN 7 THEN 'no prereq: PX 1' WHEN 8 THEN '' ELSE 'NIL ' END"
_NONE_WORDS = ", ".join(f"'{p}'" for p in ingestion.NO_REQUIREMENT)


@query("x9_states_none", f"WITH c AS (SELECT p_partkey, replace(lower(trim(regexp_replace(replace(replace({_NONE_CELL}, '—', '-'), '–', '-'), '\\s+', ' ', 'g'))), '(s)', 's') AS t FROM part), n AS (SELECT p_partkey, regexp_replace(t, 'n\\s*[/.]\\s*a\\b', 'na') AS t FROM c), b AS (SELECT p_partkey, t, regexp_replace(regexp_replace(t, '^[- ]+|[- ]+$', '', 'g'), '\\.?[- ]*$', '') AS w FROM n) SELECT p_partkey, regexp_matches(t, '^-[- ]*\\.?$') OR regexp_replace(regexp_replace(w, '([a-z])-([a-z])', '\\1 \\2', 'g'), '\\s+', ' ', 'g') IN ({_NONE_WORDS}) AS none FROM b")
def x9_states_none(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", ingestion.states_none(F.expr(_NONE_CELL)).alias("none"))


_UNITS = "CASE p_partkey % 7 WHEN 0 THEN '(' || p_size % 9 || ')' WHEN 1 THEN p_size % 7 || ' / ' || p_size % 3 WHEN 2 THEN '23 ' || p_size % 6 WHEN 3 THEN '3 1/2 units' WHEN 4 THEN 'about ' || p_size % 8 WHEN 5 THEN '' ELSE 'n/a' END"


@query("x6_unit_parts", "WITH u AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_size % 9 WHEN 1 THEN p_size % 7 WHEN 2 THEN p_size % 6 WHEN 3 THEN 1 WHEN 4 THEN p_size % 8 END AS lecture, CASE p_partkey % 7 WHEN 0 THEN 0 WHEN 1 THEN p_size % 3 WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 0 END AS lab FROM part) SELECT p_partkey, CAST(lecture AS INTEGER) AS lecture, CAST(lab AS INTEGER) AS lab, CAST(lecture + lab AS INTEGER) AS total FROM u")
def x6_unit_parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", *(c.alias(k) for k, c in ingestion.unit_parts(F.expr(_UNITS)).items()))


_TITLE = "p_name || CASE p_partkey % 5 WHEN 0 THEN ' 2 / 1' WHEN 1 THEN ' 4 3' WHEN 2 THEN ' 3' WHEN 3 THEN ' 1 9' ELSE '' END"


@query("x6_units_in_title", f"WITH t AS (SELECT p_partkey, {_TITLE} AS t, CASE WHEN p_partkey % 3 = 0 THEN '5' ELSE ' ' END AS u FROM part) SELECT p_partkey, CASE WHEN u <> '5' AND regexp_matches(t, '\\s\\d{{1,2}}\\s*/\\s*\\d{{1,2}}$') THEN regexp_extract(t, '^(.*?)\\s+(\\d{{1,2}}\\s*/\\s*\\d{{1,2}})$', 1) WHEN u <> '5' AND regexp_matches(t, '\\s\\d{{1,2}}\\s+[0-6]$') THEN regexp_extract(t, '^(.*)\\s+[0-6]$', 1) ELSE t END AS title, CASE WHEN u = '5' THEN u WHEN regexp_matches(t, '\\s\\d{{1,2}}\\s*/\\s*\\d{{1,2}}$') THEN replace(regexp_extract(t, '\\s+(\\d{{1,2}}\\s*/\\s*\\d{{1,2}})$', 1), ' ', '') WHEN regexp_matches(t, '\\s\\d{{1,2}}\\s+[0-6]$') THEN regexp_extract(t, '\\s([0-6])$', 1) ELSE '' END AS units FROM t")
def x6_units_in_title(spark: SparkSession, d: str) -> DataFrame:
    printed = F.when(F.col("p_partkey") % 3 == 0, "5").otherwise(" ")
    rows = table(spark, d, "part").select("p_partkey", F.expr(_TITLE).alias("t"), printed.alias("u"))
    return rows.select("p_partkey", *(c.alias(k) for k, c in ingestion.units_in_title(F.col("t"), F.col("u")).items()))


_CODE = "CASE p_partkey % 6 WHEN 0 THEN 'ge ' || p_size WHEN 1 THEN 'NSTP ' || p_size WHEN 2 THEN 'cs practicum' WHEN 3 THEN 'PATHFit 1' ELSE 'CS ' || p_size END"


@query("x10_course_category", f"WITH c AS (SELECT upper({_CODE}) AS c, upper(CASE WHEN p_partkey % 12 = 4 THEN 'Thesis ' || p_name ELSE p_name END) AS t FROM part) SELECT CASE WHEN c LIKE 'GE%' THEN 'General Education' WHEN regexp_matches(c, '^(NSTP|PATH|CWTS|ROTC)') THEN 'NSTP / PATHFit' WHEN c LIKE '%THESIS%' OR c LIKE '%PRACTICUM%' OR t LIKE '%THESIS%' THEN 'Capstone / Practicum' ELSE 'Core / Major' END AS category, count(*) AS n FROM c GROUP BY 1")
def x10_course_category(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("p_partkey") % 12 == 4, F.concat(F.lit("Thesis "), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").groupBy(ingestion.course_category(F.expr(_CODE), title).alias("category")).agg(F.count("*").alias("n"))
