"""Queries of reading, claims, sinks and the named-operation registry."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.operators import claims, fixes, grids, ingestion, sections
from ledgerleaf.sources import sinks

from .base import query, table

_CELL = "CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'None' WHEN 2 THEN 'PX ' || (p_partkey + 1) || ', PX ' || (p_partkey + 2) WHEN 3 THEN 'PX ' || (p_partkey + 3) || ' or PX 1' WHEN 4 THEN '3rd Year Standing' WHEN 5 THEN 'PX ' || p_partkey || ' and QQ 9' ELSE 'PX-' || (p_partkey // 2) END"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    cell = F.expr(_CELL.replace("//", "div"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("owner"), cell.alias("cell"))


def _codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("PX "), F.col("p_partkey")).alias("code"))


@query("x8_requirement_states", "WITH m AS (SELECT max(p_partkey) AS m FROM part) SELECT p_partkey AS owner, CASE p_partkey % 7 WHEN 0 THEN 'blank_unreviewed' WHEN 1 THEN 'stated_none' WHEN 2 THEN CASE WHEN p_partkey + 2 > m THEN 'unresolved_reference' ELSE 'resolved' END WHEN 3 THEN 'alternative_or_exception' WHEN 4 THEN 'standing_condition' WHEN 5 THEN 'unresolved_reference' ELSE 'resolved' END AS state, CASE p_partkey % 7 WHEN 2 THEN (p_partkey + 1 <= m)::INTEGER + (p_partkey + 2 <= m)::INTEGER WHEN 5 THEN 1 WHEN 6 THEN 1 ELSE 0 END AS n_codes FROM part, m")
def x8_requirement_states(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d)
    found = ingestion.requirement_states(cells, ingestion.resolve(ingestion.fragments(cells), _codes(spark, d)))
    return found.select("owner", "state", F.size("codes").alias("n_codes"))


@query("x7_requirement_fragments", f"WITH c AS (SELECT p_partkey AS owner, {_CELL} AS cell FROM part), f AS (SELECT owner, unnest(regexp_split_to_array(cell, '\\s*(?:,|\\band\\b)\\s*')) AS fragment FROM c) SELECT owner, fragment FROM f WHERE fragment <> ''")
def x7_requirement_fragments(spark: SparkSession, d: str) -> DataFrame:
    return ingestion.fragments(_cells(spark, d)).select("owner", "fragment")


@query("x10_course_class", "SELECT CASE WHEN p_partkey % 5 = 0 THEN 'elective' WHEN p_partkey % 5 = 1 THEN 'practicum' WHEN p_partkey % 5 = 2 THEN 'thesis' WHEN p_partkey % 5 = 3 THEN 'laboratory' ELSE 'lecture' END AS class, count(*) AS n FROM part GROUP BY 1")
def x10_course_class(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("p_partkey") % 5
    title = F.when(kind == 1, "Internship").when(kind == 2, "Thesis 1").otherwise("Subject")
    code = F.when(kind == 0, "CS ELECT 1").when(kind == 3, "CS 101L").otherwise("CS 101")
    return table(spark, d, "part").groupBy(ingestion.course_class(title, code).alias("class")).agg(F.count("*").alias("n"))


@query("x22_aliases", "WITH a AS (SELECT DISTINCT p_brand AS scope, p_partkey AS id, unnest(['px ' || p_partkey, 'px' || p_partkey, lower(p_name), lower(array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda w: w <> ''), lambda w: w[1]), ''))]) AS alias FROM part) SELECT scope, alias, min(id) AS id FROM a WHERE alias <> '' GROUP BY scope, alias HAVING count(DISTINCT id) = 1")
def x22_aliases(spark: SparkSession, d: str) -> DataFrame:
    return ingestion.aliases(table(spark, d, "part").select(F.col("p_brand").alias("scope"), F.col("p_partkey").alias("id"), F.concat(F.lit("PX "), F.col("p_partkey")).alias("code"), F.col("p_name").alias("title")))


@query("x24_quote_anchors", "SELECT conv_id, turn, CASE WHEN length(q) = 0 THEN NULL WHEN substr(text, 6, length(q)) = q THEN 5 WHEN instr(text, q) > 0 AND instr(substr(text, instr(text, q) + 1), q) = 0 THEN instr(text, q) - 1 END::INTEGER AS start FROM (SELECT *, substr(text, CASE WHEN turn % 2 = 0 THEN 6 ELSE 11 END, 8) AS q FROM conversations)")
def x24_quote_anchors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("q", F.expr("substr(text, CASE WHEN turn % 2 = 0 THEN 6 ELSE 11 END, 8)"))
    return rows.select("conv_id", "turn", ingestion.anchored(F.col("text"), F.col("q"), F.lit(5)).alias("start"))


@query("w11_banner_fill_down", "WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER w AS section, CASE WHEN l_linestatus = 'O' THEN l_suppkey END AS banner FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus ROWS UNBOUNDED PRECEDING)) SELECT l_orderkey, l_linenumber, l_partkey, last_value(banner IGNORE NULLS) OVER (PARTITION BY l_orderkey, section ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS banner FROM b")
def w11_banner_fill_down(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", F.when(F.col("l_linestatus") == "O", F.col("l_suppkey")).alias("banner"))
    out = ingestion.fill_down(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"], "banner", F.col("l_returnflag") == "R")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "banner")


@query("i8_unclaimed_codes", "SELECT DISTINCT l_suppkey AS document, 'PX' || l_partkey AS key FROM lineitem WHERE (l_suppkey, l_partkey) NOT IN (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag <> 'R')")
def i8_unclaimed_codes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("document"), F.concat(F.lit("PX "), F.col("l_partkey")).alias("code"), "l_returnflag")
    return ingestion.unclaimed(rows, rows.where("l_returnflag <> 'R'"))


@query("i17_reading_order", "WITH RECURSIVE n AS (SELECT p_partkey % 10 AS document, p_partkey AS node, CASE WHEN p_partkey >= 10 THEN (p_partkey // 10 - 1) // 3 * 10 + p_partkey % 10 END AS parent FROM part), t AS (SELECT document, node, [node] AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.document, n.node, list_append(path, n.node) FROM t JOIN n ON n.parent = t.node AND n.document = t.document) SELECT document, node, CAST(row_number() OVER (PARTITION BY document ORDER BY path) - 1 AS INTEGER) AS position FROM t")
def i17_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """Ten documents, each a tree with three children to a node."""
    k = F.col("p_partkey")
    parent = F.when(k >= 10, F.expr("(p_partkey div 10 - 1) div 3 * 10 + p_partkey % 10"))
    return ingestion.reading_order(table(spark, d, "part").select((k % 10).alias("document"), k.alias("node"), parent.alias("parent"), k.alias("ordinal")))


_CLAIMS = """
WITH c AS (SELECT o_orderkey AS claim, o_custkey AS subject FROM orders), l AS (SELECT l_orderkey AS claim, bool_or(l_quantity > 45) AS lacking, bool_and(l_discount > 0.01) AS stated FROM lineitem GROUP BY 1),
r AS (SELECT c.claim, subject, CASE WHEN c.claim % 10 = 0 THEN 'insufficient_evidence' WHEN c.claim % 3 = 0 OR l.claim IS NULL THEN 'unassessed' WHEN NOT stated THEN 'not_established' WHEN lacking THEN 'reviewed_fields_not_in_context' ELSE 'reviewed_fields_available' END AS status FROM c LEFT JOIN l ON l.claim = c.claim)
"""


def _report(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim"), "l_quantity", (F.col("l_discount") > 0.01).alias("stated"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("chunk"))
    needs = lines.groupBy("claim").agg(F.collect_set("chunk").alias("required"))
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim"), F.col("o_custkey").alias("subject")).join(needs, "claim", "left")
    return claims.claim_report(asked, asked.where("claim % 10 = 0"), lines.where("claim % 3 <> 0"), lines.where("l_quantity <= 45"))


@query("c9_claim_report", _CLAIMS + "SELECT claim, subject, status FROM r")
def c9_claim_report(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)


@query("c9_subject_status", _CLAIMS + "SELECT subject, CASE min(CASE status WHEN 'insufficient_evidence' THEN 1 WHEN 'not_established' THEN 2 WHEN 'reviewed_fields_not_in_context' THEN 3 WHEN 'unassessed' THEN 4 ELSE 5 END) WHEN 1 THEN 'insufficient_evidence' WHEN 2 THEN 'insufficient_evidence' WHEN 3 THEN 'insufficient_context' WHEN 4 THEN 'unassessed' ELSE 'available' END AS status FROM r GROUP BY subject")
def c9_subject_status(spark: SparkSession, d: str) -> DataFrame:
    return claims.subject_status(_report(spark, d))


@query("c7_selection_trace", "WITH a AS (SELECT l_orderkey AS k, list_distinct(list(l_suppkey)) AS required, list_distinct(list(l_suppkey) FILTER (WHERE l_returnflag <> 'R')) AS present, list_distinct(list(l_suppkey) FILTER (WHERE l_returnflag = 'A')) AS emitted FROM lineitem GROUP BY 1) SELECT k, array_to_string(list_sort(list_filter(required, lambda x: NOT list_contains(coalesce(present, []), x))), ',') AS absent, array_to_string(list_sort(list_filter(required, lambda x: list_contains(coalesce(present, []), x) AND NOT list_contains(coalesce(emitted, []), x))), ',') AS unemitted FROM a")
def c7_selection_trace(spark: SparkSession, d: str) -> DataFrame:
    among = lambda *flags: F.collect_set(F.when(F.col("l_returnflag").isin(*flags), F.col("l_suppkey")))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_suppkey").alias("required"), among("A", "N").alias("present"), among("A").alias("emitted"))
    out = claims.selection_trace(F.col("required"), F.col("present"), F.col("emitted"))
    return rows.select("k", *(F.array_join(c, ",").alias(k) for k, c in out.items()))


@query("c11_snapshot_binding", "SELECT c_custkey, c_nationkey <> 3 AND c_custkey % 17 <> 0 AS bound FROM customer")
def c11_snapshot_binding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer")
    columns = ["c_name", "c_nationkey", "c_acctbal"]
    prepared = rows.where("c_custkey % 17 <> 0").select("c_custkey", F.sha2(F.to_json(F.struct(*columns)), 256).alias("digest"))
    now = rows.withColumn("c_acctbal", F.when(F.col("c_nationkey") == 3, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return claims.bound(now, prepared, "c_custkey", columns)


@query("c14_integration", "WITH e AS (SELECT o_custkey AS request, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'insufficient' ELSE 'unknown' END AS status, o_orderkey % 50 AS id, CASE WHEN o_custkey % 9 = 0 THEN o_orderpriority ELSE 'r' END AS release, CASE WHEN o_custkey % 4 = 0 THEN o_orderstatus ELSE 'd' END AS digest FROM orders) SELECT request, CASE WHEN count(DISTINCT release) > 1 THEN 'release_changed' WHEN count(DISTINCT (id, digest)) > count(DISTINCT id) THEN 'conflicting_sources' ELSE ['unknown', 'insufficient', 'ok'][min(CASE status WHEN 'unknown' THEN 1 WHEN 'insufficient' THEN 2 ELSE 3 END)] END AS status, CAST(count(DISTINCT id) AS INTEGER) AS n_evidence FROM e GROUP BY request")
def c14_integration(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "insufficient").otherwise("unknown")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("request"), status.alias("status"), (F.col("o_orderkey") % 50).alias("id"), F.when(F.col("o_custkey") % 9 == 0, F.col("o_orderpriority")).otherwise("r").alias("release"), F.when(F.col("o_custkey") % 4 == 0, F.col("o_orderstatus")).otherwise("d").alias("digest"))
    return claims.integrate(rows).select("request", "status", F.size("evidence_ids").alias("n_evidence"))


@query("s14_markdown_rows", "SELECT '| ' || p_partkey || ' | ' || replace(p_name || '|', '|', '\\|') || ' | ' || p_brand || ' |' AS line FROM part")
def s14_markdown_rows(spark: SparkSession, d: str) -> DataFrame:
    return sinks.markdown_rows(table(spark, d, "part").withColumn("p_name", F.concat("p_name", F.lit("|"))), ["p_partkey", "p_name", "p_brand"])


@query("s18_fact_lines", "SELECT 'course(''' || p_partkey || ''', ''' || p_name || '''''s'').' AS line FROM part")
def s18_fact_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.fact_lines(table(spark, d, "part").withColumn("p_name", F.concat("p_name", F.lit("'s"))), "course", ["p_partkey", "p_name"])


@query("m11_freeze_comparison", "SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'missing' ELSE 'edited' END AS state FROM benchmark WHERE item_id % 5 = 0 OR item_id % 7 = 0 UNION ALL SELECT item_id + 100000, 'added' FROM benchmark WHERE item_id % 3 = 0")
def m11_freeze_comparison(spark: SparkSession, d: str) -> DataFrame:
    from ledgerleaf.sources.tables import differences

    frozen = table(spark, d, "benchmark").select("item_id", F.sha2("text", 256).alias("hash"))
    now = frozen.where("item_id % 5 <> 0").withColumn("hash", F.when(F.col("item_id") % 7 == 0, "edit").otherwise(F.col("hash")))
    found = differences(frozen, now.union(frozen.where("item_id % 3 = 0").withColumn("item_id", F.col("item_id") + 100_000)), "item_id", "hash")
    return found.withColumn("state", F.when(F.col("state") == "changed", "edited").otherwise(F.col("state")))


@query("m15_part_agreement", "WITH a AS (SELECT l_orderkey AS k, l_partkey AS p FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL), b AS (SELECT l_orderkey AS k, l_partkey AS p FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) SELECT coalesce(a.k, b.k) AS k, count(*) FILTER (WHERE a.p IS NOT NULL AND b.p IS NOT NULL) AS agreed, count(*) FILTER (WHERE b.p IS NULL) AS extra, count(*) FILTER (WHERE a.p IS NULL) AS missing FROM a FULL JOIN b ON a.k = b.k AND a.p = b.p GROUP BY 1")
def m15_part_agreement(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), "l_returnflag", "l_linestatus")
    a = lines.where("l_returnflag <> 'R'").select("k", "p").distinct().withColumn("x", F.lit(1))
    b = lines.where("l_linestatus = 'F'").select("k", "p").distinct().withColumn("y", F.lit(1))
    n = lambda c: F.count(F.when(c, 1))
    return a.join(b, ["k", "p"], "full").groupBy("k").agg(n(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("agreed"), n(F.col("y").isNull()).alias("extra"), n(F.col("x").isNull()).alias("missing"))


@query("t3_admission", "WITH o AS (SELECT event_id, user_id, ts, ts + INTERVAL 20 MINUTE AS done FROM events) SELECT a.event_id, count(b.event_id) AS running FROM o a LEFT JOIN o b ON b.user_id = a.user_id AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id)) AND b.done > a.ts GROUP BY a.event_id")
def t3_admission(spark: SparkSession, d: str) -> DataFrame:
    """How many requests of the same account still run when one comes, each taking twenty minutes: a range window."""
    rows = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.select("event_id", F.expr("count(*) OVER (PARTITION BY user_id ORDER BY at RANGE BETWEEN 1199999999 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id, at ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)").alias("running"))


@query("u5_set_equality", "WITH a AS (SELECT o_custkey AS k, list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'F'))) AS x, list_sort(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'O'))) AS y FROM orders GROUP BY 1) SELECT k, coalesce(x, []) = coalesce(y, []) AS equal, CAST(len(list_intersect(coalesce(x, []), coalesce(y, []))) AS INTEGER) AS n_shared FROM a")
def u5_set_equality(spark: SparkSession, d: str) -> DataFrame:
    of = lambda s: F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority"))))
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(of("F").alias("x"), of("O").alias("y"))
    return rows.select("k", (F.col("x") == F.col("y")).alias("equal"), F.size(F.array_intersect("x", "y")).alias("n_shared"))




@query("i2_column_groups")
def i2_column_groups(spark: SparkSession, d: str) -> DataFrame:
    """The groups of columns of each brand's table of parts: two terms side by side, one, or columns that lack units; tests
    hold the operator against an exhaustive search."""
    part = table(spark, d, "part").withColumn("n", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    code, title, units = F.concat(F.lit("PX "), (F.col("p_partkey") % 1000).cast("string")), F.col("p_name"), (F.col("p_size") % 6 + 1).cast("string")
    needs = F.when(F.col("p_size") % 3 == 0, "None").otherwise(F.concat(F.lit("PX "), (F.col("p_partkey") % 1000).cast("string"), F.lit(", PX 7")))
    kind = F.pmod(F.xxhash64("p_brand"), F.lit(4))
    cells = F.when(kind == 0, F.array(code, title, units, needs)).when(kind == 1, F.array(code, title, units, needs, code, title, units, needs)).when(kind == 2, F.array(F.lit(None).cast("string"), code, title, needs, code, title, needs)).otherwise(F.array(code, title, units, title, units, needs))
    each = part.select(F.col("p_brand").alias("table_id"), F.col("n").alias("row"), F.posexplode(cells).alias("col", "text"))
    return grids.column_groups(grids.column_scores(each))


_READ, _KNOWN_CODE = "'PX' || translate(CAST(s_suppkey * 7 AS VARCHAR), '015', 'OIS')", "'PX' || p_partkey"
_FOLD = f"translate({{}}, '{fixes.CONFUSED}', '{fixes.FOR}')"
_FIXES = f"""
WITH a AS (SELECT DISTINCT {_READ} AS text FROM supplier), k AS (SELECT DISTINCT {_KNOWN_CODE} AS proposal FROM part),
p AS (SELECT text, proposal, CAST(levenshtein(text, proposal) AS INTEGER) AS edits, (levenshtein(text, proposal) + levenshtein({_FOLD.format("text")}, {_FOLD.format("proposal")})) / 2.0 AS cost FROM a, k WHERE levenshtein(text, proposal) <= 2)
SELECT *, CAST(row_number() OVER (PARTITION BY text ORDER BY cost, edits, proposal) AS INTEGER) AS rank FROM p
"""


@query("i9_fix_proposals", _FIXES)
def i9_fix_proposals(spark: SparkSession, d: str) -> DataFrame:
    """All codes of parts within two edits of codes that a scanner has read wrong."""
    read = table(spark, d, "supplier").select(F.concat(F.lit("PX"), F.translate((F.col("s_suppkey") * 7).cast("string"), "015", "OIS")).alias("text"))
    return fixes.proposals(read, table(spark, d, "part").select(F.concat(F.lit("PX"), F.col("p_partkey").cast("string")).alias("text")))


_ROWS = """
WITH RECURSIVE n AS (SELECT p_brand AS table_id, p_name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS row FROM part),
s AS MATERIALIZED (SELECT table_id, row, CASE WHEN p_name ILIKE '%a%' AND row % 11 = 0 THEN 'S' WHEN row % 41 = 3 THEN 'Y' WHEN row % 10 = 9 THEN 'T' WHEN row % 7 = 4 THEN 'X' WHEN row % 23 = 5 THEN 'B' ELSE 'C' END AS x FROM n),
r AS (SELECT table_id, row, x, CASE x WHEN 'Y' THEN 'year' WHEN 'S' THEN 'open' ELSE 'none' END AS st, CASE x WHEN 'Y' THEN 'year' WHEN 'S' THEN 'section' WHEN 'C' THEN 'stray_course' WHEN 'T' THEN 'stray_total' WHEN 'X' THEN 'text' ELSE 'blank' END AS role FROM s WHERE row = 0
  UNION ALL SELECT s.table_id, s.row, s.x,
    CASE s.x WHEN 'Y' THEN 'year' WHEN 'S' THEN 'open' WHEN 'C' THEN CASE WHEN r.st IN ('open', 'course') THEN 'course' ELSE r.st END WHEN 'T' THEN CASE WHEN r.st IN ('open', 'course') THEN 'closed' ELSE r.st END WHEN 'B' THEN CASE r.st WHEN 'course' THEN 'open' ELSE r.st END ELSE r.st END,
    CASE s.x WHEN 'Y' THEN 'year' WHEN 'S' THEN 'section' WHEN 'C' THEN CASE WHEN r.st IN ('open', 'course') THEN 'course' ELSE 'stray_course' END WHEN 'T' THEN CASE WHEN r.st IN ('open', 'course') THEN 'total' ELSE 'stray_total' END WHEN 'X' THEN CASE r.st WHEN 'course' THEN 'continuation' ELSE 'text' END ELSE 'blank' END
    FROM r JOIN s ON s.table_id = r.table_id AND s.row = r.row + 1)
SELECT table_id, CAST(row AS BIGINT) AS row, x AS symbol, role FROM r
"""


@query("i3_row_roles", _ROWS)
def i3_row_roles(spark: SparkSession, d: str) -> DataFrame:
    """What each row of each brand's table is: banners, courses and what goes on below them, totals, strays."""
    part = table(spark, d, "part").withColumn("row", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    banner = F.when(F.col("p_name").ilike("%a%") & (F.col("row") % 11 == 0), "First Semester").when(F.col("row") % 41 == 3, "SECOND YEAR").when(F.col("row") % 10 == 9, "Total 21").when(F.col("row") % 7 == 4, "of the arts, and more").when(F.col("row") % 23 == 5, "")
    code = F.coalesce(banner, F.concat(F.lit("PX "), (F.col("p_partkey") % 1000).cast("string")))
    text = F.when(banner.isNull(), F.lit("Some title of it"))
    cells = part.select(F.col("p_brand").alias("table_id"), "row", F.posexplode(F.array(code, text)).alias("col", "text"))
    return sections.row_roles(sections.row_symbols(cells))
