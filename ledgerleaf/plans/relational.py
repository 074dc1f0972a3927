"""Queries of joins, aggregation, windows, set operations and text scalars."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerleaf.functions import text
from ledgerleaf.operators import relational
from ledgerleaf.operators.common import ratio, top_rows, upto_here
from ledgerleaf.sources import tables

from .base import query, table


@query("s1_filtered_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def s1_filtered_scan(spark: SparkSession, d: str) -> DataFrame:
    return tables.select(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity"], l_returnflag="R", l_linestatus="F")


@query("s3_upsert", "SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 10000000, c_name, 0.0 FROM customer WHERE c_acctbal < 0")
def s3_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    low = rows.where("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0))
    return tables.upsert(rows, low.union(low.withColumn("c_custkey", F.col("c_custkey") + 10_000_000)), ["c_custkey"])


@query("s6_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s6_resume(spark: SparkSession, d: str) -> DataFrame:
    return tables.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("s8_load_conflicts", "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR c_acctbal < 0")
def s8_load_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    new = rows.withColumn("c_nationkey", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey"))).withColumn("c_acctbal", F.greatest("c_acctbal", F.lit(0.0)))
    return tables.conflicts(rows, new, ["c_custkey"])


@query("s9_changed_children", "WITH a AS (SELECT o_custkey AS parent, list(o_orderkey ORDER BY o_orderkey) AS own, list(CASE WHEN o_orderpriority LIKE '1%' THEN -o_orderkey ELSE o_orderkey END ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN -o_orderkey ELSE o_orderkey END) AS other FROM orders GROUP BY o_custkey) SELECT parent FROM a WHERE own <> other")
def s9_changed_children(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("child"), "o_orderpriority")
    new = own.withColumn("child", F.when(F.col("o_orderpriority").startswith("1"), -F.col("child")).otherwise(F.col("child")))
    return relational.changed_parents(own.select("parent", "child"), new.select("parent", "child"))


@query("s10_set_digest", "WITH h AS (SELECT source, sha256(text) AS h FROM documents), b AS (SELECT source, substr(h, 1, 3) AS bucket, count(*) AS n, sha256(string_agg(h, ',' ORDER BY h)) AS digest FROM h GROUP BY ALL) SELECT source AS set_name, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(bucket || ':' || digest, ',' ORDER BY bucket)) AS digest FROM b GROUP BY source")
def s10_set_digest(spark: SparkSession, d: str) -> DataFrame:
    return relational.set_digest(table(spark, d, "documents").select(F.col("source").alias("set_name"), F.sha2("text", 256).alias("hash")))


@query("s12_release_equivalence", "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' ELSE 'changed' END AS state FROM documents WHERE doc_id % 11 = 0 OR lang = 'es' UNION ALL SELECT doc_id + 100000000, 'added' FROM documents WHERE lang = 'fr'")
def s12_release_equivalence(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("hash"))
    remote = docs.where("doc_id % 11 <> 0").withColumn("hash", F.when(F.col("lang") == "es", "edited").otherwise(F.col("hash")))
    added = docs.where("lang = 'fr'").withColumn("doc_id", F.col("doc_id") + 100_000_000)
    return tables.differences(docs, remote.union(added), "doc_id", "hash")


@query("s16_inventory_classes", "SELECT CASE WHEN length(html) < 1500 THEN 'small' WHEN length(html) < 5000 THEN 'medium' ELSE 'large' END AS class, count(*) AS n, count(DISTINCT sha256(html)) AS n_contents, sum(strlen(html))::BIGINT AS bytes FROM pages GROUP BY 1")
def s16_inventory_classes(spark: SparkSession, d: str) -> DataFrame:
    size = F.length("html")
    kind = F.when(size < 1500, "small").when(size < 5000, "medium").otherwise("large")
    return table(spark, d, "pages").groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.count_distinct(F.sha2("html", 256)).alias("n_contents"), F.sum(F.octet_length("html")).cast("long").alias("bytes"))


@query("j1_membership_join", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def j1_membership_join(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j2_uncovered_customers", "SELECT c_custkey, c_mktsegment FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def j2_uncovered_customers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.where("o_orderkey IS NULL").select("c_custkey", "c_mktsegment")


@query("j3_nested_semi", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)))")
def j3_nested_semi(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where("o_totalprice > 400000")
    customers = table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    nations = table(spark, d, "nation").join(customers, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi")
    return table(spark, d, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left_semi").select("r_name")


@query("j4_unsold_parts", "SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R')")
def j4_unsold_parts(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return table(spark, d, "part").join(returned, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_brand")


@query("j7_null_safe_join", "WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS k FROM documents), b AS (SELECT k, count(*) AS n FROM a GROUP BY k) SELECT doc_id, n FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def j7_null_safe_join(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("k"))
    b = a.groupBy(F.col("k").alias("bk")).agg(F.count("*").alias("n"))
    return a.join(b, F.col("k").eqNullSafe(F.col("bk"))).select("doc_id", "n")


@query("j8_multiset_pairing", "WITH a AS (SELECT l_orderkey AS k, l_linenumber AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT l_orderkey AS k, l_linenumber AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM lineitem WHERE l_returnflag = 'A') SELECT coalesce(a.k, b.k) AS k, x, y FROM a FULL JOIN b ON a.k = b.k AND a.rn = b.rn")
def j8_multiset_pairing(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    side = lambda flag, name: lines.where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias(name))
    return relational.pair_occurrences(side("R", "x"), side("A", "y"), "k", "x", "y")


@query("j11_interval_overlap", "WITH e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), w AS (SELECT user_id, ts AS a, ts + INTERVAL 30 MINUTE AS b, event_id AS w FROM e WHERE rn % 10 = 1) SELECT w AS window_id, count(*) AS n FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= a AND e.ts < b GROUP BY w")
def j11_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "ts")
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    starts = events.withColumn("rn", rn).where("rn % 10 = 1").select(F.col("user_id").alias("key"), F.col("event_id").alias("window_id"), F.col("ts").alias("low"), F.expr("ts + INTERVAL 30 MINUTES").alias("high"))
    points = events.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), "event_id")
    return relational.interval_join(starts, points, 1800).groupBy("window_id").agg(F.count("*").alias("n"))


@query("j13_alias_lookup", "WITH a AS (SELECT lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS alias, p_brand AS scope, p_partkey AS id FROM part), g AS (SELECT scope, alias, count(DISTINCT id) AS n, min(id) AS id FROM a GROUP BY ALL) SELECT scope, alias, n, CASE WHEN n = 1 THEN id END AS match, CASE WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS state FROM g")
def j13_alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    alias = F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]", ""))
    return relational.unique_aliases(table(spark, d, "part").select(alias.alias("alias"), F.col("p_brand").alias("scope"), F.col("p_partkey").alias("id")))


@query("a1_declared_counts", "WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS k, coalesce(n, 0) AS n, CAST(floor(o_totalprice / 60000) AS BIGINT) AS declared FROM orders LEFT JOIN n ON k = o_orderkey WHERE coalesce(n, 0) <> CAST(floor(o_totalprice / 60000) AS BIGINT)")
def a1_declared_counts(spark: SparkSession, d: str) -> DataFrame:
    declared = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_totalprice") / 60000).cast("long").alias("declared"))
    own = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("lk")).agg(F.count("*").alias("n"))
    rows = declared.join(own, F.col("k") == F.col("lk"), "left").select("k", F.coalesce("n", F.lit(0)).alias("n"), "declared")
    return rows.where("n <> declared")


@query("a2_uniqueness", "SELECT lang, count(*) AS n, count(DISTINCT text) AS n_distinct, count(*) = count(DISTINCT text) AS is_unique FROM documents GROUP BY lang")
def a2_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    distinct = F.count_distinct(F.sha2("text", 256))
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), distinct.alias("n_distinct"), (F.count("*") == distinct).alias("is_unique"))


@query("a3_ordered_children", "SELECT l_orderkey, string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS children FROM lineitem GROUP BY l_orderkey")
def a3_ordered_children(spark: SparkSession, d: str) -> DataFrame:
    kids = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    shown = F.transform(kids, lambda k: F.concat_ws(":", k.l_linenumber, k.l_returnflag))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(shown, ",").alias("children"))


@query("a4_ordered_hash", "SELECT conv_id, sha256(string_agg(text, ' ' ORDER BY turn)) AS hash, count(*) AS n FROM conversations GROUP BY conv_id")
def a4_ordered_hash(spark: SparkSession, d: str) -> DataFrame:
    spans = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s.text)
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(spans, " "), 256).alias("hash"), F.count("*").alias("n"))


@query("a5_null_skipping_mean", "SELECT source, round(sum(CASE WHEN quality = 1 THEN n_chars END) / count(*), 6) AS mean_over_all, round(avg(CASE WHEN quality = 1 THEN n_chars END), 6) AS mean_over_known, CASE WHEN count(toxic) <> 0 THEN round(sum(toxic)::DOUBLE / count(toxic), 9) END AS share FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def a5_null_skipping_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    good = F.when(F.col("quality") == 1, F.col("n_chars"))
    return rows.groupBy("source").agg(F.round(F.sum(good) / F.count("*"), 6).alias("mean_over_all"), F.round(F.avg(good), 6).alias("mean_over_known"), F.round(ratio(F.sum("toxic"), F.count("toxic")), 9).alias("share"))


@query("a6_grouping_sets", "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, CAST(grouping(lang) * 2 + grouping(source) AS BIGINT) AS level FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def a6_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    sums = docs.groupingSets([[F.col("lang")], [F.col("source")], []], "lang", "source")
    return sums.agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), (F.grouping("lang").cast("long") * 2 + F.grouping("source")).cast("long").alias("level"))


@query("a7_confusion", "SELECT quality, count(*) FILTER (WHERE n_chars < 500) AS short, count(*) FILTER (WHERE n_chars >= 500 AND n_chars < 2000) AS medium, count(*) FILTER (WHERE n_chars >= 2000) AS long FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def a7_confusion(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    guess = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")
    return rows.withColumn("guess", guess).groupBy("quality").pivot("guess", ["short", "medium", "long"]).count().na.fill(0)


@query("a8_flag_counts", "WITH f AS (SELECT unnest(list_filter([CASE WHEN l_discount > 0.05 THEN 'discount' END, CASE WHEN l_tax > 0.04 THEN 'tax' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL)) AS flag FROM lineitem) SELECT flag, count(*) AS n FROM f GROUP BY flag")
def a8_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    flags = F.array_compact(F.array(F.when(F.col("l_discount") > 0.05, "discount"), F.when(F.col("l_tax") > 0.04, "tax"), F.when(F.col("l_returnflag") == "R", "returned")))
    return table(spark, d, "lineitem").select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("a9_sums_vs_declared", "WITH s AS (SELECT l_orderkey, round(sum(l_extendedprice * (1 + l_tax) * (1 - l_discount)), 2) AS total FROM lineitem GROUP BY 1) SELECT coalesce(o_orderkey, l_orderkey) AS orderkey, round(o_totalprice, 2) AS declared, total, CASE WHEN o_orderkey IS NULL THEN 'undeclared' WHEN total IS NULL THEN 'empty' WHEN abs(total - o_totalprice) <= 0.5 * o_totalprice THEN 'match' ELSE 'differs' END AS state FROM orders FULL JOIN s ON o_orderkey = l_orderkey")
def a9_sums_vs_declared(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 + F.col("l_tax")) * (1 - F.col("l_discount"))), 2).alias("total"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(own, F.col("o_orderkey") == F.col("l_orderkey"), "full")
    state = F.when(F.col("o_orderkey").isNull(), "undeclared").when(F.col("total").isNull(), "empty").when(F.abs(F.col("total") - F.col("o_totalprice")) <= 0.5 * F.col("o_totalprice"), "match").otherwise("differs")
    return rows.select(F.coalesce("o_orderkey", "l_orderkey").alias("orderkey"), F.round("o_totalprice", 2).alias("declared"), "total", state.alias("state"))


@query("a10_duplicates", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1 HAVING count(*) > 1")
def a10_duplicates(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash"))
    return groups.agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.count_distinct("source").alias("n_sources")).where("n > 1")


@query("a11_pooled_and_worst", "WITH o AS (SELECT l_orderkey AS k, sum(l_discount) / sum(1) AS rate, sum(l_discount) AS e, count(*) AS n, l.o_custkey AS c FROM lineitem JOIN orders l ON o_orderkey = l_orderkey GROUP BY l_orderkey, l.o_custkey), r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY rate DESC, k) AS rn FROM (SELECT k, round(rate, 9) AS rate, e, n, c FROM o)) SELECT c AS custkey, round(sum(e) / sum(n), 9) AS pooled, max(CASE WHEN rn = 1 THEN k END) AS worst, round(max(rate), 6) AS worst_rate FROM r GROUP BY c")
def a11_pooled_and_worst(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_discount").alias("e"), F.count("*").alias("n"))
    rows = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("rate", F.round(F.col("e") / F.col("n"), 9))
    worst = F.max_by("l_orderkey", F.struct("rate", -F.col("l_orderkey")))
    return rows.groupBy(F.col("o_custkey").alias("custkey")).agg(F.round(F.sum("e") / F.sum("n"), 9).alias("pooled"), worst.alias("worst"), F.round(F.max("rate"), 6).alias("worst_rate"))


@query("a12_set_union", "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source")
def a12_set_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("a13_bounds", "SELECT user_id, min(value) AS low, max(value) AS high, min(ts)::VARCHAR AS first_ts, max(ts)::VARCHAR AS last_ts FROM events GROUP BY user_id")
def a13_bounds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min("ts").cast("string").alias("first_ts"), F.max("ts").cast("string").alias("last_ts"))


@query("a15_family_consistency", "SELECT o_custkey AS family, count(*) AS n, count(DISTINCT o_orderstatus || '|' || o_orderpriority) AS n_signatures, count(DISTINCT o_orderstatus || '|' || o_orderpriority) = 1 AS consistent FROM orders GROUP BY o_custkey")
def a15_family_consistency(spark: SparkSession, d: str) -> DataFrame:
    return relational.consistency(table(spark, d, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"]).withColumnRenamed("o_custkey", "family")


@query("a16_common_entries", "WITH m AS (SELECT l_orderkey AS g, l_linenumber AS i, unnest(['flag', 'status', 'supplier']) AS k, unnest([l_returnflag, l_linestatus, l_suppkey::VARCHAR]) AS v FROM lineitem), n AS (SELECT l_orderkey AS g, count(*) AS n FROM lineitem GROUP BY 1) SELECT m.g AS orderkey, k AS entry_key, min(v) AS entry_value FROM m JOIN n ON m.g = n.g GROUP BY m.g, k HAVING count(*) = min(n.n) AND count(DISTINCT v) = 1")
def a16_common_entries(spark: SparkSession, d: str) -> DataFrame:
    entries = F.create_map(F.lit("flag"), "l_returnflag", F.lit("status"), "l_linestatus", F.lit("supplier"), F.col("l_suppkey").cast("string"))
    return relational.common_entries(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), entries.alias("entries")), "orderkey", "entries")


@query("w3_ordinals", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS INTEGER) AS ordinal FROM lineitem")
def w3_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1).alias("ordinal"))


@query("w4_latest_decision", "SELECT user_id, event_type AS field, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def w4_latest_decision(spark: SparkSession, d: str) -> DataFrame:
    latest = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("field")).agg(latest.alias("e")).select("user_id", "field", "e.event_id", "e.value")


@query("w5_first_run", "SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 THEN 'run' ELSE 'rerun' END AS role FROM orders WHERE o_orderstatus = 'F'")
def w5_first_run(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey", F.when(rn == 1, "run").otherwise("rerun").alias("role"))


@query("w8_repeated_lines", "WITH l AS (SELECT DISTINCT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents) SELECT sha256(line) AS line_hash, count(*) AS n_docs FROM l WHERE line <> '' GROUP BY line HAVING count(*) >= 3")
def w8_repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    hashed = lines.select("doc_id", F.trim("line").alias("line")).where("line <> ''").select("doc_id", F.sha2("line", 256).alias("line_hash")).distinct()
    return hashed.groupBy("line_hash").agg(F.count("*").alias("n_docs")).where("n_docs >= 3")


@query("w9_running_header", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header FROM events")
def w9_running_header(spark: SparkSession, d: str) -> DataFrame:
    head = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True)
    return table(spark, d, "events").select("event_id", head.over(upto_here(["user_id"], ["ts", "event_id"])).alias("header"))


@query("w10_previous_clause", "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_role FROM conversations")
def w10_previous_clause(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("turn").over(w).alias("previous"), F.lag("role").over(w).alias("previous_role"))


@query("w12_rank_contiguity", "WITH r AS (SELECT l_orderkey, l_linenumber AS rank, l_extendedprice AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice DESC) AS rn, lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice DESC) AS before FROM lineitem) SELECT l_orderkey AS list_id, bool_and(rank = rn) AS contiguous, bool_and(before IS NULL OR before >= score) AS non_increasing FROM r GROUP BY l_orderkey")
def w12_rank_contiguity(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("list_id"), F.col("l_linenumber").alias("rank"), F.col("l_extendedprice").alias("score"))
    return relational.ranking_checks(rows)


@query("w13_worst_status", "SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) WHEN 1 THEN 'F' WHEN 2 THEN 'O' ELSE 'P' END AS status FROM orders GROUP BY o_custkey")
def w13_worst_status(spark: SparkSession, d: str) -> DataFrame:
    priority = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", priority).alias("status"))


@query("u2_first_occurrences", "WITH f AS (SELECT l_suppkey AS k, min(l_orderkey * 10 + l_linenumber) AS first_at FROM lineitem GROUP BY 1) SELECT k, first_at FROM f")
def u2_first_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_at"))


@query("u3_two_way_difference", "(SELECT o_custkey AS k, 'missing' AS state FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey, 'missing' FROM orders WHERE o_orderstatus = 'O') UNION ALL (SELECT o_custkey, 'extra' FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey, 'extra' FROM orders WHERE o_orderstatus = 'F')")
def u3_two_way_difference(spark: SparkSession, d: str) -> DataFrame:
    of = lambda s: table(spark, d, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return of("F").subtract(of("O")).withColumn("state", F.lit("missing")).union(of("O").subtract(of("F")).withColumn("state", F.lit("extra")))


@query("u6_exact_accounting", "SELECT doc_id, (CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END + CASE WHEN lang = 'en' AND n_chars < 500 THEN 1 ELSE 0 END + CASE WHEN source = 'src1' THEN 1 ELSE 0 END)::BIGINT AS n FROM documents WHERE (CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END + CASE WHEN lang = 'en' AND n_chars < 500 THEN 1 ELSE 0 END + CASE WHEN source = 'src1' THEN 1 ELSE 0 END) <> 1")
def u6_exact_accounting(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    parts = [docs.where(c).select("doc_id") for c in ("n_chars >= 500", "lang = 'en' AND n_chars < 500", "source = 'src1'")]
    return relational.misaccounted(docs.select("doc_id"), parts, "doc_id")


@query("x1_clean_text", "SELECT p_partkey, trim(regexp_replace(translate(p_name || chr(8211) || '²' || chr(160), '⁰¹²³⁴⁵⁶⁷⁸⁹‐‑‒–—―−' || chr(160), '0123456789------- '), '\\s+', ' ', 'g')) AS cleaned, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') || '2' AS key FROM part")
def x1_clean_text(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("p_name", F.lit("–² "))
    return table(spark, d, "part").select("p_partkey", text.clean_text(raw).alias("cleaned"), text.compact_key(raw).alias("key"))


@query("x5_term_index", "WITH t AS (SELECT p_partkey, p_size % 6 AS y, p_partkey % 4 AS s FROM part) SELECT p_partkey, CAST((CASE WHEN y BETWEEN 1 AND 4 THEN y ELSE 99 END) * 10 + (CASE WHEN s BETWEEN 1 AND 2 THEN s WHEN s = 3 THEN 3 ELSE 9 END) AS INTEGER) AS term_index FROM t")
def x5_term_index(spark: SparkSession, d: str) -> DataFrame:
    names = {1: "First", 2: "2nd", 3: "Third", 4: "4th"}
    year, semester = F.lit("Standing in first year only"), F.lit("any")
    for k, v in names.items():
        year = F.when(F.col("p_size") % 6 == k, f"{v} Year").otherwise(year)
    for k, v in ((1, "First Semester"), (2, "Second  Semester"), (3, "Summer")):
        semester = F.when(F.col("p_partkey") % 4 == k, v).otherwise(semester)
    return table(spark, d, "part").select("p_partkey", text.year_semester(F.concat_ws(" / ", year, semester)).alias("term_index"))


@query("x6_printed_units", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN (p_size + p_size % 4)::DOUBLE WHEN 1 THEN p_size::DOUBLE END AS units FROM part")
def x6_printed_units(spark: SparkSession, d: str) -> DataFrame:
    printed = F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" / ", "p_size", F.col("p_size") % 4)).when(F.col("p_partkey") % 3 == 1, F.col("p_size").cast("string")).otherwise(F.concat(F.col("p_size"), F.lit(" units")))
    return table(spark, d, "part").select("p_partkey", text.printed_total(printed).alias("units"))


@query("x12_token_estimate", "SELECT doc_id, greatest(ceil(length(text) / 3.0), ceil(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) * 1.8::DOUBLE))::BIGINT AS n_tokens FROM documents")
def x12_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("n_tokens"))


@query("x13_token_text", "SELECT doc_id, sha256(array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ')) AS hash, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))::INTEGER AS n FROM documents")
def x13_token_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(text.token_text(F.col("text")), 256).alias("hash"), F.size(text.tokens(F.col("text"))).alias("n"))


@query("x14_item_jaccard", "WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS a FROM benchmark) SELECT x.item_id, round(CASE WHEN len(list_distinct(list_concat(x.a, y.a))) = 0 THEN 0 ELSE len(list_intersect(x.a, y.a))::DOUBLE / len(list_distinct(list_concat(x.a, y.a))) END, 9) AS jaccard FROM t x JOIN t y ON y.item_id = x.item_id + 1")
def x14_item_jaccard(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select("item_id", F.array_distinct(text.tokens(F.col("text"))).alias("a"))
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    return items.join(after, "item_id").select("item_id", F.round(text.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


@query("x15_levenshtein", "SELECT a.p_partkey, levenshtein(a.p_name, b.p_name)::INTEGER AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def x15_levenshtein(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return parts.join(after, "p_partkey").select("p_partkey", F.levenshtein("p_name", "other").alias("distance"))


@query("x16_hash_split", "SELECT doc_id, ('0x' || substr(sha256('v1:' || doc_id), 1, 16))::UBIGINT % 100 < 20 AS in_final FROM documents")
def x16_hash_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.hash_split("v1", F.col("doc_id").cast("string"), 20).alias("in_final"))


@query("f10_identity_guard", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+|[0-9]{9,}')")
def f10_identity_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(text.holds_identity(F.col("text"))).select("doc_id")


@query("x21_kept_words", "SELECT conv_id, turn, array_to_string(regexp_extract_all(lower(text), '\\b(not|no|never|without|before|after|until|during|next|last)\\b'), ',') AS words FROM conversations")
def x21_kept_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.term_words(F.col("text")), ",").alias("words"))


@query("x25_timestamp_plausibility", "SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2000-01-01' AND ts < TIMESTAMP '2100-01-01') AS n_plausible, count(*) AS n FROM events GROUP BY event_type")
def x25_timestamp_plausibility(spark: SparkSession, d: str) -> DataFrame:
    ok = F.expr("ts >= TIMESTAMP_NTZ '2000-01-01' AND ts < TIMESTAMP_NTZ '2100-01-01'")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.when(ok, 1)).alias("n_plausible"), F.count("*").alias("n"))


@query("w1_top_rows", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def w1_top_rows(spark: SparkSession, d: str) -> DataFrame:
    return top_rows(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "o_totalprice")
