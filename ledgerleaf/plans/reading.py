"""Queries of reading text, terms, dictionaries, places and plans."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.functions import text as T
from ledgerleaf.operators import clauses, reading

from .base import query, table

_LABEL = "CASE p_partkey % 6 WHEN 0 THEN 'First Year standing, 1st Sem' WHEN 1 THEN 'Second Year 1st Semester ' || p_name || ' 1st semester then Summer' WHEN 2 THEN p_name || ' THIRD YEAR' WHEN 3 THEN 'fourth yr ' || p_name WHEN 4 THEN 'midyear / second sem / MIDYEAR' ELSE p_name END"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name", F.expr(_LABEL).alias("label"))


_SEM = "(1st|2nd|first|second)\\s+sem(?:ester)?\\b|\\bsummer\\b|\\bmidyear\\b"


@query("x3_label_places", f"WITH l AS (SELECT p_partkey, lower({_LABEL}) AS t FROM part), m AS (SELECT p_partkey, t, regexp_extract_all(t, '\\b(?:(?:1st|2nd|first|second)\\s+sem(?:ester)?|summer|midyear)\\b') AS f, string_split_regex(t, '\\b(?:(?:1st|2nd|first|second)\\s+sem(?:ester)?|summer|midyear)\\b') AS b FROM l), e AS (SELECT p_partkey, unnest(range(1, len(f) + 1)) AS i, f, b FROM m), o AS (SELECT p_partkey, i, f[i] AS label, 1 + list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0) AS place, f[i-1] AS prev FROM e) SELECT p_partkey, label, CAST(place AS INTEGER) AS place FROM o WHERE i = 1 OR prev IS DISTINCT FROM label")
def x3_label_places(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("p_partkey", F.explode(reading.label_places(F.col("label"), reading.SEMESTER)).alias("x")).select("p_partkey", "x.label", F.col("x.at").alias("place"))


_BANNER = "(?:first|1st|una|unang|second|2nd|ikalawa|ikalawang|third|3rd|ikatlo|ikatlong|fourth|4th|ikaapat|ika-apat)\\s+(?:year|yr|taon|antas)"


@query("x4_banner_split", f"WITH l AS (SELECT p_partkey, {_LABEL} AS t FROM part), a AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)^\\s*{_BANNER}\\b\\s+(standing|passed|completed|level)') THEN '' ELSE lower(regexp_extract(t, '(?i)^\\s*({_BANNER})\\b', 1)) END AS lead FROM l), r AS (SELECT *, CASE WHEN lead = '' THEN t ELSE regexp_replace(t, '(?i)^\\s*{_BANNER}\\b', '') END AS rest FROM a) SELECT p_partkey, lead, lower(regexp_extract(rest, '(?i)\\b({_BANNER})\\s*$', 1)) AS trail, trim(regexp_replace(rest, '(?i)\\b{_BANNER}\\s*$', '')) AS middle FROM r")
def x4_banner_split(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("p_partkey", *(c.alias(k) for k, c in reading.banner_split(F.col("label")).items()))


_SAID = "CASE event_id % 8 WHEN 0 THEN 'I am in second year' WHEN 1 THEN 'unang semestre po' WHEN 2 THEN 'ikatlong taon, 2nd sem' WHEN 3 THEN 'this summer' WHEN 4 THEN 'fourth na antas' ELSE event_type END"


@query("x17_carried_terms", f"WITH t AS (SELECT user_id, event_id, ts, {_SAID} AS said FROM events), p AS (SELECT *, CASE WHEN said LIKE '%second year%' THEN 2 WHEN said LIKE '%ikatlong taon%' THEN 3 WHEN said LIKE '%fourth na antas%' THEN 4 END AS y, CASE WHEN said LIKE '%unang semestre%' THEN 1 WHEN said LIKE '%2nd sem%' THEN 2 WHEN said LIKE '%summer%' THEN 3 END AS s FROM t) SELECT event_id, last_value(y IGNORE NULLS) OVER w AS year, last_value(s IGNORE NULLS) OVER w AS semester FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def x17_carried_terms(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "events").select("user_id", "event_id", "ts", F.expr(_SAID).alias("said"))
    return reading.carried_terms(turns, "user_id", ["ts", "event_id"], "said").select("event_id", "year", "semester")


_SHORT = {"the": "that one", "and": "plus", "of": "belonging to", "in": "inside"}
_SQL_SHORT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SHORT.items())


@query("x18_expanded_shorthand", f"SELECT conv_id, turn, md5(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'), lambda w: CASE lower(w) {_SQL_SHORT} ELSE w END), '')) AS digest FROM conversations WHERE text IS NOT NULL")
def x18_expanded_shorthand(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.md5(reading.expanded(F.col("text"), _SHORT)).alias("digest"))


@query("x20_question_issues", "SELECT CASE WHEN t = '' THEN 'empty' WHEN length(t) > 4000 THEN 'too_long' WHEN strlen(t) > 8192 THEN 'too_many_bytes' WHEN regexp_matches(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') THEN 'control_characters' ELSE 'none' END AS issue, count(*) AS n FROM (SELECT trim(CASE WHEN doc_id % 9 = 0 THEN '  ' WHEN doc_id % 10 = 3 THEN substr(text, 1, 50) || chr(7) || 'x' ELSE coalesce(text, '') END) AS t FROM documents) GROUP BY 1")
def x20_question_issues(spark: SparkSession, d: str) -> DataFrame:
    shown = F.when(F.col("doc_id") % 9 == 0, "  ").when(F.col("doc_id") % 10 == 3, F.concat(F.substring("text", 1, 50), F.lit("\x07x"))).otherwise(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").groupBy(reading.query_issue(shown).alias("issue")).agg(F.count("*").alias("n"))


_LINE = "CASE WHEN p_partkey % 4 = 0 THEN '12 ' ELSE '' END || p_name || CASE p_partkey % 5 WHEN 0 THEN ' 1.25 3' WHEN 1 THEN ' INC' WHEN 2 THEN ' 2.00 12 P' WHEN 3 THEN ' 9.9 x' ELSE '' END"
_GRADES = f"""
WITH l AS (SELECT p_partkey AS line_id, lower({_LINE}) AS line FROM part), a AS (SELECT min(p_partkey) AS id, lower(p_name) AS alias FROM part GROUP BY lower(p_name) UNION ALL SELECT min(p_partkey) + 1000000, split_part(lower(p_name), ' ', 1) FROM part GROUP BY split_part(lower(p_name), ' ', 1)),
m AS (SELECT line_id, id, alias, line, instr(' ' || line || ' ', ' ' || alias || ' ') AS pos FROM l JOIN a ON contains(' ' || line || ' ', ' ' || alias || ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY length(alias) DESC, pos, id) AS r FROM m), x AS (SELECT line_id, id, substr(line, pos + length(alias)) AS rest FROM b WHERE r = 1)
SELECT line_id, id, nullif(regexp_extract(upper(rest), '(?:^|\\s)([1-4]\\.(?:00|25|50|75)|5\\.00|INC|DRP|P)(?:\\s|$)', 1), '') AS grade, TRY_CAST(nullif(regexp_extract(rest, '(?:^|\\s)(\\d{{1,2}})(?:\\s|$)', 1), '') AS INTEGER) AS units FROM x
"""


@query("x23_grade_rows", _GRADES)
def x23_grade_rows(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    lines = part.select(F.col("p_partkey").alias("line_id"), F.expr(_LINE).alias("line"))
    whole = part.groupBy(F.lower("p_name").alias("alias")).agg(F.min("p_partkey").alias("id"))
    first = part.groupBy(F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1)).alias("alias")).agg((F.min("p_partkey") + 1_000_000).alias("id"))
    return reading.grade_rows(lines, whole.union(first))


_MATCH = """
WITH RECURSIVE t AS (SELECT conv_id * 1000 + turn AS text_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM conversations WHERE text IS NOT NULL),
terms AS (SELECT array_to_string(w[1:n], ' ') AS term, n, min(text_id) AS id FROM t, (SELECT unnest([1, 2, 3]) AS n) WHERE text_id % 3 = 0 AND len(w) >= n GROUP BY ALL),
runs AS (SELECT text_id, n, unnest(range(len(w) - n + 1)) AS start, w FROM t, (SELECT unnest([1, 2, 3]) AS n) WHERE len(w) >= n),
f AS (SELECT text_id, start, r.n, term, id, row_number() OVER (PARTITION BY text_id ORDER BY r.n DESC, start, term, id) AS i FROM runs r JOIN terms s ON s.n = r.n AND s.term = array_to_string(w[start + 1:start + r.n], ' ')),
g AS (SELECT text_id, 0::BIGINT AS i, []::INTEGER[] AS taken, NULL::BIGINT AS start, NULL::VARCHAR AS term, NULL::BIGINT AS id FROM (SELECT DISTINCT text_id FROM f)
  UNION ALL SELECT f.text_id, f.i, CASE WHEN len(list_intersect(g.taken, range(f.start, f.start + f.n)::INTEGER[])) = 0 THEN list_concat(g.taken, range(f.start, f.start + f.n)::INTEGER[]) ELSE g.taken END,
    CASE WHEN len(list_intersect(g.taken, range(f.start, f.start + f.n)::INTEGER[])) = 0 THEN f.start END, f.term, f.id FROM g JOIN f ON f.text_id = g.text_id AND f.i = g.i + 1)
SELECT text_id, CAST(start AS INTEGER) AS start, term, id FROM g WHERE start IS NOT NULL
"""


@query("j12_dictionary_matches", _MATCH)
def j12_dictionary_matches(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "conversations").where("text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("tokens"))
    sizes = F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("n")
    terms = texts.where("text_id % 3 = 0").select("text_id", "tokens", sizes).where(F.size("tokens") >= F.col("n")).groupBy(F.array_join(F.slice("tokens", F.lit(1), F.col("n")), " ").alias("term")).agg(F.min("text_id").alias("id"))
    return reading.dictionary_matches(texts, terms, 3)


_BOX = {"item": ("l_orderkey % 40", "l_partkey * 10 + l_linenumber", "l_partkey % 90", "l_suppkey * 7 % 83", "l_quantity", 4), "region": ("p_partkey % 40", "p_partkey", "p_partkey * 3 % 80", "p_partkey * 7 % 70", "p_size", 9)}
_ATTACH = """
WITH i AS (SELECT DISTINCT l_orderkey % 40 AS page, l_orderkey * 10 + l_linenumber AS item, (l_partkey % 90)::DOUBLE AS l, (l_partkey % 90 + 6)::DOUBLE AS r, (l_suppkey * 7 % 83)::DOUBLE AS t, (l_suppkey * 7 % 83 + 4)::DOUBLE AS b FROM lineitem),
g AS (SELECT p_partkey % 40 AS page, p_partkey AS region, (p_partkey * 3 % 80)::DOUBLE AS l, (p_partkey * 3 % 80 + p_size)::DOUBLE AS r, (p_partkey * 7 % 70)::DOUBLE AS t, (p_partkey * 7 % 70 + 9)::DOUBLE AS b FROM part),
p AS (SELECT i.item, region, CASE WHEN (i.l + i.r) / 2 BETWEEN g.l AND g.r AND (i.t + i.b) / 2 BETWEEN g.t AND g.b THEN -1 WHEN g.b <= (i.t + i.b) / 2 AND g.b >= (i.t + i.b) / 2 - 12 AND g.l <= i.r AND g.r >= i.l THEN (i.t + i.b) / 2 - g.b END AS far FROM i JOIN g ON i.page = g.page),
m AS (SELECT item, min(far) AS least FROM p WHERE far IS NOT NULL GROUP BY item), c AS (SELECT p.item, count(*) AS n, min(region) AS region FROM p JOIN m ON m.item = p.item AND far = least GROUP BY p.item)
SELECT i.item, CASE WHEN n = 1 THEN region END AS region FROM i LEFT JOIN c ON c.item = i.item
"""


@query("j10_attached_items", _ATTACH)
def j10_attached_items(spark: SparkSession, d: str) -> DataFrame:
    box = lambda x, w, y, h: [x.cast("double").alias("left"), (x + w).cast("double").alias("right"), y.cast("double").alias("top"), (y + h).cast("double").alias("bottom")]
    items = table(spark, d, "lineitem").select((F.col("l_orderkey") % 40).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), *box(F.col("l_partkey") % 90, 6, F.col("l_suppkey") * 7 % 83, 4)).distinct()
    regions = table(spark, d, "part").select((F.col("p_partkey") % 40).alias("page"), F.col("p_partkey").alias("region"), *box(F.col("p_partkey") * 3 % 80, F.col("p_size"), F.col("p_partkey") * 7 % 70, 9))
    return reading.attached(items, regions, 12.0)


_PLAN = "'Y' || (o_custkey % 4 + 1) || ' First: px ' || o_orderkey || ', PX ' || (o_orderkey + 1) || '; y2 summer : qq ' || o_custkey || CASE WHEN o_orderkey % 3 = 0 THEN '; later maybe' ELSE '' END"


@query("p9_plan_terms", "SELECT o_orderkey AS plan_id, 1 AS term_idx, CAST(o_custkey % 4 + 1 AS INTEGER) AS year, 'first' AS semester, 'PX ' || o_orderkey AS course FROM orders UNION ALL SELECT o_orderkey, 1, CAST(o_custkey % 4 + 1 AS INTEGER), 'first', 'PX ' || (o_orderkey + 1) FROM orders UNION ALL SELECT o_orderkey, 2, 2, 'summer', 'QQ ' || o_custkey FROM orders UNION ALL SELECT o_orderkey, 3, NULL, NULL, NULL FROM orders WHERE o_orderkey % 3 = 0")
def p9_plan_terms(spark: SparkSession, d: str) -> DataFrame:
    return reading.plan_terms(table(spark, d, "orders").select(F.col("o_orderkey").alias("plan_id"), F.expr(_PLAN).alias("plan")))


@query("p10_request_digest", "SELECT o_orderkey, sha256('{\"courses\":[' || o_orderkey || ',' || o_custkey || '],\"plan\":\"' || o_orderstatus || '\",\"units\":' || (o_orderkey % 30) || '}') AS digest FROM orders")
def p10_request_digest(spark: SparkSession, d: str) -> DataFrame:
    """The digest of a request as JSON with sorted keys and no blanks."""
    body = F.struct(F.array("o_orderkey", "o_custkey").alias("courses"), F.col("o_orderstatus").alias("plan"), (F.col("o_orderkey") % 30).alias("units"))
    return table(spark, d, "orders").select("o_orderkey", F.sha2(F.to_json(body), 256).alias("digest"))


@query("w6_printed_order", "SELECT id, CAST(row_number() OVER (PARTITION BY doc ORDER BY term, page, top DESC, lft, id) AS INTEGER) AS place FROM (SELECT l_suppkey AS doc, l_linenumber AS term, l_orderkey % 5 AS page, l_quantity AS top, l_discount AS lft, l_orderkey * 10000000 + l_partkey * 10 + l_linenumber AS id FROM lineitem)")
def w6_printed_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_linenumber").alias("term"), (F.col("l_orderkey") % 5).alias("page"), F.col("l_quantity").alias("top"), F.col("l_discount").alias("left"), (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("id"))
    return reading.printed_order(rows, ["doc"]).select("id", "place")


@query("w7_course_order", "SELECT p_partkey AS id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_partkey % 11 = 0 THEN 99 ELSE p_size % 4 END * 10 + CASE WHEN p_partkey % 5 = 0 THEN 9 ELSE p_size % 3 END, p_type, p_partkey % 2, p_retailprice, p_partkey) AS INTEGER) AS place FROM part")
def w7_course_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_size") % 4).alias("year"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") % 3).alias("semester"), F.col("p_type").alias("tab"), (F.col("p_partkey") % 2).alias("grp"), F.col("p_retailprice").alias("row"))
    return reading.course_order(rows, ["p_brand"]).select("id", "place")


_NOTED = "p_name || CASE p_partkey % 5 WHEN 0 THEN '²' WHEN 1 THEN ' **' WHEN 2 THEN ' [a] (1)' WHEN 3 THEN ' (lab)' ELSE '' END"


@query("x28_without_footnotes", "SELECT p_partkey, p_name || CASE WHEN p_partkey % 5 = 3 THEN ' (lab)' ELSE '' END AS plain, CASE p_partkey % 5 WHEN 0 THEN '²' WHEN 1 THEN '**' WHEN 2 THEN '[a] (1)' ELSE '' END AS marks FROM part")
def x28_without_footnotes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.expr(_NOTED).alias("t"))
    return rows.select("p_partkey", *(c.alias(k) for k, c in reading.without_footnotes(F.col("t")).items()))


_FUNCTION = {"en": ["the", "and", "of", "to"], "de": ["der", "die", "und", "das"], "fr": ["le", "la", "et", "de"]}
_COUNT = {k: "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{x}'" for x in v) + ")))" for k, v in _FUNCTION.items()}


@query("x29_style", f"WITH c AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _COUNT.items())} FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}]+') AS w FROM documents)) SELECT doc_id, CASE WHEN greatest(en, de, fr) = 0 THEN NULL WHEN en >= de AND en >= fr THEN 'en' WHEN de >= fr THEN 'de' ELSE 'fr' END AS style FROM c")
def x29_style(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", reading.style(F.col("text"), _FUNCTION).alias("style"))


@query("x30_character_diff")
def x30_character_diff(spark: SparkSession, d: str) -> DataFrame:
    """Printed names against readings that lost or doubled a letter; by a sequence matcher, so there is no SQL."""
    read = F.expr("CASE p_partkey % 3 WHEN 0 THEN substring(p_name, 2) WHEN 1 THEN concat(p_name, 'x') ELSE replace(p_name, 'i', '1') END")
    return table(spark, d, "part").select("p_partkey", reading.character_diff(read, F.col("p_name")).alias("x")).select("p_partkey", "x.missing", "x.invented")


@query("x31_program_of", "SELECT p_partkey, lower(p_type) || '-' || (p_size % 3) AS program FROM part")
def x31_program_of(spark: SparkSession, d: str) -> DataFrame:
    curriculum = F.expr("lower(p_type) || '-' || (p_size % 3) || CASE WHEN p_partkey % 2 = 0 THEN '-2024-2025' ELSE '-2019' END || CASE WHEN p_partkey % 3 = 0 THEN '-r2' ELSE '' END")
    return table(spark, d, "part").select("p_partkey", reading.program_of(curriculum).alias("program"))


@query("f8_privileged_keys", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'a.Secret' WHEN 1 THEN 'list.1.token' END AS path FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, 'a.b.c.secret' FROM events WHERE event_id % 3 = 0")
def f8_privileged_keys(spark: SparkSession, d: str) -> DataFrame:
    body = F.expr("CASE event_id % 3 WHEN 0 THEN concat('{\"a\": {\"Secret\": 1, \"x\": \"secret: no\", \"b\": {\"c\": {\"secret\": null}}}, \"p\": ', props, '}') WHEN 1 THEN '{\"list\": [{\"k\": 1}, {\"token\": [1]}]}' ELSE props END")
    return reading.key_paths(table(spark, d, "events").select("event_id", body.alias("body")), "event_id", "body", ["secret", "token"])


@query("f9_foreign_ids", "SELECT p_partkey, 'ns' || (p_partkey % 7 + 1) || ':doc-' || p_size AS token FROM part WHERE p_partkey % 3 = 0")
def f9_foreign_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of another namespace behind percent escapes, full-width letters and a zero-width blank."""
    other = F.concat(F.lit("see NS"), F.col("p_partkey") % 7 + 1, F.lit("%253Adoc"), F.lit("​"), F.lit("－"), F.col("p_size"))
    own = F.concat(F.lit("ns"), F.col("p_partkey") % 7, F.lit(":doc-"), F.col("p_size"))
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("ns"), F.col("p_partkey") % 7, F.lit(":")).alias("own"), F.when(F.col("p_partkey") % 3 == 0, F.concat_ws(" ", other, own)).otherwise(own).alias("text"))
    return reading.foreign_ids(rows, "p_partkey", "text", r"ns\d+:doc-\d+", "own")


@query("x25_parsed_timestamps", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'unreadable' WHEN o_orderdate < TIMESTAMP '1994-01-01' THEN 'too_early' WHEN o_orderdate > TIMESTAMP '1997-01-01' THEN 'too_late' ELSE 'plausible' END AS state FROM orders) GROUP BY 1")
def x25_parsed_timestamps(spark: SparkSession, d: str) -> DataFrame:
    typed = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("on "), F.col("o_orderdate").cast("string"))).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    state = T.timestamp_state(typed, "1994-01-01", "1997-01-01")
    return table(spark, d, "orders").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("x27_json_recordset", "SELECT event_id, i AS place, event_id + i AS id, CASE WHEN i = 0 THEN NULL ELSE event_type END AS kind FROM events, (SELECT unnest([0, 1, 2])::INTEGER AS i) WHERE i < event_id % 4 UNION ALL SELECT event_id, NULL, NULL, NULL FROM events WHERE event_id % 4 = 0")
def x27_json_recordset(spark: SparkSession, d: str) -> DataFrame:
    """A JSON array of objects as rows, in its order; an empty array keeps its parent (J6, X27)."""
    rows = F.transform(F.filter(F.sequence(F.lit(0), F.lit(2)), lambda i: i < F.col("event_id") % 4), lambda i: F.struct((F.col("event_id") + i).alias("id"), F.when(i > 0, F.col("event_type")).alias("kind")))
    return T.records(table(spark, d, "events").select("event_id", F.to_json(rows).alias("body")), "event_id", "body", "id long, kind string")


@query("x19_stated_results")
def x19_stated_results(spark: SparkSession, d: str) -> DataFrame:
    """What each order's customer says of one part among others, and whether it is a premise; tests hold it against a loop."""
    pick = lambda salt, *texts: F.get(F.array(*map(F.lit, texts)), F.pmod(F.xxhash64(F.lit(salt), "o_orderkey"), F.lit(len(texts))).cast("int"))
    verb = lambda salt: pick(salt, "passed", "failed", "did not pass", "took", "hindi ko pa napapasa", "am enrolled in", "never took", "am not sure about", "")
    head = F.concat(pick(1, "I ", "My friend ", "If I ", "Yes. I "), verb(2), F.lit(" PX "), F.col("o_custkey").cast("string"), pick(3, " and ", ", but I ", ". I ", " tapos "), verb(4), F.lit(" "))
    text = F.concat("head", F.lit("QQ "), F.col("o_orderkey").cast("string"), pick(5, "", " and passed", ", not yet", " but my friend failed"))
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey").withColumn("head", head)
    claims = rows.select("o_orderkey", text.alias("text"), F.length("head").alias("course"), F.array(F.locate("PX", "head") - 1).alias("others")).withColumns({"first": F.lit(0), "last": F.length("text")})
    found = clauses.stated_results(claims)
    return found.select("o_orderkey", "stated", clauses.inside_if_clause(F.col("text"), F.col("course")).alias("premise"), clauses.enrollment_period(F.col("text")).alias("period"))
