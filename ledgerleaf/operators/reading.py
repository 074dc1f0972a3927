"""Reading of printed and typed text: labels with places, terms, dictionary matches, plans, grades and documents' parts."""

from __future__ import annotations

import difflib
import unicodedata
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, top_rows, upto_here

#: Ordinals and the words for years and semesters, English and Filipino.
YEARS = {1: "first|1st|una|unang", 2: "second|2nd|ikalawa|ikalawang", 3: "third|3rd|ikatlo|ikatlong", 4: "fourth|4th|ikaapat|ika-apat"}
YEAR_WORD, SEMESTER_WORD = "year|yr|taon|antas", "semester|sem|semestre"
SEMESTER = r"(?i)\b(1st|2nd|first|second)\s+sem(?:ester)?\b|\bsummer\b|\bmidyear\b"
#: An "ordinal year" before one of these isn't a banner.
NOT_A_BANNER = "standing|passed|completed|level"


def label_places(text: Column, pattern: str) -> Column:
    """(at, label) of every match of a pattern, places from 1; of equal neighbours only the first stays."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)

    def step(s: Column, i: Column) -> Column:
        label = F.lower(F.element_at(found, i))
        at = s.at + F.length(F.element_at(between, i))
        entry = F.struct(at.alias("at"), label.alias("label"))
        again = (F.size(s.out) > 0) & (F.element_at(s.out, -1).label == label)
        return F.struct((at + F.length(label)).cast("int").alias("at"), F.when(again, s.out).otherwise(F.concat(s.out, F.array(entry))).alias("out"))

    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<at:int,label:string>>").alias("out"))
    places = F.aggregate(F.sequence(F.lit(1), F.size(found)), zero, step, lambda s: s.out)
    return F.when(F.size(found) == 0, F.array().cast("array<struct<at:int,label:string>>")).otherwise(places)


def banner_split(text: Column) -> dict[str, Column]:
    """A line's leading and trailing year banner, and what lies between."""
    ordinals = "|".join(YEARS.values())
    banner = rf"(?:{ordinals})\s+(?:{YEAR_WORD})"
    front, back = rf"(?i)^\s*({banner})\b(?!\s+(?:{NOT_A_BANNER}))", rf"(?i)\b({banner})\s*$"
    lead = F.lower(F.regexp_extract(text, front, 1))
    rest = F.regexp_replace(text, front, "")
    trail = F.lower(F.regexp_extract(rest, back, 1))
    return {"lead": lead, "trail": trail, "middle": F.trim(F.regexp_replace(rest, back, ""))}


def parsed_term(text: Column) -> dict[str, Column]:
    """The year and semester (3 is summer) that a text names by ordinals; null where it names none."""
    year, semester = F.lit(None).cast("int"), F.when(text.rlike(r"(?i)\b(summer|midyear|tag-init)\b"), 3)
    for n, words in reversed(YEARS.items()):
        year = F.when(text.rlike(rf"(?i)\b(?:{words})\s+(?:na\s+)?(?:{YEAR_WORD})\b"), n).otherwise(year)
        if n < 3:
            semester = F.when(text.rlike(rf"(?i)\b(?:{words})\s+(?:na\s+)?(?:{SEMESTER_WORD})\b"), n).otherwise(semester)
    return {"year": year, "semester": semester}


def carried_terms(turns: DataFrame, conversation: str, order: list[str], text: str) -> DataFrame:
    """Adds year and semester of each turn; what a turn doesn't name is carried on from the last one that did."""
    w = upto_here([conversation], order)
    return turns.withColumns({k: F.last(c, ignorenulls=True).over(w) for k, c in parsed_term(F.col(text)).items()})


def expanded(text: Column, words: dict[str, str]) -> Column:
    """Shorthand words written out, in whole words of any case; everything else stays as it is."""
    table = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\w+|\W+"), F.lit(0)), lambda w: F.coalesce(F.element_at(table, F.lower(w)), w)), "")


def query_issue(text: Column, most_chars: int = 4000, most_bytes: int = 8192) -> Column:
    """What is wrong with a question: empty, too long in code points or bytes, control characters; else none."""
    shown = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(shown) == 0, "empty").when(F.length(shown) > most_chars, "too_long").when(F.octet_length(shown) > most_bytes, "too_many_bytes").when(shown.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), "control_characters").otherwise("none")


def grade_rows(lines: DataFrame, aliases: DataFrame) -> DataFrame:
    """(line_id, id, grade, units): the course of each line, by its longest alias, and the marks printed after it.

    ``aliases`` has alias and id. The alias must stand at word borders; marks are 1.00 to 5.00 in quarters, or INC, DRP, P.
    """
    token = F.col("line").alias("line")
    words = lines.select("line_id", token, F.posexplode(F.split(F.lower("line"), " ")).alias("at", "w"))
    starts = words.select("line_id", "line", "at", "w")
    keyed = aliases.select("id", F.lower("alias").alias("alias"), F.element_at(F.split(F.lower("alias"), " "), 1).alias("first"))
    near = starts.join(keyed, F.col("w") == F.col("first"))
    words = F.split(F.lower("line"), " ")
    rest = F.array_join(F.slice(words, F.col("at") + 1, F.size(words)), " ")
    held = near.withColumn("rest", rest).where(F.expr("rest = alias OR startswith(rest, concat(alias, ' '))"))
    best = top_rows(held, ["line_id"], [F.desc(F.length("alias")), F.col("at"), F.col("id")]).drop("_rank")
    after = F.expr("substring(rest, length(alias) + 1)")
    grade = F.regexp_extract(F.upper(after), r"(?:^|\s)([1-4]\.(?:00|25|50|75)|5\.00|INC|DRP|P)(?:\s|$)", 1)
    units = F.regexp_extract(after, r"(?:^|\s)(\d{1,2})(?:\s|$)", 1)
    return best.select("line_id", "id", F.when(grade != "", grade).alias("grade"), F.when(units != "", units.cast("int")).alias("units"))


def dictionary_matches(texts: DataFrame, terms: DataFrame, longest: int) -> DataFrame:
    """(text_id, start, term, id): terms that a text's tokens hold, the longest first, none overlapping another.

    ``texts`` has text_id and tokens, ``terms`` has term (tokens joined by blanks, at most ``longest``) and id. Runs of
    every length are equi-joined with the terms; the few found in a text are then taken greedily: longest, then earliest.
    """
    cuts = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("tokens") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("tokens", i, n), " "))
    runs = [texts.select("text_id", F.posexplode(cuts(n)).alias("start", "term"), F.lit(n).alias("n")).where("term <> ''") for n in range(1, longest + 1)]
    sized = terms.select("term", "id", F.size(F.split("term", " ")).alias("n")).groupBy("term", "n").agg(F.min("id").alias("id"))
    found = reduce(DataFrame.union, (r.where(F.size(F.split("term", " ")) == F.col("n")) for r in runs)).join(sized, ["term", "n"])
    entry = F.struct((-F.col("n")).alias("down"), "start", "n", "term", "id")
    kind = "array<struct<down:int,start:int,n:int,term:string,id:bigint>>"
    sorted_ = found.groupBy("text_id").agg(F.array_sort(F.collect_list(entry)).cast(kind).alias("all"))
    free = lambda taken, x: ~F.exists(taken, lambda t: (x.start < t.start + t.n) & (t.start < x.start + x.n))
    taken = F.aggregate("all", F.array().cast(kind), lambda s, x: F.when(free(s, x), F.concat(s, F.array(x))).otherwise(s))
    return sorted_.select("text_id", F.explode(taken).alias("m")).select("text_id", "m.start", "m.term", "m.id")


def attached(items: DataFrame, regions: DataFrame, tolerance: float) -> DataFrame:
    """(item, region): the region of the same page that holds an item's centre, else the only nearest one that ends at
    most ``tolerance`` above it and overlaps it sideways; null where there is none, or a tie.

    Boxes are left, top, right and bottom with the origin at the top. Equal boxes of a page are one before any are
    compared, so copies take no pairs.
    """
    box = ["page", "left", "right", "top", "bottom"]
    x, y = (F.col("left") + F.col("right")) / 2, (F.col("top") + F.col("bottom")) / 2
    own = items.select(*box).distinct().select(*box, x.alias("x"), y.alias("y"))
    of = regions.groupBy(*(F.col(c).alias(f"r_{c}") for c in box)).agg(F.count("*").alias("r_n"), F.min("region").alias("r_region"))
    pairs = own.join(of, (F.col("page") == F.col("r_page")) & (F.col("r_left") <= F.greatest("x", "right")) & (F.col("r_right") >= F.least("x", "left")) & (F.col("r_top") <= F.col("y")) & (F.col("r_bottom") >= F.col("y") - tolerance))
    inside = F.col("x").between(F.col("r_left"), F.col("r_right")) & F.col("y").between(F.col("r_top"), F.col("r_bottom"))
    far = F.when(inside, F.lit(-1.0)).when(F.col("r_bottom") <= F.col("y"), F.col("y") - F.col("r_bottom"))
    near = pairs.withColumn("far", far).where("far IS NOT NULL").groupBy(*box, "far").agg(F.sum("r_n").alias("n"), F.min("r_region").alias("region"))
    best = near.groupBy(*box).agg(F.min(F.struct("far", "n", "region")).alias("best")).select(*box, "best.*")
    # An item may have several boxes on a page.
    told, own = items.select(*box, "item").join(best, box, "left"), Window.partitionBy("page", "item")
    told = told.withColumn("least", F.col("far") == F.min("far").over(own))
    told = told.withColumns({"all": F.sum(F.when(F.col("least"), F.col("n"))).over(own), "one": F.min(F.when(F.col("least"), F.col("region"))).over(own)})
    return told.select("item", F.when(F.col("all") == 1, F.col("one")).alias("region"))


def plan_terms(plans: DataFrame) -> DataFrame:
    """(plan_id, term_idx, year, semester, course): plan texts like "Y1 first: A 1, A 2; Y1 summer: B 3", a row a course.

    Terms are numbered as written, from 1; a part that doesn't read so has a null year and no course.
    """
    parts = plans.select("plan_id", F.posexplode(F.split("plan", r"\s*;\s*")).alias("at", "part"))
    read = parts.withColumn("year", F.regexp_extract("part", r"(?i)^y(\d)\s+(first|second|summer)\s*:", 1).cast("string")).withColumn("semester", F.lower(F.regexp_extract("part", r"(?i)^y(\d)\s+(first|second|summer)\s*:", 2)))
    courses = F.filter(F.transform(F.split(F.regexp_replace("part", r"^[^:]*:", ""), ","), lambda c: F.upper(F.trim(c))), lambda c: c != "")
    ok = F.col("year") != ""
    return read.select("plan_id", (F.col("at") + 1).alias("term_idx"), F.when(ok, F.col("year").cast("int")).alias("year"), F.when(ok, F.col("semester")).alias("semester"), F.explode_outer(F.when(ok, courses)).alias("course"))


def printed_order(rows: DataFrame, partition: list[str]) -> DataFrame:
    """Adds place: rows as a reader meets them, by term, page, from the top (the origin is at the bottom), from the left."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy("term", "page", F.desc("top"), "left", "id")))


def course_order(rows: DataFrame, partition: list[str]) -> DataFrame:
    """Adds place: by term (year * 10 + semester, unknown last), table, column group and row."""
    term = F.coalesce("year", F.lit(99)) * 10 + F.coalesce("semester", F.lit(9))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy(term, "tab", "grp", "row", "id")))


def without_footnotes(text: Column) -> dict[str, Column]:
    """A text without its trailing footnote marks (superscripts, stars, daggers, bracketed letters or numbers), and these."""
    marks = r"(?:\s*(?:[*†‡¹²³⁴⁵⁶⁷⁸⁹⁰]+|\[[0-9a-z]{1,2}\]|\((?:[0-9]|[a-z])\)))+\s*$"
    return {"plain": F.regexp_replace(text, marks, ""), "marks": F.trim(F.regexp_extract(text, f"({marks})", 1))}


def style(text: Column, function_words: dict[str, list[str]]) -> Column:
    """The language with the most function words in a text, by the order given where equal; null without any."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))
    best, most = F.lit(None).cast("string"), F.lit(0)
    among = lambda own: F.size(F.filter(words, lambda w: w.isin(own)))
    for lang, own in function_words.items():
        n = among(own)
        best, most = F.when(n > most, lang).otherwise(best), F.greatest(most, n)
    return best


def program_of(curriculum: Column) -> Column:
    """A program's id from that of its curriculum: without a trailing year and revision."""
    return F.regexp_replace(F.regexp_replace(curriculum, r"-r\d+$", ""), r"-\d{4}(?:-\d{4})?$", "")


@F.pandas_udf(T.StructType([T.StructField("missing", T.StringType()), T.StructField("invented", T.StringType())]))
def character_diff(read: pd.Series, printed: pd.Series) -> pd.DataFrame:
    """What a reading lacks of the printed text, and what it has that isn't printed, as the characters in order."""

    def one(a: str | None, b: str | None) -> tuple[str, str]:
        a, b, missing, invented = a or "", b or "", [], []
        for kind, i, j, k, m in difflib.SequenceMatcher(None, b, a, autojunk=False).get_opcodes():
            if kind in ("delete", "replace"):
                missing.append(b[i:j])
            if kind in ("insert", "replace"):
                invented.append(a[k:m])
        return "".join(missing), "".join(invented)

    return pd.DataFrame([one(a, b) for a, b in zip(read, printed, strict=True)], columns=["missing", "invented"])


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    """A text as an id scanner should see it: percent escapes undone up to three times, no format characters, compatible
    and case-folded forms."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        for _ in range(3):
            t = unquote(t)
        return unicodedata.normalize("NFKC", "".join(c for c in t if unicodedata.category(c) != "Cf")).casefold()

    return text.map(one)


def foreign_ids(rows: DataFrame, key: str, text: str, pattern: str, own: str) -> DataFrame:
    """(key, token): ids of the form ``pattern`` in a text that don't begin with the row's own namespace."""
    tokens = rows.select(key, own, F.explode(F.array_distinct(F.regexp_extract_all(folded(F.col(text)), F.lit(pattern), F.lit(0)))).alias("token"))
    return tokens.where(~F.startswith(F.col("token"), F.lower(own))).select(key, "token")


def key_paths(rows: DataFrame, key: str, document: str, names: list[str]) -> DataFrame:
    """(key, path): where a JSON document has a key of one of the names, at any depth, as a.b.c.

    Objects are opened level by level until none is left; arrays count by their elements' places.
    """
    level = rows.select(key, F.lit("").alias("path"), F.col(document).alias("body")).where("body IS NOT NULL")
    found = None
    while True:
        # One explode for both kinds: an object's keys by name, an array's elements by place.
        is_object = F.col("body").rlike(r"^\s*\{")
        inner = F.when(is_object, F.transform(F.map_entries(F.from_json("body", "map<string,string>")), lambda e: F.struct(e.key.alias("name"), e.value.alias("body")))).otherwise(F.transform(F.from_json("body", "array<string>"), lambda x, i: F.struct(i.cast("string").alias("name"), x.alias("body"))))
        opened = level.where(r"body RLIKE '^\\s*[\\[{]'").select(key, "path", is_object.alias("own"), F.explode(inner).alias("e"))
        joined = F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), F.col("e.name"))
        each = cut(opened.select(key, "own", F.col("e.name").alias("name"), joined.alias("path"), F.col("e.body").alias("body")))
        hits = each.where(F.col("own") & F.lower("name").isin([n.lower() for n in names])).select(key, "path")
        found = hits if found is None else found.union(hits)
        level = each.where(r"body RLIKE '^\\s*[\\[{]'").select(key, "path", "body")
        if level.isEmpty():
            return found
