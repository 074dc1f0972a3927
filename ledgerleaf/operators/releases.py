"""Releases and their checks: pointers, designations, coverage; rule exports and guards; session and upload replay; reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import similarity
from .common import cut, ratio, upto_here


def membership_faults(members: DataFrame, known: DataFrame, declared: DataFrame) -> DataFrame:
    """(release, fault, n) of drafts: members named twice, members that aren't known, and a count other than declared.

    ``members`` has release and id, ``known`` id, ``declared`` release and n_declared. A draft may be created without any.
    """
    twice = members.groupBy("release", "id").count().where("count > 1").groupBy("release").agg(F.count("*").alias("n")).select("release", F.lit("named_twice").alias("fault"), "n")
    strange = members.select("release", "id").distinct().join(known, "id", "left_anti").groupBy("release").agg(F.count("*").alias("n")).select("release", F.lit("unknown_member").alias("fault"), "n")
    sizes = members.groupBy("release").agg(F.count_distinct("id").alias("n"))
    other = declared.join(sizes, "release", "left").na.fill(0, ["n"]).where("n <> n_declared").select("release", F.lit("other_count").alias("fault"), "n")
    return twice.union(strange).union(other)


def pointer_moves(events: DataFrame, valid: DataFrame) -> DataFrame:
    """(space, seq, release, action, applied, active, superseded) of a log of activations and rollbacks.

    An activation applies if its release is valid; a rollback if its release was active before. ``active`` is the space's
    release after the event, ``superseded`` the one that the event replaced. Events have space, seq, release, action.
    """
    w = upto_here(["space"], ["seq"])
    rows = events.join(valid.select("release").distinct().withColumn("ok", F.lit(True)), "release", "left")
    started = (F.col("action") == "activate") & F.coalesce("ok", F.lit(False))
    rows = rows.withColumn("first", F.min(F.when(started, F.col("seq"))).over(Window.partitionBy("space", "release")))
    rows = rows.withColumn("applied", started | ((F.col("action") == "rollback") & F.coalesce(F.col("first") < F.col("seq"), F.lit(False))))
    rows = rows.withColumn("active", F.last(F.when(F.col("applied"), F.col("release")), ignorenulls=True).over(w))
    before = F.lag("active").over(Window.partitionBy("space").orderBy("seq"))
    return rows.select("space", "seq", "release", "action", "applied", "active", F.when(F.col("applied") & (before != F.col("release")), before).alias("superseded"))


def designation(status: Column, kind: Column, reviewed: Column, authorised: Column) -> Column:
    """Whether a release may become a research release, or the first reason why not."""
    return F.when(status != "draft", "not_a_draft").when(kind == "research", "already_research").when(~reviewed, "review_missing").when(~authorised, "authorisation_missing").otherwise("designated")


def span_coverage(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, coverage): whether half-open spans (id, start, stop) run from 0 to the size of each id without gap or overlap.

    The first that applies: none, empty_span, late_start, gap, overlap, wrong_end, else covered.
    """
    w = Window.partitionBy("id").orderBy("start", "stop")
    steps = spans.withColumn("step", F.col("start") - F.lag("stop").over(w))
    facts = steps.groupBy("id").agg(F.min("start").alias("low"), F.max("stop").alias("high"), F.max(F.col("stop") <= F.col("start")).alias("empty"), F.max(F.col("step") > 0).alias("gap"), F.max(F.col("step") < 0).alias("overlap"))
    rows = sizes.join(facts, "id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = F.when(F.col("low").isNull(), "none").when(yes("empty"), "empty_span").when(F.col("low") != 0, "late_start").when(yes("gap"), "gap").when(yes("overlap"), "overlap").when(F.col("high") != F.col("size"), "wrong_end").otherwise("covered")
    return rows.select("id", state.alias("coverage"))


def guarded(asked: DataFrame, courses: DataFrame, results: DataFrame) -> DataFrame:
    """(subject_id, owner_id, outcome, coverage, reason): results behind the root's guards.

    ``asked`` has subject_id, owner_id and curriculum, ``courses`` owner_id, curriculum and reviewed, ``results`` outcome
    and coverage. A course that the catalogue lacks, or has in another curriculum, is unknown with absent coverage; one
    whose identity isn't reviewed is unknown with partial coverage.
    """
    of = courses.select("owner_id", F.col("curriculum").alias("own"), "reviewed")
    rows = asked.join(of, "owner_id", "left").join(results, ["subject_id", "owner_id"], "left")
    reason = F.when(F.col("own").isNull(), "unknown_course").when(F.col("own") != F.col("curriculum"), "wrong_curriculum").when(~F.col("reviewed"), "identity_unreviewed")
    outcome = F.when(reason.isNotNull(), "unknown").otherwise(F.coalesce("outcome", F.lit("unknown")))
    coverage = F.when(reason == "identity_unreviewed", "partial").when(reason.isNotNull(), "absent").otherwise(F.coalesce("coverage", F.lit("absent")))
    return rows.select("subject_id", "owner_id", outcome.alias("outcome"), coverage.alias("coverage"), reason.alias("reason"))


def term_listing(courses: DataFrame) -> DataFrame:
    """(curriculum, year, term, n, units): what each term prints, for curricula all of whose courses are placed and reviewed.

    Units are null where a course has none.
    """
    whole = courses.groupBy("curriculum").agg(F.min(F.col("reviewed") & F.col("year").isNotNull() & F.col("term").isNotNull()).alias("whole")).where("whole").select("curriculum")
    units = F.when(F.count("units") == F.count("*"), F.sum("units"))
    return courses.join(whole, "curriculum", "left_semi").groupBy("curriculum", "year", "term").agg(F.count("*").alias("n"), units.alias("units"))


def ledger_faults(courses: DataFrame, reviews: DataFrame, identity: list[str]) -> DataFrame:
    """(course_id, fault): courses that share an identity, and reviews of another content or of none.

    Both have course_id; courses the columns of ``identity`` and content, reviews digest.
    """
    same = courses.groupBy(*identity).agg(F.count("*").alias("n"), F.collect_list("course_id").alias("ids")).where("n > 1").select(F.explode("ids").alias("course_id"), F.lit("identity_twice").alias("fault"))
    both = courses.select("course_id", F.sha2("content", 256).alias("own")).join(reviews.select("course_id", "digest"), "course_id", "left")
    fault = F.when(F.col("digest").isNull(), "not_reviewed").when(F.col("digest") != F.col("own"), "review_of_other_content")
    return same.union(both.select("course_id", fault.alias("fault")).where("fault IS NOT NULL"))


def exported_rule(kind: Column, reason: Column) -> dict[str, Column]:
    """How a rule leaves the ledger: a reviewed blank is no requirement, one on standing is unresolved but names no course."""
    blank, standing = F.coalesce(reason == "reviewed_empty", F.lit(False)), F.coalesce(F.startswith(reason, F.lit("standing:")), F.lit(False))
    return {"rule": F.when(blank, "verified_none").when(standing, "unresolved").otherwise(F.coalesce(kind, F.lit("unresolved"))), "course_free": standing}


def result_state(conditions: Column, body: Column, unknown: Column, coverage: Column, most: int = 128, most_bytes: int = 65_536) -> Column:
    """A rule result's state: too_large beyond the bounds, no_rule, unresolved, or resolved."""
    return F.when((conditions > most) | (F.octet_length(body) > most_bytes), "too_large").when(coverage == "absent", "no_rule").when(F.array_contains(unknown, "rule_unresolved"), "unresolved").otherwise("resolved")


def pooled_report(runs: DataFrame, marks: DataFrame) -> DataFrame:
    """(case, run, n_found, n_hits, n_relevant, n_disputed, precision, recall) over pooled judgements.

    A chunk is relevant for a case if any judge of any run marked it so; disputed if others marked it not. Cases without
    a relevant chunk have no recall. Repeated rows count once.
    """
    pool = marks.groupBy("case", "chunk").agg(F.max("relevant").alias("yes"), F.min("relevant").alias("all"))
    sizes = pool.groupBy("case").agg(F.count_if("yes").alias("n_relevant"), F.count_if(F.col("yes") & ~F.col("all")).alias("n_disputed"))
    found = runs.select("case", "run", "chunk").distinct().join(pool, ["case", "chunk"], "left")
    sums = found.groupBy("case", "run").agg(F.count("*").alias("n_found"), F.count_if(F.coalesce("yes", F.lit(False))).alias("n_hits"))
    rows = sums.join(sizes, "case", "left").na.fill(0, ["n_relevant", "n_disputed"])
    return rows.select("case", "run", "n_found", "n_hits", "n_relevant", "n_disputed", ratio(F.col("n_hits"), F.col("n_found")).alias("precision"), ratio(F.col("n_hits"), F.col("n_relevant")).alias("recall"))


def unbound(traces: DataFrame, runs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fault): traces without a run, runs without a trace, and those that differ in a field, the first by name."""
    other = runs.select(F.col(key).alias("_key"), *(F.col(f).alias(f"_{f}") for f in fields))
    both = traces.select(key, *fields).join(other, F.col(key) == F.col("_key"), "full")
    fault = F.when(F.col("_key").isNull(), "trace_without_run").when(F.col(key).isNull(), "run_without_trace")
    for f in sorted(fields):
        fault = fault.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), f"other_{f}")
    return both.select(F.coalesce(key, "_key").alias(key), fault.alias("fault")).where("fault IS NOT NULL")


def near_leaks(items: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(item_id, doc_id, similarity): items whose set of tokens is that similar (Jaccard) to a text's.

    Both have tokens. Sets are one class each before the join, so copies take no comparisons; only items meet texts.
    """
    rows = items.select(F.concat(F.lit("i"), F.col("item_id")).alias("id"), "tokens").union(texts.select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"), "tokens"))
    rows = rows.withColumn("tokens", F.array_sort(F.array_distinct("tokens"))).where("size(tokens) > 0").withColumn("digest", F.sha2(F.to_json("tokens"), 256))
    # Sets go by digest, so that they are shuffled once, and not with each row.
    classes = cut(rows.groupBy("digest").agg(F.min("id").alias("class_id"), F.first("tokens").alias("tokens"), F.max(F.startswith("id", F.lit("i"))).alias("item"), F.max(F.startswith("id", F.lit("d"))).alias("text")))
    pairs = similarity.jaccard_across(classes.where("item"), classes.where("text"), threshold)
    own = classes.where("item AND text").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.lit(1.0).alias("similarity"))
    both = cut(pairs.union(own))
    member = cut(rows.select("id", "digest").join(classes.select("digest", "class_id"), "digest").select("id", "class_id"))
    number = F.expr("CAST(substring(id, 2) AS BIGINT)")
    left = member.where("id LIKE 'i%'").select(F.col("class_id").alias("a"), number.alias("item_id"))
    right = member.where("id LIKE 'd%'").select(F.col("class_id").alias("b"), number.alias("doc_id"))
    return both.join(left, "a").join(right, "b").select("item_id", "doc_id", "similarity")


def effective_facts(stated: DataFrame, assumed: DataFrame, keep: Column) -> DataFrame:
    """(subject, course, states, conflict): what counts as known, assumptions in place of what was stated of their course.

    ``keep`` filters stated facts (such as those of a term); several states of a course are a conflict.
    """
    rest = stated.where(keep).join(assumed.select("subject", "course").distinct(), ["subject", "course"], "left_anti")
    every = rest.select("subject", "course", "state").union(assumed.select("subject", "course", "state"))
    found = every.groupBy("subject", "course").agg(F.array_sort(F.collect_set("state")).alias("states"))
    return found.withColumn("conflict", F.size("states") > 1)


def upload_replay(events: DataFrame, facts: DataFrame) -> DataFrame:
    """(session, upload, state, n_facts): each upload's last state by its log, and its facts that count.

    Only a confirmed upload's facts count; deleting it takes them away, and nothing after a deletion brings it back.
    Events have session, upload, seq and action (add, confirm, delete); facts session and upload.
    """
    state = events.groupBy("session", "upload").agg(F.max(F.col("action") == "delete").alias("gone"), F.min(F.when(F.col("action") == "add", F.col("seq"))).alias("added"), F.max(F.when(F.col("action") == "confirm", F.col("seq"))).alias("confirmed"))
    known = F.when(F.col("gone"), "deleted").when(F.col("added").isNull(), "unknown").when(F.col("confirmed") > F.col("added"), "confirmed").otherwise("pending")
    n = facts.groupBy("session", "upload").agg(F.count("*").alias("n"))
    rows = state.withColumn("state", known).join(n, ["session", "upload"], "left")
    return rows.select("session", "upload", "state", F.when(F.col("state") == "confirmed", F.coalesce("n", F.lit(0))).otherwise(0).alias("n_facts"))


def evictions(sessions: DataFrame, shard: str, cap: int) -> DataFrame:
    """(shard, session): empty sessions to drop, least recently used first, until a shard holds its cap or has no empty one."""
    total = F.count("*").over(Window.partitionBy(shard))
    order = F.row_number().over(Window.partitionBy(shard).orderBy(F.desc("empty"), "last_access", "session"))
    rows = sessions.withColumn("over", total - cap).withColumn("place", order)
    return rows.where(F.col("empty") & (F.col("place") <= F.col("over"))).select(shard, "session")


def stale(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, fault): embeddings of another content than the chunk's, of no chunk, and chunks without one."""
    both = embeddings.select("chunk_id", F.col("content_hash").alias("of")).join(chunks.select("chunk_id", F.col("content_hash").alias("own")), "chunk_id", "full")
    fault = F.when(F.col("own").isNull(), "no_chunk").when(F.col("of").isNull(), "no_embedding").when(F.col("of") != F.col("own"), "stale")
    return both.select("chunk_id", fault.alias("fault")).where("fault IS NOT NULL")


def hashed_vector(text: Column, dimension: int) -> Column:
    """A unit vector that stands in for a text's embedding: each component from a SHA-256 of the text and its place."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.conv(F.substring(F.sha2(F.concat_ws(":", text, i.cast("string")), 256), 1, 8), 16, 10).cast("double") / 2147483648.0 - 1.0)
    # A lambda's variable is worked out once: the digests once a row, and the norm once, not for each component.
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return let(raw, lambda v: let(norm(v), lambda n: F.transform(v, lambda x: x / n)))


def repair_faults(repairs: DataFrame, cells: DataFrame) -> DataFrame:
    """(repair, fault): repairs whose value doesn't stand in the cells they cite, or that cite none or unknown ones.

    Repairs have repair, doc, value and cells (an array of ids); cells doc, cell and text.
    """
    cited = repairs.select("repair", "doc", F.explode("cells").alias("cell")).join(cells, ["doc", "cell"], "left")
    texts = cited.groupBy("repair").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("texts"), F.count_if(F.col("text").isNull()).alias("lost"))
    rows = repairs.select("repair", "value").join(texts, "repair", "left")
    fault = F.when(F.col("texts").isNull(), "no_cells").when(F.col("lost") > 0, "unknown_cell").when(~F.contains(F.lower("texts"), F.lower("value")), "not_in_cells")
    return rows.select("repair", fault.alias("fault")).where("fault IS NOT NULL")


def course_checks(courses: DataFrame, texts: DataFrame) -> DataFrame:
    """(course_id, method): how a document's text confirms a course: by its printed code, by the code without blanks and
    marks, by its title, or not. Courses have course_id, doc, code and title; texts doc and text."""
    flat = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    rows = courses.join(texts, "doc", "left").withColumn("text", F.coalesce("text", F.lit("")))
    method = F.when(F.contains("text", "code"), "printed").when(F.contains(flat("text"), flat("code")), "squeezed").when(F.contains(F.lower("text"), F.lower("title")), "title").otherwise("missing")
    return rows.select("course_id", method.alias("method"))


def semantic_chunks(courses: DataFrame, budget: int) -> dict[str, DataFrame]:
    """chunks and rejects (kind, key, text, tokens): a text for each course, term and pool, within a budget of tokens.

    Courses have course_id, curriculum, term, pool (null: none), code, title and units. A term's or pool's text lists its
    courses in order; what is blank or larger than the budget is a reject, so that every row is accounted for.
    """
    line = F.concat_ws(" ", "code", "title", F.concat(F.lit("("), F.coalesce(F.col("units").cast("string"), F.lit("?")), F.lit(" units)")))
    each = courses.withColumn("line", line)
    listed = lambda kind, key, rows: rows.groupBy(key.alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", "course_id", "line"))), lambda x: x.line), "\n").alias("text")).select(F.lit(kind).alias("kind"), "key", "text")
    parts = each.select(F.lit("course").alias("kind"), F.col("course_id").cast("string").alias("key"), F.col("line").alias("text"))
    parts = parts.union(listed("term", F.concat_ws("/", "curriculum", F.col("term").cast("string")), each)).union(listed("pool", F.concat_ws("/", "curriculum", "pool"), each.where("pool IS NOT NULL")))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    sized = parts.withColumn("tokens", F.greatest(F.ceil(F.length("text") / 3), F.ceil(words * 1.8)).cast("long"))
    fits = (F.trim("text") != "") & (F.col("tokens") <= budget)
    return {"chunks": sized.where(fits), "rejects": sized.where(~fits)}


def section_health(sections: DataFrame) -> DataFrame:
    """(doc, section, health): fail, warn or ok, by what a section's rows lack.

    Rows have code, units and term. A section without a code fails; missing units or terms, and codes used twice, warn.
    """
    facts = sections.groupBy("doc", "section").agg(F.count("*").alias("n"), F.count("code").alias("codes"), F.count_distinct("code").alias("distinct"), F.count("units").alias("units"), F.count("term").alias("terms"))
    health = F.when(F.col("codes") == 0, "fail").when((F.col("codes") > F.col("distinct")) | (F.col("units") < F.col("n")) | (F.col("terms") < F.col("n")), "warn").otherwise("ok")
    return facts.select("doc", "section", health.alias("health"))
