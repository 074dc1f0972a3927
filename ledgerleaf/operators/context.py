"""Context assembly: whole retrieval with its neighbours, spans, citations, serialised forms and budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerleaf.functions.sets import any_of, within

from .common import cut, stored, top_rows
from .graphs import LEVELS, bounded_closure
from .retrieval import best_pairs


def eligible_pairs(pairs: DataFrame) -> DataFrame:
    """The (query, chunk) rows that every filter of the query lets through; an empty filter asks for nothing.

    Rows have the chunk's scope, hints, version and chunk_id, and the query's want_scope, want_hints, want_versions and
    want_chunks. A chunk without a scope is in any scope; one without hints has none of those asked for.
    """
    open_or = lambda want, test: (F.size(want) == 0) | F.coalesce(test, F.lit(False))
    return pairs.where(
        within(F.col("scope"), F.col("want_scope"))
        & open_or("want_hints", any_of(F.col("hints"), F.col("want_hints")))
        & open_or("want_versions", F.array_contains("want_versions", F.col("version")))
        & open_or("want_chunks", F.array_contains("want_chunks", F.col("chunk_id")))
    )


def retrieve(pairs: DataFrame, needs: DataFrame, k: int, threshold: float) -> DataFrame:
    """(query_id, rank, chunk_id, similarity, neighbours): the k best of the eligible chunks with what each requires.

    The threshold holds for hits only: a required neighbour comes along whatever its similarity, directly or through
    others, if it is eligible for the query and of the hit's version. ``needs`` has src and dst chunk ids.
    """
    fit = cut(eligible_pairs(pairs).select("query_id", "chunk_id", "version", "similarity"))
    hits = cut(top_rows(fit.where(F.col("similarity") >= threshold), ["query_id"], [F.desc("similarity"), F.col("chunk_id")], k))
    node = lambda c: F.struct("query_id", F.col(c).alias("chunk_id"), "version")
    own = fit.select("query_id", "version", F.col("chunk_id"))
    edges = needs.join(own.withColumnRenamed("chunk_id", "src"), "src").join(own.withColumnRenamed("chunk_id", "dst"), ["query_id", "version", "dst"])
    reached = bounded_closure(edges.select(node("src").alias("src"), node("dst").alias("dst")), hits.select(node("chunk_id").alias("root")))
    near = reached.groupBy(F.col("root.query_id").alias("query_id"), F.col("root.chunk_id").alias("chunk_id")).agg(F.array_sort(F.collect_set("node.chunk_id")).alias("neighbours"))
    none = F.array().cast("array<long>")
    return hits.join(near, ["query_id", "chunk_id"], "left").select("query_id", F.col("_rank").alias("rank"), "chunk_id", "similarity", F.coalesce("neighbours", none).alias("neighbours"))


def retrieve_among(queries: DataFrame, chunks: DataFrame, needs: DataFrame, k: int, threshold: float) -> DataFrame:
    """As ``retrieve``, of queries (query_id, q, wants) and chunks (chunk_id, v, scope, hints, version), without a row a pair.

    Filters are tried once for each kind of chunk and of query, and mask the products of blocks. Required neighbours are
    looked for from the hits alone.
    """
    wants, marks = ["want_scope", "want_hints", "want_versions"], ["scope", "hints", "version"]
    kinds = stored(chunks.select(F.struct(*marks).alias("mark")).distinct().withColumn("_kind", F.monotonically_increasing_id()))
    asked = queries.select(F.struct(*wants).alias("want")).distinct()
    any_chunk = {"want_chunks": F.array().cast("array<long>"), "chunk_id": F.lit(None).cast("long")}
    tried = eligible_pairs(asked.crossJoin(kinds).select("want", "_kind", *(F.col(f"want.{c}").alias(c) for c in wants), *(F.col(f"mark.{c}").alias(c) for c in marks)).withColumns(any_chunk))
    may = stored(tried.groupBy("want").agg(F.collect_list("_kind").alias("_fits")))
    own = queries.withColumn("w", F.struct(*wants)).join(may, F.col("w").eqNullSafe(F.col("want"))).select("query_id", "q", "_fits", F.col("want_chunks").alias("_only"))
    told = chunks.withColumn("m", F.struct(*marks)).join(kinds, F.col("m").eqNullSafe(F.col("mark"))).select("chunk_id", "v", "version", "_kind")
    found = best_pairs(own, told, k, threshold, fits=True).where(F.col("similarity") >= threshold)
    hits = cut(top_rows(found, ["query_id"], [F.desc("similarity"), F.col("chunk_id")], k))
    filters = stored(own.join(hits.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "_fits", "_only"))
    edges = stored(needs.select("src", F.col("dst").alias("chunk_id")).distinct().join(told.select("chunk_id", "version", "_kind"), "chunk_id").withColumnRenamed("chunk_id", "dst"))
    keys = ["query_id", "root", "version", "node"]
    levels = [cut(hits.select("query_id", F.col("chunk_id").alias("root"), "version", F.col("chunk_id").alias("node")).distinct())]
    while not levels[-1].isEmpty():
        step = levels[-1].join(edges.withColumnRenamed("src", "node").hint("merge"), ["node", "version"]).select("query_id", "root", "version", F.col("dst").alias("node"), "_kind")
        open_to = F.array_contains("_fits", F.col("_kind")) & ((F.size("_only") == 0) | F.array_contains("_only", F.col("node")))
        new = step.join(filters, "query_id").where(open_to).select(*keys).distinct()
        levels.append(cut(new.join(reduce(DataFrame.union, levels).hint("merge"), keys, "left_anti").select(*keys)))
        if len(levels) == LEVELS and not levels[-1].isEmpty():
            levels = [cut(reduce(DataFrame.union, levels[:-1])), levels[-1]]
    reached = reduce(DataFrame.union, levels).where("root <> node")
    near = reached.groupBy("query_id", F.col("root").alias("chunk_id"), "version").agg(F.array_sort(F.collect_set("node")).alias("neighbours"))
    near = near.groupBy("query_id", "chunk_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("neighbours")))).alias("neighbours"))
    none = F.array().cast("array<long>")
    return hits.join(near, ["query_id", "chunk_id"], "left").select("query_id", F.col("_rank").alias("rank"), "chunk_id", "similarity", F.coalesce("neighbours", none).alias("neighbours"))


def parameter_issue(k: Column, threshold: Column, n_filters: Column, n_chunks: Column) -> Column:
    """What is wrong with a request, the first that applies, or none: k is 3, 5 or 8, the threshold within -1 and 1,
    at most 32 filter values and 128 chunk ids."""
    bad = F.isnan(threshold) | ~threshold.between(-1, 1)
    issue = F.when(k.isNull() | ~k.isin(3, 5, 8), "bad_k").when(threshold.isNull() | bad, "bad_threshold")
    return issue.when(n_filters > 32, "too_many_filters").when(n_chunks > 128, "too_many_chunks").otherwise("none")


def configured(rows: DataFrame, asked: DataFrame, fields: list[str], on: str) -> DataFrame:
    """Adds configuration_equal: whether each field equals that of ``asked``, nulls alike; without a partner not."""
    other = asked.select(F.col(on).alias("_on"), *(F.col(f).alias(f"_{f}") for f in fields))
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    joined = rows.join(other, rows[on] == F.col("_on"), "left")
    return joined.withColumn("configuration_equal", same & F.col("_on").isNotNull()).select(*rows.columns, "configuration_equal")


def first_spans(spans: DataFrame) -> DataFrame:
    """Spans that say the same text at the same place are one: of each (request, locator, text) the first by position."""
    return top_rows(spans, ["request", "locator", "text"], [F.col("position"), F.col("span_id")]).drop("_rank")


def resolvable(page: Column, locator: Column, text: Column, digest: Column) -> Column:
    """Whether a citation leads somewhere: a page from 1, a place, a text, and a digest of 64 hex digits."""
    return F.coalesce((page >= 1) & (F.length(F.trim(locator)) > 0) & (F.length(F.trim(text)) > 0) & digest.rlike("^[0-9a-f]{64}$"), F.lit(False))


def serialised(rows: DataFrame, group: str, order: list[str], shared: list[str], own: list[str]) -> DataFrame:
    """(group, plain, compact, common): a group's rows as text in three forms.

    ``plain`` repeats all fields with their names on every row, ``compact`` has the values alone, and ``common`` says
    once the shared fields that all rows of the group agree in, and leaves them out of the rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = lambda cs: F.concat_ws("; ", *(F.concat(F.lit(f"{c}="), text(c)) for c in cs))
    one = {c: F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0"))) == 1 for c in shared}
    facts = rows.groupBy(group).agg(*(f.alias(f"same_{c}") for c, f in one.items()), *(F.min(text(c)).alias(f"value_{c}") for c in shared))
    head = F.concat_ws("; ", *(F.when(F.col(f"same_{c}"), F.concat(F.lit(f"{c}="), F.col(f"value_{c}"))) for c in shared))
    each = rows.join(facts, group).withColumn("rest", F.concat_ws("; ", *(F.when(~F.col(f"same_{c}"), F.concat(F.lit(f"{c}="), text(c))) for c in shared), named(own)))
    lines = F.array_sort(F.collect_list(F.struct(*order, named([*shared, *own]).alias("_plain"), F.concat_ws("|", *(text(c) for c in [*shared, *own])).alias("_compact"), "rest")))
    done = each.groupBy(group).agg(lines.alias("lines"), F.min(head).alias("head"))
    return done.select(group, F.array_join("lines._plain", "\n").alias("plain"), F.array_join("lines._compact", "\n").alias("compact"), F.concat_ws("\n", F.when(F.col("head") != "", F.col("head")), F.array_join("lines.rest", "\n")).alias("common"))


def stray_dependencies(members: DataFrame, needs: DataFrame) -> DataFrame:
    """(subject, chunk_id, needed): required chunks that the subject of the chunk that needs them doesn't have."""
    asked = members.join(needs, F.col("chunk_id") == F.col("src")).select("subject", "chunk_id", F.col("dst").alias("needed"))
    return asked.join(members.select("subject", F.col("chunk_id").alias("needed")), ["subject", "needed"], "left_anti")


def narrowed_classes(claims: DataFrame, fields: DataFrame, needs: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request, class_id) and (class_id, chunk_id): as ``narrowed``, but once for all requests of the same claims, whose
    class is named by its least request."""
    sets = claims.groupBy("request").agg(F.array_sort(F.collect_set(F.struct("subject", "claim"))).alias("claims"))
    classes = cut(sets.groupBy("claims").agg(F.min("request").alias("class_id")))
    own = sets.join(classes, "claims").select("request", "class_id")
    found = classes.select("class_id", F.inline("claims")).join(fields, ["subject", "claim"], "left")
    vague = found.groupBy("class_id", "subject").agg(F.max(F.col("chunk_id").isNull()).alias("vague"))
    whole = vague.where("vague").join(members, "subject").select("class_id", "chunk_id")
    direct = found.join(vague.where("NOT vague").select("class_id"), "class_id", "left_semi").select("class_id", "chunk_id").distinct()
    edges = needs.select("src", "dst")
    more = bounded_closure(edges, direct.select(F.col("chunk_id").alias("root")).distinct())
    through = direct.join(more, F.col("chunk_id") == F.col("root")).select("class_id", F.col("node").alias("chunk_id"))
    return own, direct.union(through).union(whole).distinct()


def narrowed(claims: DataFrame, fields: DataFrame, needs: DataFrame, members: DataFrame) -> DataFrame:
    """(request, chunk_id): the chunks that a request's claims need, with what these require in turn.

    Claims are (request, subject, claim); a claim without any reviewed field (subject, claim, chunk_id) makes its request
    ambiguous, which then gets all chunks of its subject (``members``: subject, chunk_id).
    """
    own, chunks = narrowed_classes(claims, fields, needs, members)
    return own.join(chunks, "class_id").select("request", "chunk_id")


def rendered(rows: DataFrame) -> DataFrame:
    """Adds shown: whether every value of the array ``values`` stands in ``text``, case and white space aside."""
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return rows.withColumn("shown", F.coalesce(F.forall("values", lambda v: F.contains(flat(F.col("text")), flat(v))), F.lit(False)))


def slot_faults(drafts: DataFrame, verdicts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(request, fault, n): drafts (request, claim, evidence_id) that cite unknown evidence, claims without just one
    verdict, and verdicts on claims that no draft makes."""
    cited = drafts.select("request", "evidence_id").distinct().join(evidence, ["request", "evidence_id"], "left_anti").groupBy("request").agg(F.count("*").alias("n")).select("request", F.lit("unknown_evidence").alias("fault"), "n")
    made = drafts.select("request", "claim").distinct()
    judged = verdicts.groupBy("request", "claim").agg(F.count("*").alias("times"))
    both = made.withColumn("made", F.lit(True)).join(judged, ["request", "claim"], "full")
    fault = F.when(F.col("made").isNull(), "verdict_without_claim").when(F.coalesce("times", F.lit(0)) != 1, "not_one_verdict")
    return cited.union(both.withColumn("fault", fault).where("fault IS NOT NULL").groupBy("request", "fault").agg(F.count("*").alias("n")))


def gathered(requests: DataFrame, documents: DataFrame, symbolic: DataFrame) -> DataFrame:
    """(request, route, documents, symbolic, status): the two branches of a request brought together.

    A hybrid request needs both; a branch that wasn't asked for is left out; a missing one is ``unavailable``.
    """
    d = documents.select("request", F.col("status").alias("documents"))
    s = symbolic.select("request", F.col("status").alias("symbolic"))
    rows = requests.join(d, "request", "left").join(s, "request", "left")
    doc = F.when(F.col("route") != "Symbolic", F.coalesce("documents", F.lit("unavailable")))
    sym = F.when(F.col("route") != "RAG", F.coalesce("symbolic", F.lit("unavailable")))
    worst = F.when((F.coalesce(doc, F.lit("ok")) == "ok") & (F.coalesce(sym, F.lit("ok")) == "ok"), "ok").when((F.coalesce(doc, F.lit("ok")) == "unavailable") | (F.coalesce(sym, F.lit("ok")) == "unavailable"), "unavailable").otherwise("insufficient")
    return rows.select("request", "route", doc.alias("documents"), sym.alias("symbolic"), worst.alias("status"))


def fill_down_header(rows: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """Adds part and first_row: rows of a table dealt into parts of bounded size, each beginning with the header rows.

    Rows have size, ``header`` (repeated in every part) and ``joined`` (must stay with the row before). A part begins at
    a row that isn't joined once the rows before reach the budget; see ``table_parts``.
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("block", F.sum((~F.col("joined")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def table_parts(rows: DataFrame, partition: list[str], order: list[str], budget: int) -> DataFrame:
    """(partition, part, n_rows, size): a table's body rows in parts of at most ``budget`` with the header's size in each.

    Joined rows are one block that is never cut; a block larger than the budget is a part of its own. The blocks of a
    table are folded in order by an aggregate over their sizes, so a table must fit a task; tables are many.
    """
    head = rows.where("header").groupBy(*partition).agg(F.sum("size").alias("head"))
    blocks = fill_down_header(rows.where("NOT header"), partition, order).groupBy(*partition, "block").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    lists = blocks.groupBy(*partition).agg(F.array_sort(F.collect_list(F.struct("block", "size", "n"))).alias("blocks")).join(head, partition, "left").withColumn("head", F.coalesce("head", F.lit(0)))
    zero = F.struct(F.lit(0).cast("long").alias("part"), F.lit(None).cast("long").alias("used"), F.array().cast("array<struct<part:bigint,size:bigint,n:bigint>>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        fits = s.used.isNotNull() & (s.used + b.size <= budget)
        part = F.when(fits, s.part).otherwise(s.part + 1)
        used = F.when(fits, s.used + b.size).otherwise(F.col("head") + b.size)
        return F.struct(part.alias("part"), used.alias("used"), F.concat(s.out, F.array(F.struct(part.alias("part"), b.size.alias("size"), b.n.alias("n")))).alias("out"))

    folded = lists.withColumn("o", F.explode(F.aggregate("blocks", zero, step, lambda s: s.out)))
    return folded.groupBy(*partition, "head", F.col("o.part").alias("part")).agg(F.sum("o.n").alias("n_rows"), F.sum("o.size").alias("body")).select(*partition, "part", "n_rows", (F.col("head") + F.col("body")).alias("size"))
