"""Recovery drafts: list scheduling on the prerequisite graph, for all requests at once.

A request's delayed courses, few by nature, are one array with their conditions in alternatives; each condition on a course
that isn't delayed is already a time. A draft then is a fold over the calendar in expressions of the engine: in each term
the courses that may enter are admitted by priority while there is room. Drafts are rows, one for each variant.

Requests that differ in the names of courses alone are one class, drafted and checked once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import planning, rules
from .common import stored
from .graphs import bounded_closure

#: Terms of the calendar, numbered from 0: three a year, the third in summer.
TERMS, SUMMER = 15, 2
NEVER = 1 << 20
#: D: just in time; A: own offers only; B: requests for other terms as well; C: summer as well, as soon as possible. In the
#: order in which drafts are compared.
VARIANTS = ["D", "A", "B", "C"]
_STATE = "struct<slots:array<int>,seq:array<struct<i:int,k:int>>,room:double>"


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _mode(c: Column, k: Column, variant: Column, banned: Column) -> Column:
    """How a delayed course can enter a term, or null."""
    slot = k % 3
    special = (c.own != SUMMER) & (variant != "A") & ~F.exists(banned, lambda b: (b.i == c.i) & (b.k == k))
    return (
        F.when(k < c.due, None)
        .when(slot == SUMMER, F.when((c.own == SUMMER) | variant.isin("C", "D"), "summer"))
        .when(slot == c.own, F.when(c.failed, "retake").otherwise("prescribed"))
        .otherwise(F.when(special, "special_class_request"))
    )


def _is_due(c: Column, k: Column, last_due: Column) -> Column:
    """Just in time: whether the course can no longer wait without delaying what needs it."""
    year = F.floor(k / 3).cast("int")
    offer = F.when(k % 3 < c.own, year * 3 + c.own).otherwise((year + 1) * 3 + c.own)
    return (k % 3 == c.own) | F.when(c.need.isNotNull(), k >= c.need - 1).otherwise(offer > last_due)


def _met(c: Column, k: Column, slots: Column) -> Column:
    time = lambda x: F.when(x.i > 0, F.get(slots, x.i - 1)).otherwise(x.at)
    return F.exists(c.alternatives, lambda a: F.forall(a, lambda x: time(x) + F.when(x.co, 0).otherwise(1) <= k))


def _draft(r: dict[str, Column], variant: Column, banned: Column) -> Column:
    """The greedy chain as (slots, seq): each delayed course's term, and the order in which they were admitted."""
    empty = F.struct(F.transform(r["delayed"], lambda c: F.lit(NEVER)).alias("slots"), F.array().cast("array<struct<i:int,k:int>>").alias("seq"), F.lit(None).cast("double").alias("room")).cast(_STATE)

    def admit(st: Column, c: Column, k: Column) -> Column:
        size = F.when(c.own == SUMMER, F.lit(0.0)).otherwise(c.units)
        fits = st.room.isNull() | F.coalesce(size <= st.room, F.lit(False))
        into = F.struct(
            F.transform(st.slots, lambda x, i: F.when(i + 1 == c.i, k).otherwise(x)).alias("slots"),
            F.concat(st.seq, F.array(F.struct(c.i.alias("i"), k.alias("k")))).alias("seq"),
            (st.room - size).alias("room"),
        ).cast(_STATE)
        return F.when((F.get(st.slots, c.i - 1) == NEVER) & fits & _met(c, k, st.slots), into).otherwise(st)

    def term(st: Column, k: Column) -> Column:
        capped = (k % 3 == SUMMER) & variant.isin("C", "D")
        start = F.struct(st.slots.alias("slots"), st.seq.alias("seq"), F.when(capped, r["summer_units"] - F.get(r["kept_units"], k)).cast("double").alias("room")).cast(_STATE)
        may = F.filter(r["delayed"], lambda c: (F.get(st.slots, c.i - 1) == NEVER) & _mode(c, k, variant, banned).isNotNull() & ((variant != "D") | _is_due(c, k, r["last_due"])))
        first = lambda c: F.struct(F.coalesce(c.need, F.lit(TERMS)).alias("need"), (-c.unlocks).alias("unlocks"), c.i.alias("i"), c.alias("c"))
        ordered = lambda cs: F.when(capped, F.transform(F.array_sort(F.transform(cs, first)), lambda x: x.c)).otherwise(cs)
        # A course that waits for another of the same term may enter in a later pass; without such there is one.
        passes = lambda cs: F.sequence(F.lit(1), F.when(r["paired"], F.greatest(F.size(cs), F.lit(1))).otherwise(F.lit(1)))
        run = lambda cs: F.aggregate(passes(cs), start, lambda s, _: F.aggregate(cs, s, lambda t, c: admit(t, c, k)))
        return _let(may, lambda cs: F.when(F.size(cs) > 0, _let(ordered(cs), run)).otherwise(st))

    return F.aggregate(F.sequence(r["start"], F.lit(TERMS - 1)), empty, term)


def _requests_of(st: Column, delayed: Column) -> Column:
    """What a draft asks for outside a course's own terms, latest first."""
    special = F.filter(st.seq, lambda e: (e.k % 3 != SUMMER) & (e.k % 3 != F.get(delayed, e.i - 1).own))
    keyed = F.transform(special, lambda e, n: F.struct((-e.k).alias("late"), n.alias("n"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda x: x.e)


def _rejoin(slots: Column, r: dict[str, Column]) -> Column:
    """The first regular term from which every delayed course is in its own prescribed term again."""
    late = F.array_max(F.filter(F.zip_with(slots, r["delayed"], lambda s, c: F.when(s != c.due, s)), lambda x: x.isNotNull()))
    back = F.when(late.isNull(), r["start"]).otherwise(late + 1)
    return F.when(back % 3 == SUMMER, back + 1).otherwise(back)


def _best(r: dict[str, Column], variant: Column) -> Column:
    """The greedy chain, then each request dropped again, latest first, where the student still rejoins as early."""
    none = F.array().cast("array<struct<i:int,k:int>>")
    whole = lambda st: ~F.exists(st.slots, lambda x: x == NEVER)
    kind = f"struct<banned:array<struct<i:int,k:int>>,st:{_STATE}>"
    first = F.struct(none.alias("banned"), _draft(r, variant, none).alias("st")).cast(kind)

    def fewer(best: Column, request: Column) -> Column:
        banned = F.concat(best.banned, F.array(request))

        def better(new: Column) -> Column:
            fits = whole(new) & (_rejoin(new.slots, r) <= _rejoin(best.st.slots, r)) & (F.size(_requests_of(new, r["delayed"])) < F.size(_requests_of(best.st, r["delayed"])))
            fits &= F.array_max(new.slots) <= F.greatest(r["last_due"], F.array_max(best.st.slots))
            return F.when(fits, F.struct(banned.alias("banned"), new.alias("st")).cast(kind)).otherwise(best)

        return _let(_draft(r, variant, banned), better)

    drop = lambda f: F.aggregate(F.when(whole(f.st), _requests_of(f.st, r["delayed"])).otherwise(none), f, fewer)
    return _let(first, lambda f: drop(f).st)


def delayed_courses(requests: DataFrame, facts: DataFrame, curriculum: DataFrame, nodes: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """One row for each request with the array of its delayed courses, and its other courses (request, course, due, kept, assumed)."""
    leaves = stored(rules.leaf_paths(nodes, depth))
    uses = stored(leaves.where(F.col("ref_id").isNotNull()).select(F.col("ref_id").cast("long").alias("src"), F.col("owner_id").alias("dst")).distinct())
    reached = bounded_closure(uses, requests.select(F.col("failed_course").alias("root")).distinct())
    place = curriculum.select("curriculum", "course", "due", "units", "ord")
    own = requests.join(place.select("curriculum", F.col("course").alias("failed_course"), F.col("due").alias("failed_due")), ["curriculum", "failed_course"])
    stated = F.col("stated").isNotNull() & (F.col("stated") > F.col("failed_due"))
    own = own.withColumn("start", F.when(stated, F.col("stated")).otherwise(F.col("failed_due") + 1)).where(F.col("start") < TERMS)
    known = facts.groupBy("request", "course").agg(F.max("passed").alias("passed"), F.lit(True).alias("told"))
    below = reached.select(F.col("root").alias("failed_course"), F.col("node").alias("course")).withColumn("below", F.lit(True))
    rows = own.select("request", "curriculum", "failed_course", "start").join(place, "curriculum").join(known, ["request", "course"], "left").join(below, ["failed_course", "course"], "left")
    is_failed = F.col("course") == F.col("failed_course")
    late = is_failed | (F.coalesce("below", F.lit(False)) & ~F.coalesce("passed", F.lit(False)))
    rows = stored(rows.select("request", "course", "due", "units", "ord", "start", is_failed.alias("failed"), late.alias("late"), F.coalesce("passed", F.lit(False)).alias("passed"), F.coalesce("told", F.lit(False)).alias("told")))
    blocked = rows.where("late")
    # Who needs a delayed course, at any distance, among all courses; the earliest such term is where it must have come.
    needs = bounded_closure(uses, blocked.select(F.col("course").alias("root")).distinct())
    due_of = rows.select("request", F.col("course").alias("node"), F.col("due").alias("needed"))
    need = blocked.select("request", "course").join(needs.select(F.col("root").alias("course"), "node"), "course")
    need = need.join(due_of, ["request", "node"], "left").groupBy("request", "course").agg(F.min("needed").alias("need"), F.count("*").alias("unlocks"))
    # Conditions: of a delayed course by its place in the array, of another by the term after which it counts.
    waits = blocked.select("request", "course").join(rules.alternatives(leaves, depth).withColumnRenamed("owner_id", "course"), "course")
    parts = waits.select("request", "course", F.posexplode_outer("alternatives").alias("a", "xs")).select("request", "course", "a", F.col("xs").isNotNull().alias("is_one"), F.posexplode_outer("xs").alias("b", "x"))
    numbered = blocked.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("ord", "course"))).alias("all"))
    numbered = numbered.select("request", F.posexplode("all").alias("i", "c")).select("request", F.col("c.course").alias("ref"), (F.col("i") + 1).alias("i"))
    static = F.when(F.col("passed") | ((F.col("due") < F.col("start")) & ~F.col("told")), -1).when(F.col("due") >= F.col("start"), F.col("due")).otherwise(NEVER)
    others = rows.where("NOT late").select("request", F.col("course").alias("ref"), static.alias("at"))
    outside = facts.where("passed").select("request", F.col("course").alias("ref")).distinct().withColumn("had", F.lit(True))
    parts = parts.withColumn("ref", F.col("x.ref_id")).join(numbered, ["request", "ref"], "left").join(others, ["request", "ref"], "left").join(outside, ["request", "ref"], "left")
    at = F.when(F.col("had"), -1).otherwise(F.coalesce("at", F.lit(NEVER)))
    # What was stated as passed counts as such even where it is delayed.
    index = F.when(F.col("had"), 0).otherwise(F.coalesce("i", F.lit(0)))
    cond = F.when(F.col("ref").isNotNull(), F.struct(index.cast("int").alias("i"), at.cast("int").alias("at"), F.col("x.co").alias("co")))
    lists = parts.where("is_one").groupBy("request", "course", "a").agg(F.collect_list(cond).alias("xs")).groupBy("request", "course").agg(F.collect_list("xs").alias("alternatives"))
    lists = stored(lists)
    full = blocked.join(numbered.withColumnRenamed("ref", "course"), ["request", "course"]).join(need, ["request", "course"], "left").join(lists, ["request", "course"], "left")
    entry = F.struct(F.col("i").cast("int").alias("i"), "course", F.col("due").cast("int").alias("due"), (F.col("due") % 3).cast("int").alias("own"), F.col("units").cast("double").alias("units"), F.col("need").cast("int").alias("need"), F.coalesce("unlocks", F.lit(0)).cast("int").alias("unlocks"), "failed", F.coalesce("alternatives", F.array().cast("array<array<struct<i:int,at:int,co:boolean>>>")).alias("alternatives"))
    paired = F.max(F.exists(F.coalesce("alternatives", F.array().cast("array<array<struct<i:int,at:int,co:boolean>>>")), lambda a: F.exists(a, lambda x: x.co & (x.i > 0))))
    arrays = full.groupBy("request").agg(F.array_sort(F.collect_list(entry)).alias("delayed"), paired.alias("paired"))
    kept = rows.where("NOT late AND due >= start")
    sums = [F.coalesce(F.sum(F.when(F.col("due") == k, F.col("units"))), F.lit(0.0)).cast("double") for k in range(TERMS)]
    units = kept.groupBy("request").agg(F.array(*sums).alias("kept_units"))
    spans = rows.groupBy("request").agg(F.max("due").cast("int").alias("last_due"), F.max("start").cast("int").alias("start"))
    base = arrays.join(spans, "request").join(units, "request", "left").withColumn("kept_units", F.coalesce("kept_units", F.array_repeat(F.lit(0.0), TERMS)))
    return base, rows


def recovery_drafts(requests: DataFrame, facts: DataFrame, curriculum: DataFrame, nodes: DataFrame, depth: int, summer_units: float | None, ceiling: float) -> DataFrame:
    """(request, variant, state, same_as, course, place, n_requests, rejoin, beyond, moved, digest) of each request and variant.

    Requests are (request, curriculum, failed_course, stated, fastest): ``stated`` is the term from which to plan, if it
    comes after the failed one, else the next one is taken. ``curriculum`` has (curriculum, course, due, units, ord), due
    being a term from 0 to 14; ``facts`` (request, course, passed, failed). Delayed are the failed course and all that need
    it and aren't stated passed; the other courses stay in their terms, and what was due before the start and isn't
    stated counts as passed.

    States: draft; not_placed (``course`` is the first without a term); no_summer_policy; same_as an earlier variant; blocked
    (``course`` is one that the plan check blocks). ``place`` orders a request's drafts: D, then fewest requests, then the
    earliest end, or, where the fastest is asked for, the earliest rejoin, then fewest requests. A request whose failed
    course isn't in its curriculum, or has no term after it, has no rows. Delayed courses of one request are one array.

    Curricula are alike if they agree but for the names of courses, and requests are if they agree in that, in the place of
    the failed course, in the start, and in what is known of the places. One request of each class is drafted and checked,
    and the others have its rows with their own courses. So drafts are as many as classes, at most as many as requests.
    """
    shapes = stored(_shapes(curriculum, nodes))
    known = facts.groupBy("request", "course").agg(*(F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("passed", "failed")))
    refs = nodes.where("ref_id IS NOT NULL").select(F.col("owner_id").alias("course"), F.col("ref_id").cast("long").alias("ref"))
    domain = curriculum.select("curriculum", "course").unionByName(curriculum.select("curriculum", "course").join(refs, "course").select("curriculum", F.col("ref").alias("course"))).distinct()
    known = stored(known.join(requests.select("request", "curriculum"), "request").join(domain, ["curriculum", "course"], "left_semi").select("request", "curriculum", "course", "passed", "failed"))
    place = F.array_position("courses", F.col("course"))
    fact = F.struct(place.alias("at"), F.when(place == 0, F.col("course")).alias("course"), "passed", "failed")
    of = known.join(shapes.select("curriculum", "courses"), "curriculum").groupBy("request").agg(F.array_sort(F.collect_list(fact)).alias("known"))
    at = F.array_position("courses", F.col("failed_course"))
    due = F.get("dues", (at - 1).cast("int"))
    start = F.when(F.col("stated") > due, F.col("stated")).otherwise(due + 1)
    alike = F.struct("shape", at.alias("at"), start.alias("start"), "fastest", "known")
    keyed = requests.join(shapes, "curriculum").where(at > 0).join(of, "request", "left")
    keyed = stored(keyed.select("request", "curriculum", "failed_course", "stated", "fastest", F.sha2(F.to_json(alike), 256).alias("class")))
    first = stored(keyed.groupBy("class").agg(F.min_by(F.struct("request", "curriculum", "failed_course", "stated", "fastest"), "request").alias("first"))).select("class", "first.*")
    # Rules of curricula that no class is drafted in, and that no other reaches, are left out.
    used = curriculum.join(shapes.where("NOT closed").select("curriculum").unionByName(first.select("curriculum")).distinct(), "curriculum", "left_semi")
    idle = curriculum.select("course").distinct().join(used.select("course").distinct(), "course", "left_anti")
    theirs = nodes.join(idle.withColumnRenamed("course", "owner_id"), "owner_id", "left_anti")
    drafts = _class_drafts(first.drop("class"), known.join(first.select("request"), "request", "left_semi"), used, theirs, depth, summer_units)
    named = first.select("class", "request", F.col("curriculum").alias("from")).join(shapes.select(F.col("curriculum").alias("from"), F.col("courses").alias("theirs")), "from")
    rows = stored(drafts.join(named, "request").drop("request"))
    own = keyed.select("request", "curriculum", "class").join(shapes.select("curriculum", "courses"), "curriculum")
    to = lambda c: F.when(F.col("from") == F.col("curriculum"), c).otherwise(F.get("courses", (F.array_position("theirs", c) - 1).cast("int")))
    out = own.join(rows, "class").withColumns({"course": to(F.col("course")), "moved": F.transform("moved", lambda m: F.struct(m.term.alias("term"), to(m.course).alias("course"), m["mode"].alias("mode")))})
    text = F.array_join(F.transform("moved", lambda m: F.concat_ws(":", m.term.cast("string"), m.course.cast("string"), m["mode"])), " ")
    return out.select("request", "variant", "state", "same_as", "course", "place", "n_requests", "rejoin", "beyond", text.alias("moved"), F.sha2(F.to_json("moved"), 256).alias("digest"))


def _shapes(curriculum: DataFrame, nodes: DataFrame) -> DataFrame:
    """(curriculum, courses, dues, closed, shape): its courses in order, and a digest of all else that matters of it.

    A curriculum is closed if its rules name its own courses alone, and no other rules name them; one that isn't has a
    shape of its own.
    """
    at = curriculum.select("curriculum", F.col("course").cast("long").alias("course"), "due", "units", "ord")
    tree = nodes.select("owner_id", "node_id", "parent_id", "ordinal", "depth", "kind", F.col("ref_id").cast("long").alias("ref_id"))
    trees = tree.groupBy(F.col("owner_id").cast("long").alias("course")).agg(F.array_sort(F.collect_list(F.struct("node_id", "parent_id", "ordinal", "depth", "kind", "ref_id"))).alias("tree"))
    entry = F.struct("ord", "course", "due", "units", "tree")
    each = at.join(trees, "course", "left").groupBy("curriculum").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    each = each.withColumns({"courses": F.col("all.course"), "by_name": F.array_sort("all.course")})
    named = F.transform("all", lambda c: F.struct(
        F.array_position("by_name", c.course).alias("by_name"), c.due.alias("due"), c.units.alias("units"),
        F.transform(c.tree, lambda n: F.struct(n.node_id.alias("node_id"), n.parent_id.alias("parent_id"), n.ordinal.alias("ordinal"), n.depth.alias("depth"), n.kind.alias("kind"), F.array_position("courses", n.ref_id).alias("ref"))).alias("tree"),
    ))
    inside = F.forall("all", lambda c: F.coalesce(F.forall(c.tree, lambda n: n.ref_id.isNull() | F.array_contains("courses", n.ref_id)), F.lit(True)))
    users = tree.where("ref_id IS NOT NULL").select(F.col("owner_id").cast("long").alias("course"), F.col("ref_id").alias("of")).join(at.select("curriculum", F.col("course").alias("of")), "of")
    open_ones = users.join(at.select("curriculum", "course"), ["curriculum", "course"], "left_anti").select("curriculum").distinct().withColumn("used", F.lit(True))
    closed = inside & F.col("used").isNull() & (F.size("courses") == F.size(F.array_distinct("courses")))
    shape = F.when(F.col("closed"), F.sha2(F.to_json("named"), 256)).otherwise(F.concat(F.lit("own:"), F.col("curriculum").cast("string")))
    told = each.join(open_ones, "curriculum", "left").withColumns({"named": named, "closed": closed})
    return told.select("curriculum", "courses", F.col("all.due").alias("dues"), "closed", shape.alias("shape"))


def _class_drafts(requests: DataFrame, facts: DataFrame, curriculum: DataFrame, nodes: DataFrame, depth: int, summer_units: float | None) -> DataFrame:
    """The rows of ``recovery_drafts`` without a digest and with ``moved`` as an array, each request by itself."""
    base, rows = delayed_courses(requests, facts, curriculum, nodes, depth)
    each = base.join(requests.select("request", "fastest"), "request").withColumn("variant", F.explode(F.array(*map(F.lit, VARIANTS))))
    each = each.withColumn("summer_units", F.lit(summer_units).cast("double"))
    r = {c: F.col(c) for c in ("delayed", "kept_units", "summer_units", "last_due", "start", "paired")}
    st = F.when(F.col("variant").isin("A", "B") | F.col("summer_units").isNotNull(), _best(r, F.col("variant")))
    # Dealt anew, so that drafts of all requests are made by all tasks.
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = stored(each.repartition(n, "request", "variant").withColumn("st", st))
    st = F.col("st")
    missing = F.array_position(st.slots, NEVER)
    asked = F.size(_requests_of(st, F.col("delayed")))
    moved = F.transform(st.seq, lambda e: F.struct(e.k.alias("term"), F.get(F.col("delayed"), e.i - 1).course.alias("course"), _mode(F.get(F.col("delayed"), e.i - 1), e.k, F.col("variant"), F.array().cast("array<struct<i:int,k:int>>")).alias("mode")))
    told = drawn.select(
        "request", "variant", "fastest", "start", "last_due", F.array_position(F.array(*map(F.lit, VARIANTS)), F.col("variant")).alias("at"),
        F.when(st.isNull(), "no_summer_policy").when(missing > 0, "not_placed").alias("state"), F.when(missing > 0, F.get("delayed", (missing - 1).cast("int")).course).alias("course"),
        F.when(missing == 0, moved).alias("moved"), F.when(missing == 0, asked).alias("n_requests"), F.when(missing == 0, F.array_max(st.slots)).alias("end"), F.when(missing == 0, _rejoin(st.slots, r)).alias("rejoin"),
    )
    told = stored(told.withColumn("digest", F.when(F.col("state").isNull(), F.sha2(F.to_json("moved"), 256))))
    first = told.where("state IS NULL").groupBy("request", "digest").agg(F.min("at").alias("first"))
    told = told.join(first, ["request", "digest"], "left")
    name = lambda at: F.get(F.array(*map(F.lit, VARIANTS)), at.cast("int") - 1)
    same = F.col("state").isNull() & (F.col("first") < F.col("at"))
    told = stored(told.withColumns({"state": F.when(same, "same_as").otherwise(F.col("state")), "same_as": F.when(same, name(F.col("first")))}))
    # The plan check of what is left: the courses that stay where they are, and those that move.
    open_ones = told.where("state IS NULL").select((F.col("request") * len(VARIANTS) + F.col("at") - 1).alias("plan_id"), "request", "moved", "end")
    stay = open_ones.select("plan_id", "request", "end").join(rows.where("NOT late AND due >= start"), "request").where("due <= end").select("plan_id", F.col("due").alias("term"), "course", "units")
    units = rows.where("late").select("request", "course", "units")
    go = open_ones.select("plan_id", "request", F.inline("moved")).join(units, ["request", "course"]).select("plan_id", F.col("term"), "course", "units")
    state = rows.join(facts.groupBy("request", "course").agg(F.max("failed").alias("not_done")), ["request", "course"], "left")
    before = (F.col("due") < F.col("start")) & ~F.col("late") & ~F.col("told")
    known = state.select("request", "course", (F.col("passed") | before).alias("passed"), (F.coalesce("not_done", F.lit(False)) | (F.col("failed") & ~F.col("told"))).alias("failed")).where("passed OR failed")
    plans = open_ones.select("plan_id", "request").join(known, "request").select("plan_id", "course", "passed", "failed")
    verdicts = planning.term_verdicts(stored(stay.unionByName(go)), plans, nodes, depth)
    stuck = verdicts.where("verdict = 'ineligible'").groupBy("plan_id").agg(F.min_by("course", F.struct("term", "course")).alias("stuck"))
    out = told.withColumn("plan_id", F.col("request") * len(VARIANTS) + F.col("at") - 1).join(stuck, "plan_id", "left")
    final = F.when(F.col("state").isNull() & F.col("stuck").isNotNull(), "blocked").otherwise(F.coalesce("state", F.lit("draft")))
    out = out.withColumns({"state": final, "course": F.coalesce("course", F.when(F.col("state").isNull(), F.col("stuck")))})
    is_draft = F.col("state") == "draft"
    key = F.when(F.col("fastest"), F.struct(F.col("rejoin").alias("x"), F.col("n_requests").alias("y"), F.lit(0).alias("z"), F.col("at").cast("int").alias("w"))).otherwise(F.struct((F.col("variant") != "D").cast("int").alias("x"), F.col("n_requests").alias("y"), F.col("end").alias("z"), F.col("at").cast("int").alias("w")))
    places = out.where(is_draft).groupBy("request").agg(F.array_sort(F.collect_list(key)).alias("order"))  # four at most
    out = out.join(places, "request", "left")
    return out.select(
        "request", "variant", "state", "same_as", "course", F.when(is_draft, F.array_position("order", key)).cast("int").alias("place"), "n_requests", "rejoin",
        (F.col("end") > F.col("last_due")).alias("beyond"), "moved",
    )
