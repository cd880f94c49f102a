"""Never-hit rows, class findings, lambda folding, optional parameters, initialisation failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .closure import checkpointing, reach
from .merge import METHOD

INIT, CLINIT = "<init>", "<clinit>"


def looked_through():
    """Generated and unread methods have no finding of their own."""
    return (F.col("generated_ord") > 0) | (F.col("unread_ord") > 0)


def judgeable(merged: DataFrame) -> DataFrame:
    return merged.where((F.col("kind") == "METHOD") & ~F.col("inline") & ~looked_through())


def class_findings(merged: DataFrame, withheld: DataFrame | None = None) -> DataFrame:
    """Q11-Q13: (class_name, finding, constructed) of every class with a judgeable method; finding is null for none.

    NEVER_INITIALIZED wins: a class whose initialisers have no hit. NEVER_INSTANTIATED: constructors and instance methods exist and
    none of them ran; marked methods that ran count as evidence too. withheld(class_name): classes that can't be judged.
    """
    name, instance = F.col("method_name"), ~F.col("method_name").isin(INIT, CLINIT) & ~F.col("static")
    per = judgeable(merged).groupBy("class_name").agg(
        F.bool_or(name == CLINIT).alias("has_init"), F.coalesce(F.bool_and(F.when(name == CLINIT, F.col("hits") == 0)), F.lit(True)).alias("cold"),
        F.bool_or(name == INIT).alias("has_ctor"), F.bool_or((name == INIT) & (F.col("hits") > 0)).alias("constructed"), F.bool_or(instance).alias("has_instance"),
    )
    ran = merged.where((F.col("kind") == "METHOD") & (F.col("hits") > 0) & instance).select("class_name").distinct().withColumn("ran", F.lit(True))
    per = per.join(ran, "class_name", "left").withColumn("held", F.lit(False))
    if withheld is not None:
        per = per.drop("held").join(withheld.select("class_name").distinct().withColumn("held", F.lit(True)), "class_name", "left")
    finding = F.when(F.col("held"), None).when(F.col("has_init") & F.col("cold"), "NEVER_INITIALIZED").when(F.col("has_ctor") & ~F.col("constructed") & F.col("has_instance") & F.col("ran").isNull(), "NEVER_INSTANTIATED")
    return per.select("class_name", finding.alias("finding"), "constructed")


def covered_methods(merged: DataFrame, findings: DataFrame) -> DataFrame:
    """Methods without a hit that their class's finding explains."""
    cold = judgeable(merged).where("hits = 0").join(findings.where("finding is not null"), "class_name")
    name = F.col("method_name")
    explained = (F.col("finding") == "NEVER_INITIALIZED") | (name == INIT) | ((name != CLINIT) & ~F.col("static"))
    return cold.where(explained).select(*METHOD)


def folded_lambdas(merged: DataFrame, creates: DataFrame, findings: DataFrame, covered: DataFrame, withheld: DataFrame | None = None) -> DataFrame:
    """Q14, R2: cold lambda bodies all of whose creators are absorbed: (method, owner, into_class).

    creates: (method of the creator, c_class, c_name, c_desc of what it creates). owner is the one class whose finding ends all of its
    creation chains, else null; into_class: owner is the lambda's own class and has a finding. Chains through
    lambdas that create each other have no end and stay unfolded. A creator in a withheld class absorbs nothing.
    """
    j = judgeable(merged).select(*METHOD, "hits", "lambda_body")
    cov = covered.withColumn("covered", F.lit(True))
    made = creates.where(~(F.col("class_name").eqNullSafe(F.col("c_class")) & F.col("method_name").eqNullSafe(F.col("c_name")) & F.col("method_descriptor").eqNullSafe(F.col("c_desc"))))
    made = made.select(*METHOD, "c_class", "c_name", "c_desc").distinct()
    state = made.join(j, METHOD, "left").join(cov, METHOD, "left").join(findings.select("class_name", "constructed"), "class_name", "left")
    absorbs = F.col("hits").isNotNull() & (F.col("hits") == 0) & (F.col("covered").isNotNull() | ((F.col("method_name") != CLINIT) & ((F.col("method_name") != INIT) | F.col("constructed"))))
    state = state.withColumn("absorbs", F.coalesce(absorbs, F.lit(False)))
    if withheld is not None:
        state = state.join(withheld.select("class_name").distinct().withColumn("_out", F.lit(True)), "class_name", "left").withColumn("absorbs", F.col("absorbs") & F.col("_out").isNull()).drop("_out")
    whole = state.groupBy("c_class", "c_name", "c_desc").agg(F.bool_and("absorbs").alias("all")).where("all")
    own = whole.select(F.col("c_class").alias("class_name"), F.col("c_name").alias("method_name"), F.col("c_desc").alias("method_descriptor"))
    lambdas = own.join(j.where("lambda_body and hits = 0"), METHOD, "left_semi").join(covered, METHOD, "left_anti")
    # each creator ends at its class (covered), nowhere (null), or goes on through another folded lambda
    key = F.concat_ws("\u0001", *METHOD)
    mark = lambdas.select(key.alias("key"))
    steps = state.select(F.concat_ws("\u0001", "c_class", "c_name", "c_desc").alias("key"), key.alias("by"), F.when(F.col("covered"), F.col("class_name")).alias("end")).join(mark, "key", "left_semi")
    steps = steps.join(mark.select(F.col("key").alias("by"), F.lit(True).alias("through")), "by", "left")
    known = steps.sparkSession.createDataFrame([], "key string, owner string")
    while True:
        there = steps.join(known.select(F.col("key").alias("by"), "owner", F.lit(True).alias("done")), "by", "left")
        ready = there.groupBy("key").agg(
            F.bool_and(F.col("through").isNull() | F.col("done").isNotNull()).alias("ready"),
            F.count_distinct(F.coalesce(F.when(F.col("through"), F.col("owner")).otherwise(F.col("end")), F.lit(""))).alias("ends"), F.max(F.when(F.col("through"), F.col("owner")).otherwise(F.col("end"))).alias("end"),
        )
        fresh = checkpointing(ready.where("ready").select("key", F.when(F.col("ends") == 1, F.col("end")).alias("owner")).join(known, "key", "left_anti"))
        if fresh.isEmpty():
            break
        known = checkpointing(known.union(fresh))
    out = lambdas.withColumn("key", key).join(known, "key")
    found = findings.where("finding is not null").select("class_name", F.lit(True).alias("found"))
    return out.join(found, "class_name", "left").select(*METHOD, "owner", F.coalesce((F.col("owner") == F.col("class_name")) & F.col("found"), F.lit(False)).alias("into_class"))


def never_hit(merged: DataFrame, findings: DataFrame, withheld: DataFrame | None = None, folded: DataFrame | None = None, guards: DataFrame | None = None) -> DataFrame:
    """Q6-Q10: never-hit rows with bucket PLAIN, ROUTINE or UNREAD.

    No optional arguments, inline or generated code or withheld classes; initialisers never; constructors only of classes constructed some
    other way. A branch goes if its method is an ordinary one that was never hit, or if its guard is an ordinary outcome among the candidates
    (guards: method, outcome, guard, of merge.site_guards).
    """
    rows = merged.where((F.col("hits") <= 0) & (F.col("kind") != "OPTIONAL_ARGUMENT") & ~F.col("inline") & (F.col("generated_ord") == 0))
    if withheld is not None:
        rows = rows.join(withheld.select("class_name"), "class_name", "left_anti")
    if folded is not None:
        rows = rows.join(folded.select(*METHOD), METHOD, "left_anti")
    rows = rows.join(findings.select("class_name", "constructed"), "class_name", "left")
    name = F.col("method_name")
    keep = (F.col("kind") != "METHOD") | ((name != CLINIT) & ((name != INIT) | F.coalesce("constructed", F.lit(False))))
    rows = rows.where(keep).drop("constructed")
    cold = judgeable(merged).where("hits <= 0").select(*METHOD)
    branches = rows.where("kind = 'BRANCH'").join(cold, METHOD, "left_anti")
    if guards is not None:
        named = rows.where("kind = 'BRANCH' and routine_ord = 0 and unread_ord = 0").select(*METHOD, F.col("outcome").alias("guard"))
        inner = guards.join(named, [*METHOD, "guard"], "left_semi").select(*METHOD, "outcome")
        branches = branches.join(inner, [*METHOD, "outcome"], "left_anti")
    bucket = F.when(F.col("unread_ord") > 0, "UNREAD").when(F.col("routine_ord") > 0, "ROUTINE").otherwise("PLAIN")
    return rows.where("kind <> 'BRANCH'").unionByName(branches).withColumn("bucket", bucket)


def optional_parameters(merged: DataFrame, never: bool, skipped: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """Q3-Q5: parameters that no caller supplied (never) or that every caller did.

    omitted is the sum of omission totals, target_hits that of the target method. never: equal and not overridable; else: omitted is 0 and not
    all omission probes lie in gaps (class_name). Inline, generated or unread members and skipped classes take the parameter out.
    """
    m = merged.where("kind = 'OPTIONAL_ARGUMENT'").withColumn("target", F.coalesce("target_class_name", "class_name"))
    m = m if "parameter_name" in m.columns else m.withColumn("parameter_name", F.lit(None).cast("string"))
    flag = lambda df: df.select("class_name").distinct().withColumn("flag", F.lit(True)) if df is not None else m.sparkSession.createDataFrame([], "class_name string, flag boolean")
    m = m.join(flag(skipped).withColumnRenamed("flag", "skip"), "class_name", "left").join(flag(gaps).withColumnRenamed("flag", "gap"), "class_name", "left")
    groups = m.groupBy(F.col("target").alias("class_name"), "method_name", "method_descriptor", "parameter_index").agg(
        F.sum("hits").alias("omitted"), F.bool_or("overridable").alias("overridable"), F.bool_or(F.col("inline") | looked_through() | F.coalesce("skip", F.lit(False))).alias("out"),
        F.bool_and(F.coalesce("gap", F.lit(False))).alias("all_gap"), F.greatest(F.max("line"), F.lit(-1)).alias("line"), F.coalesce(F.max("parameter_name"), F.lit("")).alias("parameter_name"),
    ).where("not out")
    groups = groups.join(flag(skipped), "class_name", "left_anti")
    target = merged.where("kind = 'METHOD'").groupBy(*METHOD).agg(F.sum("hits").alias("target_hits"))
    both = groups.join(target, METHOD).where("target_hits > 0")
    both = both.where("not overridable and omitted = target_hits") if never else both.where("omitted = 0 and not all_gap")
    return both.select(*METHOD, "parameter_index", "parameter_name", "omitted", "target_hits", "overridable", "line")


def omission_counts(merged: DataFrame) -> DataFrame:
    """A3, Q2: the summed omissions of each optional parameter of a target method, by index and name."""
    m = merged.where("kind = 'OPTIONAL_ARGUMENT'")
    return m.groupBy(F.coalesce("target_class_name", "class_name").alias("class_name"), "method_name", "method_descriptor", "parameter_index").agg(F.max("parameter_name").alias("parameter_name"), F.sum("hits").alias("omitted"))


def in_never_hit_order(rows: DataFrame) -> DataFrame:
    """O1: by method, kind (methods, outcomes), line, branch index (none first), then branch key with none last."""
    order = F.when(F.col("kind") == "METHOD", 0).when(F.col("kind") == "BRANCH", 1).otherwise(2)
    key = F.when(F.startswith("outcome", F.lit("k:")), F.expr("substring(outcome, 3)"))
    return rows.orderBy(*METHOD, order, "line", F.coalesce("branch_index", F.lit(-1)), key.asc_nulls_last())


def skipped_classes(reports: DataFrame) -> DataFrame:
    """Q18: each skipped class with its first reason (arrival_seq), sorted."""
    return reports.groupBy("class_name").agg(F.min_by("reason", "arrival_seq").alias("reason")).orderBy("class_name")


def initialized_classes(probes: DataFrame) -> DataFrame:
    """Classes that an instance surely initialised: a hit return slot where slots exist, else any hit. probes: with hits."""
    slot = F.col("kind").isin("INITIALIZER_RETURNED", "INITIALIZER_THREW")
    state = probes.groupBy("instance_id", "class_name").agg(
        F.bool_or(slot).alias("slots"), F.bool_or((F.col("kind") == "INITIALIZER_RETURNED") & (F.col("hits") > 0)).alias("returned"), F.bool_or(F.col("hits") > 0).alias("any")
    )
    return state.where(F.when(F.col("slots"), F.col("returned")).otherwise(F.col("any"))).select("class_name").distinct()


def initializers_running(probes: DataFrame) -> DataFrame:
    """(class_name) entered and not finished, with both slots, in every instance that loaded it."""
    running = _running(probes)
    return running.groupBy("class_name").agg(F.bool_and("running").alias("all")).where("all").select("class_name")


def initializer_gaps(probes: DataFrame, failed_overall: DataFrame, failed_in: DataFrame) -> DataFrame:
    """(instance_id, class_name) an instance has probes of but can't judge: failed overall or in it (failed_in), or its initialiser runs on.
    probes: with hits."""
    reported = probes.select("instance_id", "class_name").distinct()
    failed = reported.join(failed_overall.select("class_name"), "class_name", "left_semi").unionByName(reported.join(failed_in.select("instance_id", "class_name"), ["instance_id", "class_name"], "left_semi"))
    return failed.unionByName(_running(probes).where("running").select("instance_id", "class_name")).distinct()


def _running(probes: DataFrame) -> DataFrame:
    hit, kind = F.col("hits") > 0, F.col("kind")
    slot = kind.isin("INITIALIZER_RETURNED", "INITIALIZER_THREW")
    per = probes.groupBy("instance_id", "class_name").agg(
        F.bool_or(kind == "METHOD").alias("loads"), F.bool_or((F.col("method_name") == CLINIT) & (kind == "METHOD") & hit).alias("entered"), F.bool_or(kind == "INITIALIZER_RETURNED").alias("r"),
        F.bool_or(kind == "INITIALIZER_THREW").alias("t"), F.bool_or(slot & hit).alias("finished"),
    )
    return per.where("loads").withColumn("running", F.expr("entered and r and t and not finished"))


def failed_to_initialize(failures: DataFrame, supertypes: DataFrame, default_methods: DataFrame, initialized: DataFrame, known: DataFrame) -> DataFrame:
    """Classes that failed in some instance, or inherit that, and initialised in none; only classes a manifest knows.

    failures: instance_id, class_name, reason. supertypes: instance_id, child, parent, is_interface. A rejected supertype fails its
    heirs; one whose initialiser threw does so as superclass, as interface only with default methods (instance_id, class_name).
    """
    bad = failures.groupBy("instance_id", "class_name").agg(F.bool_or(F.col("reason") == "VERIFIER_REJECTED").alias("rejected"))
    edges = supertypes.select(F.concat_ws("\u0001", "instance_id", "child").alias("a"), F.concat_ws("\u0001", "instance_id", "parent").alias("b"))
    defaults = default_methods.select("instance_id", F.col("class_name").alias("parent"), F.lit(True).alias("default")).distinct()
    direct = supertypes.join(bad.withColumnRenamed("class_name", "parent"), ["instance_id", "parent"]).join(defaults, ["instance_id", "parent"], "left")
    direct = direct.where(F.col("rejected") | ~F.col("is_interface") | F.col("default")).select(F.concat_ws("\u0001", "instance_id", "child").alias("a")).distinct()
    # an heir fails if it, or a type it reaches, has such a direct supertype: walk down from those only
    below = reach(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), start=direct)
    heirs = below.select(F.col("b").alias("a")).union(direct).distinct()
    names = failures.select("class_name").union(heirs.select(F.element_at(F.split("a", "\u0001"), 2).alias("class_name"))).distinct()
    return names.join(initialized, "class_name", "left_anti").join(known, "class_name", "left_semi")


def diagnosis(wanted: DataFrame, skipped: DataFrame, unreported: DataFrame, probed: DataFrame, declared: DataFrame) -> DataFrame:
    """Q28: why (class_name, method_name) is unknown; the first that holds."""
    flag = lambda df, n, on: df.select(*on).distinct().withColumn(n, F.lit(True))
    w = wanted.join(flag(skipped, "s", ["class_name"]), "class_name", "left").join(flag(unreported, "u", ["class_name"]), "class_name", "left")
    w = w.join(flag(probed, "m", ["class_name", "method_name"]), ["class_name", "method_name"], "left").join(flag(probed, "c", ["class_name"]), "class_name", "left").join(flag(declared, "d", ["class_name"]), "class_name", "left")
    why = F.when(F.col("m"), "KNOWN").when(F.col("s"), "SKIPPED").when(F.col("u"), "UNREPORTED").when(F.col("c"), "NO_SUCH_METHOD").when(F.col("d"), "DECLARED_ONLY").otherwise("NEVER_MENTIONED")
    return w.select("class_name", "method_name", why.alias("diagnosis"))
