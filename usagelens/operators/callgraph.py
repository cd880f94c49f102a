"""Call graph with resolved targets, and clusters of unreached code.

A method key is ``class#name descriptor``. Cluster nodes are strings: ``M`` a method, ``O`` an untaken outcome of a method, ``C`` a class
with a finding, which stands for the methods it explains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import closure as C
from .findings import CLINIT, INIT, looked_through
from .merge import METHOD


def method_key(prefix: str = "") -> Column:
    return F.concat(F.col(f"{prefix}class_name"), F.lit("#"), F.col(f"{prefix}method_name"), F.lit(" "), F.col(f"{prefix}method_descriptor"))


def nodes(merged: DataFrame, declared_only: DataFrame | None = None) -> DataFrame:
    """G1: ordinary methods with their hits, and the declared methods (METHOD columns) of classes that were never loaded, at line -1."""
    own = merged.where((F.col("kind") == "METHOD") & ~F.col("inline") & ~looked_through()).select(*METHOD, "hits", "line", F.lit(False).alias("never_loaded"))
    if declared_only is not None:
        own = own.unionByName(declared_only.select(*METHOD, F.lit(0).cast("long").alias("hits"), F.lit(-1).alias("line"), F.lit(True).alias("never_loaded")))
    return own.withColumn("key", method_key())


def transparent(merged: DataFrame) -> DataFrame:
    """Methods without a node whose own edges are followed."""
    return merged.where((F.col("kind") == "METHOD") & ~F.col("inline") & looked_through()).select(*METHOD, "hits").withColumn("key", method_key())


def candidates(edges: DataFrame, supertypes: DataFrame, declares: DataFrame) -> DataFrame:
    """(edge, class_name, key) of every method an edge may enter: the nearest declaration at or above its owner, and for virtual calls
    of ordinary methods all declarations below. edges: edge, owner, name, descriptor, virtual. declares: METHOD columns."""
    sig = F.concat(F.col("name"), F.lit(" "), F.col("descriptor"))
    e = edges.select("edge", F.col("owner").alias("type"), sig.alias("method"), (F.col("virtual") & ~F.col("name").isin(INIT, CLINIT)).alias("wide"))
    known = declares.select(F.col("class_name").alias("type"), F.concat("method_name", F.lit(" "), "method_descriptor").alias("method")).distinct()
    wanted = e.select("type", "method").distinct()
    up = C.declaring_type(wanted, supertypes, known).withColumnRenamed("declared_in", "at")
    down = C.widened(wanted, supertypes, known).withColumnRenamed("subtype", "at")
    found = e.join(up, ["type", "method"]).select("edge", "at", "method").union(e.where("wide").join(down, ["type", "method"]).select("edge", "at", "method")).distinct()
    return found.select("edge", F.col("at").alias("class_name"), F.concat("at", F.lit("#"), "method").alias("key"))


def resolved(edges: DataFrame, cands: DataFrame, node_keys: DataFrame, through: DataFrame) -> DataFrame:
    """(edge, callee): nodes among the candidates, those behind transparent methods, and the initialisers of all classes on the way."""
    inner = cands.join(through.select("key"), "key", "left_semi").select("edge", F.col("key").alias("t")).distinct()
    own = edges.join(through.select(F.col("key").alias("caller")), "caller", "left_semi").select(F.col("caller").alias("t"), "edge")
    steps = own.join(inner.withColumnRenamed("t", "next"), "edge").select(F.col("t").alias("a"), F.col("next").alias("b"))
    far = C.reach(steps, start=inner.select(F.col("t").alias("a"))).select(F.col("a").alias("t"), F.col("b").alias("to"))
    passed = inner.unionByName(inner.join(far, "t").select("edge", F.col("to").alias("t"))).distinct()
    behind = passed.join(own.withColumnRenamed("edge", "inner"), "t").select("edge", "inner").join(cands.withColumnRenamed("edge", "inner"), "inner").select("edge", "class_name", "key")
    all_ = cands.select("edge", "class_name", "key").unionByName(behind).distinct()
    init = all_.select("edge", F.concat("class_name", F.lit(f"#{CLINIT} ()V")).alias("key"))
    return all_.select("edge", "key").union(init).distinct().join(node_keys.select("key").distinct(), "key", "left_semi").select("edge", F.col("key").alias("callee"))


def call_graph(edges: DataFrame, supertypes: DataFrame, declares: DataFrame, node: DataFrame, through: DataFrame, unjudged: DataFrame | None = None, withheld: DataFrame | None = None) -> DataFrame:
    """(caller, callee, guard, role) without loops. role: NODE, GENERATED (transparent callers that ran) or UNKNOWN: declared callers
    without a probe (unjudged: key), and transparent callers without a hit in classes that can't be judged (withheld: class_name)."""
    cands = C.checkpointing(candidates(edges, supertypes, declares))
    calls = edges.select("edge", "caller", "guard").join(resolved(edges, cands, node, through), "edge").where("caller <> callee")
    roles = node.select(F.col("key").alias("caller"), F.lit("NODE").alias("role")).union(through.where("hits > 0").select("key", F.lit("GENERATED")))
    if withheld is not None:
        roles = roles.union(through.where("hits <= 0").join(withheld.select("class_name").distinct(), "class_name", "left_semi").select("key", F.lit("UNKNOWN")))
    if unjudged is not None:
        roles = roles.union(unjudged.join(node.select("key"), "key", "left_anti").join(through.select("key"), "key", "left_anti").select("key", F.lit("UNKNOWN")))
    calls = calls.join(roles.distinct(), "caller")
    return calls.select("caller", "callee", F.when(F.col("role") == "NODE", F.col("guard")).alias("guard"), "role").distinct()


def unknown_callers(declared: DataFrame, known: DataFrame) -> DataFrame:
    """(key) of declared methods (METHOD columns, inline) of classes that manifests know (class_name); call_graph leaves out those with a node
    or looked through. They block roots and are none themselves."""
    return declared.where("not inline").join(known.select("class_name").distinct(), "class_name", "left_semi").select(method_key().alias("key")).distinct()


def declared_guards(declared: DataFrame, sites: DataFrame, ids: DataFrame) -> DataFrame:
    """(key, d_instance, guard_index, guard): the outcome that a baseline's guard index means, where its own instance has no outcome of it.

    declared: a row per outcome of the baseline's sites: key, instance_id, site_key, branch_index, case (role, case key and label as one
    text), blind (a label with a placeholder or a redacted text). sites: the same of manifests, with rank, class_id and probe_index. ids: key, instance_id, branch_index, outcome.
    The case must be one of its kind in the declared site and in the manifest's site of that key, and the outcome must be keyed; the
    newest manifest copy wins.
    """
    own = ids.select("key", "instance_id", "branch_index")
    open_ = declared.where("site_key is not null").groupBy("key", "instance_id", "site_key", "case").agg(F.count(F.lit(1)).alias("n"), F.min("branch_index").alias("branch_index"), F.bool_or("blind").alias("blind")).where("n = 1 and not blind")
    open_ = open_.join(own, ["key", "instance_id", "branch_index"], "left_anti")
    there = sites.groupBy("key", "instance_id", "class_id", "probe_index", "rank", "site_key", "site_index", "case").agg(F.count(F.lit(1)).alias("n"), F.min("branch_index").alias("m_index")).where("n = 1")
    there = there.join(ids.where("outcome like 'k:%'").select("key", "instance_id", F.col("branch_index").alias("m_index"), "outcome"), ["key", "instance_id", "m_index"])
    age = F.struct((-F.col("rank")).alias("r"), "m_instance", "class_id", "probe_index", "site_index")
    both = open_.select("key", F.col("instance_id").alias("d_instance"), "site_key", "case", F.col("branch_index").alias("guard_index")).join(there.withColumnRenamed("instance_id", "m_instance"), ["key", "site_key", "case"])
    return both.groupBy("key", "d_instance", "guard_index").agg(F.min_by("outcome", age).alias("guard"))


def outcome_nodes(merged: DataFrame, node: DataFrame, sites: DataFrame, withheld: DataFrame | None = None) -> DataFrame:
    """(node, key, outcome, guard) of ordinary outcomes without a hit in methods that ran, in no withheld class. sites: METHOD columns, outcome, guard."""
    merged = merged if withheld is None else merged.join(withheld.select("class_name").distinct(), "class_name", "left_anti")
    cold = merged.where((F.col("kind") == "BRANCH") & (F.col("hits") <= 0) & ~F.col("inline") & ~looked_through() & (F.col("routine_ord") == 0)).withColumn("key", method_key())
    cold = cold.join(node.where("hits > 0").select("key"), "key", "left_semi").join(sites.select(*METHOD, "outcome", "guard").distinct(), [*METHOD, "outcome"], "left")
    return cold.select(F.concat(F.lit("O"), "key", F.lit("|"), "outcome").alias("node"), "key", "outcome", "guard")


def possibly_run(merged: DataFrame, node: DataFrame, withheld: DataFrame) -> DataFrame:
    """(node) of outcomes as in outcome_nodes, but of withheld classes: they may have run, so what they guard has a caller that never joins."""
    own = merged.join(withheld.select("class_name").distinct(), "class_name", "left_semi")
    none = merged.select(*METHOD, "outcome").limit(0).withColumn("guard", F.lit(None).cast("string"))
    return outcome_nodes(own, node, none).select("node")


def cluster_edges(calls: DataFrame, outcomes: DataFrame, covered: DataFrame, possible: DataFrame | None = None) -> DataFrame:
    """(caller, callee) among cluster nodes. A guard outcome calls in its method's place, a class node in that of the methods it covers
    (covered: METHOD columns); an outcome hangs off its guard outcome, or else off its method."""
    stands = covered.select(method_key().alias("key"), F.concat(F.lit("C"), "class_name").alias("class_node"))

    def node_of(df, col, name):
        return df.join(stands.select(F.col("key").alias(col), F.col("class_node").alias("_c")), col, "left").withColumn(name, F.coalesce("_c", F.concat(F.lit("M"), col))).drop("_c")

    x = node_of(node_of(calls, "caller", "from"), "callee", "to").withColumn("g", F.concat(F.lit("O"), "caller", F.lit("|"), "guard"))
    known = outcomes.select("node") if possible is None else outcomes.select("node").union(possible.select("node"))
    x = x.join(known.select(F.col("node").alias("g"), F.lit(True).alias("is")).distinct(), "g", "left")
    links = x.select(F.when(F.col("is"), F.col("g")).otherwise(F.col("from")).alias("caller"), F.col("to").alias("callee"))
    o = outcomes.select("node", "key", F.concat(F.lit("O"), "key", F.lit("|"), "guard").alias("g")).join(outcomes.select(F.col("node").alias("g"), F.lit(True).alias("is")), "g", "left")
    hang = o.select(F.when(F.col("is") & (F.col("g") != F.col("node")), F.col("g")).otherwise(F.concat(F.lit("M"), "key")).alias("caller"), F.col("node").alias("callee"))
    return links.union(hang).where("caller <> callee").distinct()


def unreached_clusters(
    node: DataFrame, calls: DataFrame, outcomes: DataFrame, findings: DataFrame, covered: DataFrame, outside: DataFrame | None = None, withheld: DataFrame | None = None, failed: DataFrame | None = None,
    possible: DataFrame | None = None,
) -> DataFrame:
    """Q22: (root, kind, member) with the members as listed: a class node's methods in its place, no initialisers, no constructors that
    can't be judged. Roots of classes and outcomes that list nothing more are left out (G14). outside(key): known callers outside the scope.
    withheld (class_name): classes whose methods are no members, as they can't be judged. failed (class_name): classes that failed to
    initialise; a hit in one of their own nodes makes no root. possible: of possibly_run.
    """
    links = C.checkpointing(cluster_edges(calls, outcomes, covered, possible))
    cov = covered.select(method_key().alias("key"), "class_name")
    built = findings.where("constructed").select("class_name", F.lit(True).alias("built"))
    n = node.join(cov.select("key", F.lit(True).alias("covered")).distinct(), "key", "left").join(built, "class_name", "left")
    unjudged = (F.col("method_name") == INIT) & ~F.col("never_loaded") & F.col("built").isNull()
    n = n.select("key", "class_name", "method_name", "hits", F.col("covered").isNotNull().alias("covered"), unjudged.alias("unjudged"))
    classes = cov.select(F.concat(F.lit("C"), "class_name").alias("node")).distinct()
    own = n if withheld is None else n.join(withheld.select("class_name").distinct(), "class_name", "left_anti")
    cold = own.where("hits = 0 and not covered").select(F.concat(F.lit("M"), "key").alias("node"), ((F.col("method_name") != CLINIT) & ~F.col("unjudged")).alias("may_root"))
    cold = cold.union(outcomes.select("node", F.lit(True))).union(classes.select("node", F.lit(True)))
    hot = n.where("hits > 0").select(F.concat(F.lit("M"), "key").alias("node")).union(calls.where("role = 'GENERATED'").select(F.concat(F.lit("M"), "caller"))).distinct()
    other = links.select(F.col("caller").alias("node")).union(links.select("callee")).distinct().join(cold, "node", "left_anti").join(hot, "node", "left_anti")
    every = cold.select("node", F.lit(False).alias("hit"), "may_root").union(hot.select("node", F.lit(True), F.lit(False))).union(other.select("node", F.lit(False), F.lit(False)))
    every = C.checkpointing(every.distinct())
    counts = every.select(F.col("node").alias("caller"), F.col("hit").alias("caller_hit"))
    if failed is not None:
        dead = node.join(failed.select("class_name").distinct(), "class_name", "left_semi").select(F.concat(F.lit("M"), "key").alias("caller"), F.lit(True).alias("dead"))
        counts = counts.join(dead, "caller", "left").select("caller", (F.col("caller_hit") & F.col("dead").isNull()).alias("caller_hit"))
    per = links.join(counts, "caller").groupBy(F.col("callee").alias("node")).agg(F.bool_or("caller_hit").alias("from_hit"))
    starts = every.where("may_root").join(per, "node", "left").where("from_hit is null or from_hit")
    seen = outside.select(F.concat(F.lit("M"), "key").alias("node"), F.lit(True).alias("out")).distinct() if outside is not None else None
    starts = starts.join(seen, "node", "left") if seen is not None else starts.withColumn("out", F.lit(None).cast("boolean"))
    first = F.substring("node", 1, 1)
    kind = F.when(first == "C", "CLASS_FINDING").when(first == "O", "UNTAKEN_OUTCOME").when(F.col("from_hit").isNull() & F.col("out"), "CALLED_FROM_OUTSIDE_SCOPE").when(F.col("from_hit").isNull(), "UNCALLED").otherwise("REACHED_FROM_HIT")
    starts = C.checkpointing(starts.select(F.col("node").alias("root"), kind.alias("kind")))
    # only never-hit nodes may join: others count as hit for the fixpoint
    may = every.join(cold.select("node", F.lit(True).alias("cold")), "node", "left").select("node", F.col("cold").isNull().alias("hit"))
    grown = C.clusters(may, links, starts.select("root"))
    listed = n.where((F.col("method_name") != CLINIT) & ~F.col("unjudged"))
    shown = grown.where("member like 'M%'").select("root", "member", F.expr("substring(member, 2)").alias("key")).join(listed.select("key"), "key", "left_semi").select("root", "member", "key")
    inside = grown.where("member like 'C%'").join(cov.withColumn("member", F.concat(F.lit("C"), "class_name")), "member").join(listed.select("key"), "key", "left_semi").select("root", "member", "key")
    rows = shown.union(inside)
    more = rows.where("member <> root").select("root").distinct().withColumn("more", F.lit(True))
    keep = starts.join(more, "root", "left").where("more or root like 'M%'").select("root", "kind")
    return keep.join(rows.select("root", F.col("key").alias("member")).distinct(), "root", "left")


def whole_classes(clusters: DataFrame, node: DataFrame) -> DataFrame:
    """(root, class_name) where a cluster lists every method of a class."""
    size = node.where(F.col("method_name") != CLINIT).groupBy("class_name").agg(F.count(F.lit(1)).alias("size"))
    per = clusters.withColumn("class_name", F.substring_index("member", "#", 1)).groupBy("root", "class_name").agg(F.count(F.lit(1)).alias("n"))
    return per.join(size, "class_name").where("n = size").select("root", "class_name")


def in_cluster_order(clusters: DataFrame) -> DataFrame:
    """O2: (root, kind, members) by size, the largest first, then by root."""
    return clusters.groupBy("root", "kind").agg(F.count("member").alias("members")).orderBy(F.desc("members"), "root")


def call_edges(edges: DataFrame, class_name: str | None = None, method_name: str | None = None) -> DataFrame:
    """Q26: the distinct callees (owner, name, descriptor) of a method's edges over manifests and baselines, sorted; without names those of every
    caller. edges: METHOD columns of the caller, owner, name, descriptor."""
    x = edges
    if class_name is not None:
        x = x.where((F.col("class_name") == class_name) & (F.col("method_name") == method_name))
    keys = [] if class_name is not None else ["class_name", "method_name"]
    return x.select(*keys, "owner", "name", "descriptor").distinct().orderBy(*keys, "owner", "name", "descriptor")
