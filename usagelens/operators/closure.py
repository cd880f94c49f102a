"""Reachability over edges (R1), type resolution (G3, G4) and the cluster fixpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def checkpointing(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the folder that spark.checkpoint.dir names; one is made only where none is set and the master is local."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            where = tempfile.mkdtemp(prefix="usagelens-")
        context.setCheckpointDir(where)
    return df.checkpoint()


def reach(edges: DataFrame, depth: bool = False, start: DataFrame | None = None) -> DataFrame:
    """All (a, b) with a path of one edge or more from a to b; with depth, the shortest path's length too. With start (a), only paths from there.

    Semi-naive: each round joins only the pairs found last. Cycles end when a round finds nothing new.
    """
    edges = checkpointing(edges.select("a", "b").distinct())
    fresh = edges.withColumn("depth", F.lit(1))
    if start is not None:
        fresh = checkpointing(fresh.join(start.select("a").distinct(), "a", "left_semi"))
    found = fresh
    while True:
        step = fresh.select("a", F.col("b").alias("m"), "depth").join(edges.select(F.col("a").alias("m"), "b"), "m").select("a", "b", (F.col("depth") + 1).alias("depth")).distinct()
        fresh = checkpointing(step.join(found.select("a", "b"), ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            return found if depth else found.select("a", "b")
        found = checkpointing(found.union(fresh))


def declaring_type(wanted: DataFrame, supertypes: DataFrame, declares: DataFrame) -> DataFrame:
    """For each (type, method) the type itself or the first supertype, level by level, that declares the method.

    supertypes: child, parent, ord (0 the superclass, then the interfaces in order). Within a level the path of smaller orders comes first,
    as a queue gives it. Rounds go on only for those not found yet.
    """
    have = checkpointing(declares.select(F.col("type").alias("at"), "method").distinct())
    up = checkpointing(supertypes.select(F.col("child").alias("at"), "parent", F.col("ord").cast("int").alias("ord")).distinct())
    level = wanted.select("type", "method").distinct().select("type", "method", F.col("type").alias("at"), F.array().cast("array<int>").alias("path"))
    level, found, seen = checkpointing(level), None, None
    while True:
        hit = level.join(have, ["at", "method"]).groupBy("type", "method").agg(F.min_by("at", "path").alias("declared_in"))
        found = checkpointing(hit if found is None else found.union(hit))
        seen = checkpointing(level.select("type", "method", "at") if seen is None else seen.union(level.select("type", "method", "at")))
        more = level.join(found, ["type", "method"], "left_anti").join(up, "at").select("type", "method", F.col("parent").alias("at"), F.concat("path", F.array("ord")).alias("path"))
        level = checkpointing(more.groupBy("type", "method", "at").agg(F.min("path").alias("path")).join(seen, ["type", "method", "at"], "left_anti"))
        if level.isEmpty():
            return found


def widened(wanted: DataFrame, supertypes: DataFrame, declares: DataFrame) -> DataFrame:
    """All proper subtypes of the type that declare the method."""
    down = reach(supertypes.select(F.col("parent").alias("a"), F.col("child").alias("b")), start=wanted.select(F.col("type").alias("a")))
    below = wanted.join(down.select(F.col("a").alias("type"), F.col("b").alias("subtype")).where("type <> subtype"), "type")
    return below.join(declares.select(F.col("type").alias("subtype"), "method").distinct(), ["subtype", "method"]).select("type", "method", "subtype")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Never-hit nodes without a caller (UNCALLED) or with a hit caller (REACHED_FROM_HIT). nodes: node, hit."""
    callers = edges.where("caller <> callee").join(nodes.select(F.col("node").alias("caller"), F.col("hit").alias("caller_hit")), "caller", "left")
    per = callers.groupBy(F.col("callee").alias("node")).agg(F.bool_or(F.coalesce("caller_hit", F.lit(False))).alias("from_hit"))
    cold = nodes.where("not hit").join(per, "node", "left")
    return cold.where("from_hit is null or from_hit").select(F.col("node").alias("root"), F.when(F.col("from_hit"), "REACHED_FROM_HIT").otherwise("UNCALLED").alias("kind"))


def clusters(nodes: DataFrame, edges: DataFrame, root_nodes: DataFrame) -> DataFrame:
    """(root, member). A never-hit callee joins once all its callers are members; cycles that wait for each other never do.

    The least fixpoint by counting: each round only the callees of what joined last are counted, against in-degrees computed once.
    """
    cold = nodes.where("not hit").select(F.col("node").alias("callee"))
    calls = edges.where("caller <> callee").select("caller", "callee").distinct()
    degree = calls.groupBy("callee").agg(F.count(F.lit(1)).alias("degree"))
    calls = checkpointing(calls.join(cold, "callee", "left_semi").join(degree, "callee"))
    members = fresh = checkpointing(root_nodes.select("root", F.col("root").alias("member")).distinct())
    waiting = None  # callees met that still wait for callers: only these are carried on
    while True:
        step = fresh.select("root", F.col("member").alias("caller")).join(calls, "caller").groupBy("root", "callee", "degree").agg(F.count(F.lit(1)).alias("n"))
        step = step if waiting is None else waiting.unionByName(step).groupBy("root", "callee", "degree").agg(F.sum("n").alias("n"))
        step = checkpointing(step)
        waiting = step.where("n < degree")
        # the last of its callers has just joined, so a callee is complete once only; a root is a member already
        fresh = checkpointing(step.where("n = degree and callee <> root").select("root", F.col("callee").alias("member")))
        if fresh.isEmpty():
            return members
        members = members.union(fresh)


def ranked(sizes: DataFrame) -> DataFrame:
    """O2: clusters by size, largest first, then root. Sorted by ranges, not in one task."""
    return sizes.orderBy(F.desc("members"), "root")


def nearest_first(df: DataFrame, keys: list[str], by: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("_n") <= n).drop("_n")
