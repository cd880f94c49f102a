"""Counter merging: max inside a run, sum across runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .closure import checkpointing

PROBE = ["instance_id", "class_id", "probe_index"]
METHOD = ["class_name", "method_name", "method_descriptor"]
LOCATION = [*METHOD, "kind", "parameter_index", "outcome"]


def run_totals(deltas: DataFrame, keys: list[str], run: list[str] = ["instance_id", "run_id"]) -> DataFrame:  # noqa: B006
    """The total of each counter in each run. Totals are cumulative, so repeats and late rows change nothing."""
    return deltas.groupBy(*run, *keys).agg(F.max("hits_total").alias("hits"))


def total_hits(deltas: DataFrame, keys: list[str], run: list[str] = ["instance_id", "run_id"]) -> DataFrame:  # noqa: B006
    """A1: max per (run, counter), then sum over the runs."""
    return run_totals(deltas, keys, run).groupBy(*keys).agg(F.sum("hits").alias("hits"))


def was_hit(deltas: DataFrame, keys: list[str]) -> DataFrame:
    """A2: whether any run hit the counter."""
    return deltas.groupBy(*keys).agg(F.bool_or(F.col("hits_total") > 0).alias("was_hit"))


def outcome_id() -> Column:
    """the branch key, or else the tagged branch index; both copies of an outcome never meet."""
    return F.coalesce(F.concat(F.lit("k:"), "branch_key"), F.concat(F.lit("i:"), F.col("branch_index").cast("string")))


SLOTS = ("INITIALIZER_RETURNED", "INITIALIZER_THREW")


def find_probes(probes: DataFrame, class_name: str, method_name: str, descriptor: str | None = None) -> DataFrame:
    """The METHOD probes of a method; without a descriptor those of every overload."""
    found = probes.where((F.col("kind") == "METHOD") & (F.col("class_name") == class_name) & (F.col("method_name") == method_name))
    return found if descriptor is None else found.where(F.col("method_descriptor") == descriptor)


def with_site_marks(probes: DataFrame, sites: DataFrame) -> DataFrame:
    """Probes whose outcomes take routine_ord from their site and the higher unread_ord of site and probe, per instance.

    sites: a row per outcome of a site: instance_id, METHOD columns, branch_index, guard, routine_ord, unread_ord. Methods are never routine.
    """
    marks = sites.groupBy("instance_id", *METHOD, "branch_index").agg(F.max("routine_ord").alias("_r"), F.max("unread_ord").alias("_u"))
    branch = (F.col("kind") == "BRANCH") & F.col("branch_index").isNotNull()
    x = probes.join(marks, ["instance_id", *METHOD, "branch_index"], "left")
    routine = F.when(branch, F.coalesce("_r", F.lit(0))).otherwise(F.lit(0))
    unread = F.when(branch, F.greatest("unread_ord", F.coalesce("_u", F.lit(0)))).otherwise(F.col("unread_ord"))
    return x.withColumns({"routine_ord": routine, "unread_ord": unread}).select(*probes.columns, *[c for c in ("routine_ord", "unread_ord") if c not in probes.columns])


def _age() -> Column:
    return F.struct((-F.col("rank")).alias("r"), "instance_id", "class_id", "probe_index")


def site_guards(probes: DataFrame, sites: DataFrame) -> DataFrame:
    """(METHOD columns, outcome, guard): the outcome that guards a location's site, as its newest copy states it. A guard is an index of the
    same instance and method, and is given as the outcome id there."""
    branches = probes.where("kind = 'BRANCH' and branch_index is not null").withColumn("outcome", outcome_id())
    newest = branches.groupBy(*METHOD, "outcome").agg(F.min_by(F.struct("instance_id", "branch_index"), _age()).alias("n")).select(*METHOD, "outcome", "n.instance_id", "n.branch_index")
    at = sites.where("guard is not null").groupBy("instance_id", *METHOD, "branch_index").agg(F.max("guard").alias("g"))
    ids = branches.select("instance_id", *METHOD, F.col("branch_index").alias("g"), F.col("outcome").alias("guard")).distinct()
    return newest.join(at, ["instance_id", *METHOD, "branch_index"]).join(ids, ["instance_id", *METHOD, "g"]).select(*METHOD, "outcome", "guard")


def probe_hits(probes: DataFrame, deltas: DataFrame) -> DataFrame:
    """Probes with their hits, 0 where no delta arrived. Runs of an instance add up."""
    hits = run_totals(deltas, ["class_id", "probe_index"]).groupBy(*PROBE).agg(F.sum("hits").alias("hits"))
    return probes.join(hits, PROBE, "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))


def merged_locations(probes: DataFrame, deltas: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """One row per location with each attribute merged by its own rule; slots of initialisers have none.

    The newest member (highest arrival rank, then smallest instance, class_id and index) gives line and parameter_name; routine and unread
    and outside are the first that are set in that order; generated is the highest ordinal; flags are OR; branch_index the least; target_class_name and
    inlined_from the last by name. parameter_name, inlined_from and outside (a struct) may be absent. With sites, J4 comes first.
    """
    probes = probes.where(~F.col("kind").isin(*SLOTS))
    if sites is not None:
        probes = with_site_marks(probes, sites)
    members = probe_hits(probes, deltas).withColumns({"outcome": F.when(F.col("kind") == "BRANCH", outcome_id()), "age": _age()})
    flags = [F.bool_or(c).alias(c) for c in ("inline", "static", "lambda_body", "overridable")]
    first = [F.coalesce(F.min_by(c, F.when(F.col(c) > 0, F.col("age"))), F.lit(0)).alias(c) for c in ("routine_ord", "unread_ord")]
    more = {"parameter_name": F.min_by("parameter_name", "age"), "inlined_from": F.max("inlined_from"), "outside": F.min_by("outside", F.when(F.col("outside").isNotNull(), F.col("age")))}
    extra = [a.alias(c) for c, a in more.items() if c in probes.columns]
    return members.groupBy(*LOCATION).agg(
        F.sum("hits").alias("hits"), F.min_by("line", "age").alias("line"), F.min("branch_index").alias("branch_index"), F.max("generated_ord").alias("generated_ord"),
        F.max("target_class_name").alias("target_class_name"), F.count_distinct("instance_id").alias("instances"), *flags, *first, *extra,
    )


def delivery_state(states: DataFrame) -> DataFrame:
    """(instance_id, payload_sequence, starting, counts_pending) as of each instance's highest payload sequence; sequence 0 never counts.
    Copies of one sequence that differ: the first to arrive (arrival_seq) counts."""
    at = F.when(F.col("payload_sequence") > 0, F.struct("payload_sequence", (-F.col("arrival_seq")).alias("first")))
    newest = F.max_by(F.struct("payload_sequence", "starting", "counts_pending"), at)
    return states.groupBy("instance_id").agg(newest.alias("n")).select("instance_id", "n.payload_sequence", "n.starting", "n.counts_pending")


def complete_flushes(batches: DataFrame) -> DataFrame:
    """Complete flushes of each instance: distinct positive sequences, and every batch of sequence 0."""
    done = F.col("flush_complete")
    many = F.count_distinct(F.when(done & (F.col("payload_sequence") > 0), F.col("payload_sequence"))) + F.count_if(done & (F.col("payload_sequence") == 0))
    return batches.groupBy("instance_id").agg(many.alias("flushes"))


def arrival_rank(payloads: DataFrame) -> DataFrame:
    """Instances by their first accepted payload, from 0. Equal first payloads share a rank."""
    first = payloads.groupBy("instance_id").agg(F.min("arrival_seq").alias("first"))
    # ranges of first, ranked inside and shifted by what lies below: no range holds all instances. The bounds come from a sample that differs
    # each time the ranges are dealt, so they are dealt once and written. Without a first payload an instance comes last, as in SQL
    parts = max(1, int(payloads.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = F.col("first").asc_nulls_last()
    ranged = checkpointing(first.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()))
    inner = ranged.withColumn("r", F.dense_rank().over(Window.partitionBy("part").orderBy(order)))
    sizes = inner.groupBy("part").agg(F.max("r").alias("n"))
    below = sizes.alias("a").join(F.broadcast(sizes).alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("below"))  # a row per partition
    return inner.join(F.broadcast(below), "part").select("instance_id", "first", (F.col("r") - 1 + F.col("below")).cast("int").alias("rank"))


def changed_deltas(snapshots: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows whose total differs from the one delivered before (0 before the first)."""
    before = F.lag("hits_total", 1, 0).over(Window.partitionBy(*keys).orderBy(order))
    return snapshots.withColumn("delivered", before).where(F.col("hits_total") != F.col("delivered"))


def first_loaded(deltas: DataFrame, keys: list[str], at: str = "first_loaded_at") -> DataFrame:
    """The first positive time of each key; null if there is none."""
    return deltas.groupBy(*keys).agg(F.min(F.when(F.col(at) > 0, F.col(at))).alias("first_loaded_at"))


def marker_seen(markers: DataFrame, keys: list[str]) -> DataFrame:
    """Section 2.12: when each framework marker was first seen in a run."""
    return markers.groupBy(*keys).agg(F.min("seen_at").alias("seen_at"))


def reason_sets(reports: DataFrame) -> DataFrame:
    """The sorted distinct reasons of each class."""
    return reports.groupBy("class_name").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def loaded_classes(loaded: DataFrame, key: str = "dependency_id") -> DataFrame:
    """Distinct loaded class names of each jar."""
    return loaded.groupBy(key).agg(F.count_distinct("class_name").alias("loaded"))


def edge_union(*edges: DataFrame) -> DataFrame:
    """The distinct edges of manifests and baselines."""
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return out.distinct()


def withheld_classes(*names: DataFrame) -> DataFrame:
    """The classes of any of the lists (class_name): skipped, in an initialiser gap, failed."""
    return edge_union(*[n.select("class_name") for n in names])
