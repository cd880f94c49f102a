"""Payloads to state: what each field keeps when payloads repeat, arrive late or disagree (S1-S6, J7, A12, A13, sections 2.11 and 2.12).

A payload is a row of ``payloads``: payload_id, kind (DELTAS, MANIFEST, BASELINE, LISTING), instance_id, run_id, arrival_seq, heard_at (millis),
agent_version, fields_stripped, flush_interval_seconds, payload_sequence, starting, counts_pending_since, flush_complete, final_flush,
references_recorded, dependencies_listed, verifier_rejections_watched, unplaced_verification_failures. What a payload carries are rows of other tables
with its payload_id and, where the order inside it counts, pos. State depends on arrival_seq alone, not on the order of processing, so
batches and streams give the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import arrival_rank
from .scans import SCAN, accepted_chunks
from .validation import rejections

#: Longest flush interval that is believed, in seconds.
LONGEST_INTERVAL = 86_400
HEAD = ["payload_id", "instance_id", "run_id", "arrival_seq", "rank"]


def accepted(payloads: DataFrame, agent_version: str = "", one_jvm: bool = False) -> tuple[DataFrame, DataFrame]:
    """V6: (payloads that count, with the rank of their instance, and the rejected ones with a reason). Ranks go by first accepted payloads."""
    out = rejections(payloads, agent_version, one_jvm)
    good = payloads.join(out.select("payload_id"), "payload_id", "left_anti")
    return good.join(arrival_rank(good).select("instance_id", "rank"), "instance_id"), out


def carried(part: DataFrame, payloads: DataFrame) -> DataFrame:
    """The rows of a part that accepted payloads carry, with instance_id, run_id, arrival_seq and rank."""
    return part.join(payloads.select(*HEAD), "payload_id")


def _order(df: DataFrame) -> Column:
    return F.struct("arrival_seq", *(["pos"] if "pos" in df.columns else []))


def _one(df: DataFrame, keys: list[str], pick) -> DataFrame:
    values = [c for c in df.columns if c not in (*keys, "payload_id", "pos", "arrival_seq")]
    return df.groupBy(*keys).agg(pick(F.struct(*values), _order(df)).alias("v")).select(*keys, "v.*")


def last_write(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key that arrived last."""
    return _one(df, keys, F.max_by)


def first_write(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key that arrived first."""
    return _one(df, keys, F.min_by)


def newest_instance(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key from the newest instance (highest rank), and of that instance the first."""
    values = [c for c in df.columns if c not in (*keys, "payload_id", "pos", "arrival_seq")]
    age = F.struct((-F.col("rank")).alias("r"), *([_order(df).alias("o")]))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), age).alias("v")).select(*keys, "v.*")


def totals(deltas: DataFrame, payloads: DataFrame, keys: list[str], total: str = "hits_total") -> DataFrame:
    """The highest total of each counter in each run; repeats and late rows change nothing."""
    return carried(deltas, payloads).groupBy("instance_id", "run_id", *keys).agg(F.max(total).alias(total))


def probes(rows: DataFrame, payloads: DataFrame) -> DataFrame:
    """The probes as last reported, with their instance's rank."""
    return last_write(carried(rows, payloads).drop("run_id"), ["instance_id", "class_id", "probe_index"])


def supertypes(locations: DataFrame, rows: DataFrame, payloads: DataFrame) -> DataFrame:
    """(instance_id, class_name, super_class_name, interface_names, kotlin_kind, arrival_seq, pos) as each instance last reported. A class id
    means the class of that id among the probes of the same payload (the last of them), and nothing without one."""
    named = rows.groupBy("payload_id", "class_id").agg(F.max_by("class_name", "pos").alias("class_name"))
    at = carried(locations.join(named, ["payload_id", "class_id"]), payloads)
    best = F.max_by(F.struct("super_class_name", "interface_names", "kotlin_kind", "arrival_seq", "pos"), _order(at))
    return at.groupBy("instance_id", "class_name").agg(best.alias("v")).select("instance_id", "class_name", "v.*")


def merged_supertypes(per_instance: DataFrame) -> DataFrame:
    """One row per class over all instances: the last report."""
    return last_write(per_instance.drop("instance_id"), ["class_name"])


def supertype_edges(types: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, child, parent, is_interface, ord): the superclass at 0, then the interfaces in order."""
    up = F.when(F.col("super_class_name").isNotNull(), F.array(F.struct(F.col("super_class_name").alias("parent"), F.lit(False).alias("is_interface"), F.lit(0).alias("ord")))).otherwise(F.array().cast("array<struct<parent:string,is_interface:boolean,ord:int>>"))
    faces = F.transform(F.coalesce("interface_names", F.array().cast("array<string>")), lambda n, i: F.struct(n.alias("parent"), F.lit(True).alias("is_interface"), (i + 1).alias("ord")))
    return types.select(*keys, F.col("class_name").alias("child"), F.explode(F.concat(up, faces)).alias("e")).select(*keys, "child", "e.*")


def endpoints(rows: DataFrame, payloads: DataFrame) -> DataFrame:
    """Each instance's endpoints under their ids, as last reported; identities are as sent."""
    at = carried(rows, payloads)
    keep = at.withColumn("seq", F.col("arrival_seq"))
    return last_write(keep, ["instance_id", "endpoint_id"])


def disabled_modules(rows: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instance_id, module, kind) with the first kind that each instance reported, and one row per module from the newest instance."""
    at = carried(rows, payloads)
    per = first_write(at.select("instance_id", "module", "kind", "arrival_seq", "pos"), ["instance_id", "module"])
    return per, newest_instance(at.select("module", "reason", "kind", "rank", "arrival_seq", "pos"), ["module"]).drop("rank").orderBy("module")


def verifier_facts(failures: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(instance_id, class_name, reason): every reason an instance gave for a class; and (instance_id, unwatched, unplaced)."""
    reasons = carried(failures, payloads).select("instance_id", "class_name", "reason").distinct()
    own = payloads.where("kind = 'MANIFEST'").groupBy("instance_id").agg(F.bool_or(~F.col("verifier_rejections_watched")).alias("unwatched"), F.max("unplaced_verification_failures").alias("unplaced"))
    return reasons, own


def known_classes(rows: DataFrame, skipped: DataFrame, unreported: DataFrame, payloads: DataFrame) -> DataFrame:
    """S3: (instance_id, class_name) that a manifest named as probed, skipped or unreported: the classes that an instance has loaded."""
    out = None
    for part in (rows, skipped, unreported):
        names = carried(part.select("payload_id", "class_name"), payloads).select("instance_id", "class_name")
        out = names if out is None else out.unionByName(names)
    return out.distinct()


def dependencies(rows: DataFrame, deltas: DataFrame, payloads: DataFrame, state: DataFrame, complete: DataFrame) -> DataFrame:
    """S3: the listings that dependency_status reads. rows: dependency_id, identity_key, identities, discovery_source, class_count, location, as last
    reported; an unknown count is null. deltas: dependency_id, loaded_classes_total. state: of instance_state. complete (instance_id): those with
    a complete scan that gives evidence."""
    listed = last_write(carried(rows, payloads).drop("run_id", "rank"), ["instance_id", "dependency_id"])
    loaded = totals(deltas, payloads, ["dependency_id"], "loaded_classes_total").groupBy("instance_id", "dependency_id").agg(F.max("loaded_classes_total").alias("loaded_classes_total"))
    out = listed.join(loaded, ["instance_id", "dependency_id"], "left").fillna(0, ["loaded_classes_total"]).join(state.select("instance_id", "references_recorded"), "instance_id")
    done = complete.select("instance_id", F.lit(True).alias("baseline_complete")).distinct()
    return out.join(done, "instance_id", "left").fillna(False, ["baseline_complete"])


def external_classes(rows: DataFrame, payloads: DataFrame) -> DataFrame:
    """Which jar holds a referenced class of an instance, or none: the first report, of manifests and baselines alike."""
    return first_write(carried(rows, payloads).drop("run_id", "rank"), ["instance_id", "class_name"])


def class_references(rows: DataFrame, named: DataFrame, payloads: DataFrame) -> DataFrame:
    """S3: (instance_id, class_name, referenced_class) of class-level references, the last report of each class id; a class without a name is
    known by its id. named: instance_id, class_id, class_name."""
    last = last_write(carried(rows, payloads).drop("run_id", "rank"), ["instance_id", "class_id"])
    out = last.join(named, ["instance_id", "class_id"], "left")
    name = F.coalesce("class_name", F.concat(F.lit("class_id "), F.col("class_id").cast("string")))
    return out.select("instance_id", name.alias("class_name"), F.explode("referenced_classes").alias("referenced_class")).distinct()


def scans(chunks: DataFrame, declared: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks that count: scan, chunk_index, chunk_count, arrival_seq; the declared rows of those). chunks: payload_id, scanned_at, chunk_index,
    chunk_count. A scan's count is that of its first chunk; a repeated chunk's rows are left out."""
    at = carried(chunks, payloads)
    good = accepted_chunks(at)
    ids = at.join(good, [*SCAN, "chunk_index", "chunk_count", "arrival_seq"], "left_semi").select("payload_id", *SCAN)
    return good, declared.join(ids, "payload_id")


def listings(rows: DataFrame, payloads: DataFrame) -> DataFrame:
    """The class names of complete class listings: (instance_id, scanned_at, class_name), judged as scans are. The reference judges a listing's
    payload and drops it; it is kept here. rows: payload_id, listed_at, chunk_index, chunk_count, class_names."""
    at = rows.withColumnRenamed("listed_at", "scanned_at")
    good, kept = scans(at.drop("class_names"), at.select("payload_id", "class_names"), payloads)
    whole = good.groupBy(*SCAN).agg(F.count(F.lit(1)).alias("n"), F.max("chunk_count").alias("of")).where("n = of").select(*SCAN)
    return kept.join(whole, SCAN, "left_semi").select(*SCAN, F.explode("class_names").alias("class_name")).distinct()


def instance_state(payloads: DataFrame) -> DataFrame:
    """A12, A13, section 2.11: one row per instance heard from by deltas, manifests or baselines, as the gates read it.

    The flags starting and counts_pending are those of the highest payload sequence (of equal ones the first to arrive); sequence 0 changes
    none, but counts as a flush. last_heard is the last delta batch, or without one the first payload; the interval is the first one stated.
    """
    p = payloads.where("kind <> 'LISTING'")
    delta = F.col("kind") == "DELTAS"
    at = F.when(F.col("payload_sequence") > 0, F.struct("payload_sequence", (-F.col("arrival_seq")).alias("first")))
    flags = F.max_by(F.struct("starting", (F.col("counts_pending_since") != 0).alias("pending")), F.when(F.col("kind").isin("DELTAS", "MANIFEST"), at))
    done = delta & F.col("flush_complete")
    flushes = F.count_distinct(F.when(done & (F.col("payload_sequence") > 0), F.col("payload_sequence"))) + F.count_if(done & (F.col("payload_sequence") == 0))
    stated = F.col("flush_interval_seconds").between(1, LONGEST_INTERVAL)
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    out = p.groupBy("instance_id").agg(
        some(delta).alias("has_delta"), some(F.col("kind") == "MANIFEST").alias("has_manifest"), flags.alias("f"), some(delta & F.col("final_flush")).alias("ended"),
        some(done & F.col("final_flush")).alias("final_complete"), flushes.alias("flushes"), F.coalesce(F.max(F.when(delta, F.col("heard_at"))), F.min_by("heard_at", "arrival_seq")).alias("last_heard"),
        F.coalesce(F.min_by("flush_interval_seconds", F.when(stated, F.col("arrival_seq"))), F.lit(0)).alias("flush_interval_seconds"),
        some((F.col("kind") == "MANIFEST") & ~F.col("verifier_rejections_watched")).alias("unwatched"), F.coalesce(F.max(F.when(F.col("kind") == "MANIFEST", F.col("unplaced_verification_failures"))), F.lit(0)).alias("unplaced"),
        some(F.col("dependencies_listed")).alias("dependencies_listed"), some(F.col("references_recorded")).alias("references_recorded"), F.max_by("agent_version", "arrival_seq").alias("agent_version"), F.min("rank").alias("rank"),
    )
    no = F.lit(False)
    return out.select("*", F.coalesce("f.starting", no).alias("starting"), F.coalesce("f.pending", no).alias("counts_pending")).drop("f")
