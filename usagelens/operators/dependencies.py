"""Dependency status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import site_text

#: In the order of the rules; ordinals matter for sorting.
STATUSES = ["RESOURCES_ONLY", "UNLOADED", "LOADED", "USED", "FAILED_TO_LOAD", "FAILED_TO_INITIALIZE", "WITHOUT_EVIDENCE", "NO_LIVE_REFERENCE", "UNREFERENCED", "UNREACHED"]
#: Attributes of a jar's manifest that mark an agent and a boot application.
AGENT_ATTRIBUTES = ["Premain-Class", "Launcher-Agent-Class"]
BOOT_ATTRIBUTES = ["Spring-Boot-Classpath-Index", "Spring-Boot-Lib"]


def reference_flags(references: DataFrame, classes: DataFrame) -> DataFrame:
    """Each held reference that counts, with live, failed_to_load, failed_to_initialize, never_loaded, without (evidence) and its site text.

    references: instance_id, class_name, method_name (null: the class), origin, referenced_class, inline, method_hit, without_evidence.
    classes: instance_id, class_name, loaded, failed, failed_init. A manifest's class reference is live in its own instance, another class
    reference where the class is loaded anywhere, a method's where the method was hit anywhere. A class loaded anywhere hasn't failed to load.
    """
    anywhere = classes.groupBy("class_name").agg(F.bool_or("loaded").alias("loaded_any"), F.bool_or("failed").alias("failed"), F.bool_or("failed_init").alias("failed_init"))
    own = classes.groupBy("instance_id", "class_name").agg(F.bool_or("loaded").alias("loaded_here"))
    r = references.where("not inline").join(anywhere, "class_name", "left").join(own, ["instance_id", "class_name"], "left")
    no = F.lit(False)
    level, loaded, baseline = F.col("method_name").isNull(), F.coalesce("loaded_any", no), F.col("origin") == "BASELINE"
    live = F.when(F.col("origin") == "MANIFEST_CLASS", F.coalesce("loaded_here", no)).when(level, loaded).otherwise(F.col("method_hit"))
    failed_init = F.coalesce("failed_init", no)
    r = r.withColumns({"was_live": live, "failed_to_load": baseline & F.coalesce("failed", no) & ~loaded})
    r = r.withColumn("live", F.col("was_live") & ~(failed_init & level))
    r = r.withColumns({"failed_to_initialize": failed_init & ~F.col("live"), "without": ~F.col("was_live") & ~level & F.col("without_evidence"), "never_loaded": baseline & ~F.col("failed_to_load") & ~loaded})
    return r.withColumn("site", site_text(F.col("class_name"), F.col("method_name"), F.col("never_loaded"), F.col("failed_to_load"), F.col("failed_to_initialize")))


def _identities(listings: DataFrame) -> DataFrame:
    """(identity_key, identities, versions): the distinct ``group:artifact`` of a key, and ``group:artifact:version`` of those with a version, sorted."""
    if "identities" not in listings.columns:
        return listings.select("identity_key", F.array("identity_key").alias("identities"), F.array().cast("array<string>").alias("versions")).distinct()
    name = lambda i: F.concat(F.coalesce(i["group_id"], F.lit("")), F.lit(":"), i["artifact_id"])
    each = listings.select("identity_key", F.explode_outer("identities").alias("i")).distinct()
    versioned = F.when(F.coalesce(F.col("i.version"), F.lit("")) != "", F.concat(name(F.col("i")), F.lit(":"), F.col("i.version")))
    return each.groupBy("identity_key").agg(F.array_sort(F.collect_set(name(F.col("i")))).alias("identities"), F.array_sort(F.collect_set(versioned)).alias("versions"))


def dependency_status(listings: DataFrame, references: DataFrame, classes: DataFrame, externals: DataFrame) -> DataFrame:
    """One status per identity key, the first rule that holds, with loaded_total, class_count, sources, identities, versions, the sites that
    refer to it (texts, sorted), whether one of them reads never loaded, and the instances that list it.

    listings: instance_id, dependency_id, identity_key, discovery_source, class_count, loaded_classes_total, references_recorded,
    baseline_complete, and identities (group_id, artifact_id, version) if known. externals: instance_id, class_name, dependency_id, absent. Only
    instances that record references hold any. Sites are gathered per dependency, distinct ones only.
    """
    recording = listings.where("references_recorded").select("instance_id").distinct()
    held = reference_flags(references.join(recording, "instance_id", "left_semi"), classes)
    mapped = held.join(externals.where("not absent").select("instance_id", F.col("class_name").alias("referenced_class"), "dependency_id"), ["instance_id", "referenced_class"])
    mapped = mapped.join(listings.select("instance_id", "dependency_id", "identity_key").distinct(), ["instance_id", "dependency_id"])
    flags = ("live", "failed_to_load", "failed_to_initialize", "without", "never_loaded")
    # distinct sites first: many rows of one key meet in small groups before they meet in one
    sites = mapped.groupBy("identity_key", "site").agg(*[F.bool_or(c).alias(c) for c in flags])
    refs = sites.groupBy("identity_key").agg(*[F.bool_or(c).alias(c) for c in flags], F.array_sort(F.collect_list("site")).alias("sites"))
    per = listings.groupBy("identity_key").agg(
        F.max("loaded_classes_total").alias("loaded_total"), F.max("class_count").alias("class_count"), F.array_join(F.array_sort(F.collect_set("discovery_source")), ",").alias("sources"),
        F.bool_and(F.coalesce(F.col("class_count") == 0, F.lit(False))).alias("no_class"), F.bool_or(F.col("discovery_source") == "STARTUP_CLASSPATH").alias("startup"),
        F.bool_or("references_recorded").alias("judging"), F.coalesce(F.bool_and(F.when(F.col("references_recorded"), F.col("baseline_complete"))), F.lit(True)).alias("complete"),
        F.array_sort(F.collect_set("instance_id")).alias("instances"),
    )
    x = per.join(refs, "identity_key", "left").join(_identities(listings), "identity_key")
    rules = ["loaded_total = 0 and no_class", "loaded_total = 0 and startup", "not judging", "live", "failed_to_load", "failed_to_initialize", "without", "not complete", "live is null"]
    status = F.coalesce(*[F.when(F.expr(rule), F.lit(name)) for rule, name in zip(rules, STATUSES, strict=False)], F.lit(STATUSES[-1]))
    none = F.array().cast("array<string>")
    return x.select(
        "identity_key", status.alias("status"), "loaded_total", "class_count", "sources", "identities", "versions", F.coalesce("sites", none).alias("sites"),
        F.coalesce("never_loaded", F.lit(False)).alias("never_loaded"), "instances",
    )


class Ambiguous(LookupError):
    """Several dependencies carry an identity and none has it alone."""


def carrying(findings: DataFrame, group_id: str | None, artifact_id: str) -> DataFrame:
    """Q23: the one finding that carries ``group:artifact``: of several the one whose only identity it is. Raises LookupError if none carries it, and
    Ambiguous, naming the keys, if several do and not exactly one has it alone."""
    wanted = f"{group_id or ''}:{artifact_id}"
    found = findings.where(F.array_contains("identities", wanted))
    keys = found.select("identity_key", (F.size("identities") == 1).alias("alone")).orderBy("identity_key").collect()  # jars that bundle one artifact
    if not keys:
        raise LookupError(f"{wanted}: never listed by any manifest")
    alone = [r.identity_key for r in keys if r.alone]
    if len(keys) > 1 and len(alone) != 1:
        raise Ambiguous(f"{wanted} is carried by {len(keys)} dependencies: " + ", ".join(r.identity_key for r in keys))
    return found.where(F.col("identity_key") == (keys[0].identity_key if len(keys) == 1 else alone[0]))


class NotSplit(RuntimeError):
    """References are unknown, so unreferenced and unreached can't be told apart."""


def with_status(findings: DataFrame, status: str) -> DataFrame:
    """Q24: the findings of one status by key. All but UNLOADED need references from every instance that judges, so a finding that reads
    NO_LIVE_REFERENCE or LOADED raises NotSplit."""
    if status != "UNLOADED":
        unsplit = findings.where(F.col("status").isin("NO_LIVE_REFERENCE", "LOADED")).select("identity_key").orderBy("identity_key").limit(5).collect()
        if unsplit:
            raise NotSplit("these read NO_LIVE_REFERENCE or LOADED: " + ", ".join(r.identity_key for r in unsplit))
    return findings.where(F.col("status") == status).orderBy("identity_key")


def jar_kind(attributes: Column, class_names: Column, own_prefix: str, in_scope: Column) -> Column:
    """Section 2.12: how a jar counts: AGENT or BOOT_APPLICATION by its manifest's attributes, AGENT_CLASSES if it holds classes under own_prefix,
    ADOPTERS_OWN if any of its classes (in_scope: an array of flags beside class_names) is in scope, else DEPENDENCY."""
    has = lambda names: F.arrays_overlap(F.coalesce(F.map_keys(attributes), F.array().cast("array<string>")), F.array(*map(F.lit, names)))
    return (
        F.when(has(AGENT_ATTRIBUTES), "AGENT").when(has(BOOT_ATTRIBUTES), "BOOT_APPLICATION").when(F.exists(class_names, lambda c: F.startswith(c, F.lit(own_prefix))), "AGENT_CLASSES")
        .when(F.exists(in_scope, lambda f: f), "ADOPTERS_OWN").otherwise("DEPENDENCY")
    )


def in_status_order(findings: DataFrame) -> DataFrame:
    """O3: by the ordinal of the status, then by key."""
    return findings.orderBy(F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")), "identity_key")


def absent_references(references: DataFrame, externals: DataFrame, classes: DataFrame | None = None, recording: DataFrame | None = None) -> DataFrame:
    """Q25: referenced classes that no loader found, with the sorted texts of the sites that refer to them, and whether one of those reads never
    loaded. classes (as in reference_flags) give the sites' marks; recording (instance_id) are the instances whose references count."""
    refs = references if recording is None else references.join(recording.select("instance_id").distinct(), "instance_id", "left_semi")
    if classes is None:
        classes = references.sparkSession.createDataFrame([], "instance_id string, class_name string, loaded boolean, failed boolean, failed_init boolean")
    gone = externals.where("absent").select("instance_id", F.col("class_name").alias("referenced_class"))
    sites = reference_flags(refs.join(gone, ["instance_id", "referenced_class"], "left_semi"), classes).groupBy("referenced_class", "site").agg(F.bool_or("never_loaded").alias("never_loaded"))
    return sites.groupBy("referenced_class").agg(F.array_sort(F.collect_list("site")).alias("sites"), F.bool_or("never_loaded").alias("never_loaded"))
