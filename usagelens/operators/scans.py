"""Static scans: completeness, latest, merged; never-loaded classes (S5, A9-A11, Q15, Q16, Q32; sweeps of section 2.12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCAN = ["instance_id", "scanned_at"]


def accepted_chunks(chunks: DataFrame) -> DataFrame:
    """(scan, chunk_index, chunk_count, arrival_seq) of the chunks that count: valid ones (0 <= index < count, at > 0) that state the count of
    the scan's first valid chunk to arrive; of repeats the first."""
    valid = chunks.where("scanned_at > 0 and chunk_count >= 1 and chunk_index >= 0 and chunk_index < chunk_count")
    count = valid.groupBy(*SCAN).agg(F.min_by("chunk_count", "arrival_seq").alias("chunk_count"))
    return valid.join(count, [*SCAN, "chunk_count"], "left_semi").groupBy(*SCAN, "chunk_index").agg(F.min("chunk_count").alias("chunk_count"), F.min("arrival_seq").alias("arrival_seq"))


def complete_scans(chunks: DataFrame) -> DataFrame:
    """Scans whose indexes 0 .. count - 1 have all arrived."""
    per = accepted_chunks(chunks).groupBy(*SCAN).agg(F.count(F.lit(1)).alias("n"), F.max("chunk_count").alias("chunk_count"))
    return per.where("n = chunk_count").select(*SCAN, "chunk_count")


def latest_scans(complete: DataFrame) -> DataFrame:
    """A10."""
    return complete.groupBy("instance_id").agg(F.max("scanned_at").alias("scanned_at"))


def merged_classes(declared: DataFrame) -> DataFrame:
    """One row per class over the scans in instance order: the first superclass, all interfaces, the first kind that isn't NONE, and the
    declared methods as an array of (instance_id, method_name, method_descriptor); methods is their distinct number.

    declared: instance_id, class_name, super_class_name, interface_names, method_name, method_descriptor, and kind if there is one.
    """
    first = lambda c, ok: F.min_by(c, F.when(ok, F.col("instance_id")))
    kind = F.coalesce(first("kind", F.col("kind") != "NONE"), F.lit("NONE")) if "kind" in declared.columns else F.lit("NONE")
    return declared.groupBy("class_name").agg(
        first("super_class_name", F.col("super_class_name").isNotNull()).alias("super_class_name"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("interface_names")))).alias("interfaces"),
        F.count_distinct("method_name", "method_descriptor").alias("methods"), kind.alias("kind"), F.array_sort(F.collect_set(F.struct("instance_id", "method_name", "method_descriptor"))).alias("method_list"),
    )


def never_loaded(declared: DataFrame, evidencing: DataFrame, known: DataFrame, failed: DataFrame) -> DataFrame:
    """Q15: declared by the latest complete scan of an instance that gives evidence, with an ordinary method, neither known nor failed."""
    rows = declared.join(evidencing, SCAN, "left_semi").where("ordinary").select("class_name").distinct()
    return rows.join(known, "class_name", "left_anti").join(failed, "class_name", "left_anti")


def failed_to_load(failed: DataFrame, known: DataFrame) -> DataFrame:
    """Q16."""
    return failed.select("class_name").distinct().join(known, "class_name", "left_anti")


def report_buckets(chunks: DataFrame, declared: DataFrame, unprobed: DataFrame, unreadable: DataFrame, known: DataFrame, failed: DataFrame) -> DataFrame:
    """Q32: (bucket, class_name, detail) of the reporting collector's never-loaded report. While any scan is incomplete, only INCOMPLETE_SCAN rows
    come, one per scan (``received of count``). Else NEVER_LOADED with the method names, ALL_INLINE_OR_GENERATED for classes whose every method is
    looked through, UNPROBED and UNREADABLE with their reasons.

    declared: class_name, method_name, ordinary. unprobed, unreadable: class_name, reason (the first by name if several).
    """
    per = accepted_chunks(chunks).groupBy(*SCAN).agg(F.count(F.lit(1)).alias("n"), F.max("chunk_count").alias("of"))
    open_ = per.where("n < of").select(F.lit("INCOMPLETE_SCAN").alias("bucket"), F.concat_ws(" ", "instance_id", F.col("scanned_at").cast("string")).alias("class_name"), F.concat_ws(" of ", F.col("n").cast("string"), F.col("of").cast("string")).alias("detail"))
    rows = declared.groupBy("class_name").agg(F.array_join(F.array_sort(F.collect_set("method_name")), ", ").alias("names"), F.bool_or("ordinary").alias("ordinary"), F.count("method_name").alias("n"))
    rows = rows.join(known, "class_name", "left_anti").join(failed, "class_name", "left_anti")
    inline = (F.col("n") > 0) & ~F.col("ordinary")
    judged = rows.select(F.when(inline, "ALL_INLINE_OR_GENERATED").otherwise("NEVER_LOADED").alias("bucket"), "class_name", F.when(~inline, F.col("names")).alias("detail"))
    other = [df.groupBy("class_name").agg(F.min("reason").alias("detail")).select(F.lit(b).alias("bucket"), "class_name", "detail") for df, b in ((unprobed, "UNPROBED"), (unreadable, "UNREADABLE"))]
    whole = judged.unionByName(other[0]).unionByName(other[1])
    stop = F.broadcast(open_.agg((F.count(F.lit(1)) == 0).alias("_go")))  # one row
    return open_.unionByName(whole.crossJoin(stop).where("_go").drop("_go"))


def unreported(loaded: DataFrame, known: DataFrame) -> DataFrame:
    """Section 2.12: loaded classes (instance_id, class_name) that no manifest of their instance reports."""
    return loaded.select("instance_id", "class_name").distinct().join(known.select("instance_id", "class_name"), ["instance_id", "class_name"], "left_anti")


def baseline_mismatches(registered: DataFrame, scanned: DataFrame) -> DataFrame:
    """Section 2.12: registered classes (instance_id, class_name) missing from their instance's scan, once each; instances without a scan are left out."""
    has = scanned.select("instance_id").distinct()
    return unreported(registered.join(has, "instance_id", "left_semi"), scanned)
