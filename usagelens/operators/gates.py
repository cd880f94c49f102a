"""Evidence gates: which instances hold an answer back, and why (section 2.10). ``now`` is a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000


class NotEvidence(RuntimeError):
    """An instance's zero counts aren't evidence yet."""


def live(now: int):
    """Not ended, and silent for less than three flush intervals (an hour where the interval is unknown)."""
    limit = F.when(F.col("flush_interval_seconds") > 0, F.col("flush_interval_seconds").cast("long") * 3000).otherwise(F.lit(HOUR))
    return ~F.col("ended") & (F.lit(now) - F.col("last_heard") < limit)


def zero_holds(instances: DataFrame, now: int) -> DataFrame:
    """(instance_id, reason) while zero counts aren't evidence; the first reason that holds."""
    reason = (
        F.when(~F.col("has_delta"), "NO_DELTA").when(F.col("counts_pending"), "COUNTS_PENDING").when(live(now) & F.col("starting"), "STARTING")
        .when(F.col("unwatched"), "UNWATCHED").when(F.col("unplaced") > 0, "UNPLACED_FAILURES")
    )
    return instances.where("has_manifest or has_delta").select("instance_id", reason.alias("reason")).where("reason is not null")


def live_holds(instances: DataFrame, now: int) -> DataFrame:
    """(instance_id, reason) of live instances that lag behind."""
    reason = F.when(~F.col("has_delta"), "NO_DELTA").when(F.col("counts_pending"), "COUNTS_PENDING").when(F.col("starting"), "STARTING")
    return instances.where(live(now)).select("instance_id", reason.alias("reason")).where("reason is not null")


def listing_holds(instances: DataFrame, listing: DataFrame, now: int) -> DataFrame:
    """(instance_id, reason) of the instances that list a dependency (listing: instance_id), live or not, while their loaded-class counts aren't
    all in."""
    reason = F.when(~F.col("has_delta"), "NO_DELTA").when(F.col("counts_pending"), "COUNTS_PENDING").when(live(now) & F.col("starting"), "STARTING")
    own = instances.join(listing.select("instance_id").distinct(), "instance_id", "left_semi")
    return own.select("instance_id", reason.alias("reason")).where("reason is not null")


def listed_holds(instances: DataFrame) -> DataFrame:
    """(instance_id, reason): instances that haven't sent their whole dependency listing (dependencies_listed); one row with a null instance if none
    was heard from."""
    waiting = instances.where(~F.coalesce("dependencies_listed", F.lit(False))).select("instance_id", F.lit("NOT_LISTED").alias("reason"))
    heard = instances.agg((F.count(F.lit(1)) == 0).alias("none")).where("none")  # one row at most
    return waiting.unionByName(heard.select(F.lit(None).cast("string").alias("instance_id"), F.lit("NO_INSTANCE").alias("reason")))


def not_settled(instances: DataFrame, flushes_before: DataFrame, now: int, needed: int = 2) -> DataFrame:
    """Q29: (instance_id, reason) of instances whose counts may still move: pending, ended by an incomplete final flush, starting, or fewer than
    needed complete flushes since flushes_before (instance_id, flushes). A complete final flush settles.

    instances also: ended, final_complete, flushes.
    """
    x = instances.join(flushes_before.select("instance_id", F.col("flushes").alias("_before")), "instance_id", "left")
    since = F.col("flushes") - F.coalesce("_before", F.lit(0))
    reason = (
        F.when(~F.col("has_delta"), "NO_DELTA").when(F.col("counts_pending"), "COUNTS_PENDING").when(F.col("final_complete"), None)
        .when(F.col("ended"), "INCOMPLETE_FINAL_FLUSH").when(live(now) & F.col("starting"), "STARTING").when(since < needed, "TOO_FEW_FLUSHES")
    )
    return x.select("instance_id", reason.alias("reason")).where("reason is not null")


def scan_evidence(instances: DataFrame, now: int) -> DataFrame:
    return instances.where(live(now) | (F.col("has_delta") & ~F.col("starting"))).select("instance_id")


def checked(findings: DataFrame, holds: DataFrame) -> DataFrame:
    """findings, or NotEvidence with the first reasons: an empty result would be a wrong answer."""
    some = holds.orderBy("instance_id").limit(5).collect()  # bounded
    if some:
        raise NotEvidence("; ".join(f"{r.instance_id}: {r.reason}" for r in some))
    return findings
