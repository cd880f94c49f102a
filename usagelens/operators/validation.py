"""Row rejection (V1-V10). Every check gives the first reason that holds, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The code points that count as blank around a name.
BLANKS = r"\t\n\x0B\f\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
LAST_MILLIS = 253_402_300_799_999


def trimmed(x: Column) -> Column:
    """V2."""
    return F.regexp_replace(x, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


#: The checked fields in order.
FIELDS = ["service_name", "service_version", "instance_id", "environment", "run_id", "service_namespace", "agent_version"]


def invalid_resource(fields: list[str] = FIELDS, name: str = "service_name", namespace: str = "service_namespace", ids: tuple[str, ...] = ("instance_id", "run_id")) -> Column:
    """V1: sizes and NULs of all fields in order, then the trimmed name and its dots, the trimmed namespace's dots, and the ids."""
    text = lambda f: F.coalesce(F.col(f), F.lit(""))
    checks: list[Column] = []
    for f in fields:
        checks.append(F.when(F.octet_length(text(f)) > 1024, F.lit(f"{f} is longer than 1024 bytes")))
        checks.append(F.when(F.instr(text(f), "\0") > 0, F.lit(f"{f} holds NUL")))
    checks.append(F.when(trimmed(text(name)) == "", F.lit(f"{name} is empty")))
    checks += [F.when(trimmed(text(f)).isin(".", ".."), F.lit(f"{f} is a dot name")) for f in (name, namespace)]
    checks += [F.when(text(f) == "", F.lit(f"{f} is empty")) for f in ids]
    return F.coalesce(*checks)


def bad_timestamp(times: Column) -> Column:
    """The index (from 0) of the first time out of range; null if all are fine."""
    at = F.array_position(F.transform(times, lambda t: (t < 0) | (t > LAST_MILLIS)), True)
    return F.when(at > 0, at - 1)


def _bad_lists(lists: list[tuple[str, str]]) -> Column:
    """``list[index].field is out of range`` of the first list that holds such a time; each list is an array column of its name."""
    found = [bad_timestamp(F.coalesce(F.col(name), F.array().cast("array<long>"))) for name, _ in lists]
    return F.coalesce(*[F.when(at.isNotNull(), F.concat(F.lit(f"{name}["), at.cast("string"), F.lit(f"].{field} is out of range"))) for (name, field), at in zip(lists, found, strict=True)])


#: The lists of times in the order they are checked.
DELTA_TIMES = [("deltas", "first_seen_at"), ("endpoint_deltas", "first_seen_at"), ("dependency_deltas", "first_loaded_at")]
MANIFEST_TIMES = [
    ("unreported_classes", "first_seen_unreported_at"), ("failed_classes", "withheld_at"), ("classes_failed_to_initialize", "observed_at"), ("skipped_classes", "skipped_at"),
    ("disabled_endpoint_modules", "disabled_at"), ("framework_markers", "seen_at"),
]


def invalid_delta_batch() -> Column:
    """V3: an invalid resource, or the first time out of range. The times are array columns named as their lists."""
    return F.coalesce(invalid_resource(), _bad_lists(DELTA_TIMES))


def invalid_manifest() -> Column:
    """V4."""
    return F.coalesce(invalid_resource(), _bad_lists(MANIFEST_TIMES))


def invalid_chunk(at: str = "scanned_at") -> Column:
    """V5: without the resource, which callers check first."""
    index, count = F.col("chunk_index"), F.col("chunk_count")
    return F.when(F.col(at) <= 0, f"{at} is not set").when(count < 1, "chunk_count must be at least 1").when(index < 0, "chunk_index is negative").when(index >= count, "chunk_index is out of range for chunk_count")


def rejections(payloads: DataFrame, agent_version: str = "", one_jvm: bool = False) -> DataFrame:
    """V6: payloads (instance_id, run_id, agent_version, fields_stripped, arrival_seq) with a reason, oldest first by arrival_seq: STRIPPED
    fields, another AGENT_VERSION (both known), a SECOND_INSTANCE where one JVM is served, a SECOND_RUN of an instance.

    An instance's run is that of its first payload that passes the checks before; the one instance is that of the first payload that passes
    the first two. So a rejected payload decides nothing. A column invalid, if there is one, gives reasons found earlier (V1-V5).
    """
    early = F.when(F.col("fields_stripped"), "STRIPPED").when((F.lit(agent_version) != "") & (F.coalesce("agent_version", F.lit("")) != "") & (F.col("agent_version") != agent_version), "AGENT_VERSION")
    p = payloads.withColumn("reason", F.coalesce(F.col("invalid"), early) if "invalid" in payloads.columns else early)
    if one_jvm:
        only = p.where("reason is null").agg(F.min_by("instance_id", "arrival_seq").alias("_only"))  # one row
        p = p.crossJoin(F.broadcast(only)).withColumn("reason", F.coalesce("reason", F.when(F.col("instance_id") != F.col("_only"), "SECOND_INSTANCE"))).drop("_only")
    first = p.where("reason is null").groupBy("instance_id").agg(F.min_by("run_id", "arrival_seq").alias("_run"))
    p = p.join(first, "instance_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("run_id") != F.col("_run"), "SECOND_RUN"))).drop("_run")
    return p.where("reason is not null")


class Rejected(RuntimeError):
    """A payload was rejected, so every later answer would be incomplete."""


def unpoisoned(answer: DataFrame, rejected: DataFrame, most: int = 5) -> DataFrame:
    """V7: answer, or Rejected with the oldest reasons."""
    some = rejected.orderBy("arrival_seq").limit(most).collect()
    if some:
        raise Rejected("; ".join(f"{r.instance_id}: {r.reason}" for r in some))
    return answer


def reported(payloads: DataFrame) -> DataFrame:
    """V8: what the reporting collector keeps: a run id, no stripped fields, no test run."""
    return payloads.where("coalesce(run_id, '') <> '' and not fields_stripped and not test_run")


#: V9, fixed values: the most encoded bytes of a payload, the most elements of each kind, and the percentage of those that a chunk may use.
MOST_BYTES = 8 << 20
MOST_ELEMENTS = {"DELTA_BATCH": 500_000, "MANIFEST": 100_000, "STATIC_BASELINE": 200_000, "CLASS_LISTING": 100_000}
ELEMENT_PERCENT = 90


def exceeded_bound(kind: Column, size: Column, elements: Column) -> Column:
    """V9: the bound that a payload of so many encoded bytes and elements breaks: ENCODED_BYTES, ELEMENTS or null."""
    most = F.coalesce(*[F.when(kind == k, F.lit(n * ELEMENT_PERCENT // 100)) for k, n in MOST_ELEMENTS.items()])
    return F.when(size > MOST_BYTES, "ENCODED_BYTES").when(elements > most, "ELEMENTS")


def in_scope(names: DataFrame, rules: DataFrame, name: str = "class_name") -> DataFrame:
    """Names that an include rule covers and no exclude rule does. A rule covers itself and what follows it at ``.`` or ``$``.

    rules: prefix, include. A name's prefixes at boundaries are joined with the rules by equality.
    """
    cuts = F.transform(F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: F.substr(F.col(name), i + 1, F.lit(1)).isin(".", "$", "")), lambda i: F.substr(F.col(name), F.lit(1), i))
    hits = names.select(name, F.explode(cuts).alias("prefix")).join(rules, "prefix").groupBy(name).agg(F.bool_and("include").alias("ok"))
    return names.join(hits.where("ok").select(name), name, "left_semi")
