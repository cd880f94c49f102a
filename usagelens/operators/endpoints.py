"""Endpoint calls and never-called endpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_route, normalize_verb

ENDPOINT = ["verb", "route", "template_kind"]


def identities(endpoints: DataFrame) -> DataFrame:
    """Endpoints under their identity: normalised verb and route, and the template kind."""
    return endpoints.withColumns({"verb": normalize_verb(F.col("verb")), "route": normalize_route(F.col("route"))})


def call_counts(deltas: DataFrame, run: list[str] = ["instance_id", "run_id"]) -> DataFrame:  # noqa: B006
    """A4: calls of each (verb, route): the highest total of an endpoint id in each run, summed. deltas carry verb and route as sent; they are
    brought to one form once the totals are merged."""
    per = deltas.groupBy(*run, "endpoint_id", "verb", "route").agg(F.max("hits_total").alias("hits")).groupBy("verb", "route").agg(F.sum("hits").alias("calls"))
    return identities(per).groupBy("verb", "route").agg(F.sum("calls").alias("calls"))


def failed_before_declaring(endpoints: DataFrame, disabled: DataFrame) -> DataFrame:
    """Q20: modules (instance_id, module) that an instance disabled by a failure before it reported an endpoint of theirs. disabled: instance_id,
    module, kind, the first report of each."""
    failed = disabled.where(~F.coalesce("kind", F.lit("")).isin("CONFIGURED_OFF", "ROUTES_NOT_COUNTED")).select("instance_id", "module")
    return failed.join(endpoints.select("instance_id", F.col("framework").alias("module")).distinct(), ["instance_id", "module"], "left_anti")


def endpoint_status(endpoints: DataFrame, hits: DataFrame, disabled: DataFrame, gaps: DataFrame, failed_before_declaring: DataFrame) -> DataFrame:
    """Q20, Q31: (identity, calls, status) with CALLED, NOT_JUDGED or NEVER_CALLED.

    endpoints: instance_id, endpoint_id, identity, framework, discovery_source, handler_class. hits: instance_id, endpoint_id, hits. An endpoint isn't
    judged if a framework of its is disabled, if it is known from dispatch only, if its handler lies in gaps (instance_id,
    class_name) in every instance that lists it, or if any module failed before declaring its endpoints.
    """
    e = endpoints.join(hits, ["instance_id", "endpoint_id"], "left")
    e = e.join(disabled.select("framework", F.lit(True).alias("off")).distinct(), "framework", "left")
    e = e.join(gaps.select("instance_id", F.col("class_name").alias("handler_class"), F.lit(True).alias("gap")).distinct(), ["instance_id", "handler_class"], "left")
    # first under the verbs and routes as reported, so that only distinct ones are brought to one form
    e = e.groupBy(*ENDPOINT).agg(
        F.sum(F.coalesce("hits", F.lit(0))).cast("long").alias("calls"), F.coalesce(F.bool_or("off"), F.lit(False)).alias("off"),
        F.bool_and(F.col("discovery_source") == "DISPATCH").alias("dispatch"), F.bool_and(F.coalesce("gap", F.lit(False))).alias("gapped"),
    )
    out = identities(e).groupBy(*ENDPOINT).agg(F.sum("calls").cast("long").alias("calls"), F.bool_or("off").alias("off"), F.bool_and("dispatch").alias("dispatch"), F.bool_and("gapped").alias("gapped"))
    blind = failed_before_declaring.agg((F.count(F.lit(1)) > 0).alias("blind"))  # one row
    out = out.crossJoin(F.broadcast(blind))
    status = F.when(F.col("calls") > 0, "CALLED").when(F.expr("off or dispatch or gapped or blind"), "NOT_JUDGED").otherwise("NEVER_CALLED")
    return out.select(*ENDPOINT, "calls", status.alias("status"))


def never_called(status: DataFrame) -> DataFrame:
    return status.where("status = 'NEVER_CALLED'").select(*ENDPOINT)


def in_endpoint_order(df: DataFrame) -> DataFrame:
    """O1: by verb, route, then paths before expressions before servlet patterns."""
    return df.orderBy("verb", "route", F.when(F.col("template_kind") == "REGEX", 1).when(F.col("template_kind") == "SERVLET_PATTERN", 2).otherwise(0))


def listed(endpoints: DataFrame) -> DataFrame:
    """Q21: each endpoint any instance reported, as last reported (arrival_seq), sorted."""
    values = [c for c in endpoints.columns if c not in (*ENDPOINT, "arrival_seq")]
    last = identities(endpoints).groupBy(*ENDPOINT).agg(F.max_by(F.struct(*values), "arrival_seq").alias("v"))
    return in_endpoint_order(last.select(*ENDPOINT, "v.*"))


def disabled_modules(reports: DataFrame) -> DataFrame:
    """Q21: modules that any instance disabled, by name; reason and kind of the newest instance (rank), and of its first report (arrival_seq)."""
    age = F.struct((-F.col("rank")).alias("r"), "arrival_seq")
    return reports.groupBy("module").agg(F.min_by("reason", age).alias("reason"), F.min_by("kind", age).alias("kind")).orderBy("module")


def discovered(reports: DataFrame) -> DataFrame:
    """Section 2.12: one row per instance and identity: registration outranks dispatch as source, and a handler with a method one without.

    reports: instance_id, identity, discovery_source, handler_class, handler_method.
    """
    rank = F.struct(F.col("handler_method").isNotNull(), F.col("handler_class").isNotNull())
    handler = F.max_by(F.struct("handler_class", "handler_method"), rank)
    out = identities(reports).groupBy("instance_id", *ENDPOINT).agg(F.bool_or(F.col("discovery_source") == "REGISTRATION").alias("r"), handler.alias("h"))
    return out.select("instance_id", *ENDPOINT, F.when(F.col("r"), "REGISTRATION").otherwise("DISPATCH").alias("discovery_source"), "h.handler_class", "h.handler_method")


def routes_by_handler(endpoints: DataFrame) -> DataFrame:
    """The sorted routes of each handler method."""
    return identities(endpoints.select("verb", "route", "handler_class", "handler_method").distinct()).groupBy("handler_class", "handler_method").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "verb", "route"))).alias("routes"))


def bridge_routes(bridge: DataFrame, owned: DataFrame) -> DataFrame:
    """bridge routes (verb, route) that no framework route owns. HEAD is owned by GET too, any verb by ``*``, and a path by a
    servlet pattern that ends in ``/*`` over one of its folders."""
    verbs = F.array_distinct(F.array(F.col("verb"), F.lit("*"), F.when(F.col("verb") == "HEAD", "GET").otherwise(F.col("verb"))))
    parts = F.split("route", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/*")))
    candidates = bridge.select("verb", "route", F.explode(verbs).alias("v"), F.array_distinct(F.concat(F.array("route"), folders)).alias("rs")).select("verb", "route", "v", F.explode("rs").alias("r"))
    taken = candidates.join(owned.select(F.col("verb").alias("v"), F.col("route").alias("r")).distinct(), ["v", "r"], "left_semi").select("verb", "route")
    return bridge.join(taken.distinct(), ["verb", "route"], "left_anti")
