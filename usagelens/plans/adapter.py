"""Projections of the driver's tables onto telemetry tables (our own adapter, not the reference's behaviour).

Every statement is valid in Spark SQL and in DuckDB, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events".split()

#: name -> (names it reads, SELECT)
SILVER: dict[str, tuple[list[str], str]] = {
    # cumulative totals of one counter per user and event type; a run is a user
    "event_delta": ([], """
        SELECT 'i-' || cast(user_id % 50 AS string) AS instance_id, 'r-' || cast(user_id AS string) AS run_id, event_type AS probe, event_id AS payload_sequence,
               row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS hits_total
        FROM events"""),
    # ten probes of one class from ten neighbouring parts, reported by up to seven instances
    "part_probe": ([], """
        SELECT p_partkey, cast(p_partkey % 10 AS int) AS k, cast(floor(p_partkey / 10) AS bigint) % 60 AS c, cast(floor(p_partkey / 600) AS bigint) AS g, p_size FROM part"""),
    "loaded": ([], """
        SELECT DISTINCT l_partkey AS p, cast(l_suppkey % 7 AS int) AS rank FROM lineitem"""),
    "probe": (["part_probe", "loaded"], """
        SELECT 'i-' || cast(rank AS string) AS instance_id, rank, cast(floor(p / 10) AS bigint) AS class_id, k AS probe_index,
               CASE WHEN k IN (7, 8) THEN 'BRANCH' WHEN k = 9 THEN 'OPTIONAL_ARGUMENT' ELSE 'METHOD' END AS kind,
               'pkg.C' || cast(c AS string) AS class_name,
               CASE WHEN k = 4 THEN '<init>' WHEN k = 5 THEN CASE WHEN g = 0 THEN '<clinit>' ELSE 'n' || cast(g AS string) END
                    WHEN k = 6 THEN 'lambda' || cast(g AS string) WHEN k IN (7, 8) THEN 'm' || cast(g AS string) || '_0'
                    WHEN k = 9 THEN 'm' || cast(g AS string) || '_2' ELSE 'm' || cast(g AS string) || '_' || cast(k AS string) END AS method_name,
               CASE WHEN k = 4 THEN '(' || substr('IJZ', cast(g % 3 AS int) + 1, 1) || ')V' ELSE '()V' END AS method_descriptor,
               cast(p_size + 10 * k + rank AS int) AS line,
               CASE WHEN k IN (7, 8) THEN cast(k - 7 AS int) END AS branch_index,
               CASE WHEN k IN (7, 8) AND p_size % 2 = 0 THEN 'key' || cast(p % 9 AS string) END AS branch_key,
               CASE WHEN k = 9 THEN cast(p_size % 3 AS int) END AS parameter_index,
               CASE WHEN k = 9 THEN 'p' || cast((p_size + rank) % 4 AS string) END AS parameter_name,
               CASE WHEN p_size % 6 = 0 THEN 'lib.Inline' || cast(rank % 3 AS string) END AS inlined_from,
               CASE WHEN p_size % 9 = 0 AND rank % 2 = 1 THEN 'lib.Base' || cast(rank AS string) END AS outside,
               p_size % 17 = 0 AS inline, p_size % 5 = 0 AND k <> 4 AS static, k = 6 AS lambda_body, p_size % 4 = 0 AS overridable,
               cast(CASE WHEN p_size % 23 = 0 THEN 1 + p_size % 2 ELSE 0 END AS int) AS generated_ord,
               cast(CASE WHEN p_size % 19 = 0 THEN 1 + rank % 2 ELSE 0 END AS int) AS unread_ord,
               cast(0 AS int) AS routine_ord,
               CASE WHEN k = 9 AND p_size % 7 = 0 THEN 'pkg.C' || cast((c + 1) % 60 AS string) END AS target_class_name
        FROM part_probe JOIN loaded ON p = p_partkey"""),
    # the sites of each method's two outcomes; the first guards the second
    "site": (["probe"], """
        SELECT instance_id, class_name, method_name, method_descriptor, branch_index, CASE WHEN branch_index = 1 THEN 0 END AS guard,
               cast(CASE WHEN line % 7 = 0 THEN 1 + rank % 2 ELSE 0 END AS int) AS routine_ord, cast(CASE WHEN line % 31 = 0 THEN 2 ELSE 0 END AS int) AS unread_ord
        FROM probe WHERE kind = 'BRANCH'"""),
    # in a sixth of the classes only initialisers and outcomes are ever hit
    "probe_delta": (["part_probe"], """
        SELECT 'i-' || cast(l_suppkey % 7 AS string) AS instance_id, 'run-' || cast(l_suppkey % 7 AS string) AS run_id, cast(floor(l_partkey / 10) AS bigint) AS class_id, k AS probe_index,
               l_orderkey * 10 + l_linenumber AS payload_sequence,
               cast(sum(CASE WHEN (l_quantity > 44 AND p_size % 3 > 0 AND (c % 6 <> 1 OR k IN (7, 8))) OR (k = 5 AND g = 0 AND l_quantity > 4 AND c % 4 < 3) THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey % 7, l_partkey ORDER BY l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS bigint) AS hits_total
        FROM lineitem JOIN part_probe ON l_partkey = p_partkey"""),
    # slots that tell whether a static initialiser returned or threw
    "slot": (["probe"], """
        SELECT instance_id, class_id, 10 + n AS probe_index, CASE WHEN n = 0 THEN 'INITIALIZER_RETURNED' ELSE 'INITIALIZER_THREW' END AS kind, class_name, '<clinit>' AS method_name,
               cast(CASE WHEN n = 0 AND (class_id + rank) % 5 < class_id % 7 THEN 1 ELSE 0 END AS bigint) AS hits
        FROM probe CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1) s WHERE method_name = '<clinit>' AND class_id % 3 < 2"""),
    # parts of an order, each linked to the next larger one: callers are smaller than callees
    "order_part": ([], """SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem"""),
    "call_edge": (["order_part"], """
        SELECT DISTINCT caller, callee FROM (SELECT p AS caller, lead(p) OVER (PARTITION BY o ORDER BY p) AS callee FROM order_part) e WHERE callee IS NOT NULL"""),
    "method_node": ([], """SELECT p_partkey AS node, p_size <= 10 AS hit FROM part"""),
    # a tree of types of depth 4 at most
    "supertype": ([], """SELECT p_partkey AS child, cast(floor(p_partkey / 10) AS bigint) AS parent, 0 AS ord FROM part WHERE p_partkey >= 10"""),
    "declares": ([], """SELECT p_partkey AS type, 'm' || cast(p_size % 6 AS string) AS method FROM part"""),
    "scan_chunk": ([], """
        SELECT 'i-' || cast(o_custkey % 30 AS string) AS instance_id, l_orderkey AS scanned_at, l_linenumber - 1 AS chunk_index, cast(2 + l_orderkey % 5 AS int) + CASE WHEN l_partkey % 40 = 0 THEN 1 ELSE 0 END AS chunk_count, l_partkey AS class_id,
               cast(l_orderkey AS bigint) * 100000000 + l_partkey * 10 + l_linenumber AS arrival_seq
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "endpoint_delta": ([], """
        SELECT CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE ' post ' END AS verb, '/u/' || cast(user_id % 40 AS string) || '//{id:[0-9]+}/' AS route, 'i-' || cast(user_id % 5 AS string) AS instance_id, 'r-' || cast(event_id % 2 AS string) AS run_id,
               user_id AS endpoint_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS hits_total, event_type
        FROM events"""),
    # suppliers are jars; a part's class refers to the jars that deliver it
    "dependency": ([], """
        SELECT 'i-' || cast(s_nationkey % 4 AS string) AS instance_id, s_suppkey AS dependency_id, 'g' || cast(s_suppkey % 60 AS string) || ':a' || cast(s_nationkey % 3 AS string) AS identity_key,
               CASE WHEN s_acctbal > 4000 THEN 'STARTUP_CLASSPATH' ELSE 'LOADED' END AS discovery_source,
               CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 4 = 0 THEN 0 ELSE cast(s_suppkey % 90 AS int) END AS class_count,
               cast(CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey % 8 END AS bigint) AS loaded_classes_total,
               s_nationkey % 4 <> 3 AS references_recorded, s_nationkey % 4 <> 2 AS baseline_complete
        FROM supplier"""),
    "reference": ([], """
        SELECT DISTINCT 'i-' || cast(s_nationkey % 4 AS string) AS instance_id, 'pkg.C' || cast(CASE l_suppkey % 8 WHEN 1 THEN 14 * (l_partkey % 14) WHEN 5 THEN 31 * (l_partkey % 6) WHEN 2 THEN 31 * (l_partkey % 6) + 1 WHEN 6 THEN 31 * (l_partkey % 6) + 2 ELSE l_partkey % 200 END AS string) AS class_name,
               CASE WHEN l_suppkey % 8 IN (1, 5) OR (l_suppkey % 4 = 0 AND l_partkey % 3 = 0) THEN NULL ELSE 'm' || cast(l_partkey AS string) END AS method_name,
               CASE WHEN l_suppkey % 8 = 1 THEN 'BASELINE' WHEN l_suppkey % 8 = 5 THEN 'MANIFEST_CLASS' WHEN l_suppkey % 4 <> 0 OR l_partkey % 3 <> 0 THEN 'MANIFEST_METHOD' WHEN l_partkey % 2 = 0 THEN 'MANIFEST_CLASS' ELSE 'BASELINE' END AS origin,
               CASE WHEN l_suppkey % 8 = 3 THEN 'ext.Z' ELSE 'ext.S' END || cast(l_suppkey AS string) AS referenced_class, p_size % 13 = 0 AS inline, p_size <= 5 AND l_suppkey % 4 = 0 AS method_hit, p_size % 6 = 0 AND l_suppkey % 8 = 6 AS without_evidence
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"""),
    "external_class": ([], """
        SELECT 'i-' || cast(s_nationkey % 4 AS string) AS instance_id, 'ext.S' || cast(s_suppkey AS string) AS class_name, s_suppkey AS dependency_id, s_suppkey % 29 = 0 AS absent FROM supplier"""),
    "class_state": ([], """
        SELECT DISTINCT 'i-' || cast(p_partkey % 4 AS string) AS instance_id, 'pkg.C' || cast(p_partkey % 200 AS string) AS class_name, p_partkey % 200 % 7 <> 0 AS loaded,
               p_partkey % 200 % 14 = 0 AS failed, p_partkey % 200 % 31 = 0 AS failed_init FROM part"""),
    "instance_state": ([], """
        SELECT 'i-' || cast(c_custkey AS string) AS instance_id, c_acctbal >= 0 AS has_delta, c_acctbal >= -500 AS has_manifest, c_nationkey % 5 = 0 AS counts_pending, c_nationkey % 7 = 0 AS starting,
               c_nationkey % 11 = 0 AS unwatched, cast(CASE WHEN c_custkey % 13 = 0 THEN 2 ELSE 0 END AS bigint) AS unplaced, c_custkey % 10 = 0 AS ended, c_custkey * 1000 AS last_heard, cast(CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE 60 END AS int) AS flush_interval_seconds,
               c_custkey % 8 > 0 AS dependencies_listed, c_custkey % 20 = 0 AS final_complete, cast(c_custkey % 5 AS bigint) AS flushes
        FROM customer"""),
    "sample": ([], """
        SELECT 'i-' || cast(user_id % 20 AS string) AS instance, epoch(ts) AS moment, value AS rss, event_id FROM events"""),
}
#: Functions whose names differ: (DuckDB, Spark).
SPARK_NAMES = [("epoch(ts)", "cast(unix_micros(cast(ts AS timestamp)) / 1000000.0 AS double)")]


def ctes(*names: str) -> str:
    """A WITH clause for DuckDB that defines the given telemetry tables."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in SILVER[n][0]:
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SILVER[n][1]})" for n in order)


class Telemetry:
    """Telemetry tables as DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._got: dict[str, DataFrame] = {}
        self.kept: dict[str, DataFrame] = {}  # tables that a query derives and reads several times

    def __call__(self, name: str) -> DataFrame:
        if name not in self._got:
            if name in SILVER:
                needs, sql = SILVER[name]
                for duck, own in SPARK_NAMES:
                    sql = sql.replace(duck, own)
                inputs = {n: self(n) for n in [*needs, *TABLES] if n != name and _reads(sql, n)}
                sql = sql.replace("{", "{{").replace("}", "}}")  # braces name inputs
                for n in inputs:
                    sql = _read(sql, n)
                self._got[name] = self.spark.sql(sql, **inputs)
            else:
                self._got[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._got[name]


def _reads(sql: str, name: str) -> bool:
    import re

    return re.search(rf"(FROM|JOIN)\s+{name}\b", sql) is not None


def _read(sql: str, name: str) -> str:
    """FROM name and JOIN name read the DataFrame given under that name."""
    import re

    return re.sub(rf"(FROM|JOIN)(\s+){name}\b", rf"\1\2{{{name}}} {name}", sql)
