"""Queries of the ingest rules: orders are payloads, their lines what these carry."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import ingest as I
from .queries import query

PAY = """WITH p0 AS (SELECT cast(o_orderkey AS string) AS payload_id, CASE o_orderkey % 3 WHEN 0 THEN 'MANIFEST' WHEN 1 THEN 'DELTAS' ELSE 'BASELINE' END AS kind, 'i-' || cast(o_custkey % 20 AS string) AS instance_id, 'r' AS run_id, o_orderkey AS arrival_seq,
  o_orderkey * 10 AS heard_at, '1.' || cast(o_orderkey % 4 AS string) AS agent_version, false AS fields_stripped, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE cast(30 + o_orderkey % 60 AS int) END AS flush_interval_seconds, o_orderkey % 50 AS payload_sequence, o_orderkey % 5 = 0 AS starting,
  CASE WHEN o_orderkey % 7 = 0 THEN 5 ELSE 0 END AS counts_pending_since, o_orderkey % 2 = 0 AS flush_complete, o_custkey % 400 = 3 AS final_flush, o_orderkey % 11 = 0 AS references_recorded, o_orderkey % 13 = 0 AS dependencies_listed,
  o_custkey % 60 <> 7 AS verifier_rejections_watched, o_orderkey % 3 AS unplaced_verification_failures FROM orders)"""
#: With the rank of each instance by its first payload, and with the lines at their places.
RANKED = PAY + """, pf AS (SELECT instance_id, dense_rank() OVER (ORDER BY min(arrival_seq)) - 1 AS rank FROM p0 GROUP BY 1), p AS (SELECT p0.*, rank FROM p0 JOIN pf USING (instance_id)),
x AS (SELECT p.*, l.*, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS pos FROM lineitem l JOIN p ON payload_id = cast(l_orderkey AS string))"""


def _payloads(t):
    if "accepted" not in t.kept:
        t.kept["accepted"] = I.accepted(t.spark.sql(PAY.replace("orders)", "{orders} orders)") + " SELECT * FROM p0", orders=t("orders")))[0]
    return t.kept["accepted"]


def _lines(t, **columns):
    pos = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000
    return t("lineitem").select(F.col("l_orderkey").cast("string").alias("payload_id"), pos.alias("pos"), *[c.alias(n) for n, c in columns.items()])


def _name(prefix, column, modulus):
    return F.concat(F.lit(prefix), (F.col(column) % modulus).cast("string"))


@query("s01_totals", RANKED + " SELECT instance_id, run_id, l_partkey % 90 AS class_id, max(l_suppkey) AS hits_total FROM x GROUP BY 1, 2, 3")
def _(t):
    return I.totals(_lines(t, class_id=F.col("l_partkey") % 90, hits_total=F.col("l_suppkey")), _payloads(t), ["class_id"])


@query("s02_probes", RANKED + " SELECT instance_id, l_partkey % 90 AS class_id, l_suppkey % 7 AS probe_index, arg_max('m' || l_partkey % 1000, (arrival_seq, pos)) AS method_name, arg_max(l_suppkey % 31, (arrival_seq, pos)) AS line FROM x GROUP BY 1, 2, 3")
def _(t):
    rows = _lines(t, class_id=F.col("l_partkey") % 90, probe_index=F.col("l_suppkey") % 7, method_name=_name("m", "l_partkey", 1000), line=F.col("l_suppkey") % 31)
    return I.probes(rows, _payloads(t)).select("instance_id", "class_id", "probe_index", "method_name", "line")


@query("s02_skipped_classes", RANKED + " SELECT 'C' || l_partkey % 90 AS class_name, arg_min('why ' || l_suppkey % 31, (arrival_seq, pos)) AS reason FROM x GROUP BY 1")
def _(t):
    rows = I.carried(_lines(t, class_name=_name("C", "l_partkey", 90), reason=_name("why ", "l_suppkey", 31)), _payloads(t))
    return I.first_write(rows, ["class_name"]).select("class_name", "reason")


@query("s02_disabled_modules", RANKED + " SELECT 'web' || l_partkey % 12 AS module, arg_min('why ' || l_suppkey % 31, (-rank, arrival_seq, pos)) AS reason, arg_min('K' || l_suppkey % 5, (-rank, arrival_seq, pos)) AS kind FROM x GROUP BY 1")
def _(t):
    return I.disabled_modules(_lines(t, module=_name("web", "l_partkey", 12), reason=_name("why ", "l_suppkey", 31), kind=_name("K", "l_suppkey", 5)), _payloads(t))[1]


@query("s02_module_kinds", RANKED + " SELECT instance_id, 'web' || l_partkey % 12 AS module, arg_min('K' || l_suppkey % 5, (arrival_seq, pos)) AS kind FROM x GROUP BY 1, 2")
def _(t):
    return I.disabled_modules(_lines(t, module=_name("web", "l_partkey", 12), reason=F.lit(""), kind=_name("K", "l_suppkey", 5)), _payloads(t))[0].select("instance_id", "module", "kind")


# a payload's lines of odd number are probes, the others class locations; ids mean the classes that the same payload's probes name
@query("s02_supertypes", RANKED + """, named AS (SELECT payload_id, l_suppkey % 5 AS class_id, arg_max('C' || l_partkey % 90, pos) AS class_name FROM x WHERE l_linenumber % 2 = 1 GROUP BY 1, 2)
SELECT instance_id, class_name, arg_max('S' || l_partkey % 40, (arrival_seq, pos)) AS super_class_name FROM x JOIN named ON named.payload_id = x.payload_id AND class_id = l_suppkey % 5 WHERE l_linenumber % 2 = 0 GROUP BY 1, 2""")
def _(t):
    cols = {"class_id": F.col("l_suppkey") % 5, "class_name": _name("C", "l_partkey", 90), "super_class_name": _name("S", "l_partkey", 40), "interface_names": F.array().cast("array<string>"), "kotlin_kind": F.lit("NONE"), "odd": F.col("l_linenumber") % 2}
    rows = _lines(t, **cols)
    locations = rows.where("odd = 0").drop("class_name", "odd")
    return I.supertypes(locations, rows.where("odd = 1").select("payload_id", "pos", "class_id", "class_name"), _payloads(t)).select("instance_id", "class_name", "super_class_name")


@query("s03_external_classes", RANKED + " SELECT instance_id, 'X' || l_partkey % 90 AS class_name, arg_min(l_suppkey % 31, (arrival_seq, pos)) AS dependency_id FROM x GROUP BY 1, 2")
def _(t):
    return I.external_classes(_lines(t, class_name=_name("X", "l_partkey", 90), dependency_id=F.col("l_suppkey") % 31), _payloads(t))


@query("s03_dependencies", RANKED + """, listed AS (SELECT instance_id, l_suppkey % 31 AS dependency_id, arg_max('g:a' || l_partkey % 9, (arrival_seq, pos)) AS identity_key FROM x GROUP BY 1, 2), loaded AS (SELECT instance_id, l_suppkey % 31 AS dependency_id, max(l_partkey % 50) AS loaded_classes_total FROM x WHERE l_linenumber = 2 GROUP BY 1, 2)
SELECT instance_id, dependency_id, identity_key, coalesce(loaded_classes_total, 0) AS loaded_classes_total, instance_id IN (SELECT instance_id FROM p0 WHERE references_recorded) AS references_recorded, instance_id LIKE '%1' AS baseline_complete FROM listed LEFT JOIN loaded USING (instance_id, dependency_id)""")
def _(t):
    p = _payloads(t)
    rows = _lines(t, dependency_id=F.col("l_suppkey") % 31, identity_key=_name("g:a", "l_partkey", 9))
    loaded = _lines(t, dependency_id=F.col("l_suppkey") % 31, loaded_classes_total=F.col("l_partkey") % 50, n=F.col("l_linenumber")).where("n = 2").drop("n", "pos")
    return I.dependencies(rows, loaded, p, I.instance_state(p), p.where("instance_id like '%1'").select("instance_id"))


@query("s03_class_references", RANKED + ", last AS (SELECT instance_id, l_partkey % 90 AS class_id, arg_max(['r' || l_suppkey % 31, 'r' || l_suppkey % 7], (arrival_seq, pos)) AS refs FROM x GROUP BY 1, 2) SELECT DISTINCT instance_id, CASE WHEN class_id % 2 = 0 THEN 'C' || class_id ELSE 'class_id ' || class_id END AS class_name, unnest(refs) AS referenced_class FROM last")
def _(t):
    p = _payloads(t)
    rows = _lines(t, class_id=F.col("l_partkey") % 90, referenced_classes=F.array(_name("r", "l_suppkey", 31), _name("r", "l_suppkey", 7)))
    named = p.select("instance_id").distinct().select("instance_id", F.explode(F.sequence(F.lit(0), F.lit(88), F.lit(2))).alias("class_id")).withColumn("class_name", F.concat(F.lit("C"), F.col("class_id").cast("string")))
    return I.class_references(rows, named, p)


@query("s04_verifier_facts", RANKED + " SELECT DISTINCT instance_id, 'C' || l_partkey % 90 AS class_name, 'R' || l_suppkey % 3 AS reason FROM x")
def _(t):
    return I.verifier_facts(_lines(t, class_name=_name("C", "l_partkey", 90), reason=_name("R", "l_suppkey", 3)), _payloads(t))[0]


@query("s05_scan_classes", RANKED + """, c AS (SELECT *, arrival_seq % 400 AS scanned_at, cast(arrival_seq % 4 AS int) AS chunk_index, cast(4 + (arrival_seq // 400) % 2 AS int) AS chunk_count FROM p WHERE arrival_seq % 400 > 0), f AS (SELECT instance_id, scanned_at, arg_min(chunk_count, arrival_seq) AS chunk_count FROM c GROUP BY 1, 2),
ok AS (SELECT instance_id, scanned_at, chunk_index, min(arrival_seq) AS arrival_seq FROM c JOIN f USING (instance_id, scanned_at, chunk_count) GROUP BY 1, 2, 3) SELECT ok.instance_id, scanned_at, 'C' || l_partkey % 90 AS class_name, count(*) AS methods FROM ok JOIN x ON x.arrival_seq = ok.arrival_seq GROUP BY 1, 2, 3""")
def _(t):
    p = _payloads(t)
    chunks = p.where("arrival_seq % 400 > 0").selectExpr("payload_id", "arrival_seq % 400 as scanned_at", "cast(arrival_seq % 4 as int) as chunk_index", "cast(4 + (arrival_seq div 400) % 2 as int) as chunk_count")
    declared = I.scans(chunks, _lines(t, class_name=_name("C", "l_partkey", 90)), p)[1]
    return declared.join(p.select("payload_id", "instance_id"), ["payload_id", "instance_id"]).groupBy("instance_id", "scanned_at", "class_name").agg(F.count(F.lit(1)).alias("methods"))


@query("s06_listings", RANKED + """, c AS (SELECT *, arrival_seq % 40 AS moment, cast(arrival_seq % 4 AS int) AS i FROM p WHERE arrival_seq % 40 > 0), ok AS (SELECT instance_id, moment, i, min(arrival_seq) AS arrival_seq FROM c GROUP BY 1, 2, 3), whole AS (SELECT instance_id, moment FROM ok GROUP BY 1, 2 HAVING count(*) = 4)
SELECT DISTINCT instance_id, moment AS scanned_at, unnest(['L' || arrival_seq % 60, 'K' || arrival_seq % 7]) AS class_name FROM ok JOIN whole USING (instance_id, moment)""".replace("arrival_seq % 4 AS int", "(arrival_seq // 40) % 4 AS int"))
def _(t):
    p = _payloads(t)
    names = F.array(_name("L", "arrival_seq", 60), _name("K", "arrival_seq", 7))
    rows = p.where("arrival_seq % 40 > 0").select("payload_id", F.expr("arrival_seq % 40").alias("listed_at"), F.expr("cast((arrival_seq div 40) % 4 as int)").alias("chunk_index"), F.lit(4).alias("chunk_count"), names.alias("class_names"))
    return I.listings(rows, p)


@query("x11_instance_state", RANKED + """ SELECT instance_id, bool_or(kind = 'DELTAS') AS has_delta, bool_or(kind = 'MANIFEST') AS has_manifest, bool_or(kind = 'DELTAS' AND final_flush) AS ended, bool_or(kind = 'DELTAS' AND final_flush AND flush_complete) AS final_complete,
count(DISTINCT payload_sequence) FILTER (kind = 'DELTAS' AND flush_complete AND payload_sequence > 0) + count(*) FILTER (kind = 'DELTAS' AND flush_complete AND payload_sequence = 0) AS flushes, max(heard_at) FILTER (kind = 'DELTAS') AS last_heard,
arg_min(flush_interval_seconds, arrival_seq) FILTER (flush_interval_seconds > 0) AS flush_interval_seconds, bool_or(kind = 'MANIFEST' AND NOT verifier_rejections_watched) AS unwatched, max(unplaced_verification_failures) FILTER (kind = 'MANIFEST') AS unplaced, bool_or(dependencies_listed) AS dependencies_listed,
bool_or(references_recorded) AS references_recorded, arg_max(agent_version, arrival_seq) AS agent_version, arg_max(starting, (payload_sequence, -arrival_seq)) FILTER (kind <> 'BASELINE') AS starting, arg_max(counts_pending_since <> 0, (payload_sequence, -arrival_seq)) FILTER (kind <> 'BASELINE') AS counts_pending FROM p GROUP BY 1""")
def _(t):
    return I.instance_state(_payloads(t)).drop("rank")
