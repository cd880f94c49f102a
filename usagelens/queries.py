"""One query per operator over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import bench_stats as B
from .operators import callgraph as K
from .operators import closure as C
from .operators import dependencies as D
from .operators import endpoints as E
from .operators import findings as Q
from .operators import gates as G
from .operators import harness as H
from .operators import merge as M
from .operators import scans as S
from .operators import validation as V
from .plans.adapter import Telemetry, ctes
from .sources import readers as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None, needs: tuple[str, ...] = ()):
    """Registers a function of the telemetry tables; oracle is a SELECT over the same tables."""

    def register(f: Callable[[Telemetry], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Telemetry(spark, sf_dir))
        if oracle:
            ORACLE[name] = f"{ctes(*needs)} {oracle}" if needs and not oracle.lstrip().startswith(",") else (ctes(*needs) + oracle if needs else oracle)
        return f

    return register


# --- counters -----------------------------------------------------------------------------------------------------------


@query("q01_hit_count", "SELECT event_type AS probe, count(*) AS hits FROM events GROUP BY 1")
def _(t):
    d = t("event_delta")
    return M.total_hits(d.unionByName(d.where("payload_sequence % 3 = 0")), ["probe"])  # injected repeats change nothing


@query("q01_was_hit", "SELECT class_id, probe_index, max(hits_total) > 0 AS was_hit FROM probe_delta GROUP BY 1, 2", ("probe_delta",))
def _(t):
    return M.was_hit(t("probe_delta"), ["class_id", "probe_index"])


HITS = ", hits AS (SELECT instance_id, class_id, probe_index, sum(m) AS hits FROM (SELECT instance_id, run_id, class_id, probe_index, max(hits_total) AS m FROM probe_delta GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"
AGE = "(-rank, instance_id, class_id, probe_index)"
MEMBERS = HITS + f""", mk AS (SELECT instance_id, class_name, method_name, method_descriptor, branch_index, max(routine_ord) AS r, max(unread_ord) AS u FROM site GROUP BY 1, 2, 3, 4, 5),
member AS (SELECT p.* EXCLUDE (routine_ord, unread_ord), CASE WHEN branch_index IS NOT NULL THEN coalesce(r, 0) ELSE 0 END AS routine_ord, CASE WHEN branch_index IS NOT NULL THEN greatest(unread_ord, coalesce(u, 0)) ELSE unread_ord END AS unread_ord,
  coalesce(h.hits, 0) AS hits, CASE WHEN kind = 'BRANCH' THEN coalesce('k:' || branch_key, 'i:' || cast(branch_index AS string)) END AS outcome
  FROM probe p LEFT JOIN hits h USING (instance_id, class_id, probe_index) LEFT JOIN mk USING (instance_id, class_name, method_name, method_descriptor, branch_index)),
merged AS (SELECT class_name, method_name, method_descriptor, kind, parameter_index, outcome, cast(sum(hits) AS bigint) AS hits, arg_min(line, {AGE}) AS line, min(branch_index) AS branch_index,
  max(generated_ord) AS generated_ord, max(target_class_name) AS target_class_name, count(DISTINCT instance_id) AS instances, bool_or(inline) AS inline, bool_or(static) AS static, bool_or(lambda_body) AS lambda_body, bool_or(overridable) AS overridable,
  coalesce(arg_min(routine_ord, {AGE}) FILTER (routine_ord > 0), 0) AS routine_ord, coalesce(arg_min(unread_ord, {AGE}) FILTER (unread_ord > 0), 0) AS unread_ord,
  arg_min_null(parameter_name, {AGE}) AS parameter_name, max(inlined_from) AS inlined_from, arg_min(outside, {AGE}) FILTER (outside IS NOT NULL) AS outside
  FROM member GROUP BY class_name, method_name, method_descriptor, kind, parameter_index, outcome)"""
PROBES = ("probe", "probe_delta", "site")


def _merged(t):
    """The merged locations, written once: findings read them several times."""
    if "merged" not in t.kept:
        t.kept["merged"] = C.checkpointing(M.merged_locations(t("probe"), t("probe_delta"), t("site")))
    return t.kept["merged"]


@query("j01_probe_hits", HITS + " SELECT p.instance_id, p.class_id, p.probe_index, p.kind, coalesce(h.hits, 0)::BIGINT AS hits FROM probe p LEFT JOIN hits h USING (instance_id, class_id, probe_index)", PROBES)
def _(t):
    return M.probe_hits(t("probe"), t("probe_delta")).select("instance_id", "class_id", "probe_index", "kind", "hits")


@query("j02_find_probes", " SELECT instance_id, class_id, probe_index, method_descriptor FROM probe WHERE kind = 'METHOD' AND class_name = 'pkg.C3' AND method_name = '<init>'", ("probe",))
def _(t):
    return M.find_probes(t("probe"), "pkg.C3", "<init>").select("instance_id", "class_id", "probe_index", "method_descriptor")


@query("j04_site_marks", MEMBERS + " SELECT instance_id, class_id, probe_index, routine_ord, unread_ord FROM member", PROBES)
def _(t):
    return M.with_site_marks(t("probe"), t("site")).select("instance_id", "class_id", "probe_index", "routine_ord", "unread_ord")


GUARDS = f""", br AS (SELECT *, coalesce('k:' || branch_key, 'i:' || cast(branch_index AS string)) AS outcome FROM probe WHERE kind = 'BRANCH'),
nw AS (SELECT class_name, method_name, method_descriptor, outcome, arg_min(instance_id, {AGE}) AS instance_id, arg_min(branch_index, {AGE}) AS branch_index FROM br GROUP BY 1, 2, 3, 4),
gd AS (SELECT DISTINCT nw.class_name, nw.method_name, nw.method_descriptor, nw.outcome, br.outcome AS guard FROM nw JOIN site s ON s.instance_id = nw.instance_id AND s.class_name = nw.class_name AND s.method_name = nw.method_name AND s.method_descriptor = nw.method_descriptor AND s.branch_index = nw.branch_index
  JOIN br ON br.instance_id = nw.instance_id AND br.class_name = nw.class_name AND br.method_name = nw.method_name AND br.method_descriptor = nw.method_descriptor AND br.branch_index = s.guard)"""


@query("j05_site_guards", GUARDS + " SELECT * FROM gd", ("probe", "site"))
def _(t):
    return M.site_guards(t("probe"), t("site"))


@query("a05_merged_locations", MEMBERS + " SELECT * FROM merged", PROBES)
def _(t):
    return M.merged_locations(t("probe"), t("probe_delta"), t("site"))


@query("a07_loading_instances", "SELECT class_name, count(DISTINCT instance_id) AS instances FROM probe GROUP BY 1", ("probe",))
def _(t):
    return t("probe").groupBy("class_name").agg(F.count_distinct("instance_id").alias("instances"))


STATES = ", s AS (SELECT cast(user_id AS string) AS instance_id, event_id % 50 AS payload_sequence, event_type = 'error' AS starting, event_type = 'view' AS counts_pending, value > 20 AS flush_complete, event_id AS arrival_seq FROM events)"


def _states(t):
    return t("events").select(F.col("user_id").cast("string").alias("instance_id"), (F.col("event_id") % 50).alias("payload_sequence"), (F.col("event_type") == "error").alias("starting"), (F.col("event_type") == "view").alias("counts_pending"), (F.col("value") > 20).alias("flush_complete"), F.col("event_id").alias("arrival_seq"))


@query("a12_delivery_state", "WITH " + STATES[2:] + """ SELECT instance_id, max(payload_sequence) FILTER (payload_sequence > 0) AS payload_sequence, arg_max(starting, (payload_sequence, -arrival_seq)) FILTER (payload_sequence > 0) AS starting,
arg_max(counts_pending, (payload_sequence, -arrival_seq)) FILTER (payload_sequence > 0) AS counts_pending FROM s GROUP BY 1""")
def _(t):
    return M.delivery_state(_states(t))


@query("a13_complete_flushes", "WITH " + STATES[2:] + " SELECT instance_id, count(DISTINCT payload_sequence) FILTER (flush_complete AND payload_sequence > 0) + count(*) FILTER (flush_complete AND payload_sequence = 0) AS flushes FROM s GROUP BY 1")
def _(t):
    return M.complete_flushes(_states(t))


@query("w03_arrival_rank", "SELECT cast(user_id AS string) AS instance_id, min(event_id) AS first, cast(dense_rank() OVER (ORDER BY min(event_id)) - 1 AS int) AS rank FROM events GROUP BY 1")
def _(t):
    return M.arrival_rank(_states(t))


@query("w04_changed_deltas", "SELECT run_id, probe, payload_sequence, hits_total, delivered FROM (SELECT *, lag(hits_total, 1, 0) OVER (PARTITION BY run_id, probe ORDER BY payload_sequence) AS delivered FROM (SELECT run_id, probe, payload_sequence, hits_total // 2 AS hits_total FROM event_delta)) WHERE hits_total <> delivered", ("event_delta",))
def _(t):
    d = t("event_delta").withColumn("hits_total", F.expr("hits_total div 2").cast("long"))
    return M.changed_deltas(d, ["run_id", "probe"], "payload_sequence").select("run_id", "probe", "payload_sequence", "hits_total", "delivered")


# --- findings ------------------------------------------------------------------------------------------------------------

JUDGED = MEMBERS + """, judged AS (SELECT * FROM merged WHERE kind = 'METHOD' AND NOT inline AND generated_ord = 0 AND unread_ord = 0),
per AS (SELECT class_name, bool_or(method_name = '<clinit>') AS has_init, coalesce(bool_and(hits = 0) FILTER (method_name = '<clinit>'), true) AS cold, bool_or(method_name = '<init>') AS has_ctor,
  bool_or(method_name = '<init>' AND hits > 0) AS constructed, bool_or(method_name NOT IN ('<init>', '<clinit>') AND NOT static) AS has_instance FROM judged GROUP BY 1),
ran AS (SELECT DISTINCT class_name FROM merged WHERE kind = 'METHOD' AND hits > 0 AND NOT static AND method_name NOT IN ('<init>', '<clinit>')),
finding AS (SELECT class_name, CASE WHEN has_init AND cold THEN 'NEVER_INITIALIZED' WHEN has_ctor AND NOT constructed AND has_instance AND class_name NOT IN (SELECT class_name FROM ran) THEN 'NEVER_INSTANTIATED' END AS finding, constructed FROM per)"""


@query("q13_judge_classes", JUDGED + " SELECT * FROM finding", PROBES)
def _(t):
    return Q.class_findings(_merged(t))


@query("q11_never_initialized", JUDGED + " SELECT class_name FROM finding WHERE finding = 'NEVER_INITIALIZED'", PROBES)
def _(t):
    return Q.class_findings(_merged(t)).where("finding = 'NEVER_INITIALIZED'").select("class_name")


@query("q12_never_instantiated", JUDGED + " SELECT class_name FROM finding WHERE finding = 'NEVER_INSTANTIATED'", PROBES)
def _(t):
    return Q.class_findings(_merged(t)).where("finding = 'NEVER_INSTANTIATED'").select("class_name")


@query("q13_covered_methods", JUDGED + """ SELECT class_name, method_name, method_descriptor FROM judged JOIN finding USING (class_name) WHERE hits = 0 AND finding IS NOT NULL
AND (finding = 'NEVER_INITIALIZED' OR method_name = '<init>' OR (method_name <> '<clinit>' AND NOT static))""", PROBES)
def _(t):
    m = _merged(t)
    return Q.covered_methods(m, Q.class_findings(m))


# classes that were skipped or whose initialiser has a gap can't be judged
WITHHELD = ", skipped AS (SELECT DISTINCT class_name FROM probe WHERE class_id % 60 = 17), gap AS (SELECT DISTINCT class_name FROM probe WHERE class_id % 60 = 29), wh AS (SELECT class_name FROM skipped UNION SELECT class_name FROM gap)"


def _lists(t):
    of = lambda n: t("probe").where(F.col("class_id") % 60 == n).select("class_name").distinct()
    return of(17), of(29)


NEVER = JUDGED + GUARDS + WITHHELD + """, found AS (SELECT class_name, CASE WHEN class_name NOT IN (SELECT class_name FROM wh) THEN finding END AS finding, constructed FROM finding),
cv AS (SELECT class_name, method_name, method_descriptor FROM judged JOIN found USING (class_name) WHERE hits = 0 AND found.finding IS NOT NULL AND (found.finding = 'NEVER_INITIALIZED' OR method_name = '<init>' OR (method_name <> '<clinit>' AND NOT static))),
gone AS (SELECT * FROM cv UNION SELECT l.class_name, l.method_name, l.method_descriptor FROM judged l JOIN judged cr ON cr.class_name = l.class_name AND cr.method_name = 'm' || substr(l.method_name, 7) || '_0' AND cr.hits = 0 WHERE l.lambda_body AND l.hits = 0 AND l.class_name NOT IN (SELECT class_name FROM wh)), cand AS (SELECT m.*, CASE WHEN unread_ord > 0 THEN 'UNREAD' WHEN routine_ord > 0 THEN 'ROUTINE' ELSE 'PLAIN' END AS bucket FROM merged m LEFT JOIN finding f USING (class_name)
  WHERE hits <= 0 AND kind <> 'OPTIONAL_ARGUMENT' AND NOT inline AND generated_ord = 0 AND class_name NOT IN (SELECT class_name FROM wh) AND (class_name, method_name, method_descriptor) NOT IN (SELECT class_name, method_name, method_descriptor FROM gone) AND (kind <> 'METHOD' OR (method_name <> '<clinit>' AND (method_name <> '<init>' OR coalesce(constructed, false))))),
nh AS (SELECT class_name, method_name, method_descriptor, kind, outcome, line, bucket FROM cand c WHERE kind <> 'BRANCH' OR (NOT EXISTS (SELECT 1 FROM judged m WHERE m.hits <= 0 AND m.class_name = c.class_name AND m.method_name = c.method_name AND m.method_descriptor = c.method_descriptor)
  AND NOT EXISTS (SELECT 1 FROM gd JOIN cand o ON o.kind = 'BRANCH' AND o.routine_ord = 0 AND o.unread_ord = 0 AND o.class_name = gd.class_name AND o.method_name = gd.method_name AND o.method_descriptor = gd.method_descriptor AND o.outcome = gd.guard
    WHERE gd.class_name = c.class_name AND gd.method_name = c.method_name AND gd.method_descriptor = c.method_descriptor AND gd.outcome = c.outcome)))"""
NEVER_COLUMNS = ["class_name", "method_name", "method_descriptor", "kind", "outcome", "line", "bucket"]


def _creates(m):
    """Each class's methods ``m<g>_0`` create its ``lambda<g>``."""
    methods = m.where("kind = 'METHOD' and method_name like 'm%'").select(*M.METHOD)
    made = m.where("lambda_body and kind = 'METHOD'").select("class_name", F.col("class_name").alias("c_class"), F.col("method_name").alias("c_name"), F.col("method_descriptor").alias("c_desc"))
    return methods.join(made, "class_name").where(F.substring_index("method_name", "_", -1) == "0").where(F.substring_index(F.expr("substring(method_name, 2)"), "_", 1) == F.expr("substring(c_name, 7)"))


def _never(t):
    m, withheld = _merged(t), M.withheld_classes(*_lists(t))
    f = C.checkpointing(Q.class_findings(m, withheld))
    covered = Q.covered_methods(m, f)
    folded = Q.folded_lambdas(m, _creates(m), f, covered, withheld).select(*M.METHOD).unionByName(covered).distinct()
    return Q.never_hit(m, f, withheld, folded, M.site_guards(t("probe"), t("site"))).select(*NEVER_COLUMNS)


@query("q09_never_hit_rows", NEVER + " SELECT * FROM nh", PROBES)
def _(t):
    return _never(t)


for _name, _bucket in (("q06_never_hit", "PLAIN"), ("q07_never_hit_routine", "ROUTINE"), ("q08_never_hit_unread", "UNREAD")):
    query(_name, NEVER + f" SELECT * FROM nh WHERE bucket = '{_bucket}'", PROBES)(lambda t, b=_bucket: _never(t).where(F.col("bucket") == b))


@query("q30_never_hit_totals", NEVER + " SELECT bucket, count(*) AS rows, round(100.0 * count(*) / (SELECT count(*) FROM merged), 6) AS percent FROM nh GROUP BY 1", PROBES)
def _(t):
    m = _merged(t)
    n = m.agg(F.count(F.lit(1)).alias("n"))  # one row
    rows = _never(t).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    return rows.crossJoin(F.broadcast(n)).select("bucket", "rows", F.round(100.0 * F.col("rows") / F.col("n"), 6).cast("double").alias("percent"))


OPTIONAL = MEMBERS + WITHHELD + """, grp AS (SELECT coalesce(target_class_name, class_name) AS class_name, method_name, method_descriptor, parameter_index, coalesce(max(parameter_name), '') AS parameter_name, cast(sum(hits) AS bigint) AS omitted, bool_or(overridable) AS overridable,
  bool_or(inline OR generated_ord > 0 OR unread_ord > 0 OR class_name IN (SELECT class_name FROM skipped)) AS out, bool_and(class_name IN (SELECT class_name FROM gap)) AS all_gap, greatest(max(line), -1) AS line FROM merged WHERE kind = 'OPTIONAL_ARGUMENT' GROUP BY 1, 2, 3, 4),
tgt AS (SELECT class_name, method_name, method_descriptor, cast(sum(hits) AS bigint) AS target_hits FROM merged WHERE kind = 'METHOD' GROUP BY 1, 2, 3),
par AS (SELECT class_name, method_name, method_descriptor, parameter_index, parameter_name, omitted, target_hits, overridable, line, all_gap FROM grp JOIN tgt USING (class_name, method_name, method_descriptor) WHERE NOT out AND target_hits > 0 AND class_name NOT IN (SELECT class_name FROM skipped))"""


@query("q03_never_supplied", OPTIONAL + " SELECT * EXCLUDE (all_gap) FROM par WHERE NOT overridable AND omitted = target_hits", PROBES)
def _(t):
    return Q.optional_parameters(_merged(t), never=True, skipped=_lists(t)[0])


@query("q04_always_supplied", OPTIONAL + " SELECT * EXCLUDE (all_gap) FROM par WHERE omitted = 0 AND NOT all_gap", PROBES)
def _(t):
    skipped, gaps = _lists(t)
    return Q.optional_parameters(_merged(t), never=False, skipped=skipped, gaps=gaps)


@query("q02_omission_count", OPTIONAL + " SELECT class_name, method_name, method_descriptor, parameter_index, nullif(parameter_name, '') AS parameter_name, omitted FROM grp", PROBES)
def _(t):
    return Q.omission_counts(_merged(t))


SLOTTED = MEMBERS + """, slotted AS (SELECT instance_id, class_name, kind, method_name, hits FROM member UNION ALL SELECT instance_id, class_name, kind, method_name, hits FROM slot),
ev AS (SELECT instance_id, class_name, bool_or(kind LIKE 'INITIALIZER%') AS slots, bool_or(kind = 'INITIALIZER_RETURNED' AND hits > 0) AS returned, bool_or(hits > 0) AS anyhit, bool_or(kind = 'METHOD') AS loads,
  bool_or(method_name = '<clinit>' AND kind = 'METHOD' AND hits > 0) AS entered, bool_or(kind = 'INITIALIZER_RETURNED') AS r, bool_or(kind = 'INITIALIZER_THREW') AS t, bool_or(kind LIKE 'INITIALIZER%' AND hits > 0) AS finished FROM slotted GROUP BY 1, 2)"""
SLOT_TABLES = (*PROBES, "slot")


def _slotted(t):
    c = ["instance_id", "class_name", "kind", "method_name", "hits"]
    return M.probe_hits(t("probe"), t("probe_delta")).select(*c).unionByName(t("slot").select(*c))


@query("a14_initialized_classes", SLOTTED + " SELECT DISTINCT class_name FROM ev WHERE CASE WHEN slots THEN returned ELSE anyhit END", SLOT_TABLES)
def _(t):
    return Q.initialized_classes(_slotted(t))


@query("a15_initializers_running", SLOTTED + " SELECT class_name FROM ev WHERE loads GROUP BY 1 HAVING bool_and(entered AND r AND t AND NOT finished)", SLOT_TABLES)
def _(t):
    return Q.initializers_running(_slotted(t))


@query("j09_initializer_gaps", SLOTTED + WITHHELD + " SELECT instance_id, class_name FROM ev WHERE class_name IN (SELECT class_name FROM gap) OR (instance_id = 'i-2' AND class_name LIKE '%7') OR (loads AND entered AND r AND t AND NOT finished)", SLOT_TABLES)
def _(t):
    p = _slotted(t)
    return Q.initializer_gaps(p, _lists(t)[1], p.where("instance_id = 'i-2' and class_name like '%7'").select("instance_id", "class_name"))


@query("q18_skipped_classes", "SELECT p_brand AS class_name, arg_min(p_type, p_partkey) AS reason FROM part WHERE p_size > 40 GROUP BY 1")
def _(t):
    return Q.skipped_classes(t("part").where("p_size > 40").select(F.col("p_brand").alias("class_name"), F.col("p_type").alias("reason"), F.col("p_partkey").alias("arrival_seq")))


FAILURES = """, fail AS (SELECT 'i-' || cast(p_partkey % 3 AS string) AS instance_id, p_partkey AS class_name, CASE WHEN p_size % 2 = 0 THEN 'VERIFIER_REJECTED' ELSE 'STATIC_INITIALIZER_THREW' END AS reason FROM part WHERE p_size > 40),
st AS (SELECT 'i-' || cast(i AS string) AS instance_id, child, parent, child % 2 = 1 AS is_interface FROM supertype, (SELECT DISTINCT p_partkey % 3 AS i FROM part)),
def AS (SELECT 'i-' || cast(p_partkey % 3 AS string) AS instance_id, p_partkey AS class_name FROM part WHERE p_size % 3 = 0),
bad AS (SELECT instance_id, class_name, bool_or(reason = 'VERIFIER_REJECTED') AS rejected FROM fail GROUP BY 1, 2),
up AS (SELECT instance_id, child, parent, is_interface FROM st UNION SELECT u.instance_id, u.child, s.parent, s.is_interface FROM up u JOIN st s ON s.child = u.parent AND s.instance_id = u.instance_id),
heir AS (SELECT u.child FROM up u JOIN bad b ON b.instance_id = u.instance_id AND b.class_name = u.parent WHERE b.rejected OR NOT u.is_interface OR EXISTS (SELECT 1 FROM def d WHERE d.instance_id = u.instance_id AND d.class_name = u.parent))"""


@query("q17_failed_to_initialize", FAILURES + " SELECT cast(n AS string) AS class_name FROM (SELECT class_name AS n FROM fail UNION SELECT child FROM heir) WHERE n % 10 <> 3 AND n % 10 <> 7", ("supertype",))
def _(t):
    p = t("part")
    inst = F.concat(F.lit("i-"), (F.col("p_partkey") % 3).cast("string"))
    name = F.col("p_partkey").cast("string").alias("class_name")
    fail = p.where("p_size > 40").select(inst.alias("instance_id"), name, F.when(F.col("p_size") % 2 == 0, "VERIFIER_REJECTED").otherwise("STATIC_INITIALIZER_THREW").alias("reason"))
    three = t.spark.createDataFrame([("i-0",), ("i-1",), ("i-2",)], "instance_id string")
    st = t("supertype").crossJoin(F.broadcast(three)).select("instance_id", F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent"), (F.col("child") % 2 == 1).alias("is_interface"))
    default = p.where("p_size % 3 = 0").select(inst.alias("instance_id"), name)
    return Q.failed_to_initialize(fail, st, default, p.where("p_partkey % 10 = 3").select(name), p.where("p_partkey % 10 <> 7").select(name))


@query("q28_diagnosis", "SELECT class_name, method_name, CASE WHEN p % 3 = 0 THEN 'KNOWN' WHEN p % 7 = 0 THEN 'SKIPPED' WHEN p % 11 = 0 THEN 'UNREPORTED' WHEN p % 5 = 0 THEN 'DECLARED_ONLY' ELSE 'NEVER_MENTIONED' END AS diagnosis FROM (SELECT p_partkey AS p, 'C' || p_partkey AS class_name, 'm' AS method_name FROM part)")
def _(t):
    p = t("part").select("p_partkey", F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("class_name"), F.lit("m").alias("method_name"))
    return Q.diagnosis(p.select("class_name", "method_name"), p.where("p_partkey % 7 = 0"), p.where("p_partkey % 11 = 0"), p.where("p_partkey % 3 = 0"), p.where("p_partkey % 5 = 0"))


# --- scans ---------------------------------------------------------------------------------------------------------------

CHUNKS = """, valid AS (SELECT * FROM scan_chunk WHERE scanned_at > 0 AND chunk_index >= 0 AND chunk_index < chunk_count), fst AS (SELECT instance_id, scanned_at, arg_min(chunk_count, arrival_seq) AS chunk_count FROM valid GROUP BY 1, 2),
ok AS (SELECT DISTINCT instance_id, scanned_at, chunk_index, chunk_count FROM valid JOIN fst USING (instance_id, scanned_at, chunk_count)), done AS (SELECT instance_id, scanned_at, chunk_count FROM ok GROUP BY 1, 2, 3 HAVING count(*) = chunk_count)"""


@query("a09_complete_scans", CHUNKS + " SELECT * FROM done", ("scan_chunk",))
def _(t):
    return S.complete_scans(t("scan_chunk"))


@query("a10_latest_scans", CHUNKS + " SELECT instance_id, max(scanned_at) AS scanned_at FROM done GROUP BY 1", ("scan_chunk",))
def _(t):
    return S.latest_scans(S.complete_scans(t("scan_chunk")))


@query("q15_never_loaded", CHUNKS + ", last AS (SELECT instance_id, max(scanned_at) AS scanned_at FROM done GROUP BY 1) SELECT DISTINCT class_id AS class_name FROM scan_chunk JOIN last USING (instance_id, scanned_at) WHERE class_id % 4 <> 0 AND class_id % 5 > 1 AND class_id % 7 <> 0", ("scan_chunk",))
def _(t):
    c = t("scan_chunk")
    declared = c.select("instance_id", "scanned_at", F.col("class_id").alias("class_name"), (F.col("class_id") % 4 != 0).alias("ordinary"))
    names = c.select(F.col("class_id").alias("class_name")).distinct()
    return S.never_loaded(declared, S.latest_scans(S.complete_scans(c)), names.where("class_name % 5 <= 1"), names.where("class_name % 7 = 0"))


@query("a11_merged_classes", "SELECT p_brand AS class_name, arg_min(s, i) FILTER (s IS NOT NULL) AS super_class_name, list_sort(list_distinct(list(p_type))) AS interfaces, count(DISTINCT p_name) AS methods, coalesce(arg_min(k, i) FILTER (k <> 'NONE'), 'NONE') AS kind FROM (SELECT *, lpad(cast(p_partkey AS string), 9, '0') AS i, CASE WHEN p_size > 10 THEN p_type END AS s, CASE WHEN p_size > 48 THEN 'FILE' WHEN p_size > 45 THEN 'CLASS' ELSE 'NONE' END AS k FROM part) GROUP BY 1")
def _(t):
    kind = F.when(F.col("p_size") > 48, "FILE").when(F.col("p_size") > 45, "CLASS").otherwise("NONE")
    d = t("part").select(F.col("p_brand").alias("class_name"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("instance_id"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("super_class_name"), F.array("p_type").alias("interface_names"), F.col("p_name").alias("method_name"), F.lit("").alias("method_descriptor"), kind.alias("kind"))
    return S.merged_classes(d).drop("method_list")


@query("q16_failed_to_load", "SELECT DISTINCT p_partkey % 700 AS class_name FROM part WHERE p_size > 45 AND p_partkey % 700 NOT IN (SELECT p_partkey % 700 FROM part WHERE p_size <= 25)")
def _(t):
    p = t("part").withColumn("class_name", F.col("p_partkey") % 700)
    return S.failed_to_load(p.where("p_size > 45"), p.where("p_size <= 25"))


@query("q32_report_buckets", CHUNKS + " SELECT 'INCOMPLETE_SCAN' AS bucket, instance_id || ' ' || scanned_at AS class_name, count(*) || ' of ' || chunk_count AS detail FROM ok GROUP BY instance_id, scanned_at, chunk_count HAVING count(*) < chunk_count", ("scan_chunk",))
def _(t):
    no = t.spark.createDataFrame([], "class_name string, reason string")
    declared = t("scan_chunk").select(F.col("class_id").cast("string").alias("class_name"), F.lit("m").alias("method_name"), F.lit(True).alias("ordinary"))
    return S.report_buckets(t("scan_chunk"), declared, no, no, no, no)


@query("q32_never_loaded_report", """WITH d AS (SELECT p_partkey % 700 AS n, 'm' || p_size AS method_name, p_size % 3 > 0 AS ordinary FROM part), r AS (SELECT 'c' || n AS class_name, string_agg(DISTINCT method_name, ', ' ORDER BY method_name) AS names, bool_or(ordinary) AS ordinary FROM d WHERE n % 5 > 0 AND n % 7 > 0 GROUP BY n)
SELECT CASE WHEN ordinary THEN 'NEVER_LOADED' ELSE 'ALL_INLINE_OR_GENERATED' END AS bucket, class_name, CASE WHEN ordinary THEN names END AS detail FROM r UNION ALL SELECT 'UNPROBED', p_brand, min(p_type) FROM part WHERE p_size = 1 GROUP BY p_brand UNION ALL SELECT 'UNREADABLE', p_brand, min(p_type) FROM part WHERE p_size = 2 GROUP BY p_brand""")
def _(t):
    p = t("part").withColumn("n", F.col("p_partkey") % 700)
    name = F.concat(F.lit("c"), F.col("n").cast("string")).alias("class_name")
    declared = p.select(name, F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("method_name"), (F.col("p_size") % 3 > 0).alias("ordinary"))
    bad = lambda k: p.where(F.col("p_size") == k).select(F.col("p_brand").alias("class_name"), F.col("p_type").alias("reason"))
    one = t.spark.createDataFrame([("i", 1, 0, 1, 1)], "instance_id string, scanned_at long, chunk_index int, chunk_count int, arrival_seq long")
    return S.report_buckets(one, declared, bad(1), bad(2), p.where("n % 5 = 0").select(name).distinct(), p.where("n % 7 = 0").select(name).distinct())


@query("u04_unreported_classes", "SELECT DISTINCT instance_id, class_name FROM (SELECT 'i-' || p_size % 4 AS instance_id, p_brand || p_partkey % 30 AS class_name FROM part) EXCEPT SELECT 'i-' || p_size % 4, p_brand || p_partkey % 30 FROM part WHERE p_size > 12")
def _(t):
    c = [F.concat(F.lit("i-"), (F.col("p_size") % 4).cast("string")).alias("instance_id"), F.concat("p_brand", (F.col("p_partkey") % 30).cast("string")).alias("class_name")]
    return S.unreported(t("part").select(*c), t("part").where("p_size > 12").select(*c))


@query("x12_baseline_mismatches", "SELECT DISTINCT i AS instance_id, c AS class_name FROM (SELECT 'i-' || p_size % 4 AS i, p_brand || p_partkey % 30 AS c FROM part WHERE p_size > 8) WHERE i <> 'i-3' AND (i, c) NOT IN (SELECT 'i-' || p_size % 4, p_brand || p_partkey % 30 FROM part WHERE p_size > 25 AND p_size % 4 < 3)")
def _(t):
    c = [F.concat(F.lit("i-"), (F.col("p_size") % 4).cast("string")).alias("instance_id"), F.concat("p_brand", (F.col("p_partkey") % 30).cast("string")).alias("class_name")]
    return S.baseline_mismatches(t("part").where("p_size > 8").select(*c), t("part").where("p_size > 25 and p_size % 4 < 3").select(*c))


# --- endpoints -----------------------------------------------------------------------------------------------------------

CALLS = ", c AS (SELECT upper(trim(verb)) AS verb, '/u/' || split_part(route, '/', 3) || '/{id}' AS route, instance_id, run_id, endpoint_id, max(hits_total) AS hits FROM endpoint_delta GROUP BY 1, 2, 3, 4, 5)"


@query("q19_call_count", CALLS + " SELECT verb, route, cast(sum(hits) AS bigint) AS calls FROM c GROUP BY 1, 2", ("endpoint_delta",))
def _(t):
    return E.call_counts(t("endpoint_delta"))


ENDPOINTS = """, e AS (SELECT DISTINCT upper(trim(verb)) AS verb, '/u/' || split_part(route, '/', 3) || '/{id}' AS route, 'PATH' AS template_kind, instance_id, endpoint_id, endpoint_id % 6 AS fw, endpoint_id % 7 = 0 AS disp, endpoint_id % 10 AS h FROM endpoint_delta),
hit AS (SELECT instance_id, endpoint_id, max(hits_total) AS hits FROM endpoint_delta WHERE endpoint_id % 4 = 0 GROUP BY 1, 2),
es AS (SELECT verb, route, template_kind, cast(sum(coalesce(hits, 0)) AS bigint) AS calls, bool_or(fw = 2) AS off, bool_and(disp) AS disp, bool_and(h = 3) AS gapped FROM e LEFT JOIN hit USING (instance_id, endpoint_id) GROUP BY 1, 2, 3),
st AS (SELECT verb, route, template_kind, calls, CASE WHEN calls > 0 THEN 'CALLED' WHEN off OR disp OR gapped THEN 'NOT_JUDGED' ELSE 'NEVER_CALLED' END AS status FROM es)"""


def _endpoint_status(t):
    d = t("endpoint_delta")
    e = d.select("verb", "route", F.lit("PATH").alias("template_kind"), "instance_id", "endpoint_id").distinct()
    e = e.withColumns({"framework": F.col("endpoint_id") % 6, "discovery_source": F.when(F.col("endpoint_id") % 7 == 0, "DISPATCH").otherwise("SCAN"), "handler_class": (F.col("endpoint_id") % 10).cast("string")})
    hits = d.where("endpoint_id % 4 = 0").groupBy("instance_id", "endpoint_id").agg(F.max("hits_total").alias("hits"))
    gaps = e.where("handler_class = '3'").select("instance_id", F.col("handler_class").alias("class_name"))
    off = t.spark.createDataFrame([(2,)], "framework long")
    # module 2 failed after it had declared endpoints, module 9 was configured off: neither hides the others
    modules = t.spark.createDataFrame([("i-0", 2, "FAILED"), ("i-1", 9, "CONFIGURED_OFF")], "instance_id string, module long, kind string")
    return E.endpoint_status(e, hits, off, gaps, E.failed_before_declaring(e, modules.where("instance_id <> 'i-0'").unionByName(e.where("framework = 2").select("instance_id", F.col("framework").alias("module"), F.lit("FAILED").alias("kind")).distinct())))


@query("q31_endpoint_status", ENDPOINTS + " SELECT * FROM st", ("endpoint_delta",))
def _(t):
    return _endpoint_status(t)


@query("q20_never_called", ENDPOINTS + " SELECT verb, route, template_kind FROM st WHERE status = 'NEVER_CALLED'", ("endpoint_delta",))
def _(t):
    return E.never_called(_endpoint_status(t))


@query("j12_routes_by_handler", ENDPOINTS + " SELECT cast(h AS string) AS handler_class, 'handle' AS handler_method, list_sort(list(DISTINCT verb || ' ' || route)) AS routes FROM e GROUP BY 1", ("endpoint_delta",))
def _(t):
    d = t("endpoint_delta").select("verb", "route", (F.col("endpoint_id") % 10).cast("string").alias("handler_class"), F.lit("handle").alias("handler_method"))
    return E.routes_by_handler(d)


#: Route templates and their one form below ``/ctx``.
FORMS = {
    "/a/{x}/b": "/ctx/a/{x}/b", "//a//{id:[0-9]{2}}/": "/ctx/a/{id}", "files/{path...}": "/ctx/files/*", "{*rest}": "/ctx/*", "<name>": "/ctx/*", "/v{n}/{opt:?}": "/ctx/v{n}/{opt?}", "/books{/id}": "/ctx/books/{id?}", "/{a}/*": "/ctx/{a}/*",
    "/open/{x/y": "/ctx/open/{x/y", "{+p}": "/ctx/*", "": "/ctx",
}


@query("f01_normalize_route", f"SELECT p_partkey, CASE p_partkey % {len(FORMS)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(FORMS.values())) + " END AS route FROM part")
def _(t):
    p = t("part").select("p_partkey", F.element_at(F.array(*map(F.lit, FORMS)), (F.col("p_partkey") % len(FORMS) + 1).cast("int")).alias("template"))
    return p.select("p_partkey", T.normalize_route(F.col("template"), F.lit("/ctx")).alias("route"))


@query("q21_endpoints", ENDPOINTS + ", l AS (SELECT upper(trim(verb)) AS verb, '/u/' || split_part(route, '/', 3) || '/{id}' AS route, arg_max(endpoint_id, event_id) AS endpoint_id, arg_max(instance_id, event_id) AS instance_id FROM endpoint_delta GROUP BY 1, 2) SELECT verb, route, 'PATH' AS template_kind, endpoint_id, instance_id FROM l", ("endpoint_delta",))
def _(t):
    return E.listed(t("endpoint_delta").select("verb", "route", F.lit("PATH").alias("template_kind"), "endpoint_id", "instance_id", F.col("event_id").alias("arrival_seq")))


@query("q21_disabled_modules", "SELECT p_brand AS module, arg_min(p_type, (-(p_size % 6), p_partkey)) AS reason, arg_min(p_container, (-(p_size % 6), p_partkey)) AS kind FROM (SELECT *, p_type || p_size AS p_container FROM part) GROUP BY 1")
def _(t):
    return E.disabled_modules(t("part").select(F.col("p_brand").alias("module"), F.col("p_type").alias("reason"), F.concat("p_type", F.col("p_size").cast("string")).alias("kind"), (F.col("p_size") % 6).alias("rank"), F.col("p_partkey").alias("arrival_seq")))


@query("x12_endpoint_discovery", "SELECT instance_id, verb, route, 'PATH' AS template_kind, CASE WHEN bool_or(reg) THEN 'REGISTRATION' ELSE 'DISPATCH' END AS discovery_source, max(handler_class) AS handler_class, max(m) AS handler_method FROM (SELECT instance_id, upper(trim(verb)) AS verb, '/u/' || split_part(route, '/', 3) || '/{id}' AS route, endpoint_id % 3 = 0 AS reg, 'H' AS handler_class, CASE WHEN endpoint_id % 5 = 0 THEN 'handle' END AS m FROM endpoint_delta) GROUP BY 1, 2, 3", ("endpoint_delta",))
def _(t):
    k = F.col("endpoint_id")
    return E.discovered(t("endpoint_delta").select("instance_id", "verb", "route", F.lit("PATH").alias("template_kind"), F.when(k % 3 == 0, "REGISTRATION").otherwise("DISPATCH").alias("discovery_source"), F.lit("H").alias("handler_class"), F.when(k % 5 == 0, "handle").alias("handler_method")))


@query("f22_bridge_routes", "SELECT verb, route FROM (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN 'HEAD' WHEN p_size % 3 = 1 THEN 'GET' ELSE 'POST' END AS verb, '/s' || p_partkey % 20 || '/p' || p_size AS route, p_partkey % 20 AS s, p_size FROM part) WHERE NOT (s = 4 AND verb IN ('GET', 'HEAD')) AND NOT (s = 5) AND NOT (s = 6 AND p_size = 7)")
def _(t):
    verb = F.when(F.col("p_size") % 3 == 0, "HEAD").when(F.col("p_size") % 3 == 1, "GET").otherwise("POST")
    bridge = t("part").select(verb.alias("verb"), F.concat(F.lit("/s"), (F.col("p_partkey") % 20).cast("string"), F.lit("/p"), F.col("p_size").cast("string")).alias("route")).distinct()
    return E.bridge_routes(bridge, t.spark.createDataFrame([("GET", "/s4/*"), ("*", "/s5/*"), ("*", "/s6/p7")], "verb string, route string"))


# --- dependencies --------------------------------------------------------------------------------------------------------

DEPENDENCY = """, anyw AS (SELECT class_name, bool_or(loaded) AS la, bool_or(failed) AS fl, bool_or(failed_init) AS fi FROM class_state GROUP BY 1),
own AS (SELECT instance_id, class_name, bool_or(loaded) AS lh FROM class_state GROUP BY 1, 2),
held AS (SELECT r.*, coalesce(fi, false) AS fi, coalesce(la, false) AS la, r.origin = 'BASELINE' AND coalesce(fl, false) AND NOT coalesce(la, false) AS ftl, CASE WHEN origin = 'MANIFEST_CLASS' THEN coalesce(lh, false) WHEN method_name IS NULL THEN coalesce(la, false) ELSE method_hit END AS wl
  FROM reference r LEFT JOIN anyw USING (class_name) LEFT JOIN own USING (instance_id, class_name) WHERE NOT inline AND instance_id IN (SELECT instance_id FROM dependency WHERE references_recorded)),
h2 AS (SELECT *, wl AND NOT (fi AND method_name IS NULL) AS live, origin = 'BASELINE' AND NOT ftl AND NOT la AS nl FROM held),
h3 AS (SELECT *, CASE WHEN method_name IS NULL THEN class_name || ' (class level)' ELSE class_name || '#' || method_name END || CASE WHEN ftl THEN ' (failed to load)' WHEN fi AND NOT live THEN ' (failed to initialise)' WHEN nl THEN ' (never loaded)' ELSE '' END AS site FROM h2),
refs AS (SELECT identity_key, list_sort(list(DISTINCT site)) AS sites, bool_or(nl) AS nl, bool_or(live) AS live, bool_or(ftl) AS ftl, bool_or(fi AND NOT live) AS fti, bool_or(NOT wl AND method_name IS NOT NULL AND without_evidence) AS wo
  FROM h3 JOIN external_class x ON x.instance_id = h3.instance_id AND x.class_name = h3.referenced_class AND NOT x.absent JOIN dependency d ON d.instance_id = h3.instance_id AND d.dependency_id = x.dependency_id GROUP BY 1),
lst AS (SELECT identity_key, max(loaded_classes_total) AS loaded_total, max(class_count) AS class_count, string_agg(DISTINCT discovery_source, ',' ORDER BY discovery_source) AS sources, bool_and(coalesce(class_count = 0, false)) AS nc, bool_or(discovery_source = 'STARTUP_CLASSPATH') AS su,
  bool_or(references_recorded) AS ju, coalesce(bool_and(baseline_complete) FILTER (references_recorded), true) AS co, list_sort(list(DISTINCT instance_id)) AS instances FROM dependency GROUP BY 1),
dep AS (SELECT identity_key, CASE WHEN loaded_total = 0 AND nc THEN 'RESOURCES_ONLY' WHEN loaded_total = 0 AND su THEN 'UNLOADED' WHEN NOT ju THEN 'LOADED' WHEN live THEN 'USED' WHEN ftl THEN 'FAILED_TO_LOAD' WHEN fti THEN 'FAILED_TO_INITIALIZE' WHEN wo THEN 'WITHOUT_EVIDENCE'
  WHEN NOT co THEN 'NO_LIVE_REFERENCE' WHEN live IS NULL THEN 'UNREFERENCED' ELSE 'UNREACHED' END AS status, loaded_total, class_count, sources, [identity_key] AS identities, CAST([] AS VARCHAR[]) AS versions, coalesce(sites, []) AS sites, coalesce(nl, false) AS never_loaded, instances FROM lst LEFT JOIN refs USING (identity_key))"""
DEPS = ("dependency", "reference", "external_class", "class_state")


def _dependencies(t):
    return D.dependency_status(*(t(n) for n in ("dependency", "reference", "class_state", "external_class")))


@query("q23_dependency_status", DEPENDENCY + " SELECT * FROM dep", DEPS)
def _(t):
    return _dependencies(t)


@query("a17_status_histogram", DEPENDENCY + " SELECT status, count(*) AS dependencies FROM dep GROUP BY 1", DEPS)
def _(t):
    return _dependencies(t).groupBy("status").agg(F.count(F.lit(1)).alias("dependencies"))


for _name, _status in (("q24_unloaded_dependencies", "UNLOADED"), ("q24_unreferenced_dependencies", "UNREFERENCED"), ("q24_unreached_dependencies", "UNREACHED"), ("q24_failed_to_load_dependencies", "FAILED_TO_LOAD"), ("q24_failed_to_initialize_dependencies", "FAILED_TO_INITIALIZE")):

    def _of_status(t, status=_status):
        # jars of instances that record no references, or lack a baseline, would raise: they are listed apart
        findings = D.in_status_order(_dependencies(t)).where("status not in ('LOADED', 'NO_LIVE_REFERENCE')")
        return D.with_status(findings, status).select("identity_key", "sites")

    query(_name, DEPENDENCY + f" SELECT identity_key, sites FROM dep WHERE status = '{_status}'", DEPS)(_of_status)


@query("q25_absent_references", DEPENDENCY + """ SELECT h3.referenced_class, list_sort(list(DISTINCT site)) AS sites, bool_or(nl) AS never_loaded FROM h3 JOIN external_class x ON x.instance_id = h3.instance_id AND x.class_name = h3.referenced_class AND x.absent GROUP BY 1""", DEPS)
def _(t):
    return D.absent_references(t("reference"), t("external_class"), t("class_state"), t("dependency").where("references_recorded"))


@query("x12_jar_kind", "SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'AGENT' WHEN p_size % 7 = 0 THEN 'BOOT_APPLICATION' WHEN p_size % 5 = 0 THEN 'AGENT_CLASSES' WHEN p_size % 3 = 0 THEN 'ADOPTERS_OWN' ELSE 'DEPENDENCY' END AS kind FROM part")
def _(t):
    k = F.col("p_size")
    none = F.lit(None).cast("map<string,string>")
    attributes = F.when(k % 11 == 0, F.create_map(F.lit("Premain-Class"), F.lit("x"))).when(k % 7 == 0, F.create_map(F.lit("Spring-Boot-Lib"), F.lit("x"))).otherwise(none)
    names = F.array(F.lit("lib.A"), F.when(k % 5 == 0, "agent.B").otherwise("lib.B"))
    return t("part").select("p_partkey", D.jar_kind(attributes, names, "agent.", F.array(F.lit(False), k % 3 == 0)).alias("kind"))


@query("f03_identity_key", r"""SELECT p_brand, string_agg(DISTINCT replace(replace(replace(p_type, '\', '\\'), ':', '\:'), ',', '\,') || ':' || p_size, ',' ORDER BY replace(replace(replace(p_type, '\', '\\'), ':', '\:'), ',', '\,') || ':' || p_size) AS key FROM (SELECT p_brand, CASE WHEN p_size % 2 = 0 THEN replace(p_type, ' ', ',') ELSE replace(p_type, ' ', ':') END AS p_type, p_size FROM part) GROUP BY 1""")
def _(t):
    p = t("part").select("p_brand", F.when(F.col("p_size") % 2 == 0, F.replace("p_type", F.lit(" "), F.lit(","))).otherwise(F.replace("p_type", F.lit(" "), F.lit(":"))).alias("group_id"), F.col("p_size").cast("string").alias("artifact_id"))
    return p.groupBy("p_brand").agg(F.collect_set(F.struct("group_id", "artifact_id")).alias("ids")).select("p_brand", T.identity_key(F.col("ids")).alias("key"))


# --- graph ---------------------------------------------------------------------------------------------------------------


@query("r01_closure", ", up AS (SELECT child AS a, parent AS b FROM supertype UNION SELECT up.a, s.parent FROM up JOIN supertype s ON s.child = up.b) SELECT * FROM up", ("supertype",))
def _(t):
    return C.reach(t("supertype").select(F.col("child").alias("a"), F.col("parent").alias("b")))


UP = ", up AS (SELECT child AS a, parent AS b, 1 AS depth FROM supertype UNION SELECT up.a, s.parent, depth + 1 FROM up JOIN supertype s ON s.child = up.b)"


@query("g03_declaring_type", UP + ", wanted AS (SELECT p_partkey AS type, 'm0' AS method FROM part), above AS (SELECT type, method, type AS found, 0 AS depth FROM wanted UNION ALL SELECT type, method, b, up.depth FROM wanted JOIN up ON a = type) SELECT type, above.method, arg_min(found, depth) AS declared_in FROM above WHERE EXISTS (SELECT 1 FROM declares d WHERE d.type = found AND d.method = above.method) GROUP BY 1, 2", ("supertype", "declares"))
def _(t):
    wanted = t("part").select(F.col("p_partkey").alias("type"), F.lit("m0").alias("method"))
    return C.declaring_type(wanted, t("supertype"), t("declares"))


@query("g04_widen_to_subtypes", UP + " SELECT b AS type, 'm1' AS method, a AS subtype FROM up JOIN declares d ON d.type = a AND d.method = 'm1'", ("supertype", "declares"))
def _(t):
    wanted = t("part").select(F.col("p_partkey").alias("type"), F.lit("m1").alias("method"))
    return C.widened(wanted, t("supertype"), t("declares"))


ROOTS = ", cal AS (SELECT callee AS node, bool_or(n.hit) AS from_hit FROM call_edge JOIN method_node n ON n.node = caller GROUP BY 1), root AS (SELECT n.node AS root, CASE WHEN from_hit THEN 'REACHED_FROM_HIT' ELSE 'UNCALLED' END AS kind FROM method_node n LEFT JOIN cal USING (node) WHERE NOT hit AND (from_hit IS NULL OR from_hit))"
GRAPH = ("call_edge", "method_node")


@query("g11_roots", ROOTS + " SELECT * FROM root", GRAPH)
def _(t):
    return C.roots(t("method_node"), t("call_edge"))


# on an acyclic graph the least fixpoint is what the root reaches less what anything else starts
CLUSTERS = ROOTS + """, cold AS (SELECT caller, callee FROM call_edge JOIN method_node ON node = callee WHERE NOT hit),
fwd AS (SELECT root, root AS node FROM root UNION SELECT root, callee FROM fwd JOIN cold ON caller = node),
src AS (SELECT r.root, n.node FROM root r, method_node n LEFT JOIN cal USING (node) WHERE n.node <> r.root AND (n.hit OR from_hit IS NULL) AND r.root IN (SELECT root FROM fwd WHERE root <> node)),
bad AS (SELECT root, node FROM src UNION SELECT bad.root, callee FROM bad JOIN call_edge ON caller = node WHERE callee <> bad.root),
mem AS (SELECT root, node AS member FROM fwd EXCEPT SELECT root, node FROM bad)"""


@query("r04_clusters", CLUSTERS + " SELECT root, count(*) AS members FROM mem GROUP BY 1", GRAPH)
def _(t):
    nodes, edges = t("method_node"), t("call_edge")
    m = C.clusters(nodes, edges, C.roots(nodes, edges))
    return C.ranked(m.groupBy("root").agg(F.count(F.lit(1)).alias("members")))


# --- gates ---------------------------------------------------------------------------------------------------------------

NOW = 2_000_000
LIVE = f"(NOT ended AND {NOW} - last_heard < CASE WHEN flush_interval_seconds > 0 THEN flush_interval_seconds * 3000 ELSE 3600000 END)"


@query("gate_zero", f" SELECT instance_id, reason FROM (SELECT *, CASE WHEN NOT has_delta THEN 'NO_DELTA' WHEN counts_pending THEN 'COUNTS_PENDING' WHEN {LIVE} AND starting THEN 'STARTING' WHEN unwatched THEN 'UNWATCHED' WHEN unplaced > 0 THEN 'UNPLACED_FAILURES' END AS reason FROM instance_state WHERE has_manifest OR has_delta) WHERE reason IS NOT NULL", ("instance_state",))
def _(t):
    return G.zero_holds(t("instance_state"), NOW)


@query("gate_live", f" SELECT instance_id, reason FROM (SELECT *, CASE WHEN NOT has_delta THEN 'NO_DELTA' WHEN counts_pending THEN 'COUNTS_PENDING' WHEN starting THEN 'STARTING' END AS reason FROM instance_state WHERE {LIVE}) WHERE reason IS NOT NULL", ("instance_state",))
def _(t):
    return G.live_holds(t("instance_state"), NOW)


@query("gate_scan_evidence", f" SELECT instance_id FROM instance_state WHERE {LIVE} OR (has_delta AND NOT starting)", ("instance_state",))
def _(t):
    return G.scan_evidence(t("instance_state"), NOW)


HOLD = f"CASE WHEN NOT has_delta THEN 'NO_DELTA' WHEN counts_pending THEN 'COUNTS_PENDING' WHEN {LIVE} AND starting THEN 'STARTING' END"


@query("gate_listing", f" SELECT instance_id, reason FROM (SELECT instance_id, {HOLD} AS reason FROM instance_state WHERE instance_id IN (SELECT 'i-' || s_suppkey FROM supplier)) WHERE reason IS NOT NULL", ("instance_state",))
def _(t):
    return G.listing_holds(t("instance_state"), t("supplier").select(F.concat(F.lit("i-"), F.col("s_suppkey").cast("string")).alias("instance_id")), NOW)


@query("gate_listed", " SELECT instance_id, 'NOT_LISTED' AS reason FROM instance_state WHERE NOT dependencies_listed", ("instance_state",))
def _(t):
    return G.listed_holds(t("instance_state"))


@query("q29_not_settled", f" SELECT instance_id, reason FROM (SELECT instance_id, CASE WHEN NOT has_delta THEN 'NO_DELTA' WHEN counts_pending THEN 'COUNTS_PENDING' WHEN final_complete THEN NULL WHEN ended THEN 'INCOMPLETE_FINAL_FLUSH' WHEN {LIVE} AND starting THEN 'STARTING' WHEN flushes - CASE WHEN flushes > 3 THEN 3 ELSE 0 END < 2 THEN 'TOO_FEW_FLUSHES' END AS reason FROM instance_state) WHERE reason IS NOT NULL", ("instance_state",))
def _(t):
    x = t("instance_state")
    return G.not_settled(x, x.where("flushes > 3").select("instance_id", F.lit(3).alias("flushes")), NOW)


@query("q24_gated_listing", f" SELECT instance_id FROM instance_state WHERE {HOLD} IS NULL AND dependencies_listed", ("instance_state",))
def _(t):
    x = t("instance_state").where("dependencies_listed")
    clear = x.join(G.listing_holds(x, x.select("instance_id"), NOW), "instance_id", "left_anti")
    # held instances would raise; those that are clear pass the gate
    return G.checked(clear.select("instance_id"), G.listed_holds(clear))


# --- validation ----------------------------------------------------------------------------------------------------------


@query("v01_invalid_resource", "SELECT c_custkey, CASE WHEN length(n) > 1024 THEN 'service_name is longer than 1024 bytes' WHEN trim(n) = '' THEN 'service_name is empty' WHEN n IN ('.', '..') THEN 'service_name is a dot name' WHEN i = '' THEN 'instance_id is empty' END AS reason FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN repeat('x', 1025) WHEN 1 THEN '  ' WHEN 2 THEN '..' ELSE c_name END AS n, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS i FROM customer)")
def _(t):
    k = F.col("c_custkey")
    c = t("customer").select("c_custkey", F.when(k % 5 == 0, F.repeat(F.lit("x"), 1025)).when(k % 5 == 1, F.lit("  ")).when(k % 5 == 2, F.lit("..")).otherwise(F.col("c_name")).alias("service_name"), F.when(k % 4 == 0, F.lit("")).otherwise(F.col("c_name")).alias("instance_id"), F.lit("r").alias("run_id"), F.lit(None).cast("string").alias("service_namespace"))
    return c.select("c_custkey", V.invalid_resource(["service_name", "service_namespace", "instance_id", "run_id"]).alias("reason"))


TIMES = "SELECT p_partkey, p_size % 7 = 0 AS a, p_size % 5 = 0 AS b, p_size % 11 = 0 AS c FROM part"


def _times(t, names):
    k, bad = F.col("p_size"), F.lit(253_402_300_800_000)
    lists = {n: F.array(F.lit(5).cast("long"), F.when(k % m == 0, F.lit(-1) if m == 7 else bad).otherwise(F.lit(0)).cast("long")) for n, m in zip(names, (7, 5, 11), strict=True)}
    fixed = {f: F.lit("x") for f in V.FIELDS}
    return t("part").select("p_partkey", *[c.alias(n) for n, c in (lists | fixed).items()])


@query("v03_invalid_delta_batch", f"SELECT p_partkey, CASE WHEN a THEN 'deltas[1].first_seen_at is out of range' WHEN b THEN 'endpoint_deltas[1].first_seen_at is out of range' WHEN c THEN 'dependency_deltas[1].first_loaded_at is out of range' END AS reason FROM ({TIMES})")
def _(t):
    return _times(t, ["deltas", "endpoint_deltas", "dependency_deltas"]).select("p_partkey", V.invalid_delta_batch().alias("reason"))


@query("v04_invalid_manifest", f"SELECT p_partkey, CASE WHEN c THEN 'failed_classes[1].withheld_at is out of range' WHEN b THEN 'skipped_classes[1].skipped_at is out of range' WHEN a THEN 'framework_markers[1].seen_at is out of range' END AS reason FROM ({TIMES})")
def _(t):
    x = _times(t, ["framework_markers", "skipped_classes", "failed_classes"])
    none = F.lit(None).cast("array<long>")
    return x.select("*", *[none.alias(n) for n in ("unreported_classes", "classes_failed_to_initialize", "disabled_endpoint_modules")]).select("p_partkey", V.invalid_manifest().alias("reason"))


@query("v05_invalid_chunk", "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 = 0 THEN 'scanned_at is not set' WHEN l_orderkey % 5 = 0 THEN 'chunk_count must be at least 1' WHEN l_linenumber = 1 THEN 'chunk_index is negative' WHEN l_linenumber - 2 >= l_orderkey % 5 THEN 'chunk_index is out of range for chunk_count' END AS reason FROM lineitem")
def _(t):
    x = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 9).alias("scanned_at"), (F.col("l_orderkey") % 5).alias("chunk_count"), (F.col("l_linenumber") - 2).alias("chunk_index"))
    return x.select("l_orderkey", "l_linenumber", V.invalid_chunk().alias("reason"))


# the first run and the one instance are those of accepted payloads
REJECTED = """WITH p AS (SELECT o_orderkey, o_custkey, o_orderkey % 3 AS run, CASE WHEN o_orderkey % 11 = 0 THEN 'STRIPPED' WHEN o_orderkey % 7 = 0 THEN 'AGENT_VERSION' END AS early FROM orders),
f AS (SELECT o_custkey, arg_min(run, o_orderkey) AS first FROM p WHERE early IS NULL GROUP BY 1), r AS (SELECT o_orderkey, coalesce(early, CASE WHEN run <> first THEN 'SECOND_RUN' END) AS reason FROM p LEFT JOIN f USING (o_custkey))"""


def _payloads(t):
    o = F.col("o_orderkey")
    version = F.when(o % 7 == 0, "old").when(o % 2 == 0, "").otherwise("1.0")
    return t("orders").select("o_orderkey", F.col("o_custkey").alias("instance_id"), (o % 3).alias("run_id"), version.alias("agent_version"), (o % 11 == 0).alias("fields_stripped"), o.alias("arrival_seq"))


@query("v06_rejections", REJECTED + " SELECT * FROM r WHERE reason IS NOT NULL")
def _(t):
    return V.rejections(_payloads(t), "1.0").select("o_orderkey", "reason")


@query("v06_one_jvm", "WITH p AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'STRIPPED' WHEN o_orderkey % 7 = 0 THEN 'AGENT_VERSION' END AS early FROM orders), o AS (SELECT arg_min(o_custkey, o_orderkey) AS only_one FROM p WHERE early IS NULL) SELECT o_orderkey, coalesce(early, 'SECOND_INSTANCE') AS reason FROM p, o WHERE early IS NOT NULL OR o_custkey <> only_one")
def _(t):
    return V.rejections(_payloads(t).withColumn("run_id", F.lit("r")), "1.0", one_jvm=True).select("o_orderkey", "reason")


@query("v10_scope", "SELECT class_name FROM (SELECT DISTINCT 'com.' || p_size || CASE WHEN p_size % 2 = 0 THEN '.' ELSE '$' END || p_partkey % 9 AS class_name, p_size, p_partkey % 9 AS k FROM part) WHERE (p_size BETWEEN 1 AND 9) AND NOT (p_size = 4 AND k = 2) AND p_size <> 7")
def _(t):
    size = F.col("p_size").cast("string")
    names = t("part").select(F.concat(F.lit("com."), size, F.when(F.col("p_size") % 2 == 0, F.lit(".")).otherwise(F.lit("$")), (F.col("p_partkey") % 9).cast("string")).alias("class_name")).distinct()
    rules = [(f"com.{i}", True) for i in range(1, 10)] + [("com.4.2", False), ("com.7", False), ("com.1", True)]
    return V.in_scope(names, t.spark.createDataFrame(rules, "prefix string, include boolean"))


# --- text ----------------------------------------------------------------------------------------------------------------


@query("f04_jar_identity", r"SELECT p_partkey, coalesce(nullif(regexp_extract(s, '^(.+?)-((?:\d+\.\d+|\d+-SNAPSHOT)(?:[.-][A-Za-z0-9_+]+)*)$', 1), ''), s) AS artifact, coalesce(nullif(regexp_extract(s, '^(.+?)-((?:\d+\.\d+|\d+-SNAPSHOT)(?:[.-][A-Za-z0-9_+]+)*)$', 2), ''), 'm1') AS version FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'lib-core-' || p_size || '.2.Final' WHEN 1 THEN 'app-' || p_size || '-SNAPSHOT' WHEN 2 THEN 'plain' ELSE 'x-1-y' END AS s FROM part)")
def _(t):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("lib-core-"), s, F.lit(".2.Final.jar"))).when(k % 4 == 1, F.concat(F.lit("app-"), s, F.lit("-SNAPSHOT.JAR"))).when(k % 4 == 2, F.lit("plain.zip")).otherwise(F.lit("x-1-y.jar"))
    j = T.jar_identity(name, manifest_version=F.lit(" m1 "))
    return t("part").select("p_partkey", j["artifact"].alias("artifact"), j["version"].alias("version"))


@query("f06_method_text", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'C(int, String[], Map.Entry)' WHEN 1 THEN 'C static initialiser' ELSE 'C#run' END AS text FROM part")
def _(t):
    k = F.col("p_partkey") % 3
    return t("part").select("p_partkey", T.method_text(F.lit("C"), F.when(k == 0, "<init>").when(k == 1, "<clinit>").otherwise("run"), F.lit("(I[Ljava/lang/String;Ljava/util/Map$Entry;)V")).alias("text"))


@query("f13_member", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'pkg.C' WHEN 1 THEN 'pkg' ELSE '' END AS class_name, CASE p_partkey % 3 WHEN 0 THEN 'm#x' WHEN 1 THEN 'C' ELSE 'D' END AS method_name FROM part")
def _(t):
    k = F.col("p_partkey") % 3
    m = T.member(F.when(k == 0, "pkg.C#m#x").when(k == 1, "pkg.C").otherwise("D"))
    return t("part").select("p_partkey", m["class_name"].alias("class_name"), m["method_name"].alias("method_name"))


@query("f14_class_pattern", "SELECT p_type FROM (SELECT DISTINCT p_type FROM part) WHERE regexp_full_match(p_type, '[A-M].*') OR ends_with(p_type, 'STEEL')")
def _(t):
    p = t("part").select("p_type").distinct()
    return p.where(T.class_matches("[A-M].*", F.col("p_type")) | T.class_matches("STEEL", F.col("p_type")))


LOG = "SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN '2024-01-02T03:04:05.5Z WARNING: ' || role WHEN 1 THEN '{\"level\": \"error\", \"time\": \"2024-05-06T07:08:09Z\"}' WHEN 2 THEN 'x [WARN] y' WHEN 3 THEN 'OpenJDK 64-Bit Server VM warning: z' WHEN 4 THEN 'SEVERE: bad' ELSE role END AS line, role FROM conversations"


def _log(t):
    return t.spark.sql(LOG.replace("{", "{{").replace("}", "}}").replace("conversations", "{c}"), c=t("conversations"))


@query("f15_log_level", f"SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'WARN' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'WARN' WHEN 3 THEN 'WARN' WHEN 4 THEN 'ERROR' END AS level FROM ({LOG})")
def _(t):
    return _log(t).select("conv_id", "turn", T.log_level(F.col("line")).alias("level"))


@query("a21_level_counts", f"SELECT role AS source, CASE (conv_id + turn) % 6 WHEN 0 THEN 'WARN' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'WARN' WHEN 3 THEN 'WARN' WHEN 4 THEN 'ERROR' END AS level, count(*) AS lines FROM ({LOG}) GROUP BY 1, 2")
def _(t):
    x = _log(t)
    return H.level_counts(x.select(F.col("role").alias("source"), T.log_level(F.col("line")).alias("level")))


@query("f16_violation_key", "SELECT p_partkey, 'dead code (N) in C ' || p_brand AS key FROM part")
def _(t):
    return t("part").select("p_partkey", T.violation_key(F.concat(F.lit("dead code ("), F.col("p_size").cast("string"), F.lit(" hits, now) in C "), "p_brand")).alias("key"))


@query("f17_iso_seconds", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 3600.0 WHEN 1 THEN 86400.0 + p_size * 60 WHEN 2 THEN p_size * 604800.0 + 0.5 END::DOUBLE AS seconds FROM part")
def _(t):
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit(" PT"), s, F.lit("H\n"))).when(k == 1, F.concat(F.lit("P1DT"), s, F.lit("M"))).when(k == 2, F.concat(F.lit("P"), s, F.lit("WT0.5S"))).otherwise(F.lit("PT"))
    return t("part").select("p_partkey", T.try_iso_seconds(text).alias("seconds"))


@query("f23_home_folder", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '~/lib/' || p_size || '.jar' WHEN 1 THEN 'file:~/a.jar' ELSE '/opt/home/x' END AS location FROM part")
def _(t):
    k = F.col("p_partkey") % 3
    return t("part").select("p_partkey", T.home_folder(F.when(k == 0, F.concat(F.lit("/home/ann/lib/"), F.col("p_size").cast("string"), F.lit(".jar"))).when(k == 1, "file:/Users/b/a.jar").otherwise("/opt/home/x")).alias("location"))


@query("f24_fingerprint", "SELECT p_partkey, CASE p_size % 2 WHEN 0 THEN p_brand || ' [uncalled]' ELSE p_brand END AS key FROM part")
def _(t):
    return t("part").select("p_partkey", T.fingerprint(F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, "cluster").otherwise("method"), F.lit("called_only_by_tests"), F.lit(True)).alias("key"))


# --- harness -------------------------------------------------------------------------------------------------------------


@query("u01_finding_diff", "(SELECT c_mktsegment AS key, c_nationkey AS n, 'WENT_AWAY' AS change FROM customer WHERE c_acctbal < 8500 EXCEPT SELECT c_mktsegment, c_nationkey, 'WENT_AWAY' FROM customer WHERE c_acctbal >= 8500) UNION ALL (SELECT c_mktsegment, c_nationkey, 'APPEARED' FROM customer WHERE c_acctbal >= 8500 EXCEPT SELECT c_mktsegment, c_nationkey, 'APPEARED' FROM customer WHERE c_acctbal < 8500)")
def _(t):
    c = t("customer").select("c_acctbal", F.col("c_mktsegment").alias("key"), F.col("c_nationkey").alias("n"))
    return H.finding_diff(c.where("c_acctbal < 8500").drop("c_acctbal"), c.where("c_acctbal >= 8500").drop("c_acctbal"))


@query("q34_unexplained", """WITH f AS (SELECT 's' || p_size % 3 AS scope, 'k' || p_partkey AS key, p_type AS c, 'm' || p_size % 4 AS m, p_partkey, p_size FROM part)
SELECT scope, key, 'UNNAMED' AS why FROM f WHERE p_partkey % 9 = 0 UNION ALL SELECT scope, key, 'BANNED' FROM f WHERE (scope = 's0' AND ends_with(c, 'STEEL')) OR (scope = 's1' AND regexp_full_match(c, 'PROMO.*') AND m IN ('m1', 'm2'))
UNION ALL SELECT scope, key, 'REMOVED' FROM f WHERE c IN (SELECT p_type FROM part WHERE p_size = 2) AND scope = 's2'""")
def _(t):
    scope = F.concat(F.lit("s"), (F.col("p_size") % 3).cast("string"))
    f = t("part").select(scope.alias("scope"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_type").alias("class_name"), F.concat(F.lit("m"), (F.col("p_size") % 4).cast("string")).alias("method_name"), "p_partkey", "p_size")
    banned = t.spark.createDataFrame([("s0", "STEEL", None), ("s1", "PROMO.*", ["m1", "m2"])], "scope string, class_pattern string, methods array<string>")
    return H.unexplained(f, f.where("p_partkey % 9 <> 0"), banned, f.where("p_size = 2").select("scope", "class_name"))


@query("j17_truth_gaps", "SELECT p_brand, p_size, 'MISSING' AS gap FROM (SELECT DISTINCT p_brand, p_size FROM part WHERE p_partkey % 2 = 0) EXCEPT SELECT p_brand, p_size, 'MISSING' FROM part WHERE p_partkey % 2 = 1 UNION ALL (SELECT DISTINCT p_brand, p_size, 'UNEXPLAINED' FROM part WHERE p_partkey % 2 = 1 EXCEPT SELECT p_brand, p_size, 'UNEXPLAINED' FROM part WHERE p_partkey % 2 = 0)")
def _(t):
    p = t("part")
    return H.truth_gaps(p.where("p_partkey % 2 = 0").select("p_brand", "p_size").distinct(), p.where("p_partkey % 2 = 1").select("p_brand", "p_size").distinct(), ["p_brand", "p_size"])


EVENTS_AT = "SELECT event_id AS id, user_id, event_type, epoch(ts) AS moment FROM events"


def _events_at(t):
    return t("events").select(F.col("event_id").alias("id"), "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))


for _name, _in in (("j14_inside_windows", True), ("j15_outside_windows", False)):

    def _windowed(t, inside=_in):
        e = _events_at(t)
        w = e.where("event_type = 'error'").select("user_id", F.col("at").alias("t0"), (F.col("at") + 7200).alias("t1"))
        return H.within_windows(e, w, ["user_id"], "at", 7200.0, inside).select("id")

    query(_name, f"WITH e AS ({EVENTS_AT}) SELECT id FROM e WHERE {'' if _in else 'NOT '}EXISTS (SELECT 1 FROM e w WHERE w.event_type = 'error' AND w.user_id = e.user_id AND e.moment BETWEEN w.moment AND w.moment + 7200)")(_windowed)


@query("j13_nearest_control", f"WITH e AS ({EVENTS_AT}), p AS (SELECT * FROM e WHERE event_type <> 'error'), c AS (SELECT * FROM e WHERE event_type = 'error'), d AS (SELECT p.id, p.user_id AS app, p.moment AS started, c.id AS control, row_number() OVER (PARTITION BY p.id ORDER BY abs(p.moment - c.moment), c.moment) AS r FROM p JOIN c USING (user_id)) SELECT app, id, started, control FROM d WHERE r = 1")
def _(t):
    e = _events_at(t).select(F.col("user_id").alias("app"), "id", F.col("at").alias("started"), "event_type")
    return H.nearest_control(e.where("event_type <> 'error'").drop("event_type"), e.where("event_type = 'error'").drop("event_type"))


@query("a20_memory_trend", ", a AS (SELECT *, moment - min(moment) OVER (PARTITION BY instance) AS age FROM sample) SELECT instance, count(*) AS samples, round(regr_slope(rss, age) * 1e6, 4) AS slope, round(avg(rss), 4) AS mean FROM a WHERE age >= 1800 GROUP BY 1", ("sample",))
def _(t):
    m = H.memory_trend(t("sample").withColumnRenamed("moment", "at"), ["instance"])
    return m.select("instance", "samples", F.round(F.col("slope") * 1e6, 4).alias("slope"), F.round("mean", 4).alias("mean"))


TRAFFIC = """WITH tr AS (SELECT 'i' || l_linenumber AS instance, l_returnflag AS route, sum(l_quantity)::BIGINT AS ok, count(*) AS non2xx, max(l_discount) AS rate FROM lineitem GROUP BY 1, 2),
st AS (SELECT 'i' || p_size % 4 AS instance, count(*) AS starts FROM part GROUP BY 1), ki AS (SELECT 'i' || p_size % 9 AS instance, count(*) AS kills FROM part WHERE p_size % 10 = 3 GROUP BY 1),
tol AS (SELECT route, sum(ok)::BIGINT AS ok, sum(ok + non2xx)::BIGINT AS sent, sum((ceil(rate * 60) + 1) * (1 + coalesce(kills, 0) + 5) + 2 * coalesce(starts, 1) + ceil(10 * rate))::BIGINT AS tolerance FROM tr LEFT JOIN st USING (instance) LEFT JOIN ki USING (instance) GROUP BY 1)"""


def _tolerance(t):
    li = t("lineitem").groupBy(F.concat(F.lit("i"), F.col("l_linenumber").cast("string")).alias("instance"), F.col("l_returnflag").alias("route"))
    traffic = li.agg(F.sum("l_quantity").cast("long").alias("ok"), F.count(F.lit(1)).alias("non2xx"), F.max("l_discount").alias("rate_per_s")).withColumns({"errors": F.lit(0), "flush_s": F.lit(60)})
    at = lambda n: F.concat(F.lit("i"), (F.col("p_size") % n).cast("string")).alias("instance")
    p = t("part")
    return H.count_tolerance(traffic, p.select(at(4)), p.where("p_size % 10 = 3").select(at(9)), t("region"))


@query("a19_count_tolerance", TRAFFIC + " SELECT * FROM tol")
def _(t):
    return _tolerance(t)


@query("q35_count_verdict", TRAFFIC + ", c AS (SELECT l_returnflag AS route, sum(l_quantity)::BIGINT + count(*) AS total FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) SELECT route, total, coalesce(total BETWEEN ok - tolerance AND sent + tolerance, false) AS holds FROM tol LEFT JOIN c USING (route)")
def _(t):
    x = _tolerance(t)
    totals = t("lineitem").where("l_returnflag <> 'N'").groupBy(F.col("l_returnflag").alias("route")).agg((F.sum("l_quantity").cast("long") + F.count(F.lit(1))).alias("total"))
    return H.count_verdict(x, x, totals)


@query("w06_due_reads", f"""WITH e AS ({EVENTS_AT}), r AS (SELECT user_id AS key, moment, (SELECT max(o.moment) FROM e o WHERE o.event_type = 'error' AND o.user_id = e.user_id AND o.moment <= e.moment) AS f FROM e WHERE event_type = 'view'),
x AS (SELECT *, lag(moment) OVER (PARTITION BY key ORDER BY moment) AS b, lag(f) OVER (PARTITION BY key ORDER BY moment) AS fb FROM r)
SELECT key, round(moment, 3) AS moment, coalesce(moment - f < 86400, false) AS covered, cast(CASE WHEN coalesce(b - fb < 86400 AND moment - fb < 86400, false) AND moment - b > 900 THEN round_even((moment - b) / 600, 0) - 1 ELSE 0 END AS int) AS skipped FROM x""")
def _(t):
    e = _events_at(t).select(F.col("user_id").alias("key"), "at", "event_type")
    return H.due_reads(e.where("event_type = 'error'"), e.where("event_type = 'view'"), 600.0, 86400.0).select("key", F.round("at", 3).alias("moment"), "covered", "skipped")


@query("w06_opened_windows", f"WITH o AS (SELECT user_id, moment, CASE WHEN moment - lag(moment) OVER (PARTITION BY user_id ORDER BY moment) > 86400 OR lag(moment) OVER (PARTITION BY user_id ORDER BY moment) IS NULL THEN 1 ELSE 0 END AS new FROM ({EVENTS_AT}) WHERE event_type = 'error'), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY moment ROWS UNBOUNDED PRECEDING) AS n FROM o) SELECT user_id, cast(n AS bigint) AS n, min(moment) AS t0, max(moment) + 86400 AS t1, count(*) AS opened FROM g GROUP BY 1, 2")
def _(t):
    return H.opened_windows(_events_at(t), "user_id", "at", "event_type = 'error'", 86400.0)


@query("q40_read_violations", "SELECT c_nationkey AS \"window\", count(*) AS reads, count(DISTINCT c_mktsegment) AS violations, count(*) FILTER (c_acctbal < 0) * 10 > count(*) AS too_many_failed FROM customer GROUP BY 1")
def _(t):
    return H.read_violations(t("customer").select(F.col("c_nationkey").alias("window"), F.col("c_mktsegment").alias("violation"), (F.col("c_acctbal") < 0).alias("failed")))


# --- statistics ----------------------------------------------------------------------------------------------------------


@query("a22_summary", "SELECT l_returnflag AS variant, median(l_extendedprice) AS median, min(l_extendedprice) AS min, max(l_extendedprice) AS max, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1")
def _(t):
    return B.summary(t("lineitem").withColumnRenamed("l_returnflag", "variant"), ["variant"], "l_extendedprice")




@query("a31_against_baseline", "WITH s AS (SELECT l_linestatus AS metric, l_returnflag AS variant, median(l_quantity) AS m, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1, 2) SELECT s.metric, s.variant, s.m AS median, CASE WHEN b.m <> 0 THEN (s.m - b.m) / b.m * 100 END AS change, s.m BETWEEN b.lo AND b.hi AS noise, s.lo <= b.hi AND b.lo <= s.hi AS overlap FROM s JOIN s b ON b.metric = s.metric AND b.variant = 'N'")
def _(t):
    x = t("lineitem").select(F.col("l_linestatus").alias("metric"), F.col("l_returnflag").alias("variant"), "l_quantity")
    return B.against_baseline(B.summary(x, ["metric", "variant"], "l_quantity"), "N")


@query("a31_pivot", """WITH s AS (SELECT l_linestatus AS metric, l_returnflag AS v, median(q) AS m, min(q) AS lo, max(q) AS hi FROM (SELECT *, floor(l_quantity)::DOUBLE AS q FROM lineitem) GROUP BY 1, 2),
c AS (SELECT s.metric, s.v, printf('%.1f (%.1f to %.1f)', s.m::DOUBLE, s.lo::DOUBLE, s.hi::DOUBLE) AS cell, CASE WHEN b.m <> 0 THEN CASE WHEN printf('%+.1f%%', (s.m - b.m) / b.m * 100) IN ('+0.0%', '-0.0%') THEN '0.0%' ELSE printf('%+.1f%%', (s.m - b.m) / b.m * 100) END || CASE WHEN s.m BETWEEN b.lo AND b.hi THEN ' *' ELSE '' END END AS change FROM s LEFT JOIN s b ON b.metric = s.metric AND b.v = 'N')
SELECT metric, coalesce(max(cell) FILTER (v = 'A'), 'n/a') AS "A", coalesce(max(cell) FILTER (v = 'N'), 'n/a') AS "N", coalesce(max(cell) FILTER (v = 'R'), 'n/a') AS "R", coalesce(max(change) FILTER (v = 'A'), 'n/a') AS "A change", coalesce(max(change) FILTER (v = 'R'), 'n/a') AS "R change" FROM c GROUP BY 1""")
def _(t):
    x = t("lineitem").select(F.col("l_linestatus").alias("metric"), F.col("l_returnflag").alias("variant"), F.floor("l_quantity").cast("double").alias("q"))
    return B.pivoted(B.summary(x, ["metric", "variant"], "q"), ["A", "N", "R"], baseline="N")


SLICES = "SELECT user_id, event_id AS slice, value AS throughput FROM events"


def _slices(t):
    return t("events").select("user_id", F.col("event_id").alias("slice"), F.col("value").alias("throughput"))


@query("w01_warm_up", f"WITH s AS (SELECT *, lag(throughput, 2) OVER w AS a, lag(throughput, 1) OVER w AS b, row_number() OVER w * 10 AS spent FROM ({SLICES}) WINDOW w AS (PARTITION BY user_id ORDER BY slice)) SELECT user_id, slice, CASE WHEN a IS NOT NULL AND a > 0 AND b > 0 AND abs(b - a) <= (0.5 + 1e-12) * a AND abs(throughput - b) <= (0.5 + 1e-12) * b AND spent >= 40 THEN 'STEADY' WHEN spent >= 120 THEN 'CAPPED' ELSE 'CONTINUE' END AS verdict FROM s")
def _(t):
    return B.warm_up(_slices(t), ["user_id"], 0.5, 10, 40, 120)


#: Runs of a variant, from thirds of each user's events; some lack a third, some serve nothing.
THIRDS = "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS load, CASE WHEN user_id % 11 > 0 THEN sum(value) FILTER (event_type = 'view') END AS a, CASE WHEN user_id % 13 > 0 THEN sum(value) FILTER (event_type = 'click') END AS b FROM events GROUP BY 1"
WARMTH = f"x AS ({THIRDS}), w AS (SELECT user_id, load, CASE WHEN a IS NULL THEN 'NO_FIRST_THIRD' WHEN b IS NULL THEN 'NO_LAST_THIRD' WHEN CASE WHEN load = 'OPEN' THEN b ELSE a END <= 0 THEN 'NOTHING_SERVED' END AS problem, CASE WHEN load = 'OPEN' THEN a / b ELSE b / a END AS d FROM x)"


def _warmth(t):
    total = lambda kind, lost: F.when(F.col("user_id") % lost > 0, F.sum(F.when(F.col("event_type") == kind, F.col("value"))))
    x = t("events").groupBy("user_id").agg(total("view", 11).alias("a"), total("click", 13).alias("b")).withColumn("load", F.when(F.col("user_id") % 2 == 0, "OPEN").otherwise("CLOSED"))
    return x.select("user_id", "load", B.warmth(F.col("load"), F.col("a"), F.col("b")).alias("w")).select("user_id", "load", "w.drift", "w.problem")


@query("w02_warmth", f"WITH {WARMTH} SELECT user_id, load, round(CASE WHEN problem IS NULL THEN d END, 6) AS drift, problem FROM w")
def _(t):
    return _warmth(t).withColumn("drift", F.round("drift", 6))


@query("a27_variant_warmth", f"WITH {WARMTH}, r AS (SELECT user_id % 4 AS variant, CASE WHEN problem IS NULL THEN d END AS d, user_id % 3 = 0 AS steady FROM w WHERE problem IS NULL OR user_id % 4 = 3), g AS (SELECT variant, median(d) AS d, count(*) FILTER (d IS NULL) AS missing, count(*) FILTER (NOT steady) AS capped FROM r GROUP BY 1) SELECT variant, round(d, 6) AS drift, missing, capped, CASE WHEN missing > 0 THEN 'MISSING' WHEN d > 1.1 THEN 'RISING' WHEN d < 0.9 THEN 'FALLING' END AS verdict FROM g")
def _(t):
    r = _warmth(t).where("problem is null or user_id % 4 = 3").select((F.col("user_id") % 4).alias("variant"), "drift", (F.col("user_id") % 3 == 0).alias("warmup_steady"))
    return B.variant_warmth(r, ["variant"]).withColumn("drift", F.round("drift", 6))


@query("a24_window_allocation", "WITH s AS (SELECT l_suppkey AS r, l_partkey % 5 AS thread, l_orderkey AS moment, l_orderkey * 3 + l_partkey % 5 AS allocated FROM lineitem), st AS (SELECT r, min(moment) AS start FROM s GROUP BY 1), p AS (SELECT r, thread, arg_min(allocated, moment) AS f, min(moment) AS fa, arg_max(allocated, moment) AS l FROM s GROUP BY 1, 2) SELECT r, cast(sum(greatest(l - CASE WHEN fa <= start + 1 THEN f ELSE 0 END, 0)) AS bigint) AS allocated FROM p JOIN st USING (r) GROUP BY 1")
def _(t):
    x = t("lineitem").select(F.col("l_suppkey").alias("r"), (F.col("l_partkey") % 5).alias("thread"), F.col("l_orderkey").alias("at"), (F.col("l_orderkey") * 3 + F.col("l_partkey") % 5).alias("allocated"))
    return B.window_allocation(x, ["r"])


ROLLED = ", ".join(f"('{t}', '{f}', {d}, '{m}', '{a}')" for t, f, d, many in B.EVENT_RULES for m, a in many)
KINDS = [(t, f) for t, f, *_ in B.EVENT_RULES]


@query("a25_event_rollup", f"""WITH r AS (SELECT * FROM (VALUES {ROLLED}) v(type, field, divisor, metric, how)), k AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{t}', '{f}')" for i, (t, f) in enumerate(KINDS))}) v(i, type, field)),
e AS (SELECT l_returnflag AS run, type, field, l_shipdate AS moment, l_quantity AS value FROM lineitem JOIN k ON i = l_partkey % {len(KINDS)}), m AS (SELECT run, metric, how, divisor, moment, sum(value) AS s, count(*) AS n, min(value) AS lo, max(value) AS hi FROM e JOIN r USING (type, field) GROUP BY 1, 2, 3, 4, 5)
SELECT run, metric, round(CASE how WHEN 'avg' THEN sum(s) / sum(n) WHEN 'max' THEN max(hi) WHEN 'min' THEN min(lo) WHEN 'sum' THEN sum(s) ELSE avg(s) END / divisor, 9) AS value FROM m GROUP BY run, metric, how, divisor""")
def _(t):
    kind = F.element_at(F.array(*[F.struct(F.lit(a).alias("type"), F.lit(b).alias("field")) for a, b in KINDS]), (F.col("l_partkey") % len(KINDS) + 1).cast("int"))
    e = t("lineitem").select(F.col("l_returnflag").alias("run"), kind.alias("k"), F.col("l_shipdate").alias("at"), F.col("l_quantity").cast("double").alias("value")).select("run", "k.type", "k.field", "at", "value")
    return B.event_rollup(e, ["run"]).select("run", "metric", F.round("value", 9).alias("value"))


@query("a28_counter_difference", "SELECT a.c_custkey, a.v - coalesce(b.v, 0) AS gained FROM (SELECT c_custkey, c_acctbal AS v FROM customer) a LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1) b ON o_custkey = c_custkey".replace("a.v - coalesce(b.v, 0)", "round(a.v - coalesce(b.v, 0), 4)"))
def _(t):
    b = t("orders").where("o_custkey % 2 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("value"))
    d = B.counter_difference(b, t("customer").select("c_custkey", F.col("c_acctbal").alias("value")), ["c_custkey"])
    return d.select("c_custkey", F.round("gained", 4).alias("gained"))


RUNS = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS load, l_discount * 40 AS cores, CASE WHEN l_quantity > 45 THEN 3 END AS dropped, CASE WHEN l_returnflag = 'R' THEN 'NO_LAST_THIRD' END AS cold, l_tax FROM lineitem"


@query("q41_run_problems", f"""SELECT l_orderkey, l_linenumber, l_partkey, list_filter([CASE WHEN load = 'OPEN' THEN CASE WHEN coalesce(dropped, 0) > 0 THEN 'DROPPED' WHEN cores >= 1.6 THEN 'NO_HEADROOM' END WHEN cores < 1.8 THEN 'NOT_SATURATED' END, cold,
CASE WHEN l_tax > 0.03 AND l_tax < 0.05 THEN 'NO_PROBE' END, CASE WHEN l_tax > 0.05 THEN 'DISABLED_MODULES' END], lambda x: x IS NOT NULL) AS problems FROM ({RUNS})""")
def _(t):
    x = t("lineitem")
    tax = F.col("l_tax")
    load = F.when(F.col("l_linenumber") % 2 == 0, "OPEN").otherwise("CLOSED")
    delivery = B.delivery_problems(tax > 0.03, F.when(tax < 0.05, 0).otherwise(7), F.lit(4), F.when(tax > 0.05, 2).otherwise(0))
    problems = B.run_problems(load, F.col("l_discount") * 40, F.lit(2), F.when(F.col("l_quantity") > 45, 3), F.when(F.col("l_returnflag") == "R", "NO_LAST_THIRD"), delivery)
    return x.select("l_orderkey", "l_linenumber", "l_partkey", problems.alias("problems"))


@query("o04_capped_evidence", "SELECT * FROM (SELECT n_name AS line FROM nation ORDER BY 1 LIMIT 10) UNION ALL SELECT '... and ' || (count(*) - 10) || ' more' FROM nation")
def _(t):
    return H.capped(t("nation").select("n_name"), ["n_name"], 10)


@query("u02_edge_union", " SELECT DISTINCT caller, callee FROM (SELECT caller, callee FROM call_edge UNION ALL SELECT child, parent FROM supertype)", ("call_edge", "supertype"))
def _(t):
    return M.edge_union(t("call_edge"), t("supertype").select(F.col("child").alias("caller"), F.col("parent").alias("callee")))


@query("x09_top_callers", " SELECT caller, calls FROM (SELECT caller, count(*) AS calls, row_number() OVER (PARTITION BY caller % 10 ORDER BY count(*) DESC, caller) AS r FROM call_edge GROUP BY 1) WHERE r <= 3", ("call_edge",))
def _(t):
    n = t("call_edge").groupBy("caller").agg(F.count(F.lit(1)).alias("calls")).withColumn("g", F.col("caller") % 10)
    return C.nearest_first(n, ["g"], [F.desc("calls"), F.col("caller")], 3).select("caller", "calls")


@query("s14_prometheus", "SELECT p_partkey, 'hits_total' AS name, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand, p_size::DOUBLE AS value FROM part WHERE p_size % 7 > 0")
def _(t):
    size = F.col("p_size").cast("string")
    labels = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('{brand="old",brand="'), F.col("p_brand"), F.lit('",k="'), F.col("p_partkey").cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit('{k="'), F.col("p_partkey").cast("string"), F.lit('"}')))
    x = R.prometheus(t("part").select(F.when(F.col("p_size") % 7 == 0, "# HELP x").otherwise(F.concat(F.lit("hits_total"), labels, F.lit(" "), size)).alias("value")))
    return x.select(F.col("labels")["k"].cast("long").alias("p_partkey"), "name", F.col("labels")["brand"].alias("brand"), "value")


@query("s16_counts", "SELECT 'pkg/' || p_partkey AS path, p_size AS first, p_partkey AS second FROM part WHERE p_size % 5 > 0")
def _(t):
    n = F.when(F.col("p_size") % 5 > 0, F.col("p_size").cast("string")).otherwise("x")
    return R.counts(t("part").select(F.concat_ws(" ", F.concat(F.lit("pkg/"), F.col("p_partkey").cast("string")), n, F.col("p_partkey").cast("string")).alias("value")))


@query("s17_cpu_set", "SELECT p_partkey, list_concat(range(p_size, p_size + 3), [p_size + 9]) AS cpus FROM part")
def _(t):
    k = F.col("p_size")
    text = F.concat(k.cast("string"), F.lit("-"), (k + 2).cast("string"), F.lit(","), (k + 9).cast("string"))
    return t("part").select("p_partkey", R.cpu_set(text).alias("cpus"))


# --- smaller operators ---------------------------------------------------------------------------------------------------


@query("f02_normalize_verb", "SELECT p_partkey, CASE WHEN trim(v) = '' OR v IS NULL THEN '*' ELSE upper(trim(v)) END AS verb FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' get ' WHEN 1 THEN '  ' WHEN 2 THEN '*' END AS v FROM part)")
def _(t):
    k = F.col("p_partkey") % 4
    return t("part").select("p_partkey", T.normalize_verb(F.when(k == 0, "\tget \n").when(k == 1, " \u3000 ").when(k == 2, "*")).alias("verb"))


@query("f05_outcome_id", " SELECT DISTINCT class_id, coalesce('k:' || branch_key, 'i:' || branch_index) AS outcome FROM probe WHERE kind = 'BRANCH'", ("probe",))
def _(t):
    return t("probe").where("kind = 'BRANCH'").select("class_id", M.outcome_id().alias("outcome")).distinct()


SENTENCE = """SELECT p_partkey, CASE WHEN k = 0 THEN '`x == "' || p_size || '\\n"…`' ELSE 'the branch at line ' || p_size END AS s, k, p_size, role FROM (SELECT *, p_partkey % 2 AS k, p_partkey % 7 AS role FROM part)"""


@query("f07_outcome_text", f"""SELECT p_partkey, CASE WHEN role = 0 THEN s || CASE WHEN k = 0 THEN ' was never true' ELSE ' never fell through' END WHEN role = 1 THEN s || CASE WHEN k = 0 THEN ' was never false' ELSE ' never jumped' END
WHEN role = 2 THEN s || ' was never `A`' WHEN role = 3 THEN s || ' was never 4' WHEN role = 4 THEN 'a case of ' || s || ' never ran' WHEN role = 5 THEN s || ' never reached its default' ELSE s || ' had an outcome that never ran' END || ', ' ||
CASE p_size % 4 WHEN 0 THEN 'only path to line ' || p_size || ', B.kt:' || p_size || '-' || p_size + 2 || ', partly to line 9' WHEN 1 THEN 'only path to line ' || p_size || ', B.kt:' || p_size || '-' || p_size + 2 WHEN 2 THEN 'partly the path to line 9' ELSE 'guards no code of its own' END AS sentence FROM ({SENTENCE})""")
def _(t):
    size, role = F.col("p_size"), F.col("p_partkey") % 7
    part = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    condition = F.when(F.col("p_partkey") % 2 == 0, F.array(part("CODE", F.lit("x == ")), part("STRING_LITERAL", F.concat(size.cast("string"), F.lit("\n"))), part("PLACEHOLDER", F.lit("?"))))
    lines = lambda file, a, b: F.struct(F.lit(file).alias("source_file"), a.alias("first_line"), b.alias("last_line"))
    guarded, partly = F.when(size % 4 <= 1, F.array(lines("", size, size), lines("B.kt", size, size + 2))), F.when(size % 2 == 0, F.array(lines("", F.lit(9), F.lit(9))))
    name = F.element_at(F.array(*map(F.lit, ["FALL_THROUGH", "TAKEN", "CASE", "CASE", "CASE", "DEFAULT", "OTHER"])), (role + 1).cast("int"))
    sentence = T.outcome_text(name, condition, size, F.when(role == 2, F.array(part("CODE", F.lit("A")))), F.when(role == 3, F.lit(4)), guarded, partly)
    return t("part").select("p_partkey", sentence.alias("sentence"))


@query("f11_site_text", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || '#run' ELSE p_brand || ' (class level)' END || CASE WHEN p_size % 7 = 0 THEN ' (failed to load)' WHEN p_size % 5 = 0 THEN ' (failed to initialise)' WHEN p_size % 3 = 0 THEN ' (never loaded)' ELSE '' END AS site, CASE p_size % 3 WHEN 0 THEN '@Get' WHEN 1 THEN 'overrides Outer$Base' ELSE 'Plain' END AS reason FROM part")
def _(t):
    size = F.col("p_size")
    reason = T.outside_reason(F.when(size % 3 == 0, "CALLBACK_ANNOTATION").when(size % 3 == 1, "OVERRIDES_METHOD"), F.when(size % 3 == 0, "web.Get").when(size % 3 == 1, "lib.Outer$Base").otherwise("Plain"))
    return t("part").select("p_partkey", T.site_text(F.col("p_brand"), F.when(size % 2 == 0, "run"), size % 3 == 0, size % 7 == 0, size % 5 == 0).alias("site"), reason.alias("reason"))


@query("f12_status_text", "SELECT DISTINCT lower(replace(status, '_', '-')) AS status FROM (SELECT CASE WHEN p_size > 9 THEN 'NEVER_HIT' ELSE 'Never_Loaded' END AS status FROM part)")
def _(t):
    return t("part").select(T.status_text(F.when(F.col("p_size") > 9, "NEVER_HIT").otherwise("Never_Loaded")).alias("status")).distinct()


@query("f19_percent_change", "SELECT c_custkey, CASE WHEN b <> 0 THEN round((c_acctbal - b) / b * 100, 6) END AS change, CASE WHEN b > 0 THEN round(c_acctbal * 1000 / b, 6) END AS per_request FROM (SELECT *, (c_nationkey - 3)::DOUBLE AS b FROM customer)")
def _(t):
    base = (F.col("c_nationkey") - 3).cast("double")
    return t("customer").select("c_custkey", F.round(B.percent_change(F.col("c_acctbal"), base), 6).alias("change"), F.round(B.per_request(F.col("c_acctbal"), base, 1000.0), 6).alias("per_request"))


@query("f18_signed_percent", """SELECT p_partkey, CASE WHEN printf('%+.1f%%', (p_size - 25) / 50.0) IN ('+0.0%', '-0.0%') THEN '0.0%' ELSE printf('%+.1f%%', (p_size - 25) / 50.0) END AS change, CASE WHEN p_size % 4 = 0 THEN printf('%.1f', p_size / 4.0) ELSE regexp_replace(printf('%.3f', p_size / 4.0), '0+$', '') END AS number FROM part""")
def _(t):
    size = F.col("p_size")
    return t("part").select("p_partkey", B.signed_percent((size - 25) / F.lit(50.0)).alias("change"), B.number_text(size / F.lit(4.0)).alias("number"))


@query("f20_request_ratios", "SELECT p_partkey, CASE WHEN p_size > 9 THEN round(p_partkey * 1000.0 / p_size, 6) END AS cpu, CASE WHEN p_size > 9 AND p_size % 2 = 0 THEN round(3 * 1024.0 / p_size, 6) END AS allocated FROM part")
def _(t):
    size = F.col("p_size").cast("double")
    m = F.map_filter(F.create_map(F.lit("k6Requests"), F.when(size > 9, size).otherwise(0.0), F.lit("cpuSeconds"), F.col("p_partkey").cast("double"), F.lit("allocatedMiB"), F.when(size % 2 == 0, 3.0)), lambda k, v: v.isNotNull())
    r = t("part").select("p_partkey", m.alias("m")).select("p_partkey", B.request_ratios(F.col("m")).alias("r"))
    return r.select("p_partkey", F.round(F.col("r")["cpuMillisPerRequest"], 6).alias("cpu"), F.round(F.col("r")["allocatedKiBPerRequest"], 6).alias("allocated"))


@query("f21_cpu_use", "SELECT p_partkey, round(p_size * 1e5 / 1e6, 9) AS cpu_seconds, round(p_size * 1e5 / 1e6 / 10, 9) AS cores_avg, 2.0::DOUBLE AS throttled_periods, p_size / 1000.0::DOUBLE AS throttled_ms FROM part")
def _(t):
    size = F.col("p_size").cast("long")
    read = lambda k: F.struct((size * 100_000 * k).alias("usage_micros"), F.lit(2 * k).alias("throttled_periods"), (size * k).alias("throttled_micros"))
    u = B.cpu_use(read(1), read(2), F.lit(10.0))
    return t("part").select("p_partkey", u.alias("u")).select("p_partkey", F.round("u.cpu_seconds", 9).alias("cpu_seconds"), F.round("u.cores_avg", 9).alias("cores_avg"), "u.throttled_periods", "u.throttled_ms")


@query("v02_trim", "SELECT p_partkey, p_brand AS name FROM part")
def _(t):
    return t("part").select("p_partkey", V.trimmed(F.concat(F.lit("   \t"), "p_brand", F.lit("　\n"))).alias("name"))


@query("v08_reported", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def _(t):
    o = F.col("o_orderkey")
    return V.reported(t("orders").select("o_orderkey", F.when(o % 3 != 0, "r").alias("run_id"), (o % 5 == 0).alias("fields_stripped"), (o % 7 == 0).alias("test_run"))).select("o_orderkey")


@query("v09_exceeded_bound", "SELECT p_partkey, CASE WHEN p_partkey * 9000 > 8388608 THEN 'ENCODED_BYTES' WHEN p_size * 10000 > CASE p_partkey % 4 WHEN 0 THEN 450000 WHEN 1 THEN 90000 WHEN 2 THEN 180000 ELSE 90000 END THEN 'ELEMENTS' END AS bound FROM part")
def _(t):
    kind = F.element_at(F.array(*map(F.lit, V.MOST_ELEMENTS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t("part").select("p_partkey", V.exceeded_bound(kind, F.col("p_partkey") * 9000, F.col("p_size") * 10_000).alias("bound"))


@query("a18_first_loaded", "SELECT s_nationkey, min(s_suppkey % 9) FILTER (s_suppkey % 9 > 0) AS first_loaded_at FROM supplier GROUP BY 1")
def _(t):
    return M.first_loaded(t("supplier").withColumn("at", F.col("s_suppkey") % 9), ["s_nationkey"], "at")


@query("x12_marker_seen", "SELECT o_custkey AS run_id, o_orderstatus AS marker, min(o_orderkey) AS seen_at FROM orders GROUP BY 1, 2")
def _(t):
    return M.marker_seen(t("orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("marker"), F.col("o_orderkey").alias("seen_at")), ["run_id", "marker"])


@query("a29_reason_sets", "SELECT p_brand AS class_name, list_sort(list(DISTINCT p_type)) AS reasons FROM part GROUP BY 1")
def _(t):
    return M.reason_sets(t("part").select(F.col("p_brand").alias("class_name"), F.col("p_type").alias("reason")))


@query("a30_loaded_classes", "SELECT l_suppkey AS dependency_id, count(DISTINCT l_partkey) AS loaded FROM lineitem GROUP BY 1")
def _(t):
    return M.loaded_classes(t("lineitem").select(F.col("l_suppkey").alias("dependency_id"), F.col("l_partkey").alias("class_name")))


# runs that ended, as the orders' customers: every kind of end, some inside two outages, some not listed
ENDS = """WITH r AS (SELECT o_orderkey AS instance_id, CASE o_orderkey % 7 WHEN 0 THEN 'crash' WHEN 1 THEN 'graceful-timeout' WHEN 2 THEN 'upgrade' WHEN 3 THEN 'kill9' ELSE 'graceful' END AS how, o_orderkey * 1.0 AS ended, o_orderkey - (o_custkey % 300) * 1.0 AS started, o_custkey % 10 > 0 AS asserted, o_custkey FROM orders),
l AS (SELECT o_orderkey AS instance_id, o_custkey % 2 = 0 AS clean FROM orders WHERE o_custkey % 4 < 3), n AS (SELECT max(o_orderkey) AS now FROM orders)"""


@query("q36_run_end", ENDS + """ SELECT r.instance_id, CASE WHEN how = 'crash' THEN 'FAULT_CRASHED' WHEN NOT asserted THEN 'SKIP_UNASSERTED' WHEN how = 'graceful-timeout' THEN 'FAULT_KILLED_ON_TIMEOUT' WHEN how NOT IN ('graceful', 'kill9') THEN 'SKIP_OTHER_END'
WHEN how = 'graceful' AND (ended BETWEEN 995 AND 2120 OR ended BETWEEN 5995 AND 7120) THEN 'SKIP_OUTAGE' WHEN now - ended < 150 THEN 'SKIP_TOO_RECENT' WHEN l.instance_id IS NULL THEN CASE WHEN ended - started >= 120 THEN 'FAULT_NOT_LISTED' ELSE 'SKIP_SHORT_LIVED' END
WHEN how = 'graceful' AND NOT clean THEN 'FAULT_NOT_CLEAN' WHEN how = 'kill9' AND clean THEN 'FAULT_CLEAN' ELSE 'GOOD' END AS verdict FROM r LEFT JOIN l USING (instance_id), n""")
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    how = F.element_at(F.array(*map(F.lit, ["crash", "graceful-timeout", "upgrade", "kill9", "graceful", "graceful", "graceful"])), (k % 7 + 1).cast("int"))
    o = t("orders")
    runs = o.select(k.alias("instance_id"), how.alias("how"), (k - c % 300).cast("double").alias("started"), k.cast("double").alias("ended"), (c % 10 > 0).alias("asserted"))
    listed = o.where("o_custkey % 4 < 3").select(k.alias("instance_id"), (c % 2 == 0).alias("ended_cleanly"))
    outages = t.spark.createDataFrame([(1000.0, 2000.0), (6000.0, 7000.0)], "t0 double, t1 double")
    now = float(o.agg(F.max("o_orderkey")).first()[0])
    return H.run_end(runs, listed, outages, now, 60.0)


# memory samples of users as processes; every tenth user is the control of the nine after it
MEMORY = """, s AS (SELECT user_id // 10 AS app, user_id AS pid, moment, value AS rss FROM (SELECT user_id, epoch(ts) AS moment, value FROM events)), f AS (SELECT app, pid, min(moment) AS started FROM s GROUP BY 1, 2),
a AS (SELECT app, pid, started, moment - started AS age, rss FROM s JOIN f USING (app, pid) WHERE moment - started >= 1800), sp AS (SELECT app, pid, started, min(age) AS lo, max(age) AS hi FROM a GROUP BY 1, 2, 3),
pr AS (SELECT p.app, p.pid, p.started, c.pid AS cpid, c.started AS cs, c.lo AS clo, c.hi AS chi FROM sp p JOIN sp c ON c.app = p.app AND c.pid % 10 < 2 AND p.pid % 10 >= 2),
mine AS (SELECT pr.app, pr.pid, pr.started, cpid, cs, count(*) AS n, min(age) AS t0, max(age) AS t1 FROM pr JOIN a ON a.app = pr.app AND a.pid = pr.pid AND age BETWEEN clo AND chi GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 6),
same AS (SELECT m.app, m.pid, m.started, cpid, cs, t0, t1, count(*) AS k, regr_slope(rss, age / 3600.0) AS c_slope, avg(rss) AS c_mean FROM mine m JOIN a ON a.app = m.app AND a.pid = m.cpid AND age BETWEEN t0 AND t1 GROUP BY 1, 2, 3, 4, 5, 6, 7 HAVING count(*) >= 6),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY app, pid ORDER BY abs(cs - started), cpid) AS r FROM same) WHERE r = 1)"""


def _memory(t):
    return t("events").select((F.expr("user_id div 10")).alias("app"), F.col("user_id").alias("pid"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("value").alias("rss"))


def _compared(t):
    own = F.when(F.col("pid") % 10 < 2, F.concat(F.lit("control-"), F.col("app").cast("string"))).otherwise(F.concat(F.lit("app-"), F.col("app").cast("string")))
    samples = _memory(t).select(own.alias("instance"), "pid", "at", "rss")
    apps = _memory(t).select("app").distinct().select(F.concat(F.lit("app-"), F.col("app").cast("string")).alias("instance"), F.concat(F.lit("control-"), F.col("app").cast("string")).alias("control"))
    starts = t.spark.createDataFrame([], "instance string, pid long, started double")
    return samples, H.control_at_same_ages(samples, starts, apps)


@query("j13_control_at_same_ages", "WITH" + MEMORY[1:] + " SELECT 'app-' || app AS instance, pid, cpid AS control_pid, round(t0, 3) AS t0, round(t1, 3) AS t1 FROM best")
def _(t):
    return _compared(t)[1].select("instance", "pid", "control_pid", F.round("t0", 3).alias("t0"), F.round("t1", 3).alias("t1"))


@query("q37_memory_verdict", "WITH" + MEMORY[1:] + ", o AS (SELECT b.app, b.pid, cpid, c_slope, c_mean, regr_slope(rss, age / 3600.0) AS slope FROM best b JOIN a ON a.app = b.app AND a.pid = b.pid AND age BETWEEN t0 AND t1 GROUP BY 1, 2, 3, 4, 5) SELECT 'app-' || app AS instance, pid, cpid AS control_pid, CASE WHEN slope > greatest(c_slope, 0) + 0.1 * c_mean / 24 THEN 'GROWS' ELSE 'FLAT' END AS verdict FROM o")
def _(t):
    return H.memory_verdict(*_compared(t)).select("instance", "pid", "control_pid", "verdict")


# log lines of three sources; every user's error opens an outage, in which warnings and errors of its kind are allowed
@query("q38_severity_verdicts", f"""WITH e AS ({EVENTS_AT}), x AS (SELECT id, CASE user_id % 3 WHEN 0 THEN 'server' WHEN 1 THEN 'collector' ELSE 'app' END AS source, CASE WHEN event_type = 'view' THEN 'WARN' WHEN event_type = 'click' THEN 'ERROR' END AS level, user_id % 5 = 0 AS agent, moment, 'lost ' || event_type || id % 10 AS text FROM e),
w AS (SELECT moment - 5 AS t0, moment + 300 AS t1 FROM e WHERE event_type = 'error'), h AS (SELECT *, (level = 'WARN' AND regexp_matches(text, '[0-4]$')) OR (level = 'ERROR' AND regexp_matches(text, 'lost.*7')) AS hit FROM x WHERE level IS NOT NULL)
SELECT id, CASE WHEN NOT (source IN ('server', 'collector') OR agent) THEN 'NOT_JUDGED' WHEN NOT hit THEN 'UNEXPLAINED' WHEN EXISTS (SELECT 1 FROM w WHERE h.moment BETWEEN t0 AND t1) THEN 'ALLOWED' ELSE 'OUTSIDE' END AS verdict FROM h""")
def _(t):
    e = _events_at(t)
    source = F.when(F.col("user_id") % 3 == 0, "server").when(F.col("user_id") % 3 == 1, "collector").otherwise("app")
    level = F.when(F.col("event_type") == "view", "WARN").when(F.col("event_type") == "click", "ERROR")
    lines = e.select("id", source.alias("source"), level.alias("level"), (F.col("user_id") % 5 == 0).alias("is_agent"), "at", F.concat(F.lit("lost "), "event_type", (F.col("id") % 10).cast("string")).alias("text"))
    allowed = t.spark.createDataFrame([("outage", "WARN", "[0-4]$"), ("outage", "ERROR", "lost.*7")], "disruption string, level string, pattern string")
    windows = e.where("event_type = 'error'").select(F.explode(F.array(F.lit("WARN"), F.lit("ERROR"))).alias("level"), F.lit("outage").alias("disruption"), (F.col("at") - 5).alias("t0"), (F.col("at") + 300).alias("t1"))
    return H.severity_verdicts(lines, allowed, windows)


# test runs are customers; their findings before and after are their orders' states
@query("q39_run_verdicts", """WITH b AS (SELECT DISTINCT o_custkey AS run, o_orderstatus AS key FROM orders WHERE o_orderkey % 2 = 0), a AS (SELECT DISTINCT o_custkey AS run, o_orderstatus AS key FROM orders WHERE o_orderkey % 2 = 1),
d AS (SELECT run FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)) GROUP BY 1)
SELECT c_custkey AS run, CASE WHEN c_custkey % 17 = 0 THEN 'FAILED' WHEN c_custkey % 13 = 0 THEN 'NO_BEFORE' WHEN c_custkey % 11 = 0 THEN 'PENDING' WHEN 100 BETWEEN c_custkey AND c_custkey + 20 THEN 'PLANNED_CHANGE' WHEN c_custkey IN (SELECT run FROM d) THEN 'CHANGED' ELSE 'UNCHANGED' END AS verdict FROM customer""")
def _(t):
    k = F.col("c_custkey")
    runs = t("customer").select(k.alias("run"), F.when(k % 17 == 0, 1).otherwise(0).alias("exit"), (k % 13 > 0).alias("has_before"), (k % 11 > 0).alias("has_after"), k.alias("t0"), (k + 20).alias("t1"))
    f = t("orders").select(F.col("o_custkey").alias("run"), F.lit("s").alias("scope"), F.col("o_orderstatus").alias("key"), "o_orderkey")
    return H.run_verdicts(runs, f.where("o_orderkey % 2 = 0"), f.where("o_orderkey % 2 = 1"), t.spark.createDataFrame([(100,)], "at int"))


@query("q42_retries", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey % 3 < 2) WHERE r = 1")
def _(t):
    k = F.col("o_orderkey") % 4
    p = F.when(k == 1, F.array(F.lit("NOT_SATURATED"))).when(k == 2, F.array(F.lit("NO_HEADROOM"))).when(k == 3, F.array(F.lit("NOT_SATURATED"), F.lit("NO_PROBE"))).otherwise(F.array().cast("array<string>"))
    x = t("orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 < 2, 1).otherwise(2).alias("attempt"), p.alias("problems"))
    return B.retries(x, ["o_custkey"], ["o_orderkey"]).select("o_orderkey")


@query("u03_withheld_classes", "SELECT p_brand AS class_name FROM part WHERE p_size = 1 UNION SELECT p_brand FROM part WHERE p_size = 2 UNION SELECT p_brand FROM part WHERE p_size = 3")
def _(t):
    b = lambda n: t("part").where(F.col("p_size") == n).select(F.col("p_brand").alias("class_name"))
    return M.withheld_classes(b(1), b(2), b(3))


@query("q26_call_edges", " SELECT DISTINCT 'm' || caller AS method_name, 'pkg.C' || caller // 10 AS class_name, 'pkg.C' || callee // 10 AS owner, 'm' || callee AS name, '()V' AS descriptor FROM call_edge", ("call_edge",))
def _(t):
    part = lambda c: (F.concat(F.lit("pkg.C"), F.expr(f"cast({c} div 10 as string)")), F.concat(F.lit("m"), F.col(c).cast("string")))
    (a, b), (c, d) = part("caller"), part("callee")
    return K.call_edges(t("call_edge").select(a.alias("class_name"), b.alias("method_name"), c.alias("owner"), d.alias("name"), F.lit("()V").alias("descriptor")))


@query("q27_rejected_payloads", "SELECT o_orderkey, 'STRIPPED' AS reason FROM orders WHERE o_orderkey % 11 = 0")
def _(t):
    o = F.col("o_orderkey")
    p = t("orders").select("o_orderkey", o.alias("instance_id"), o.alias("run_id"), F.lit("1").alias("agent_version"), (o % 11 == 0).alias("fields_stripped"), o.alias("arrival_seq"))
    return V.rejections(p, "1").select("o_orderkey", "reason")


COVERED = JUDGED + """, cov AS (SELECT class_name, method_name, method_descriptor, finding FROM judged JOIN finding USING (class_name) WHERE hits = 0 AND finding IS NOT NULL AND (finding = 'NEVER_INITIALIZED' OR method_name = '<init>' OR (method_name <> '<clinit>' AND NOT static)))"""


@query("q14_folded_lambdas", COVERED + """ SELECT l.class_name, l.method_name, l.method_descriptor, CASE WHEN c.finding IS NOT NULL THEN l.class_name END AS owner, c.finding IS NOT NULL AS into_class
FROM judged l JOIN judged cr ON cr.class_name = l.class_name AND cr.method_name = 'm' || substr(l.method_name, 7) || '_0' AND cr.hits = 0 LEFT JOIN cov c ON c.class_name = cr.class_name AND c.method_name = cr.method_name AND c.method_descriptor = cr.method_descriptor
WHERE l.lambda_body AND l.hits = 0 AND l.class_name NOT LIKE '%3' AND NOT EXISTS (SELECT 1 FROM cov x WHERE x.class_name = l.class_name AND x.method_name = l.method_name AND x.method_descriptor = l.method_descriptor)""", PROBES)
def _(t):
    m = _merged(t)
    f = C.checkpointing(Q.class_findings(m))
    creates = _creates(m)
    withheld = m.where("class_name like '%3'").select("class_name")
    return Q.folded_lambdas(m, creates, f, Q.covered_methods(m, f), withheld)


# the edges go from each class to the next, so the graph has no cycle and the fixpoint is what a root reaches less what anything else reaches
UNREACHED = MEMBERS + GUARDS + WITHHELD + """, judged AS (SELECT *, class_name || '#' || method_name || ' ' || method_descriptor AS key FROM merged WHERE kind = 'METHOD' AND NOT inline AND generated_ord = 0 AND unread_ord = 0),
thr AS (SELECT *, class_name || '#' || method_name || ' ' || method_descriptor AS key FROM merged WHERE kind = 'METHOD' AND NOT inline AND (generated_ord > 0 OR unread_ord > 0)),
per AS (SELECT class_name, bool_or(method_name = '<clinit>') AS has_init, coalesce(bool_and(hits = 0) FILTER (method_name = '<clinit>'), true) AS cold, bool_or(method_name = '<init>') AS has_ctor, bool_or(method_name = '<init>' AND hits > 0) AS constructed, bool_or(method_name NOT IN ('<init>', '<clinit>') AND NOT static) AS has_instance FROM judged GROUP BY 1),
ran AS (SELECT DISTINCT class_name FROM merged WHERE kind = 'METHOD' AND hits > 0 AND NOT static AND method_name NOT IN ('<init>', '<clinit>')),
finding AS (SELECT class_name, CASE WHEN class_name IN (SELECT class_name FROM wh) THEN NULL WHEN has_init AND cold THEN 'NEVER_INITIALIZED' WHEN has_ctor AND NOT constructed AND has_instance AND class_name NOT IN (SELECT class_name FROM ran) THEN 'NEVER_INSTANTIATED' END AS finding, constructed FROM per),
cov AS (SELECT class_name, key FROM judged JOIN finding USING (class_name) WHERE hits = 0 AND finding IS NOT NULL AND (finding = 'NEVER_INITIALIZED' OR method_name = '<init>' OR (method_name <> '<clinit>' AND NOT static))),
known AS (SELECT key, class_name, method_name, true AS node, hits FROM judged UNION ALL SELECT key, class_name, method_name, false, hits FROM thr),
own AS (SELECT DISTINCT class_name, method_name, class_name || '#' || method_name || ' ' || method_descriptor AS key, cast(substr(class_name, 6) AS int) AS n FROM merged WHERE kind = 'METHOD'),
edge AS (SELECT a.key AS caller, b.key AS callee FROM own a JOIN own b ON b.n = a.n + 1 AND b.method_name = a.method_name JOIN known k ON k.key = b.key),
res AS (SELECT caller, callee FROM edge UNION SELECT r.caller, e.callee FROM res r JOIN thr ON thr.key = r.callee JOIN edge e ON e.caller = r.callee),
tgt AS (SELECT caller, callee FROM res UNION SELECT caller, k.class_name || '#<clinit> ()V' FROM res JOIN known k ON k.key = res.callee),
role AS (SELECT key, 1 AS r FROM judged UNION ALL SELECT key, CASE WHEN hits > 0 THEN 2 ELSE 3 END FROM thr WHERE hits > 0 OR class_name IN (SELECT class_name FROM wh)),
calls AS (SELECT DISTINCT caller, callee FROM tgt JOIN role ON role.key = caller WHERE callee IN (SELECT key FROM judged) AND caller <> callee),
oc AS (SELECT 'O' || j.key || '|' || m.outcome AS node, j.key, m.class_name, m.method_name, m.method_descriptor, m.outcome FROM merged m JOIN judged j USING (class_name, method_name, method_descriptor)
  WHERE m.kind = 'BRANCH' AND m.hits <= 0 AND NOT m.inline AND m.generated_ord = 0 AND m.unread_ord = 0 AND m.routine_ord = 0 AND j.hits > 0 AND m.class_name NOT IN (SELECT class_name FROM wh)),
link AS (SELECT DISTINCT * FROM (SELECT coalesce('C' || a.class_name, 'M' || caller) AS caller, coalesce('C' || b.class_name, 'M' || callee) AS callee FROM calls LEFT JOIN cov a ON a.key = caller LEFT JOIN cov b ON b.key = callee
  UNION ALL SELECT CASE WHEN p.node IS NOT NULL AND p.node <> oc.node THEN p.node ELSE 'M' || oc.key END, oc.node FROM oc LEFT JOIN gd USING (class_name, method_name, method_descriptor, outcome) LEFT JOIN oc p ON p.node = 'O' || oc.key || '|' || gd.guard) WHERE caller <> callee),
cold AS (SELECT 'M' || key AS node, method_name <> '<clinit>' AND (method_name <> '<init>' OR coalesce(constructed, false)) AS may FROM judged LEFT JOIN finding USING (class_name) WHERE hits = 0 AND key NOT IN (SELECT key FROM cov) AND class_name NOT IN (SELECT class_name FROM wh)
  UNION ALL SELECT node, true FROM oc UNION ALL SELECT DISTINCT 'C' || class_name, true FROM cov),
hot AS (SELECT 'M' || key AS node, class_name NOT IN (SELECT class_name FROM gap) AS counts FROM judged WHERE hits > 0 UNION ALL SELECT 'M' || key, true FROM thr WHERE hits > 0),
cal AS (SELECT callee AS node, bool_or(coalesce(counts, false)) AS from_hit FROM link LEFT JOIN hot ON hot.node = caller GROUP BY 1),
start AS (SELECT node AS root, CASE WHEN node LIKE 'C%' THEN 'CLASS_FINDING' WHEN node LIKE 'O%' THEN 'UNTAKEN_OUTCOME' WHEN from_hit IS NULL THEN 'UNCALLED' ELSE 'REACHED_FROM_HIT' END AS kind FROM cold LEFT JOIN cal USING (node) WHERE may AND (from_hit IS NULL OR from_hit)),
every AS (SELECT caller AS node FROM link UNION SELECT callee FROM link UNION SELECT node FROM cold),
fwd AS (SELECT root, root AS node FROM start UNION SELECT root, callee FROM fwd JOIN link ON caller = fwd.node JOIN cold ON cold.node = callee),
src AS (SELECT root, e.node FROM start, every e WHERE e.node <> root AND root IN (SELECT root FROM fwd WHERE node <> root) AND (e.node NOT IN (SELECT node FROM cold) OR e.node NOT IN (SELECT callee FROM link))),
bad AS (SELECT root, node FROM src UNION SELECT bad.root, callee FROM bad JOIN link ON caller = node WHERE callee <> bad.root),
mem AS (SELECT root, node AS member FROM fwd EXCEPT SELECT root, node FROM bad),
listed AS (SELECT key FROM judged LEFT JOIN finding USING (class_name) WHERE method_name <> '<clinit>' AND (method_name <> '<init>' OR coalesce(constructed, false))),
shown AS (SELECT root, member, key FROM mem JOIN listed ON member = 'M' || key UNION ALL SELECT root, member, key FROM mem JOIN cov ON member = 'C' || class_name WHERE key IN (SELECT key FROM listed))
SELECT s.root, kind, key AS member FROM start s LEFT JOIN (SELECT DISTINCT root, key FROM shown) USING (root) WHERE s.root LIKE 'M%' OR s.root IN (SELECT root FROM shown WHERE member <> root)"""


@query("q22_unreached_clusters", UNREACHED, PROBES)
def _(t):
    m, keep = _merged(t), C.checkpointing
    skipped, gaps = _lists(t)
    withheld = keep(M.withheld_classes(skipped, gaps))
    f = keep(Q.class_findings(m, withheld))
    node, through = keep(K.nodes(m)), keep(K.transparent(m))
    owners = m.where("kind = 'METHOD'").select(*M.METHOD, K.method_key().alias("caller")).withColumn("n", F.expr("cast(substring(class_name, 6) as int)"))
    # each class's methods call those of the same name in the next class
    nexts = owners.select((F.col("n") - 1).alias("n"), F.col("class_name").alias("owner"), F.col("method_name").alias("name"), F.col("method_descriptor").alias("descriptor"))
    edges = owners.join(nexts, "n").where(F.col("method_name") == F.col("name")).select(F.xxhash64("caller", "owner", "name", "descriptor").alias("edge"), "caller", "owner", "name", "descriptor", F.lit(True).alias("virtual"), F.lit(None).cast("string").alias("guard"))
    none = t.spark.createDataFrame([], "child string, parent string, ord int")
    known = node.select(*M.METHOD).unionByName(through.select(*M.METHOD))
    calls = keep(K.call_graph(keep(edges), none, known, node, through, withheld=withheld))
    outcomes = keep(K.outcome_nodes(m, node, M.site_guards(t("probe"), t("site")), withheld))
    return K.unreached_clusters(node, calls, outcomes, f, Q.covered_methods(m, f), withheld=withheld, failed=gaps, possible=K.possibly_run(m, node, withheld))


from . import ingest_queries  # noqa: E402, F401  registers its queries too
