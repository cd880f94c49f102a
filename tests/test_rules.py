"""Dependencies, endpoints, gates, scans, graph, text, sources and streaming."""

import random

import pytest
from pyspark.sql import functions as F

from usagelens.functions import text as T
from usagelens.operators import bench_stats as B
from usagelens.operators import closure as C
from usagelens.operators import dependencies as D
from usagelens.operators import gates as G
from usagelens.operators import harness as H
from usagelens.operators import merge as M
from usagelens.operators import scans as S
from usagelens.operators import validation as V
from usagelens.sources import readers as R
from usagelens.streaming import ingest as I

LISTING = "instance_id string, dependency_id int, identity_key string, discovery_source string, class_count int, loaded_classes_total long, references_recorded boolean, baseline_complete boolean"
REFERENCE = "instance_id string, class_name string, method_name string, origin string, referenced_class string, inline boolean, method_hit boolean, without_evidence boolean"


def status(spark, listing, references=(), classes=(), absent=False):
    externals = spark.createDataFrame([("i", "x.X", 1, absent)], "instance_id string, class_name string, dependency_id int, absent boolean")
    c = spark.createDataFrame(list(classes), "instance_id string, class_name string, loaded boolean, failed boolean, failed_init boolean")
    return D.dependency_status(spark.createDataFrame([("i", 1, "g:a", *listing)], LISTING), spark.createDataFrame(list(references), REFERENCE), c, externals).first().status


def ref(method="m", origin="MANIFEST_METHOD", inline=False, hit=False, blind=False):
    return ("i", "C", method, origin, "x.X", inline, hit, blind)


@pytest.mark.parametrize(
    "listing, references, classes, want",
    [
        (("STARTUP_CLASSPATH", 5, 0, True, True), [], [], "UNLOADED"), (("STARTUP_CLASSPATH", 0, 0, True, True), [], [], "RESOURCES_ONLY"), (("LOADED", None, 0, True, True), [], [], "UNREFERENCED"),
        (("LOADED", 5, 3, False, True), [ref()], [], "LOADED"), (("LOADED", 5, 3, True, True), [ref(hit=True)], [], "USED"), (("LOADED", 5, 3, True, True), [ref()], [], "UNREACHED"),
        (("LOADED", 5, 3, True, True), [ref(inline=True, hit=True)], [], "UNREFERENCED"), (("LOADED", 5, 3, True, False), [ref()], [], "NO_LIVE_REFERENCE"), (("LOADED", 5, 3, True, True), [ref(blind=True)], [], "WITHOUT_EVIDENCE"),
        (("LOADED", 5, 3, True, True), [ref(None, "BASELINE")], [("i", "C", False, True, False)], "FAILED_TO_LOAD"), (("LOADED", 5, 3, True, True), [ref(None, "MANIFEST_CLASS")], [("i", "C", True, False, True)], "FAILED_TO_INITIALIZE"),
        (("LOADED", 5, 3, True, True), [ref(None, "BASELINE")], [("j", "C", True, False, False)], "USED"), (("LOADED", 5, 3, True, True), [ref(None, "MANIFEST_CLASS")], [("j", "C", True, False, False)], "UNREACHED"),
    ],
)
def test_dependency_rules(spark, listing, references, classes, want):
    assert status(spark, listing, references, classes) == want


def brute_cluster(root, cold, edges):
    members = {root}
    while True:
        more = {b for a, b in edges if a in members and b in cold and b not in members and {x for x, y in edges if y == b and x != y} <= members}
        if not more:
            return members
        members |= more


@pytest.mark.parametrize("seed", range(3))
def test_clusters_on_cyclic_graphs(spark, seed):
    rnd = random.Random(seed)
    n = 40
    hit = {i for i in range(n) if rnd.random() < 0.2}
    edges = {(rnd.randrange(n), rnd.randrange(n)) for _ in range(60)}
    nodes = spark.createDataFrame([(i, i in hit) for i in range(n)], "node int, hit boolean")
    e = spark.createDataFrame(sorted(edges), "caller int, callee int")
    r = C.roots(nodes, e)
    got: dict = {}
    for x in C.clusters(nodes, e, r).collect():
        got.setdefault(x.root, set()).add(x.member)
    callers = {i: {a for a, b in edges if b == i and a != b} for i in range(n)}
    roots = {i for i in range(n) if i not in hit and (not callers[i] or callers[i] & hit)}
    assert got == {i: brute_cluster(i, set(range(n)) - hit, {(a, b) for a, b in edges if a != b}) for i in roots}


def test_a_cycle_below_a_root_never_joins(spark):
    nodes = spark.createDataFrame([(i, False) for i in range(3)], "node int, hit boolean")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "caller int, callee int")
    assert [tuple(r) for r in C.clusters(nodes, edges, C.roots(nodes, edges)).collect()] == [(0, 0)]


def test_gates(spark):
    schema = "instance_id string, has_delta boolean, has_manifest boolean, counts_pending boolean, starting boolean, unwatched boolean, unplaced long, ended boolean, last_heard long, flush_interval_seconds int"
    row = lambda i, **k: tuple(({"instance_id": i, "has_delta": True, "has_manifest": True, "counts_pending": False, "starting": False, "unwatched": False, "unplaced": 0, "ended": False, "last_heard": 1_000_000, "flush_interval_seconds": 60} | k).values())
    x = spark.createDataFrame([row("ok"), row("manifest only", has_delta=False), row("scan only", has_delta=False, has_manifest=False), row("starting", starting=True), row("gone", starting=True, last_heard=0, flush_interval_seconds=1), row("unplaced", unplaced=1)], schema)
    holds = G.zero_holds(x, 1_000_100)
    assert {r.instance_id: r.reason for r in holds.collect()} == {"manifest only": "NO_DELTA", "starting": "STARTING", "unplaced": "UNPLACED_FAILURES"}
    with pytest.raises(G.NotEvidence):
        G.checked(x, holds)
    assert G.checked(x, holds.limit(0)).count() == 6


def test_scans(spark):
    c = spark.createDataFrame([("i", 5, 0, 2), ("i", 5, 0, 2), ("i", 5, 1, 2), ("i", 9, 0, 2), ("i", 9, 7, 2), ("i", 0, 0, 1)], "instance_id string, scanned_at long, chunk_index int, chunk_count int").withColumn("arrival_seq", F.lit(1))
    assert [(r.scanned_at, r.chunk_count) for r in S.complete_scans(c).collect()] == [(5, 2)]
    # the first count to arrive holds: a chunk that states another is ignored, even if it would complete the scan
    d = spark.createDataFrame([("i", 5, 0, 2, 1), ("i", 5, 1, 3, 2), ("i", 5, 2, 3, 3), ("i", 5, 0, 3, 4)], "instance_id string, scanned_at long, chunk_index int, chunk_count int, arrival_seq int")
    assert S.complete_scans(d).count() == 0 and S.accepted_chunks(d).count() == 1


@pytest.mark.parametrize(
    "given, want",
    [("", "/"), ("/a//b/", "/a/b"), ("{id:[0-9]{2}}", "/{id}"), ("x/{n:?}", "/x/{n?}"), ("/books{/id}", "/books/{id?}"), ("*", "/*"), ("a/**", "/a/*"), ("{path...}", "/*"), ("{*rest}", "/*"), ("{+p}", "/*"), ("<name>", "/*"),
     ("v{n}.{m}", "/v{n}.{m}"), ("a/{x/y", "/a/{x/y"), ("{.name}", "/{.name}"), ("a/ /b", "/a/b"), ("{a}{b:c/d}", "/{a}{b}"), ("<a<b>", "/<a<b>")],
)
def test_routes(given, want):
    assert T.route(given) == want


def test_text(spark):
    one = spark.createDataFrame([("\tget \n", None, " PT1H30M\n", "P", "a (3 x) b")], "v string, n string, d string, bad string, k string")
    r = one.select(
        T.normalize_verb(F.col("v")), T.normalize_verb(F.col("n")), T.iso_seconds(F.col("d")), T.try_iso_seconds(F.col("bad")), T.violation_key(F.col("k")), T.parameter_types(F.lit("([[Lp/A$B;IJ)V")),
        T.identity_key(F.expr("array(named_struct('group_id', 'g', 'artifact_id', 'b'), named_struct('group_id', 'a,', 'artifact_id', 'x:y'), named_struct('group_id', 'g', 'artifact_id', 'b'))")), T.status_text(F.lit("NEVER_HIT")),
    ).first()
    assert list(r) == ["GET", "*", 5400.0, None, "a (N) b", ["A.B[][]", "int", "long"], "a\\,:x\\:y,g:b", "never-hit"]
    with pytest.raises(Exception, match="not an ISO 8601 duration"):
        one.select(T.iso_seconds(F.col("bad"))).collect()


PART = "array<struct<kind:string,text:string>>"
RANGE = "array<struct<source_file:string,first_line:int,last_line:int>>"


@pytest.mark.parametrize(
    "role, condition, label, key, guarded, partly, want",
    [
        ("FALL_THROUGH", [("CODE", "x == "), ("STRING_LITERAL", 'a"\\\n\t')], None, None, [("", 5, 5), ("B.kt", 7, 9)], None, '`x == "a\\"\\\\\\n\\t"` was never true, only path to line 5, B.kt:7-9'),
        ("FALL_THROUGH", None, None, None, None, None, "the branch at line 3 never fell through, guards no code of its own"),
        ("TAKEN", [("CODE", "x")], None, None, None, [("", 4, 4)], "`x` was never false, partly the path to line 4"),
        ("TAKEN", [], None, None, [("", 4, 4)], [("", 6, 8)], "the branch at line 3 never jumped, only path to line 4, partly to line 6-8"),
        ("CASE", [("CODE", "x")], [("CODE", "A")], 4, None, None, "`x` was never `A`, guards no code of its own"), ("CASE", [("CODE", "x")], [], 4, None, None, "`x` was never 4, guards no code of its own"),
        ("CASE", [("PLACEHOLDER", "")], None, None, None, None, "a case of `…` never ran, guards no code of its own"), ("DEFAULT", [("OTHER", "y")], None, None, None, None, "`y` never reached its default, guards no code of its own"),
        (None, None, None, None, None, None, "the branch at line 3 had an outcome that never ran, guards no code of its own"),
    ],
)
def test_outcome_sentences(spark, role, condition, label, key, guarded, partly, want):
    d = spark.createDataFrame([(role, condition, 3, label, key, guarded, partly)], f"role string, condition {PART}, line int, label {PART}, key int, guarded {RANGE}, partly {RANGE}")
    assert d.select(T.outcome_text(*[F.col(c) for c in ("role", "condition", "line", "label", "key", "guarded", "partly")])).first()[0] == want


def test_sites_and_reasons(spark):
    d = spark.createDataFrame([("C", "m", True, False, True), ("C", None, True, False, False), ("C", "m", True, True, True), ("C", "m", False, False, False)], "c string, m string, n boolean, l boolean, i boolean")
    got = [r[0] for r in d.select(T.site_text(*[F.col(c) for c in "cmnli"])).collect()]
    assert got == ["C#m (failed to initialise)", "C (class level) (never loaded)", "C#m (failed to load)", "C#m"]
    k = spark.createDataFrame([("OVERRIDES_METHOD", "a.b.Base$X"), ("CALLBACK_ANNOTATION", "a.Get"), (None, "a.Y"), ("OVERRIDES_METHOD", None)], "k string, t string")
    assert [r[0] for r in k.select(T.outside_reason(F.col("k"), F.col("t"))).collect()] == ["overrides Base$X", "@Get", "Y", "overrides "]


def test_log_lines(spark):
    lines = {
        "2024-01-01T00:00:00Z SEVERE: x": ("ERROR", False), "WARNING: tool: y": ("WARN", True), "a [ERROR] b": ("ERROR", False), "ERRORS here": (None, False), "an ERROR": (None, False), "OpenJDK 64-Bit Server VM warning: z": ("WARN", True),
        '{"level":"warning","time":"2024-01-01T00:00:00Z"}': ("WARN", False), '{"level":"SEVERE"}': (None, False), '{"level": broken WARN x': ("WARN", False), "tool: fine": (None, True),
    }
    d = spark.createDataFrame([(x,) for x in lines], "v string")
    assert [tuple(r) for r in d.select(T.log_level(F.col("v")), T.log_is_agent(F.col("v"), r"(?<![\w.])tool: ")).collect()] == list(lines.values())


def test_validation(spark):
    rows = [("ok", "i", "r", None), ("  ", "i", "r", None), ("a\0", "i", "r", None), ("é" * 513, "i", "r", None), (" . ", "i", "r", None), ("ok", "", "r", None), ("ok", "i", "r", "\u00a0..\n"), ("ok", "i", "", ".x")]
    d = spark.createDataFrame(rows, "service_name string, instance_id string, run_id string, service_namespace string")
    got = [r[0] for r in d.select(V.invalid_resource(["service_name", "instance_id", "run_id", "service_namespace"])).collect()]
    assert got == [None, "service_name is empty", "service_name holds NUL", "service_name is longer than 1024 bytes", "service_name is a dot name", "instance_id is empty", "service_namespace is a dot name", "run_id is empty"]


def test_rejections_decide_nothing(spark):
    rows = [(1, "i", "r0", "1", True), (2, "i", "r1", "1", False), (3, "i", "r0", "1", False), (4, "j", "r9", "", False), (5, "k", "r", "2", False), (6, "j", "r9", "1", False)]
    d = spark.createDataFrame(rows, "arrival_seq int, instance_id string, run_id string, agent_version string, fields_stripped boolean")
    got = lambda **k: {r.arrival_seq: r.reason for r in V.rejections(d, "1", **k).collect()}
    assert got() == {1: "STRIPPED", 3: "SECOND_RUN", 5: "AGENT_VERSION"}
    assert got(one_jvm=True) == {1: "STRIPPED", 3: "SECOND_RUN", 4: "SECOND_INSTANCE", 5: "AGENT_VERSION", 6: "SECOND_INSTANCE"}
    with pytest.raises(V.Rejected, match="i: STRIPPED"):
        V.unpoisoned(d, V.rejections(d, "1"))
    assert V.unpoisoned(d, V.rejections(d, "1").limit(0)).count() == 6


def test_warm_up_looks_at_neighbours(spark):
    def verdicts(series, drift=0.1, cap=9):
        d = spark.createDataFrame([("r", k, float(x)) for k, x in enumerate(series)], "run string, slice int, throughput double")
        return [r.verdict for r in B.warm_up(d, ["run"], drift, 1, 3, cap).orderBy("slice").collect()]

    assert verdicts([100, 109, 118]) == ["CONTINUE", "CONTINUE", "STEADY"]
    assert verdicts([0, 0, 0, 5]) == ["CONTINUE"] * 4 and verdicts([100, 110, 121, 134]) == ["CONTINUE", "CONTINUE", "STEADY", "CONTINUE"]
    assert verdicts([1, 2, 4, 4, 4], cap=4) == ["CONTINUE", "CONTINUE", "CONTINUE", "CAPPED", "STEADY"]


def test_statistics(spark):
    d = spark.createDataFrame([(-0.01, 5.0), (0.04, 2.5), (-1.0, 0.125), (12.34, 1e16)], "a double, b double")
    assert [tuple(r) for r in d.select(B.signed_percent(F.col("a")), B.number_text(F.col("b"))).collect()] == [("0.0%", "5.0"), ("0.0%", "2.5"), ("-1.0%", "0.125"), ("+12.3%", "10000000000000000")]
    x = spark.createDataFrame([("CLOSED", 1.7, 2, None), ("CLOSED", 1.8, 2, None), ("OPEN", 1.6, 2, 0), ("OPEN", 1.5, 2, 4), ("OPEN", 1.5, 2, None)], "load string, cpu double, cores int, dropped int")
    assert [r[0] for r in x.select(B.load_problem(F.col("load"), F.col("cpu"), F.col("cores"), F.col("dropped"))).collect()] == ["NOT_SATURATED", None, "NO_HEADROOM", "DROPPED", None]
    w = spark.createDataFrame([("CLOSED", 100.0, 120.0), ("OPEN", 12.0, 10.0), ("CLOSED", 0.0, 5.0), ("OPEN", 5.0, 0.0), ("CLOSED", None, 5.0)], "load string, a double, b double")
    assert [tuple(r[0]) for r in w.select(B.warmth(F.col("load"), F.col("a"), F.col("b"))).collect()] == [(1.2, None), (1.2, None), (None, "NOTHING_SERVED"), (None, "NOTHING_SERVED"), (None, "NO_FIRST_THIRD")]
    a = spark.createDataFrame([("r", 1, 1, ["NOT_SATURATED"]), ("r", 2, 1, ["NOT_SATURATED"]), ("s", 1, 2, ["NOT_SATURATED"]), ("t", 1, 1, ["NOT_SATURATED", "NO_PROBE"]), ("u", 1, 1, [])], "run string, repeat int, attempt int, problems array<string>")
    assert [(r.run, r.repeat) for r in B.retries(a, ["run"], ["repeat"]).collect()] == [("r", 1)]


def test_tolerance_counts_whole_flushes_for_kills(spark):
    traffic = spark.createDataFrame([("a", "/x", 100, 3, 2, 0.5, 60), ("b", "/x", 10, 0, 0, 0.0, 60)], "instance string, route string, ok long, non2xx long, errors long, rate_per_s double, flush_s int")
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "instance string")
    got = H.count_tolerance(traffic, names("a", "a"), names("a"), names().limit(0)).first()
    # a: 31 + 2 * 2 + 31 + 5, b without a recorded start: 1 + 2
    assert (got.ok, got.sent, got.tolerance) == (110, 115, 74)
    totals = spark.createDataFrame([("/x", 189)], "route string, total long")
    now = H.count_tolerance(traffic, names("a", "a"), names("a"), names().limit(0))
    assert H.count_verdict(now, now, totals).first().holds and not H.count_verdict(now, now, totals.limit(0)).first().holds
    assert not H.count_verdict(now, now, totals.withColumn("total", F.lit(190))).first().holds


def test_run_ends(spark):
    runs = [("a", "graceful", 0.0, 500.0, True), ("b", "graceful", 0.0, 100.0, True), ("c", "kill9", 0.0, 500.0, True), ("d", "crash", 0.0, 5.0, False), ("e", "graceful", 0.0, 995.0, True), ("f", "kill9", 480.0, 500.0, True), ("g", "kill9", 0.0, 500.0, True),
            ("h", None, 0.0, 500.0, True), ("i", "graceful-timeout", 0.0, 5.0, True), ("j", "graceful", 0.0, None, True), ("k", "graceful", 0.0, 500.0, True), ("l", "graceful", 0.0, 500.0, False)]
    r = spark.createDataFrame(runs, "instance_id string, how string, started double, ended double, asserted boolean")
    listed = spark.createDataFrame([("a", True), ("c", True), ("g", False), ("k", None), ("e", True)], "instance_id string, ended_cleanly boolean")
    got = {x.instance_id: x.verdict for x in H.run_end(r, listed, spark.createDataFrame([(90.0, 95.0)], "t0 double, t1 double"), 1000.0, 10.0).collect()}
    assert got == {"a": "GOOD", "b": "SKIP_OUTAGE", "c": "FAULT_CLEAN", "d": "FAULT_CRASHED", "e": "SKIP_TOO_RECENT", "f": "FAULT_NOT_LISTED", "g": "GOOD", "h": "SKIP_OTHER_END", "i": "FAULT_KILLED_ON_TIMEOUT", "k": "FAULT_NOT_CLEAN", "l": "SKIP_UNASSERTED"}


def test_findings_are_sets(spark):
    f = lambda *x: spark.createDataFrame([(k,) for k in x], "key string")
    assert H.finding_diff(f("x", "x"), f("x")).count() == 0
    assert sorted(map(tuple, H.finding_diff(f("x", "y"), f("x", "z", "z")).collect())) == [("y", "WENT_AWAY"), ("z", "APPEARED")]


def test_nearest_declaration_takes_the_superclass(spark):
    up = spark.createDataFrame([("T", "Zsuper", 0), ("T", "Aface", 1), ("Aface", "Deep", 0), ("Zsuper", "Deeper", 0)], "child string, parent string, ord int")
    has = lambda *x: spark.createDataFrame([(t, "m") for t in x], "type string, method string")
    got = lambda *x: [r.declared_in for r in C.declaring_type(has("T"), up, has(*x)).collect()]
    assert got("Zsuper", "Aface") == ["Zsuper"] and got("T", "Zsuper") == ["T"] and got("Deep", "Deeper") == ["Deeper"] and got("Deep", "Aface") == ["Aface"] and got("X") == []
    ring = spark.createDataFrame([("T", "U", 0), ("U", "T", 0)], "child string, parent string, ord int")
    assert C.declaring_type(has("T"), ring, has("X")).count() == 0


def test_only_jobs_on_this_machine_make_their_own_folder(spark):
    assert spark.sparkContext.master.startswith("local[")


def test_salted_controls_are_the_same(spark):
    r = random.Random(5)
    p = spark.createDataFrame([(f"a{i % 3}", i, float(r.randrange(1000))) for i in range(200)], "app string, id int, started double")
    c = spark.createDataFrame([(f"a{i % 3}", i, float(r.randrange(1000))) for i in range(20)], "app string, id int, started double")
    one, four = (sorted(map(tuple, H.nearest_control(p, c, salt=n).collect())) for n in (1, 4))
    assert one == four and len(one) == 200


def test_ranks_do_not_need_one_task(spark):
    r = random.Random(6)
    rows = [(f"i{r.randrange(40)}", r.randrange(10_000)) for _ in range(300)]
    first = {}
    for i, a in rows:
        first[i] = min(first.get(i, a), a)
    order = sorted(set(first.values()))
    got = {x.instance_id: x["rank"] for x in M.arrival_rank(spark.createDataFrame(rows, "instance_id string, arrival_seq int")).collect()}
    assert got == {i: order.index(a) for i, a in first.items()}


def test_ranks_hold_for_many_instances(spark):
    n = 50_000  # more than the sample that sets the bounds of the ranges
    rows = spark.range(n).select(F.col("id").cast("string").alias("instance_id"), F.when(F.col("id") > 0, F.col("id") * 7919 % 1_000_003).alias("arrival_seq"))
    order = [i for _, i in sorted((i * 7919 % 1_000_003, i) for i in range(1, n))] + [0]  # an instance without one comes last
    got = {int(x.instance_id): x["rank"] for x in M.arrival_rank(rows).collect()}
    assert got == {i: k for k, i in enumerate(order)}


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ts,instance,pid,generation,rss_kb,heap_used_kb\n2024-01-01T00:00:00Z,a,1,0,5,\n2024-01-01T00:00:00Z,a,x,0,5,6\n")
    assert [r.rss_kb for r in R.memory_samples(spark, str(tmp_path / "m.csv")).collect()] == [5]
    lines = spark.createDataFrame([("# HELP x",), ('x_total{a="b",c="d \\" e"} 3.5',), ("y 7",), ("broken",), ("p 1 2",), ("cpu  1 2 3 4 5 6 7 8 9",)], "value string")
    assert [(r.name, r.labels, r.value) for r in R.prometheus(lines).where("name in ('x_total', 'y')").collect()] == [("x_total", {"a": "b", "c": 'd \\" e'}, 3.5), ("y", {}, 7.0)]
    assert [tuple(r) for r in R.counts(lines).collect()] == [("p", 1, 2)] and R.steal_ticks(lines).first()[0] == 8
    assert lines.select(R.cpu_set(F.lit("0-2,5"))).first()[0] == [0, 1, 2, 5]
    assert R.json_or_default(spark, str(tmp_path / "none.json"), "a int", [(3,)]).first().a == 3
    inner = bytes([0x08, 5, 0x10, 2, 0x28, 0xAC, 0x02])
    payload = spark.createDataFrame([("i", "r", 1, bytearray(bytes([0x12, len(inner)]) + inner))], "instance_id string, run_id string, arrival_seq long, payload binary")
    got = R.decode_deltas(payload, 2, {"class_id": 1, "probe_index": 2, "kind": 3, "first_seen_at": 4, "hits_total": 5}).first()
    assert (got.class_id, got.probe_index, got.hits_total, got.kind) == (5, 2, 300, 0)


def test_streaming_equals_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = [("i-%d" % rnd.randrange(3), "r", "p%d" % rnd.randrange(5), n, rnd.randrange(90)) for n in range(300)]
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 130], I.DELTA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, want = str(tmp_path / "out"), spark.createDataFrame(rows, I.DELTA).groupBy("instance_id", "run_id", "probe").agg(F.max("hits_total"))
    state = I.total_state(I.delta_stream(spark, str(tmp_path / "in"), files=1), ["probe"])
    I.upsert(state, out, str(tmp_path / "cp"), ["instance_id", "run_id", "probe"]).awaitTermination()
    got = I.latest(spark, out, ["instance_id", "run_id", "probe"])
    assert sorted(map(tuple, got.select("instance_id", "run_id", "probe", "hits").collect())) == sorted(map(tuple, want.collect()))
    assert I.settled(got, "hits > 50")


def test_harness(spark):
    s = spark.createDataFrame([("a", float(t), 2.0 * t, t) for t in range(0, 3600, 300)], "instance string, at double, rss double, event_id long")
    m = H.memory_trend(s, ["instance"]).first()
    assert (round(m.slope, 6), m["first"], m["last"]) == (2.0, 3600.0, 6600.0)
    assert H.memory_trend(s.where("at <= 1800"), ["instance"]).first().slope == 0.0
    lines = [r.line for r in H.capped(spark.range(5).selectExpr("cast(id as string) as k"), ["k"], 3).collect()]
    assert lines == ["0", "1", "2", "... and 2 more"]
