"""Payloads in, answers out: the rules of ingest and the gates, on hand-made payloads."""

import random

import pytest
from pyspark.sql import functions as F

from usagelens.collector import TABLES, Collector, Unknown
from usagelens.operators import ingest as I
from usagelens.operators.gates import NotEvidence
from usagelens.operators.validation import Rejected

NOW = 1_000_000


def columns(schema):
    depth, out, word = 0, [], ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out


class Payloads:
    """Rows of payload tables; columns that a test doesn't name are null or a plain default."""

    PLAIN = {"inline": False, "generated_ord": 0, "unread_ord": 0, "routine_ord": 0, "static": False, "lambda_body": False, "overridable": False, "line": 1, "virtual": False, "edge_kind": "CALL", "method_descriptor": "()V", "descriptor": "()V", "kind": "METHOD", "referenced_classes": [], "absent": False}
    HEAD = {"run_id": "r", "heard_at": NOW - 1000, "agent_version": "1", "fields_stripped": False, "flush_interval_seconds": 60, "starting": False, "counts_pending_since": 0, "flush_complete": False, "final_flush": False, "references_recorded": True, "dependencies_listed": True, "verifier_rejections_watched": True, "unplaced_verification_failures": 0}

    def __init__(self):
        self.rows = {n: [] for n in TABLES}
        self.n = 0

    def add(self, kind, instance, seq=None, head=None, **parts):
        self.n += 1
        pid = f"p{self.n}"
        self.rows["payloads"].append(self.HEAD | {"payload_id": pid, "kind": kind, "instance_id": instance, "arrival_seq": self.n, "payload_sequence": self.n if seq is None else seq} | (head or {}))
        for table, rows in parts.items():
            self.rows[table] += [{"payload_id": pid, "pos": i} | r for i, r in enumerate(rows)]
        return self

    def tables(self, spark):
        out = {}
        for n, rows in self.rows.items():
            names = columns(TABLES[n])
            plain = {} if n in ("payloads", "disabled_modules", "declared_classes") else self.PLAIN
            out[n] = spark.createDataFrame([tuple((plain | r).get(c) for c in names) for r in rows], TABLES[n])
        return out

    def collector(self, spark, now=NOW, **k):
        return Collector(spark, self.tables(spark), now, **k)


def probe(cls, name, index, class_id=1, **k):
    return {"class_id": class_id, "probe_index": index, "class_name": cls, "method_name": name} | k


FOO = [probe("Foo", "<init>", 0), probe("Foo", "ran", 1), probe("Foo", "idle", 2, line=7)]


def delta(index, total, class_id=1):
    return {"class_id": class_id, "probe_index": index, "hits_total": total}


def simple():
    return Payloads().add("MANIFEST", "i-1", probes=FOO).add("DELTAS", "i-1", probe_deltas=[delta(0, 1), delta(1, 5)], head={"flush_complete": True}).add("MANIFEST", "i-2", probes=FOO).add("DELTAS", "i-2", probe_deltas=[delta(1, 2)])


def names(df, *c):
    return [tuple(r[x] for x in c) if len(c) > 1 else r[c[0]] for r in df.collect()]


def test_counts_and_unknown_names(spark):
    p = simple().add("DELTAS", "i-1", probe_deltas=[delta(1, 3)])  # late: totals never fall
    p.add("MANIFEST", "i-1", skipped_classes=[{"class_name": "Bad", "reason": "too large"}], unreported_classes=[{"class_name": "Odd"}])
    c = p.collector(spark)
    assert c.hit_count("Foo", "ran") == 7 and c.was_hit("Foo", "ran") and not c.was_hit("Foo", "idle")
    assert names(c.never_hit(), "class_name", "method_name", "line") == [("Foo", "idle", 7)]
    for cls, method, why in (("Foo", "no", "NO_SUCH_METHOD"), ("Bad", "m", "SKIPPED"), ("Odd", "m", "UNREPORTED"), ("Nowhere", "m", "NEVER_MENTIONED")):
        with pytest.raises(Unknown, match=why):
            c.hit_count(cls, method)
    assert names(c.skipped_classes(), "class_name", "reason") == [("Bad", "too large")] and names(c.unreported_classes(), "class_name") == ["Odd"]
    assert c.agent_version("i-1") == "1" and not c.ended_cleanly("i-1")


def test_gates_hold_answers_back(spark):
    quiet = simple().add("MANIFEST", "i-3", probes=FOO)
    with pytest.raises(NotEvidence, match="i-3: NO_DELTA"):
        quiet.collector(spark).never_hit()
    starting = simple().add("DELTAS", "i-2", head={"starting": True}).add("DELTAS", "i-2", seq=0)  # sequence 0 changes no flag
    with pytest.raises(NotEvidence, match="i-2: STARTING"):
        starting.collector(spark).never_hit()
    assert names(starting.collector(spark, now=NOW + 10_000_000).never_hit(), "method_name") == ["idle"]  # silent for long: not live any more
    over = simple().add("DELTAS", "i-2", seq=9, head={"starting": True}).add("DELTAS", "i-2", seq=10).add("DELTAS", "i-2", seq=3, head={"starting": True})
    assert names(over.collector(spark).never_hit(), "method_name") == ["idle"]
    with pytest.raises(NotEvidence, match="UNPLACED"):
        simple().add("MANIFEST", "i-1", head={"unplaced_verification_failures": 2}).collector(spark).never_initialized()
    with pytest.raises(NotEvidence, match="no complete scan"):
        simple().collector(spark).never_loaded()


def test_a_rejection_poisons_every_answer(spark):
    c = simple().add("DELTAS", "i-1", head={"run_id": "other"}).collector(spark)
    assert names(c.rejected_payloads(), "instance_id", "reason") == [("i-1", "SECOND_RUN")]
    with pytest.raises(Rejected):
        c.hit_count("Foo", "ran")
    with pytest.raises(Rejected):
        c.never_supplied()


def test_merge_policies(spark):
    a = [probe("Foo", "old", 0), probe("Foo", "x", 1)]
    p = Payloads().add("MANIFEST", "i-1", probes=a, class_locations=[{"class_id": 1, "super_class_name": "A", "interface_names": ["I"], "kotlin_kind": "CLASS"}, {"class_id": 9, "super_class_name": "Z"}], disabled_modules=[{"module": "web", "reason": "first", "kind": "FAILED"}],
                       external_classes=[{"class_name": "x.X", "dependency_id": 1}], skipped_classes=[{"class_name": "S", "reason": "one"}])
    p.add("MANIFEST", "i-2", probes=[probe("Foo", "x", 1)], disabled_modules=[{"module": "web", "reason": "newer", "kind": "CONFIGURED_OFF"}], skipped_classes=[{"class_name": "S", "reason": "two"}])
    p.add("MANIFEST", "i-1", probes=[probe("Foo", "new", 0)], class_locations=[{"class_id": 1, "super_class_name": "B", "kotlin_kind": "FILE"}], disabled_modules=[{"module": "web", "reason": "third", "kind": "OTHER"}], external_classes=[{"class_name": "x.X", "dependency_id": 2}])
    # a class location without a probe of its class in the same payload says nothing
    p.add("MANIFEST", "i-2", class_locations=[{"class_id": 1, "super_class_name": "C", "kotlin_kind": "NONE"}])
    p.add("DELTAS", "i-1").add("DELTAS", "i-2")
    c = p.collector(spark)
    assert sorted(names(c.probes(), "instance_id", "probe_index", "method_name")) == [("i-1", 0, "new"), ("i-1", 1, "x"), ("i-2", 1, "x")]
    assert names(c._types(), "instance_id", "class_name", "super_class_name") == [("i-1", "Foo", "B")] and c.kotlin_kind("Foo") == "FILE"
    assert names(c.disabled_endpoint_modules(), "module", "reason") == [("web", "newer")]
    assert sorted(names(I.disabled_modules(p.tables(spark)["disabled_modules"], c.payloads)[0], "instance_id", "kind")) == [("i-1", "FAILED"), ("i-2", "CONFIGURED_OFF")]
    assert names(c._externals(), "class_name", "dependency_id") == [("x.X", 1)]
    assert names(c.skipped_classes(), "class_name", "reason") == [("S", "one")]


def test_order_and_repeats_of_payload_rows_change_nothing(spark):
    p = simple().add("DELTAS", "i-1", probe_deltas=[delta(2, 1)]).add("MANIFEST", "i-2", probes=[probe("Foo", "idle", 2, line=9)])
    rnd, tables = random.Random(1), p.tables(spark)
    shuffled = {n: spark.createDataFrame(rnd.sample(t.collect() * 2, 2 * t.count()), t.schema) if n == "probe_deltas" else t.orderBy(F.rand(3)) for n, t in tables.items()}
    one, two = Collector(spark, tables, NOW), Collector(spark, shuffled, NOW)
    key = lambda c: sorted(map(str, c.merged().collect()))
    assert key(one) == key(two) and one.hit_count("Foo", "idle") == two.hit_count("Foo", "idle") == 1


def test_optional_parameters_endpoints_and_clusters(spark):
    rows = [*FOO, probe("Foo", "ran", 3, kind="OPTIONAL_ARGUMENT", parameter_index=0, parameter_name="limit"), probe("Foo", "helper", 4)]
    p = Payloads().add("MANIFEST", "i-1", probes=rows, calls=[{"class_id": 1, "probe_index": 2, "owner": "Foo", "name": "helper"}],
                       endpoints=[{"endpoint_id": 1, "verb": "GET", "route": "/a/{x}", "template_kind": "PATH", "framework": "web", "discovery_source": "SCAN"}, {"endpoint_id": 2, "verb": "POST", "route": "/b", "template_kind": "PATH", "framework": "web", "discovery_source": "SCAN"}])
    p.add("DELTAS", "i-1", probe_deltas=[delta(0, 1), delta(1, 5), delta(3, 5)], endpoint_deltas=[{"endpoint_id": 1, "hits_total": 4}])
    c = p.collector(spark)
    assert c.omission_count("Foo", "ran", 0) == c.omission_count("Foo", "ran", "limit") == 5
    assert names(c.never_supplied(), "method_name", "parameter_name") == [("ran", "limit")] and names(c.always_supplied(), "method_name") == []
    assert c.call_count("get", "/a/{x:[0-9]+}/") == 4 and c.was_called("GET", "a/{x}")
    with pytest.raises(Unknown, match="never mentioned"):
        c.call_count("GET", "/none")
    assert names(c.never_called(), "verb", "route") == [("POST", "/b")] and names(c.endpoints(), "verb") == ["GET", "POST"]
    assert sorted(names(c.unreached_clusters(), "root", "kind", "member")) == [("MFoo#idle ()V", "UNCALLED", "Foo#helper ()V"), ("MFoo#idle ()V", "UNCALLED", "Foo#idle ()V")]
    assert names(c.call_edges("Foo", "idle"), "owner", "name") == [("Foo", "helper")]
    with pytest.raises(Unknown):
        c.call_edges("Foo", "nothing")


def test_dependencies_and_scans(spark):
    ids = lambda *a: [{"group_id": "g", "artifact_id": x, "version": "1"} for x in a]
    jars = [{"dependency_id": 1, "identities": ids("used"), "discovery_source": "LOADED", "class_count": 5}, {"dependency_id": 2, "identities": ids("idle", "shaded"), "discovery_source": "STARTUP_CLASSPATH", "class_count": 5},
            {"dependency_id": 3, "identities": ids("shaded"), "discovery_source": "LOADED", "class_count": 9}]
    externals = [{"class_name": "u.U", "dependency_id": 1}, {"class_name": "s.S", "dependency_id": 3}, {"class_name": "gone.G", "absent": True}]
    rows = [probe("Foo", "<init>", 0), probe("Foo", "ran", 1, referenced_classes=["u.U"]), probe("Foo", "idle", 2, referenced_classes=["s.S", "gone.G"])]
    p = Payloads().add("MANIFEST", "i-1", probes=rows, dependencies=jars, external_classes=externals)
    p.add("DELTAS", "i-1", probe_deltas=[delta(0, 1), delta(1, 1)], dependency_deltas=[{"dependency_id": 1, "loaded_classes_total": 2}, {"dependency_id": 3, "loaded_classes_total": 1}])
    scan = lambda k, of, *m: {"chunks": [{"scanned_at": 5, "chunk_index": k, "chunk_count": of}], "declared_methods": [{"class_name": c, "method_name": n} for c, n in m], "declared_classes": [{"class_name": c, "interface_names": [], "kind": "CLASS", "referenced_classes": []} for c, _ in m]}
    p.add("BASELINE", "i-1", **scan(0, 2, ("Foo", "ran"), ("Cold", "m")))
    c = p.collector(spark)
    with pytest.raises(NotEvidence, match="no complete scan"):
        c.never_loaded()
    assert c.dependency("g", "used").first().status == "USED"
    with pytest.raises(LookupError, match="never listed"):
        c.dependency("g", "none")
    p.add("BASELINE", "i-1", **scan(1, 2, ("Frozen", "m"))).add("BASELINE", "i-1", **scan(1, 2, ("Again", "m")))
    c = p.collector(spark)
    assert names(c.never_loaded(), "class_name") == ["Cold", "Frozen"]  # a repeated chunk's classes are ignored
    shaded = c.dependency("g", "shaded").first()  # two jars carry it; one has it alone
    assert (shaded.identity_key, shaded.status, shaded.sites) == ("g:shaded", "UNREACHED", ["Foo#idle"])
    assert [(r.identity_key, r.versions) for r in c.unloaded_dependencies().collect()] == [("g:idle,g:shaded", ["g:idle:1", "g:shaded:1"])]
    assert names(c.unreached_dependencies(), "identity_key") == ["g:shaded"] and names(c.unreferenced_dependencies(), "identity_key") == []
    assert names(c.absent_references(), "referenced_class", "sites") == [("gone.G", ["Foo#idle"])]
    with pytest.raises(NotEvidence, match="i-2: NOT_LISTED"):
        p.add("DELTAS", "i-2", head={"dependencies_listed": False}).collector(spark).unloaded_dependencies()


def test_listings_are_whole_or_absent(spark):
    p = simple().add("LISTING", "i-1").add("LISTING", "i-1")
    rows = spark.createDataFrame([("p5", 7, 0, 2, ["A", "B"]), ("p6", 7, 1, 2, ["C"])], "payload_id string, listed_at long, chunk_index int, chunk_count int, class_names array<string>")
    good = p.collector(spark).payloads
    assert sorted(names(I.listings(rows, good), "class_name")) == ["A", "B", "C"] and I.listings(rows.where("chunk_index = 0"), good).count() == 0


def test_settling(spark):
    c = simple().add("DELTAS", "i-2", head={"flush_complete": True, "final_flush": True}).collector(spark)
    assert names(c.not_settled(), "instance_id", "reason") == [("i-1", "TOO_FEW_FLUSHES")]
    more = simple().add("DELTAS", "i-1", seq=0, head={"flush_complete": True}).add("DELTAS", "i-2", head={"flush_complete": True, "final_flush": True}).collector(spark)
    assert names(more.not_settled(), "instance_id") == [] and more.ended_cleanly("i-2")
