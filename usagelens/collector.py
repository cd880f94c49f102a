"""The judging collector: payload tables in, answers out, each behind its evidence gate (Q1-Q29, sections 2.9 and 2.10).

Every answer fails with ``Rejected`` once any payload was rejected, and with ``NotEvidence`` while the instances' reports don't carry it; an empty
result would read as a finding. Unknown names raise ``Unknown`` with a reason. Tables that a caller doesn't give are empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import identity_key, normalize_route, normalize_verb
from .operators import callgraph as K
from .operators import closure as C
from .operators import dependencies as D
from .operators import endpoints as E
from .operators import findings as Q
from .operators import gates as G
from .operators import ingest as I
from .operators import merge as M
from .operators import scans as S
from .operators import validation as V

FLAGS = "inline boolean, generated_ord int, unread_ord int, static boolean, lambda_body boolean"
IDENTITIES = "identities array<struct<group_id:string,artifact_id:string,version:string>>"
TARGET = "owner string, name string, descriptor string, virtual boolean, edge_kind string"
METHOD = "class_name string, method_name string, method_descriptor string"
#: The payload tables and their columns; a payload's head is in ``payloads``. generated, unread and routine kinds come as their ordinals.
TABLES = {
    "payloads": "payload_id string, kind string, instance_id string, run_id string, arrival_seq long, heard_at long, agent_version string, fields_stripped boolean, flush_interval_seconds int, payload_sequence long, starting boolean, "
    "counts_pending_since long, flush_complete boolean, final_flush boolean, references_recorded boolean, dependencies_listed boolean, verifier_rejections_watched boolean, unplaced_verification_failures long",
    "probe_deltas": "payload_id string, class_id int, probe_index int, hits_total long",
    "endpoint_deltas": "payload_id string, endpoint_id int, hits_total long",
    "dependency_deltas": "payload_id string, dependency_id int, loaded_classes_total long",
    "probes": f"payload_id string, pos int, class_id int, probe_index int, kind string, {METHOD}, line int, branch_index int, branch_key string, parameter_index int, parameter_name string, overridable boolean, target_class_name string, inlined_from string, outside string, {FLAGS}, referenced_classes array<string>",
    # a row per outcome of a site of a method's probe
    "sites": "payload_id string, class_id int, probe_index int, branch_index int, guard int, routine_ord int, unread_ord int",
    "calls": f"payload_id string, class_id int, probe_index int, {TARGET}, guard int",
    "class_locations": "payload_id string, pos int, class_id int, super_class_name string, interface_names array<string>, kotlin_kind string",
    "skipped_classes": "payload_id string, pos int, class_name string, reason string",
    "unreported_classes": "payload_id string, pos int, class_name string",
    "failed_classes": "payload_id string, class_name string",
    "classes_failed_to_initialize": "payload_id string, class_name string, reason string",
    "endpoints": "payload_id string, pos int, endpoint_id int, verb string, route string, template_kind string, verbatim_template string, framework string, discovery_source string, handler_class string, handler_method string, handler_descriptor string",
    "disabled_modules": "payload_id string, pos int, module string, reason string, kind string",
    "dependencies": f"payload_id string, pos int, dependency_id int, {IDENTITIES}, discovery_source string, class_count int, location string",
    "class_references": "payload_id string, pos int, class_id int, referenced_classes array<string>",
    "external_classes": "payload_id string, pos int, class_name string, dependency_id int, absent boolean",
    "chunks": "payload_id string, scanned_at long, chunk_index int, chunk_count int",
    "declared_classes": "payload_id string, class_name string, super_class_name string, interface_names array<string>, kind string, referenced_classes array<string>",
    "declared_methods": f"payload_id string, {METHOD}, {FLAGS}, referenced_classes array<string>",
    "declared_calls": f"payload_id string, {METHOD}, {TARGET}",
}
RESTING_ON_ZERO = {"UNREACHED", "NO_LIVE_REFERENCE", "FAILED_TO_LOAD", "FAILED_TO_INITIALIZE"}


class Unknown(LookupError):
    """No accepted payload declared what was asked for."""


class Collector:
    """Answers over payload tables as of ``now`` (millis). Derived tables are written once and read by every answer."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], now: int, agent_version: str = "", one_jvm: bool = False):
        self.spark, self.now = spark, now
        self._in = {n: tables[n] if n in tables else spark.createDataFrame([], schema) for n, schema in TABLES.items()}
        self._kept: dict[str, DataFrame] = {}
        good, bad = I.accepted(self._in["payloads"], agent_version, one_jvm)
        self.payloads, self._rejected = C.checkpointing(good), C.checkpointing(bad)

    def _keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = C.checkpointing(build())
        return self._kept[name]

    def _carried(self, table: str) -> DataFrame:
        return I.carried(self._in[table], self.payloads)

    # --- state ----------------------------------------------------------------------------------------------------------

    def instances(self) -> DataFrame:
        return self._keep("instances", lambda: I.instance_state(self.payloads))

    def probes(self) -> DataFrame:
        return self._keep("probes", lambda: I.probes(self._in["probes"].withColumn("source", F.col("payload_id")), self.payloads).withColumn("routine_ord", F.lit(0)))

    def _hits(self) -> DataFrame:
        return self._keep("hits", lambda: self._carried("probe_deltas"))

    def _of_probes(self, table: str) -> DataFrame:
        """Rows that belong to probes, of those payloads that reported the probes last, with the method they are in."""
        own = self.probes().select(F.col("source").alias("payload_id"), "class_id", "probe_index", "instance_id", "rank", *M.METHOD)
        return self._in[table].join(own, ["payload_id", "class_id", "probe_index"])

    def _sites(self) -> DataFrame:
        return self._keep("sites", lambda: self._of_probes("sites"))

    def merged(self) -> DataFrame:
        return self._keep("merged", lambda: M.merged_locations(self.probes(), self._hits(), self._sites()))

    def _with_hits(self) -> DataFrame:
        return self._keep("with_hits", lambda: M.probe_hits(self.probes(), self._hits()))

    def _known(self) -> DataFrame:
        return self._keep("known", lambda: I.known_classes(self._in["probes"], self._in["skipped_classes"], self._in["unreported_classes"], self.payloads))

    def _names(self) -> DataFrame:
        return self._known().select("class_name").distinct()

    def _types(self) -> DataFrame:
        return self._keep("types", lambda: I.supertypes(self._in["class_locations"], self._in["probes"], self.payloads))

    def _chunks(self) -> DataFrame:
        return self._keep("chunks", lambda: I.scans(self._in["chunks"], self._in["declared_classes"], self.payloads)[0])

    def _declared(self, table: str, evidencing: bool) -> DataFrame:
        """Declared rows of the latest complete scans; evidencing: of instances whose scans give evidence."""
        name = f"{table}-{evidencing}"

        def build():
            rows = I.scans(self._in["chunks"], self._in[table], self.payloads)[1]
            last = S.latest_scans(S.complete_scans(self._chunks()))
            if evidencing:
                last = last.join(G.scan_evidence(self.instances(), self.now), "instance_id", "left_semi")
            return rows.join(last, ["instance_id", "scanned_at"], "left_semi")

        return self._keep(name, build)

    def _skipped(self) -> DataFrame:
        return self._carried("skipped_classes")

    def _failed_reasons(self) -> DataFrame:
        return I.verifier_facts(self._in["classes_failed_to_initialize"], self.payloads)[0]

    def _failed_to_initialize(self) -> DataFrame:
        def build():
            methods = self.probes().where("kind = 'METHOD' and not static").where(~F.col("method_name").isin(Q.INIT, Q.CLINIT)).select("instance_id", "class_name").distinct()
            up = I.supertype_edges(self._types(), ["instance_id"])
            return Q.failed_to_initialize(self._failed_reasons(), up, methods, Q.initialized_classes(self._with_hits()), self._names())

        return self._keep("failed_to_initialize", build)

    def _failed_to_load(self) -> DataFrame:
        return self._keep("failed_to_load", lambda: S.failed_to_load(self._carried("failed_classes"), self._names()))

    def _gaps(self) -> DataFrame:
        return self._keep("gaps", lambda: M.withheld_classes(self._failed_to_initialize(), Q.initializers_running(self._with_hits())))

    def _withheld(self) -> DataFrame:
        return self._keep("withheld", lambda: M.withheld_classes(self._gaps(), self._skipped()))

    def _findings(self) -> DataFrame:
        return self._keep("findings", lambda: Q.class_findings(self.merged(), self._withheld()))

    def _covered(self) -> DataFrame:
        return self._keep("covered", lambda: Q.covered_methods(self.merged(), self._findings()))

    def _edges(self) -> DataFrame:
        """Edges of manifests and baselines; a guard is given as the outcome it means in its own instance."""

        def build():
            own = self._of_probes("calls")
            ids = self.probes().where("kind = 'BRANCH' and branch_index is not null").select("instance_id", *M.METHOD, F.col("branch_index").alias("guard"), M.outcome_id().alias("outcome")).distinct()
            own = own.join(ids, ["instance_id", *M.METHOD, "guard"], "left").drop("guard").withColumnRenamed("outcome", "guard")
            cols = [*M.METHOD, "owner", "name", "descriptor", "virtual", "edge_kind", "guard"]
            return own.select(*cols).unionByName(self._declared("declared_calls", False).withColumn("guard", F.lit(None).cast("string")).select(*cols)).distinct()

        return self._keep("edges", build)

    def _folded(self) -> DataFrame:
        def build():
            made = self._edges().where("edge_kind = 'CREATES'").select(*M.METHOD, F.col("owner").alias("c_class"), F.col("name").alias("c_name"), F.col("descriptor").alias("c_desc"))
            return Q.folded_lambdas(self.merged(), made, self._findings(), self._covered(), self._withheld())

        return self._keep("folded", build)

    def _all_covered(self) -> DataFrame:
        """Methods that class findings stand for, lambda bodies among them."""
        return self._covered().unionByName(self._folded().where("into_class").select(*M.METHOD)).distinct()

    # --- gates ----------------------------------------------------------------------------------------------------------

    def _checked(self, answer: DataFrame) -> DataFrame:
        return V.unpoisoned(answer, self._rejected)

    def _zero(self) -> None:
        G.checked(self._rejected, G.zero_holds(self.instances(), self.now))

    def _live(self) -> None:
        G.checked(self._rejected, G.live_holds(self.instances(), self.now))

    # --- counters -------------------------------------------------------------------------------------------------------

    def rejected_payloads(self) -> DataFrame:
        """Q27: reasons, oldest first. Never fails."""
        return self._rejected.select("arrival_seq", "instance_id", "reason").orderBy("arrival_seq")

    def why_unknown(self, class_name: str, method_name: str) -> str:
        """Q28."""
        wanted = self.spark.createDataFrame([(class_name, method_name)], "class_name string, method_name string")
        found = Q.diagnosis(wanted, self._skipped(), self._carried("unreported_classes"), self.probes().where("kind = 'METHOD'"), self._declared("declared_methods", False))
        return found.first().diagnosis

    def _method(self, class_name: str, method_name: str, descriptor: str | None) -> DataFrame:
        rows = M.find_probes(self._checked(self._with_hits()), class_name, method_name, descriptor)
        if rows.isEmpty():
            raise Unknown(f"{class_name}#{method_name}: {self.why_unknown(class_name, method_name)}")
        return rows

    def was_hit(self, class_name: str, method_name: str, descriptor: str | None = None) -> bool:
        """Q1."""
        return self.hit_count(class_name, method_name, descriptor) > 0

    def hit_count(self, class_name: str, method_name: str, descriptor: str | None = None) -> int:
        """Q1: over every overload without a descriptor."""
        return self._method(class_name, method_name, descriptor).agg(F.sum("hits")).first()[0]

    def omission_count(self, class_name: str, method_name: str, parameter: int | str, descriptor: str | None = None) -> int:
        """Q2: of an optional parameter by its index or name."""
        m = self._checked(self._with_hits()).where("kind = 'OPTIONAL_ARGUMENT'").where((F.coalesce("target_class_name", "class_name") == class_name) & (F.col("method_name") == method_name))
        m = m.where(F.col("parameter_index" if isinstance(parameter, int) else "parameter_name") == parameter)
        m = m if descriptor is None else m.where(F.col("method_descriptor") == descriptor)
        got = m.agg(F.sum("hits")).first()[0]
        if got is None:
            raise Unknown(f"{class_name}#{method_name}, parameter {parameter}: {self.why_unknown(class_name, method_name)}")
        return got

    def never_supplied(self) -> DataFrame:
        """Q3. It rests on no zero count, so no gate holds it."""
        return self._checked(Q.optional_parameters(self.merged(), never=True, skipped=self._skipped())).orderBy("class_name", "method_name", "parameter_index")

    def always_supplied(self) -> DataFrame:
        """Q4."""
        self._checked(self.merged())
        self._zero()
        return Q.optional_parameters(self.merged(), never=False, skipped=self._skipped(), gaps=self._gaps()).orderBy("class_name", "method_name", "parameter_index")

    # --- findings -------------------------------------------------------------------------------------------------------

    def _never(self, bucket: str) -> DataFrame:
        self._checked(self.merged())
        self._zero()
        folded = self._folded().select(*M.METHOD)
        rows = Q.never_hit(self.merged(), self._findings(), self._withheld(), folded.unionByName(self._covered()).distinct(), M.site_guards(self.probes(), self._sites()))
        return Q.in_never_hit_order(rows.where(F.col("bucket") == bucket)).drop("bucket")

    def never_hit(self) -> DataFrame:
        """Q6. Methods that a class finding covers and folded lambda bodies aren't listed."""
        return self._never("PLAIN")

    def never_hit_routine_outcomes(self) -> DataFrame:
        """Q7."""
        return self._never("ROUTINE")

    def never_hit_unread_shapes(self) -> DataFrame:
        """Q8."""
        return self._never("UNREAD")

    def _class_finding(self, finding: str) -> DataFrame:
        self._checked(self.merged())
        self._zero()
        loads = self._known().groupBy("class_name").agg(F.count_distinct("instance_id").alias("instances"))
        return self._findings().where(F.col("finding") == finding).select("class_name").join(loads, "class_name").orderBy("class_name")

    def never_initialized(self) -> DataFrame:
        """Q11."""
        return self._class_finding("NEVER_INITIALIZED")

    def never_instantiated(self) -> DataFrame:
        """Q12."""
        return self._class_finding("NEVER_INSTANTIATED")

    def never_loaded(self) -> DataFrame:
        """Q15: fails too while no scan is complete."""
        self._checked(self.merged())
        if S.complete_scans(self._chunks()).isEmpty():
            raise G.NotEvidence("no complete scan has been received")
        self._live()
        d = self._declared("declared_methods", True).withColumn("ordinary", F.expr("not inline and generated_ord = 0 and unread_ord = 0"))
        failed = self._carried("failed_classes").select("class_name")
        return S.never_loaded(d, d.select("instance_id", "scanned_at").distinct(), self._names(), failed).orderBy("class_name")

    def failed_to_load(self) -> DataFrame:
        """Q16."""
        return self._checked(self._failed_to_load()).orderBy("class_name")

    def failed_to_initialize(self) -> DataFrame:
        """Q17."""
        return self._checked(self._failed_to_initialize()).orderBy("class_name")

    def skipped_classes(self) -> DataFrame:
        """Q18."""
        return Q.skipped_classes(self._checked(self._skipped()))

    def unreported_classes(self) -> DataFrame:
        """Q26."""
        return self._checked(self._carried("unreported_classes")).select("class_name").distinct().orderBy("class_name")

    # --- endpoints ------------------------------------------------------------------------------------------------------

    def _endpoints(self) -> DataFrame:
        return self._keep("endpoints", lambda: I.endpoints(self._in["endpoints"], self.payloads))

    def _endpoint_hits(self) -> DataFrame:
        per = I.totals(self._in["endpoint_deltas"], self.payloads, ["endpoint_id"])
        return per.groupBy("instance_id", "endpoint_id").agg(F.sum("hits_total").alias("hits"))

    def call_count(self, verb: str, route: str) -> int:
        """Q19: calls of a path endpoint, under any spelling of verb and route."""
        row = self.spark.createDataFrame([(verb, route)], "verb string, route string").select(normalize_verb(F.col("verb")).alias("verb"), normalize_route(F.col("route")).alias("route")).first()
        own = E.identities(self._checked(self._endpoints())).where((F.col("template_kind") == "PATH") & (F.col("verb") == row.verb) & (F.col("route") == row.route))
        got = own.join(self._endpoint_hits(), ["instance_id", "endpoint_id"], "left").agg(F.count(F.lit(1)), F.coalesce(F.sum("hits"), F.lit(0))).first()
        if not got[0]:
            off = [f"{r.module}: {r.reason}" for r in self.disabled_endpoint_modules().limit(5).collect()]
            raise Unknown(f"{row.verb} {row.route}: " + (f"modules are disabled: {'; '.join(off)}" if off else "never mentioned as a path"))
        return got[1]

    def was_called(self, verb: str, route: str) -> bool:
        """Q19."""
        return self.call_count(verb, route) > 0

    def _initializer_gaps(self) -> DataFrame:
        return Q.initializer_gaps(self._with_hits(), self._failed_to_initialize(), self._failed_reasons())

    def never_called(self) -> DataFrame:
        """Q20."""
        self._checked(self.merged())
        self._zero()
        per, _ = I.disabled_modules(self._in["disabled_modules"], self.payloads)
        off = per.select(F.col("module").alias("framework"))
        status = E.endpoint_status(self._endpoints(), self._endpoint_hits(), off, self._initializer_gaps(), E.failed_before_declaring(self._endpoints(), per))
        return E.in_endpoint_order(E.never_called(status))

    def endpoints(self) -> DataFrame:
        """Q21."""
        return E.listed(self._checked(self._endpoints()).withColumnRenamed("seq", "arrival_seq"))

    def disabled_endpoint_modules(self) -> DataFrame:
        """Q21."""
        return self._checked(I.disabled_modules(self._in["disabled_modules"], self.payloads)[1])

    # --- graph ----------------------------------------------------------------------------------------------------------

    def call_edges(self, class_name: str, method_name: str) -> DataFrame:
        """Q26."""
        found = K.call_edges(self._checked(self._edges()), class_name, method_name)
        if found.isEmpty() and M.find_probes(self.probes(), class_name, method_name).isEmpty():
            named = (F.col("class_name") == class_name) & (F.col("method_name") == method_name)
            if self._declared("declared_methods", False).where(named).isEmpty():
                raise Unknown(f"{class_name}#{method_name}: {self.why_unknown(class_name, method_name)}")
        return found

    def kotlin_kind(self, class_name: str) -> str | None:
        """Q26: of the last manifest that gave one, or else of the baselines."""
        found = I.merged_supertypes(self._checked(self._types())).where(F.col("class_name") == class_name).select("kotlin_kind").first()
        if found:
            return found[0]
        row = self._merged_baseline().where(F.col("class_name") == class_name).select("kind").first()
        return row[0] if row else None

    def agent_version(self, instance_id: str) -> str | None:
        """Q26."""
        row = self._checked(self.instances()).where(F.col("instance_id") == instance_id).select("agent_version").first()
        return row[0] if row else None

    def ended_cleanly(self, instance_id: str) -> bool:
        """Q26."""
        return not self._checked(self.instances()).where((F.col("instance_id") == instance_id) & F.col("ended")).isEmpty()

    def _merged_baseline(self) -> DataFrame:
        d = self._declared("declared_classes", False)
        return S.merged_classes(d.withColumns({"method_name": F.lit(None).cast("string"), "method_descriptor": F.lit(None).cast("string")}))

    def _all_supertypes(self) -> DataFrame:
        """(child, parent, ord) by the last manifest, or by the baselines for classes that no manifest places."""
        told = I.supertype_edges(I.merged_supertypes(self._types()), [])
        rest = self._merged_baseline().withColumnRenamed("interfaces", "interface_names").join(self._types().select("class_name").distinct(), "class_name", "left_anti")
        return told.unionByName(I.supertype_edges(rest, [])).select("child", "parent", "ord")

    def unreached_clusters(self) -> DataFrame:
        """Q22: (root, kind, member)."""
        self._checked(self.merged())
        self._zero()
        m, keep = self.merged(), C.checkpointing
        ordinary = F.expr("not inline and generated_ord = 0 and unread_ord = 0")
        unseen = self._declared("declared_methods", True).join(self._names(), "class_name", "left_anti")
        declared_only = unseen.where(ordinary).select(*M.METHOD).distinct().join(m.where("kind = 'METHOD'").select(*M.METHOD), M.METHOD, "left_anti")
        if not declared_only.isEmpty():
            self._live()
        node = keep(K.nodes(m, declared_only))
        looked = self._declared("declared_methods", False).where("not inline and (generated_ord > 0 or unread_ord > 0)").select(*M.METHOD, F.lit(0).cast("long").alias("hits"))
        through = K.transparent(m)
        extra = looked.withColumn("key", K.method_key()).distinct().join(through.select("key"), "key", "left_anti").join(node.select("key"), "key", "left_anti").select(*through.columns)
        through = keep(through.unionByName(extra))
        e = self._edges()
        edges = keep(e.select(F.xxhash64(*M.METHOD, "owner", "name", "descriptor", "virtual", "guard").alias("edge"), K.method_key().alias("caller"), "owner", "name", "descriptor", "virtual", "guard"))
        known = node.select(*M.METHOD).unionByName(through.select(*M.METHOD)).distinct()
        unprobed = K.unknown_callers(self._declared("declared_methods", False), self._names())
        calls = keep(K.call_graph(edges, self._all_supertypes(), known, node, through, unprobed, self._withheld()))
        findings, covered = self._findings(), self._all_covered()
        # classes that were never loaded are found as wholes
        never = declared_only.join(self._failed_to_load(), "class_name", "left_anti").join(findings.where("finding is not null").select("class_name"), "class_name", "left_anti")
        findings = findings.unionByName(never.select("class_name", F.lit("NEVER_LOADED").alias("finding"), F.lit(False).alias("constructed")).distinct())
        covered = keep(covered.join(node.where("hits = 0").select(*M.METHOD), M.METHOD, "left_semi").unionByName(never))
        withheld = M.withheld_classes(self._withheld(), self._failed_to_load())
        outcomes = keep(K.outcome_nodes(m, node, M.site_guards(self.probes(), self._sites()), self._withheld()))
        outside = m.where("kind = 'METHOD' and outside is not null").select(K.method_key().alias("key"))
        return K.unreached_clusters(node, calls, outcomes, findings, covered, outside, withheld, self._failed_to_initialize(), K.possibly_run(m, node, self._withheld()))

    # --- dependencies -----------------------------------------------------------------------------------------------------

    def _listings(self) -> DataFrame:
        done = S.complete_scans(self._chunks()).join(G.scan_evidence(self.instances(), self.now), "instance_id", "left_semi")
        rows = self._in["dependencies"].withColumn("identity_key", identity_key(F.col("identities")))
        return self._keep("listings", lambda: I.dependencies(rows, self._in["dependency_deltas"], self.payloads, self.instances(), done))

    def _references(self) -> DataFrame:
        """Every held reference with the evidence about its site."""

        def build():
            methods = self.probes().where("kind = 'METHOD'").select("instance_id", *M.METHOD, F.lit("MANIFEST_METHOD").alias("origin"), F.explode("referenced_classes").alias("referenced_class"), "inline")
            named = self.probes().groupBy("instance_id", "class_id").agg(F.max("class_name").alias("class_name"))
            none = F.lit(None).cast("string")
            level = I.class_references(self._in["class_references"], named, self.payloads).select("instance_id", "class_name", none.alias("method_name"), none.alias("method_descriptor"), F.lit("MANIFEST_CLASS").alias("origin"), "referenced_class", F.lit(False).alias("inline"))
            d = self._declared("declared_methods", True).select("instance_id", *M.METHOD, F.lit("BASELINE").alias("origin"), F.explode("referenced_classes").alias("referenced_class"), "inline")
            c = self._declared("declared_classes", True).select("instance_id", "class_name", none.alias("method_name"), none.alias("method_descriptor"), F.lit("BASELINE").alias("origin"), F.explode("referenced_classes").alias("referenced_class"), F.lit(False).alias("inline"))
            rows = methods.unionByName(level).unionByName(d).unionByName(c).distinct()
            hit = self._with_hits().where("kind = 'METHOD'").groupBy(*M.METHOD).agg((F.sum("hits") > 0).alias("method_hit"))
            gaps = self._initializer_gaps().withColumn("gap", F.lit(True))
            blind = self.probes().where("kind = 'METHOD'").select("instance_id", *M.METHOD).distinct().join(gaps, ["instance_id", "class_name"], "left").groupBy(*M.METHOD).agg(F.bool_and(F.coalesce("gap", F.lit(False))).alias("blind"))
            skipped = self._skipped().select("class_name", F.lit(True).alias("skipped")).distinct()
            x = rows.join(hit, M.METHOD, "left").join(blind, M.METHOD, "left").join(skipped, "class_name", "left")
            no = F.lit(False)
            return x.select("instance_id", "class_name", "method_name", "origin", "referenced_class", "inline", F.coalesce("method_hit", no).alias("method_hit"), (F.coalesce("blind", no) | F.coalesce("skipped", no)).alias("without_evidence"))

        return self._keep("references", build)

    def _class_states(self) -> DataFrame:
        no = F.lit(False)
        loaded = self._known().select("instance_id", "class_name", F.lit(True).alias("loaded"), no.alias("failed"), no.alias("failed_init"))
        failed = self._failed_to_load().select(F.lit("").alias("instance_id"), "class_name", no.alias("loaded"), F.lit(True).alias("failed"), no.alias("failed_init"))
        threw = self._failed_to_initialize().select(F.lit("").alias("instance_id"), "class_name", no.alias("loaded"), no.alias("failed"), F.lit(True).alias("failed_init"))
        return loaded.unionByName(failed).unionByName(threw)

    def _externals(self) -> DataFrame:
        return self._keep("externals", lambda: I.external_classes(self._in["external_classes"], self.payloads))

    def _report(self) -> DataFrame:
        return self._keep("report", lambda: D.dependency_status(self._listings(), self._references(), self._class_states(), self._externals()))

    def _claimed(self, findings: DataFrame) -> DataFrame:
        if not findings.where("never_loaded").isEmpty():
            self._live()
        return findings

    def dependency(self, group_id: str | None, artifact_id: str) -> DataFrame:
        """Q23: one row."""
        self._checked(self.payloads)
        found = D.carrying(self._report(), group_id, artifact_id)
        row = found.first()
        if row.status in RESTING_ON_ZERO and row.sites:
            self._zero()
        if row.status == "UNLOADED":
            G.checked(found, G.listing_holds(self.instances(), found.select(F.explode("instances").alias("instance_id")), self.now))
        return self._claimed(found)

    def _split(self) -> None:
        if self.instances().where("references_recorded").isEmpty():
            raise D.NotSplit("no instance sent references_recorded")

    def _of_status(self, status: str) -> DataFrame:
        self._checked(self.payloads)
        if status in RESTING_ON_ZERO:
            self._zero()
        G.checked(self.payloads, G.listed_holds(self.instances()))
        if status != "UNLOADED":
            self._split()
        found = D.with_status(self._report(), status)
        if status == "UNLOADED":
            G.checked(found, G.listing_holds(self.instances(), found.select(F.explode("instances").alias("instance_id")), self.now))
        return self._claimed(found)

    def unloaded_dependencies(self) -> DataFrame:
        """Q24."""
        return self._of_status("UNLOADED")

    def unreferenced_dependencies(self) -> DataFrame:
        """Q24."""
        return self._of_status("UNREFERENCED")

    def unreached_dependencies(self) -> DataFrame:
        """Q24."""
        return self._of_status("UNREACHED")

    def failed_to_load_dependencies(self) -> DataFrame:
        """Q24."""
        return self._of_status("FAILED_TO_LOAD")

    def failed_to_initialize_dependencies(self) -> DataFrame:
        """Q24."""
        return self._of_status("FAILED_TO_INITIALIZE")

    def absent_references(self) -> DataFrame:
        """Q25."""
        self._checked(self.payloads)
        G.checked(self.payloads, G.listed_holds(self.instances()))
        self._split()
        recording = self.instances().where("references_recorded").select("instance_id")
        return self._claimed(D.absent_references(self._references(), self._externals(), self._class_states(), recording)).orderBy("referenced_class")

    # --- waits ------------------------------------------------------------------------------------------------------------

    def not_settled(self, flushes_before: DataFrame | None = None) -> DataFrame:
        """Q29: instances whose counts may still move; callers read new payloads and ask again. flushes_before: of instances() when the wait began."""
        none = self.spark.createDataFrame([], "instance_id string, flushes long")
        return G.not_settled(self._checked(self.instances()), none if flushes_before is None else flushes_before, self.now)
