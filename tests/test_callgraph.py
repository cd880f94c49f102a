"""Resolution and clusters on small programs."""

from pyspark.sql import functions as F

from usagelens.operators import callgraph as G

MERGED = "class_name string, method_name string, method_descriptor string, kind string, parameter_index int, outcome string, hits long, line int, inline boolean, static boolean, generated_ord int, unread_ord int, routine_ord int"
EDGE = "edge long, caller string, owner string, name string, descriptor string, virtual boolean, guard string"


def method(cls, name, hits=0, generated=0, kind="METHOD", outcome=None):
    return (cls, name, "()V", kind, None, outcome, hits, 1, False, False, generated, 0, 0)


def graph(spark, methods, calls, supers=()):
    merged = spark.createDataFrame(methods, MERGED)
    edges = spark.createDataFrame([(i, f"{a}#{m} ()V", o, n, "()V", v, g) for i, (a, m, o, n, v, g) in enumerate(calls)], EDGE)
    node, through = G.nodes(merged), G.transparent(merged)
    st = spark.createDataFrame(list(supers), "child string, parent string").withColumn("ord", F.lit(0))
    return merged, node, G.call_graph(edges, st, merged.where("kind = 'METHOD'"), node, through)


def names(df):
    return sorted((r.caller.split(" ")[0], r.callee.split(" ")[0]) for r in df.collect())


def test_resolution(spark):
    methods = [method("Base", "run"), method("Sub", "run"), method("Sub", "<clinit>"), method("Main", "go", 1), method("Main", "bridge", 0, 1), method("Other", "end")]
    supers = [("Sub", "Base"), ("Leaf", "Sub")]
    virtual = [("Main", "go", "Base", "run", True, None)]
    assert names(graph(spark, methods, virtual, supers)[2]) == [("Main#go", "Base#run"), ("Main#go", "Sub#<clinit>"), ("Main#go", "Sub#run")]
    inherited = [("Main", "go", "Leaf", "run", False, None)]
    assert names(graph(spark, methods, inherited, supers)[2]) == [("Main#go", "Sub#<clinit>"), ("Main#go", "Sub#run")]
    looked = [("Main", "go", "Main", "bridge", False, None), ("Main", "bridge", "Other", "end", False, None), ("Main", "bridge", "Main", "bridge", False, None)]
    assert names(graph(spark, methods, looked, supers)[2]) == [("Main#go", "Other#end")]
    ran = [m if m[1] != "bridge" else method("Main", "bridge", 5, 1) for m in methods]
    assert names(graph(spark, ran, looked, supers)[2]) == [("Main#bridge", "Other#end"), ("Main#go", "Other#end")]


def clusters(spark, methods, calls, sites=(), findings=(), covered=()):
    merged, node, calls_ = graph(spark, methods, calls)
    s = spark.createDataFrame(list(sites), "class_name string, method_name string, method_descriptor string, outcome string, guard string")
    f = spark.createDataFrame(list(findings), "class_name string, finding string, constructed boolean")
    c = spark.createDataFrame(list(covered), "class_name string, method_name string, method_descriptor string")
    out: dict = {}
    for r in G.unreached_clusters(node, calls_, G.outcome_nodes(merged, node, s), f, c).collect():
        out.setdefault((r.root[0], r.root[1:].split(" ")[0], r.kind), set()).add(r.member.split("#")[1].split(" ")[0] if r.member else None)
    return out


def test_clusters(spark):
    methods = [method("A", "hot", 1), method("A", "a"), method("A", "b"), method("A", "c"), method("A", "alone")]
    calls = [("A", "hot", "A", "a", False, None), ("A", "a", "A", "b", False, None), ("A", "b", "A", "c", False, None), ("A", "a", "A", "c", False, None)]
    assert clusters(spark, methods, calls) == {("M", "A#a", "REACHED_FROM_HIT"): {"a", "b", "c"}, ("M", "A#alone", "UNCALLED"): {"alone"}}


def test_an_outcome_guards_its_calls(spark):
    methods = [method("A", "hot", 1), method("A", "hot", 0, kind="BRANCH", outcome="i:0"), method("A", "x"), method("A", "y")]
    calls = [("A", "hot", "A", "x", False, "i:0"), ("A", "x", "A", "y", False, None)]
    assert clusters(spark, methods, calls, sites=[("A", "hot", "()V", "i:0", None)]) == {("O", "A#hot", "UNTAKEN_OUTCOME"): {"x", "y"}}
    assert clusters(spark, methods, calls[1:], sites=[("A", "hot", "()V", "i:0", None)]) == {("M", "A#x", "UNCALLED"): {"x", "y"}}


def test_a_class_finding_stands_for_its_methods(spark):
    methods = [method("A", "hot", 1), method("K", "<clinit>"), method("K", "run"), method("A", "helper")]
    calls = [("A", "hot", "K", "run", False, None), ("K", "run", "A", "helper", False, None)]
    covered = [("K", "<clinit>", "()V"), ("K", "run", "()V")]
    got = clusters(spark, methods, calls, findings=[("K", "NEVER_INITIALIZED", False)], covered=covered)
    assert got == {("C", "K", "CLASS_FINDING"): {"run", "helper"}}
