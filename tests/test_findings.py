"""Rules of the merged findings on hand-made payloads."""

import random

import pytest

from usagelens.operators import findings as Q
from usagelens.operators import merge as M

PROBE = "instance_id string, rank int, class_id int, probe_index int, kind string, class_name string, method_name string, method_descriptor string, line int, branch_index int, branch_key string, parameter_index int, inline boolean, static boolean, lambda_body boolean, overridable boolean, generated_ord int, unread_ord int, routine_ord int, target_class_name string"
DELTA = "instance_id string, run_id string, class_id int, probe_index int, payload_sequence long, hits_total long"


def probe(instance, index, name, cls="Foo", kind="METHOD", line=1, branch=None, key=None, parameter=None, rank=0, class_id=1, **flags):
    f = {"inline": False, "static": False, "lambda_body": False, "overridable": False, "generated_ord": 0, "unread_ord": 0, "routine_ord": 0, "target_class_name": None} | flags
    return (instance, rank, class_id, index, kind, cls, name, "()V", line, branch, key, parameter, *f.values())


def merged(spark, probes, deltas):
    return M.merged_locations(spark.createDataFrame(probes, PROBE), spark.createDataFrame([(i, "r", c, p, n, h) for n, (i, c, p, h) in enumerate(deltas, 1)], DELTA))


def rows(m):
    return sorted((r.method_name, r.outcome) for r in Q.never_hit(m, Q.class_findings(m)).collect())


def test_method_hit_in_one_instance_is_hit(spark):
    p = [probe(i, k, n) for i in ("i-1", "i-2") for k, n in enumerate(["<init>", "ran", "idle"])]
    m = merged(spark, p, [("i-1", 1, 0, 1), ("i-1", 1, 1, 1)])
    assert rows(m) == [("idle", None)]
    assert Q.class_findings(m).where("finding is not null").count() == 0


def test_class_findings(spark):
    never = [probe("i", 0, "<init>"), probe("i", 1, "run")]
    assert Q.class_findings(merged(spark, never, [("i", 1, 9, 1)])).first().finding == "NEVER_INSTANTIATED"
    # an instance method ran although no constructor did; so it does when only a generated one ran
    assert Q.class_findings(merged(spark, never, [("i", 1, 1, 1)])).first().finding is None
    marked = [*never, probe("i", 2, "made", generated_ord=1)]
    assert Q.class_findings(merged(spark, marked, [("i", 1, 2, 1)])).first().finding is None
    both = [*never, probe("i", 2, "<clinit>")]
    m = merged(spark, both, [("i", 1, 9, 1)])
    f = Q.class_findings(m)
    assert f.first().finding == "NEVER_INITIALIZED" and Q.covered_methods(m, f).count() == 3


def test_outcomes_merge_by_key_and_never_with_keyless_ones(spark):
    ran = [probe(i, 9, "m", rank=r) for r, i in enumerate(("i-1", "i-2"))]
    hit = [("i-1", 1, 9, 1)]
    keyed = [*ran, probe("i-1", 1, "m", kind="BRANCH", branch=0, key="k"), probe("i-2", 1, "m", kind="BRANCH", branch=3, key="k", rank=1)]
    assert rows(merged(spark, keyed, hit)) == [("m", "k:k")]
    assert rows(merged(spark, keyed, [*hit, ("i-2", 1, 1, 2)])) == []
    mixed = [*ran, probe("i-1", 1, "m", kind="BRANCH", branch=0, key="k"), probe("i-2", 1, "m", kind="BRANCH", branch=0, rank=1)]
    assert rows(merged(spark, mixed, hit)) == [("m", "i:0"), ("m", "k:k")]
    assert rows(merged(spark, keyed, [])) == [("m", None)]  # the method's own row stands for its branches


def test_merge_rules_follow_age_and_ordinals(spark):
    p = [probe("i-1", 0, "m", line=5, generated_ord=2, routine_ord=0, rank=0), probe("i-2", 0, "m", line=9, generated_ord=1, routine_ord=1, rank=1), probe("i-3", 0, "m", line=7, rank=0, routine_ord=2)]
    r = merged(spark, p, [("i-1", 1, 0, 3), ("i-2", 1, 0, 4)]).first()
    assert (r.line, r.generated_ord, r.routine_ord, r.hits, r.instances) == (9, 2, 1, 7, 3)


def test_optional_parameters(spark):
    p = [probe(i, 0, "m", rank=r) for r, i in enumerate(("i-1", "i-2"))] + [probe(i, 1, "m", kind="OPTIONAL_ARGUMENT", parameter=0, rank=r) for r, i in enumerate(("i-1", "i-2"))]
    only = merged(spark, p, [("i-1", 1, 0, 2), ("i-1", 1, 1, 2)])
    assert Q.optional_parameters(only, never=True).count() == 1 and Q.optional_parameters(only, never=False).count() == 0
    mixed = merged(spark, p, [("i-1", 1, 0, 2), ("i-1", 1, 1, 2), ("i-2", 1, 0, 1)])
    assert Q.optional_parameters(mixed, never=True).count() == 0 and Q.optional_parameters(mixed, never=False).count() == 0
    always = merged(spark, p, [("i-1", 1, 0, 2)])
    assert Q.optional_parameters(always, never=False).count() == 1
    skipped = spark.createDataFrame([("Foo",)], "class_name string")
    assert Q.optional_parameters(always, never=False, skipped=skipped).count() == 0
    assert Q.optional_parameters(always, never=False, gaps=skipped).count() == 0


def test_lambda_folding(spark):
    names = ["idle", "lambda1", "lambda2", "ran"]
    p = [probe("i", k, n, lambda_body=n.startswith("lambda")) for k, n in enumerate(names)] + [probe("i", 7, "<init>")]
    m = merged(spark, p, [("i", 1, 3, 1), ("i", 1, 7, 1)])
    f = Q.class_findings(m)
    edges = spark.createDataFrame([("Foo", "idle", "()V", "Foo", "lambda1", "()V"), ("Foo", "lambda1", "()V", "Foo", "lambda2", "()V")], "class_name string, method_name string, method_descriptor string, c_class string, c_name string, c_desc string")
    folded = Q.folded_lambdas(m, edges, f, Q.covered_methods(m, f))
    assert sorted(r.method_name for r in folded.collect()) == ["lambda1", "lambda2"]
    assert sorted(r.method_name for r in Q.never_hit(m, f, folded=folded).collect()) == ["idle"]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_and_order_change_nothing(spark, seed):
    rnd = random.Random(seed)
    d = [("i-%d" % rnd.randrange(3), "r-%d" % rnd.randrange(2), 1, rnd.randrange(4), n, rnd.randrange(50)) for n in range(200)]
    once = sorted(map(tuple, M.total_hits(spark.createDataFrame(d, DELTA), ["probe_index"]).collect()))
    again = d + rnd.sample(d, 80)
    rnd.shuffle(again)
    assert once == sorted(map(tuple, M.total_hits(spark.createDataFrame(again, DELTA), ["probe_index"]).collect()))


def test_failed_to_initialize_is_inherited(spark):
    fail = spark.createDataFrame([("i", "A", "STATIC_INITIALIZER_THREW"), ("i", "V", "VERIFIER_REJECTED")], "instance_id string, class_name string, reason string")
    st = spark.createDataFrame([("i", "B", "A", False), ("i", "C", "B", False), ("i", "D", "A", True), ("i", "E", "V", True), ("i", "G", "E", True)], "instance_id string, child string, parent string, is_interface boolean")
    none = spark.createDataFrame([], "instance_id string, class_name string")
    names = lambda x: spark.createDataFrame([(n,) for n in x], "class_name string")
    got = lambda defaults, known: sorted(r.class_name for r in Q.failed_to_initialize(fail, st, defaults, names(["C"]), names(known)).collect())
    assert got(none, "ABCDEGV") == ["A", "B", "E", "G", "V"]
    assert got(spark.createDataFrame([("i", "A")], "instance_id string, class_name string"), "ABDV") == ["A", "B", "D", "V"]


def test_initializers(spark):
    p = [probe("i", 0, "<clinit>"), probe("i", 1, "x", kind="INITIALIZER_RETURNED"), probe("i", 2, "x", kind="INITIALIZER_THREW")]
    hits = lambda d: M.probe_hits(spark.createDataFrame(p, PROBE), spark.createDataFrame([("i", "r", 1, k, 1, 1) for k in d], DELTA))
    assert Q.initializers_running(hits([0])).count() == 1 and Q.initialized_classes(hits([0])).count() == 0
    assert Q.initializers_running(hits([0, 1])).count() == 0 and Q.initialized_classes(hits([0, 1])).count() == 1
