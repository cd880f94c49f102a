"""The telemetry tables read whole tables: small folders beside brute force."""

import random
from itertools import pairwise

from usagelens.queries import QUERIES


def write(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_every_order_makes_call_edges(spark, tmp_path):
    r = random.Random(1)
    size = {p: r.choice([5, 20, 30, 40]) for p in range(1, 31)}
    orders = {o: r.sample(range(1, 31), r.randint(1, 3)) for o in range(1, 26)}  # no order key that 40 divides
    lines = [(o, p) for o, ps in orders.items() for p in [*ps, ps[0]]]
    folder = write(spark, tmp_path, lineitem=(lines, "l_orderkey long, l_partkey long"), part=(list(size.items()), "p_partkey long, p_size int"))
    edges = {e for ps in orders.values() for e in pairwise(sorted(ps))}
    hit = {p for p, s in size.items() if s <= 10}
    callers = {p: {a for a, b in edges if b == p} for p in size}
    roots = {p: "UNCALLED" if not callers[p] else "REACHED_FROM_HIT" for p in size if p not in hit and (not callers[p] or callers[p] & hit)}

    def members(root):
        found, before = {root}, 0
        while len(found) > before:
            before = len(found)
            found |= {p for p in size if p not in hit and callers[p] and callers[p] <= found}
        return len(found)

    out_degree = {p: sum(a == p for a, _ in edges) for p in size if any(a == p for a, _ in edges)}
    name = lambda p: (f"pkg.C{p // 10}", f"m{p}")
    assert pairs(QUERIES["q26_call_edges"](spark, folder)) == sorted((*name(a), *name(b), "()V") for a, b in edges)
    assert pairs(QUERIES["u02_edge_union"](spark, folder)) == sorted(edges | {(p, p // 10) for p in size if p >= 10})
    assert pairs(QUERIES["g11_roots"](spark, folder)) == sorted(roots.items())
    clusters = {p: members(p) for p in roots}
    assert max(clusters.values()) > 1
    assert pairs(QUERIES["r04_clusters"](spark, folder)) == sorted(clusters.items())
    top = [x for g in range(10) for x in sorted((i for i in out_degree.items() if i[0] % 10 == g), key=lambda i: (-i[1], i[0]))[:3]]
    assert pairs(QUERIES["x09_top_callers"](spark, folder)) == sorted(top)


def test_every_order_holds_references(spark, tmp_path):
    supplier = [(i, i % 4, -100.0 if i % 2 else 5000.0) for i in range(1, 59)]
    part = [(p, 1 + p % 50) for p in range(1, 121)]
    r = random.Random(2)
    lines = [(o, r.randint(1, 120), s) for o in range(1, 16) for s in range(1, 59)]  # no order key that 16 divides
    folder = write(spark, tmp_path, lineitem=(lines, "l_orderkey long, l_partkey long, l_suppkey long"), part=(part, "p_partkey long, p_size int"),
                   supplier=(supplier, "s_suppkey long, s_nationkey int, s_acctbal double"))
    size, nation = dict(part), {s: n for s, n, _ in supplier}

    # (class, method, origin, hit, whether an unhit method gives no evidence) of a line's reference
    def held(p, s):
        n = {1: 14 * (p % 14), 5: 31 * (p % 6), 2: 31 * (p % 6) + 1, 6: 31 * (p % 6) + 2}.get(s % 8, p % 200)
        level = s % 8 in (1, 5) or (s % 4 == 0 and p % 3 == 0)
        origin = "BASELINE" if s % 8 == 1 else "MANIFEST_CLASS" if s % 8 == 5 else "MANIFEST_METHOD" if s % 4 or p % 3 else "BASELINE" if p % 2 else "MANIFEST_CLASS"
        return n, None if level else f"m{p}", origin, size[p] <= 5 and s % 4 == 0, size[p] % 6 == 0 and s % 8 == 6

    # class_state holds a class in the instance of its one part; 120 parts make 120 classes
    loaded = {p % 200 for p in size if p % 200 % 7}
    failed = {p % 200 for p in size if p % 200 % 14 == 0} - loaded
    failed_init = {p % 200 for p in size if p % 200 % 31 == 0}
    found, absent = {}, {}
    for _, p, s in lines:
        if size[p] % 13 == 0 or nation[s] == 3 or s % 8 == 3:
            continue
        n, method, origin, hit, blind = held(p, s)
        here = n in loaded and any(q % 200 == n and q % 4 == nation[s] for q in size)
        was = here if origin == "MANIFEST_CLASS" else n in loaded if method is None else hit
        now = was and not (n in failed_init and method is None)
        ftl, fti = origin == "BASELINE" and n in failed, n in failed_init and not now
        never = origin == "BASELINE" and not ftl and n not in loaded
        site = (f"pkg.C{n} (class level)" if method is None else f"pkg.C{n}#{method}") + (" (failed to load)" if ftl else " (failed to initialise)" if fti else " (never loaded)" if never else "")
        if s % 29 == 0:
            absent.setdefault(f"ext.S{s}", set()).add((site, never))
        else:
            found.setdefault(f"g{s % 60}:a{nation[s] % 3}", set()).add((site, now, ftl, fti, not was and method is not None and blind))
    got = {r.referenced_class: (r.sites, r.never_loaded) for r in QUERIES["q25_absent_references"](spark, folder).collect()}
    assert got == {c: (sorted({x for x, _ in v}), any(x for _, x in v)) for c, v in absent.items()} and got
    key = {s: f"g{s % 60}:a{nation[s] % 3}" for s in nation}

    def status(k):
        of = [s for s in nation if key[s] == k]
        refs = found.get(k, set())
        total = max(0 if s % 3 == 0 else s % 8 for s in of)
        if total == 0 and all(s % 11 and s % 4 == 0 for s in of):
            return "RESOURCES_ONLY"
        if total == 0 and any(s % 2 == 0 for s in of):
            return "UNLOADED"
        judged = [s for s in of if nation[s] != 3]
        if not judged:
            return "LOADED"
        for i, name in enumerate(("USED", "FAILED_TO_LOAD", "FAILED_TO_INITIALIZE", "WITHOUT_EVIDENCE"), 1):
            if any(r[i] for r in refs):
                return name
        if any(nation[s] == 2 for s in judged):
            return "NO_LIVE_REFERENCE"
        return "UNREACHED" if refs else "UNREFERENCED"

    want = {k: status(k) for k in key.values()}
    rows = QUERIES["q23_dependency_status"](spark, folder).collect()
    assert {r.identity_key: r.status for r in rows} == want
    assert {r.identity_key: r.sites for r in rows} == {k: sorted({r[0] for r in found.get(k, set())}) for k in want}
    histogram = {s: list(want.values()).count(s) for s in want.values()}
    assert len(histogram) > 6
    assert pairs(QUERIES["a17_status_histogram"](spark, folder)) == sorted(histogram.items())
    assert [k for k, _ in pairs(QUERIES["q24_unloaded_dependencies"](spark, folder))] == sorted(k for k, s in want.items() if s == "UNLOADED")
