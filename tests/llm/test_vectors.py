import numpy as np
import pytest

from usagelens.llm.anisotropic import Quantiser, nearest
from usagelens.llm.cover_tree import CoverTree, dual, linked_vectors, unit


def vectors(n=400, size=16, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, size))
    for _ in range(n // 8):  # close pairs and groups
        i, j = r.integers(0, n, 2)
        x[i] = x[j] * r.uniform(0.5, 2) + r.normal(size=size) * r.choice([0.02, 0.2, 0.4, 0.6])
    x[:40] = x[0] + 0.05 * r.normal(size=(40, size))
    x[50:55] = x[49]
    return x.astype(np.float32)


def links_of(x, least=0.9):
    u = unit(x.astype(np.float64))
    linked = u @ u.T >= least
    np.fill_diagonal(linked, False)
    return linked


def test_cover_tree_invariants_and_dual_traversal():
    x = unit(vectors().astype(np.float64))
    tree = CoverTree(x)
    assert sorted(tree.order) == list(range(len(x)))
    for c, a, b, r, first, last in tree.nodes:
        assert np.linalg.norm(x[tree.order[a:b]] - x[c], axis=1).max() <= r + 1e-12
        if last:
            assert [tree.nodes[k][1] for k in range(first, last)][0] == a and tree.nodes[last - 1][2] == b
    w = np.ones(len(x), np.int64)
    got, _, _ = dual(tree, tree, np.sqrt(0.2), w, w, True)
    assert (got == links_of(x).sum(axis=1)).all()
    s, t = CoverTree(x[:150]), CoverTree(x[150:])
    a, b, _ = dual(s, t, np.sqrt(0.2), w[:150], w[150:], False)
    cross = links_of(x)[:150, 150:]
    assert (a == cross.sum(axis=1)).all() and (b == cross.sum(axis=0)).all()


@pytest.mark.parametrize(("block", "groups"), [(100, 6), (30, 4)])
def test_links_and_components_against_brute_force(spark, monkeypatch, block, groups):
    from usagelens.llm import cover_tree

    monkeypatch.setattr(cover_tree, "BLOCK", block)
    monkeypatch.setattr(cover_tree, "GROUPS", groups)
    x = vectors()
    linked = links_of(x)
    reach = linked | np.eye(len(x), dtype=bool)
    for _ in range(9):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(x)]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], []]
    rows += [(1000 + i, v, "x") for i, v in enumerate(odd)] + [(2000, [None] + [1.0] * 15, "x"), (None, x[3].tolist(), "x")]
    got = {r.vec_id: r for r in linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, kept string")).collect()}
    for i in range(len(x)):
        assert got[i].n_links == linked[i].sum() + (1 if i == 3 or linked[i, 3] else 0), i
        assert got[i].component_id == reach[i].argmax() and got[i].kept == (got[i].component_id == i)
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in [*range(1000, 1006), 2000])
    assert got[None].component_id == got[3].component_id and not got[None].kept
    # a table of two lengths: each is compared with its own
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in linked_vectors(two).collect()) == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert linked_vectors(empty).count() == 0


def test_search_recall_and_exact_scores(spark):
    x = vectors(3000, 32, 3)
    x[100:160] = x[99]  # ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9020, [0.0] * 32), (None, [1.0] * 32)], "vec_id long, embedding array<float>")
    got = nearest(rows, rows.where("vec_id % 20 = 0")).collect()
    x = x.astype(np.float64)
    by = {}
    for r in got:
        by.setdefault(r.query_id, {})[r.rank] = r
        assert abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-9 and r.vec_id != r.query_id
    hits = 0
    for q in range(0, 3000, 20):
        assert sorted(by[q]) == list(range(1, 21))
        want = [i for i in np.lexsort((np.arange(3000), -(x @ x[q]).round(9))) if i != q][:20]
        hits += len(set(want) & {r.vec_id for r in by[q].values()})
    assert hits / (150 * 20) >= 0.95 and set(by) == set(range(0, 3000, 20))
    few = nearest(rows.where("vec_id < 5"), rows.where("vec_id = 0"))
    assert few.count() == 4
    assert nearest(rows.limit(0), rows).count() == 0
    assert nearest(rows, rows.limit(0)).count() == 0
    odd = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, [3.0, 4.0, 5.0]), (6, [1.0, 1.0, 1.0]), (7, [0.5, 0.5])]
    two = spark.createDataFrame([(i, v, "x") for i, v in odd], "vec_id long, embedding array<double>, score string")
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(two, two).collect()) == [(1, 1, 7, 0.5), (5, 1, 6, 12.0), (6, 1, 5, 12.0), (7, 1, 1, 0.5), (7, 2, 1, 0.5)]


def test_fit_lowers_the_weighted_loss():
    x = vectors(2000, 64, 4).astype(np.float64)
    plain = Quantiser(64)
    plain.weight = 1.0
    plain.fit(x)
    score = Quantiser(64).fit(x)

    def parallel(q):
        s, codes = q.split(x), q.encode(x)
        r = (s - q.centres[np.arange(q.parts), codes]).reshape(len(x), -1)[:, :64]
        return (((r * x).sum(axis=1) ** 2) / (x * x).sum(axis=1)).mean()

    assert parallel(score) < parallel(plain)
