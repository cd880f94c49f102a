"""Embedding near-duplicates by dual traversal of cover trees (operator 4).

Equal vectors form one class. The classes are dealt to the cells of a bounded sample of pivots, cells to blocks of
about BLOCK vectors, and each block becomes a cover tree: nested levels of halving radii, each node covering its members.
Blocks travel in groups: a task gets two groups whose cells' covering radii let them hold a link and traverses all their
pairs of trees, so a block is sent once per group and not once per block. A pair of nodes is dropped if its
centres are too far apart for any link, counted whole if all its pairs must be links, and opened otherwise.
Chord length stands for the cosine: cosine >= c exactly if the unit vectors are at most sqrt(2 - 2 c) apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize, partitions
from .graph import components
from .vectors import lengths, matrix, usable

BLOCK, MOST_CELLS, SURE = 4096, 1024, 1e-9
#: Blocks of a group at most, and groups that are wanted at least.
GROUP, GROUPS = 16, 6
#: The radius of the first level. Wider levels part nothing that links need, and their nodes would stay in reach of half of all others.
TOP = 0.5


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class CoverTree:
    """Over the rows of x (unit vectors). order: rows so that each node's members are neighbours; nodes: (centre row, first, past
    last, radius, first child, past last child), children of a node one after another; a leaf has no child."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.order = np.arange(len(x))
        self.nodes: list[list] = [[0, 0, len(x), 0.0, 0, 0]]
        todo = [(0, TOP)]
        self.nodes[0][3] = self._radius(0, self.order)
        while todo:
            k, r = todo.pop()
            c, a, b, radius, *_ = self.nodes[k]
            if b - a == 1 or radius == 0:
                continue
            while r >= radius:  # a level at which nothing parts
                r /= 2
            groups = self._cover(self.order[a:b], r)
            first, at = len(self.nodes), a
            for g in groups:
                self.order[at : at + len(g)] = g
                self.nodes.append([int(g[0]), at, at + len(g), self._radius(g[0], g), 0, 0])
                if len(g) > 1:
                    todo.append((len(self.nodes) - 1, r / 2))
                at += len(g)
            self.nodes[k][4:] = first, len(self.nodes)

    @classmethod
    def of(cls, x: np.ndarray, order: np.ndarray, nodes: np.ndarray) -> CoverTree:
        """The tree of these rows that was built elsewhere."""
        tree = cls.__new__(cls)
        tree.x, tree.order = x, order
        tree.nodes = [[int(c), int(a), int(b), float(r), int(f), int(g)] for c, a, b, r, f, g in nodes]
        return tree

    def _radius(self, centre: int, rows: np.ndarray) -> float:
        d = self.x[rows] - self.x[centre]
        return float(np.sqrt(np.einsum("ij,ij->i", d, d).max()))

    def _cover(self, rows: np.ndarray, r: float) -> list[np.ndarray]:
        """Centres more than r apart, each with the rows nearest to it, all within r; the centre first."""
        x, near = self.x, 1 - r * r / 2  # a cosine of near or more: within r
        centres: list[int] = []
        owner = np.empty(len(rows), np.int64)
        for a in range(0, len(rows), 256):
            part = rows[a : a + 256]
            if centres:
                dots = x[part] @ x[centres].T
                best = dots.argmax(axis=1)
                free = dots[np.arange(len(part)), best] < near
                owner[a : a + 256] = best
            else:
                free = np.ones(len(part), bool)
            own = x[part] @ x[part].T
            for i in np.flatnonzero(free):
                if free[i]:
                    taken = free & (own[i] >= near)
                    taken[i] = True
                    owner[a : a + 256][taken] = len(centres)
                    free &= ~taken
                    centres.append(int(part[i]))
        by = np.argsort(owner, kind="stable")
        groups = np.split(rows[by], np.cumsum(np.bincount(owner, minlength=len(centres)))[:-1])
        return [np.concatenate(([c], g[g != c])) for c, g in zip(centres, groups, strict=True)]


class Forest:
    """Union-find over 0..n-1 that gives its spanning edges."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def dual(s: CoverTree, t: CoverTree, most: float, weight_s: np.ndarray, weight_t: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(weights linked with each row of s, with each row of t, links that connect what is linked: rows of s, rows of t).

    same: s and t are one tree; each row's own weight is left out and only the first array counts.
    """
    got_s, got_t = np.zeros(len(s.x), np.int64), np.zeros(len(t.x), np.int64)
    forest = Forest(len(s.x) + (0 if same else len(t.x)))
    shift = 0 if same else len(s.x)
    links: list[tuple[int, int]] = []

    def whole(p, q):
        """All pairs of two nodes are links."""
        i, j = s.order[p[1] : p[2]], t.order[q[1] : q[2]]
        got_s[i] += weight_t[j].sum()
        got_t[j] += weight_s[i].sum()
        for a in i:
            if forest.root(int(a)) != forest.root(int(j[0]) + shift):
                forest.join(int(a), int(j[0]) + shift)
                links.append((int(a), int(j[0])))
        for b in j:
            if forest.root(int(i[0])) != forest.root(int(b) + shift):
                forest.join(int(i[0]), int(b) + shift)
                links.append((int(i[0]), int(b)))

    todo = [([0], [0])]
    ns, nt = (np.array([x[:4] for x in tree.nodes], np.float64) for tree in (s, t))
    while todo:
        ps, qs = todo.pop()
        for a in range(0, len(ps), 512):
            p = np.array(ps[a : a + 512])
            for b in range(0, len(qs), 4096):
                q = np.array(qs[b : b + 4096])
                dots = s.x[ns[p, 0].astype(int)] @ t.x[nt[q, 0].astype(int)].T
                reach = most + ns[p, 3][:, None] + nt[q, 3][None, :] + SURE
                close = dots >= 1 - reach * reach / 2 - SURE
                close |= reach >= 2
                for i, j in zip(*np.nonzero(close), strict=True):
                    u, v = s.nodes[p[i]], t.nodes[q[j]]
                    d = s.x[u[0]] - t.x[v[0]]
                    d = float(np.sqrt(d @ d))
                    leaves = not u[5] and not v[5]
                    if leaves or d + u[3] + v[3] <= most - SURE:
                        # a leaf's members are one vector: its centre speaks for all
                        if not leaves or dots[i, j] >= 1 - most * most / 2:
                            whole(u, v)
                    elif d <= u[3] + v[3] + most + SURE:
                        open_u = u[5] and (u[3] >= v[3] or not v[5])
                        both = u[5] and v[5] and u[3] < 2 * v[3] and v[3] < 2 * u[3]
                        todo.append((list(range(u[4], u[5])) if open_u or both else [int(p[i])], list(range(v[4], v[5])) if not open_u or both else [int(q[j])]))
    if same:
        got_s -= weight_s  # each row met itself once
    return got_s, got_t, links


def _dealing(pivots: np.ndarray, size: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column(1), size))
            dots = x @ pivots.T
            cell = dots.argmax(axis=1)
            far = np.sqrt(np.maximum(0, 2 - 2 * dots[np.arange(len(x)), cell]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64())], ["cid", "embedding", "copies", "cell", "far"])

    return run


TREE = ["raw", "order", "nodes", "copies", "ids"]


def _building(size: int, kind: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = table["embedding"].combine_chunks()
        tree = CoverTree(unit(matrix(column, size)))
        raw = column.flatten().to_numpy(zero_copy_only=False).astype(kind)  # as given: narrower than unit vectors, which come out the same again
        parts = [raw.tobytes(), tree.order.astype(np.int32).tobytes(), np.array(tree.nodes, np.float64).tobytes(), table["copies"].to_numpy().astype(np.int64).tobytes(), b"".join(table["cid"].to_pylist())]
        return pa.table({"team": pa.array([table["team"][0].as_py()], pa.int32())} | {n: pa.array([p], pa.binary()) for n, p in zip(TREE, parts, strict=True)})

    return run


def _opened(row: tuple, size: int, kind: str):
    raw, order, nodes, copies, ids = row
    x = unit(np.frombuffer(raw, kind).astype(np.float64).reshape(-1, size))
    ids = [ids[i : i + 16] for i in range(0, len(ids), 16)]
    return CoverTree.of(x, np.frombuffer(order, np.int32).astype(np.int64), np.frombuffer(nodes, np.float64).reshape(-1, 6)), np.frombuffer(copies, np.int64), ids


def _traversing(most: float, size: int, kind: str):
    """Rows (pair, right, tree) sorted by pair and side to what their trees link: (cid, links, other)."""

    def meet(left: list, right: list | None):
        for i, (s, ws, ids) in enumerate(left):
            for j, (t, wt, jds) in enumerate(left[i:] if right is None else right):
                same = right is None and j == 0
                a, b, links = dual(s, t, most, ws, wt, same)
                out = [(ids[k], int(a[k]), None) for k in np.flatnonzero(a)]
                if not same:
                    out += [(jds[k], int(b[k]), None) for k in np.flatnonzero(b)]
                out += [(ids[k], 0, jds[m]) for k, m in links if ids[k] != jds[m]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())], ["cid", "links", "other"])

    def run(batches):
        key, sides = None, ([], [])
        for batch in batches:
            for k in range(batch.num_rows):
                pair, side, same = (batch.column(c)[k].as_py() for c in range(3))
                if pair != key and key is not None:
                    yield from meet(sides[0], None if alone else sides[1])
                    sides = ([], [])
                key, alone = pair, same
                sides[side].append(_opened(tuple(batch.column(c)[k].as_py() for c in range(3, 8)), size, kind))
        if key is not None:
            yield from meet(sides[0], None if alone else sides[1])

    return run


def linked_vectors(rows: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; other columns are left out.

    Links: cosine of least or more, in double precision; n_links counts other rows. Vectors that are null, zero or hold null or
    non-finite components link with nothing, and vectors of different lengths not with each other. component_id is the
    smallest vec_id reachable, the own one included (null only if all are null); kept: vec_id equals it.
    """
    rows = rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding"))
    ok = usable(F.col("embedding"))
    out = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    for size in lengths(rows.where(ok), "embedding"):
        out = out.unionByName(_linked(rows.where(ok & (F.size("embedding") == size)), size, least))
    return out


def _linked(rows: DataFrame, size: int, least: float) -> DataFrame:
    """linked_vectors of usable vectors of one length."""
    spark = rows.sparkSession
    rows = rows.withColumn("cid", F.unhex(F.md5(F.col("embedding").cast("string").cast("binary"))))
    classes = rows.groupBy("cid", "embedding").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "vectors")
    n = classes.count()
    pivots = classes.orderBy("cid").limit(max(1, min(MOST_CELLS, n // BLOCK))).select("embedding").collect()
    pivots = unit(np.array([p[0] for p in pivots], np.float64))
    kind = classes.schema["embedding"].dataType.simpleString()
    dealt = classes.select("cid", "embedding", "copies").mapInArrow(_dealing(pivots, size), f"cid binary, embedding {kind}, copies long, cell int, far double")
    dealt = materialize(dealt, "cells")
    cells = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # at most MOST_CELLS rows
    parts = {c.cell: -(-c.n // BLOCK) for c in cells}
    offset = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist(), strict=False))
    group = max(1, min(GROUP, sum(parts.values()) // GROUPS))
    of = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])[F.col("cell")]
    block = of(offset) + F.pmod(F.xxhash64("cid"), of(parts))
    dealt = dealt.select("cid", "embedding", "copies", block.alias("block"), F.expr(f"cast(floor(block / {group}) as int)").alias("team"))
    kind = "float32" if classes.schema["embedding"].dataType.elementType.simpleString() == "float" else "float64"
    trees = dealt.groupBy("block").applyInArrow(_building(size, kind), ", ".join(["team int", *(f"{n} binary" for n in TREE)]))
    trees = materialize(trees, "trees")
    most = float(np.sqrt(2 - 2 * least))
    # groups (teams) of which two cells may hold a link
    known = sorted(parts)
    far = np.array([c.far for c in sorted(cells, key=lambda c: c.cell)])
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots[known] @ pivots[known].T))
    near = np.argwhere(apart <= far[:, None] + far[None, :] + most + 2e-8)  # at most MOST_CELLS a side; a root of rounding noise is 1.5e-8
    teams = [(c, t) for c in known for t in range(offset[c] // group, (offset[c] + parts[c] - 1) // group + 1)]
    near = spark.createDataFrame([(known[i], known[j]) for i, j in near.tolist() if i <= j], "i int, j int")
    teams = spark.createDataFrame(teams, "cell int, team int")
    reached = near.join(teams.select(F.col("cell").alias("i"), F.col("team").alias("t")), "i").join(teams.select(F.col("cell").alias("j"), F.col("team").alias("u")), "j")
    reached = reached.select(F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b")).distinct().withColumn("pair", F.col("a").cast("long") * (1 << 31) + F.col("b"))
    reached = materialize(reached, "pairs")
    # each group's trees to each of its pairs
    sides = reached.select("pair", F.lit(0).alias("side"), (F.col("a") == F.col("b")).alias("same"), F.col("a").alias("team")).union(reached.where("a < b").select("pair", F.lit(1), F.lit(False), F.col("b")))
    both = trees.join(sides, "team").select("pair", "side", "same", *TREE)
    both = both.repartition(max(partitions(spark), min(reached.count(), 10_000)), "pair").sortWithinPartitions("pair", "side")
    found = materialize(both.mapInArrow(_traversing(most, size, kind), "cid binary, links long, other binary"), "found")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    labels = components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    ids = classes.select("cid", "least_id", "copies").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = ids.groupBy("component").agg(F.min("least_id").alias("component_id"))
    per = ids.join(lowest, "component").join(counts, "cid", "left").select("cid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "cid").join(per, "cid")
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a, v b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
d AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT c.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN d USING (vec_id)
"""
