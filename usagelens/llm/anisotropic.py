"""Maximum inner product search by score-aware quantisation (operator 5).

Vectors are cut into subspaces of two components with 16 centres each. The loss weighs the part of a vector's
residual that is parallel to the vector more than the rest, as that part moves large inner products; centres and
codes are fitted to it in turns. A search scans the four-bit codes with tables of partial products, two codes (one byte)
at a time, and ranks the best by exact products of the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import materialize, scratch
from .vectors import lengths, matrix, usable

#: Bounds: vectors that the centres are fitted on, queries of one pass, vectors of one scan, candidates ranked
#: exactly for each query and scan.
SAMPLE, QUERIES, SCAN, RANKED = 8192, 4096, 8192, 160
THRESHOLD = 0.2


class Quantiser:
    def __init__(self, size: int):
        self.size, self.parts = size, -(-size // 2)
        self.parts += self.parts % 2  # two codes to a byte
        self.weight = max(1.0, (size - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        self.centres = np.zeros((self.parts, 16, 2))

    def split(self, x: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(x), self.parts * 2))
        wide[:, : self.size] = x
        return wide.reshape(len(x), self.parts, 2)

    def fit(self, x: np.ndarray, rounds: int = 4, seed: int = 5) -> Quantiser:
        """Turns of coding and of solving for all centres at once (least squares in the weighted norm)."""
        r = np.random.default_rng(seed)
        s = self.split(x)
        self.centres = s[r.integers(0, len(x), (self.parts, 16)), np.arange(self.parts)[:, None]] + r.normal(0, 1e-6, (self.parts, 16, 2))
        for _ in range(6):  # plain Lloyd turns first
            codes = self._nearest(s)
            for m in range(self.parts):
                n = np.bincount(codes[:, m], minlength=16)
                for d in range(2):
                    total = np.bincount(codes[:, m], weights=s[:, m, d], minlength=16)
                    self.centres[m, :, d] = np.where(n, total / np.maximum(n, 1), self.centres[m, :, d])
        along = self.split(x / np.sqrt((x * x).sum(axis=1))[:, None])
        k = self.parts * 32
        for _ in range(rounds):
            codes = self.encode(x)
            at = ((np.arange(self.parts) * 16 + codes)[:, :, None] * 2 + np.arange(2)).reshape(len(x), -1)
            flat, rows = along.reshape(len(x), -1), np.arange(len(x))[:, None]
            v = np.zeros((len(x), k), np.float32)
            v[rows, at] = flat
            normal = (self.weight - 1) * (v.T @ v).astype(np.float64)
            normal[np.arange(k), np.arange(k)] += np.bincount(at.ravel(), minlength=k) + 1e-3
            norm = np.sqrt((x * x).sum(axis=1))
            right = np.bincount(at.ravel(), weights=(s.reshape(len(x), -1) + (self.weight - 1) * norm[:, None] * flat).ravel(), minlength=k)
            right += 1e-3 * self.centres.ravel()
            self.centres = np.linalg.solve(normal, right).reshape(self.centres.shape)
        return self

    def _nearest(self, s: np.ndarray) -> np.ndarray:
        return np.stack([((s[:, m, None, :] - self.centres[m]) ** 2).sum(axis=2).argmin(axis=1) for m in range(self.parts)], axis=1)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes by coordinate descent on |r|^2 + (weight - 1) (r . x / |x|)^2, from the nearest centres."""
        s = self.split(x)
        along = self.split(x / np.sqrt((x * x).sum(axis=1))[:, None])
        codes = self._nearest(s)
        rows = np.arange(len(x))
        apart = [((s[:, m, None, :] - self.centres[m]) ** 2).sum(axis=2) for m in range(self.parts)]
        share = [np.einsum("nkd,nd->nk", s[:, m, None, :] - self.centres[m], along[:, m]) for m in range(self.parts)]
        parallel = sum(share[m][rows, codes[:, m]] for m in range(self.parts))
        for _ in range(sweeps):
            for m in range(self.parts):
                rest = parallel - share[m][rows, codes[:, m]]
                codes[:, m] = (apart[m] + (self.weight - 1) * (rest[:, None] + share[m]) ** 2).argmin(axis=1)
                parallel = rest + share[m][rows, codes[:, m]]
        return codes

    def pack(self, codes: np.ndarray) -> np.ndarray:
        return (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(bytes of a code, 256, queries): the partial product that each byte of a code stands for."""
        t = np.einsum("qmd,mkd->mkq", self.split(queries), self.centres).astype(np.float32)
        return (t[::2][:, None, :, :] + t[1::2][:, :, None, :]).reshape(self.parts // 2, 256, len(queries))


def _coding(q: Quantiser):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), q.size)
                codes = [q.pack(q.encode(x[a : a + 2048])) for a in range(0, len(x), 2048)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for part in codes for c in part], pa.binary())], ["vec_id", "embedding", "code"])

    return run


def _scanning(q: Quantiser, ids: np.ndarray, queries: np.ndarray, k: int):
    tables = None

    def best_of(vec_ids, x, codes):
        """(query, vec_id, score) of the k nearest of one scan for each query."""
        nonlocal tables
        if tables is None:
            tables = q.tables(queries)
        _, first, kind = np.unique(x, axis=0, return_index=True, return_inverse=True)  # copies are scanned once
        kind = kind.ravel()
        order = np.lexsort((vec_ids, kind))
        begin = np.searchsorted(kind[order], np.arange(len(first) + 1))
        ranked = min(RANKED, len(first))
        out = []
        for a in range(0, len(queries), 512):
            score = tables[0][:, a : a + 512][codes[first, 0]]
            for m in range(1, len(tables)):
                score += tables[m][:, a : a + 512][codes[first, m]]
            top = np.argpartition(-score, ranked - 1, axis=0)[:ranked] if ranked < len(first) else np.tile(np.arange(len(first))[:, None], score.shape[1])
            for c in range(score.shape[1]):
                cand = top[:, c]
                exact = (x[first[cand]] * queries[a + c]).sum(axis=1)
                # k + 1 kinds suffice: one may be the query alone
                short = np.argsort(-exact, kind="stable")
                last = exact[short[min(k, len(short) - 1)]]
                short = short[exact[short] >= last]
                size = np.minimum(begin[cand[short] + 1] - begin[cand[short]], k + 1)
                rows = order[np.repeat(begin[cand[short]], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
                value = np.repeat(exact[short], size)
                keep = vec_ids[rows] != ids[a + c]
                rows, value = rows[keep], value[keep]
                o = np.lexsort((vec_ids[rows], -value))[:k]
                out.append((np.full(len(o), ids[a + c]), vec_ids[rows[o]], value[o]))
        return [np.concatenate(p) for p in zip(*out, strict=True)]

    def merged(parts):
        qs, vs, sc = (np.concatenate(p) for p in zip(*parts, strict=True))
        o = np.lexsort((vs, -sc, qs))
        qs, vs, sc = qs[o], vs[o], sc[o]
        start = np.searchsorted(qs, qs)
        keep = np.arange(len(qs)) - start < k
        return qs[keep], vs[keep], sc[keep]

    def run(batches):
        held = None
        for batch in batches:
            for a in range(0, batch.num_rows, SCAN):
                part = batch.slice(a, SCAN)
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                got = best_of(part.column(0).to_numpy(), matrix(part.column(1), q.size), codes)
                held = merged([held, got] if held is not None else [got])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows found with the largest inner product for each query, nearest first, ties to
    the smaller vec_id; all rows if there are fewer. score is the product of the original vectors in double precision.

    A row isn't its own candidate: rows with the query's vec_id are left out. Rows without vec_id, vectors that are
    null, zero or hold null or non-finite components take no part; vectors of different lengths aren't compared.
    Of queries with one vec_id the smallest vector counts. Every row is indexed. Queries go in passes of about QUERIES.
    Other columns are left out.
    """
    spark = rows.sparkSession

    def valid(df):
        return df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))

    base, asked = valid(rows), valid(queries)
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for size in lengths(base, "embedding"):
        of = F.size("embedding") == size
        empty = empty.unionByName(_nearest(base.where(of), asked.where(of), size, k))
    return empty


def _nearest(base: DataFrame, asked: DataFrame, size: int, k: int) -> DataFrame:
    """nearest for valid vectors of one length."""
    spark = base.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = base.select("embedding", F.xxhash64("vec_id", F.lit(5)).alias("at"), "vec_id").orderBy("at", "vec_id").limit(SAMPLE).select("embedding").collect()
    q = Quantiser(size).fit(np.array([r[0] for r in sample], np.float64))
    index = materialize(base.mapInArrow(_coding(q), "vec_id long, embedding array<double>, code binary"), "codes")
    asked = materialize(asked, "queries")
    n = asked.count()
    if not n:
        return empty
    passes = -(-n // QUERIES)
    path = scratch(spark, "found")
    for p in range(passes):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).collect()
        if part:
            ids, vectors = np.array([r[0] for r in part], np.int64), np.array([r[1] for r in part], np.float64)
            index.mapInArrow(_scanning(q, ids, vectors, k), "query_id long, vec_id long, score double").write.mode("append").parquet(path)
    found = spark.read.schema("query_id long, vec_id long, score double").parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
