"""Packing by optimal length buckets (operator 10).

The global histogram of lengths is small (one row per length up to the maximum). Dynamic programming over it
chooses the bucket boundaries that minimise padding; inside each bucket, batches are filled to a token budget.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .base import materialize, partitions, released
from .token_counts import worker_counter

#: Rows ranked in one group.
GROUP = 20_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The at most ``buckets`` padded lengths of least total padding; each length goes to the least one that holds it.

    lengths ascend. Of equal optima, one with the fewest buckets.
    """
    m = len(lengths)
    if m == 0:
        return []
    n = np.concatenate(([0], np.cumsum(counts, dtype=np.float64)))
    s = np.concatenate(([0], np.cumsum(counts * lengths, dtype=np.float64)))
    # cost[i, j]: lengths i..j padded to lengths[j]
    cost = lengths[None, :] * (n[1:][None, :] - n[:-1][:, None]) - (s[1:][None, :] - s[:-1][:, None])
    cost[np.tril_indices(m, -1)] = np.inf
    best, back = cost[0].copy(), [np.zeros(m, np.int64)]
    totals = [best[-1]]
    for _ in range(1, min(buckets, m)):
        with_cut = best[:-1, None] + cost[1:, :]  # the last bucket begins at i + 1
        cut = with_cut.argmin(axis=0)
        best = np.minimum(with_cut[cut, np.arange(m)], cost[0])
        back.append(np.where(with_cut[cut, np.arange(m)] < cost[0], cut + 1, 0))
        totals.append(best[-1])
    k, j, out = int(np.argmin(totals)), m - 1, []
    while j >= 0:
        out.append(int(lengths[j]))
        start = int(back[k][j])
        j, k = start - 1, k - 1
    return out[::-1]


def _counting(path: str, text: str):
    def run(batches):
        counter = worker_counter(path)
        for batch in batches:
            col = batch.schema.get_field_index(text)
            kept = [c for i, c in enumerate(batch.columns) if i != col]
            names = [c for i, c in enumerate(batch.schema.names) if i != col]
            yield pa.RecordBatch.from_arrays([*kept, counter.column(batch.column(col))], [*names, "n_tokens"])

    return released(run)


def token_lengths(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and n_tokens of every row; a null text has 0 tokens."""
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(_counting(tokenizer, "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def pack(lengths: DataFrame, max_tokens: int = 2048, buckets: int = 16, budget: int = 65_536) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start and n_tokens within the document, bucket_tokens (its padded
    length), batch_id, slot (from 0) and padding.

    lengths: doc_id and n_tokens. Documents over max_tokens are cut in pieces of max_tokens and a rest; no token is
    dropped. A document without tokens (or with a null count) is one piece of 0 tokens in the shortest bucket. A batch
    of a bucket holds as many pieces as fit budget (one at least), and all batches of a bucket but the last are
    full. Rows with null or repeated doc_id are pieces like others. Ranks come from counts per (bucket, group),
    so no task sees a whole bucket.
    """
    spark = lengths.sparkSession
    whole = F.coalesce("n_tokens", F.lit(0))
    cut = lengths.select("doc_id", whole.alias("whole")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(whole - 1) div {max_tokens}")))))
    cut = cut.select("doc_id", "piece", (F.col("piece") * max_tokens).alias("start"), F.least(F.lit(max_tokens).cast("long"), F.expr(f"whole - piece * {max_tokens}")).alias("n_tokens"))
    histogram = sorted((r[0], r[1]) for r in cut.groupBy("n_tokens").count().collect())  # max_tokens + 1 rows at most
    bounds = boundaries(np.array([h[0] for h in histogram], np.float64), np.array([h[1] for h in histogram], np.float64), buckets)
    total = sum(h[1] for h in histogram)
    groups = max(partitions(spark), total // GROUP + 1)
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")) for b in bounds], F.lit(max_tokens).cast("long"))
    dealt = cut.withColumns({"bucket_tokens": bucket, "group": F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups))})
    first = dealt.groupBy("bucket_tokens", "group").agg(F.count(F.lit(1)).alias("n"))
    first = first.select("bucket_tokens", "group", (F.sum("n").over(Window.partitionBy("bucket_tokens").orderBy("group")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("bucket_tokens", "group").orderBy("doc_id", "piece")) - 1)
    room = F.greatest(F.lit(1).cast("long"), F.expr(f"{budget} div greatest(1, bucket_tokens)"))
    out = ranked.join(first, ["bucket_tokens", "group"]).withColumn("at", F.col("before") + F.col("rank")).withColumn("room", room)
    return out.select(
        "doc_id", "piece", "start", "n_tokens", "bucket_tokens", F.concat_ws("-", "bucket_tokens", F.expr("at div room")).alias("batch_id"),
        F.expr("at % room").alias("slot"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )


def pack_documents(docs: DataFrame) -> DataFrame:
    """Documents packed by their byte_bpe_50k token counts, with the production parameters."""
    import public_tokenizers

    lengths = token_lengths(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pack(materialize(lengths, "lengths"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
