"""The corpus pipeline: language identification, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm import langid, near_dup, packing, suffix_dedup
from usagelens.llm.base import scratch

#: Documents go whose most likely language has less than this share: with four languages little more than a guess.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or without any likely language, go.

    The network learns from the rows of docs that aren't held out; where no row has a lang, all with a letter stay.
    """
    net = langid.fit(docs, ~langid.held_out())
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = langid.predict(docs, net)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    groups = near_dup.near_duplicates(docs, width=5)
    kept = groups.where("kept").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("component_id").alias("_component"), F.col("n_shingles").alias("_n")).distinct()
    both = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & F.xxhash64("text").eqNullSafe(F.col("_digest")))
    # rows that share a doc_id and a group are one document: of repeated ids with near-equal texts one row stays; texts without words have no group
    one = both.where("_n > 0").dropDuplicates(["doc_id", "_component"])
    return one.unionByName(both.where("_n = 0")).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 200 bytes that occur elsewhere too."""
    cut = suffix_dedup.remove_repeats(docs, as_text=True)
    cut = cut.withColumn("text", F.when(F.col("n_bytes") > 0, F.col("kept")).otherwise(F.lit("")))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training batches by optimal length buckets."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("pack", pack)]
#: SQL can express neither the network nor the tokenizer; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = scratch(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
