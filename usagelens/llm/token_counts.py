"""Token counts through a digest cache (operator 7).

A cache table holds (tokenizer digest, content digest, count). Documents are reduced to their content digests,
digests without a stored count are encoded once each, and the new counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import pieces, released, scratch, utf8
from .bpe import byte_letters

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Space-led pieces, and pattern pieces, kept in a worker's memory with their counts.
MEMO = 300_000
#: Bytes of text counted at once: the more, the more of its words are met once only.
RUN = 2 << 20
# Letters, digits and blanks on which the splitting below and the library's pattern surely agree; a text with any
# other character goes to the library whole.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_ODD = "[^\t-\r -~¡-ɏ]|[ ][\t-\r ]|[\t-\r] \\z"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9²³¹¼½¾]+| ?[^\\s{_LETTER}0-9²³¹¼½¾]+|\\s+(?!\\S)|\\s+")


@lru_cache(4)
def tokenizer_digest(path: str) -> str:
    """Of the vocabulary file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class Memo:
    """Counts of strings in columns, which take less than a dict: at most MEMO, or those asked for last."""

    def __init__(self):
        self.keys, self.counts = pa.array([], pa.string()), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def of(self, keys: pa.Array, count) -> np.ndarray:
        """Counts of distinct keys; count gives those of the keys that aren't remembered."""
        place = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy()
        fresh = place < 0
        out = np.zeros(len(keys), np.int64)
        out[~fresh] = self.counts[place[~fresh]]
        if fresh.any():
            new = keys.filter(pa.array(fresh))
            out[fresh] = count(new)
            if len(self) + len(new) > MEMO:  # what is asked for now stays
                self.keys, self.counts = keys, out
            else:
                self.keys, self.counts = pa.concat_arrays([self.keys, new]), np.concatenate([self.counts, out[fresh]])
        return out


class Counter:
    """Token counts of whole texts, equal to ``len(tokenizer.encode(text, add_special_tokens=False).ids)``.

    Byte-level BPE merges nothing across the pieces of its split pattern, so the count of a text is the sum over
    its space-led pieces; the library's model encodes each distinct pattern piece once while it is remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        import json

        with open(path) as f:
            kind = json.load(f)
        before = kind.get("pre_tokenizer") or {}
        self.by_piece = kind["model"]["type"] == "BPE" and kind["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not kind["model"].get("dropout")
        self.memo, self.sizes = Memo(), Memo()
        # NUL divides pieces on their way through the letters: a text that holds it is odd
        self.letters = {i: c for i, c in enumerate(byte_letters()) if i}

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def counts(self, texts: list[str] | pa.Array) -> list[int]:
        """Of each text; a null counts as empty."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.string()).fill_null("")
        out = np.zeros(len(column), np.int64)
        whole = pc.match_substring_regex(column, _ODD) if self.by_piece else pa.array(np.ones(len(column), bool))
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(column, s))
        odd, filled = whole.to_numpy(zero_copy_only=False), pc.binary_length(column).to_numpy() > 0
        split = np.flatnonzero(filled & ~odd)
        if len(split):
            parts = pc.split_pattern(column.take(pa.array(split)), " ")
            at, flat = np.asarray(parts.offsets), parts.values
            led = np.ones(len(flat), bool)
            led[at[:-1]] = False  # what stands before a text's first blank
            each = np.zeros(len(flat), np.int32)
            each[at[:-1]] = self.encode(flat.filter(pa.array(~led)).to_pylist())
            coded = flat.filter(pa.array(led)).dictionary_encode()
            each[led] = self.memo.of(coded.dictionary, self._led)[np.asarray(coded.indices)]
            out[split] = np.add.reduceat(each, at[:-1], dtype=np.int64)
        for i in np.flatnonzero(filled & odd):
            out[i] = self.encode([column[i].as_py()])[0]
        return out.tolist()

    def _led(self, words: pa.Array) -> np.ndarray:
        """Counts of space-led pieces, given without their blank."""
        # A blank begins a pattern piece, and only the first of a word, so all words are split at once. The empty word would join with white space before it: it goes first
        alone = words.to_pylist()
        alone.sort(key=len)
        coded = pa.array(_SPLIT.findall(" " + " ".join(alone)), pa.string()).dictionary_encode()
        at = np.asarray(coded.indices)
        begin = np.flatnonzero(pc.starts_with(coded.dictionary, " ").to_numpy(zero_copy_only=False)[at])
        # pattern pieces repeat far more than space-led ones: a word comes with many endings
        found = np.add.reduceat(self.sizes.of(coded.dictionary, self._sizes)[at], begin)
        out = np.empty(len(words), np.int64)
        out[np.argsort(pc.utf8_length(words).to_numpy(), kind="stable")] = found
        return out

    def _sizes(self, parts: pa.Array) -> np.ndarray:
        """Token counts of pattern pieces."""
        tokenize = self.tok.model.tokenize
        spelt = "\0".join(parts.to_pylist()).encode().decode("latin-1").translate(self.letters).split("\0")
        return np.fromiter((len(tokenize(p)) for p in spelt), np.int64, len(parts))

    def column(self, texts: pa.Array) -> pa.Array:
        """counts, by runs of documents of RUN bytes or a longer one."""
        _, offsets = utf8(texts)
        return pa.array([n for a, b in pieces(offsets, RUN) for n in self.counts(texts.slice(a, b - a))], pa.int64())


@lru_cache(2)
def worker_counter(path: str) -> Counter:
    """One for each worker process: later tasks find its vocabulary and its remembered pieces."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Counter(path)


def _counting(path: str):
    def run(batches):
        counter = worker_counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("digest"), counter.column(batch.column("text"))], ["digest", "n_tokens"])

    return released(run)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8) and n_tokens added (columns of those names are replaced).

    tokenizer: path of a tokenizers .json file, present on every executor. cache: folder of the cache table, made if
    missing; counts under other tokenizer digests in it stay untouched. A null text counts as empty (0 bytes, 0
    tokens). Texts are counted whole, repeated rows stay. Running twice at once may store a digest twice; readers
    take any of its equal counts.
    """
    spark: SparkSession = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    seen = _read_cache(spark, cache, version)
    # first() is combined map-side: a hot text leaves each task once
    distinct = docs.select(digest.alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    misses = distinct.join(seen, "digest", "left_anti") if seen is not None else distinct
    fresh = misses.mapInArrow(_counting(tokenizer), "digest binary, n_tokens long")
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    stored = _read_cache(spark, cache, version)
    named = docs.withColumns({"n_bytes": F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long"), "_digest": digest})
    return named.drop("n_tokens").join(stored.withColumnRenamed("digest", "_digest"), "_digest", "left").drop("_digest")


def _read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return None
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-cache"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
