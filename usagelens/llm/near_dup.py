"""Near-duplicates by MinHash bands, odd sketches and exact verification (operator 6).

1. Every text becomes a set of hashed word shingles; equal sets form one class, whose members need no comparing.
2. A class has HASHES MinHash values: BANDS bands of ROWS of them give its buckets, and the parities of their hashed
   values fill an odd sketch, whose XOR population counts estimate the similarity of a pair within a few hundredths.
3. Sketches choose the pairs that full sets then verify. First each class meets one other: of the centres of its buckets (the
   member whose buckets hold most classes) the one that it shares most bands with; what that links is contracted. Then only
   pairs of one bucket that lie in different components are left; their sketches are compared in blocks. The rows outside a
   bucket's largest component meet all its others, so a row is copied once for each block of such outsiders.
A pair of similarity s shares no bucket with probability (1 - s^ROWS)^BANDS: 5e-5 at 0.8, less above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import PIECE, materialize, mix, partitions, pieces, released, utf8, words
from .graph import components

BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: Bits of an odd sketch, and the estimate below which a pair isn't verified. With the noise of HASHES MinHash values and
#: of folding them into SKETCH bits together, three pairs in 100 million at 0.8 fall below it.
SKETCH, LEAST = 512, 0.55
#: Rows of each side of a block in which pairs are judged, and shingles of those rows' sets.
BLOCK, HEAVY = 512, 1 << 21
_R = np.random.default_rng(1729)
_XOR = _R.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MUL = _R.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int):
    """The sorted distinct shingle hashes of each document."""
    hashes, first = words(data, offsets)
    n = len(hashes)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for j in range(width if n >= width else 0):
        rolled = rolled * np.uint64(0xA24BAED4963EE407) + hashes[j : n - width + 1 + j]
    rolled = mix(rolled)
    for i in range(len(offsets) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for h in hashes[a:b]:
                whole = whole * np.uint64(0xA24BAED4963EE407) + h
            yield mix(whole + np.uint64(b - a))
        else:
            yield hashes[:0]


def identity(sets: list[np.ndarray]) -> np.ndarray:
    """Ids of 128 bits, as two words, of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    sizes = np.array([len(s) for s in sets], np.uint64)
    return np.stack([mix(np.add.reduceat(mix(flat ^ np.uint64(c)), starts) + sizes) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], axis=1)


def signature(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, band keys, odd sketches) of non-empty sets."""
    flat, ident = np.concatenate(sets), identity(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    low = (flat >> np.uint64(32)).astype(np.uint32)
    least = np.stack([np.minimum.reduceat((low ^ x) * m, starts) for x, m in zip(_XOR, _MUL, strict=True)], axis=1)
    bands = np.zeros((len(sets), BANDS), np.uint64)
    for r in range(ROWS):
        bands = bands * np.uint64(0xD1342543DE82EF95) + least[:, r::ROWS] + np.uint64(1)
    bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    spot = mix(least.astype(np.uint64) | (np.arange(HASHES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH)
    parity = np.zeros((len(sets), SKETCH), np.uint8)
    np.add.at(parity, (np.arange(len(sets))[:, None], spot.astype(np.int64)), 1)
    return ident, bands, np.packbits(parity & 1, axis=1).view(np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by odd sketches (last axis: words)."""
    differ = np.minimum(np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64), SKETCH // 2 - 1)
    return 1 + SKETCH / (4 * HASHES) * np.log1p(-2 * differ / SKETCH)


#: Bits in which two sketches may differ without their estimate falling below LEAST.
DIFFER = int(np.flatnonzero(1 + SKETCH / (4 * HASHES) * np.log1p(-2 * np.arange(SKETCH // 2) / SKETCH) >= LEAST)[-1])


def _signing(width: int):
    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column(2))
            cols: list[list] = [[], [], [], []]
            for i, j in pieces(at, PIECE):
                sets = list(shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], width))
                full = [s for s in sets if len(s)]
                ident, bands, sketches = signature(full) if full else (None, None, None)
                k = 0
                for s in sets:
                    cols[0].append(len(s))
                    cols[1].append(ident[k].tobytes() if len(s) else None)
                    cols[2].append(bands[k].view(np.int64) if len(s) else None)
                    cols[3].append(sketches[k].view(np.int64) if len(s) else None)
                    k += bool(len(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.list_(pa.int64()))],
                ["doc_id", "digest", "n_shingles", "cid", "bands", "sketch"],
            )

    return run


def _sets(width: int):
    """The sets of (cid, text), of those texts whose set has that id: two rows that a key of 64 bits mixes up are told apart."""

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column(1))
            cids, out, known = [], [], batch.column(0).to_pylist()
            for i, j in pieces(at, PIECE):
                for cid, s in zip(known[i:j], shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], width), strict=True):
                    if len(s) and identity([s])[0].tobytes() == cid:
                        cids.append(cid)
                        out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.binary()), pa.array(out, pa.binary())], ["cid", "members"])

    return run


def _verifying(least: float):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= round(100 * least) * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return run


def _blocks(batches):
    """(key, rows) of whole blocks from batches whose first column, the key, comes sorted."""
    last, held = None, []
    for batch in batches:
        # lists of numbers, all of one length, as rows of an array: a fraction of what lists of objects take
        columns = [c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) if pa.types.is_list(c.type) and len(c) else c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if held and row[0] != last:
                yield last, held
                held = []
            last = row[0]
            held.append(row)
    if held:
        yield last, held


def _open_pairs(key: str, rows: list[tuple], bound: int):
    """(left rows, right rows, which pairs are to be judged here): other components, sketches and sizes that allow the threshold, and
    no earlier band in common, as that band's bucket has the pair too."""
    bucket = np.int64(int(key.split(" ")[0]))
    left, right = ([r for r in rows if r[1] == side] for side in (True, False))
    if not left or not right:
        return left, right, np.zeros((len(left), len(right)), bool)
    sk = [np.array([r[4] for r in side], np.int64).view(np.uint64) for side in (left, right)]
    n = [np.array([r[6] for r in side], np.int64) for side in (left, right)]
    bands = [np.array([r[5] for r in side], np.int64) for side in (left, right)]
    comps = [np.array([r[3] for r in side], dtype=object) for side in (left, right)]
    out = np.zeros((len(left), len(right)), bool)
    for a in range(0, len(left), 64):
        same = bands[0][a : a + 64, None, :] == bands[1][None, :, :]
        first = np.take_along_axis(np.broadcast_to(bands[1][None, :, :], same.shape), same.argmax(axis=2)[:, :, None], axis=2)[:, :, 0]
        may = np.bitwise_count(sk[0][a : a + 64, None, :] ^ sk[1][None, :, :]).sum(axis=-1, dtype=np.int64) <= DIFFER
        may &= 100 * np.minimum(n[0][a : a + 64, None], n[1][None, :]) >= bound * np.maximum(n[0][a : a + 64, None], n[1][None, :])
        out[a : a + 64] = (first == bucket) & may & (comps[0][a : a + 64, None] != comps[1][None, :])
    return left, right, out


def _meeting(least: float):
    """The rows of each bucket that have a pair to be judged: (bucket, left, cid)."""
    bound = round(100 * least)

    def run(batches):
        for key, rows in _blocks(batches):
            left, right, to_do = _open_pairs(key, rows, bound)
            out = [(True, left[i][2]) for i in np.flatnonzero(to_do.any(axis=1))] + [(False, right[j][2]) for j in np.flatnonzero(to_do.any(axis=0))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([int(key.split(" ")[0])] * len(out), pa.int64()), pa.array([o[0] for o in out], pa.bool_()), pa.array([o[1] for o in out], pa.binary())], ["bucket", "left", "cid"])

    return run


def _linking(least: float):
    """Links found in each block, on full sets. What two components have joined isn't judged again: a block gives no more
    links than it has rows."""
    bound = round(100 * least)

    def run(batches):
        for key, rows in _blocks(batches):
            left, right, to_do = _open_pairs(key, rows, bound)
            if not to_do.any():
                continue
            up: dict = {}

            def root(c, up=up):
                while c in up:
                    c = up[c]
                return c

            sets = [np.frombuffer(r[7], np.uint64) for r in right]
            flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
            starts = np.cumsum(sizes) - sizes
            out = []
            for i in np.flatnonzero(to_do.any(axis=1)):
                x = np.frombuffer(left[i][7], np.uint64)
                js = np.flatnonzero(to_do[i])
                js = js[[root(left[i][3]) != root(right[j][3]) for j in js]]
                if not len(js):
                    continue
                n = sizes[js]
                at = np.repeat(starts[js] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                values = flat[at]
                hit = x[np.minimum(np.searchsorted(x, values), len(x) - 1)] == values
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum(n) - n)
                for j in js[100 * both >= bound * (len(x) + n - both)]:
                    p, q = root(left[i][3]), root(right[j][3])
                    if p != q:
                        up[p] = q
                        out.append((left[i][2], right[j][2]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    return run


def _dealt(rows: DataFrame, n: int, heavy: bool = False) -> DataFrame:
    """Each bucket's left rows against its right rows in blocks of BLOCK by BLOCK (with heavy, of fewer where their sets are large);
    rows: bucket, left, cid, size and more. rows are written, so that a bucket of many rows can be split in the join."""
    rows = materialize(rows, "dealt")
    sides = (F.col("left"), ~F.col("left"))
    counts = [F.count_if(c).alias(k) for c, k in zip(sides, "lr", strict=True)] + [F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0)).alias(k) for c, k in zip(sides, "uv", strict=True)]
    sizes = materialize(rows.groupBy("bucket").agg(*counts), "sizes")
    high, wide = (F.expr(f"cast(greatest(1, ceil({c} / {BLOCK}), {f'ceil({w} / {HEAVY})' if heavy else 1}) as int)") for c, w in (("l", "u"), ("r", "v")))
    own = F.pmod(F.xxhash64("cid"), F.when(F.col("left"), high).otherwise(wide)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("left"), wide).otherwise(high) - 1))
    x = rows.join(sizes, "bucket").withColumns({"own": own}).select("*", other.alias("other"))
    i, j = F.when(F.col("left"), F.col("own")).otherwise(F.col("other")), F.when(F.col("left"), F.col("other")).otherwise(F.col("own"))
    x = x.withColumns({"i": i, "j": j, "key": F.concat_ws(" ", "bucket", i, j)})
    return x.repartition(n, "key").sortWithinPartitions("key")


def near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n_shingles, component_id, kept) of every row; digest is xxhash64 of the text.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text of fewer words than width is one shingle, and one without
    words (or null) is empty and linked with nothing. Links: similarity of least or more, in hundredths. component_id is
    the smallest doc_id reachable, the own one included (null only if all are null); kept: doc_id equals it. Repeated
    rows have equal sets and so share a component.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("digest"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = materialize(rows.mapInArrow(released(_signing(width)), f"doc_id {kind}, digest long, n_shingles long, cid binary, bands array<long>, sketch array<long>"), "signed")
    classes = signed.where("cid is not null").groupBy("cid").agg(
        F.min(F.struct("doc_id", "digest")).alias("rep"), F.min("doc_id").alias("least_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("size")
    )
    classes = materialize(classes, "classes")

    # buckets of two classes or more, each with its centre: near copies that lie between the others share most with them
    banded = classes.select(F.explode("bands").alias("bucket"), "cid")
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(banded.join(shared, "bucket"), "buckets")
    weight = members.groupBy("cid").agg(F.sum("n").alias("weight"))
    centre = members.join(weight, "cid").groupBy("bucket").agg(F.max(F.struct("weight", "cid"))["cid"].alias("first"))
    # one partner for each class: the centre that it shares most bands with
    stars = members.join(centre, "bucket").where("cid <> first").groupBy("cid", "first").agg(F.count(F.lit(1)).alias("bands"))
    stars = stars.groupBy("cid").agg(F.max_by("first", F.struct("bands", "first")).alias("first"))
    stars = stars.select(F.least("cid", "first").alias("a"), F.greatest("cid", "first").alias("b")).distinct()
    one, two = (classes.select(F.col("cid").alias(c), F.col("sketch").alias(f"s_{c}")) for c in "ab")
    apart = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    tried = materialize(stars.join(one, "a").join(two, "b").where(apart <= DIFFER).select("a", "b"), "tried")
    links = _verify(docs, classes, tried, width, least, key, text)
    labels = components(links)

    # what is left: buckets that hold several components. The rows outside the largest one meet all others
    placed = members.select("bucket", "cid").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    parts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
    parts = parts.groupBy("bucket").agg(F.max_by("component", F.struct("m", "component")).alias("main"), (F.sum("m") > F.max("m")).alias("open")).where("open").drop("open")
    traits = classes.select("cid", "sketch", "bands", "size")
    open_ = placed.join(parts, "bucket")
    sides = open_.where("component <> main").withColumn("left", F.lit(True)).unionByName(open_.withColumn("left", F.lit(False))).drop("main")
    n = partitions(docs.sparkSession)
    meeting = _dealt(sides.join(traits, "cid"), n).select("key", "left", "cid", "component", "sketch", "bands", "size")
    active = materialize(meeting.mapInArrow(released(_meeting(least)), "bucket long, left boolean, cid binary").distinct(), "active")
    sets = _fetch(docs, classes, active.select("cid"), width, key, text)
    full = active.join(traits, "cid").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    # sets travel only once the rows are dealt out
    judged = _dealt(full.join(sets, "cid"), n, heavy=True).select("key", "left", "cid", "component", "sketch", "bands", "size", "members")
    links = links.union(materialize(judged.mapInArrow(released(_linking(least)), "a binary, b binary"), "links"))
    labels = components(links)

    ids = classes.select("cid", "least_id").join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = ids.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_class = ids.join(lowest, "component").select("cid", "component_id")
    out = signed.select("doc_id", "digest", "n_shingles", "cid").join(of_class, "cid", "left")
    out = out.withColumn("component_id", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "digest", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _fetch(docs: DataFrame, classes: DataFrame, used: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """(cid, members) of the classes in used: only their texts are made sets again."""
    wanted = classes.join(used.distinct(), "cid").select("cid", F.xxhash64("rep.doc_id", "rep.digest").alias("at"))
    rows = docs.select(F.xxhash64(F.col(key), F.xxhash64(F.col(text))).alias("at"), F.col(text).alias("text"))
    # each class's smallest (doc_id, digest) row; equal rows give equal sets
    found = rows.join(wanted.hint("shuffle_hash"), "at").select("cid", "text")
    return materialize(found.mapInArrow(released(_sets(width)), "cid binary, members binary").dropDuplicates(["cid"]), "sets")


def _verify(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, least: float, key: str, text: str) -> DataFrame:
    """Those pairs (a, b) whose full sets reach the threshold."""
    sets = _fetch(docs, classes, pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))), width, key, text)
    one = pairs.join(sets.select(F.col("cid").alias("a"), F.col("members").alias("x")), "a")
    two = one.join(sets.select(F.col("cid").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y")
    return materialize(two.mapInArrow(released(_verifying(least)), "a binary, b binary"), "links")


def op6_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=2).select("doc_id", "n_shingles", "component_id", "kept")
