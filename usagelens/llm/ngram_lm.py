"""A language model of order three in an Elias-Fano trie (operator 9).

Level 1 holds the words' hashes (ascending, so a word's rank is its id) with their counts. Below it the trie is dealt to shards by its
first word; the followers of a word that fills more than a shard are dealt out too. A shard has the words it holds contexts of,
level 2 with the words seen after each, and level 3 with the words seen after each of those pairs. A node's followers lie between two
monotone pointers; their ids are stored relative to the node, on top of the last value of the node before it, so that each level is
one monotone sequence; a lookup is a successor search between the pointers. Level 2 has an 8-bit quantised log probability for each
follower, level 3 the quantised share of each, and each pair the quantised weight it leaves to order two. The levels are files in
the shared folder, written by tasks and mapped into memory by tasks: neither the driver nor a worker ever holds one.

p(w) = (c(w) + 1) / (N + V + 1); p(w | v) = (c(v, w) + MU p(w)) / (c(v) + MU); p(w | u, v) = (c(u, v, w) + NU p(w | v)) / (c(u, v) + NU), where c(u, v)
counts those followed by a token. The first token of a text follows its start. Words count by a 64-bit hash.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize, mix, partitions, pieces, released, scratch, utf8, words
from .elias_fano import EliasFano, open_arrays, write_arrays

MU, NU = 500.0, 5.0
#: Word shards: 2^LEAST_BITS at least, and as many as keep them at about SHARD words.
LEAST_BITS, SHARD = 4, 1 << 20
#: Training tokens of a trie shard; a first word with more is dealt out by its follower.
TOKENS = 4_000_000
#: The hash that stands for the end of a text; tokens of one flush; bytes of one scoring piece.
END, FLUSH, PIECE = np.uint64(0x5DEECE66D1A2B3C5), 2_000_000, 4 << 20
U = np.uint64


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every token with an end after each text, first token of each text)."""
    hashes, first = words(data, offsets)
    return np.insert(hashes, first[1:], END), first + np.arange(len(first))


def _flushes(batches):
    """(tokens, is the first of its text) of whole texts, about FLUSH at a time."""
    held, size = [], 0
    for batch in batches:
        data, at = utf8(batch.column(0))
        for i, j in pieces(at, PIECE):
            t, first = tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
            new = np.zeros(len(t), bool)
            new[first[:-1]] = True
            held.append((t, new))
            size += len(t)
            if size >= FLUSH:
                yield [np.concatenate(p) for p in zip(*held, strict=True)]
                held, size = [], 0
    if size:
        yield [np.concatenate(p) for p in zip(*held, strict=True)]


def _counting(batches):
    for t, _ in _flushes(batches):
        h, c = np.unique(t, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["hash", "n"])


def _by_shard(batches):
    """Whole shards from batches whose first column, the shard, comes sorted."""
    last, held = None, []
    for batch in batches:
        shard = batch.column(0).to_numpy()
        cuts = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)])) if len(shard) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if last is not None and shard[a] != last:
                yield last, held
                held = []
            last = int(shard[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield last, held


def _writing_words(folder: str, bits: int):
    def run(batches):
        for shard, parts in _by_shard(batches):
            h = np.concatenate([p.column(1).to_numpy() for p in parts]).view(U)
            n = np.concatenate([p.column(2).to_numpy() for p in parts])
            order = np.argsort(h)
            h, n = h[order], n[order]
            ef = EliasFano.of(h & U((1 << (64 - bits)) - 1), 1 << (64 - bits))
            write_arrays(f"{folder}/words-{shard}.ef", ef.parts("hash") | {"count": n})
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["shard", "words", "tokens"])

    return run


@dataclass
class Model:
    """What tasks need to open the files: a few numbers."""

    folder: str
    base: list[int]  # id of each word shard's first word
    total: int  # N
    distinct: int  # V
    texts: int
    bits: int = LEAST_BITS
    shards: int = 0
    mu: float = MU
    nu: float = NU
    _open: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def file(self, name: str) -> dict:
        if name not in self._open:
            self._open[name] = open_arrays(f"{self.folder}/{name}.ef")
        return self._open[name]

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each hash; -1 and 0 if it wasn't in the training texts."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        top = (h >> U(64 - self.bits)).astype(np.int64)
        for s in np.unique(top).tolist():
            if self.base[s + 1] == self.base[s]:
                continue
            arrays = self.file(f"words-{s}")
            if f"words-{s}/ef" not in self._open:
                self._open[f"words-{s}/ef"] = EliasFano.read(arrays, "hash")
            ef, own = self._open[f"words-{s}/ef"], np.flatnonzero(top == s)
            x = h[own] & U((1 << (64 - self.bits)) - 1)
            at = ef.successor(x)
            ok = np.flatnonzero(at < ef.n)
            ok = ok[ef.get(at[ok]) == x[ok]]
            ids[own[ok]] = at[ok] + self.base[s]
            counts[own[ok]] = arrays["count"][at[ok]]
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """The counts of ids; distinct stands for the start of a text."""
        out = np.full(len(ids), self.texts, np.int64)
        shard = np.searchsorted(self.base, ids, "right") - 1
        for s in np.unique(shard[ids < self.distinct]).tolist():
            own = (shard == s) & (ids < self.distinct)
            out[own] = self.file(f"words-{s}")["count"][ids[own] - self.base[s]]
        return out

    def shard_of(self, one: np.ndarray, two: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The shard of a pair whose first word has that count."""
        fan = (count // TOKENS + 1).astype(U)
        return (mix(one.astype(U) * U(0x9E3779B97F4A7C15) + mix(two.astype(U) + U(1)) % fan) % U(max(1, self.shards))).astype(np.int64)

    def _levels(self, s: int):
        arrays = self.file(f"trie-{s}")
        if f"trie-{s}/ef" not in self._open:
            names = ("one", "at2", "two", "at3", "three")
            self._open[f"trie-{s}/ef"] = [EliasFano.read(arrays, n) for n in names] if len(arrays["code2"]) else None
        return arrays, self._open[f"trie-{s}/ef"]

    @staticmethod
    def _child(pointer: EliasFano, child: EliasFano, node: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The place of value among the children of each node; -1 where it is none."""
        a, b = (x.astype(np.int64) for x in pointer.two(node))
        out = np.full(len(node), -1, np.int64)
        has = np.flatnonzero(a < b)
        a, b, value = a[has], b[has], value[has].astype(U)
        # the last value of the node before, and the first one of this node
        under, least = np.zeros(len(has), U), np.zeros(len(has), U)
        some = np.flatnonzero(a > 0)
        under[some], least[some] = child.two(a[some] - 1)
        under[some] += U(1)
        start = np.flatnonzero(a == 0)
        least[start] = child.get(a[start])
        x = under + value
        hit = least == x
        out[has[hit]] = a[hit]
        more = np.flatnonzero((least < x) & (b - a > 1))
        if len(more):
            x, a, b = x[more], a[more] + 1, b[more]
            at = child.successor(x, a, b)
            ok = np.flatnonzero(at < b)
            ok = ok[child.get(at[ok]) == x[ok]]
            out[has[more[ok]]] = at[ok]
        return out

    def pairs(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For pairs sorted by the first word (distinct is the start of a text): shard, place (-1 if unseen), the stored log10 probability (nan if
        unseen) and the share that the pair leaves to order two (1 if unseen)."""
        shard = self.shard_of(one, two, self.counts_of(one))
        place, value, left = np.full(len(one), -1, np.int64), np.full(len(one), np.nan), np.ones(len(one))
        for s, own in _by_value(shard):
            arrays, levels = self._levels(s)
            if levels is None:
                continue
            ones, at2, twos = levels[:3]
            first = np.flatnonzero(np.concatenate(([True], one[own][1:] != one[own][:-1])))
            kinds = one[own][first].astype(U)
            at = ones.successor(kinds)
            known = np.flatnonzero(at < ones.n)
            known = known[ones.get(at[known]) == kinds[known]]
            node = np.full(len(kinds), -1, np.int64)
            node[known] = at[known]
            node = np.repeat(node, np.diff(np.append(first, len(own))))
            some = np.flatnonzero(node >= 0)
            at = self._child(at2, twos, node[some], two[own][some])
            hit = own[some[at >= 0]]
            place[hit] = at[at >= 0]
            value[hit] = arrays["book2"][arrays["code2"][place[hit]]]
            left[hit] = arrays["book_left"][arrays["left"][place[hit]]]
        return shard, place, value, left

    def third(self, shard: np.ndarray, place: np.ndarray, three: np.ndarray) -> np.ndarray:
        """The stored share of three after the pair at that place of a shard; 0 if unseen."""
        out = np.zeros(len(three))
        for s, own in _by_value(shard):
            arrays, levels = self._levels(s)
            if levels[4].n:
                at = self._child(levels[3], levels[4], place[own], three[own])
                out[own[at >= 0]] = arrays["book3"][arrays["code3"][at[at >= 0]]]
        return out

    def single(self, count: np.ndarray) -> np.ndarray:
        return (count + 1) / (self.total + self.distinct + 1)


def _by_value(shard: np.ndarray):
    """(value, places that have it) in ascending order; places keep theirs."""
    order = np.argsort(shard, kind="stable")
    found = shard[order]
    cuts = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))) if len(found) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        yield int(found[a]), order[a:b]


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype(np.uint32).tobytes(), 1)


def _grams(model: Model):
    """Blocks of distinct pairs and triples: for each pair its count, its number of distinct followers, and these with their counts."""

    def run(batches):
        for t, new in _flushes(batches):
            kinds, inverse = np.unique(t, return_inverse=True)
            ids = model.look_up(kinds)[0][inverse.ravel()]
            before = np.concatenate(([0], ids[:-1]))
            before[new] = model.distinct
            key, rank, c = np.unique(before.astype(U) << U(32) | ids.astype(U), return_inverse=True, return_counts=True)
            one, two = (key >> U(32)).astype(np.int64), (key & U(0xFFFFFFFF)).astype(np.int64)
            shard = model.shard_of(one, two, model.counts_of(one))
            later = np.flatnonzero(~new)
            key3, c3 = np.unique(rank.ravel()[later - 1].astype(U) << U(32) | ids[later].astype(U), return_counts=True)
            pair3, three = (key3 >> U(32)).astype(np.int64), key3 & U(0xFFFFFFFF)
            begin = np.searchsorted(pair3, np.arange(len(key) + 1))  # triples of each pair
            many = np.diff(begin)
            rows = []
            for s, own in _by_value(shard):  # ascending keys: a sequence of their own
                flat = one[own].astype(U) * U(model.distinct + 1) + two[own].astype(U)
                n = many[own]
                at = np.repeat(begin[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                rows.append((s, EliasFano.of(flat, (model.distinct + 1) ** 2).dump(), _packed(c[own]), _packed(n), _packed(three[at]), _packed(c3[at])))
            kinds = [pa.int32(), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["shard", "pairs", "counts", "many", "thirds", "counts3"])

    return run


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, book of at most 256 means): equal shares of the sorted values."""
    edges = np.unique(np.quantile(values, np.linspace(0, 1, 257)[1:-1])) if len(values) else np.zeros(0)
    codes = np.searchsorted(edges, values, "left")
    n = np.bincount(codes, minlength=256)
    return codes.astype(np.uint8), np.bincount(codes, weights=values, minlength=256) / np.maximum(n, 1)


def _relative(parent: np.ndarray, value: np.ndarray, parents: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(pointers of each parent, values on top of the last one of the parent before, past the last) of children sorted by (parent, value)."""
    pointer = np.searchsorted(parent, np.arange(parents + 1))
    if not len(value):
        return pointer, value, 0
    begins = pointer[:-1][pointer[1:] > pointer[:-1]]
    sizes = np.diff(np.append(begins, len(value)))
    top = np.cumsum(value[begins + sizes - 1] + 1)
    return pointer, value + np.repeat(np.concatenate(([0], top[:-1])), sizes), int(top[-1])


def _writing_trie(model: Model):
    def run(batches):
        for shard, parts in _by_shard(batches):
            flats, ns, many, thirds, ns3 = [], [], [], [], []
            for p in parts:
                flats += [EliasFano.load(x).all() for x in p.column(1).to_pylist()]
                for col, to in zip(range(2, 6), (ns, many, thirds, ns3), strict=True):
                    to += [np.frombuffer(zlib.decompress(x), np.uint32) for x in p.column(col).to_pylist()]
            flat, rank = np.unique(np.concatenate(flats), return_inverse=True)
            n = np.bincount(rank.ravel(), np.concatenate(ns)).astype(np.int64)
            key3 = np.repeat(rank.ravel(), np.concatenate(many)).astype(U) << U(32) | np.concatenate(thirds).astype(U)
            order = np.argsort(key3, kind="stable")
            key3, n3 = key3[order], np.concatenate(ns3)[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], key3[1:] != key3[:-1]))) if len(key3) else np.zeros(0, np.int64)
            key3, n3 = key3[first], np.add.reduceat(n3, first) if len(first) else n3
            pair3, three = (key3 >> U(32)).astype(np.int64), (key3 & U(0xFFFFFFFF)).astype(np.int64)
            one, two = (flat // U(model.distinct + 1)).astype(np.int64), (flat % U(model.distinct + 1)).astype(np.int64)
            logs = np.log10((n + model.mu * model.single(model.counts_of(two))) / (model.counts_of(one) + model.mu))
            inside = np.bincount(pair3, n3, len(flat))  # how often a pair has a token after it
            ones, node = np.unique(one, return_inverse=True)
            at2, twos, top2 = _relative(node.ravel(), two, len(ones))
            at3, threes, top3 = _relative(pair3, three, len(flat))
            code2, book2 = quantise(logs)
            left, book_left = quantise(np.log10(model.nu / (inside + model.nu)))
            code3, book3 = quantise(np.log10(n3 / (inside[pair3] + model.nu)))
            arrays = {"code2": code2, "book2": book2, "left": left, "book_left": 10**book_left, "code3": code3, "book3": 10**book3}
            for name, values, top in (("one", ones, model.distinct + 1), ("at2", at2, len(two) + 1), ("two", twos, top2 + 1), ("at3", at3, len(three) + 1), ("three", threes, top3 + 1)):
                arrays |= EliasFano.of(values, top).parts(name)
            write_arrays(f"{model.folder}/trie-{shard}.ef", arrays)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(two)], pa.int64())], ["shard", "pairs"])

    return run


def train(docs: DataFrame, text: str = "text", mu: float = MU, nu: float = NU) -> Model:
    """The model of all texts of docs (null: empty). Its files stay in the shared folder; where tasks haven't mounted that, each copies the
    shards it asks to its own temporary folder first. Ids are 32 bits wide: 2^32 - 1 distinct words or more raise an error."""
    spark = docs.sparkSession
    folder = scratch(spark, "trie")
    docs = docs.select(F.col(text).alias("text"))
    n = partitions(spark)
    counts = docs.mapInArrow(released(_counting), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "counts")
    bits = max(LEAST_BITS, (counts.count() // SHARD).bit_length())
    shard = F.shiftrightunsigned("hash", 64 - bits).cast("int")
    dealt = counts.select(shard.alias("shard"), "hash", "n").repartition(1 << bits, "shard").sortWithinPartitions("shard")
    sizes = {r.shard: r for r in materialize(dealt.mapInArrow(_writing_words(folder, bits), "shard int, words long, tokens long"), "words").collect()}  # a row per shard
    base = np.concatenate(([0], np.cumsum([sizes[s].words if s in sizes else 0 for s in range(1 << bits)]))).tolist()
    model = Model(folder, base, sum(r.tokens for r in sizes.values()), base[-1], 0, bits, mu=mu, nu=nu)
    if not model.distinct:
        return model
    if model.distinct >= (1 << 32) - 1:
        raise ValueError("2^32 - 1 distinct words or more: widen the ids")
    model.texts = int(model.look_up(np.array([END]))[1][0])
    model.shards = max(n, model.total // TOKENS)
    blocks = docs.mapInArrow(released(_grams(model)), "shard int, pairs binary, counts binary, many binary, thirds binary, counts3 binary").repartition(model.shards, "shard").sortWithinPartitions("shard")
    written = {r.shard for r in materialize(blocks.mapInArrow(released(_writing_trie(model)), "shard int, pairs long"), "shards").select("shard").collect()}  # a row per shard
    for s in set(range(model.shards)) - written:
        write_arrays(f"{folder}/trie-{s}.ef", {"code2": np.zeros(0, np.uint8)})
    return model


def _scoring(model: Model, names: list[str], col: int):
    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column(col))
            cols: list[list[np.ndarray]] = [[np.zeros(0)] for _ in range(4)]
            for i, j in pieces(at, PIECE):
                t, first = tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
                kinds, inverse = np.unique(t, return_inverse=True)
                inverse = inverse.ravel()
                kind_ids, kind_counts = model.look_up(kinds) if model.distinct else (np.full(len(kinds), -1), np.zeros(len(kinds), np.int64))
                kind_base = np.log10(model.single(kind_counts))
                ids, counts, logs = kind_ids[inverse], kind_counts[inverse], kind_base[inverse]
                before = np.concatenate(([0], ids[:-1]))
                before[first[:-1]] = model.distinct
                past = np.concatenate(([0], counts[:-1]))
                past[first[:-1]] = model.texts
                # unseen after a known word: its share of the smoothing mass; after an unknown one, p(w)
                value = logs + np.log10(model.mu / (past + model.mu))
                known = np.flatnonzero((ids >= 0) & (before >= 0)) if model.distinct else np.zeros(0, np.int64)
                if len(known):
                    key, where = np.unique(before[known].astype(U) << U(32) | ids[known].astype(U), return_inverse=True)
                    shard, place, stored, left = model.pairs((key >> U(32)).astype(np.int64), (key & U(0xFFFFFFFF)).astype(np.int64))
                    where = where.ravel()
                    seen = ~np.isnan(stored[where])
                    value[known[seen]] = stored[where[seen]]
                    # order three, where the pair of the two tokens before was seen
                    pair = np.full(len(ids), -1, np.int64)
                    pair[known[seen]] = where[seen]
                    past_pair = np.concatenate(([-1], pair[:-1]))
                    past_pair[first[:-1]] = -1
                    three = np.flatnonzero(past_pair >= 0)
                    p = past_pair[three]
                    share = np.zeros(len(three))
                    # a triple can't have been seen if its last two tokens weren't
                    may = np.flatnonzero(pair[three] >= 0)
                    key3, where3 = np.unique(p[may].astype(U) << U(32) | ids[three[may]].astype(U), return_inverse=True)
                    q = (key3 >> U(32)).astype(np.int64)
                    share[may] = model.third(shard[q], place[q], (key3 & U(0xFFFFFFFF)).astype(np.int64))[where3.ravel()]
                    value[three] = np.log10(share + left[p] * 10 ** value[three])
                cols[0].append(np.diff(first))
                cols[1].append(np.add.reduceat((counts > 0).astype(np.int64), first[:-1]))
                cols[2].append(np.add.reduceat(logs, first[:-1]))
                cols[3].append(np.add.reduceat(value, first[:-1]))
            got = [np.concatenate(c) for c in cols]
            kept = [c for i, c in enumerate(batch.columns) if i != col]
            more = [pa.array(got[0].astype(np.int64)), pa.array(got[1].astype(np.int64)), pa.array(np.full(len(got[0]), model.total, np.int64)), pa.array(got[2]), pa.array(got[3])]
            yield pa.RecordBatch.from_arrays([*kept, *more], names)

    return run


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens (words and the end), n_known, train_tokens, base_score and score added; columns of
    those names are replaced.

    A null or empty text is its end alone. Scores are log10 probabilities of the whole text. With nothing trained, N = V =
    0 and every token has probability 1. Repeated rows stay.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    docs = docs.drop(*[c for c in new if c != text])
    rest = [f for f in docs.schema if f.name != text]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "n_tokens long", "n_known long", "train_tokens long", "base_score double", "score double"])
    return docs.mapInArrow(released(_scoring(model, [*(f.name for f in rest), *new], docs.columns.index(text))), kinds)


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the key as text leaves 2 modulo 7; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out()))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
