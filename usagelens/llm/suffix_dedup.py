"""Removal of repeated substrings by a hash-compared suffix sort (operator 1).

A window is a string of LENGTH bytes of one text; a byte goes if a window over it also starts elsewhere.

Texts are known by 128 bits (d, n), two hashes of theirs.
1. Anchors. In every window the leftmost smallest hash among its 64-byte grams is its anchor; equal windows have equal
   anchors at equal offsets, and runs of neighbouring windows share one. So one row per run (about 1.5 % of the bytes)
   is shuffled by anchor instead of one per window. A task sends a run once, however often it holds it.
2. Runs alone with their anchor are unique. Runs with an equal twin (anchor and context digest, 128 bits together) repeat
   throughout; twins of one task are compared byte by byte.
3. What is left meets text that differs nearby. There the contexts are fetched, and the suffixes that start
   at their windows are sorted by a mergesort whose comparisons find the common extension by binary search over prefix
   polynomial hashes. Neighbours that agree over LENGTH bytes are compared byte by byte before they count.
Anchors with too many runs for one task are dealt out by window instead: their windows' two 64-bit hashes are the key. A sample of the runs
finds those anchors; it decides only which of the two ways a window is judged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize, mix, partitions, powers, released, utf8

LENGTH = 200
STEP, FLUSH = 1 << 19, 300_000
SECOND = 0xC2B2AE3D27D4EB4F
#: An anchor with about this many runs at least, or this share of all, is dealt out by window: a million anchors at most, 8 MB. One run in
#: SAMPLE is counted.
HOT, HOT_SHARE, SAMPLE = 4096, 1 / (1 << 20), 64
ROW = ["key", "sub", "d", "n", "ws", "k", "off", "w"]
ROW_SCHEMA = "key long, sub long, d long, n long, ws int, k int, off int, w int"


def _prefix(data: np.ndarray, base: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1, base) if base else powers(len(data) + 1)
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=p[1:])
    return p, down


def runs(data: np.ndarray, starts: np.ndarray, length: int) -> tuple:
    """Runs of windows with one anchor. data: texts one after another, starts: of each, and the end.

    Returns (first window, past the last, offset of the anchor in the first window, anchor hash, context hash, prefix, down).
    """
    gram = max(1, length * 8 // 25)
    wide, n = length - gram + 1, len(data)
    prefix, down = _prefix(data)
    h = mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    low = np.uint64((1 << 24) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= wide:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if wide > span:
        m = np.minimum(m[: len(m) - (wide - span)], m[wide - span :])
    at = (m & low).astype(np.int64)
    change = np.zeros(n + 2, np.int32)
    sizes = np.diff(starts)
    long = sizes >= length
    np.add.at(change, starts[:-1][long], 1)
    np.add.at(change, starts[1:][long] - length + 1, -1)
    valid = np.cumsum(change)[: len(at)] > 0
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
    old = valid.copy()
    old[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
    ws, we = np.flatnonzero(new), np.flatnonzero(old) + 1
    a = at[ws]
    context = mix((prefix[we - 1 + length] - prefix[ws]) * down[ws] + (we - ws).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (a - ws).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return ws, we, a - ws, h[a], context, prefix, down


def _rows(batches, length: int, hot: np.ndarray, texts: list | None = None):
    """Columns of ROW (without w) for about FLUSH runs at a time; batches: d, n, text. With texts, that list holds the bytes that the runs
    come from, and a last column says where in them each run begins."""
    acc: list[list[np.ndarray]] = []
    held = 0
    for batch in batches:
        data, at = utf8(batch.column(2))
        ident, second_ident = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        parts, sizes = [], 0

        def work(parts):
            starts = np.concatenate(([0], np.cumsum([e - s for _, s, e in parts])))
            joined = np.concatenate([data[s:e] for _, s, e in parts])
            ws, we, off, ha, hc, prefix, down = runs(joined, starts, length)
            seg = np.searchsorted(starts, ws, "right") - 1
            doc = np.array([i for i, _, _ in parts])[seg]
            first = np.array([s for _, s, _ in parts])[seg] - at[doc] - starts[seg]  # from a place here to one in the text
            cols = [ha.view(np.int64), hc.view(np.int64), ident[doc], second_ident[doc], ws + first, we - ws, off]
            if texts is not None:
                cols.append(ws + sum(map(len, texts)))
                texts.append(joined)
            many = np.isin(cols[0], hot) if len(hot) else np.zeros(len(ws), bool)
            if many.any():
                second, down2 = _prefix(joined, SECOND)
                size = cols[5][many]
                w = np.repeat(ws[many] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                each = np.repeat(np.flatnonzero(many), size)
                one = mix((prefix[w + length] - prefix[w]) * down[w]).view(np.int64)
                two = mix((second[w + length] - second[w]) * down2[w]).view(np.int64)
                more = [one, two, cols[2][each], cols[3][each], w + first[each], np.ones(len(w), np.int64), np.full(len(w), -1)]
                if texts is not None:
                    more.append(w + sum(map(len, texts[:-1])))
                cols = [np.concatenate((c[~many], x)) for c, x in zip(cols, more, strict=True)]
            return cols

        for i in range(batch.num_rows):
            s, e = int(at[i]), int(at[i + 1])
            for a in range(s, e - length + 1, STEP):
                parts.append((i, a, min(e, a + STEP + length - 1)))
                sizes += parts[-1][2] - a
                if sizes >= STEP:
                    acc.append(work(parts))
                    held += len(acc[-1][0])
                    parts, sizes = [], 0
                    if held >= FLUSH:
                        yield [np.concatenate(c) for c in zip(*acc, strict=True)]
                        acc, held = [], 0
                        if texts is not None:
                            texts.clear()
        if parts:
            acc.append(work(parts))
            held += len(acc[-1][0])
    if held:
        yield [np.concatenate(c) for c in zip(*acc, strict=True)]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, start of each group of equal keys in it)."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _heavy(length: int):
    """(anchor, runs) of a sample of the different runs of each task, and (null, all its runs)."""

    def run(batches):
        for key, sub, d, n, ws, *_ in _rows(batches, length, np.zeros(0, np.int64)):
            order, starts = _groups(key, sub)
            one = order[starts]
            drawn = one[mix((sub[one] ^ d[one] ^ ws[one]).view(np.uint64)) % np.uint64(SAMPLE) == 0]
            anchors, counts = np.unique(key[drawn], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([None, *anchors.tolist()], pa.int64()), pa.array([len(starts), *counts.tolist()], pa.int64())], ["key", "runs"])

    return run


def _emit(cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 4 else pa.int32()) for i, c in enumerate(cols)], ROW)


def _unequal(text: np.ndarray, at: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which stretches of text differ from the stretch that begins at first, of the same size; a bounded number of bytes at a time."""
    out = np.zeros(len(at), bool)
    ends = np.cumsum(size)
    for a in range(0, len(at), 4096):
        i = np.arange(a, min(a + 4096, len(at)))
        begin = ends[i] - size[i] - (ends[a] - size[a])
        inside = np.arange(int(size[i].sum())) - np.repeat(begin, size[i])
        differ = text[np.repeat(at[i], size[i]) + inside] != text[np.repeat(first[i], size[i]) + inside]
        out[i] = np.add.reduceat(differ, begin) > 0
    return out


def _sending(length: int, hot: np.ndarray):
    """Runs for the shuffle: one of each kind with its weight (2: several), and what is known here to repeat (w = 0)."""

    def run(batches):
        texts: list[np.ndarray] = []
        for cols in _rows(batches, length, hot, texts):
            *cols, place = cols
            key, sub, d, n, ws, k, off = cols
            order, starts = _groups(key, sub)
            sizes = np.diff(np.append(starts, len(order)))
            # twins byte by byte: one that only its digests share gets a digest of its bytes
            text, lead = np.concatenate(texts), np.repeat(order[starts], sizes)
            pair = np.flatnonzero(order != lead)
            wide = k[order[pair]] - 1 + length
            wrong = order[pair][(k[order[pair]] != k[lead[pair]]) | _unequal(text, place[order[pair]], wide, place[lead[pair]])]
            if len(wrong):
                sub = cols[1] = sub.copy()
                for r in wrong.tolist():
                    sub[r] = np.frombuffer(hashlib.sha256(text[place[r] : place[r] + k[r] - 1 + length].tobytes()).digest()[:8], np.int64)[0]
                order, starts = _groups(key, sub)
                sizes = np.diff(np.append(starts, len(order)))
            one = order[starts]
            yield _emit([*(c[one] for c in cols), np.minimum(sizes, 2)])
            again = order[np.repeat(sizes >= 2, sizes)]
            if len(again):
                o = again[np.lexsort((ws[again], n[again], d[again]))]
                fresh = np.ones(len(o), bool)
                fresh[1:] = (d[o[1:]] != d[o[:-1]]) | (n[o[1:]] != n[o[:-1]]) | (ws[o[1:]] != ws[o[:-1]])
                o = o[fresh]
                begin = np.ones(len(o), bool)
                begin[1:] = (d[o[1:]] != d[o[:-1]]) | (n[o[1:]] != n[o[:-1]]) | (ws[o[1:]] != ws[o[:-1]] + k[o[:-1]])
                b = np.flatnonzero(begin)
                last = np.append(b[1:], len(o)) - 1
                z = np.zeros(len(b), np.int64)
                yield _emit([d[o[b]] ^ ws[o[b]], z, d[o[b]], n[o[b]], ws[o[b]], ws[o[last]] + k[o[last]] - ws[o[b]], z, z])

    return run


def _judging(batches):
    """Rows sorted by (key, sub) to (d, n, ws, k, key, need): need is null for windows that repeat, true for windows
    to be judged by their context, false for contexts to compare with."""
    names = ["d", "n", "ws", "k", "key", "need"]

    def judge(c):
        key, sub, d, n, ws, k, off, w = c
        known = w == 0
        out = [(d[known], n[known], ws[known], k[known], np.zeros(known.sum(), np.int64), None)]
        rest = np.flatnonzero(~known)
        if len(rest):
            key, sub, d, n, ws, k, off, w = (x[rest] for x in c)
            order, starts = _groups(key, sub)
            sizes = np.diff(np.append(starts, len(order)))
            weight = np.add.reduceat(w[order], starts)
            twice = np.repeat(weight >= 2, sizes)
            o = order[twice]
            out.append((d[o], n[o], ws[o], k[o], np.zeros(len(o), np.int64), None))
            kinds = np.unique(key[order[starts]], return_inverse=True, return_counts=True)
            single = np.bincount(kinds[1], weights=(weight < 2) & (off[order[starts]] >= 0), minlength=len(kinds[0]))
            mixed = ((kinds[2] >= 2) & (single > 0))[kinds[1]] & (off[order[starts]] >= 0)
            o = order[starts[mixed]]
            need = weight[mixed] < 2
            for flag in (True, False):
                p = o[need == flag]
                out.append((d[p], n[p], ws[p], k[p], key[p], flag))
        sizes = [len(x[0]) for x in out]
        flags = [f for x, s in zip(out, sizes, strict=True) for f in [x[5]] * s]
        return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate([x[i] for x in out]), pa.int64() if i in (0, 1, 4) else pa.int32()) for i in range(5)), pa.array(flags, pa.bool_())], names)

    kept = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if kept is not None:
            cols = [np.concatenate(p) for p in zip(kept, cols, strict=True)]
        if not len(cols[0]):
            continue
        whole = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
        if whole:
            yield judge([c[:whole] for c in cols])
        kept = [c[whole:] for c in cols]
    if kept is not None:
        yield judge(kept)


class Suffixes:
    """Suffix sort of window starts within groups, comparisons by prefix hashes."""

    def __init__(self, text: np.ndarray, length: int):
        self.text, self.length = np.concatenate((text, np.zeros(8, np.uint8))), length
        self.prefix, self.down = _prefix(self.text)
        words = np.lib.stride_tricks.sliding_window_view(self.text, 8)[: len(text) + 1]
        self.head = np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at i and j, up to length."""
        got, p, down = np.zeros(len(i), np.int64), self.prefix, self.down
        step = 1 << (self.length.bit_length() - 1)
        while step:
            ok = np.flatnonzero(got + step <= self.length)
            a, b = i[ok] + got[ok], j[ok] + got[ok]
            same = (p[a + step] - p[a]) * down[a] == (p[b + step] - p[b]) * down[b]
            got[ok[same]] += step
            step >>= 1
        return got

    def less(self, i: np.ndarray, j: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether the suffix at i comes before that at j; ties: what counts if they agree over length."""
        out = self.head[i] < self.head[j]
        equal = np.flatnonzero(self.head[i] == self.head[j])
        if len(equal):
            a, b = i[equal], j[equal]
            n = self.common(a, b)
            out[equal] = np.where(n >= self.length, ties[equal], self.text[a + np.minimum(n, self.length - 1)] < self.text[b + np.minimum(n, self.length - 1)])
        return out

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Bottom-up mergesort of at within each group (groups are contiguous); all merges of a level run together."""
        at = at.copy()
        n = len(at)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        size = np.diff(np.append(first, n))
        begin, count = np.repeat(first, size), np.repeat(size, size)
        inside = np.arange(n) - begin
        wide = 1
        while wide < size.max():
            mine = inside // wide
            other = mine ^ 1
            lo0 = begin + np.minimum(other * wide, count)
            hi0 = begin + np.minimum((other + 1) * wide, count)
            lo, hi = lo0.copy(), hi0.copy()
            left = (mine & 1) == 0
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                # a left item goes before equal right ones
                before = self.less(at[mid], at[open_], ~left[open_])
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            to = begin + (mine & ~1) * wide + (inside - mine * wide) + (lo - lo0)
            out = np.empty_like(at)
            out[to] = at
            at = out
            wide *= 2
        return at

    def repeated(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Which suffixes agree over length with another of their group (their own place excepted)."""
        order = np.argsort(group, kind="stable")
        sorted_ = self.sort(at[order], group[order])
        place = np.empty(int(at.max()) + 1, np.int64)
        place[at] = np.arange(len(at))
        g = group[order]
        near = np.flatnonzero(g[1:] == g[:-1])
        near = near[self.common(sorted_[near], sorted_[near + 1]) >= self.length]
        hit = np.zeros(len(at), bool)
        for a in range(0, len(near), 4096):  # byte by byte
            k = near[a : a + 4096]
            i, j = sorted_[k], sorted_[k + 1]
            span = np.arange(self.length)
            same = (self.text[i[:, None] + span] == self.text[j[:, None] + span]).all(axis=1)
            if not same.all():  # hashes collided: these groups again, by their bytes
                for bad in np.unique(g[k[~same]]):
                    seen: dict[bytes, list[int]] = {}
                    for p in at[group == bad]:
                        seen.setdefault(self.text[p : p + self.length].tobytes(), []).append(int(place[p]))
                    for same_text in seen.values():
                        if len(same_text) > 1:
                            hit[same_text] = True
            hit[place[i[same]]] = hit[place[j[same]]] = True
        return hit


def _contexts(length: int):
    """(d, n, asks, text) to one row per context."""

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column(3))
            d, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for i, asks in enumerate(batch.column(2).to_pylist()):
                for a in asks:
                    s = int(at[i]) + a["ws"]
                    out.append((a["key"], d[i], n[i], a["ws"], a["k"], a["need"], data[s : s + a["k"] - 1 + length].tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["key", "d", "n", "ws", "k", "need", "context"])

    return run


def _sorting(length: int):
    """Contexts sorted by key to the windows (d, n, ws, k) that repeat."""

    def judge(rows):
        rows = list({(r[0], r[1], r[2], r[3], r[4]): r for r in rows}.values())  # copies of a text fetch the same
        keys = {k: i for i, k in enumerate(dict.fromkeys(r[0] for r in rows))}
        text = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
        ends = np.cumsum([len(r[6]) for r in rows])
        starts = ends - [len(r[6]) for r in rows]
        k = np.array([r[4] for r in rows])
        row = np.repeat(np.arange(len(rows)), k)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
        at = starts[row] + inside
        hit = Suffixes(text, length).repeated(at, np.array([keys[r[0]] for r in rows])[row])
        hit &= np.array([r[5] for r in rows])[row]
        begin = hit.copy()
        begin[1:] &= ~hit[:-1] | (row[1:] != row[:-1])
        stop = hit.copy()
        stop[:-1] &= ~hit[1:] | (row[1:] != row[:-1])
        b, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        d, n, ws = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 3))
        return pa.RecordBatch.from_arrays([pa.array(d[row[b]], pa.int64()), pa.array(n[row[b]], pa.int64()), pa.array(ws[row[b]] + inside[b], pa.int32()), pa.array(e - b, pa.int32())], ["d", "n", "ws", "k"])

    def run(batches):
        held: list = []
        size = 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > 1_000_000 and r[0] != held[-1][0]:
                    yield judge(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield judge(held)

    return run


#: The second seed of a text's hashes.
SEED = 0x5EED


def _spans(length: int):
    """(d, n, ranges [start, stop) sorted by start) to their unions."""

    def run(batches):
        for batch in batches:
            out = []
            for ranges in batch.column(2).to_pylist():
                merged: list[dict] = []
                for r in ranges:
                    if merged and merged[-1]["stop"] >= r["start"]:
                        merged[-1]["stop"] = max(merged[-1]["stop"], r["stop"])
                    else:
                        merged.append(r)
                out.append(merged)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], ["d", "n", "spans"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """(d, n, spans): the maximal byte ranges [start, stop) to remove from each text that has any.

    d and n are xxhash64 of the text without and with a seed. Texts below length bytes, and null ones, have none. Copies of a text
    are other places: a text of length bytes or more that occurs twice is covered wholly.
    """
    spark = docs.sparkSession
    texts = docs.where(F.octet_length(F.col(text)) >= length).select(F.xxhash64(F.col(text)).alias("d"), F.xxhash64(F.lit(SEED), F.col(text)).alias("n"), F.col(text).alias("text"))
    heavy = texts.mapInArrow(released(_heavy(length)), "key long, runs long").groupBy("key").agg(F.sum("runs").alias("runs"))
    heavy = materialize(heavy, "heavy")
    total = heavy.where("key is null").agg(F.coalesce(F.sum("runs"), F.lit(0))).first()[0]
    least = max(HOT, int(total * HOT_SHARE)) // (2 * SAMPLE)  # half of what is expected: a hot anchor is missed with probability 10^-5 at HOT, none at twice that
    hot = np.array([r[0] for r in heavy.where(f"key is not null and runs >= {least}").select("key").collect()], np.int64)  # at most 2 / HOT_SHARE keys
    sent = texts.mapInArrow(released(_sending(length, hot)), ROW_SCHEMA)
    sent = sent.repartition(partitions(spark), "key").sortWithinPartitions("key", "sub")
    judged = materialize(sent.mapInArrow(released(_judging), "d long, n long, ws int, k int, key long, need boolean"), "judged")
    asks = judged.where("need is not null").groupBy("d", "n").agg(F.collect_list(F.struct("key", "ws", "k", "need")).alias("asks"))
    whole = texts.groupBy("d", "n").agg(F.first("text").alias("text"))
    contexts = asks.join(whole.hint("merge"), ["d", "n"]).select("d", "n", "asks", "text").mapInArrow(released(_contexts(length)), "key long, d long, n long, ws int, k int, need boolean, context binary")
    contexts = contexts.repartition(partitions(spark), "key").sortWithinPartitions("key")
    found = contexts.mapInArrow(released(_sorting(length)), "d long, n long, ws int, k int")
    windows = judged.where("need is null").select("d", "n", "ws", "k").union(found)
    ranges = F.array_sort(F.collect_list(F.struct(F.col("ws").alias("start"), (F.col("ws") + F.col("k") - 1 + length).alias("stop"))))
    merged = windows.groupBy("d", "n").agg(ranges.alias("ranges")).mapInArrow(_spans(length), "d long, n long, spans array<struct<start:int,stop:int>>")
    return materialize(merged, "spans")


def _cutting(names: list[str], as_text: bool):
    """The text without its spans, as bytes; the last two columns are spans and text."""

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column(batch.num_columns - 1))
            kept, removed, spans_n, sha = [], [], [], []
            for i, spans in enumerate(batch.column(batch.num_columns - 2).to_pylist()):
                raw = data[at[i] : at[i + 1]].tobytes()
                out, last = [], 0
                for s in spans or []:
                    out.append(raw[last : s["start"]])
                    last = s["stop"]
                out = b"".join([*out, raw[last:]])
                kept.append(out)
                removed.append(len(raw) - len(out))
                spans_n.append(len(spans or []))
                sha.append(hashlib.sha256(out).hexdigest())
            more = [pa.array([len(k) + r for k, r in zip(kept, removed, strict=True)], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans_n, pa.int64()), pa.array(sha, pa.string()), pa.array([k.decode(errors="ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*names, "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", as_text: bool = False) -> DataFrame:
    """docs without the text, with spans, n_bytes, n_removed, n_spans, kept_sha256 (lowercase hex) and kept (the bytes
    that are left, in order) added; columns of those names are replaced.

    A null text counts as empty. kept may begin or end within a character; with as_text it is a string without the bytes of
    characters cut through. Repeated rows stay.
    """
    new = ["spans", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    spans = repeated_spans(docs, length, text)
    rest = [c for c in docs.columns if c not in new and c != text]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), F.xxhash64(F.col(text)).alias("d"), F.xxhash64(F.lit(SEED), F.col(text)).alias("n"), F.col(text).alias("text"))
    both = rows.join(spans, ["d", "n"], "left").select("rest.*", "spans", "text")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return both.mapInArrow(released(_cutting(rest, as_text)), f"{kinds}, spans array<struct<start:int,stop:int>>, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {'string' if as_text else 'binary'}".lstrip(", "))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
