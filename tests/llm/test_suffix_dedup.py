import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from usagelens.llm import suffix_dedup
from usagelens.llm.suffix_dedup import Suffixes, remove_repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdeéñ") for _ in range(rnd.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(60) for _ in range(4)]
    texts = []
    for i in range(120):
        t = prose(rnd.randrange(5, 150))
        if i % 3 == 0:
            s = rnd.choice(shared)
            a = rnd.randrange(len(s) // 2)
            t = t + s[a : a + rnd.randrange(150, 400)] + prose(20)
        if i % 7 == 0 and texts:  # a near copy
            t = list(rnd.choice(texts) or "x")
            t[rnd.randrange(len(t))] = "#"
            t = "".join(t)
        texts.append(t)
    texts += [texts[5], texts[5], None, "", "short", "ab" * 400, "z" * 199, "z" * 200, "z" * 201, "q" * 1000, "line of text\n" * 40, texts[9] * 2]
    return texts


@pytest.mark.parametrize("hot", [4096, 3])
def test_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    if hot == 3:
        monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "x"), (None, None)], "doc_id long, text string")
    assert remove_repeats(docs.limit(0)).count() == 0
    assert [(r.n_bytes, r.n_removed) for r in remove_repeats(docs).orderBy("doc_id").collect()] == [(0, 0), (1, 0)]


def test_long_text_is_worked_through_in_steps(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "STEP", 500)
    rnd = np.random.default_rng(0)
    text = rnd.integers(97, 123, 5000, dtype=np.uint8)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([2], pa.int64()), pa.array([text.tobytes().decode()])], ["d", "n", "text"])
    (cols,) = suffix_dedup._rows([batch], 200, np.zeros(0, np.int64))
    windows = sorted(w for ws, k in zip(cols[4], cols[5], strict=True) for w in range(ws, ws + k))
    assert windows == list(range(4801))


def test_clashing_names_and_repeated_rows(spark):
    line = "the same words again and again, " * 10
    docs = spark.createDataFrame([(1, line, 7, 8, 9, 10), (1, line, 7, 8, 9, 10), (2, "x" + line[:150], 1, 2, 3, 4)], "d long, text string, n int, _d int, rest int, spans int")
    got = remove_repeats(docs).orderBy("d").collect()
    assert [(r.d, r.n, r._d, r.rest, r.n_bytes, r.n_removed) for r in got] == [(1, 7, 8, 9, 320, 320)] * 2 + [(2, 1, 2, 3, 151, 0)]


def test_an_anchor_in_every_task(spark, monkeypatch):
    """A passage that each of many tasks holds a few times, all in different surroundings."""
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(230))
    texts = ["".join(rnd.choice("abcdefgh ") for _ in range(300)) + passage + "".join(rnd.choice("abcdefgh ") for _ in range(200)) for _ in range(240)]
    monkeypatch.setattr(suffix_dedup, "HOT", 100)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 2)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(24)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)


def test_a_long_repetitive_text(spark):
    """20 MB: a line over and over, with a number in between that makes each place a range of its own."""
    text = "".join(f"{'a line that comes again and again in this text, ' * 5}{i * 7919 % 1_000_003}\n" for i in range(80_000))
    got = remove_repeats(spark.createDataFrame([(1, text), (2, text[:50_000]), (3, "short")], "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert by[2].n_removed == 50_000 and by[3].n_removed == 0
    assert by[1].n_bytes == len(text) and by[1].n_removed > 0.9 * len(text)


def test_twins_are_compared_by_their_bytes():
    text = np.frombuffer(b"abcdeabcdfabc", np.uint8)
    at, size, first = np.array([5, 5, 10, 5]), np.array([4, 5, 3, 1]), np.zeros(4, np.int64)
    assert suffix_dedup._unequal(text, at, size, first).tolist() == [False, True, False, False]
    assert suffix_dedup._unequal(text, at[:0], size[:0], first[:0]).tolist() == []


def test_suffix_sort_orders_by_content():
    r = np.random.default_rng(1)
    text = r.integers(97, 99, 4000, dtype=np.uint8)
    s = Suffixes(text, 16)
    at = r.permutation(3900)
    group = np.sort(r.integers(0, 5, len(at)))
    got = s.sort(at, group)
    for g in range(5):
        strings = [text[p : p + 16].tobytes() for p in got[group == g]]
        assert strings == sorted(strings) and sorted(got[group == g]) == sorted(at[group == g])
    many = [text[p : p + 16].tobytes() for p in at]
    count = Counter(zip(group, many, strict=True))
    assert (s.repeated(at, group) == np.array([count[g, m] > 1 for g, m in zip(group, many, strict=True)])).all()
