import math
import random
import re

import numpy as np
import pyarrow as pa

from usagelens.llm import near_dup
from usagelens.llm.base import utf8, words
from usagelens.llm.graph import components
from usagelens.llm.near_dup import BANDS, HASHES, LEAST, ROWS, SKETCH, estimate, near_duplicates, shingles, signature


def brute(rows, width, least=80):
    sets = []
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= least * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(x for x in (low.get(find(i)), d) if x is not None) if d is not None or low.get(find(i)) is not None else None
    return sorted([(d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows)], key=str)


def corpus():
    rnd = random.Random(2)
    vocab = ["w%d" % i for i in range(300)]
    rows, n = [], 0
    for _ in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.randrange(20, 120))]
        for _ in range(rnd.randrange(1, 12)):
            t = list(base)
            for _ in range(rnd.randrange(0, 6)):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            rows.append((n, " ".join(t)))
            n += 1
    rows += [(n, rows[0][1].upper().replace("W", "w")), (n + 1, None), (n + 2, ""), (n + 3, " \t\n "), (n + 4, "one"), (n + 5, "ONE"), (n + 6, "one two"), (n + 7, "é x"), (n + 7, "é x"), (None, "one two")]
    return rows


def test_components_against_brute_force(spark):
    for width in (2, 5):
        docs = spark.createDataFrame([(d, t, True) for d, t in corpus()], "doc_id long, text string, kept boolean")
        got = near_duplicates(docs, width=width).select("doc_id", "n_shingles", "component_id", "kept").collect()
        assert sorted(map(tuple, got), key=str) == brute(corpus(), width)
    assert near_duplicates(docs.limit(0)).count() == 0


def test_words_that_meet_under_polynomials_modulo_two_to_the_64():
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1 << 12))
    two = one.translate(str.maketrans("ab", "ba"))
    data, at = utf8(pa.array([one, two, one.upper(), f"{two} {one}"]))
    hashes, first = words(data, at)
    assert first.tolist() == [0, 1, 2, 3, 5]
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3]


def test_small_blocks_and_large_sets_give_the_same(spark, monkeypatch):
    """Blocks of few rows or shingles only deal the work out otherwise; here each outsider meets each other row in a block of its own."""
    docs = spark.createDataFrame([*corpus(), (5000, "v " * 200_000 + "long"), (5001, "LONG " + "v " * 200_000)], "doc_id long, text string")
    want = brute([*corpus(), (5000, "v " * 2000 + "long"), (5001, "LONG " + "v " * 2000)], 2)
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    monkeypatch.setattr(near_dup, "HEAVY", 50)
    got = near_duplicates(docs, width=2).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_long_words_and_documents():
    text = ("x" * 3_000_000 + " b " + "y z " * 700_000).encode()
    data = np.frombuffer(text + b"q r", np.uint8)
    sets = list(shingles(data, np.array([0, len(text), len(text) + 3]), 2))
    assert [len(s) for s in sets] == [4, 1]


def test_sketch_estimates_similarity():
    r = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        base = r.integers(0, 1 << 63, 1000, dtype=np.uint64)
        a, b = np.unique(base[:900]), np.unique(base[100:])
        _, _, s = signature([a, b])
        errors.append(float(estimate(s[0], s[1])) - 0.8)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(50, i) for i in range(51, 60)] + [(7, 7), (3, 90), (90, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 50 for i in range(50, 60)) and got[7] == 7 and got[90] == 3


def test_the_sketch_loses_far_less_than_the_bands():
    """The chance that a pair at 0.8 is estimated below LEAST: HASHES values differ with chance 0.2 each, and each that does flips two of SKETCH bits."""
    i = np.arange(SKETCH + 1)
    odd = np.zeros(SKETCH + 1)
    odd[0] = 1
    differ = np.zeros(SKETCH + 1)
    for unlike in range(HASHES + 1):
        differ += math.comb(HASHES, unlike) * 0.2**unlike * 0.8 ** (HASHES - unlike) * odd
        for _ in range(2):
            up, down = odd * (SKETCH - i) / SKETCH, odd * i / SKETCH
            odd = np.append(0, up[:-1]) + np.append(down[1:], 0)
    bits = np.packbits(np.arange(SKETCH) < i[:, None], axis=1).view(np.uint64)
    lost = differ[estimate(np.zeros_like(bits), bits) < LEAST].sum()
    assert abs(differ.sum() - 1) < 1e-9
    assert lost < 0.01 * (1 - 0.8**ROWS) ** BANDS
