import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from usagelens.llm.elias_fano import EliasFano, open_arrays, write_arrays
from usagelens.llm import ngram_lm
from usagelens.llm.ngram_lm import MU, NU, held_out, quantise, score, train


def test_elias_fano_against_plain_arrays(tmp_path):
    r = np.random.default_rng(0)
    for u in (1, 5, 1000, 1 << 40, 1 << 60):
        for n in (0, 1, 2, 63, 64, 65, 1000):
            v = np.sort(r.integers(0, u, n, dtype=np.uint64))
            ef = EliasFano.of(v, u)
            write_arrays(str(tmp_path / "x"), ef.parts("a"))
            for e in (ef, EliasFano.load(ef.dump()), EliasFano.read(open_arrays(str(tmp_path / "x")), "a")):
                assert (e.all() == v).all()
                if n:
                    i = r.integers(0, n, 50)
                    assert (e.get(i) == v[i]).all()
                if n > 1:
                    i = np.sort(r.integers(0, n - 1, 50))
                    assert all((x == y).all() for x, y in zip(e.two(i), (v[i], v[i + 1]), strict=True))
                x = np.concatenate((r.integers(0, u, 50, dtype=np.uint64), v[:50]))
                assert (e.successor(x) == np.searchsorted(v, x)).all()
                a = r.integers(0, n + 1, len(x))
                b = np.minimum(n, a + r.integers(0, 9, len(x)))
                assert (e.successor(x, a, b) == np.clip(np.searchsorted(v, x), a, b)).all()


def test_quantised_values_are_near():
    v = np.random.default_rng(1).normal(size=5000)
    code, book = quantise(v)
    assert np.abs(book[code] - v).mean() < 0.02
    assert quantise(np.array([2.0, 2.0]))[1][quantise(np.array([2.0, 2.0]))[0]].tolist() == [2.0, 2.0]


def toks(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


@pytest.mark.parametrize("tokens", [4_000_000, 40])
def test_scores_against_brute_force(spark, tokens, monkeypatch):
    """With few tokens a shard there are many shards, and the followers of frequent words are dealt out."""
    monkeypatch.setattr(ngram_lm, "TOKENS", tokens)
    rnd = random.Random(6)
    vocab = ["a", "B", "ccc", "dd", "é", "f" * 300] + ["w%d" % i for i in range(60)]
    rows = [(i, " ".join(rnd.choices(vocab, weights=[1 / (k + 1) for k in range(len(vocab))], k=rnd.randrange(0, 60)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "never seen"), (903, "a\tb\n\x0bc"), (903, "a\tb\n\x0bc"), (None, "a a a")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, score int")
    model = train(docs.where(~held_out()))
    got = score(docs.withColumn("held_out", held_out()), model).collect()
    seen = [toks(r[1]) for r, g in zip(rows, got, strict=True) if not g.held_out]
    c = Counter(x for t in seen for x in t)
    pairs = Counter(p for t in seen for p in zip(["<s>", *t[:-1]], t, strict=True))
    triples = Counter(p for t in seen if len(t) > 1 for p in zip(["<s>", *t[:-2]], t[:-1], t[1:], strict=True))
    inside = Counter()
    for (u, v, _), n in triples.items():
        inside[u, v] += n
    total, distinct = sum(c.values()), len(c)
    past = Counter({**c, "<s>": len(seen)})
    assert any(g.held_out for g in got)
    for (d, t), g in zip(rows, got, strict=True):
        w = toks(t)
        single = [math.log10((c[x] + 1) / (total + distinct + 1)) for x in w]
        assert (g.doc_id, g.n_tokens, g.n_known, g.train_tokens) == (d, len(w), sum(c[x] > 0 for x in w), total)
        assert abs(g.base_score - sum(single)) < 1e-6
        second = [(pairs[p, x] + MU * 10**s) / (past[p] + MU) for p, x, s in zip(["<s>", *w[:-1]], w, single, strict=True)]
        third = [(triples[u, v, x] + NU * p) / (inside[u, v] + NU) for u, v, x, p in zip(["<s>", *w[:-2]], w[:-1], w[1:], second[1:], strict=True)] if len(w) > 1 else []
        exact = sum(map(math.log10, second[:1] + third))
        assert abs(g.score - exact) < 0.02 * len(w) + 1e-6  # quantised


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = score(docs, train(docs.limit(0))).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert score(docs.limit(0), train(docs)).count() == 0
