import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from usagelens.llm import langid
from usagelens.llm.langid import SPAN, Network, fit, held_out, predict

A, B = "ka mi so tu ra ne".split(), "xel qor vyn zhu wex".split()


def corpus():
    r = random.Random(3)
    rows = [(i, " ".join(r.choices(A if i % 2 else B, k=r.randrange(3, 60))), "aa" if i % 2 else "bb") for i in range(400)]
    return rows + [(900, None, "aa"), (901, "", "bb"), (902, "12 !? 34", None), (903, "KA MI SO", None), (904, "xel qor " * 40_000, None), (None, "vyn zhu xel", None), (903, "KA MI SO", None)]


def test_gradient_by_differences():
    """Every gradient beside the difference of the loss, in double precision, with windows of unequal lengths."""
    net = Network(["a", "b", "c"], hidden=3, embed=2, seed=5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    windows, labels = [b"ka mi", b"x", b"\xc3\xa9 zz y"], np.array([0, 1, 2])
    _, grad = net.loss_and_gradient(windows, labels)
    used = sorted(set(b"".join(windows)))
    for name, p in net.p.items():
        places = [(b, j) for b in used for j in range(2)] if name == "E" else list(np.ndindex(p.shape))
        for at in places:
            old, step = p[at], 1e-6
            p[at] = old + step
            up, _ = net.loss_and_gradient(windows, labels)
            p[at] = old - step
            down, _ = net.loss_and_gradient(windows, labels)
            p[at] = old
            assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-7, (name, at)
    assert not grad["E"][[b for b in range(256) if b not in used]].any()


def test_every_byte_has_a_distribution():
    net = Network(["a", "b"], seed=2)
    text = ("é" * SPAN + " ka mi").encode()
    p = net.label([text, b"", b"x"])
    assert [len(x) for x in p] == [len(text), 0, 1] and all(np.allclose(x.sum(axis=1), 1, atol=1e-5) for x in p if len(x))
    # the state goes on across blanks: what stands before a word changes its labels
    one, two = (net.label([x])[0][-2:] for x in (b"ka mi", b"zz mi"))
    assert not np.allclose(one, two)
    # a text of many stretches: each byte depends on its stretch and the bytes around it only
    long = b"ka mi so " * 200
    again = net.label([b"x" * SPAN + long])[0]
    assert np.allclose(again[2 * SPAN : 3 * SPAN], net.label([long])[0][SPAN : 2 * SPAN], atol=1e-3)


def test_languages_are_told_apart(spark):
    docs = spark.createDataFrame([(d, t, lang, f"s{k}") for k, (d, t, lang) in enumerate(corpus())], "doc_id long, text string, lang string, lang_pred string")
    net = fit(docs, ~held_out(), steps=120)
    got = predict(docs.select("doc_id", "lang_pred", "text"), net).collect()
    assert len(got) == len(corpus())
    for (d, t, lang), r in zip(corpus(), got, strict=True):
        assert r.doc_id == d and r.text == t and 0 <= r.score <= 1
        if not t or d == 902:
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif lang is None:
            assert r.lang_pred == ("aa" if d == 903 else "bb")
    known = [(r.lang_pred == lang) for (d, t, lang), r in zip(corpus(), got, strict=True) if lang and t]
    assert np.mean(known) > 0.97
    assert predict(docs.limit(0), net).count() == 0
    assert fit(docs.limit(0), ~held_out()) is None
    assert [r.lang_pred for r in predict(docs.select("doc_id", "text").limit(3), None).collect()] == ["und"] * 3


def test_ties_go_to_the_first_language(spark):
    net = Network(["zz", "bb", "aa"])
    net.languages = sorted(net.languages)
    net.p["V"][:] = net.p["c"][:] = 0
    row = predict(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), net).first()
    assert row.lang_pred == "aa" and abs(row.score - 1 / 3) < 1e-6


FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: r for r in langid.op3_language_id(spark, FOLDER).collect()}
    rows = docs.where(F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}"))).select("doc_id", "lang").collect()
    assert len(got) == docs.count()
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    held = [got[r.doc_id].lang_pred == r.lang for r in rows if got[r.doc_id].held_out]
    assert len(held) > 100 and np.mean(held) > 0.97
