import random

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from usagelens.llm import langid

from .test_near_dup import brute as near_groups
from .test_suffix_dedup import brute as repeats


def write(spark, path):
    rnd = random.Random(12)
    vocab = {"aa": ["the", "ing", "tion", "wh", "er"], "bb": ["der", "ung", "sch", "ein", "ö"]}
    prose = lambda k, n: " ".join("".join(rnd.choices(vocab[k], k=rnd.randrange(1, 4))) for _ in range(n))
    shared = prose("aa", 60)
    rows = []
    for i in range(160):
        k = "aa" if i % 2 else "bb"
        t = prose(k, rnd.randrange(20, 200))
        if i % 9 == 0:
            t = f"{t} {shared} {prose(k, 30)}"
        if i % 10 == 0 and i:
            w = rows[i - 2][1].split()
            w[0] = "changed"
            t = " ".join(w)
        rows.append((i, t, k, "s", len(t)))
    rows += [(300, None, "aa", "s", 0), (301, "12 34 !!", "aa", "s", 8), (302, rows[3][1], "aa", "s", 1), (302, rows[3][1], "aa", "s", 1), (303, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return docs


def test_run_against_brute_force(spark, tmp_path):
    docs = write(spark, str(tmp_path))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {(r.doc_id, r.text) for r in langid.predict(docs, langid.fit(docs, ~langid.held_out())).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    assert {300, 301, 303}.isdisjoint(d for d, _ in kept) and len(kept) >= 160
    rows = sorted(kept)
    left = {d for d, _, _, keep in near_groups(rows, 5) if keep}
    rows = [r for r in rows if r[0] in left]
    assert 302 not in left and len(rows) < len(kept)
    cuts = repeats([t for _, t in rows], 200)
    assert any(c[1] for c in cuts)
    stage = {d: t for d, t in rows}
    docs2 = spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for r, (n, removed, _, _) in zip(corpus_pipeline.repeated_passages(spark, docs2, "").orderBy("doc_id").collect(), cuts, strict=True):
        assert 0 <= n - removed - len(r.text.encode()) <= 6 and r.n_chars == len(r.text)
        stage[r.doc_id] = r.text
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: len(tok.encode(t, add_special_tokens=False).ids) for d, t in stage.items()}
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == want


def test_stages_on_empty_tables(spark, tmp_path):
    docs = write(spark, str(tmp_path)).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
