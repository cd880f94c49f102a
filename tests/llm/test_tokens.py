"""Operators 7 and 8 against the library itself."""

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from usagelens.llm import token_counts as token_counts_module
from usagelens.llm.base import scratch
from usagelens.llm.bpe import Codec, encode
from usagelens.llm.token_counts import Counter, token_counts

TEXTS = [
    "", " ", "  ", "a", "Hello world", "it's we'll I'D  'S ''s", "x\n y", "x\n \ny", "a   b", "a \nb", "tail  ", "\t\ttab", "été ÀÉÎ ñandú ¿qué? ½ ²",
    "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "<|endoftext", "日本語のテキスト", "e\u0301a\u030a", "\u2028x\u00a0y\u0085z", "İstanbul ŉ ß ẞ Σίσυφος ΣΑΣ", "\x1c\x1d a", "aaaaaaaa aaaa",
    "lololololo hahahahaha", "123 4567 8,9.0", "!!??...---", "🙂🙂 ok", "\x00\x01", "á" * 50, "ab" * 5000, "word " * 3000, "ﬁ ﬃ", "\ufffd", "ÀÀÀÀ ãããã", "don't can't won't've", "ªº µ",
]


def texts():
    rnd = random.Random(5)
    alphabet = "abcdehlnoréñ THE ' \n\t.,!12²" + "ing the and"
    return TEXTS + ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(400))) for _ in range(400)] + ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 600), rnd.randrange(0x300, 0x3000)])) for _ in range(60)) for _ in range(200)]


def test_counts_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    assert Counter(path).counts(texts()) == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts()]


def test_columns_count_as_the_library(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    some = [None, *texts(), "end\n ", "end \n", "x\n\n ", "a ", " b", None, "the end\n "] * 2
    want = [len(tok.encode(t or "", add_special_tokens=False).ids) for t in some]
    assert Counter(path).column(pa.array(some)).to_pylist() == want
    assert Counter(path).column(pa.array(some)[5:-3]).to_pylist() == want[5:-3]
    assert Counter(path).column(pa.array(some[:0], pa.string())).to_pylist() == []
    monkeypatch.setattr(token_counts_module, "RUN", 500)
    monkeypatch.setattr(token_counts_module, "MEMO", 20)
    assert Counter(path).column(pa.array(some)).to_pylist() == want


def test_words_are_looked_up_once_in_a_run():
    counter, seen = Counter(public_tokenizers.path("byte_bpe_50k.json")), []
    led = counter._led
    counter._led = lambda words: seen.extend(words.to_pylist()) or led(words)
    counter.column(pa.array([f"a the end of{i % 7}" for i in range(3_000)]))
    assert sorted(seen) == sorted({"the", "end", *(f"of{i}" for i in range(7))})


def test_remembered_words_stay_small():
    counter, letters, before = Counter(public_tokenizers.path("byte_bpe_50k.json")), str.maketrans("0123456789", "aeinorstlu"), pa.total_allocated_bytes()
    tracemalloc.start()
    for a in range(0, 500_000, 20_000):
        counter.counts([" ".join(f"x{i}".translate(letters) + "," for i in range(a, a + 20_000))])
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 30e6


def test_ids_and_decoding_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, codec = Tokenizer.from_file(path), Codec(path)
    for t, (n, ids, decoded) in zip(texts(), codec.encode(texts()), strict=True):
        want = tok.encode(t, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and n == len(want), t
        assert decoded == tok.decode(want, skip_special_tokens=False), t
        assert codec.decode(want) == decoded


def test_pair_index_equals_one_merge_at_a_time():
    codec = Codec(public_tokenizers.path("word_bpe_49k.json"))
    words = ["aaaaa", "aaaa", "thththth", "inininin", "nationalization", "xyzzyxyzzy", "hhhh", "", "q"]
    assert codec.bpe.encode(words) == [codec.bpe.one(w) if w else [] for w in words]


def test_token_counts_cache_nulls_and_repeats(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, None, None), (3, "", "y"), (4, "new text", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    cache = scratch(spark, "cache")
    first = sorted(map(tuple, token_counts(docs.limit(4), path, cache).select("doc_id", "n_bytes", "n_tokens").collect()), key=str)
    assert first == sorted([(1, 11, 2), (1, 11, 2), (None, 0, 0), (3, 0, 0)], key=str)
    token_counts(docs, path, cache).count()
    assert spark.read.parquet(cache).count() == 3  # hello world, the empty text, new text: each encoded once
    assert token_counts(docs.limit(0), path, scratch(spark, "cache")).count() == 0


def test_encode_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "the end", "s"), (1, "the end", "s"), (None, None, None)], "doc_id long, text string, ids string")
    got = encode(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(got) == 3 and got[0].ids == got[1].ids and got[0].decoded == "the</w> end</w>"
    assert (got[2].n_tokens, got[2].ids, got[2].decoded) == (0, [], "")
