"""BPE encoding and decoding with a pair occurrence index (operator 8).

All distinct words of a batch are merged together: an index maps each adjacent pair to all its positions, a heap
holds the active ranks, and the lowest rank's merge is applied at all its positions at once, which updates the lists
of the neighbouring pairs.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Words kept in a worker's memory with their ids and tokens: about 150 MB.
MEMO = 300_000
# Characters on which Python's NFC, white space, lower case and letter classes surely agree with the library's.
_ODD = re.compile(f"[^\t-\r -~¡-ňŊ-ſ]|İ|[{chr(0x1C)}-{chr(0x1F)}]")
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9²³¹¼½¾]|[^\\s{_LETTER}0-9²³¹¼½¾]+")


def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte: itself if printable in Latin-1, else the next
    letter from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class PairIndexBPE:
    """ids of words (in byte letters, without the end mark) by the vocabulary and merges of a BPE model."""

    def __init__(self, model: dict):
        self.vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank_of = key[order], order
        self.left, self.right = left, right
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1: no merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank_of[at], -1)

    def encode(self, words: list[str]) -> list[list[int]]:
        """Empty words have no ids; letters outside the vocabulary are left out, as the model has no unknown token."""
        if not words:
            return []
        vocab, end = self.vocab, self.end
        sym: list[int] = []
        bounds = [0]
        for w in words:
            if w:
                sym += [vocab.get(c, -1) for c in w[:-1]]
                sym.append(vocab.get(w[-1] + end, -1))
            sym.append(-1)  # nothing merges across this mark
            bounds.append(len(sym))
        s = np.array(sym, np.int64)
        n = len(s)
        word = np.repeat(np.arange(len(words)), np.diff(bounds))
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        again: set[int] = set()

        def note(at: np.ndarray, ranks: np.ndarray) -> None:
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cut = np.flatnonzero(np.diff(ranks)) + 1
            for r, group in zip(ranks[np.concatenate(([0], cut))].tolist(), np.split(at, cut), strict=True):
                if r in lists:
                    lists[r].append(group)
                else:
                    lists[r] = [group]
                    heapq.heappush(heap, r)

        note(np.arange(n - 1), self.ranks(s[:-1], s[1:]))
        while heap:
            r = heapq.heappop(heap)
            groups = lists.pop(r)
            at = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
            a, b = self.left[r], self.right[r]
            nxt = after[at]
            live = (s[at] == a) & (s[np.minimum(nxt, n - 1)] == b)  # others have changed since they were listed
            at, nxt = at[live], nxt[live]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # runs of one symbol pair up from the left
                at = np.sort(at)
                keep, last = [], -1
                for p, q in zip(at.tolist(), after[at].tolist(), strict=True):
                    if p != last:
                        keep.append(p)
                        last = q
                at = np.array(keep)
                nxt = after[at]
            s[at] = self.made[r]
            s[nxt] = -2
            far = after[nxt]
            after[at] = far
            before[far[far < n]] = at[far < n]
            lefts = before[at]
            ok = lefts >= 0
            new_l = self.ranks(s[lefts[ok]], s[at[ok]])
            ok_r = far < n
            new_r = self.ranks(s[at[ok_r]], s[far[ok_r]])
            if len(new_l) and ((new_l >= 0) & (new_l < r)).any():
                again.update(word[at[ok][(new_l >= 0) & (new_l < r)]].tolist())
            if len(new_r) and ((new_r >= 0) & (new_r < r)).any():
                again.update(word[at[ok_r][(new_r >= 0) & (new_r < r)]].tolist())
            note(np.concatenate((lefts[ok], at[ok_r])), np.concatenate((new_l, new_r)))
        kept = s >= 0
        ids, sizes = s[kept].tolist(), np.bincount(word[kept], minlength=len(words))
        ends = np.cumsum(sizes).tolist()
        out = [ids[e - k : e] for e, k in zip(ends, sizes.tolist(), strict=True)]
        for i in again:  # a merge made a pair of lower rank: the order within that word matters
            out[i] = self.one(words[i])
        return out

    def one(self, w: str) -> list[int]:
        """One word, one merge at a time: lowest rank first, leftmost of equals."""
        s = [self.vocab.get(c, -1) for c in w[:-1]] + [self.vocab.get(w[-1] + self.end, -1)]
        while len(s) > 1:
            r = self.ranks(np.array(s[:-1]), np.array(s[1:]))
            if (r < 0).all():
                break
            i = int(np.where(r < 0, 1 << 40, r).argmin())
            s[i : i + 2] = [int(self.made[r[i]])]
        return [x for x in s if x >= 0]


class Codec:
    """Whole texts to ids and back, as the tokenizers library does with its file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError(f"{path} isn't a plain BPE file")
        self.library = Tokenizer.from_file(path)  # its normaliser and splitter serve texts with rare characters
        self.bpe = PairIndexBPE(spec["model"])
        self.token = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        self.letters = {chr(b): letters[b] for b in range(128)}
        self.byte = letters
        self.memo: dict[str, tuple[int, str, str]] = {}

    def _written(self, piece: str) -> str:
        return "".join(map(self.byte.__getitem__, piece.encode()))

    def _entries(self, chunks: list[list[str]]) -> list[tuple[int, str, str]]:
        """(count, ids, tokens) of each chunk, given as its pieces in byte letters."""
        distinct = list({p for c in chunks for p in c})
        ids = dict(zip(distinct, self.bpe.encode(distinct), strict=True))
        token, out = self.token, []
        for c in chunks:
            got = [i for p in c for i in ids[p]]
            out.append((len(got), " ".join(map(str, got)), " ".join(map(token.__getitem__, got))))
        return out

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids joined by spaces, decoded text) of each text."""
        plain, odd = [], []
        for i, t in enumerate(texts):
            if _ODD.search(t) or (self.at_special and "<|" in t and self.at_special.search(t)):
                odd.append(i)
            else:
                plain.append((i, t.lower().split()))
        fresh = {w for _, ws in plain for w in ws} - self.memo.keys()
        if len(self.memo) + len(fresh) > MEMO:
            self.memo = {}
            fresh = {w for _, ws in plain for w in ws}
        names = list(fresh)
        self.memo.update(zip(names, self._entries([[self._written(p) for p in _SPLIT.findall(w)] for w in names]), strict=True))
        out: list = [(0, "", "")] * len(texts)
        get = self.memo.__getitem__
        for i, ws in plain:
            if ws:
                n, ids, tokens = zip(*map(get, ws), strict=True)
                out[i] = (sum(n), " ".join(ids), " ".join(tokens))
        for i in odd:
            parts = []
            for k, part in enumerate(self.at_special.split(texts[i]) if self.at_special else [texts[i]]):
                if k % 2:
                    parts.append((1, str(self.special[part]), part))
                elif part:
                    normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                    parts += self._entries([[p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]])
            parts = [p for p in parts if p[0]]
            out[i] = (sum(p[0] for p in parts), " ".join(p[1] for p in parts), " ".join(p[2] for p in parts))
        return out

    def ids(self, text: str) -> list[int]:
        return [int(x) for x in self.encode([text])[0][1].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: the file has no decoder. Unknown ids are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


@lru_cache(2)
def worker_codec(path: str) -> Codec:
    """One for each worker process: later tasks find its vocabulary and its remembered words."""
    return Codec(path)


def _encoding(path: str, text: str, digests: bool):
    def run(batches):
        codec = worker_codec(path)
        for batch in batches:
            col = batch.schema.get_field_index(text)
            got: list[tuple[int, str, str]] = []
            out = []
            for a in range(0, batch.num_rows, 1024):
                got = codec.encode([t or "" for t in batch.column(col).slice(a, 1024).to_pylist()])
                if digests:
                    out += [(n, hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for n, i, d in got]
                else:
                    out += [(n, [int(x) for x in i.split()], d) for n, i, d in got]
            n, x, y = ([r[k] for r in out] for k in range(3))
            kept = [c for i, c in enumerate(batch.columns) if i != col]
            names = [c for i, c in enumerate(batch.schema.names) if i != col]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(x, pa.string() if digests else pa.list_(pa.int64())), pa.array(y, pa.string())], [*names, "n_tokens", "ids_sha256" if digests else "ids", "decoded_sha256" if digests else "decoded"])

    return run


def encode(docs: DataFrame, tokenizer: str, text: str = "text", digests: bool = False) -> DataFrame:
    """docs without the text, with n_tokens, ids (array) and decoded (string), or with digests their SHA-256 in
    lowercase hex (ids: decimal, joined by one space). Columns of those names are replaced.

    A null text counts as empty: 0 ids, empty text. Texts are encoded whole; strings of special tokens in them become
    those tokens, as the library does by default. Repeated rows stay.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    docs = docs.drop(*[n for n in names if n != text])
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    kinds = ["long", "string", "string"] if digests else ["long", "array<long>", "string"]
    schema = ", ".join(x for x in [rest, *[f"{n} {k}" for n, k in zip(names, kinds, strict=True)]] if x)
    return docs.mapInArrow(_encoding(tokenizer, text, digests), schema)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True)
