"""Language identification by a bidirectional gated recurrent network over bytes (operator 3).

The network reads the lower-cased text as it stands, blanks included. A text is read in stretches of SPAN bytes, each together with
WARM bytes of the text before and after it (to the next character), so a byte's state never begins at the byte's own stretch. Every byte
gets a distribution over the languages; a document's probabilities are the mean over the bytes of its letters. The network is trained
in numpy by backpropagation through time.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import released, utf8

SPAN, WARM = 224, 16
#: Characters of a training window, and rows that the network works on at a time.
WINDOW, ROWS = 64, 1024
#: Steps in which a share of the rows is drawn: fine enough for 10^12 rows of a language.
SHARES = 10**15
_ASCII_LETTER = re.compile("[A-Za-z]")
#: Bytes of letters: the ASCII ones, and all beyond ASCII.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Embedding, one gated recurrent layer each way, a linear layer and softmax at every position."""

    def __init__(self, languages: list[str], hidden: int = 8, embed: int = 8, seed: int = 7):
        r = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        p = {"E": r.normal(0, 0.5, (256, embed)), "V": r.normal(0, 0.3, (2 * hidden, len(languages))), "c": np.zeros(len(languages))}
        for d in "fb":
            p |= {f"W{d}": r.normal(0, 1 / np.sqrt(embed), (embed, 3 * hidden)), f"U{d}": r.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)), f"b{d}": np.zeros(3 * hidden)}
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    @staticmethod
    def rows(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(bytes padded to the longest, lengths)."""
        sizes = np.array([len(w) for w in windows])
        wide = int(sizes.max())
        return np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in windows), np.uint8).reshape(len(windows), wide), sizes

    def _run(self, x: np.ndarray, mask: np.ndarray | None, d: str, keep: list | None) -> np.ndarray:
        """Hidden states (time, row, hidden) in the order of x; where mask is 0 the state stays as it was."""
        h, p = self.hidden, self.p
        table, u = p["E"] @ p[f"W{d}"] + p[f"b{d}"], p[f"U{d}"]  # the input's part by table
        u_gates, u_new = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        state = np.zeros((x.shape[1], h), self.p["E"].dtype)
        out = np.zeros((x.shape[0], x.shape[1], h), state.dtype)
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            g = table[x[t]]
            rz = _sigmoid(g[:, : 2 * h] + state @ u_gates)
            r, z = rz[:, :h], rz[:, h:]
            rs = r * state
            n = np.tanh(g[:, 2 * h :] + rs @ u_new)
            m = 1 if mask is None else mask[t][:, None]
            new = state + m * z * (n - state)
            if keep is not None:
                keep.append((t, state, r, z, rs, n, m))
            state = out[t] = new
        return out

    def label(self, texts: list[bytes]) -> list[np.ndarray]:
        """The distribution over the languages of every byte of every (lower-cased) text."""
        out = [np.zeros((len(t), len(self.languages)), np.float32) for t in texts]
        data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        for probs, first, doc, start, size in self._stretches(data, at):
            for i in range(len(doc)):
                a = start[i] - at[doc[i]]
                out[doc[i]][a : a + size[i]] = probs[start[i] - first[i] : start[i] - first[i] + size[i], i]
        return out

    def _stretches(self, data: np.ndarray, at: np.ndarray):
        """(probabilities (time, row, language), first byte read, document, first own byte, own bytes) for the stretches of all texts."""
        sizes = np.diff(at)
        many = -(-sizes // SPAN)
        doc = np.repeat(np.arange(len(sizes)), many)
        start = at[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * SPAN
        stop = np.minimum(start + SPAN, at[doc + 1])
        first, last = np.maximum(start - WARM, at[doc]), np.minimum(stop + WARM, at[doc + 1])
        inner = np.append((data & 0xC0) == 0x80, False)  # within a character
        for _ in range(3):
            first = np.where(inner[first] & (first > at[doc]), first - 1, first)
            last = np.where(inner[last] & (last < at[doc + 1]), last + 1, last)
        order = np.argsort(last - first, kind="stable")  # rows of a batch are about as long
        for a in range(0, len(order), ROWS):
            k = order[a : a + ROWS]
            length = last[k] - first[k]
            t = np.arange(int(length.max()))[:, None]
            x = data[np.minimum(first[k] + t, len(data) - 1)]
            full = int(length.min()) == len(x)
            mask = None if full else (t < length).astype(np.float32)
            logits = self._run(x, mask, "f", None) @ self.p["V"][: self.hidden] + self.p["c"]
            logits += self._run(x, mask, "b", None) @ self.p["V"][self.hidden :]
            logits -= logits.max(axis=2, keepdims=True)
            e = np.exp(logits, out=logits)
            e /= e.sum(axis=2, keepdims=True)
            yield e, first[k], doc[k], start[k], stop[k] - start[k]

    def pooled(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each text the sum over the bytes of its letters of their distributions."""
        out = np.zeros((len(at) - 1, len(self.languages)))
        for probs, first, doc, start, size in self._stretches(data, at):
            t = np.arange(len(probs))[:, None]
            place = first + t
            own = (place >= start) & (place < start + size) & _LETTER[data[np.minimum(place, len(data) - 1)]]
            np.add.at(out, doc, np.einsum("tbc,tb->bc", probs, own.astype(np.float32)))
        return out

    def loss_and_gradient(self, windows: list[bytes], labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean cross entropy of all positions, and its gradient by backpropagation through time."""
        h, p = self.hidden, self.p
        x, sizes = self.rows(windows)
        xt = np.ascontiguousarray(x.T)
        mask = (np.arange(len(xt))[:, None] < sizes).astype(p["E"].dtype)
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self._run(xt, mask, d, kept[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        logits = both @ p["V"] + p["c"]
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        g = e / e.sum(axis=2, keepdims=True)
        rows = np.arange(len(windows))
        loss = float(-(np.log(g[:, rows, labels]) * mask).sum() / mask.sum())
        g[:, rows, labels] -= 1
        g *= (mask / mask.sum())[:, :, None]
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["V"] = np.einsum("tbh,tbc->hc", both, g)
        grad["c"] = g.sum((0, 1))
        back = g @ p["V"].T
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u, flow = p[f"U{d}"], np.zeros((len(windows), h), p["E"].dtype)
            gates = np.zeros((*xt.shape, 3 * h), p["E"].dtype)
            for t, state, rr, z, rs, n, m in reversed(kept[d]):
                flow = flow + back[t][:, part]
                dn = flow * m * z * (1 - n * n)
                dz = flow * m * (n - state) * z * (1 - z)
                drs = dn @ u[:, 2 * h :].T
                dr = drs * state * rr * (1 - rr)
                drz = np.concatenate([dr, dz], axis=1)
                grad[f"U{d}"][:, : 2 * h] += state.T @ drz
                grad[f"U{d}"][:, 2 * h :] += rs.T @ dn
                gates[t] = np.concatenate([drz, dn], axis=1)
                flow = flow * (1 - m * z) + drs * rr + drz @ u[:, : 2 * h].T
            grad[f"b{d}"] = gates.sum((0, 1))
            flat, ids = gates.reshape(-1, 3 * h), xt.reshape(-1)
            table = np.stack([np.bincount(ids, flat[:, j], 256) for j in range(3 * h)], axis=1).astype(p["E"].dtype)  # by input byte
            grad[f"W{d}"] = p["E"].T @ table
            grad["E"] += table @ p[f"W{d}"].T
        return loss, grad

    def train(self, windows: list[bytes], labels: np.ndarray, steps: int = 300, batch: int = 128, rate: float = 0.02, seed: int = 11) -> Network:
        """Adam on loss_and_gradient; every language has an equal share of each batch."""
        r, p = np.random.default_rng(seed), self.p
        m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        by = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        for step in range(1, steps + 1):
            pick = np.concatenate([r.choice(own, max(1, batch // len(by))) for own in by if len(own)])
            _, grad = self.loss_and_gradient([windows[i] for i in pick], labels[pick])
            size = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
            slow = rate * min(1, 2 * (1 - step / (steps + 1)))
            for k, v in grad.items():
                v = v * min(1, 1 / max(size, 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                p[k] -= (slow * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def fit(docs: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_language: int = 240, windows_per_row: int = 12, most_languages: int = 256, steps: int = 300) -> Network | None:
    """A network trained on a bounded sample: about rows_per_language documents of each language (those of
    the lowest hash of key) and windows_per_row windows of WINDOW characters spread evenly over each. Only rows where train holds and text and lang
    aren't null count; beyond most_languages, the rarest languages aren't learned. None if no row is left.
    """
    rows = docs.where(train & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(key).cast("string").alias("key"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not sizes:
        return None
    share = F.create_map(*[x for s in sizes for x in (F.lit(s[0]), F.lit(int(min(1.0, rows_per_language / s[1]) * SHARES)))])
    drawn = rows.where(F.pmod(F.xxhash64("key", F.lit(29)), F.lit(SHARES)) < share[F.col("lang")]).where(F.rlike("text", F.lit(r"\p{L}")))
    size = F.length("text")
    step = F.greatest(F.lit(WINDOW), F.ceil(size / windows_per_row)).cast("int")
    some = drawn.select("lang", F.transform(F.sequence(F.lit(0), F.floor((size - 1) / step).cast("int")), lambda i: F.lower(F.substring("text", i * step + 1, F.lit(WINDOW)))).alias("windows"), F.xxhash64("key", F.lit(29)).alias("at"))
    got = some.orderBy("at", "windows").limit(2 * rows_per_language * len(sizes)).collect()
    languages = sorted({r.lang for r in got})
    windows = [(w.encode(), languages.index(r.lang)) for r in got for w in r.windows if any(map(str.isalpha, w))]
    if not windows:
        return None
    return Network(languages).train([w for w, _ in windows], np.array([k for _, k in windows]), steps)


def _predicting(net: Network | None, text: str):
    def run(batches):
        for batch in batches:
            col = batch.schema.get_field_index(text)
            langs: list[str | None] = ["und"] * batch.num_rows
            scores = [0.0] * batch.num_rows
            texts = batch.column(col).to_pylist() if net is not None else []
            # whole texts, a few megabytes at a time; a longer one alone
            held, size = [], 0
            for i, t in enumerate(texts):
                if t and (_ASCII_LETTER.search(t) or any(map(str.isalpha, t))):
                    held.append((i, t.lower()))
                    size += len(t)
                if held and (size >= 1 << 21 or i + 1 == len(texts)):
                    data, at = utf8(pa.array([x for _, x in held], pa.large_string()))
                    total = net.pooled(data, at)
                    for (k, _), p in zip(held, total, strict=True):
                        best = int(p.argmax())
                        langs[k], scores[k] = net.languages[best], float(p[best] / p.sum())
                    held, size = [], 0
            kept = [c for i, c in enumerate(batch.columns) if i != col]
            names = [c for i, c in enumerate(batch.schema.names) if i != col]
            yield pa.RecordBatch.from_arrays([*kept, batch.column(col), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, text, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score added (columns of those names are replaced; the text column comes third from last).

    A null text, or one without a letter, gets ``und`` and score 0, as does every row without a network. Whole
    texts count; nothing but the text is read. Of equally likely languages the first in alphabetical order wins.
    """
    docs = docs.drop("lang_pred", "score")
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c != text], text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(released(_predicting(net, text)), f"{schema}, lang_pred string, score double")


def held_out(key: str = "doc_id") -> Column:
    """crc32 of the key as text is divisible by 5; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = fit(docs, ~held_out())
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), net).select("doc_id", "held_out", "lang_pred", "score")
