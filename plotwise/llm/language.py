"""Language identification by a byte convolutional network trained in numpy.

Bytes are embedded, convolved by filters of several widths, max-pooled over a
window and fed to a softmax. A text is cut into windows of WINDOW bytes, all
of them are scored in batches, and the text's distribution is the mean of its
windows' weighted by their letters' bytes. Languages are the non-null `lang`
values of the learning fold; at most about PER_LANG rows of each are used.

A null text, and a text without a letter, is `und` with score 0; so is every
text when nothing could be learnt. Nothing else depends on other rows, so
repeats, ties and extra columns are harmless.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from plotwise.llm.common import batches, fold_of, thin

WINDOW, EMBED, FILTERS, WIDTHS = 192, 8, 8, (2, 3, 4)
PER_LANG, WINDOWS_PER_TEXT, EPOCHS, SEED = 800, 4, 10, 11


class ByteNet:
    """Parameters are float32; byte 0 is padding and never occurs in a window's text."""

    def __init__(self, langs: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"e": rng.normal(0, 0.3, (256, EMBED)), "o": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))), "c": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p[f"k{w}"] = rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray):
        """x: windows by WINDOW bytes. Pooled features, where each maximum is, and probabilities."""
        e = self.p["e"][x]
        pooled, at = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            cols = np.concatenate([e[:, j : j + n] for j in range(w)], axis=2)
            a = (cols.reshape(-1, w * EMBED) @ self.p[f"k{w}"]).reshape(len(x), n, FILTERS)
            m = a.argmax(1)
            at.append(m)
            pooled.append(np.maximum(0, np.take_along_axis(a, m[:, None], 1)[:, 0] + self.p[f"b{w}"]))
        h = np.concatenate(pooled, axis=1)
        z = h @ self.p["o"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        return h, at, z / z.sum(1, keepdims=True)

    def tables(self):
        """What a pair of neighbouring bytes adds to each filter; a convolution is then a few lookups."""
        e = self.p["e"]
        tap = {w: [e @ self.p[f"k{w}"][j * EMBED : (j + 1) * EMBED] for j in range(w)] for w in WIDTHS}
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        first = np.concatenate([pair(*tap[w][:2]) for w in WIDTHS], axis=1)
        return first, tap[3][2], pair(*tap[4][2:])

    def predict(self, x: np.ndarray, tables) -> np.ndarray:
        """Probabilities of windows by table lookups; bias and ReLU come after pooling."""
        first, third, last = tables
        two = x[:, :-1].astype(np.intp) * 256 + x[:, 1:]
        a = first.take(two, axis=0)
        b = third.take(x[:, 2:], axis=0)
        b += a[:, :-1, FILTERS : 2 * FILTERS]
        c = last.take(two[:, 2:], axis=0)
        c += a[:, :-2, 2 * FILTERS :]
        h = np.concatenate([a[:, :, :FILTERS].max(1), b.max(1), c.max(1)], axis=1)
        h = np.maximum(0, h + np.concatenate([self.p[f"b{w}"] for w in WIDTHS]))
        z = h @ self.p["o"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, size: int = 64, rate: float = 0.004, seed: int = SEED) -> ByteNet:
        """Cross entropy, balanced over languages, by Adam."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = (len(y) / len(self.langs) / np.maximum(1, np.bincount(y, minlength=len(self.langs)))).astype(np.float32)
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), size):
                xb, yb = x[order[i : i + size]], y[order[i : i + size]]
                h, at, q = self.forward(xb)
                d = q.copy()
                d[np.arange(len(yb)), yb] -= 1
                d *= weight[yb][:, None] / len(yb)
                g = {"o": h.T @ d, "c": d.sum(0), "e": np.zeros_like(self.p["e"])}
                dh = (d @ self.p["o"].T) * (h > 0)
                for n, w in enumerate(WIDTHS):
                    part = dh[:, n * FILTERS : (n + 1) * FILTERS]
                    g[f"b{w}"] = part.sum(0)
                    pos = at[n][:, :, None] + np.arange(w)
                    taken = xb[np.arange(len(xb))[:, None, None], pos]
                    cols = self.p["e"][taken].reshape(len(xb), FILTERS, w * EMBED)
                    g[f"k{w}"] = np.einsum("bf,bfc->cf", part, cols)
                    back = np.einsum("bf,cf->bfc", part, self.p[f"k{w}"]).reshape(-1, EMBED)
                    np.add.at(g["e"], taken.reshape(-1), back)
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def windows(data: bytes) -> np.ndarray:
    """All windows of a text, the last one padded with zeros."""
    a = np.frombuffer(data, np.uint8)
    n = max(1, -(-len(a) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(a)] = a
    return out.reshape(n, WINDOW)


def folded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


LETTER_BYTE = np.array([chr(i).isalpha() if i < 128 else True for i in range(256)])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> ByteNet | None:
    """Learn from text and lang of the rows whose id has crc32 mod 5 other than 0."""
    rows = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL").where(fold_of("doc_id", 5) != 0)

    def run(b):
        keep = [(i, t, g) for i, t, g in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["lang"].to_pylist()) if has_letter(t)]
        out = [(i, g, windows(folded(t))) for i, t, g in keep]
        step = lambda w: w[:: max(1, len(w) // WINDOWS_PER_TEXT)][:WINDOWS_PER_TEXT]
        return {"doc_id": [i for i, _, _ in out], "lang": [g for _, g, _ in out], "w": [step(w).tobytes() for _, _, w in out]}

    # At most per_lang rows of a language, WINDOWS_PER_TEXT windows each.
    got = batches(thin(rows, ["doc_id"], per_lang, ["lang"]).select("doc_id", "lang", "text"), run, "doc_id long, lang string, w binary").collect()
    got.sort(key=lambda r: (r.doc_id is None, r.doc_id, r.lang, bytes(r.w)))
    if not got:
        return None
    langs = sorted({r.lang for r in got})
    x = [np.frombuffer(bytes(r.w), np.uint8).reshape(-1, WINDOW) for r in got]
    y = np.repeat([langs.index(r.lang) for r in got], [len(w) for w in x])
    return ByteNet(langs).fit(np.concatenate(x), y)


def predict(docs: DataFrame, net: ByteNet | None, size: int = 32) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand numbers

    def run(b):
        m = held.value
        texts = b["text"].to_pylist()
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        todo = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
        wins = [windows(folded(texts[i])) for i in todo]
        # Windows of many short texts, or a part of those of a long one, make a block.
        owner = np.repeat(np.arange(len(todo)), [len(w) for w in wins])
        if len(todo):
            all_w = np.concatenate(wins)
            tables, total = m.tables(), np.zeros((len(todo), len(m.langs)))
            for i in range(0, len(all_w), size):
                x = all_w[i : i + size]
                q = m.predict(x, tables) * (LETTER_BYTE[x] & (x > 0)).sum(1)[:, None]
                np.add.at(total, owner[i : i + size], q)
            for j, i in enumerate(todo):
                best = int(total[j].argmax())
                lang[i], score[i] = m.langs[best], float(min(1.0, total[j][best] / max(1e-12, total[j].sum())))
        return {"doc_id": b["doc_id"], "lang_pred": lang, "score": score}

    out = batches(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
