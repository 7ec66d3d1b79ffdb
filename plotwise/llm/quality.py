"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

The pairwise part is the sum-of-squares identity, so a text costs time linear
in its distinct words. Words are hashed to `2**BITS` slots with a length-
normalised weight; structure statistics and the n_chars column are one-hot
bins. The model is fitted on at most about `SAMPLE` labelled rows (a
documented bound) of about the same share of each label as they come.

Null or empty texts have no words and are scored by their bins alone. Rows
are scored one by one, so repeated rows, ties and extra columns change
nothing. With no usable label every score is 0.5.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, functions as F

from plotwise.llm.common import WORD, batches, fold_of, thin

BITS, RANK, SAMPLE, EPOCHS, SEED = 17, 8, 6000, 6, 7
BINS = 12
STATS = 10
SYMBOLS = re.compile(r"[#*$%&|<>@^~{}\[\]\\_=+]")
UPPER, DIGIT, PUNCT, SHOUT = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[.,;:!?'\"()-]"), re.compile(r"!!|\?\?|\.\.\.")
SLOTS = (1 << BITS) + (STATS + 1) * BINS


def structure(text: str, words: list[str], distinct: int) -> list[float]:
    """Ten statistics of a text, each in 0..1."""
    n, w = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda rx: len(rx.findall(text)) / n
    root = lambda x: math.sqrt(min(1.0, x))
    return [min(1.0, math.log1p(len(words)) / 12), root(share(SYMBOLS) * 4), root(share(UPPER)), root(share(DIGIT) * 2), root(share(PUNCT) * 2),
            min(1.0, (n / w) / 24), root(1 - len(set(lines)) / max(1, len(lines))), 1 - distinct / w, root(share(SHOUT) * 10), min(1.0, max(map(len, words), default=0) / 60)]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    text = text or ""
    words = WORD.findall(text)
    counts = Counter(words)
    slots: dict[int, float] = {}
    mask = (1 << BITS) - 1
    for w, c in counts.items():
        k = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) & mask
        slots[k] = slots.get(k, 0.0) + c
    idx = np.fromiter(slots, np.int64, len(slots))
    val = np.log1p(np.fromiter(slots.values(), np.float64, len(slots)))
    if len(val):
        val /= math.sqrt(float(val @ val))
    bins = [int(min(BINS - 1, s * BINS)) + j * BINS for j, s in enumerate(structure(text, words, len(counts)))]
    bins.append(STATS * BINS + (0 if n_chars is None or n_chars < 0 else min(BINS - 1, 1 + int(math.log1p(n_chars) / 1.2))))
    return np.concatenate([idx, np.array(bins, np.int64) + (1 << BITS)]), np.concatenate([val, np.full(len(bins), 0.5)])


class Machine:
    """Second-order factorisation machine with logistic loss."""

    def __init__(self, slots: int = SLOTS, rank: int = RANK, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(slots, np.float32)
        self.v = rng.normal(0, 0.02, (slots, rank)).astype(np.float32)

    def raw(self, idx, val) -> float:
        vx = self.v[idx] * val[:, None]
        s = vx.sum(0)
        return float(self.w0 + self.w[idx] @ val + 0.5 * (s @ s - (vx * vx).sum()))

    def score(self, idx, val) -> float:
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, self.raw(idx, val)))))

    def fit(self, rows, labels, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5, seed: int = SEED) -> Machine:
        """Adaptive gradient steps, one row at a time in a seeded order."""
        gw, gv, g0 = np.full(len(self.w), 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                idx, val = rows[i]
                g = self.score(idx, val) - labels[i]
                v = self.v[idx]
                vx = v * val[:, None]
                dv = g * val[:, None] * (vx.sum(0) - vx) + decay * v
                dw = g * val + decay * self.w[idx]
                g0 += g * g
                self.w0 -= rate * g / math.sqrt(g0)
                gw[idx] += dw * dw
                gv[idx] += dv * dv
                self.w[idx] -= rate * dw / np.sqrt(gw[idx])
                self.v[idx] -= 0.5 * rate * dv / np.sqrt(gv[idx])
        return self


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """Learn from labelled rows whose id has crc32 mod 3 other than 1."""
    lab = (labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(fold_of("doc_id", 3) != 1))
    lab = thin(lab, ["doc_id"], sample)
    ids = docs.select("doc_id", "text", "n_chars").join(lab, "doc_id")

    def run(b):
        f = [features(t, c) for t, c in zip(b["text"].to_pylist(), b["n_chars"].to_pylist())]
        return {"doc_id": b["doc_id"], "quality": b["quality"].cast("double"), "idx": [x.tolist() for x, _ in f], "val": [x.tolist() for _, x in f]}

    # Bounded by `sample` rows; floats halve what travels.
    got = batches(ids, run, "doc_id long, quality double, idx array<int>, val array<float>").collect()
    got.sort(key=lambda r: (r.doc_id, r.quality, r.idx))
    if not got:
        return None
    return Machine().fit([(np.array(r.idx, np.int64), np.array(r.val, np.float64)) for r in got], [r.quality for r in got])


def score(docs: DataFrame, model: Machine | None, into: str = "score") -> DataFrame:
    """docs with the score of each row."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # fixed size: 2**BITS slots

    def run(it):
        m = held.value
        for texts, n_chars in it:
            import pandas as pd

            yield pd.Series([0.5 if m is None else m.score(*features(t, None if c is None or c != c else int(c))) for t, c in zip(texts, n_chars)], dtype="float64")

    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import DoubleType
    from collections.abc import Iterator
    import pandas as pd

    run.__annotations__ = {"it": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return docs.withColumn(into, pandas_udf(run, DoubleType())("text", F.col("n_chars").cast("double")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    clean = docs.select("doc_id", "text", "n_chars")
    scored = score(clean, fit(clean, labels))
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    model = fit(source if source is not None else docs, labels)
    return score(docs, model, "_quality").where("_quality >= 0.5").select(*docs.columns)
