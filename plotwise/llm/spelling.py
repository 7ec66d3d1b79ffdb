"""Spelling variants: words that differ by one edit, and the form each belongs to.

One inserted, deleted or replaced code point moves a word's letter counts by at
most two in L1: one count up, one down, or both. Counts are kept in unary in 64
bits (a-z up to two each, the other letters share twelve counters of one), so
count vectors become bit sets, L1 distances become bit counts, and a box is two
bit sets, its least and greatest corner. Saturation and sharing only shrink
distances, so no pair is lost.

A k-d tree over length and letter counts, cut at medians of a sample of at most
32 words a cell, deals the words to cells. A word is also sent, as a query, to
the later cells whose box it can reach by one edit. Cells and their queries are
cut into blocks, so none is unbounded. In a block there is a k-d tree for each
length; for each pair of lengths (equal, or one apart) queries descend together
and leave the boxes they cannot reach. What a leaf's counts allow is verified by
letter order: one mismatch for equal lengths, else common head plus common tail
covering the shorter word. Blocks give back counts and the best near word of
each word, never pairs.

The form is the near word of largest n, the smallest in code-point order at
ties, if it occurs at least twice as often; so forms have no cycles, and roots
are found by doubling paths.

Null texts have no words, a null id is hashed as no digits, repeated rows count
each time. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plotwise.llm.common import batches, thin
from plotwise.session import stage

RUN = "([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP, SHORTEST, RAREST, RATIO = 97, 5, 3, 2
CELL, MOST_CELLS, PER_CELL, BLOCK, LEAF, CHUNK = 16_384, 4096, 32, 32_768, 128, 1 << 21
FULL = np.uint64(2**64 - 1)


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, slip: int = SLIP) -> DataFrame:
    """(word, n): the words of all texts, some runs with the letter deleted that their hash names."""
    run = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(1)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), run.alias("word"))
    h = F.crc32(F.concat("_id", F.lit(":"), "word").cast("binary"))
    at = (h % F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    words = runs.select(F.when(h % slip == 0, cut).otherwise(F.col("word")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= rarest)


def codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def signatures(words: list[str]) -> np.ndarray:
    """Letter counts in unary: bits 2k and 2k+1 for a-z, bits 52 to 63 for the rest."""
    out = np.zeros(len(words), np.uint64)
    size = np.array([len(w) for w in words])
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        c = codes([words[i] for i in at])
        sig = np.zeros(len(at), np.uint64)
        for k in range(26):
            count = (c == 97 + k).sum(1)
            sig |= np.minimum((1 << np.minimum(count, 2)) - 1, 3).astype(np.uint64) << np.uint64(2 * k)
        rest = (c < 97) | (c > 122)
        for k in range(12):
            sig |= (rest & (c % 12 == k)).any(1).astype(np.uint64) << np.uint64(52 + k)
        out[at] = sig
    return out


def median_bit(sig: np.ndarray) -> tuple[int, int]:
    """The count that splits most evenly, and the smaller side's size."""
    ones = np.array([int(((sig >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)])
    small = np.minimum(ones, len(sig) - ones)
    return int(small.argmax()), int(small.max())


class Cells:
    """Top of the k-d tree: cuts by length or by one letter's count down to cells."""

    def __init__(self, length: np.ndarray, sig: np.ndarray, cells: int):
        self.nodes: list[tuple] = []
        self.cells = 0
        self.grow(length, sig, max(1, len(sig) // max(1, cells)))

    def grow(self, length: np.ndarray, sig: np.ndarray, enough: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        bit, small = median_bit(sig) if len(sig) else (0, 0)
        middle = np.sort(length)[len(length) // 2] if len(length) else 0
        by_length = int((length < middle).sum())
        if len(sig) <= enough or max(small, by_length) == 0:
            self.nodes[at] = ("cell", self.cells)
            self.cells += 1
        elif by_length >= small // 2:  # lengths prune better than counts
            low = length < middle
            self.nodes[at] = ("length", int(middle), self.grow(length[low], sig[low], enough), self.grow(length[~low], sig[~low], enough))
        else:
            one = (sig >> np.uint64(bit)) & np.uint64(1) == 1
            self.nodes[at] = ("letter", bit, self.grow(length[~one], sig[~one], enough), self.grow(length[one], sig[one], enough))
        return at

    def route(self, length: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Each word's own cell, and the later cells it may reach by one edit."""
        own, far = np.zeros(len(sig), np.int64), [[] for _ in range(len(sig))]
        # Words at a node with counts gone up and down so far, and how much their length changed.
        todo = [(0, np.arange(len(sig)), np.zeros(len(sig), np.int8), np.zeros(len(sig), np.int8), np.zeros(len(sig), np.int8))]
        while todo:
            node, w, up, down, longer = todo.pop()
            kind, *rest = self.nodes[node]
            # One longer means one count up and none down, one shorter the reverse.
            ok = (up <= (longer >= 0)) & (down <= (longer <= 0)) & (np.abs(longer) <= 1)
            w, up, down, longer = w[ok], up[ok], down[ok], longer[ok]
            if not len(w):
                continue
            if kind == "cell":
                home = (up == 0) & (down == 0) & (longer == 0)
                own[w[home]] = rest[0]
                for i in w[~home].tolist():
                    far[i].append(rest[0])
                continue
            cut, low, high = rest
            if kind == "length":
                todo.append((low, w, up, down, np.minimum(longer, np.maximum(cut - 1 - length[w], -2)).astype(np.int8)))
                todo.append((high, w, up, down, np.maximum(longer, np.minimum(cut - length[w], 2)).astype(np.int8)))
            else:
                one = ((sig[w] >> np.uint64(cut)) & np.uint64(1)).astype(np.int8)
                todo.append((low, w, up, down + one, longer))
                todo.append((high, w, up + 1 - one, down, longer))
        return own, [[c for c in cells if c > mine] for cells, mine in zip(far, own.tolist())]


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of code points are one edit apart; b as long as a, or one longer."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(1) == 1
    head = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= n


class Tree:
    """k-d tree over the letter counts of words of one length, with a tight box at each node."""

    def __init__(self, at: np.ndarray, sig: np.ndarray, leaf: int = LEAF):
        self.at, self.sig, self.leaf, self.nodes = at, sig, leaf, []
        self.grow(np.arange(len(at)))

    def grow(self, part: np.ndarray) -> int:
        here, sig = len(self.nodes), self.sig[part]
        self.nodes.append(None)
        bit, small = median_bit(sig) if len(part) > self.leaf else (0, 0)
        children = ()
        if small:
            one = (sig >> np.uint64(bit)) & np.uint64(1) == 1
            children = (self.grow(part[~one]), self.grow(part[one]))
        self.nodes[here] = (np.bitwise_and.reduce(sig), np.bitwise_or.reduce(sig), children, part)
        return here

    def search(self, sig: np.ndarray, up: int, down: int):
        """Blocks of (query, member) whose counts differ by at most `up` more and `down` fewer."""
        todo = [(0, np.arange(len(sig)))]
        while todo:
            node, q = todo.pop()
            low, high, children, part = self.nodes[node]
            s = sig[q]
            q = q[(np.bitwise_count(low & ~s) <= up) & (np.bitwise_count(s & ~high) <= down)]
            if not len(q):
                continue
            if children:
                todo += [(c, q) for c in children]
                continue
            size = max(1, CHUNK // len(part))
            for i in range(0, len(q), size):
                s, p = sig[q[i : i + size]][:, None], self.sig[part][None]
                a, b = np.nonzero((np.bitwise_count(p & ~s) <= up) & (np.bitwise_count(s & ~p) <= down))
                if len(a):
                    yield q[i + a], self.at[part[b]]


def pairs(words: list[str], member: np.ndarray, inside: bool):
    """Arrays (i, j) of near words, each pair once: members with others, or members with members (`inside`)."""
    size, sig = np.array([len(w) for w in words]), signatures(words)
    lengths = np.unique(size).tolist()
    at = {n: np.flatnonzero(size == n) for n in lengths}
    text = {n: codes([words[i] for i in at[n]]) for n in lengths}
    row = np.zeros(len(words), np.int64)
    for n in lengths:
        row[at[n]] = np.arange(len(at[n]))
    for n in lengths:
        mine = at[n][member[at[n]]]
        if not len(mine):
            continue
        tree = Tree(mine, sig[mine])
        for other, up, down in ((n, 1, 1), (n - 1, 1, 0), (n + 1, 0, 1)):
            if other not in at:
                continue
            # A pair of members of two lengths is met when the shorter one asks.
            if inside and other > n:
                continue
            ask = at[other][member[at[other]] == inside]
            for q, p in tree.search(sig[ask], up, down):
                q = ask[q]
                if inside and other == n:
                    once = q < p
                    q, p = q[once], p[once]
                step = max(1, CHUNK // n)
                for i in range(0, len(q), step):
                    a, b = q[i : i + step], p[i : i + step]
                    x, y = text[other][row[a]], text[n][row[b]]
                    ok = near(x, y) if other <= n else near(y, x)
                    yield a[ok], b[ok]


def table_of(word: list[str], n_near, best: list[str], best_n) -> pd.DataFrame:
    return pd.DataFrame({"word": pd.Series(word, dtype=object), "n_near": np.asarray(n_near, np.int64), "best": pd.Series(best, dtype=object), "best_n": np.asarray(best_n, np.int64)})


def meet(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    """Near words of a block: how many each word has here, and the best of them."""
    if not len(members):
        return table_of([], [], [], [])
    words = members["word"].tolist() + queries["r_word"].tolist()
    n = np.concatenate([members["n"].to_numpy(np.int64), queries["r_n"].to_numpy(np.int64)])
    order = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])))
    rank = np.zeros(len(words), np.int64)
    rank[order] = np.arange(len(words))
    count, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    member = np.arange(len(words)) < len(members)
    inside = bool((members["q"] == members["m"]).all())
    for i, j in pairs(words, member, inside):
        np.add.at(count, i, 1)
        np.add.at(count, j, 1)
        np.minimum.at(best, i, rank[j])
        np.minimum.at(best, j, rank[i])
    some = np.flatnonzero(count)
    near_to = order[best[some]]
    return table_of([words[i] for i in some], count[some], [words[i] for i in near_to], n[near_to])


def near_words(vocab: DataFrame, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best, best_n) for every word that has a near word; best has the largest n."""
    spark = vocab.sparkSession
    total = vocab.count()
    cells = max(1, min(MOST_CELLS, -(-total // cell)))

    def numbers(b):
        words = b["word"].to_pylist()
        return {"length": [len(w) for w in words], "sig": signatures(words).view(np.int64)}

    got = sorted(map(tuple, batches(thin(vocab, ["word"], cells * PER_CELL).select("word"), numbers, "length int, sig long").collect())) if cells > 1 else []
    held = spark.sparkContext.broadcast(Cells(np.array([g[0] for g in got], np.int64), np.array([g[1] for g in got], np.int64).view(np.uint64), cells))  # a node a cell

    def route(b):
        words = b["word"].to_pylist()
        own, far = held.value.route(np.array([len(w) for w in words], np.int64), signatures(words))
        return {"word": b["word"], "n": b["n"], "cell": own.astype(np.int32), "far": far}

    dealt = stage(batches(vocab, route, "word string, n long, cell int, far array<int>"), "spell-cells")
    members = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}
    asked = {r["cell"]: r["count"] for r in dealt.select(F.explode("far").alias("cell")).groupBy("cell").count().collect()}
    # Blocks of a cell's members meet its queries and the later blocks of its members.
    parts = [(c, -(-n // block), -(-asked.get(c, 0) // block)) for c, n in sorted(members.items())]
    blocks = F.broadcast(spark.createDataFrame(parts, "cell int, mb int, qb int")) if parts else None  # a row a cell
    if blocks is None:
        return spark.createDataFrame([], "word string, n_near long, best string, best_n long")
    salt = lambda n: F.pmod(F.xxhash64("word"), n).cast("int")
    span = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    own = dealt.select("word", "n", "cell").join(blocks, "cell").withColumn("m", salt(F.col("mb")))
    # A block m of members meets earlier blocks q < m of its cell, itself (q = m) and, from q = mb on, blocks of queries.
    left = own.withColumn("q", F.explode(F.concat(span(F.lit(0), F.col("m")), span(F.col("mb"), F.col("mb") + F.col("qb") - 1)))).select("cell", "m", "q", "word", "n")
    inner = own.withColumn("to", F.explode(span(F.col("m") + 1, F.col("mb") - 1))).select("cell", F.col("to").alias("m"), F.col("m").alias("q"), "word", "n")
    outer = dealt.select("word", "n", F.explode("far").alias("cell")).join(blocks, "cell").withColumn("q", F.col("mb") + salt(F.col("qb"))).withColumn("m", F.explode(span(F.lit(0), F.col("mb") - 1))).select("cell", "m", "q", "word", "n")
    right = inner.unionByName(outer)
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    found = left.groupBy("cell", "m", "q").cogroup(right.groupBy("r_cell", "r_m", "r_q")).applyInPandas(meet, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("k"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n_near", F.col("_b.w").alias("best"), (-F.col("_b.k")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): paths double their length each round; a row count comes back."""
    hop = stage(forms.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        step = hop.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = stage(hop.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "spell-roots")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        hop = new.select("word", "root")


def variants(docs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST, slip: int = SLIP, ratio: int = RATIO, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word."""
    vocab = stage(vocabulary(docs, shortest, rarest, slip), "spell-words")
    found = near_words(vocab, cell, block)
    better = F.col("best_n") >= ratio * F.col("n")
    words = vocab.join(found, "word", "left").select("word", F.when(better, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best_n")).alias("form_n"))
    words = stage(words, "spell-forms")
    ends = roots(words.where("form IS NOT NULL"))
    return words.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
