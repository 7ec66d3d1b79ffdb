"""Similarity join of texts on word shingles by chosen paths.

A text's set is its five-word shingles (of fewer words, the words as they
are). In every run a set walks from the root along sampled tokens: at a path it
goes on with each token whose hash with the path lies below 1 / (T |set|), T
being the similarity, so similar sets share a path and others part. Sets that
share a path form its bucket. A bucket of at most SMALL sets is compared
directly; a larger one is split by the next level of its members' paths, up to
DEPTH; what is large even then is compared block by block, so nothing is
capped. RUNS is the number of runs that the target recall asks for.

In a bucket, pairs are compared by 256-bit minhash sketches with a margin of
over four standard deviations; only a spanning forest of the pairs that pass
leaves the task. Components of these edges hold every candidate pair once, and
inside a component all pairs are checked exactly, again in blocks: links are
counted, and a forest of them gives the classes.

Equal texts are one set, told by a 64-bit hash; copies are never expanded into
pairs. A null text and one without a word has no set: it links with nothing
and is a class of its own. Rows that share an id are all returned; a null id
is nobody's smallest and, alone in its class, has a null class id. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from plotwise.llm.common import WORD, WORD_SQL, batches, components, forest, mixed, sifted
from plotwise.session import stage

WORDS, TENTHS, DEPTH, SMALL, BLOCK, BITS = 5, 8, 3, 2048, 512, 256
RECALL = 0.9995
#: A pair just at the threshold shares a path with probability 1 - 1/e a level; two levels are the usual depth.
RUNS = math.ceil(math.log(1 - RECALL) / math.log(math.exp(-(1 - math.exp(-1)))))
SLACK = 50  # differing bits of BITS that a candidate may have; a pair at 0.8 has 25.6 on average, deviation 4.8
SEED = 17


def shingles(words: list[list[str]], size: int = WORDS) -> list[np.ndarray]:
    """Distinct shingle hashes of each word list."""
    index: dict[str, int] = {}
    flat = np.fromiter((index.setdefault(w, len(index)) for w in chain.from_iterable(words)), np.int64)
    code = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in index), np.uint64, len(index))[flat]
    out, end = [], 0
    for w in words:
        h = code[end : end + len(w)]
        end += len(w)
        n = min(size, len(h))
        if not n:
            out.append(np.zeros(0, np.uint64))
            continue
        s = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            s = mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - n + 1 + j], j)
        out.append(np.unique(s))
    return out


def text_shingles(texts: list[str], size: int = 1000) -> list[np.ndarray]:
    """Shingles of texts, of which `size` at a time are held as words."""
    return [s for i in range(0, len(texts), size) for s in shingles([WORD.findall(t) for t in texts[i : i + size]])]


_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BITS, dtype=np.uint64)


def sketch(s: np.ndarray) -> bytes:
    """One bit of each of BITS minima, each by a permutation of its own; sets of all sizes can be compared."""
    low = np.full(BITS, np.iinfo(np.uint64).max)
    for k in range(0, len(s), 256):
        low = np.minimum(low, (s[k : k + 256, None] * _A + _B).min(0))
    return np.packbits((mixed(low, 3) & np.uint64(1)).astype(np.uint8)).tobytes()


def steps(s: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """The paths that a set goes on with from any of `paths`."""
    limit = np.uint64(min(2**64 - 1, int(2**64 * 10 / (TENTHS * len(s)))))
    u = (s ^ paths[:, None]) * np.uint64(0x9E3779B97F4A7C15)
    u ^= u >> np.uint64(29)
    u *= np.uint64(0xBF58476D1CE4E5B9)
    at, token = np.nonzero(u < limit)
    return mixed(u[at, token] + paths[at], 2)


def roots(runs: int) -> np.ndarray:
    return mixed(np.arange(runs, dtype=np.uint64), SEED)


def sets(docs: DataFrame, runs: int) -> DataFrame:
    """cls, size, sketch and first paths of every text with a word; copies appear as often as they come."""

    def run(b):
        sh = text_shingles(b["text"].to_pylist())
        start = roots(runs)
        return {"cls": b["cls"], "n": [len(s) for s in sh], "sketch": [sketch(s) for s in sh], "paths": [steps(s, start).view(np.int64) for s in sh]}

    return batches(docs.select("cls", "text"), run, "cls long, n int, sketch binary, paths array<long>")


def deeper(docs: DataFrame, large: DataFrame) -> DataFrame:
    """(p, cls): the next paths of the sets in large buckets (p, cls), from their texts."""
    # Staged, as only a plain scan with a predicate is taken for the small side that sifts the texts.
    per = stage(large.groupBy("cls").agg(F.collect_list("p").alias("paths")), "large-paths").where(F.size("paths") > 0)

    def run(b):
        sh = text_shingles(b["text"].to_pylist())
        return {"cls": b["cls"], "paths": [steps(s, np.array(p, np.int64).view(np.uint64)).view(np.int64) for s, p in zip(sh, b["paths"].to_pylist())]}

    return batches(docs.select("cls", "text").join(per, "cls"), run, "cls long, paths array<long>").select(F.explode("paths").alias("p"), "cls").distinct()


def buckets(docs: DataFrame, first: DataFrame, small: int = SMALL) -> DataFrame:
    """(p, cls, blocks): buckets of two sets or more, at the level where they are small, or at the last one."""
    rows, out = first, None
    for level in range(DEPTH):
        with sifted(docs.sparkSession):
            rows = stage(rows, "paths")
        size = stage(rows.groupBy("p").agg(F.count("*").alias("size")).where("size > 1"), "path-sizes")
        met = rows.join(size, "p")
        large = size.where(F.col("size") > small)
        last = level == DEPTH - 1 or large.isEmpty()
        here = met if last else met.where(F.col("size") <= small)
        here = here.select("p", "cls", F.ceil(F.col("size") / small).cast("int").alias("blocks"))
        out = here if out is None else out.unionByName(here)
        if last:
            break
        rows = deeper(docs, stage(rows.join(large.select("p"), "p", "left_semi"), "large-buckets"))
    return out


def in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt to pairs (i, j) of their key's blocks, i <= j; a row of a single block appears once."""
    at = F.pmod(F.xxhash64("cls", F.lit(5)), F.col("blocks")).cast("int")
    return (rows.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("i", F.least("at", "other")).withColumn("j", F.greatest("at", "other")).drop("other", "blocks"))


FEW = 64


def near(bits: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) are near by sketch and size; a and b broadcast."""
    apart = np.zeros(np.broadcast_shapes(a.shape, b.shape), np.uint16)
    for w in range(bits.shape[1]):
        apart += np.bitwise_count(bits[a, w] ^ bits[b, w])
    return (apart <= SLACK) & (np.minimum(n[a], n[b]) * 10 >= np.maximum(n[a], n[b]) * TENTHS)


def near_sketches(pdf: pd.DataFrame) -> pd.DataFrame:
    """Forest of the near pairs of the buckets' block pairs that were dealt here together."""
    pdf = pdf.drop_duplicates(["p", "i", "j", "cls"]).sort_values(["p", "i", "j"], kind="stable").reset_index(drop=True)
    bits = np.frombuffer(b"".join(pdf["sketch"]), np.uint64).reshape(len(pdf), BITS // 64)
    n, at, crossed = pdf["n"].to_numpy(np.int64), pdf["at"].to_numpy(), (pdf["i"] != pdf["j"]).to_numpy()
    ids, node = np.unique(pdf["cls"].to_numpy(), return_inverse=True)
    bucket = pdf.groupby(["p", "i", "j"], sort=False).ngroup().to_numpy()
    begin, size = np.unique(bucket, return_index=True, return_counts=True)[1:]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # Small buckets all at once: rows d places apart, as long as they share a bucket.
    some = np.flatnonzero(size[bucket] <= FEW)
    for d in range(1, min(FEW, int(size[size <= FEW].max(initial=1)))):
        x, y = some[:-d], some[d:]
        both = (bucket[x] == bucket[y]) & (~crossed[x] | (at[x] != at[y]))
        x, y = x[both], y[both]
        ok = near(bits, n, x, y)
        a.append(node[x[ok]])
        b.append(node[y[ok]])
    for k in np.flatnonzero(size > FEW):
        rows = np.arange(begin[k], begin[k] + size[k])
        i, j = pdf["i"][begin[k]], pdf["j"][begin[k]]
        left, right = rows[at[rows] == i], rows[at[rows] == j]
        for c in range(0, len(left), 256):
            x = left[c : c + 256]
            p, q = np.nonzero(near(bits, n, x[:, None], right[None, :]))
            here, inv = np.unique(np.concatenate([node[x[p]], node[right[q]]]), return_inverse=True)
            root = forest(len(here), inv[: len(p)], inv[len(p) :])  # of this stripe
            a.append(here)
            b.append(here[root])
    root = forest(len(ids), np.concatenate(a), np.concatenate(b))
    child = np.flatnonzero(root != np.arange(len(ids)))
    return pd.DataFrame({"a": ids[child], "b": ids[root[child]]})


def exact(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of a block pair by exact similarity: counts where a = b, else edges of their forest."""
    pdf = pdf.drop_duplicates("cls")
    i, j = int(key[1]), int(key[2])
    sh = shingles([WORD.findall(t) for t in pdf["text"]])
    n, at, ids = np.array([len(s) for s in sh], np.int64), pdf["at"].to_numpy(), pdf["cls"].to_numpy()
    left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
    u, token = np.unique(np.concatenate(sh), return_inverse=True)
    owner = np.repeat(np.arange(len(sh)), n)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    # Only tokens of two sets or more can be common; they are multiplied out in slices.
    many = np.bincount(token) > 1
    keep = many[token]
    number = np.cumsum(many) - 1
    token, owner = number[token[keep]], owner[keep]
    common = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for k in range(0, int(many.sum()), width):
        lo, hi = np.searchsorted(token, [k, k + width])
        x = np.zeros((len(sh), width), np.float32)
        x[owner[lo:hi], token[lo:hi] - k] = 1
        common += x[left] @ x[right].T
    common = common.astype(np.int64)
    linked = (common * 10 >= TENTHS * (n[left][:, None] + n[right] - common)) & (left[:, None] != right)
    p, q = np.nonzero(linked)
    links = np.bincount(left[p], minlength=len(sh))
    if i != j:
        links = links + np.bincount(right[q], minlength=len(sh))
    root = forest(len(sh), left[p], right[q])
    child, some = np.flatnonzero(root != np.arange(len(sh))), np.flatnonzero(links)
    return pd.DataFrame({"a": np.concatenate([ids[some], ids[child]]), "b": np.concatenate([ids[some], ids[root[child]]]), "links": np.concatenate([links[some], np.zeros(len(child), np.int64)])})


def candidates(docs: DataFrame, runs: int = RUNS, small: int = SMALL) -> DataFrame:
    """Components (id, root) of the sets whose sketches are near in some bucket."""
    spark = docs.sparkSession
    known = stage(sets(docs, runs).dropDuplicates(["cls"]), "sets")
    member = buckets(docs, known.select(F.explode("paths").alias("p"), "cls"), small).join(known.select("cls", "n", "sketch"), "cls")
    # Block pairs are dealt out together, a task's worth at a time: most are tiny.
    deals = 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_blocks(member, "p").withColumn("deal", F.pmod(F.xxhash64("p", "i", "j"), F.lit(deals)))
    return components(dealt.groupBy("deal").applyInPandas(near_sketches, "a long, b long").distinct())


def assigned(docs: DataFrame, runs: int = RUNS, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """row (a hash of all columns), doc_id, root (null without a set), class_id, n_links, n_copies for every row."""
    wordy = F.coalesce(F.regexp_like("text", F.lit(WORD_SQL)), F.lit(False))
    rows = docs.select("doc_id", "text", F.xxhash64(*docs.columns).alias("row")).withColumn("cls", F.when(wordy, F.xxhash64("text")))
    ids = stage(rows.select("row", "doc_id", "cls"), "text-classes")
    copies = stage(ids.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_copies")), "text-copies")
    found = stage(candidates(rows.where("cls IS NOT NULL"), runs, small), "candidates")
    size = found.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    asked = stage(found.join(size, "root").join(copies.select(F.col("cls").alias("id"), "low"), "id"), "candidate-blocks")
    # One row of each text meets its component: the one with the smallest id.
    # Texts without a candidate are sifted out before the shuffle; the predicate marks the small side for it.
    some = asked.withColumnRenamed("id", "cls").where("blocks > 0")
    texts = rows.join(some, "cls").where(F.col("doc_id").eqNullSafe(F.col("low"))).select("root", "cls", "text", "blocks")
    with sifted(docs.sparkSession):
        linked = stage(in_blocks(texts, "root").groupBy("root", "i", "j").applyInPandas(exact, "a long, b long, links long"), "links")
    n = linked.where("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("n_links"))
    comp = components(linked.select("a", "b")).withColumnRenamed("id", "cls")
    per = stage(copies.join(n, "cls", "left").join(comp, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "class-rows")
    low = per.groupBy("root").agg(F.min("low").alias("class_id"))
    per = stage(per.join(low, "root").select("cls", "root", "class_id", "n_links", "n_copies"), "classes")
    return ids.join(per, "cls", "left").select("row", "doc_id", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id, n_links (other texts linked), kept, n_copies (rows of this text) for every row."""
    done = assigned(docs.select("doc_id", "text"), **how)
    return done.select("doc_id", "class_id", "n_links", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"), "n_copies")


def representatives(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each class, that of the smallest id; rows without a word all stay."""
    done = stage(assigned(docs, **how), "assigned")
    best = done.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("w"))
    kept = stage(best.select(F.col("w.row").alias("_row"), F.lit(True).alias("_one")).union(done.where("root IS NULL").select("row", F.lit(False)).distinct()), "kept-rows")
    joined = docs.withColumn("_row", F.xxhash64(*docs.columns)).join(kept, "_row")
    # Of equal rows the first stays; the join has sorted them already.
    nth = F.row_number().over(Window.partitionBy("_row").orderBy("_row"))
    return joined.withColumn("_nth", nth).where("_nth = 1 OR NOT _one").select(*docs.columns)
