"""Near-duplicate vectors by product quantisation.

Equal vectors are one class. A coarse quantiser and, per subspace, a codebook
of residuals are fitted on a documented sample; every class is filed in the
inverted list of its nearest centroid with its codes and its own quantisation
error.

A vector within r of q that is filed under c rather than q's own c* lies beyond
their bisector, which is (|q-c|^2 - |q-c*|^2) / (2 |c-c*|) away from q. A query
therefore probes the lists whose bisector is within r, which loses no pair but
probes a large share of all lists. The same bound holds for the other vector of
a pair, so a query leaves out the lists before its own, whose members probe its
list: two lists meet once, not twice. A pair counts for both its vectors if
either one probes the other's list. On request (`deviations`) all lists within
reach are probed, and the margin is that many
deviations r / sqrt(k) of a difference that favours no direction, k being the
effective dimension of the residuals; this loses links between dense groups
whose centroids lie further apart than that.

Inside a list, the table-lookup distance differs from the true one by no more
than the stored error, so what exceeds r + error is no neighbour; the rest is
reranked by exact cosine in double precision. This step loses no pair.

Lists lie packed in blocks of bounded size, in their order; a hot list is many
blocks. Two blocks meet once, as rows of a nested loop over the staged blocks,
if a vector of one probes a list of the other: vectors are dealt out once and no
pair of a vector and a list is ever written. A batch of such meetings gives back
sums of links and a spanning forest, never its pairs.

Vectors that are null, empty, zero or hold a null or non-finite component link
with nothing. Vectors of other lengths are never compared. Rows that share an
id are rows of their own; a null id is nobody's smallest. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plotwise.llm.common import batches, components, forest, thin
from plotwise.session import stage

COSINE, SAMPLE, SUBSPACES, CODES, BLOCK, MOST_LISTS, STEPS, SEED, DEVIATIONS = 0.95, 20_000, 8, 256, 1024, 4096, 8, 3, None


def kmeans(x: np.ndarray, k: int, steps: int = STEPS, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        near = nearest(x, c)[0]
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0][:, None]
    return c


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1))


def nearest(x: np.ndarray, c: np.ndarray, size: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    at, d = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    for i in range(0, len(x), size):
        q = squares(x[i : i + size], c)
        at[i : i + size] = q.argmin(1)
        d[i : i + size] = q.min(1)
    return at, d


class Quantiser:
    """Coarse centroids and residual codebooks over unit vectors of one length."""

    def __init__(self, x: np.ndarray, lists: int, subspaces: int = SUBSPACES, deviations: float | None = DEVIATIONS):
        self.coarse = kmeans(x, lists)
        self.cut = np.array_split(np.arange(x.shape[1]), min(subspaces, x.shape[1]))
        rest = x - self.coarse[nearest(x, self.coarse)[0]]
        self.books = [kmeans(np.ascontiguousarray(rest[:, s]), CODES) for s in self.cut]
        self.margin, self.once = reach(), deviations is None
        if deviations is not None:
            c = rest.T.astype(np.float64) @ rest
            k = max(1.0, np.trace(c) ** 2 / max((c * c).sum(), 1e-300))
            self.margin = min(self.margin, deviations * self.margin / k**0.5)

    @cached_property
    def apart(self) -> np.ndarray:
        """Distances between centroids, computed once per worker."""
        return np.sqrt(squares(self.coarse, self.coarse))

    def probed(self, x: np.ndarray, at: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Whether a vector filed under `at` has to probe each of `lists`."""
        own = ((x - self.coarse[at]) ** 2).sum(1)
        bound = squares(x, self.coarse[lists]) - own[:, None] <= 2 * self.apart[np.ix_(at, lists)] * (self.margin + 1e-4) + 1e-5
        if self.once:
            bound &= lists >= at[:, None]
        return bound | (lists == at[:, None])

    def encode(self, x: np.ndarray):
        """List, codes and error of each vector, and the lists it has to probe."""
        at, probes = nearest(x, self.coarse)[0], []
        for i in range(0, len(x), 1024):
            probes += [np.flatnonzero(b) for b in self.probed(x[i : i + 1024], at[i : i + 1024], np.arange(len(self.coarse)))]
        rest = x - self.coarse[at]
        codes = np.stack([nearest(np.ascontiguousarray(rest[:, s]), b)[0] for s, b in zip(self.cut, self.books)], axis=1)
        back = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)
        error = np.sqrt(((rest[:, np.concatenate(self.cut)] - back) ** 2).sum(1))
        return at, codes.astype(np.uint8), error, probes

    def fixed(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The part of a table distance that no query changes: |b|^2 + 2 c b, summed over the codes."""
        total = np.zeros(len(codes), np.float32)
        for j, (s, b) in enumerate(zip(self.cut, self.books)):
            part = b[codes[:, j]]
            total += (part * (part + 2 * self.coarse[at][:, s])).sum(1)
        return total

    def lookup(self, q: np.ndarray, at: int | np.ndarray, codes: np.ndarray, fixed: np.ndarray | None = None) -> np.ndarray:
        """Squared distances of coded members of list `at`, one or one a member, to queries.

        |q - c - b|^2 is |q - c|^2 + |b|^2 + 2 c b - 2 q b, and only the last part
        needs a query and a code: a table per subspace, summed over the codes, serves
        all lists at once. A code's row holds all queries, so a lookup copies whole rows.
        """
        at = np.broadcast_to(at, len(codes))
        lists, place = np.unique(at, return_inverse=True)
        total = squares(self.coarse[lists], q)[place] + (self.fixed(at, codes) if fixed is None else fixed)[:, None]
        for j, (s, b) in enumerate(zip(self.cut, self.books)):
            total += np.take(b @ (-2 * q[:, s].T), codes[:, j], axis=0)
        return np.maximum(total, 0, out=total)


def reach(cosine: float = COSINE) -> float:
    """Distance of unit vectors at that cosine."""
    return (2 - 2 * cosine) ** 0.5


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    return v / np.sqrt((v * v).sum(1))[:, None]


PACKED = {"cls": np.int64, "n": np.int64, "vec": np.float32, "home": np.int32, "codes": np.uint8, "error": np.float32}
BLOCKS = "blk long, lists array<int>, probes array<boolean>, " + ", ".join(f"{c} binary" for c in PACKED)


def pack(pdf: pd.DataFrame, model: Quantiser) -> pd.DataFrame:
    """A block of vectors as one row: its lists, the lists that any of its vectors probes, and each column's bytes."""
    pdf = pdf.sort_values(["list", "cls"])
    x = np.frombuffer(b"".join(pdf["vec"]), np.float32).reshape(len(pdf), -1)
    at, codes, error, probes = model.encode(unit(x).astype(np.float32))
    any_ = np.zeros(len(model.coarse), bool)
    any_[np.unique(np.concatenate(probes))] = True
    held = {"cls": pdf["cls"].to_numpy(), "n": pdf["n"].to_numpy(), "vec": x, "home": at, "codes": codes, "error": error}
    return pd.DataFrame([{"blk": int(pdf["blk"].iloc[0]), "lists": np.unique(at).tolist(), "probes": any_.tolist()} | {c: held[c].astype(k).tobytes() for c, k in PACKED.items()}])


def unpack(batch, i: int, side: str) -> dict[str, np.ndarray]:
    """Columns of one side of meeting `i`."""
    got = {c: np.frombuffer(batch[f"{side}_{c}"][i].as_buffer(), k) for c, k in PACKED.items()}
    return got | {c: got[c].reshape(len(got["cls"]), -1) for c in ("vec", "codes")}


def links_of(a: dict, b: dict, same: bool, model: Quantiser):
    """Links between queries of block `a` and members of block `b`: rows of `a` and of `b`, part by part."""
    xu, yu = unit(a["vec"]), unit(b["vec"])
    x, y = xu.astype(np.float32), yu.astype(np.float32)
    (la, ia), (lb, ib) = (np.unique(s["home"], return_inverse=True) for s in (a, b))
    there, back = model.probed(x, a["home"], lb), model.probed(y, b["home"], la)
    asks = np.flatnonzero(there.any(1) | back.any(0)[ia])
    meets = np.flatnonzero(back.any(1) | there.any(0)[ib])
    home, codes = b["home"][meets], b["codes"][meets]
    fixed, limit = model.fixed(home, codes), ((b["error"][meets] + np.float32(reach() + 1e-3)) ** 2)[:, None]
    for i in range(0, len(asks), 128):
        some = asks[i : i + 128]
        q, p = np.nonzero(model.lookup(x[some], home, codes, fixed) <= limit)
        for k in range(0, len(p), 1 << 17):
            r, m = some[p[k : k + (1 << 17)]], meets[q[k : k + (1 << 17)]]
            ok = there[r, ib[m]] | back[m, ia[r]]
            if same:
                ok &= r < m
            r, m = r[ok], m[ok]
            ok = np.einsum("ij,ij->i", xu[r], yu[m]) >= COSINE
            yield r[ok], m[ok]


def meetings(batch, model: Quantiser) -> dict[str, np.ndarray]:
    """(a, b, links) of a batch of meeting blocks: sums of links where a = b, else an edge of a spanning forest."""
    ids, sums, ei, ej = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(batch.num_rows):
        a, b = unpack(batch, i, "a"), unpack(batch, i, "b")
        mine, theirs = np.zeros(len(a["cls"]), np.int64), np.zeros(len(b["cls"]), np.int64)
        for p, q in links_of(a, b, batch["a_blk"][i] == batch["b_blk"][i], model):
            np.add.at(mine, p, b["n"][q])
            np.add.at(theirs, q, a["n"][p])
            # Only a spanning forest of this part's links is kept.
            x, y = spanning(a["cls"][p], b["cls"][q])
            ei.append(x)
            ej.append(y)
        ids += [a["cls"][mine > 0], b["cls"][theirs > 0]]
        sums += [mine[mine > 0], theirs[theirs > 0]]
    own, inv = np.unique(np.concatenate(ids), return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, inv, np.concatenate(sums))
    x, y = spanning(np.concatenate(ei), np.concatenate(ej))
    return {"a": np.concatenate([own, x]), "b": np.concatenate([own, y]), "links": np.concatenate([total, np.zeros(len(x), np.int64)])}


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links (a, b)."""
    both, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    m = len(inv) // 2
    root = forest(len(both), inv[:m], inv[m:])
    child = np.flatnonzero(root != np.arange(len(both)))
    return both[child], both[root[child]]


def dealt(members: dict[int, int], lists: int) -> list[tuple[int, int, int]]:
    """(list, first block, blocks): lists in order, packed into blocks of about `BLOCK` vectors; a large list has several of its own."""
    out, blk, filled = [], 0, 0
    for k in range(lists):
        n = members.get(k, 0)
        if filled and filled + n > BLOCK:
            blk, filled = blk + 1, 0
        parts = max(1, -(-n // BLOCK))
        out.append((k, blk, parts))
        filled += n
        if parts > 1:
            blk, filled = blk + parts, 0
    return out


def links(reps: DataFrame, dim: int, sample: int = SAMPLE, deviations: float | None = DEVIATIONS) -> DataFrame:
    """(a, b, links): sums of links of class a where a = b, else an edge of a spanning forest."""
    spark = reps.sparkSession
    mine = reps.where(F.col("dim") == dim)
    total = mine.count()
    got = sorted(thin(mine, ["cls"], sample).select("cls", "vec").collect())
    if not got:
        got = sorted(mine.select("cls", "vec").limit(1).collect())
    lists = int(max(1, min(MOST_LISTS, len(got) // 4 or 1, total**0.5)))
    x = unit(np.array([r.vec for r in got])).astype(np.float32)
    model = Quantiser(x, lists, deviations=deviations)
    held = spark.sparkContext.broadcast(model)  # at most MOST_LISTS + CODES vectors

    def file(b):
        v = np.array(b["vec"].to_pylist(), np.float32)
        return {"cls": b["cls"], "n": b["n"], "vec": [r.tobytes() for r in v], "list": nearest(unit(v).astype(np.float32), held.value.coarse)[0]}

    filed = batches(mine.select("cls", "n", "vec"), file, "cls long, n long, vec binary, list int")
    members = {r["list"]: r["count"] for r in filed.groupBy("list").count().collect()}
    places = F.broadcast(spark.createDataFrame(dealt(members, len(model.coarse)), "list int, first int, parts int"))  # a row a list
    blk = (F.col("first") + F.pmod(F.xxhash64("cls"), F.col("parts"))).alias("blk")
    packed = filed.join(places, "list").select(blk, "list", "cls", "n", "vec").groupBy("blk").applyInPandas(lambda pdf: pack(pdf, held.value), BLOCKS)
    packed = stage(packed, "pq-blocks")
    a, b = (packed.select(*[F.col(c).alias(f"{s}_{c}") for c in packed.columns]) for s in "ab")
    meet = F.exists("b_lists", lambda k: F.get("a_probes", k)) | F.exists("a_lists", lambda k: F.get("b_probes", k))
    pairs = a.join(b, (F.col("a_blk") <= F.col("b_blk")) & meet).drop(*[f"{s}_{c}" for s in "ab" for c in ("lists", "probes")])
    return batches(pairs, lambda b: meetings(b, held.value), "a long, b long, links long")


def near_duplicates(vectors: DataFrame, sample: int = SAMPLE, deviations: float | None = DEVIATIONS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<float>").alias("vec"))
    bad = F.coalesce(F.exists("vec", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))), F.lit(True)) | ~F.coalesce(F.exists("vec", lambda e: e != 0), F.lit(False))
    v = v.withColumn("cls", F.when(~bad, F.xxhash64("vec")))
    reps = stage(v.where("cls IS NOT NULL").groupBy("cls").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("vec").alias("vec")).withColumn("dim", F.size("vec")), "pq-classes")
    found = None
    for (dim,) in sorted(reps.select("dim").distinct().collect()):
        part = links(reps, dim, sample, deviations)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = stage(found, "pq-links")
    n = found.where("a = b").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("far"))
    comp = components(found.select("a", "b"))
    per = reps.drop("vec").join(n, "cls", "left").join(comp.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    per = stage(per.select("cls", "root", "low", (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("n_links")), "pq-result")
    low = per.groupBy("root").agg(F.min("low").alias("component_id"))
    out = v.drop("vec").join(per.join(low, "root").select("cls", "n_links", "component_id"), "cls", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
