"""Exact nearest vectors by cosine, on cells with a radius.

Every vector lies in the cell of its nearest pivot, and each cell knows how far
its members reach. By the triangle inequality no member of a cell is more
similar to a query than 1 - (|q - pivot| - radius)^2 / 2. Vectors and queries
of a cell are packed into blocks, a row each, and dealt out once. A query takes
its floor from a block of its own cell: its k-th answer is that good at least.
Blocks then meet in a nested loop, if the cell can beat the floor of one of the
queries; a task keeps the k best of the queries it holds while vectors pass, so
only k rows a query and part of the vectors come back, and no pair of a query
and a cell is ever written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from plotwise.session import stage

PIVOTS, BLOCK = 1024, 2048
VISITS = 1 << 15  # rows times cells looked at in one go
PART = 1 << 27  # bytes of vectors that pass by a task's queries
HELD = 64  # blocks of queries a task keeps answers of at most
NEAR = 1e-9  # similarities are told apart to nine digits; closer ones go to the smaller id


def _unit(column) -> np.ndarray:
    v = np.array(list(column), dtype=float)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1), 0))


def _slices(pdf: pd.DataFrame, cells: int):
    """Parts of a batch whose rows times cells stay few, so that neither distances nor visits fill the memory."""
    step = max(1, VISITS // max(1, cells))
    return (pdf.iloc[i : i + step] for i in range(0, len(pdf), step))


def cosine_topk(corpus: DataFrame, queries: DataFrame, vid: str, vec: str, k: int = 10, threshold: float = -1.0, most_pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """qid, id, similarity, rn: the k most similar vectors of every query, above a threshold.

    A vector is not its own answer. A zero vector has similarity 0 to all;
    null vectors neither ask nor answer. Pivots are vectors of the corpus,
    `most_pivots` at most: beyond that cells hold more blocks.
    """
    spark = corpus.sparkSession
    vt = dict(corpus.dtypes)[vid]
    wide = {n: np.float32 if dict(d.dtypes)[vec] == "array<float>" else np.float64 for n, d in (("c", corpus), ("q", queries))}
    c, q = (d.where(F.col(vec).isNotNull()).select(F.col(vid).alias("id"), F.transform(vec, lambda e: e.cast("double")).alias("v")) for d in (corpus, queries))
    total = c.count()
    none = spark.createDataFrame([], f"qid {vt}, {vid} {vt}, similarity double, rn int")
    if not total:
        return none
    n = max(1, min(most_pivots, -(-total // block)))
    drawn = c.orderBy(F.xxhash64("id"), "id").limit(n).collect()  # most_pivots vectors at most
    shared = spark.sparkContext.broadcast(_unit([r["v"] for r in drawn]))

    def filed(d: DataFrame, kind) -> DataFrame:
        """Vectors with their cell; its number is -1 for zero vectors."""
        def place(batches):
            for pdf in batches:
                for part in _slices(pdf, len(shared.value)):
                    x = _unit(part["v"])
                    d = _apart(x, shared.value)
                    at = d.argmin(1)
                    zero = ~x.any(1)
                    raw = np.array(list(part["v"]), dtype=kind)
                    yield pd.DataFrame({"cell": np.where(zero, -1, at).astype(np.int32), "reach": np.where(zero, 0.0, np.nan_to_num(d[np.arange(len(x)), at])), "id": part["id"], "v": [r.tobytes() for r in raw]})

        return d.mapInPandas(place, f"cell int, reach double, id {vt}, v binary")

    def packed(d: DataFrame, counts: list[tuple[int, int]]) -> DataFrame:
        """cell, m, ids, v: blocks of about `block` vectors of a cell, as a row each."""
        parts = F.broadcast(spark.createDataFrame([(i, -(-m // block)) for i, m in counts], "cell int, mb int"))  # a row a pivot
        dealt = d.join(parts, "cell").withColumn("m", F.pmod(F.xxhash64("id", "v"), F.col("mb")).cast("int")).select("cell", "m", "id", "v")
        each = lambda t: pa.table({"cell": t["cell"][:1], "m": t["m"][:1], "ids": pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), pa.concat_arrays(t["id"].chunks)), "v": pa.array([b"".join(t["v"].to_pylist())])})
        return dealt.groupBy("cell", "m").applyInArrow(each, f"cell int, m int, ids array<{vt}>, v binary")

    cfiled, qfiled = filed(c, wide["c"]), filed(q, wide["q"])
    cells = sorted(map(tuple, cfiled.groupBy("cell").agg(F.max("reach"), F.count("*")).collect()))  # a row a pivot
    asked = sorted(map(tuple, qfiled.groupBy("cell").count().collect()))  # a row a pivot
    if not asked:
        return none
    number = np.array([r[0] for r in cells])
    pivots = np.array([shared.value[i] if i >= 0 else np.zeros_like(shared.value[0]) for i in number])
    held = spark.sparkContext.broadcast((number, pivots, np.array([r[1] for r in cells])))
    least = max(float(threshold), -1.0)
    places = F.broadcast(spark.createDataFrame([(int(i), at) for at, i in enumerate(number)], "cell int, at int"))  # a row a pivot
    vectors = stage(packed(cfiled, [(i, m) for i, _, m in cells]).join(places, "cell"), "vector-cells")

    def block_of(ids, v, kind) -> tuple[np.ndarray, np.ndarray]:
        """Ids and unit vectors of a packed block."""
        ids = ids.values
        x = np.frombuffer(v.as_buffer(), kind).reshape(len(ids), -1)
        known = ids.to_numpy(zero_copy_only=False) if not ids.null_count else np.array(ids.to_pylist(), object)
        return known, _unit(x)

    def bounds(x: np.ndarray, at) -> np.ndarray:
        """The best similarity that members of cells can have to vectors."""
        number, pivots, reach = held.value
        best = 1 - np.maximum(_apart(x, pivots[at]) - reach[at] - 1e-7, 0) ** 2 / 2
        best[:, number[at] < 0], best[~x.any(1)] = 0.0, 0.0
        return best

    def itself(asks, ids) -> np.ndarray:
        """Whether ids are the same; a null id is nobody's."""
        same = asks == ids
        return same & ~(pd.isna(asks) & pd.isna(ids)) if asks.dtype == object else same

    asking = to_arrow_schema(_parse_datatype_string(f"blk long, ids array<{vt}>, v binary, floor binary, asks array<boolean>"))

    def floors(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asks, x = block_of(batch["ids"][i], batch["v"][i], wide["q"])
                floor = np.full(len(x), least)
                if batch["c_v"][i].is_valid:
                    ids, y = block_of(batch["c_ids"][i], batch["c_v"][i], wide["c"])
                    for j in range(0, len(x) if len(y) >= k else 0, 256):
                        s = np.round(x[j : j + 256] @ y.T, 9)
                        s[itself(asks[j : j + 256, None], ids[None, :])] = -2.0
                        floor[j : j + 256] = np.maximum(least, np.partition(s, len(y) - k, axis=1)[:, len(y) - k])
                some = np.zeros(len(held.value[0]), bool)
                for j in range(0, len(x), max(1, VISITS // len(some))):
                    t = slice(j, j + max(1, VISITS // len(some)))
                    some |= (bounds(x[t], np.arange(len(some))) >= floor[t, None] - NEAR).any(0)
                yield pa.RecordBatch.from_arrays([batch["blk"].slice(i, 1), batch["ids"].slice(i, 1), batch["v"].slice(i, 1), pa.array([floor.tobytes()]), pa.array([some.tolist()])], schema=asking)

    own = vectors.where("m = 0").select("cell", F.col("ids").alias("c_ids"), F.col("v").alias("c_v"))
    blocks = packed(qfiled, asked).join(own, "cell", "left").withColumn("blk", F.monotonically_increasing_id()).select("blk", "ids", "v", "c_ids", "c_v")
    probes = stage(blocks.mapInArrow(floors, "blk long, ids " + f"array<{vt}>, v binary, floor binary, asks array<boolean>"), "vector-probes")

    answer = to_arrow_schema(_parse_datatype_string(f"qid {vt}, id {vt}, similarity double"))

    def meet(batches):
        kept = {}  # block of queries -> its ids, vectors, floors, and rows, ids and similarities of the best so far

        def flush(blk):
            qids, _, _, row, ids, sim = kept.pop(blk)
            return pa.RecordBatch.from_arrays([qids.take(pa.array(row)), ids, pa.array(sim)], schema=answer)

        for batch in batches:
            for i in range(batch.num_rows):
                blk = batch["blk"][i].as_py()
                if blk not in kept:
                    if len(kept) >= HELD:
                        yield flush(next(iter(kept)))
                    asks, x = block_of(batch["ids"][i], batch["v"][i], wide["q"])
                    mine = pa.array(batch["ids"][i].values.to_pylist(), answer.field("qid").type)  # copies, as a view would hold the whole batch
                    kept[blk] = [mine, (asks.copy(), x), np.frombuffer(batch["floor"][i].as_buffer(), float).copy(), np.zeros(0, int), pa.array([], answer.field("id").type), np.zeros(0)]
                qids, (asks, x), floor, row, best, sim = kept[blk]
                near = np.flatnonzero(bounds(x, [batch["c_at"][i].as_py()])[:, 0] >= floor - NEAR)
                if not len(near):
                    continue
                ids, y = block_of(batch["c_ids"][i], batch["c_v"][i], wide["c"])
                rows, cols, sims = [row], [], [sim]
                for j in range(0, len(near), 256):
                    part = near[j : j + 256]
                    s, bar = x[part] @ y.T, np.maximum(floor[part] - NEAR, least)
                    r, col = np.nonzero(s >= bar[:, None] - NEAR)
                    exact = np.round(s[r, col], 9)
                    ok = (exact >= bar[r]) & ~itself(asks[part[r]], ids[col])
                    rows.append(part[r[ok]])
                    cols.append(col[ok])
                    sims.append(exact[ok])
                if sum(map(len, cols)):
                    row, sim = np.concatenate(rows), np.concatenate(sims)
                    best = pa.concat_arrays([best, batch["c_ids"][i].values.take(pa.array(np.concatenate(cols)))])
                    rank = np.empty(len(best), int)
                    rank[pc.array_sort_indices(best, null_placement="at_start").to_numpy()] = np.arange(len(best))
                    order = np.lexsort((rank, -sim, row))
                    place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
                    floor[row[order[place == k - 1]]] = np.maximum(floor[row[order[place == k - 1]]], sim[order[place == k - 1]])
                    order = order[place < k]
                    kept[blk] = [qids, (asks, x), floor, row[order], best.take(pa.array(order)), sim[order]]
        yield from (flush(blk) for blk in list(kept))

    size = total * len(shared.value[0]) * np.dtype(wide["c"]).itemsize
    right = vectors.select(F.col("at").alias("c_at"), F.col("ids").alias("c_ids"), F.col("v").alias("c_v")).coalesce(-(-size // PART))
    pairs = probes.join(right, F.get("asks", F.col("c_at"))).drop("asks")
    rank = Window.partitionBy("qid").orderBy(F.desc("similarity"), "id")
    found = stage(pairs.mapInArrow(meet, f"qid {vt}, id {vt}, similarity double"), "vector-hits")
    return found.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= k).withColumnRenamed("id", vid)
