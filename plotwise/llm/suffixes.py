"""Byte-exact repeats by suffix arrays built with linear grouping.

Every byte covered by a string of LENGTH bytes that also starts elsewhere in
the corpus (or in the same text) is removed. Strings are judged on the input
and never cross a text.

1. Windows of LENGTH bytes are named by their anchor, the rightmost smallest
   hash of GRAM bytes in the window; equal windows have equal anchors at equal
   offsets. Neighbouring windows of one anchor are a context.
2. Anchors that occur once are done. Contexts that occur twice are repeated as
   a whole. Of the rest one representative goes on.
3. A context is cut into units of STEP windows. The bytes that all windows of
   a unit share are its core. Units that occur twice are repeated; units whose
   core occurs once are not.
4. What is left straddles the border of a repeat. The core is written as one
   symbol, so a window is exactly STEP symbols, and the units of a block of
   cores make one string whose suffix array tells each window's nearest equal:
   a window is repeated if a neighbouring suffix shares STEP symbols.

The suffix array is built by linear grouping: suffixes are grouped by first
symbol, groups are processed in descending order, and the previous smaller
suffixes of a group's members move to new groups right above their own, by how
many members point at them. Each group then holds the suffixes of one Lyndon
prefix, and one scan emits their order; nothing is renamed.

Counting is done with map-side sums, so a passage in a third of all texts is
one row per task. A core with very many different units is split into single
windows, dealt by their content. Positions live in tables; only block-sized
strings are ever in one task.

Null texts are empty. Texts under LENGTH bytes keep all. Equal rows repeat
each other like any two texts. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from plotwise.llm.common import batches, mixed, settle
from plotwise.session import stage

LENGTH, GRAM, STEP = 200, 32, 16
WIDE = 20_000
SEGMENT = 1 << 22


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of `text` (symbols of at least 1), by linear grouping."""
    s = [*text, 0]
    n = len(s)
    where: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        where.setdefault(c, []).append(i)
    members = [where[c] for c in sorted(where)]
    group = [0] * n
    for g, m in enumerate(members):
        for i in m:
            group[i] = g
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    smaller, jump, done, order = [-1] * n, [-1] * n, [False] * n, []
    g = len(members) - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        members[g] = mine
        if mine:
            order.append(g)
        pointed: dict[int, int] = {}
        for i in mine:
            # The previous suffix of a smaller group: all groups processed so far are larger, and earlier members are equal.
            j = i - 1
            while j >= 0 and done[j]:
                k = jump[j]
                if k >= 0 and done[k]:
                    jump[j] = k = jump[k]
                j = k
            smaller[i] = jump[i] = j
            done[i] = True
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        moves: dict[tuple[int, int], list[int]] = {}
        for p, times in pointed.items():
            moves.setdefault((-times, group[p]), []).append(p)
        # Those with most pointers are the largest: they go right above their group first, the others between.
        for _, h in sorted(moves):
            new, moved = len(members), moves[_, h]
            moved.sort()
            members.append(moved)
            for p in moved:
                group[p] = new
            up = above[h]
            below.append(h)
            above.append(up)
            above[h] = new
            if up >= 0:
                below[up] = new
        g = below[g]
    start, at = [0] * len(members), 0
    for g in reversed(order):
        start[g] = at
        at += len(members[g])
    out, placed = [-1] * n, [False] * n
    out[0], placed[n - 1] = n - 1, True
    start[group[n - 1]] += 1
    for k in range(n):
        i = out[k] - 1
        while i >= 0 and not placed[i]:
            g = group[i]
            out[start[g]] = i
            start[g] += 1
            placed[i] = True
            i = smaller[i]
    return out[1:]


def gram_hashes(a: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of each run of `gram` bytes, a power of two, by doubling."""
    h = mixed(a, 1) >> np.uint64(24)
    n = 1
    while n < gram:
        h = h[:-n] * np.uint64(0x9E3779B97F4A7C15 * (2 * n + 1) & (2**64 - 1)) + h[n:]
        h ^= h >> np.uint64(29)
        n *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def contexts(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """(first start, last start, anchor position, anchor, context) of a text's windows."""
    whole = np.frombuffer(data, np.uint8)
    out = []
    for begin in range(0, len(whole) - LENGTH + 1, SEGMENT):
        a = whole[begin : begin + SEGMENT + LENGTH - 1]
        h = gram_hashes(a) & np.uint64((1 << 64) - (1 << 24))
        # The low bits prefer the rightmost of equal hashes.
        m = h | (np.uint64((1 << 24) - 1) - np.arange(len(h), dtype=np.uint64))
        n, width = 1, LENGTH - GRAM + 1
        while 2 * n <= width:
            m = np.minimum(m[:-n], m[n:])
            n *= 2
        if width > n:
            m = np.minimum(m[: len(m) - (width - n)], m[width - n :])
        first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        last = np.concatenate([first[1:], [len(m)]]) - 1
        m = m[first]
        at = ((1 << 24) - 1) - (m & np.uint64((1 << 24) - 1)).astype(np.int64)
        name = (m >> np.uint64(24)).astype(np.int64)
        for lo, hi, p, anchor in zip((first + begin).tolist(), (last + begin).tolist(), (at + begin).tolist(), name.tolist()):
            out.append((lo, hi, p, anchor, xxhash.xxh64_intdigest(data[lo : hi + LENGTH], seed=p - lo) - (1 << 63)))
    return out


def units(data: bytes, lo: int, hi: int, at: int):
    """(core start, least and most bytes before the core, core, unit, left, right) of a context's units."""
    for b in range((at - hi) // STEP, (at - lo) // STEP + 1):
        c = at - STEP * b  # the unit's last start, and where its core begins
        least, most = max(0, c - hi), min(STEP - 1, c - lo)
        end = c + LENGTH - STEP + 1
        left, right = data[c - most : c], data[end : end + STEP - 1 - least]
        core = xxhash.xxh64_intdigest(data[c:end], seed=b) - (1 << 63)
        yield c, least, most, core, xxhash.xxh64_intdigest(left + b"|" + right, seed=len(left) * STEP + len(right)) - (1 << 63), left, right


def repeated(pdf: pd.DataFrame) -> list[np.ndarray]:
    """For each unit of a block, which of its windows (by bytes before the core) some other window equals."""
    number = {c: i for i, c in enumerate(sorted(set(pdf["core"])), 258)}
    text, at = [], []
    for core, left, right in zip(pdf["core"], pdf["left"], pdf["right"]):
        at.append(len(text) + len(left))
        text += [b + 2 for b in left]
        text.append(number[core])
        text += [b + 2 for b in right]
        text.append(1)
    order = np.array(suffix_array(text), np.int64)
    sym = np.array(text + [0] * STEP, np.int64)
    same = np.ones(len(order) - 1, bool)
    for j in range(STEP):
        same &= sym[order[1:] + j] == sym[order[:-1] + j]
    hit = np.zeros(len(sym), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return [np.array([d for d in range(lo, hi + 1) if n > 1 or hit[a - d]], np.int64) for a, lo, hi, n in zip(at, pdf["least"], pdf["most"], pdf["n"])]


def block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Starts of the repeated windows of the units that occur once."""
    pdf = pdf.sort_values(["core", "unit", "least", "most"]).reset_index(drop=True)
    found = repeated(pdf)
    keep = [i for i, (n, f) in enumerate(zip(pdf["n"], found)) if n == 1 and len(f)]
    runs = [(pdf["key"][i], pdf["c"][i] - d) for i in keep for d in found[i].tolist()]
    return pd.DataFrame({"key": [k for k, _ in runs], "lo": [x for _, x in runs], "hi": [x for _, x in runs]}).astype("int64")


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left without the windows that start in the spans; removed bytes and runs."""
    out, removed, runs, at, end = [], 0, 0, 0, -1
    for lo, hi in sorted(spans):
        if lo > end:
            if end >= 0:
                at = end
            out.append(data[at:lo])
            runs += 1
            at = lo
            removed += hi + LENGTH - lo
            end = hi + LENGTH
        elif hi + LENGTH > end:
            removed += hi + LENGTH - end
            end = hi + LENGTH
    out.append(data[max(at, end) if runs else 0 :])
    return b"".join(out), removed, runs


def repeats(docs: DataFrame, wide: int = WIDE, parts: int | None = None) -> DataFrame:
    """(key, lo, hi): ranges of window starts that are repeated, per row key of docs (key, data)."""
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def found(b):
        got = [(k, c) for k, d in zip(b["key"].to_pylist(), b["data"].to_pylist()) for c in contexts(d)]
        return {"key": [k for k, _ in got], **{name: [c[j] for _, c in got] for j, name in enumerate(("lo", "hi", "at", "anchor", "ctx"))}}

    every = stage(batches(docs, found, "key long, lo int, hi int, at int, anchor long, ctx long"), "contexts")
    twice = stage(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    shared = stage(every.join(twice, "anchor"), "shared-contexts")
    settle(spark, every, twice)
    kinds = stage(shared.groupBy("anchor", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("key", "lo", "hi", "at")).alias("r")), "context-kinds")
    many = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    whole = stage(shared.join(kinds.where("n > 1").select("anchor", "ctx"), ["anchor", "ctx"]).select("key", "lo", "hi"), "whole-contexts")
    first = stage(kinds.join(many, "anchor").select("r.key", F.struct("r.lo", "r.hi", "r.at", (F.col("n") == 1).alias("lone")).alias("c")).groupBy("key").agg(F.collect_list("c").alias("cs")), "representatives")
    settle(spark, shared, kinds)

    def cut(b):
        names = ("key", "lone", "c", "least", "most", "core", "unit", "left", "right")
        got = [(key, x["lone"], *u) for key, d, cs in zip(b["key"].to_pylist(), b["data"].to_pylist(), b["cs"].to_pylist()) for x in cs for u in units(d, x["lo"], x["hi"], x["at"])]
        return {k: [g[j] for g in got] for j, k in enumerate(names)}

    unit = stage(batches(docs.join(first, "key"), cut, "key long, lone boolean, c int, least int, most int, core long, unit long, left binary, right binary"), "units")
    settle(spark, first)
    kind = stage(unit.groupBy("core", "unit").agg(F.count("*").alias("n"), F.min(F.struct("key", "c", "least", "most", "left", "right")).alias("r")).select("core", "unit", "n", "r.*"), "unit-kinds")
    full = unit.where("lone").join(kind.where("n > 1").select("core", "unit"), ["core", "unit"]).select("key", (F.col("c") - F.col("most")).alias("lo"), (F.col("c") - F.col("least")).alias("hi"))
    cores = kind.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1")
    border = stage(kind.join(cores, "core"), "border-units")
    deal = F.pmod(F.xxhash64("core"), F.lit(parts))
    sorted_out = border.where(F.col("kinds") <= wide).withColumn("deal", deal).repartition(parts, "deal").groupBy("deal").applyInPandas(block, "key long, lo long, hi long")
    # A core with very many units: its windows one by one; equal ones are counted together.
    single = border.where(F.col("kinds") > wide).withColumn("d", F.explode(F.sequence("least", "most")))
    single = single.withColumn("text", F.concat(F.expr("substring(left, length(left) - d + 1, d)"), F.expr(f"substring(right, 1, {STEP - 1} - d)"))).select("core", "d", "text", "key", "c")
    often = single.groupBy("core", "d", "text").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    counted = single.join(often, ["core", "d", "text"]).select("key", (F.col("c") - F.col("d")).alias("lo"), (F.col("c") - F.col("d")).alias("hi"))
    spans = stage(whole.unionAll(full).unionAll(sorted_out).unionAll(counted).select("key", F.col("lo").cast("int"), F.col("hi").cast("int")), "repeats")
    settle(spark, unit, kind, border, whole)
    return spans


def dedup(docs: DataFrame, wide: int = WIDE, parts: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes (`kept`) of every row."""
    rows = docs.select("doc_id", F.coalesce(F.encode("text", "utf-8"), F.lit(b"")).alias("data"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "data"))
    spans = repeats(rows.select("key", "data"), wide, parts)
    per = spans.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def remove(b):
        got = [kept_bytes(d, [(x["lo"], x["hi"]) for x in s or ()]) for d, s in zip(b["data"].to_pylist(), b["spans"].to_pylist())]
        return {"doc_id": b["doc_id"], "n_bytes": [len(d) for d in b["data"].to_pylist()], "n_removed": [n for _, n, _ in got], "n_spans": [n for _, _, n in got], "kept": [k for k, _, _ in got]}

    return batches(rows.join(per, "key", "left").select("doc_id", "data", "spans"), remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
