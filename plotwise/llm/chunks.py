"""Document fingerprints from content-defined chunks.

A gear hash rolls over the last 16 bytes of the UTF-8 text. A chunk ends where
low bits of the hash are zero: six bits before the normal length, four beyond
it (normalised cutting keeps lengths close together), and at the greatest
length at the latest. Boundaries depend on the bytes around them alone, so
insertions move them but do not change those further on.

A fingerprint is the set of chunk digests, each with its chunk's length, in
order of the digests: `digest:length` in hex, comma-joined. Likeness is
containment: the length of the chunks also in the other set over the length of
all own chunks (1 for two empty sets, 0 if only the own one is empty).

`edited` texts need each document's follower. Documents are dealt to ranges of
(id, text hash), cut at quantiles of a sample of at most 8 ids a range, so that
repeated ids spread too; the first document of a range also goes to the range
before it. Each task then reads its ranges in order and holds two documents at
a time. Texts are shuffled once; long ones are hashed a megabyte at a time.

Order: descending id, a null id as the smallest, equal ids by descending hash
of the text, then by text. The last document is followed by the first, a single
one by itself. Null texts are empty texts: they have no chunk and an empty
fingerprint. Repeated rows are documents of their own. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from plotwise.llm.common import mixed, thin

WINDOW, LEAST, NORMAL, MOST, STRICT, LOOSE = 16, 16, 48, 192, 63, 15
SEGMENT = 1 << 20
RANGE_CHARS, MOST_RANGES, PER_RANGE = 1 << 21, 1 << 15, 8
FIRST = -(1 << 63)
GEAR = (mixed(np.arange(256), 13) >> np.uint64(48)).astype(np.uint16)


def gear(data: bytes) -> np.ndarray:
    """Hash of the 16 bytes before each end 16..len: sum of GEAR[byte] shifted by its distance, by doubling."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for reach in (1, 2, 4, 8):
        h[reach:] = h[reach:] + (h[:-reach] << np.uint16(reach))
    return h[WINDOW - 1 :]


def candidates(data: bytes) -> tuple[list[int], list[int]]:
    """Ends where a chunk may stop before, and after, its normal length."""
    strict, loose = [], []
    for i in range(0, max(1, len(data) - WINDOW + 1), SEGMENT):
        if len(data) < WINDOW:
            break
        h = gear(data[i : i + SEGMENT + WINDOW - 1])
        at = np.flatnonzero((h & LOOSE) == 0)
        loose += (at + (i + WINDOW)).tolist()
        strict += (at[(h[at] & STRICT) == 0] + (i + WINDOW)).tolist()
    return strict, loose


def ends(data: bytes) -> list[int]:
    """Ends of the chunks of a text, the last one at its end."""
    strict, loose = candidates(data)
    out, at, n = [], 0, len(data)
    while at < n:
        i = bisect_left(strict, at + LEAST)
        if i < len(strict) and strict[i] < at + NORMAL:
            at = strict[i]
        else:
            j = bisect_left(loose, at + NORMAL)
            at = min(loose[j] if j < len(loose) else n, at + MOST, n)
        out.append(at)
    return out


def digests(data: bytes, stops: list[int], start: int = 0) -> dict[int, int]:
    out = {}
    for stop in stops:
        out[xxhash.xxh64_intdigest(data[start:stop])] = stop - start
        start = stop
    return out


class Text:
    """A document with its chunks."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = self.text.encode("utf-8", "surrogatepass")
        self.ends = ends(self.data)
        self.chunks = digests(self.data, self.ends)

    def edited(self, follower: Text) -> tuple[str, dict[int, int]]:
        """The text with its last half replaced by the follower's beginning, and its chunks."""
        half = len(self.text) // 2
        if not half:
            return self.text, self.chunks
        head, tail = self.text[: len(self.text) - half], follower.text[:half]
        # Chunks that end within the head are those of the whole text.
        whole = bisect_left(self.ends, len(head.encode("utf-8", "surrogatepass")) + 1)
        at = self.ends[whole - 1] if whole else 0
        rest = (head + tail).encode("utf-8", "surrogatepass")[at:]
        return head + tail, digests(self.data, self.ends[:whole]) | digests(rest, ends(rest))


def write(chunks: dict[int, int]) -> str:
    return ",".join([f"{d:016x}:{n:x}" for d, n in sorted(chunks.items())])


def likeness(own: dict[int, int], other: dict[int, int]) -> float:
    if not own:
        return float(not other)
    return sum(n for d, n in own.items() if d in other) / sum(own.values())


def ranges(docs: DataFrame, ident: str, size: int) -> list[tuple[int, int]]:
    """Ascending (id, hash) cuts between ranges of about `size` code points."""
    total = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = min(MOST_RANGES, -(-total // size))
    if n < 2:
        return []
    got = sorted(map(tuple, thin(docs.select(ident, "_hash"), [ident, "_hash"], n * PER_RANGE).collect()))
    return sorted({got[len(got) * i // n] for i in range(1, n)}) if got else []


def in_range(cuts: list[tuple[int, int]]):
    """Column function (id, hash) -> number of cuts up to it."""
    ids, hashes = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)

    @F.pandas_udf("int")
    def number(ident: pd.Series, h: pd.Series) -> pd.Series:
        i, h = ident.to_numpy(), h.to_numpy()
        low, high = np.searchsorted(ids, i, "left"), np.searchsorted(ids, i, "right")
        for at in np.unique(low[low < high]):
            same = (low == at) & (low < high)
            low[same] += np.searchsorted(hashes[at : high[same][0]], h[same], "right")
        return pd.Series(low.astype(np.int32))

    return number


def fingerprints(docs: DataFrame, size: int = RANGE_CHARS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    spark = docs.sparkSession
    d = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("_id"), F.xxhash64("text").alias("_hash"))
    cuts = ranges(d, "_id", size)
    d = d.withColumn("_range", in_range(cuts)("_id", "_hash") if cuts else F.lit(0))
    # The first document of each range: at most MOST_RANGES rows of numbers.
    heads = sorted((r["_range"], *r["head"]) for r in d.groupBy("_range").agg(F.max(F.struct("_id", "_hash")).alias("head")).collect())
    before = [(heads[(i + 1) % len(heads)][0], ident, h) for i, (_, ident, h) in enumerate(heads)]
    tails = F.broadcast(spark.createDataFrame(before, "_to int, _id long, _hash long"))
    copies = d.join(tails, ["_id", "_hash"]).select("doc_id", "text", "_id", "_hash", F.col("_to").alias("_range"), F.lit(True).alias("_tail"))
    dealt = d.withColumn("_tail", F.lit(False)).unionByName(copies).repartition("_range")
    dealt = dealt.sortWithinPartitions("_range", "_tail", F.desc("_id"), F.desc("_hash"), F.desc("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    target = to_arrow_schema(_parse_datatype_string(schema))

    def row(ident, own: Text, follower: Text) -> dict:
        text, chunks = own.edited(follower)
        return {"doc_id": ident, "n_chars": len(own.text), "edited_sha256": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": write(own.chunks), "edited_fingerprint": write(chunks),
                "near_edited": likeness(own.chunks, chunks), "near_next": likeness(own.chunks, follower.chunks)}

    def run(it):
        held = None  # the document that waits for its follower
        for b in it:
            rows = []
            for ident, text, part, tail in zip(b["doc_id"].to_pylist(), b["text"], b["_range"].to_pylist(), b["_tail"].to_pylist()):
                if tail and held is None:
                    continue  # further copies of a first document that stands several times
                own = Text(text.as_py())
                if held is not None:
                    rows.append(row(*held, own))
                held = None if tail else (ident, own)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    return dealt.select("doc_id", "text", "_range", "_tail").mapInArrow(run, schema)
