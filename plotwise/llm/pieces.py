"""SentencePiece encoding and decoding through a relational lattice.

A text, opened by one blank, is cut into units: a run of marks (punctuation and
digits, as listed in MARKS) with the carriage returns after it, of other
characters, or of carriage returns, each with all blanks before it; blanks
alone; or another single white-space character. The public vocabulary has no
piece across such a cut, so it costs no path. All substrings of a unit up to
the longest piece are exploded and equi-joined to the piece table; the matches
are the edges of the unit's lattice. Edges are grouped by unit and a
higher-order aggregate folds them in order of their ends, keeping the best path
to each position (Viterbi). A character that no piece covers is spelt in byte
pieces, so every text can be decoded exactly.

The vocabulary is given, never trained. Where its scores are merge ranks, not
log probabilities, edges score -ln(rank) - PIECE_COST: Zipf's law over the ranks
and a cost per piece.

Frequent units are solved once by that lattice: a heavy-hitter count over all
texts picks at most HOT units, whose solutions are small enough to broadcast.
All other units are rare, so a lattice of rows would be built for each about
once a text. They meet the piece table as a trie in arrays and go through the
same recursion, with the same ties, where the text is assembled: all distinct
ones of a part of a batch at once, position by position. Units of over UNIT
code points are solved one by one in linear space. Texts are not shuffled.

A null text has no ids and decodes to the empty text. Every row is returned,
repeated ones as often as they come; other columns are passed through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plotwise.llm.common import batches
from plotwise.session import stage

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIT, PIECE_COST, BYTE_COST, HOT, PER_TASK, HELD, PART, BLOCK = 48, 10.0, 60.0, 400_000, 100_000, 1 << 24, 1 << 21, 1 << 18
# Code points, not character classes, whose content differs between Java and Python.
MARKS = r"!-@\[-`{-~\u00a1-\u00a9\u00ab-\u00b4\u00b6-\u00b9\u00bb-\u00bf\u2010-\u206f\u3001-\u303f"
UNITS = rf" *[^ \t-\r{MARKS}]+| *[{MARKS}]+\r*| *\r+| +|[\t\n\x0b\x0c]"
UNITS_PY = re.compile(UNITS)
WORDS = re.compile(" *[^ ]+| +")


class Model:
    """The piece table of a model file, blanks in place of the mark."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        ranked = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        scores = {i: sp.get_score(i) for i in plain}
        # Merge ranks are whole numbers, log probabilities are not.
        by_rank = all(float(s).is_integer() for s in scores.values())
        self.rows = [(sp.id_to_piece(i).replace("▁", " "), i, -math.log(r) - PIECE_COST if by_rank else float(scores[i])) for r, i in enumerate(ranked, 1)]
        self.unknown = sp.unk_id()
        byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.first_byte = byte[0] if len(byte) == 256 and all(byte[b] == byte[0] + b for b in byte) else None
        self.bytes = [b""] * n
        for piece, i, _ in self.rows:
            self.bytes[i] = piece.encode()
        for b, i in byte.items():
            self.bytes[i] = bytes([b])
        self.longest = max((len(p) for p, _, _ in self.rows), default=1)

    def spelling(self) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' bytes in one array, and the length of each."""
        return np.frombuffer(b"".join(self.bytes), np.uint8), np.array([len(b) for b in self.bytes], np.int64)

    def table(self, spark: SparkSession) -> DataFrame:
        return stage(spark.createDataFrame(self.rows or [("", 0, 0.0)], "piece string, id int, score double"), "pieces")


def best_path(edges: Column) -> Column:
    """Ids of the best path through edges (end, start, score, ids); on ties the longer last piece."""
    begin = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids"))).cast("array<struct<score:double,ids:array<int>>>")

    def step(best: Column, e: Column) -> Column:
        back, last = F.get(best, e["start"]), F.get(best, e["end"])
        score = back["score"] + e["score"]
        here = F.array(F.struct(score.alias("score"), F.concat(back["ids"], e["ids"]).alias("ids")))
        return F.when(last.isNull(), F.concat(best, here)).when(score > last["score"], F.concat(F.slice(best, F.lit(1), e["end"]), here)).otherwise(best)

    return F.aggregate(F.sort_array(edges), begin, step, lambda best: F.element_at(best, -1)["ids"])


def segment(unit: str, table: dict[str, tuple[int, float]], model: Model) -> list[int]:
    """Ids of the best path through one long unit; ties as in `best_path`."""
    best, back = [0.0], [0]
    for e in range(1, len(unit) + 1):
        top, at = -math.inf, e - 1
        for s in range(max(0, e - model.longest), e):
            part = unit[s:e]
            if part in table:
                score = best[s] + table[part][1]
            elif e - s == 1:
                score = best[s] + len(part.encode()) * -BYTE_COST
            else:
                continue
            if score > top:
                top, at = score, s
        best.append(top)
        back.append(at)
    parts, e = [], len(unit)
    while e:
        parts.append(unit[back[e] : e])
        e = back[e]
    other = lambda c: [model.unknown] if model.first_byte is None else [b + model.first_byte for b in c.encode()]
    return [i for c in reversed(parts) for i in ([table[c][0]] if c in table else other(c))]


def lattice(units: DataFrame, table: DataFrame, model: Model) -> DataFrame:
    """(unit, ids) of distinct units."""
    n = F.length("unit")
    parts = units.withColumn("start", F.explode(F.sequence(F.lit(0), n - 1)))
    parts = parts.withColumn("len", F.explode(F.sequence(F.lit(1), F.least(F.lit(model.longest), n - F.col("start")))))
    parts = parts.withColumn("piece", F.substring(F.col("unit"), F.col("start") + 1, F.col("len")))
    # One row a piece: the table is as large as the vocabulary.
    met = parts.join(F.broadcast(table), "piece", "left").where("id IS NOT NULL OR len = 1")
    if model.first_byte is None:
        other = F.array(F.lit(model.unknown))
    else:
        spelt = F.hex(F.encode("piece", "utf-8"))
        other = F.transform(F.sequence(F.lit(0), F.octet_length("piece") - 1), lambda i: F.conv(F.substring(spelt, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + model.first_byte)
    edge = F.struct((F.col("start") + F.col("len")).alias("end"), "start", F.coalesce("score", F.octet_length("piece") * -BYTE_COST).alias("score"), F.when(F.col("id").isNotNull(), F.array("id")).otherwise(other).alias("ids"))
    grouped = met.select("unit", edge.alias("edge")).groupBy("unit").agg(F.collect_list("edge").alias("edges"))
    return grouped.select("unit", best_path(F.col("edges")).alias("ids"))


class Trie:
    """The piece table as arrays: a child's key is its parent's number and the letter, and each node names its piece."""

    def __init__(self, model: Model):
        table: dict[str, tuple[int, float]] = {}
        for p, i, score in model.rows:
            table.setdefault(p, (i, score))  # rows come best first
        letters = sorted({c for p in table for c in p})
        self.letter = np.zeros(0x110000, np.int64)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        number, keys = {"": 0}, {}
        for p in table:
            for k in range(1, len(p) + 1):
                if p[:k] not in number:
                    number[p[:k]] = len(number)
                    keys[number[p[: k - 1]] * self.width + int(self.letter[ord(p[k - 1])])] = number[p[:k]]
        self.keys = np.array(sorted(keys), np.int64)
        self.child = np.array([keys[k] for k in sorted(keys)], np.int64)
        self.piece, self.score = np.full(len(number), -1, np.int64), np.zeros(len(number))
        for p, (i, score) in table.items():
            self.piece[number[p]], self.score[number[p]] = i, score
        self.unknown, self.first_byte, self.n = model.unknown, model.first_byte, len(model.bytes)

    def edges(self, text: np.ndarray, last: np.ndarray):
        """(begin, end, score, ids) of all pieces in the text that end by `last`, and ids of characters that are none: n and more are places in `spelt`."""
        found, letter = [], self.letter[text]
        at, node = np.arange(len(text) if len(self.keys) else 0), np.zeros(len(text) if len(self.keys) else 0, np.int64)
        bare, n = np.ones(len(text), bool), 0
        while len(at):
            key = node * self.width + letter[at + n]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            same = self.keys[k] == key
            at, node, n = at[same], self.child[k[same]], n + 1
            hit = self.piece[node] >= 0
            found.append((at[hit], at[hit] + n, self.score[node[hit]], self.piece[node[hit]]))
            if n == 1:
                bare[at[hit]] = False
            more = at + n < last[at]
            at, node = at[more], node[more]
        at = np.flatnonzero(bare)
        points, which = np.unique(text[at], return_inverse=True)
        spelt = [[self.unknown] if self.first_byte is None else [b + self.first_byte for b in chr(c).encode()] for c in points]
        octets = np.array([len(chr(c).encode()) for c in points], np.int64)
        found.append((at, at + 1, octets[which] * -BYTE_COST, self.n + which))
        return tuple(np.concatenate(x) for x in zip(*found)), spelt


def solve(units: list[str], trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best paths of units of few code points as one array, and where each unit's begin; ties as in `best_path`."""
    ids, sizes, held, at = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0, 0
    for k, u in enumerate(units, 1):
        held += len(u)
        if held >= BLOCK or k == len(units):
            some, size = best_paths(units[at:k], trie)
            ids, sizes, held, at = [*ids, some], [*sizes, size], 0, k
    return np.concatenate(ids), np.cumsum(np.concatenate(sizes))


def best_paths(units: list[str], trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the units' best paths, and how many each has. All units move on by one position a step."""
    size = np.fromiter(map(len, units), np.int64, len(units))
    text = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
    stop, unit = np.cumsum(size), np.repeat(np.arange(len(units)), size)
    (begin, end, score, piece), spelt = trie.edges(text, np.repeat(stop, size))
    # A unit of n characters has n + 1 places, so unit u is moved on by u.
    offset, begin, end = begin - (stop - size)[unit[begin]], begin + unit[begin], end + unit[begin]
    order = np.argsort(offset.astype(np.uint16), kind="stable")
    begin, end, score, piece = begin[order], end[order], score[order], piece[order]
    first, last = stop - size + np.arange(len(units)), stop + np.arange(len(units))
    best, back = np.full(len(text) + len(units), -np.inf), np.zeros(len(text) + len(units), np.int64)
    best[first] = 0.0
    bounds = np.concatenate([[0], np.cumsum(np.bincount(offset))])
    for i, j in zip(bounds, bounds[1:]):
        # Edges that begin at one place end at different ones; the earlier beginning wins a tie.
        total = best[begin[i:j]] + score[i:j]
        better = np.flatnonzero(total > best[end[i:j]]) + i
        best[end[better]], back[end[better]] = total[better - i], better
    who, place, path = np.arange(len(units)), last.copy(), []
    while len(who):
        edge = back[place]
        path.append((who, edge))
        place = begin[edge]
        more = place > first[who]
        who, place = who[more], place[more]
    who, edge = (np.concatenate(x) for x in zip(*reversed(path)))
    order = np.argsort(who, kind="stable")
    who, piece = who[order], piece[edge[order]]
    # Characters spelt in bytes have several ids, kept behind those of the pieces.
    width = np.concatenate([np.ones(trie.n, np.int64), np.array([len(x) for x in spelt], np.int64)])
    pool = np.concatenate([np.arange(trie.n), *(np.array(x, np.int64) for x in spelt)]).astype(np.int32)
    ids = pool[spread((np.cumsum(width) - width)[piece], width[piece])]
    return ids, np.bincount(who, width[piece], len(units)).astype(np.int64)


def portions(texts):
    """The texts of a batch in lists of about PART code points, so that few units are held at once."""
    some, held = [], 0
    for t in texts:
        some.append(t.as_py())
        held += len(some[-1] or "")
        if held >= PART:
            yield some
            some, held = [], 0
    yield some


def heavy_units(docs: DataFrame, most: int = HOT, per_task: int = PER_TASK) -> DataFrame:
    """At most `most` frequent units. Every task counts all its texts and reports its heaviest."""

    def lighter(units: Counter) -> Counter:
        """Bounded memory: light units make room."""
        if len(units) <= 4 * per_task:
            return units
        least = np.partition(np.fromiter(units.values(), np.int64, len(units)), -2 * per_task)[-2 * per_task]
        return Counter({u: n for u, n in units.items() if n > least})

    def cut(words: Counter, units: Counter) -> Counter:
        """Adds the units of words with the blanks before them; no unit reaches over a word's end, so each is cut once."""
        for w, n in words.items():
            for u in UNITS_PY.findall(w):
                if len(u) <= UNIT:
                    units[u] += n
        words.clear()
        return lighter(units)

    def count(it):
        import pyarrow as pa

        words, units, held = Counter(), Counter(), 0
        for b in it:
            for t in b["text"].to_pylist():
                if t is not None:
                    words.update(WORDS.findall(" " + t))
                    held += len(t)
                    if held > HELD:
                        units, held = cut(words, units), 0
        top = cut(words, units).most_common(per_task)
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["unit", "n"])

    counts = stage(docs.select("text").mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")), "unit-counts")
    least, room = 1 << 62, most
    for r in sorted(counts.groupBy("n").count().collect(), reverse=True):
        if r["count"] > room:
            break
        least, room = r["n"], room - r["count"]
    return stage(counts.where(F.col("n") >= least).select("unit"), "hot-units")


class Solutions:
    """Ids of the hot units: a dictionary into one flat array, built once per worker."""

    def __init__(self, table):
        self.table, self.index = table, None

    def open(self):
        if self.index is None:
            ids = self.table["ids"].combine_chunks()
            self.flat, self.ends = ids.flatten().to_numpy(), ids.offsets.to_numpy()
            self.index = {u: i for i, u in enumerate(self.table["unit"].to_pylist())}
            self.table = None  # a worker's copy; the driver never opens its own
        return self

    def __getstate__(self):
        return {"table": self.table, "index": None}


def encode(docs: DataFrame, path: str = MODEL, hot: int = HOT, parts: int | None = None, decoded: str | None = None) -> DataFrame:
    """docs with `ids`, an array of piece ids, and on request the text these spell, in place of columns of those names.

    `parts` deals the rows anew, for an input of too few partitions.
    """
    docs = docs.drop("ids", *([decoded] if decoded not in (None, "text") else []))
    spark, model = docs.sparkSession, Model(path)
    table = model.table(spark)
    hot_units = heavy_units(docs, hot)
    solved = lattice(hot_units, table, model).toArrow()  # at most `hot` units of UNIT code points
    held = spark.sparkContext.broadcast(Solutions(solved))
    letters = spark.sparkContext.broadcast(model.spelling())
    known = spark.sparkContext.broadcast(({p: (i, score) for p, i, score in model.rows}, model))
    tree = spark.sparkContext.broadcast(Trie(model))
    if parts:
        docs = docs.repartition(parts)
    names = docs.columns

    def assemble(b):
        s, out = held.value.open(), []
        for texts in portions(b["text"]):
            cuts = [[] if t is None else UNITS_PY.findall(" " + t) for t in texts]
            cold = list({u for c in cuts for u in set(c).difference(s.index) if len(u) <= UNIT})
            own, (more, more_ends) = {u: k for k, u in enumerate(cold)}, solve(cold, tree.value)
            for text, cut in zip(texts, cuts):
                ids, at = [], 0
                for k in [k for k, u in enumerate(cut) if len(u) > UNIT]:
                    ids += [gather(s, own, more, more_ends, cut[at:k]), np.array(segment(cut[k], *known.value), np.int32)]
                    at = k + 1
                out.append(np.concatenate([*ids, gather(s, own, more, more_ends, cut[at:])]) if text is not None else np.zeros(0, np.int32))
        spelt = {} if decoded is None else {decoded: spell(*letters.value, out)}
        return {**{c: b[c] for c in names}, "ids": listed(out), **spelt}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return batches(docs, assemble, f"{schema}, ids array<int>" + (f", {decoded} string" if decoded not in (None, "text") else ""))


def spell(table: np.ndarray, size: np.ndarray, arrays: list[np.ndarray]) -> list[str]:
    """The text of each array of ids, without the blank that opened it."""
    first = np.cumsum(size) - size
    texts = (table[spread(first[x], size[x])].tobytes().decode("utf-8", "replace") for x in arrays)
    return [t[1:] if t.startswith(" ") else t for t in texts]


def listed(arrays: list[np.ndarray]):
    """Arrow list array of integer arrays."""
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays])))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start[i] .. start[i] + size[i] - 1, one range after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)


def gather(s: Solutions, own: dict[str, int], more: np.ndarray, more_ends: np.ndarray, units: list[str]) -> np.ndarray:
    """Ids of a text's units in order: hot ones from the flat array, the rest from the cold list."""
    index, base = s.index, len(s.index)
    at = np.fromiter(map(index.get, units, repeat(-1)), np.int64, len(units))
    hot = at >= 0
    at[~hot] = [base + own[units[k]] for k in np.flatnonzero(~hot).tolist()]
    size, begin = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    h, c = at[hot], at[~hot] - base
    size[hot], begin[hot] = s.ends[h + 1] - s.ends[h], s.ends[h]
    size[~hot], begin[~hot] = more_ends[c + 1] - more_ends[c], more_ends[c]
    place, from_hot = spread(begin, size), np.repeat(hot, size)
    out = np.empty(len(place), np.int32)
    out[from_hot] = s.flat[place[from_hot]]
    out[~from_hot] = more[place[~from_hot]]
    return out


def decode(coded: DataFrame, path: str = MODEL, into: str = "decoded") -> DataFrame:
    """coded with the text that its ids spell; broken byte runs become replacement characters."""
    held = coded.sparkSession.sparkContext.broadcast(Model(path).spelling())
    names = [c for c in coded.columns if c != into]

    def run(b):
        ends, ids = b["ids"].offsets.to_numpy(), b["ids"].values.to_numpy()
        return {**{c: b[c] for c in names}, into: spell(*held.value, [ids[i:j] for i, j in zip(ends, ends[1:])])}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema if f.name != into)
    return batches(coded, run, f"{schema}, {into} string")


def round_trip(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, a hash of the ids, and whether they decode to the text."""
    done = encode(docs.select("doc_id", "text"), path, decoded="decoded")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
