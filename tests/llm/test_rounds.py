"""Centroid clustering, spelling variants and chunk fingerprints against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from plotwise.llm import centroids, chunks, spelling


# -- centroids


def plain_clusters(rows, k=8, rounds=10, dim=64, scale=1024, seed="3:"):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [list(v) for _, v in first]
    far = lambda v, m: sum((a - b) ** 2 for a, b in zip(v, m))
    home = lambda v: min((far(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(home(v)[1], []).append(v)
        c = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else m for j, m in enumerate(c)]
    at = [(i, *home(v)) for i, v in kept]
    total = {}
    for _, d, j in at:
        total[j] = total.get(j, 0) + d
    return sorted(((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in at), key=str)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, cluster string, k int")


def test_clusters_equal_plain_ones(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 64)).astype(np.float32)
    x[50:] = x[rng.integers(0, 5, 100)] + rng.normal(size=(100, 64)).astype(np.float32) * 0.2
    x[:4, :] = np.round(x[:4, :])  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(7, rows[7][1])] * 40 + [(None, rows[8][1]), (900, None), (901, []), (902, [0.0] * 64), (903, [1.0] * 63), (904, [None] + [1.0] * 63), (905, [float("nan")] * 64), (906, [float("-inf")] * 64)]
    got = sorted(map(tuple, centroids.cluster(vectors(spark, rows)).collect()), key=str)
    assert got == plain_clusters(rows)
    few = rows[:3]
    assert sorted(map(tuple, centroids.cluster(vectors(spark, few)).collect()), key=str) == plain_clusters(few)


def test_clusters_large_values_and_empty(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([1e8, -1e8, 3.5]) * rng.random() for _ in range(6)]) for i in range(40)]
    got = sorted(map(tuple, centroids.cluster(vectors(spark, rows, "double"), k=5, rounds=3, dim=6).collect()), key=str)
    assert [(r[0], r[1], r[5]) for r in got] == [(r[0], r[1], r[5]) for r in plain_clusters(rows, 5, 3, 6)]
    assert all(r[2] == w[2] or (r[2] is None and w[2] >= 2**63) for r, w in zip(got, plain_clusters(rows, 5, 3, 6)))
    assert centroids.cluster(vectors(spark, [(1, [1.0])]).limit(0)).collect() == []
    assert centroids.cluster(vectors(spark, [(1, [1.0]), (2, None)])).collect() == []


@pytest.mark.parametrize("k,leaf", [(1, 2), (2, 1), (9, 1), (60, 3), (300, 2)])
def test_tree_finds_the_smallest_nearest_centroid(k, leaf):
    rng = np.random.default_rng(k)
    c = rng.integers(-3, 4, size=(k, 3))  # many equal ones and ties
    x = rng.integers(-4, 5, size=(200, 3)).astype(float)
    at, far = centroids.Tree(c.tolist(), leaf).nearest(x)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert at.tolist() == d.argmin(1).tolist() and far == d.min(1).tolist()


def test_tree_skips_nodes():
    rng = np.random.default_rng(0)
    c = np.concatenate([rng.integers(0, 50, size=(100, 4)), rng.integers(10_000, 10_050, size=(100, 4))])
    tree, met = centroids.Tree(c.tolist()), []
    whole = tree.squares
    tree.squares = lambda x, items: met.append(len(x) * len(items)) or whole(x, items)
    tree.nearest(c[:50].astype(float))
    assert sum(met) < 50 * 200 / 2


# -- spelling


def plain_variants(rows):
    n = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] = n.get(w, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    shorter = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    cut = {w: shorter(w) for w in n}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return a in cut[b] if len(b) == len(a) + 1 else len(a) == len(b) + 1 and b in cut[a]

    form, count = {}, {}
    for w in n:
        others = [o for o in n if abs(len(o) - len(w)) < 2 and near(w, o)]
        count[w] = len(others)
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], count[w], n.get(form[w])) for w in n)


def typos(rng, words, size):
    letters = "abcdefghijéüñÀ"
    out = []
    for _ in range(size):
        w = list(rng.choice(words))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = rng.choice(["", rng.choice(letters), rng.choice(letters)])
        out.append("".join(w))
    return out


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(8)
    stock = ["".join(rng.choice("abcde") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["Straße", "Étéable", "aaaaaa", "aaaaaaaa", "q" * 700, "q" * 701]
    w = typos(rng, stock, 250)
    rows = [(i, " ".join(rng.choice(w) + rng.choice(["", ",", "\n", "1"]) for _ in range(rng.randint(0, 120)))) for i in range(40)]
    chain = [f"{'x' * i}{'y' * (9 - i)} " * 2**i * 3 for i in range(6)]
    return rows + [(100 + i, t) for i, t in enumerate(chain)] + [(None, rows[0][1]), (200, None), (201, ""), (202, "cafés " * 3000), (3, rows[3][1]), (3, rows[3][1]), (203, "\U0001f600 ABCDE abcde Abcde ÀBCDE")]


@pytest.mark.parametrize("cell,block", [(16_384, 32_768), (20, 7), (5, 1000)])
def test_variants_equal_plain_ones(spark, misspelt, cell, block):
    d = spark.createDataFrame([(i, t, 1, "f", 2) for i, t in misspelt], "doc_id long, text string, n int, form string, cell int")
    got = sorted(map(tuple, spelling.variants(d, cell=cell, block=block).collect()))
    want = plain_variants(misspelt)
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[1] and r[2] != r[1] for r in got)


def test_variants_of_nothing(spark, empty):
    assert spelling.variants(empty).collect() == []
    assert spelling.variants(spark.createDataFrame([(1, "abc abc abc abcde")], "doc_id long, text string")).collect() == []


# -- chunks


def plain_ends(data):
    out, at = [], 0
    while at < len(data):
        stop = None
        for e in range(at + 16, min(len(data), at + 192) + 1):
            h = sum(int(chunks.GEAR[data[e - 1 - j]]) << j for j in range(16)) & 0xFFFF
            if h & (63 if e < at + 48 else 15) == 0:
                stop = e
                break
        at = stop or min(at + 192, len(data))
        out.append(at)
    return out


def plain_print(text):
    data, at, out = text.encode(), 0, {}
    for e in plain_ends(data):
        out[xxhash.xxh64_intdigest(data[at:e])] = e - at
        at = e
    return out


def plain_fingerprints(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    like = lambda a, b: sum(n for d, n in a.items() if d in b) / sum(a.values()) if a else float(not b)
    out = []
    for j, (i, t) in enumerate(order):
        own, follower = t or "", order[(j + 1) % len(order)][1] or ""
        half = len(own) // 2
        text = own[: len(own) - half] + follower[:half]
        a, b, c = plain_print(own), plain_print(text), plain_print(follower)
        out.append((i, len(own), hashlib.sha256(text.encode()).hexdigest(), chunks.write(a), chunks.write(b), like(a, b), like(a, c)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1 << 24, 3000, 50])
def test_fingerprints_equal_plain_ones(spark, docs, corpus, monkeypatch, size):
    monkeypatch.setattr(chunks, "SEGMENT", 300)
    rows = [(i * 3 % 101, t) for i, t in enumerate(corpus)] + [(None, corpus[4])]
    d = spark.createDataFrame([(i, t, "x", 1, True) for i, t in rows], "doc_id long, text string, fingerprint string, _range int, _tail boolean")
    got = chunks.fingerprints(d, size=size)
    assert sorted(map(tuple, got.collect()), key=str) == plain_fingerprints(rows)


def test_fingerprints_of_repeated_ids_and_few_rows(spark, docs, empty):
    got = chunks.fingerprints(docs, size=2000).collect()
    assert len(got) == docs.count()
    by_text = {}
    for r in chunks.fingerprints(docs).collect():
        by_text.setdefault((r.doc_id, r.n_chars, r.fingerprint), []).append(r.edited_sha256)
    for r in got:
        assert r.edited_sha256 in by_text[(r.doc_id, r.n_chars, r.fingerprint)]
    assert chunks.fingerprints(empty).collect() == []
    one = spark.createDataFrame([(1, "abcdefgh" * 30)], "doc_id long, text string")
    (r,) = chunks.fingerprints(one).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(("abcdefgh" * 30).encode()).hexdigest()
    none = chunks.fingerprints(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert {(r.n_chars, r.fingerprint, r.near_edited, r.near_next) for r in none} == {(0, "", 1.0, 1.0)}


def test_chunks_move_with_the_text():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(800))
    a, b = chunks.Text(text).chunks, chunks.Text("some words before " + text).chunks
    assert chunks.likeness(a, b) > 0.95 and 30 < np.mean(list(a.values())) < 90
