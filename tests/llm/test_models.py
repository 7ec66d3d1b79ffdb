"""Classifier, language model, vectors and pages."""

import random

import numpy as np
import pytest

from plotwise.llm import embeddings, html, language, quality


def test_language_accuracy_and_edges(spark, empty):
    rng = random.Random(2)
    stock = {"aa": ["katso", "talo", "kissa", "vene", "kala", "suuri"], "bb": ["house", "bright", "whole", "thing", "ship", "other"]}
    rows = [(i, " ".join(rng.choice(stock[g]) for _ in range(rng.randint(3, 60))), g, "s") for i, g in ((i, ["aa", "bb"][i % 2]) for i in range(300))]
    rows += [(1000, None, "aa", "s"), (1001, "", None, "s"), (1002, "12 !!", "bb", "s"), (None, "house ship", None, None), (1003, "talo " * 5000, None, "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language.identify(d).collect()}
    assert len(got) == len(rows)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002)) and got[1003].lang_pred == "aa"
    held = [r for r in rows if r[0] is not None and r[0] < 300 and got[r[0]].held_out]
    assert held and np.mean([got[r[0]].lang_pred == r[2] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.identify(empty).collect() == []
    assert {r.lang_pred for r in language.identify(d.withColumn("lang", d.lang.substr(9, 1)).where("lang IS NULL")).collect()} <= {"und"}


def test_factorisation_identity():
    m = quality.Machine(50, 4)
    idx, val = np.array([3, 7, 40]), np.array([0.5, 1.0, 2.0])
    m.w[idx] = [0.1, -0.2, 0.3]
    pairs = sum(float(m.v[a] @ m.v[b]) * x * y for i, (a, x) in enumerate(zip(idx, val)) for b, y in list(zip(idx, val))[i + 1 :])
    assert abs(m.raw(idx, val) - (float(m.w[idx] @ val) + pairs)) < 1e-6


def test_quality_separates_held_out_rows(spark, docs, empty):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["river", "stone", "cloud", "green", "paper", "north"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "###", "$$$", "CLICK!!", "%%%"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), None if i % 5 == 0 else 300) for i in range(240)] + [(900, None, None), (901, "", 0), (None, "x", -1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "'x' lang", "'x' source", "'x' quality")
    lab = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(240)] + [(1, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(d, lab).collect()}
    held = [i for i in range(240) if got[i].held_out]
    assert held and all(got[i].predicted == (1 if i % 3 else 0) for i in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values()) and len(got) == len(rows)
    assert quality.classify(empty, lab).collect() == []
    assert {r.score for r in quality.classify(docs, lab.limit(0)).collect()} == {0.5}
    clash = d.withColumns({"score": d.doc_id * 2, "predicted": d.doc_id, "_n": d.doc_id})
    kept = quality.accepted(clash, lab)
    assert kept.columns == clash.columns and all(r.score == r.doc_id * 2 for r in kept.collect() if r.doc_id is not None)


@pytest.mark.parametrize("sample,block", [(20_000, 1024), (10, 7)])
def test_vector_links_equal_all_pairs(spark, monkeypatch, sample, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 16)).astype(np.float32)
    x[60:90] = x[:30] + rng.normal(size=(30, 16)).astype(np.float32) * 0.12
    x[90:115] = x[0] + rng.normal(size=(25, 16)).astype(np.float32) * 0.15
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(200, x[3].tolist(), 1), (201, (x[3] * 2).tolist(), 1), (5, x[5].tolist(), 1), (202, None, 1), (203, [0.0] * 16, 1), (204, [float("nan")] * 16, 1), (205, [1.0, None], 1), (206, [], 1), (207, [1.0, 2.0], 1), (208, [2.0, 4.0], 1), (None, x[7].tolist(), 1)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, cls int"), sample).collect()), key=str)
    ok = lambda v: bool(v) and all(e is not None and np.isfinite(e) for e in v) and any(v)
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok(v) else None for _, v, _ in rows]
    n = len(rows)
    link = [[i != j and a is not None and b is not None and len(a) == len(b) and float(a @ b) >= 0.95 for j, b in enumerate(unit)] for i, a in enumerate(unit)]
    want = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = {j for j in range(n) if link[k][j]} - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        want.append((rows[i][0], sum(link[i]), low, rows[i][0] is not None and rows[i][0] == low))
    assert got == sorted(want, key=str)


def test_vector_probes_find_nearly_all_links(spark):
    """Many lists, so that most links cross lists; the full margin finds all, the default one at least 99 %."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    x[500:1000] = x[:500] + rng.normal(size=(500, 32)).astype(np.float32) * 0.22
    x[1000:] = x[0] + rng.normal(size=(500, 32)).astype(np.float32) * 0.2
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    want = (u @ u.T >= 0.95).sum(1) - 1
    got = {m: np.array([r.n_links for r in embeddings.near_duplicates(d, deviations=m).orderBy("vec_id").collect()]) for m in (None, embeddings.DEVIATIONS)}
    assert (got[None] == want).all()
    near = got[embeddings.DEVIATIONS]
    assert (near <= want).all() and near.sum() >= 0.99 * want.sum() and near.sum() % 2 == 0


def test_links_between_two_dense_groups(spark):
    """Each group has centroids of its own, and their bisectors lie far from both."""
    rng = np.random.default_rng(3)
    a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    b = 0.955 * a + (1 - 0.955**2) ** 0.5 * b
    x = np.concatenate([rng.normal(size=(1500, 64)) / 8, *(c + rng.normal(size=(150, 64)) * 0.03 / 8 for c in (a, b))]).astype(np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    want = (u @ u.T >= 0.95).sum(1) - 1
    got = np.array([r.n_links for r in embeddings.near_duplicates(d).orderBy("vec_id").collect()])
    assert (got == want).all() and (want[1500:] > 150).all()


def test_two_lists_meet_once():
    """Each pair of lists is probed from one side only, no link is lost, and table distances keep to their error."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    x[600:] = x[:300] + rng.normal(size=(300, 24)).astype(np.float32) * 0.25
    u = embeddings.unit(x).astype(np.float32)
    model = embeddings.Quantiser(u, 60)
    at, codes, error, probes = model.encode(u)
    probed = np.zeros((len(u), 60), bool)
    for i, p in enumerate(probes):
        probed[i, p] = True
    p, q = np.nonzero(np.triu(u @ u.T >= 0.95, 1))
    there, back = probed[p, at[q]], probed[q, at[p]]
    assert (at[p] != at[q]).any() and (there | back).all() and ((there & back) == (at[p] == at[q])).all()
    assert all((x >= a).all() for x, a in zip(probes, at))
    for k in range(60):
        far = np.sqrt(model.lookup(u[:50], k, codes[at == k]))
        true = np.linalg.norm(u[at == k][:, None] - u[None, :50], axis=2)
        assert far.shape == true.shape and (np.abs(far - true) <= error[at == k][:, None] + 1e-3).all()


def test_no_vectors(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


PAGES = [
    ("http://a.example/1", "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Menu</li></ul></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p><b>One\n two<br><p>Three &nbsp; four</p><div class='comments'><p>me too</p></div></article><footer>&copy;</footer></body></html>", "A & B\nOne two\nThree four"),
    ("http://a.example/2", None, ""),
    ("http://a.example/3", "", ""),
    (None, "<p>plain &lt;text", "plain <text"),
    ("http://a.example/4", "<main><!-- <p>no</p> --><script>var a='</p>';</script><p>yes<form><p>x</p></form></main><aside>z</aside>", "yes"),
    ("http://a.example/5", "<article>" + "<p>w w</p>" * 4000 + "</article>", "\n".join(["w w"] * 4000)),
    ("x", "<div>a<span>b</span>c<table><tr><td>1<td>2</table></div><b>unclosed <i>end", "abc\n1\n2\nunclosed end"),
]


def test_page_text(spark):
    d = spark.createDataFrame([(i, u, h, "x") for i, (u, h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(d).collect()}
    for i, (_, _, want) in enumerate(PAGES):
        assert got[i].text == want and got[i].n_chars == len(want)
    assert html.extract(d.limit(0)).collect() == []


def test_site_templates_go(spark):
    page = lambda k: f"<body><div><p>Site name</p><p>Read our offers today</p></div><div><p>Story number {k} of this site</p></div><p>Printed in town</p></body>"
    rows = [(k, f"http://Host.example/{k}", page(k)) for k in range(8)] + [(50, "http://other.example/", page(3)), (51, "http://host.example/2", page(2)), (51, "http://host.example/2", page(2))]
    got = [(r.page_id, r.text) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(t for i, t in got if i < 8) == [f"Story number {k} of this site" for k in range(8)]
    assert [t for i, t in got if i == 51] == ["Story number 2 of this site"] * 2
    assert [t for i, t in got if i == 50] == ["Site name\nRead our offers today\nStory number 3 of this site\nPrinted in town"]


def test_templates_of_marked_pages_go(spark):
    """Most pages mark their article; what all pages share goes inside and outside of it, copies of an article stay."""
    top, share = "<div><p>Read our offers today</p></div>", "<div><p>About the author</p></div>"
    marked = lambda k: f"<body>{top}<article><h1>Title {k}</h1><p>Story number {k}</p>{share}</article><p>{k}</p></body>"
    pages = [marked(k) for k in range(12)] + [f"<body>{top}<p>Plain page {k}</p></body>" for k in range(2)]
    pages += [marked(0).replace("<p>0</p>", f"<p>copy {k}</p>") for k in range(30)]
    rows = [(k, f"http://host.example/{k}", p) for k, p in enumerate(pages)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = [f"Title {k}\nStory number {k}" for k in range(12)] + [f"Plain page {k}" for k in range(2)] + ["Title 0\nStory number 0"] * 30
    assert got == dict(enumerate(want))


def test_near_copies_of_an_article_stay():
    blocks = [("One long shared paragraph of it", 2, (1, 9)), ("changed", 2, (2, 9))]
    assert html.content(blocks, frozenset({1})) == "One long shared paragraph of it\nchanged"
    assert html.content(blocks, frozenset({2})) == "One long shared paragraph of it"


def test_main_and_articles_are_kept():
    text = lambda h: html.content(html.parse(h)[0])
    assert text("<main><h1>Title</h1><p>long body</p><article class='card'>teaser</article></main><p>out</p>") == "Title\nlong body\nteaser"
    assert text("<main><article><p>short</p></article></main><p>a long text outside of it</p>") == "short"
    assert text("<p>an unmarked body of the page</p><article>teaser</article>") == "an unmarked body of the page\nteaser"
    assert text("<p>top</p><article><p>the body of the page</p></article>") == "the body of the page"


def test_vectors_are_dealt_out_once(spark, monkeypatch):
    """Lists meet as packed blocks: nothing is shuffled by a vector and a list it probes."""
    monkeypatch.setattr(embeddings, "BLOCK", 40)
    x = np.random.default_rng(2).normal(size=(300, 16))
    reps = spark.createDataFrame([(i, 1, v.tolist(), 16) for i, v in enumerate(x)], "cls long, n long, vec array<float>, dim int")
    staged, whole = [], embeddings.stage
    monkeypatch.setattr(embeddings, "stage", lambda df, label: staged.append((label, whole(df, label))) or staged[-1][1])
    plan = embeddings.links(reps, 16)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Generate" not in plan
    assert [n for n, _ in staged] == ["pq-blocks"] and sum(len(r.cls) // 8 for r in staged[0][1].collect()) == 300
    assert embeddings.dealt({0: 3, 1: 5, 2: 100, 3: 30, 4: 20}, 6) == [(0, 0, 1), (1, 0, 1), (2, 1, 3), (3, 4, 1), (4, 5, 1), (5, 5, 1)]
