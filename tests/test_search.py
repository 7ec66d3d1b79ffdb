"""Ranked search from a table of requests against a plain loop."""

import random

from plotwise.operators import search as se


def test_ten_thousand_requests(spark):
    rng = random.Random(9)
    kinds, places = ["Casa", "Apartamento", "Lote", None], ["SUBA", "USME", "BOSA", None]
    rows = [(i, rng.choice(kinds), rng.choice(places), rng.choice([None, rng.randint(1, 900) * 1_000_000]), rng.uniform(20, 300), rng.randint(1, 6), rng.randint(1, 4), -74.1 + rng.uniform(0, 0.02), 4.6 + rng.uniform(0, 0.02),
             *[round(rng.uniform(0, 5), 2) for _ in range(6)], rng.choice([["p"], ["p", "g"], []])) for i in range(150)]
    names = ["composite", "access", "security", "dwelling", "services", "zoning"]
    listings = spark.createDataFrame(rows, "id long, kind string, locality string, price long, area double, rooms int, baths int, lon double, lat double, " + ", ".join(f"{n} double" for n in names) + ", amenities array<string>")
    pois = spark.createDataFrame([(i, rng.choice(["parque", "colegio"]), -74.1 + rng.uniform(0, 0.02), 4.6 + rng.uniform(0, 0.02)) for i in range(8)], "fid long, category string, lon double, lat double")
    asks = []
    for i in range(10_000):
        lo = rng.choice([None, None, rng.randint(1, 400) * 1_000_000])
        hi = rng.choice([None, None, rng.randint(100, 1200) * 1_000_000])
        asks.append((f"r{i}", "t", rng.choice([[], None, ["Casa"], ["Casa", "Lote"], ["Casa", "Casa"]]), rng.choice([[], None, ["parque"], ["parque", "colegio"]]), 700, lo, hi, rng.choice([None, 60.0]), None, rng.choice([None, 3]), None,
                     rng.choice([None, None, "SUBA"]), rng.choice([None, 2.0]), *[None] * 5, rng.choice([[], ["p"]]), None, None, 500))
    intents = spark.createDataFrame(asks, se.INTENT)
    got = {}
    for r in se.ranked_search(listings, pois, intents, k=3).select("intent", "id", "rn", "hard", "relaxed", "dists", "met").collect():
        got.setdefault(r.intent, []).append(r)
    near = {r.id: r.near for r in se.poi_distances(listings.select("id", "lon", "lat"), pois, ["colegio", "parque"]).collect()}
    for a in rng.sample(asks, 400) + asks[:100]:
        q = dict(zip([c.split(" ")[0] for c in se.INTENT.split(", ")], a))
        hits = []
        for row in rows:
            x = dict(zip(["id", "kind", "locality", "price", "area", "rooms", "baths", "lon", "lat", *names, "amenities"], row))
            if x["kind"] in ("Casa", "Apartamento") and x["price"] is not None and x["price"] < 30_000_000:
                continue
            if q["kinds"] and x["kind"] not in q["kinds"] or q["locality"] and x["locality"] != q["locality"] or set(q["amenities"]) - set(x["amenities"]):
                continue
            if any(q[n] is not None and (x[c] is None or x[c] < q[n]) for n, c in (("price_min", "price"), ("area_min", "area"), ("rooms_min", "rooms"), ("composite_min", "composite"))):
                continue
            if q["price_max"] is not None and (x["price"] is None or x["price"] > q["price_max"]):
                continue
            cats = q["categories"] or []
            d = [near[x["id"]][c] if near[x["id"]][c] <= 700 else None for c in cats]
            score = x["composite"] / 5.0 * 0.45 + (sum(max(0.0, 1 - v / 700) for v in d if v is not None) / len(cats) * 0.40 if cats else 0.0)
            hits.append((None in d, -round(score, 9), x["id"]))
        hits = sorted(hits)[:3]
        want = [h for h in hits if not h[0]] or hits
        mine = sorted(got.get(q["intent"], []), key=lambda r: r.rn)
        assert [r.id for r in mine] == [h[2] for h in want]
        assert all(r.relaxed == want[0][0] and r.hard != want[0][0] for r in mine)
