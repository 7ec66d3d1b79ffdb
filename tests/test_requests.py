"""Query texts: phrases, numbers with their surroundings, addresses, routes."""

from pyspark.sql import functions as F

from plotwise.functions import requests as rq
from plotwise.operators import search as se

FEATURES = {
    "apto entre $200 y $350 millones, 3 habitaciones": {"price_min": 200_000_000, "price_max": 350_000_000, "rooms_min": 3, "kinds": ["Apartamento"]},
    "casas HASTA 80 metros cuadrados o más de 60m²": {"area_max": 80.0, "area_min": 60.0, "kinds": ["Casa"]},
    "mas de 90 m2 y 12 baños": {"area_min": 90.0, "baths_min": None, "price_min": 90_000_000},
    "bajo $ 400 millones a 1,5 km": {"price_max": 400_000_000, "max_m": 1500},
    "a 15 min del parque": {"max_m": 1200, "categories": ["parque"]},
    "a 40 minutos, muy cerca": {"max_m": 300},
    "Índice mayor a 3,5 y muy seguro": {"composite_min": 3.5, "security_min": 3.5},
    "iseg >= 4 en Suba": {"security_min": 4.0, "locality": "SUBA"},
    "indice 7, zona top": {"composite_min": 4.0},
    "Cra 7a Bis Nº 80–23 apto": {"address": "cra 7 a bis n 80 - 23", "kinds": ["Apartamento"]},
    "Avenida 19 #100B - 12": {"address": "avenida 19 # 100 b - 12"},
    "calle 100": {"address": None},
    "": {"max_m": None, "kinds": [], "categories": [], "price_min": None, "address": None},
    None: {"max_m": None, "kinds": [], "price_max": None, "address": None},
}
ROUTES = {"¡Hola!": "smalltalk", "hasta luego.": "smalltalk", "¿Qué es el índice?": "explain", "cuántas casas hay": "stats", "top 5 barrios": "stats",
          "ranking localidades": "stats", "compara Suba y Usme": "compare", "Suba o Usme como localidad": "compare", "inmueble #123": "acm", "id 99": "smalltalk",
          "id 990": "acm", "cerca al parque": "search", "a 300 metros": "search", "menos de $ 200": "search", "nada de eso que se pueda leer aqui": "explain",
          "": "smalltalk", None: "smalltalk"}


def test_features_of_texts(spark):
    log = spark.createDataFrame(list(enumerate(FEATURES)), "id int, q string")
    got = {r.id: r.asDict() for r in se.parse_queries(log, "id", "q").collect()}
    for i, (q, want) in enumerate(FEATURES.items()):
        assert {k: got[i][k] for k in want if k != "categories"} == {k: x for k, x in want.items() if k != "categories"}, q


def test_routes_of_texts(spark):
    d = spark.createDataFrame(list(enumerate(ROUTES)), "id int, q string").withColumn("w", rq.words(F.col("q"))).withColumn("n", rq.numbers(F.col("w")))
    got = {r.id: r.route for r in d.select("id", rq.route(F.col("q"), F.col("w"), F.col("n")).alias("route")).collect()}
    assert {q: got[i] for i, q in enumerate(ROUTES)} == ROUTES


def test_no_texts(spark):
    log = spark.createDataFrame([], "id int, q string")
    assert se.parse_queries(log, "id", "q").isEmpty()


def test_phrases_are_heard_word_by_word(spark):
    q = "que es; zona ... top, MUY segura y a pie"
    w = rq.words(F.lit(q))
    got = spark.range(1).select(rq.heard(w).alias("h"), rq.has(rq.heard(w), ["zona top"]).alias("apart"), rq.has(rq.heard(w), ["segura"]).alias("one")).first()
    assert {"que es", "zona top", "a pie", "segura"} <= set(got.h) and got.apart and got.one
    assert "muy seguro" not in got.h and "bien conectado" not in got.h
    cut = spark.range(1).select(rq.has(rq.heard(rq.words(F.lit("zona muy top a > pie"))), ["zona top", "a pie"]).alias("x")).first()
    assert not cut.x


def test_texts_in_one_piece_are_read_by_many_tasks(spark):
    log = spark.range(400).selectExpr("id", "concat('casa ', id) AS q").coalesce(1)
    assert se.parse_queries(log, "id", "q").rdd.getNumPartitions() > 4
