"""Query texts read as words, numbers in their surroundings and phrases.

A text is folded (lower case, no accents) and split once into words, numbers
and signs. Phrases are looked up in the line of these tokens. Every number
stands with the five tokens before it (without currency signs) and the two
after it; prices, areas, rooms, distances, index floors and half of the routes
are conditions on these three. An accent more or less makes no difference, and
a number counts as a whole: the last digits of a longer one are no price.

A text may be long, so it is passed over once: `heard` lists the words and
phrases of the vocabulary that it holds, and all conditions on phrases read that list.

Null texts read as empty ones: no feature, and the route of a short text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.functions.labels import chain
from plotwise.functions.text import bind, fold

TOKEN = r"m2\b|[\p{L}_]+|\d+(?:[.,]\d+)?|[$<>=#?-]"
SIGNS = ["$", "<", ">", "=", "#", "?", "-"]
LETTERS = [c for c in "abcdefghijklmopqrstuvwxyz"]  # no n, which abbreviates "number"

# Vocabulary of query texts, folded. Where the first match wins, order matters.
DISTANCE_WORDS = [(150, ["pegado a", "pegada a", "a una cuadra"]), (300, ["muy cerca", "al lado", "a pocos pasos"]),
                  (600, ["caminando", "a pie", "cerca", "cercano", "cercana"]),
                  (800, ["proximo", "proxima", "proximos", "proximas", "proximidad"]), (1500, ["en zona", "en la zona"]),
                  (1000, ["al rededor", "alrededor"])]
KIND_WORDS = {"Apartamento": ["apartamento", "apto", "aptos"], "Casa": ["casa", "casas"], "Lote": ["lote", "lotes"],
              "Oficina": ["oficina", "oficinas"], "Local": ["local", "locales", "comercial", "comerciales"]}
# The last entry that occurs decides a dimension.
QUALITY_WORDS = {"security": [(4.0, ["muy seguro"]), (3.5, ["seguro", "segura"])],
                 "access": [(3.5, ["bien conectado", "con buena accesibilidad"])],
                 "services": [(3.5, ["buena dotacion", "muchos servicios"])],
                 "composite": [(3.5, ["buen indice"]), (4.0, ["indice alto"]), (4.5, ["indice muy alto"]), (4.0, ["zona top"])]}
INDEX_WORDS = {"composite": "indice", "access": "iacc", "security": "iseg", "dwelling": "ihed", "services": "idot", "zoning": "ipnu"}
AT_MOST, AT_LEAST = ["menos de", "hasta", "maximo", "<"], ["mas de", "sobre", "minimo", ">"]
ROOM_WORDS, BATH_WORDS = ["habitacion", "cuarto", "alcoba", "hab"], ["bano"]
AREA_WORDS = ["m2 ", "metros cuadrados ", "metro cuadrado ", "metros cuadrado ", "metro cuadrados "]
STREETS = ["cra", "carrera", "calle", "cl", "av", "avenida", "diag", "diagonal", "tv", "transversal"]
STREET_SIDES, NUMBER_SIGNS = ["bis", "este", "sur", "norte"], ["#", "n", "no", "nro"]
PLACES = ["localidad", "barrio", "zona"]
GREETINGS = ["hola", "buenas", "buenos dias", "hey", "hi", "saludos", "gracias", "listo", "ok", "perfecto", "genial", "adios", "chao",
             "hasta luego", "nos vemos"]
EXPLAIN_WORDS = ["que es", "como se calcula", "como funciona", "que significa", "metodologia", "definicion", "formula", "teoria", "por que",
                 "explica", "explicame", "indice ?", "diferencia entre", "diferencias entre"]
STATS_WORDS = ["cuanto", "cuanta", "cuantos", "cuantas", "cuant", "total de", "promedio", "media", "estadistica", "estadisticas",
               "distribucion", "histograma"]
RANK_WORDS = ["ranking", "top"]
COMPARE_WORDS = ["compar", "compara", "comparar", "comparame", "versus", "vs"]
ASSET_WORDS = ["inmueble", "propiedad", "inmueble #", "propiedad #"]
VALUATION_WORDS = ["cotiza", "cotizacion", "acm"]
SEARCH_WORDS = ["apartamento", "apartamentos", "apartamenta", "apartamentas", "apartament", "apartaments", "apto", "aptos", "casa", "casas",
                "caso", "casos", "lote", "lotes", "oficina", "oficinas", "locale", "locales", "cerca de", "cerca a", "cerca al", "busco", "busca",
                "buscame", "buscar", "hospital", "clinica", "colegio", "universidad", "parque", "farmacia", "biblioteca", "transmilenio", "tm",
                "cai", "centro comercial"]


_RULES = [*(ps for _, ps in DISTANCE_WORDS), *KIND_WORDS.values(), *(ps for hints in QUALITY_WORDS.values() for _, ps in hints),
          EXPLAIN_WORDS, STATS_WORDS, COMPARE_WORDS, VALUATION_WORDS, SEARCH_WORDS]
ALTERNATIVES = ["o", "vs"]
LONG_PHRASES = sorted({p for ps in _RULES for p in ps if " " in p})
VOCABULARY = sorted({w for ps in (*_RULES, RANK_WORDS, ALTERNATIVES, STREETS) for p in ps for w in p.split(" ")})


def dealt(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Texts dealt by keys before they are read: a file may hold very many in one piece, and reading takes far longer than moving them."""
    # A number of its own, as partitions that are small in bytes would be put together again.
    return texts.repartition(4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def words(q: Column) -> Column:
    """Words, numbers and signs of a text, folded."""
    return F.regexp_extract_all(F.translate(fold(q), "²–º°", "2-  "), F.lit(TOKEN), F.lit(0))


def numbers(w: Column) -> Column:
    """Array of (x, before, after): each number with the tokens around it."""
    def read(x: Column, i: Column) -> Column:
        before = F.filter(F.slice(w, F.greatest(i - 4, F.lit(1)), F.least(i, F.lit(5))), lambda t: t != "$")
        after = F.slice(w, i + 2, F.lit(2))
        return F.when((x >= "0") & (x < ":"), F.struct(x.alias("x"), F.concat(F.lit(" "), F.array_join(before, " ")).alias("before"),
                                                F.concat(F.array_join(after, " "), F.lit(" ")).alias("after")))

    return F.array_compact(F.transform(w, read))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def heard(w: Column) -> Column:
    """Words and phrases of the vocabulary that stand in the text, word by word; only phrases whose words all occur are looked up in its line."""
    line = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))

    def phrases(found: Column, t: Column) -> Column:
        every = lambda p: reduce(lambda a, b: a & b, [F.array_contains(found, x) for x in p.split(" ")])
        return F.array_compact(F.array(*[F.when(every(p) & t.contains(f" {p} "), F.lit(p)) for p in LONG_PHRASES]))

    return bind(F.array_intersect(w, F.lit(VOCABULARY)), lambda found: F.concat(found, bind(line, lambda t: phrases(found, t))))


def has(said: Column, phrases: list[str]) -> Column:
    """One of the phrases is among those heard."""
    unknown = [p for p in phrases if p not in VOCABULARY and p not in LONG_PHRASES]
    if unknown:
        raise ValueError(f"not in the vocabulary: {unknown}")
    return F.arrays_overlap(said, F.lit(phrases))


def behind(n: Column, phrases: list[str]) -> Column:
    return any_of([n["before"].endswith(f" {p}") for p in phrases])


def followed(n: Column, starts: list[str]) -> Column:
    return any_of([n["after"].startswith(s) for s in starts])


def whole(n: Column, digits: str = "1,9") -> Column:
    return n["x"].rlike(r"^\d{%s}$" % digits)


def first(found: Column, test) -> Column:
    return F.get(F.filter(found, test), 0)


def distance(said: Column, n: Column) -> Column:
    """Metres asked for: explicit metres, kilometres, walking minutes, then phrases."""
    m = first(n, lambda r: whole(r, "2,4") & followed(r, ["m ", "metro"]))["x"].cast("int")
    km = F.replace(first(n, lambda r: followed(r, ["km "]))["x"], F.lit(","), F.lit(".")).cast("double")
    mins = first(n, lambda r: whole(r) & followed(r, ["min"]))["x"].cast("int")
    phrase = chain([(has(said, ps), d) for d, ps in DISTANCE_WORDS], F.lit(None).cast("int"))
    return F.coalesce(F.when(m.between(50, 5000), m), F.floor(km * 1000).cast("int"), F.when(mins.between(1, 30), mins * 80), phrase)


def kinds(said: Column) -> Column:
    return F.array_compact(F.array(*[F.when(has(said, ps), F.lit(k)) for k, ps in KIND_WORDS.items()]))


def amounts(n: Column) -> dict[str, Column]:
    """Bounds of price (millions), area, rooms and baths. A price range goes before single bounds."""
    millions = lambda x: x.cast("bigint") * 1_000_000
    price = F.filter(n, lambda r: whole(r, "2,4") & followed(r, ["m"]))
    area = F.filter(n, lambda r: whole(r, "2,4") & followed(r, AREA_WORDS))
    ranged = first(price, lambda r: r["before"].rlike(r" entre \d{2,4} [y-]$"))
    lowest = F.get(F.split(ranged["before"], " "), F.size(F.split(ranged["before"], " ")) - 2)

    def few(units: list[str]) -> Column:
        x = first(n, lambda r: whole(r) & followed(r, units))["x"].cast("int")
        return F.when(x.between(1, 10), x)

    return {
        "price_min": F.coalesce(millions(lowest), millions(first(price, lambda r: behind(r, AT_LEAST))["x"])),
        "price_max": F.coalesce(millions(ranged["x"]), millions(first(price, lambda r: behind(r, [*AT_MOST, "bajo"]))["x"])),
        "area_min": first(area, lambda r: behind(r, AT_LEAST))["x"].cast("double"),
        "area_max": first(area, lambda r: behind(r, AT_MOST))["x"].cast("double"),
        "rooms_min": few(ROOM_WORDS),
        "baths_min": few(BATH_WORDS),
    }


def index_floors(said: Column, n: Column) -> dict[str, Column]:
    """Minimum per index from quality phrases, overridden by the first number that stands behind an index name."""
    names_it = lambda r, names: behind(r, [f"{i}{how}" for i in names for how in ("", " >", " > =", " mayor a")])
    stated = first(n, lambda r: names_it(r, list(INDEX_WORDS.values())))

    def stated_for(name: str) -> Column:
        value = lambda r: F.replace(r["x"], F.lit(","), F.lit(".")).cast("double")
        return bind(stated, lambda r: F.when(names_it(r, [name]) & value(r).between(0, 5), value(r)))

    out = {}
    for dim, name in INDEX_WORDS.items():
        hints = [(has(said, ps), v) for v, ps in reversed(QUALITY_WORDS.get(dim, []))]
        hint = chain(hints, F.lit(None).cast("double")) if hints else F.lit(None).cast("double")
        out[f"{dim}_min"] = F.coalesce(stated_for(name), hint)
    return out


def address(w: Column) -> Column:
    """First street address in words: street, number, letter, side, number sign, number, letter, dash, number."""
    token = lambda i: F.coalesce(F.get(w, i), F.lit(""))
    number = lambda i: token(i).rlike(r"^\d+$")
    after = lambda i, test: i + F.when(test, 1).otherwise(0)

    def tail(i: Column, sign: Column) -> Column:
        """End of the address that begins at i and has its number sign at `sign`."""
        def rest(house: Column) -> Column:
            dash = lambda a: bind(after(a, token(a) == "-"), lambda b: after(b, number(b)))
            end = bind(after(house + 1, token(house + 1).isin([*LETTERS, "n"])), dash)
            return F.when(token(sign).isin(NUMBER_SIGNS) & number(house), F.array_join(F.slice(w, i + 1, end - i), " "))

        return bind(after(sign + 1, token(sign + 1).isin(NUMBER_SIGNS)), rest)

    def at(x: Column, i: Column) -> Column:
        lettered = bind(after(i + 2, token(i + 2).isin(LETTERS)), lambda a: bind(after(a, token(a).isin(STREET_SIDES)), lambda s: tail(i, s)))
        return F.when(x.isin(STREETS) & number(i + 1), lettered)

    return F.when(F.arrays_overlap(w, F.lit(STREETS)), F.get(F.array_compact(F.transform(w, at)), 0))


def route(q: Column, w: Column, n: Column) -> Column:
    """Which assistant a query belongs to; short leftovers are small talk, long ones ask to explain."""
    return bind(heard(w), lambda said: _route(q, w, n, said))


def _route(q: Column, w: Column, n: Column, said: Column) -> Column:
    some = lambda test: F.exists(n, test)
    place = lambda t: any_of([t.startswith(p) for p in PLACES])
    bare = F.array_join(F.filter(w, lambda t: ~t.isin(SIGNS)), " ")
    ranked = has(said, RANK_WORDS) & F.exists(F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: a.isin(RANK_WORDS) & place(b)), lambda t: t)
    # A place at most four words behind the second of two alternatives.
    either = has(said, ALTERNATIVES) & F.exists(F.transform(w, lambda t, i: t.isin(ALTERNATIVES) & (i > 0) & F.exists(F.slice(w, i + 3, F.lit(5)), place)), lambda t: t)
    rules = [
        ("smalltalk", bare.isin(GREETINGS)),
        ("explain", has(said, EXPLAIN_WORDS)),
        ("stats", has(said, STATS_WORDS) | F.coalesce(ranked, F.lit(False)) | some(lambda r: behind(r, RANK_WORDS) & place(r["after"]))),
        ("compare", has(said, COMPARE_WORDS) | either),
        ("acm", has(said, VALUATION_WORDS) | some(lambda r: behind(r, ASSET_WORDS) | (behind(r, ["id"]) & r["x"].rlike(r"^\d{3}")))),
        ("search", has(said, SEARCH_WORDS) | some(lambda r: (behind(r, ["a"]) & followed(r, ["m ", "metro ", "metros "]))
                                               | followed(r, ["minuto ", "minutos "]) | behind(r, ["menos de", "mas de"]))),
    ]
    length = F.length(F.coalesce(F.trim(q), F.lit("")))
    return chain([(test, name) for name, test in rules], F.when(length < 25, "smalltalk").otherwise("explain"))
