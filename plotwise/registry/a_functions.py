"""Scalar functions, cleaning, projections."""

from pyspark.sql import functions as F

from plotwise.fixtures import AMENITIES, BUILD_RANGES, SCORES
from plotwise.functions import labels as lb
from plotwise.functions import requests as rq
from plotwise.functions import spatial as sp
from plotwise.functions import text as tx
from plotwise.operators import cleaning as cl
from plotwise.registry.core import query

c = F.col


def q_str(s):
    return "'" + s.replace("'", "''") + "'"


def sql_case(pairs, default):
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {default} END"


def sql_bands(x, bands, lowest):
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} >= {lo} THEN '{n}'" for lo, n in bands) + f" ELSE '{lowest}' END"


TREAT_SQL = sql_case([(f"lower(value) LIKE '%{p}%'", f"{s}e0") for p, s in lb.TREATMENT_SCORES], "2.5e0")
BUILD_SQL = sql_case([(f"value = '{k}'", f"{s}e0") for k, s in lb.BUILD_SCORES.items()], "2.5e0")
ACT_SQL = sql_case([(f"value = '{k}'", f"{s}e0") for k, s in lb.ACTIVITY_SCORES.items()], "3.0e0")


@query("scl_1_treatment_score", f"SELECT poly_id, value, {TREAT_SQL} AS score FROM pot WHERE layer='treatment'")
def _(v):
    return v.pot.where("layer = 'treatment'").select("poly_id", "value", lb.treatment_score(c("value")).alias("score"))


@query("scl_2_build_score", f"SELECT poly_id, value, {BUILD_SQL} AS score FROM pot WHERE layer='buildability'")
def _(v):
    return v.pot.where("layer = 'buildability'").select("poly_id", "value", lb.build_score(c("value")).alias("score"))


@query("scl_3_activity_score", f"SELECT poly_id, value, {ACT_SQL} AS score FROM pot WHERE layer='activity'")
def _(v):
    return v.pot.where("layer = 'activity'").select("poly_id", "value", lb.activity_score(c("value")).alias("score"))


@query("scl_4_index_labels", f"SELECT id, composite, {sql_bands('composite', lb.INDEX_BANDS, lb.INDEX_LOWEST)} AS label FROM scored")
def _(v):
    return v.scored.select("id", "composite", lb.index_label(c("composite")).alias("label"))


MARKET_SQL = sql_case([(f"r > {x}e0", f"'{t}'") for x, t in lb.MARKET_ABOVE] + [(f"r >= {x}e0", f"'{t}'") for x, t in lb.MARKET_FROM],
                      f"'{lb.MARKET_LOWEST}'")
SAATY_SQL = sql_case([("rooms = 1", q_str(lb.SAATY_BANDS[0][1]))] + [(f"rooms <= {h}", q_str(t)) for h, t in lb.SAATY_BANDS[1:]],
                     q_str(lb.SAATY_HIGHEST))


@query("scl_5_other_labels", f"""SELECT id, {sql_bands('zoning', lb.ZONING_BANDS, lb.ZONING_LOWEST)} AS zoning_label,
  {sql_bands('(services/5)', lb.KMO_BANDS, lb.KMO_LOWEST)} AS kmo, CASE WHEN r IS NULL THEN NULL ELSE {MARKET_SQL} END AS market,
  {SAATY_SQL} AS saaty FROM (SELECT *, access/2.5e0 AS r FROM scored)""")
def _(v):
    return v.scored.select("id", lb.zoning_label(c("zoning")).alias("zoning_label"), lb.kmo_label(c("services") / 5).alias("kmo"),
                           lb.market_label(c("access") / 2.5).alias("market"), lb.saaty_label(c("rooms")).alias("saaty"))


@query("scl_6_alerts", "SELECT id, concat_ws('|', " + ", ".join(
    f"CASE WHEN {n} < {t}e0 THEN '{m}' END" for n, t, m in lb.ALERTS) + ") AS alerts FROM scored")
def _(v):
    return v.scored.select("id", F.array_join(lb.alerts({n: c(n) for n, _, _ in lb.ALERTS}), "|").alias("alerts"))


@query("scl_7_invert_clip_divide", """SELECT id, 5.0e0-access AS inverted, CASE WHEN dwelling IS NOT NULL THEN
  least(5.0e0, greatest(0.0e0, dwelling*2-3)) END AS clipped, CASE WHEN area IS NULL OR area=0 THEN NULL ELSE price/area END AS per_m2 FROM scored""")
def _(v):
    return v.scored.select("id", lb.inverted(c("access")).alias("inverted"), lb.clip(c("dwelling") * 2 - 3).alias("clipped"),
                           F.try_divide(c("price").cast("double"), F.nullif(c("area"), F.lit(0.0))).alias("per_m2"))


@query("scl_8_decay_kernels", f"""SELECT id, round(exp(-(d*d)/(2*s*s)), 9) AS gaussian, greatest(0.0e0, 1-d/1000) AS linear, 1.0e0/greatest(d, 50.0e0) AS inverse,
  round(s, 6) AS sigma FROM (SELECT id, area*10 AS d, {lb.calibrated_sigma(1000)!r}e0 AS s FROM listing WHERE area IS NOT NULL)""")
def _(v):
    d, s = c("area") * 10, lb.calibrated_sigma(1000)
    return v.listing.where("area is not null").select(
        "id", F.round(lb.gaussian_decay(d, F.lit(s)), 9).alias("gaussian"), lb.linear_decay(d, 1000).alias("linear"),
        lb.inverse_decay(d).alias("inverse"), F.round(F.lit(s), 6).alias("sigma"))


@query("scl_9_walking_minutes", """SELECT id, greatest(1, CAST(round_even(area*8/80, 0) AS INT)) AS minutes FROM listing WHERE area IS NOT NULL""")
def _(v):
    return v.listing.where("area is not null").select("id", lb.walking_minutes(c("area") * 8).alias("minutes"))


SITES = list(lb.URL_TEMPLATES) + ["otro"]


@query("scl_10_listing_url", f"""SELECT id, CASE s WHEN 0 THEN concat('https://www.fincaraiz.com.co/', code) WHEN 1 THEN
  concat('https://habi.co/inmueble/', code) WHEN 2 THEN concat('https://www.metrocuadrado.com/inmueble/', code) ELSE '' END AS url
  FROM (SELECT id, code, id%4 AS s FROM listing)""")
def _(v):
    from plotwise.fixtures import pick

    return v.listing.select("id", lb.listing_url(pick(SITES, c("id") % 4), c("code")).alias("url"))


STATES = list(lb.CONDITION_LEVELS) + ["desconocido"]
_LEVEL = lambda i: f"([{', '.join(str(x) for x in list(lb.CONDITION_LEVELS.values()) + [3])}])[CAST({i} AS INT)+1]"
_FACT = f"([{', '.join(str(x) + 'e0' for x in lb.CONDITION_FACTORS.values())}])[CAST(greatest(-4, least(4, {_LEVEL('garages+baths')} - {_LEVEL('id%8')})) AS INT)+5]"


@query("scl_11_condition_factor", f"""SELECT id, CAST(round(CAST({_FACT} * CASE WHEN area/rooms/25 > 1.15e0 THEN 0.95e0
  WHEN area/rooms/25 < 0.85e0 THEN 1.05e0 ELSE 1.0e0 END AS DECIMAL(18,8)), 2) AS DOUBLE) AS factor
  FROM listing WHERE baths IS NOT NULL AND area IS NOT NULL""")
def _(v):
    from plotwise.fixtures import pick

    return v.listing.where("baths is not null and area is not null").select("id", lb.condition_factor(
        pick(STATES, c("id") % 8), pick(STATES, c("garages") + c("baths")), c("area") / c("rooms"), F.lit(25.0)).alias("factor"))


@query("scl_12_json_bags", """SELECT event_id, k, bag FROM (SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k,
  concat('{"type":"', event_type, '","user":', user_id, '}') AS bag FROM events)""")
def _(v):
    e = v.table("events")
    return e.select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"),
                    F.to_json(F.struct(c("event_type").alias("type"), c("user_id").alias("user"))).alias("bag"))


@query("scl_13_change_list", """SELECT a.id, concat_ws(',', CASE WHEN a.price//10 IS DISTINCT FROM b.price//10 THEN 'price' END,
  CASE WHEN a.baths IS DISTINCT FROM b.baths THEN 'baths' END, CASE WHEN a.kind IS DISTINCT FROM b.kind THEN 'kind' END) AS changed
  FROM listing a JOIN listing b ON b.id = a.id+1""")
def _(v):
    from plotwise.operators.upsert import changed_fields

    a = v.listing.select("id", "price", "baths", "kind")
    b = a.select((c("id") - 1).alias("id"), c("price").alias("p2"), c("baths").alias("b2"), c("kind").alias("k2"))
    return a.join(b, "id").select("id", F.array_join(changed_fields(
        {"price": (F.floor(c("price") / 10), F.floor(c("p2") / 10)), "baths": (c("baths"), c("b2")), "kind": (c("kind"), c("k2"))}), ",").alias("changed"))


@query("scl_14_array_membership", """SELECT city, count(*) AS n, count(*) FILTER (kind IN ('1-URGENT','5-LOW')) AS chosen,
  array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds FROM listing GROUP BY city""")
def _(v):
    return v.listing.groupBy("city").agg(F.count("*").alias("n"), F.count(F.when(c("kind").isin("1-URGENT", "5-LOW"), 1)).alias("chosen"),
                                         F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


# Word boundaries that treat accented letters as letters, for the SQL engine.
_B = r"(?:^|$|[^\p{L}\p{N}_])"


def rx(p):
    return q_str(p.replace(r"\b", _B))


def sm(p, text="q"):
    return f"regexp_matches({text}, {rx(p)}, 'i')"


# Query texts as tokens, a line of them and numbers with their surroundings.
_W = rf"""regexp_extract_all(translate(trim(regexp_replace(strip_accents(lower(coalesce(q, ''))), '[\s\p{{Z}}]+', ' ', 'g')), '²–º°', '2-  '), {q_str(rq.TOKEN)})"""
READ_SQL = rf"""w0 AS (SELECT qid, q, {_W} AS w FROM query_log),
  r AS (SELECT qid, q, w, ' ' || array_to_string(w, ' ') || ' ' AS line, list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'x': w[i],
    'b': ' ' || coalesce(array_to_string(list_filter(w[greatest(i - 5, 1):i - 1], lambda t: t <> '$'), ' '), ''),
    'a': coalesce(array_to_string(w[i + 1:i + 2], ' '), '') || ' '}}), lambda z: regexp_matches(z.x, '^\d')) AS n FROM w0)"""


def _has(ps):
    return "(" + " OR ".join(f"contains(line, ' {p} ')" for p in ps) + ")"


def _behind(ps, r="z"):
    return "(" + " OR ".join(f"ends_with({r}.b, ' {p}')" for p in ps) + ")"


def _followed(ps):
    return "(" + " OR ".join(f"starts_with(z.a, '{p}')" for p in ps) + ")"


def _whole(digits="1,9"):
    return rf"regexp_full_match(z.x, '\d{{{digits}}}')"


def _first(test):
    return f"list_filter(n, lambda z: {test})[1]"


_M = f"TRY_CAST({_first(_whole('2,4') + ' AND ' + _followed(['m ', 'metro']))}.x AS INT)"
_KM = f"CAST(floor(CAST(replace({_first(_followed(['km ']))}.x, ',', '.') AS DOUBLE)*1000) AS INT)"
_MIN = f"TRY_CAST({_first(_whole() + ' AND ' + _followed(['min']))}.x AS INT)"
DIST_SQL = f"""coalesce(CASE WHEN {_M} BETWEEN 50 AND 5000 THEN {_M} END, {_KM}, CASE WHEN {_MIN} BETWEEN 1 AND 30 THEN {_MIN}*80 END,
  {sql_case([(_has(ps), d) for d, ps in rq.DISTANCE_WORDS], 'NULL')})"""
CATS_SQL = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {sm('|'.join(rf'\b{w}\b' for w in ws), 'lower(q)')} THEN '{k}' END" for k, ws in tx.CATEGORY_WORDS.items()) + ")"
KINDS_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN {_has(ps)} THEN '{k}' END" for k, ps in rq.KIND_WORDS.items()) + ")"
AMEN_SQL = "concat_ws(',', " + ", ".join(
    f"CASE WHEN {' OR '.join(f'contains(lower(q), {q_str(w)})' for w in ws)} THEN '{k}' END" for k, ws in tx.AMENITY_WORDS.items()) + ")"
_PRICE, _AREA = f"{_whole('2,4')} AND {_followed(['m'])}", f"{_whole('2,4')} AND {_followed(rq.AREA_WORDS)}"
_RANGE = r"entre (\d{2,4}) [y-]$"
_RANGED = _first(f"{_PRICE} AND regexp_matches(z.b, ' {_RANGE}')")
_mil = lambda x: f"CAST(nullif({x}, '') AS BIGINT)*1000000"


def _small(units):
    x = f"TRY_CAST({_first(_whole() + ' AND ' + _followed(units))}.x AS INT)"
    return f"CASE WHEN {x} BETWEEN 1 AND 10 THEN {x} END"


FILTER_SQL = f"""coalesce({_mil(f"regexp_extract({_RANGED}.b, '{_RANGE}', 1)")}, {_mil(_first(_PRICE + ' AND ' + _behind(rq.AT_LEAST)) + '.x')}) AS price_min,
  coalesce({_mil(_RANGED + '.x')}, {_mil(_first(_PRICE + ' AND ' + _behind([*rq.AT_MOST, 'bajo'])) + '.x')}) AS price_max,
  CAST({_first(_AREA + ' AND ' + _behind(rq.AT_LEAST))}.x AS DOUBLE) AS area_min, CAST({_first(_AREA + ' AND ' + _behind(rq.AT_MOST))}.x AS DOUBLE) AS area_max,
  {_small(rq.ROOM_WORDS)} AS rooms_min, {_small(rq.BATH_WORDS)} AS baths_min,
  {sql_case([(f"contains(upper(q), '{z}')", f"'{z}'") for z in tx.LOCALITIES], 'NULL')} AS locality"""
_SAID = r"""regexp_matches(z.b, ' (%s)( >| > =| mayor a)?$')"""


def _floor_sql(dim):
    one = _first(_SAID % "|".join(rq.INDEX_WORDS.values()))
    val = f"CAST(replace({one}.x, ',', '.') AS DOUBLE)"
    named = (_SAID % rq.INDEX_WORDS[dim]).replace("z.b", f"{one}.b")
    hints = [(_has(ps), f"{v}e0") for v, ps in reversed(rq.QUALITY_WORDS.get(dim, []))]
    hint = sql_case(hints, "NULL") if hints else "NULL"
    return f"CAST(coalesce(CASE WHEN {named} AND {val} BETWEEN 0 AND 5 THEN {val} END, {hint}) AS DOUBLE) AS {dim}_min"


_STREET, _SIDE, _SIGN = ("|".join(x) for x in (rq.STREETS, rq.STREET_SIDES, rq.NUMBER_SIGNS))
ADDRESS_SQL = rf"""nullif(trim(regexp_extract(line, ' ((?:{_STREET}) \d+ (?:[{''.join(rq.LETTERS)}] )?(?:(?:{_SIDE}) )?(?:(?:{_SIGN}) ){{1,2}}\d+ (?:[a-z] )?(?:- )?(?:\d+ )?)', 1)), '')"""
DIMS = ["composite", "access", "security", "dwelling", "services", "zoning"]


@query("scl_16_query_features", f"""{READ_SQL} SELECT qid, {DIST_SQL} AS max_m, {CATS_SQL} AS categories, {KINDS_SQL} AS kinds, {FILTER_SQL},
  {', '.join(_floor_sql(d) for d in DIMS)}, {AMEN_SQL} AS amenities, {ADDRESS_SQL} AS address FROM r""")
def _(v):
    from plotwise.operators.search import parse_queries

    return parse_queries(v.query_log, "qid", "q").withColumns({
        n: F.array_join(n, ",") for n in ("categories", "kinds", "amenities")})


_PLACE = "(" + "|".join(rq.PLACES) + ")"
_RANK = "|".join(rq.RANK_WORDS)


def _some(test):
    return f"len(list_filter(n, lambda z: {test})) > 0"


@query("scl_17_route_label", READ_SQL + rf""" SELECT qid, CASE
  WHEN coalesce(array_to_string(list_filter(w, lambda t: NOT list_contains({rq.SIGNS}, t)), ' '), '') IN ({', '.join(q_str(x) for x in rq.GREETINGS)}) THEN 'smalltalk'
  WHEN {_has(rq.EXPLAIN_WORDS)} THEN 'explain'
  WHEN {_has(rq.STATS_WORDS)} OR regexp_matches(line, ' ({_RANK}) {_PLACE}') OR {_some(_behind(rq.RANK_WORDS) + f" AND regexp_matches(z.a, '^{_PLACE}')")} THEN 'stats'
  WHEN {_has(rq.COMPARE_WORDS)} OR regexp_matches(line, '\S (o|vs) \S+ (\S+ ){{0,4}}{_PLACE}') THEN 'compare'
  WHEN {_has(rq.VALUATION_WORDS)} OR {_some(f"{_behind(rq.ASSET_WORDS)} OR ({_behind(['id'])} AND regexp_matches(z.x, '^[0-9][0-9][0-9]'))")} THEN 'acm'
  WHEN {_has(rq.SEARCH_WORDS)} OR {_some(f"({_behind(['a'])} AND {_followed(['m ', 'metro ', 'metros '])}) OR {_followed(['minuto ', 'minutos '])} OR {_behind(['menos de', 'mas de'])}")} THEN 'search'
  WHEN length(trim(coalesce(q, ''))) < 25 THEN 'smalltalk' ELSE 'explain' END AS route FROM r""")
def _(v):
    d = rq.dealt(v.query_log, ["qid", "q"]).withColumn("w", rq.words(c("q"))).withColumn("n", rq.numbers(c("w")))
    return d.select("qid", rq.route(c("q"), c("w"), c("n")).alias("route"))


_REF = " OR ".join(f"contains(t, {q_str(w)})" for w in tx.REFINEMENT_WORDS)


@query("scl_18_refinement_merge", f"""t00 AS (SELECT *, text AS q FROM turns WHERE role='user'),
  t0 AS (SELECT conv_id, turn, q, ' ' || array_to_string({_W}, ' ') || ' ' AS line, CAST(replace(replace(floor(turn/5)::VARCHAR, '.0', ''), '.', '') AS BIGINT) AS session FROM t00),
  t1 AS (SELECT conv_id, turn, session, q, trim(lower(q)) AS t, {KINDS_SQL} AS kinds, {CATS_SQL} AS cats FROM t0),
  t2 AS (SELECT *, lag(kinds) OVER w AS pk, lag(cats) OVER w AS pc, (length(t) < 50 OR {_REF}) AS refine FROM t1 WINDOW w AS (PARTITION BY conv_id, session ORDER BY turn))
  SELECT conv_id, turn, refine, md5(CASE WHEN refine AND coalesce(pk,'')||coalesce(pc,'') <> '' THEN concat(q, ' (filtros previos: ',
  concat_ws('; ', nullif(lower(replace(pk, ',', ', ')), ''), nullif(array_to_string(list_transform(list_filter(string_split(coalesce(pc,''), ','), lambda x: x <> '')[1:3],
  lambda x: concat('cerca a ', map_extract_value(MAP {{{', '.join(f"'{k}': '{w}'" for k, w in tx.CATEGORY_LABELS.items())}}}, x))), '; '), '')), ')') ELSE q END) AS merged FROM t2""")
def _(v):
    from plotwise.operators.search import merge_previous

    t = v.turns.where("role = 'user'").withColumn("session", F.floor(c("turn") / 5))
    return merge_previous(t, ["conv_id", "session"], "turn", "text").select(
        "conv_id", "turn", "refine", F.md5(c("merged")).alias("merged"))


@query("scl_19_cache_key", r"""SELECT qid, md5(concat(trim(regexp_replace(lower(q), '[\s\p{Z}]+', ' ', 'g')), '|', '{"limit": ', qid%10, '}')) AS key FROM query_log""")
def _(v):
    return v.query_log.select("qid", tx.cache_key(c("q"), F.concat(F.lit('{"limit": '), (c("qid") % 10).cast("string"), F.lit("}"))).alias("key"))


# ----------------------------------------------------------------- cleaning

@query("cln_2_price_text", """SELECT id, CAST(nullif(regexp_extract(regexp_replace(t, '[$ .,]', '', 'g'), '\\d+'), '') AS BIGINT) AS price FROM
  (SELECT id, CASE id%4 WHEN 0 THEN concat('$ ', price//1000000, '.', lpad(CAST(price//1000%1000 AS VARCHAR), 3, '0'), '.', lpad(CAST(price%1000 AS VARCHAR), 3, '0'))
   WHEN 1 THEN CAST(price AS VARCHAR) WHEN 2 THEN concat('COP ', price, ' neg') ELSE 'consultar' END AS t FROM listing)""")
def _(v):
    p = c("price")
    pad = lambda x: F.lpad(x.cast("string"), 3, "0")
    t = F.when(c("id") % 4 == 0, F.concat(F.lit("$ "), F.floor(p / 1000000).cast("string"), F.lit("."), pad(F.floor(p / 1000) % 1000), F.lit("."), pad(p % 1000))).when(
        c("id") % 4 == 1, p.cast("string")).when(c("id") % 4 == 2, F.concat(F.lit("COP "), p.cast("string"), F.lit(" neg"))).otherwise("consultar")
    return v.listing.select("id", tx.price_of_text(t).alias("price"))


@query("cln_3_area_text", """SELECT id, CASE id%3 WHEN 0 THEN CAST(concat(CAST(area AS BIGINT), '.25') AS DOUBLE) WHEN 1 THEN CAST(CAST(area AS BIGINT) AS DOUBLE) END AS area
  FROM listing WHERE area IS NOT NULL""")
def _(v):
    a = c("area").cast("bigint").cast("string")
    t = F.when(c("id") % 3 == 0, F.concat(a, F.lit(",25 m²"))).when(c("id") % 3 == 1, F.concat(F.lit("Aprox "), a, F.lit(" M2"))).otherwise("sin dato")
    return v.listing.where("area is not null").select("id", tx.area_of_text(t).alias("area"))


@query("cln_4_first_int_stratum", """SELECT id, CASE WHEN id%10 BETWEEN 1 AND 6 THEN id%10 END AS stratum, rooms FROM listing""")
def _(v):
    return v.listing.select("id", tx.valid_stratum(tx.first_int(F.concat(F.lit("Estrato "), c("id") % 10, F.lit(" de 6")))).alias("stratum"),
                            tx.first_int(F.concat(c("rooms").cast("string"), F.lit(" hab"))).alias("rooms"))


@query("cln_5_coordinates", """SELECT id, CASE WHEN id%5 NOT IN (1,2,3) THEN lon END AS lon, coalesce(CASE WHEN id%5 NOT IN (1,2) THEN (CASE WHEN id%5=3 THEN 0.05e0 ELSE lon END) END
  BETWEEN -180 AND 180 AND lat BETWEEN -90 AND 90 AND abs(CASE WHEN id%5=3 THEN 0.05e0 ELSE lon END) > 0.1 AND abs(lat) > 0.1, false) AS ok FROM listing""")
def _(v):
    raw = F.when(c("id") % 5 == 1, F.lit("NaN")).when(c("id") % 5 == 2, F.lit("abc")).when(c("id") % 5 == 3, F.lit("0.05")).otherwise(c("lon").cast("string"))
    lon = tx.coordinate(raw)
    return v.listing.select("id", F.when(F.abs(lon) > 0.1, lon).alias("lon"), F.coalesce(tx.guarded_point(lon, c("lat")), F.lit(False)).alias("ok"))


_TYPE_SQL = sql_case([(f"contains(lower(t), '{k}')", f"'{w}'") for k, w in tx.TYPE_MAP],
                     "array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1:1])||lower(w[2:])), ' ')")


@query("cln_6_type_canonical", f"""SELECT id, CASE WHEN t <> '' THEN {_TYPE_SQL} END AS kind FROM (SELECT id, trim(([{', '.join(q_str(x) for x in
  ['APTO duplex', ' casa campestre', 'Penthouse', 'consultorio medico', '', 'Terreno rural', 'Apartaestudio', 'local', 'ISLA comercial'])}])[CAST(id%9 AS INT)+1]) AS t FROM listing)""")
def _(v):
    from plotwise.fixtures import pick

    vals = ["APTO duplex", " casa campestre", "Penthouse", "consultorio medico", "", "Terreno rural", "Apartaestudio", "local", "ISLA comercial"]
    return v.listing.select("id", tx.canonical_type(pick(vals, c("id") % 9)).alias("kind"))


@query("cln_7_condition_canonical", """SELECT id, ([ 'Nuevos', 'En construcción', 'Usados', 'Usados', NULL, 'raro' ])[CAST(id%6 AS INT)+1] AS condition FROM listing""")
def _(v):
    from plotwise.fixtures import pick

    vals = ["Es NUEVO", "en Construcción", "usado ", "Buen estado", "", " raro"]
    return v.listing.select("id", tx.canonical_condition(pick(vals, c("id") % 6)).alias("condition"))


@query("cln_8_fold_text", r"""SELECT doc_id, md5(trim(regexp_replace(strip_accents(lower(text)), '[\s\p{Z}]+', ' ', 'g'))) AS folded FROM documents""")
def _(v):
    return v.table("documents").select("doc_id", F.md5(tx.fold(c("text"))).alias("folded"))


_AMEN_TERMS = {a: t for a, t in zip(AMENITIES, ["piscina", "gimnasio", "parqueadero", "portería 24 horas", "ascensor", "zona de parrilla", "depósito"])}


@query("cln_9_amenity_terms", "SELECT l_orderkey AS id, l_linenumber AS line, " + sql_case(
    [(f"l_linenumber%7={i}", f"'{_AMEN_TERMS[a]}'") for i, a in enumerate(AMENITIES)], "NULL") + " AS term, count(*) AS n FROM lineitem GROUP BY ALL")
def _(v):
    from plotwise.fixtures import pick

    raw = F.concat(pick(AMENITIES, c("l_linenumber") % 7), F.when(c("l_orderkey") % 2 == 0, "  Ver más").otherwise(""))
    return v.table("lineitem").groupBy(c("l_orderkey").alias("id"), c("l_linenumber").alias("line"),
                                       tx.amenity_term(tx.clean_amenity(raw)).alias("term")).agg(F.count("*").alias("n"))


@query("cln_10_city", "SELECT id, city FROM listing")
def _(v):
    return v.listing.select("id", tx.city_of_place(c("place")).alias("city"))


@query("cln_11_impute_trim", """g AS (SELECT kind, median(area) AS ma, median(baths) AS mb, median(stratum) AS ms FROM listing GROUP BY kind),
  f AS (SELECT id, l.kind, coalesce(area, ma) AS area, coalesce(baths, mb)::DOUBLE AS baths, coalesce(stratum, ms)::DOUBLE AS stratum, price FROM listing l JOIN g USING (kind)),
  x AS (SELECT *, ln(price/area) AS y FROM f), s AS (SELECT kind, avg(y) AS m, stddev_samp(y) AS s FROM x GROUP BY kind)
  SELECT id, area, baths, stratum, round(y, 6) AS ln_price_m2 FROM x JOIN s USING (kind) WHERE abs(y-m) <= 3*s""")
def _(v):
    f = cl.impute_medians(v.listing.select("id", "kind", "price", "area", "baths", "stratum"), ["area", "baths", "stratum"], ["kind"])
    f = f.withColumn("ln_price_m2", F.ln(c("price") / c("area")))
    return cl.sigma_trim(f, "ln_price_m2", ["kind"]).select("id", "area", "baths", "stratum", F.round("ln_price_m2", 6).alias("ln_price_m2"))


@query("cln_12_complete_cases", "SELECT id FROM scored WHERE access IS NOT NULL AND security IS NOT NULL AND zoning IS NOT NULL AND area IS NOT NULL AND baths IS NOT NULL")
def _(v):
    return cl.complete_cases(v.scored, ["access", "security", "zoning", "area", "baths"]).select("id")


@query("cln_13_rule_quarantine", """SELECT id, concat_ws(',', CASE WHEN NOT (garages<>2 OR kind='1-URGENT') THEN 'project_only_flat' END,
  CASE WHEN NOT (site IN ('F','O')) THEN 'offer_state' END) AS reason FROM listing""")
def _(v):
    rules = {"project_only_flat": (c("garages") != 2) | (c("kind") == "1-URGENT"), "offer_state": c("site").isin("F", "O")}
    return cl.quarantine(v.listing, rules).select("id", "reason")


_BOX = "(lon BETWEEN -74.15 AND -74.05 AND lat BETWEEN 4.5 AND 4.8)"


@query("cln_14_blank_outside", "SELECT id, " + ", ".join(f"CASE WHEN lon IS NULL OR {_BOX} THEN {s} END AS {s}" for s in SCORES) + " FROM scored")
def _(v):
    return cl.blank_outside(v.scored, SCORES, {"lon": (-74.15, -74.05), "lat": (4.5, 4.8)}).select("id", *SCORES)


@query("flt_1_listing_search", f"""SELECT id, price, composite FROM (SELECT *, 2*6371000.0e0*asin(sqrt(pow(sin(radians(4.65e0-lat)/2),2)+cos(radians(lat))*cos(radians(4.65e0))*
  pow(sin(radians(-74.1e0-lon)/2),2))) AS d FROM scored) WHERE kind='2-HIGH' AND price >= 50000000 AND price <= 450000000 AND area >= 20 AND rooms >= 2
  AND access >= 1.0 AND d <= 12000 AND NOT is_outlier ORDER BY composite DESC NULLS LAST, id LIMIT 20 OFFSET 5""")
def _(v):
    return cl.search_listings(v.scored, kind="2-HIGH", price=(50_000_000, 450_000_000), area=(20, None), rooms_min=2,
                              floors={"access": 1.0}, near=(-74.1, 4.65, 12_000.0), limit=20, offset=5).select("id", "price", "composite")


@query("flt_2_plausible", "SELECT id FROM listing WHERE price BETWEEN 50000000 AND 400000000 AND area BETWEEN 20 AND 200 AND rooms BETWEEN 1 AND 8")
def _(v):
    return cl.plausible(v.listing, {"price": (50_000_000, 400_000_000), "area": (20, 200), "rooms": (1, 8)}).select("id")


@query("flt_3_placeholder_prices", "SELECT id FROM listing WHERE NOT (kind IN ('1-URGENT','2-HIGH') AND price < 30000000)")
def _(v):
    return cl.drop_placeholder_prices(v.listing, ["1-URGENT", "2-HIGH"]).select("id")


@query("prj_0_derived_features", """SELECT id, round(price/nullif(area,0), 4) AS price_m2, round(ln(price),8) AS ln_price, round(ln(area),8) AS ln_area,
  area*stratum AS area_stratum, round(baths/nullif(rooms,0), 8) AS bath_ratio, round(ln(price/nullif(area,0)),8) AS ln_price_m2 FROM listing""")
def _(v):
    r = lambda n, d: F.round(c(n), d).alias(n)
    return cl.derived_features(v.listing).select("id", r("price_m2", 4), r("ln_price", 8), r("ln_area", 8), "area_stratum", r("bath_ratio", 8), r("ln_price_m2", 8))


@query("prj_1_web_mercator", """SELECT id, round(radians(lon)*6378137.0e0, 3) AS x, round(ln(tan(pi()/4+radians(lat)/2))*6378137.0e0, 3) AS y,
  round(lon, 9) AS lon2, round(lat, 9) AS lat2 FROM listing WHERE lon IS NOT NULL""")
def _(v):
    x, y = sp.lonlat_to_mercator("lon", "lat")
    d = v.listing.where("lon is not null").withColumns({"x": x, "y": y})
    lon2, lat2 = sp.mercator_to_lonlat("x", "y")
    return d.select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(lon2, 9).alias("lon2"), F.round(lat2, 9).alias("lat2"))


@query("prj_2_transverse_mercator", """SELECT id, round(lon, 8) AS lon_national, round(lat, 8) AS lat_national, round(lon, 8) AS lon_city, round(lat, 8) AS lat_city,
  true AS in_frame FROM listing WHERE lon IS NOT NULL""")
def _(v):
    out = v.listing.where("lon is not null")
    for name, grid in (("national", sp.NATIONAL_GRID), ("city", sp.CITY_GRID)):
        x, y = grid.forward("lon", "lat")
        out = out.withColumns({f"x_{name}": x, f"y_{name}": y})
        lo, la = grid.inverse(f"x_{name}", f"y_{name}")
        out = out.withColumns({f"lon_{name}": F.round(lo, 8), f"lat_{name}": F.round(la, 8)})
    frame = c("x_national").between(980_000, 1_020_000) & c("y_national").between(970_000, 1_040_000)
    return out.select("id", "lon_national", "lat_national", "lon_city", "lat_city", frame.alias("in_frame"))
