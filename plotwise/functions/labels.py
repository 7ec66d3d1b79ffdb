"""Score tables, labels and decay kernels as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# All score tables, bands and messages in this block.
TREATMENT_SCORES = [("renovaci", 5.0), ("desarrollo", 4.5), ("consolidaci", 3.0), ("mejoramiento", 2.0), ("conservaci", 1.0)]
TREATMENT_DEFAULT = 2.5
BUILD_SCORES = {"4": 5.0, "4A": 5.0, "4B": 5.0, "4C": 5.0, "4D": 5.0, "3": 4.0, "2": 3.0, "1": 2.0}
BUILD_DEFAULT = 2.5
ACTIVITY_SCORES = {"AAERAE": 5.0, "AAGSM": 4.5, "AAERVIS": 4.0, "AAPGSU": 3.5, "AAPRSU": 3.0, "PEMP": 1.0}
ACTIVITY_DEFAULT = 3.0
INDEX_BANDS = [(4.5, "Excelente"), (4.0, "Muy Bueno"), (3.5, "Bueno"), (3.0, "Regular"),
               (2.5, "Por Debajo del Promedio"), (2.0, "Deficiente")]
INDEX_LOWEST = "Muy Deficiente"
ZONING_BANDS = [(4.5, "Muy Alto"), (4.0, "Alto"), (3.5, "Medio-Alto"), (3.0, "Medio"), (2.5, "Medio-Bajo"), (2.0, "Bajo")]
ZONING_LOWEST = "Muy Bajo"
KMO_BANDS = [(0.90, "Maravilloso"), (0.80, "Meritorio"), (0.70, "Aceptable"), (0.60, "Mediocre"), (0.50, "Miserable")]
KMO_LOWEST = "Inaceptable"
SAATY_BANDS = [(1, "Igual importancia"), (2, "Ligeramente más importante"), (4, "Moderadamente más importante"),
               (6, "Fuertemente más importante"), (8, "Muy fuertemente más importante")]
SAATY_HIGHEST = "Extremadamente más importante"
MARKET_ABOVE = [(1.20, "Significativamente por encima del mercado"), (1.10, "Ligeramente por encima del mercado")]
MARKET_FROM = [(0.90, "En linea con el mercado"), (0.80, "Ligeramente por debajo del mercado")]
MARKET_LOWEST = "Significativamente por debajo del mercado"
ALERTS = [("security", 2.5, "Zona con seguridad por debajo del promedio"),
          ("access", 2.0, "Accesibilidad limitada a transporte público"),
          ("zoning", 2.0, "Potencial normativo muy bajo (restricciones POT)")]
OFFER_FACTOR = 0.95
CONDITION_LEVELS = {"Remodelado": 5, "Nuevos": 5, "Buen estado": 4, "En construcción": 3, "Usados": 3,
                    "Sobre planos": 3, "Para remodelar": 1}
CONDITION_DEFAULT = 3
CONDITION_FACTORS = {-4: 0.85, -3: 0.88, -2: 0.92, -1: 0.95, 0: 1.00, 1: 1.05, 2: 1.10, 3: 1.15, 4: 1.20}
URL_TEMPLATES = {"finca_raiz": "https://www.fincaraiz.com.co/%s", "habi": "https://habi.co/inmueble/%s",
                 "metrocuadrado": "https://www.metrocuadrado.com/inmueble/%s"}


def lookup(table: dict, key: Column, default=None) -> Column:
    """Literal map lookup; missing or null keys give `default`."""
    flat = [F.lit(x) for kv in table.items() for x in kv]
    found = F.when(key.isNotNull(), F.try_element_at(F.create_map(*flat), key))
    return found if default is None else F.coalesce(found, F.lit(default))


def chain(pairs, default) -> Column:
    """First true condition wins."""
    out = None
    for cond, val in pairs:
        out = F.when(cond, F.lit(val)) if out is None else out.when(cond, F.lit(val))
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def treatment_score(name: Column) -> Column:
    return chain([(F.lower(name).contains(p), s) for p, s in TREATMENT_SCORES], TREATMENT_DEFAULT)


def build_score(rng: Column) -> Column:
    return lookup(BUILD_SCORES, rng, BUILD_DEFAULT)


def activity_score(code: Column) -> Column:
    return lookup(ACTIVITY_SCORES, code, ACTIVITY_DEFAULT)


def _bands(x: Column, bands, lowest: str) -> Column:
    return F.when(x.isNotNull(), chain([(x >= lo, name) for lo, name in bands], lowest))


def index_label(x: Column) -> Column:
    return _bands(x, INDEX_BANDS, INDEX_LOWEST)


def zoning_label(x: Column) -> Column:
    return _bands(x, ZONING_BANDS, ZONING_LOWEST)


def kmo_label(x: Column) -> Column:
    return _bands(x, KMO_BANDS, KMO_LOWEST)


def market_label(ratio: Column) -> Column:
    pairs = [(ratio > v, t) for v, t in MARKET_ABOVE] + [(ratio >= v, t) for v, t in MARKET_FROM]
    return F.when(ratio.isNotNull(), chain(pairs, MARKET_LOWEST))


def saaty_label(v: Column) -> Column:
    return chain([(v == SAATY_BANDS[0][0], SAATY_BANDS[0][1])] + [(v <= hi, t) for hi, t in SAATY_BANDS[1:]], SAATY_HIGHEST)


def alerts(columns: dict[str, Column]) -> Column:
    """Messages of the scores that fall below their threshold."""
    return F.array_compact(F.array(*[F.when(columns[n] < th, F.lit(msg)) for n, th, msg in ALERTS]))


def clip(x: Column, lo: float = 0.0, hi: float = 5.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), x)))


def half_up(x: Column, digits: int = 2) -> Column:
    """Round halves away from zero on the decimal value, as numeric columns do."""
    return F.round(x.cast("decimal(28,10)"), digits).cast("double")


def inverted(x: Column, top: float = 5.0) -> Column:
    return F.lit(top) - x


def gaussian_decay(d: Column, sigma) -> Column:
    return F.exp(-(d * d) / (2 * sigma * sigma))


def linear_decay(d: Column, radius) -> Column:
    return F.greatest(F.lit(0.0), 1 - d / radius)


def inverse_decay(d: Column, floor: float = 50.0) -> Column:
    return F.lit(1.0) / F.greatest(d, F.lit(float(floor)))


def calibrated_sigma(radius: float, threshold: float = 0.05) -> float:
    """Sigma at which the gaussian kernel has fallen to `threshold` at `radius`."""
    return radius / math.sqrt(2 * math.log(1 / threshold))


def walking_minutes(metres: Column, pace: float = 80.0) -> Column:
    """At least one minute; halves go to the even minute."""
    return F.greatest(F.lit(1), F.bround(metres / pace).cast("int"))


def listing_url(site: Column, code: Column) -> Column:
    """Advert address from the site's template; empty where the site has none."""
    known = (site != "") & (code != "")
    return F.coalesce(F.when(known, F.replace(lookup(URL_TEMPLATES, site), F.lit("%s"), code)), F.lit(""))


def condition_factor(comp_state: Column, subj_state: Column, comp_area: Column, subj_area: Column) -> Column:
    """Adjustment from the state levels, then ±5 % when areas differ by more than 15 %."""
    level = lambda s: lookup(CONDITION_LEVELS, s, CONDITION_DEFAULT)
    diff = F.greatest(F.lit(-4), F.least(F.lit(4), level(subj_state) - level(comp_state)))
    factor = lookup(CONDITION_FACTORS, diff, 1.0)
    ratio = F.when((comp_area != 0) & (subj_area > 0), comp_area / subj_area)
    tweak = F.when(ratio > 1.15, 0.95).when(ratio < 0.85, 1.05).otherwise(1.0)
    return half_up(factor * tweak, 2)
