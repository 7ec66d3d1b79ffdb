"""Row cleaning, plausibility filters and derived features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.operators.ranking import join_on, medians

# Service area of the city, and plausible ranges for modelling.
CITY_BOX = {"lon": (-75.0, -73.0), "lat": (3.0, 6.0)}
OFFER_STATES = ["active", "inactive", "sold", "removed"]
MIN_DWELLING_PRICE = 30_000_000


def impute_medians(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """Fill nulls with the exact group median."""
    m = medians(df, cols, by)
    out = join_on(df, m, by, "left")
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"med_{c}")) for c in cols}).drop(*[f"med_{c}" for c in cols])


def informative_columns(df: DataFrame, cols: list[str]) -> list[str]:
    """Columns with any spread (one small row to the driver)."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in cols]).first()
    return [c for c in cols if (row[c] or 0) > 0]


def sigma_trim(df: DataFrame, col: str, by: list[str], n_sigma: float = 3.0) -> DataFrame:
    """Keep rows within n_sigma standard deviations of the group mean."""
    st = df.groupBy(*by).agg(F.avg(col).alias("_m"), F.stddev_samp(col).alias("_s"))
    j = join_on(df, st, by)
    return j.where(F.abs(F.col(col) - F.col("_m")) <= n_sigma * F.col("_s")).drop("_m", "_s")


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=cols).where(reduce(lambda a, b: a & b, [~F.isnan(F.col(c).cast("double")) for c in cols]))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add `reason`: names of the broken rules joined by commas, empty for valid rows."""
    return df.withColumn("reason", F.concat_ws(",", *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))


def blank_outside(df: DataFrame, cols: list[str], box: dict = CITY_BOX) -> DataFrame:
    """Null the columns of rows located outside the box; rows without a location keep theirs."""
    inside = reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, (lo, hi) in box.items()])
    located = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    return df.withColumns({c: F.when(~located | inside, F.col(c)) for c in cols})


def plausible(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.col(c).between(lo, hi) for c, (lo, hi) in ranges.items()]))


def drop_placeholder_prices(df: DataFrame, kinds: list[str], floor: int = MIN_DWELLING_PRICE) -> DataFrame:
    """Dwellings below a credible sale price are left out; a missing price is not a reason."""
    bad = F.col("kind").isin(kinds) & F.col("price").isNotNull() & (F.col("price") < floor)
    return df.where(~bad)


def unflagged(df: DataFrame) -> DataFrame:
    """Without listings flagged as outliers; a table without the flag has none."""
    return df.where(~F.coalesce(F.col("is_outlier"), F.lit(False))) if "is_outlier" in df.columns else df


def search_listings(df: DataFrame, *, kind=None, price=(None, None), area=(None, None), rooms_min=None, baths_min=None,
                    floors: dict | None = None, near: tuple[float, float, float] | None = None, order_by: str = "composite",
                    descending: bool = True, limit: int | None = 20, offset: int = 0) -> DataFrame:
    """Filtered, sorted and paged listing search without flagged outliers; only the filters given are applied."""
    from plotwise.functions.spatial import haversine

    c, df = F.col, unflagged(df)
    if kind is not None:
        df = df.where(c("kind") == kind)
    for name, (lo, hi) in (("price", price), ("area", area)):
        if lo is not None:
            df = df.where(c(name) >= lo)
        if hi is not None:
            df = df.where(c(name) <= hi)
    if rooms_min is not None:
        df = df.where(c("rooms") >= rooms_min)
    if baths_min is not None:
        df = df.where(c("baths") >= baths_min)
    for name, lo in (floors or {}).items():
        df = df.where(c(name) >= lo)
    if near is not None:
        lon, lat, radius = near
        df = df.withColumn("dist", haversine("lon", "lat", F.lit(lon), F.lit(lat))).where(c("dist") <= radius)
    key = c(order_by).desc_nulls_last() if descending else c(order_by).asc_nulls_last()
    df = df.orderBy(key, "id").offset(offset)
    return df.limit(limit) if limit is not None else df


def derived_features(df: DataFrame) -> DataFrame:
    price, area = F.col("price").cast("double"), F.col("area")
    return df.withColumns({
        "price_m2": F.try_divide(price, F.nullif(area, F.lit(0.0))),
        "ln_price": F.ln(F.when(price > 0, price)),
        "ln_area": F.ln(F.when(area > 0, area)),
        "area_stratum": area * F.col("stratum"),
        "bath_ratio": F.try_divide(F.col("baths").cast("double"), F.nullif(F.col("rooms").cast("double"), F.lit(0.0))),
    }).withColumn("ln_price_m2", F.ln(F.when(F.col("price_m2") > 0, F.col("price_m2"))))
