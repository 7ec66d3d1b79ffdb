"""The whole job: raw documents to listings, zones, indices, outliers and models, with a stage report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.operators import geo
from plotwise.operators import indicators as ind
from plotwise.operators import outliers as ou
from plotwise.operators import regression as rg
from plotwise.operators import upsert as up
from plotwise.plans.recompute import recompute_indices
from plotwise.session import stage
from plotwise.sources.listings import normalize_all

FIELDS = ["price", "area", "rooms", "baths", "garages", "stratum", "kind", "operation", "place", "lat", "lon"]


def refresh(docs: DataFrame, current: DataFrame | None, *, stations: DataFrame, pois: DataFrame, zones: DataFrame, barrios: DataFrame, layers: DataFrame,
            now, last_outlier_run=None, last_model_run=None, model_runs: DataFrame | None = None, predicted: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every stage reads and writes tables of the shared folder.

    Returns the tables and a report of (stage, metric, value). Outliers run if
    enough is new; models are fitted on the listings that are left, if the retrain
    rule says so: `last_model_run` (none: first run), samples per kind of that run
    (`model_runs`: kind, n_samples) and its predictions (`predicted`: id, predicted).
    """
    spark = docs.sparkSession
    tables, report = {}, []

    batch = stage(normalize_all(docs).where("code <> ''"), "normalized")
    if current is None:
        current = batch.select("site", "code", *FIELDS).limit(0).withColumns({"first_seen": now, "last_seen": now, "scrapes": F.lit(0)})
    snap = up.upsert(current, batch, ["site", "code"], FIELDS, now, F.struct("price", "area", "rooms", "baths", "place"))
    snap = stage(snap.withColumn("id", F.xxhash64("site", "code")).withColumn("city", _city()), "snapshot")
    tables["snapshot"] = snap
    report.append(snap.groupBy(F.lit("upsert").alias("stage"), F.col("action").alias("metric")).agg(F.count("*").cast("double").alias("value")))

    zoned = stage(geo.assign_zones(snap, barrios, "barrio_id"), "zoned")
    report.append(zoned.groupBy(F.lit("zones").alias("stage"), F.coalesce("path", F.lit("no_location")).alias("metric")).agg(F.count("*").cast("double").alias("value")))

    scored = stage(recompute_indices(zoned, stations=stations, pois=pois, zones=zones, layers=layers), "scored")
    tables["scored"] = scored
    report.append(scored.agg(F.count("*").cast("double").alias("value")).select(F.lit("indices").alias("stage"), F.lit("updated").alias("metric"), "value"))

    due = ou.rerun_decision(snap, "last_seen", last_outlier_run, now).first()
    if due["trigger"]:
        found = stage(ou.classify(scored, ["city", "kind"]), "outliers")
        tables["outliers"] = found
        scored = scored.join(found.select("id"), "id", "left_anti")
        report.append(found.agg(F.count("*").cast("double").alias("value")).select(F.lit("outliers").alias("stage"), F.lit("found").alias("metric"), "value"))

    d = scored.where("price > 0 and area > 0").withColumn("y", F.ln(F.col("price") / F.col("area")))
    rated = d.withColumn("price_m2", F.col("price") / F.col("area"))
    rated = rated.join(predicted.select("id", "predicted"), "id", "left") if predicted is not None else rated
    again = rg.retrain_decision(rated, model_runs, last_model_run, "last_seen", ["stratum", "area"]).first()
    report.append(spark.createDataFrame([("models", "due", float(again["retrain"]))], "stage string, metric string, value double"))
    models = {} if not again["retrain"] else rg.model_race(d, "y", {"hedonic": ["area", "rooms", "garages"], "full": ["area", "rooms", "garages", "access", "services", "zoning"]}, "kind", "id")
    tables["opportunities"] = ind.opportunity_table(stage(scored.select("id", "kind", "price", "area", "composite"), "index"))
    rows = [("models", f"{k}_{n}", float(v)) for k, r in models.items() for n, v in (("r2", r["models"][r["best"]]["r2"]), ("cv_rmse", r["models"][r["best"]]["cv_rmse_mean"]))]
    if rows:
        report.append(spark.createDataFrame(rows, "stage string, metric string, value double"))
    return tables, geo.union_all(report)


def _city():
    from plotwise.functions.text import city_of_place

    return city_of_place(F.col("place"))
