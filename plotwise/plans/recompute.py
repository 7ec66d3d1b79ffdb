"""Index chain over all located listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotwise.operators import geo
from plotwise.operators import indicators as ind


def recompute_indices(listings: DataFrame, *, stations: DataFrame, pois: DataFrame, zones: DataFrame, layers: DataFrame,
                      station_id: str = "station_id") -> DataFrame:
    """All five sub-indices and the composite of every located listing.

    Spatial scores are found once per distinct location and attached to the
    listings in one join; `zones` carries `zone_id`, `mass` and `rings`.
    """
    pts = listings.where("lon is not null and lat is not null")
    locs = geo.locations(pts)
    d = ind.station_access(locs, stations, station_id)
    d = ind.simple_services(d, pois)
    d = geo.one_polygon(d, zones.select("zone_id", "mass", "rings"), "zone_id", ["zone_id", "mass"])
    d = ind.zoning_potential(d, layers).withColumn("security", ind.zone_security(F.col("mass")))
    scores = d.select("lon", "lat", "zone_id", "access", "security", "services", "zoning")
    out = pts.drop("zone_id", "access", "security", "services", "zoning", "dwelling", "composite").join(scores, ["lon", "lat"])
    return out.withColumn("dwelling", ind.rule_dwelling()).withColumn("composite", ind.composite("five"))
