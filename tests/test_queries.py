"""Registered queries against their SQL on the smallest data set.

A spread of queries runs by default; PLOTWISE_ALL=1 runs every one that has SQL.
"""

import os

import pytest

from compare import compare, connect

SF = "/root/testdata/sf0.001"
SPREAD = ["scl_7_invert_clip_divide", "scl_17_route_label", "cln_1_listing_normalizer", "cln_11_impute_trim", "jon_7_band_comparables", "agg_2_price_distribution", "agg_13_amenity_flags",
          "agg_20_insecurity_index", "win_3_percentiles", "win_8_price_history", "pip_3_nearest_fallback", "rng_2_context_counts", "knn_1_nearest_station", "ind_1_transit_gravity",
          "ind_8_security_three_dims", "ind_24_opportunity_table", "reg_0_grouped_ols", "reg_9_retrain_decision", "out_3_cluster_labels", "val_2_cluster_comparables", "simp_1_simplified_zones", "sea_7_similar_raw", "sta_1_nested_models", "mc_1_rank_stability", "out_1_density_noise", "val_1_comparables",
          "sea_1_ranked_search", "vec_1_cosine_topk", "ups_1_keyed_upsert", "src_1_geojson_points", "str_5_window_counts", "str_9_duplicate_suppression"]


def keys():
    import __spark_entry__ as e

    return sorted(e.oracle_sql()) if os.environ.get("PLOTWISE_ALL") else SPREAD


def test_registry_is_consistent():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(SPREAD) <= set(e.oracle_sql())


@pytest.mark.parametrize("key", keys())
def test_query_matches_sql(spark, key):
    import __spark_entry__ as e

    if not os.path.isdir(SF):
        pytest.skip("data set not present")
    status, info, _ = compare(spark, connect(SF), key, e.queries()[key], e.oracle_sql().get(key), SF)
    assert status in ("ok", "near"), info


def test_entry(spark):
    import __spark_entry__ as e

    if not os.path.isdir(SF):
        pytest.skip("data set not present")
    assert e.entry(spark).count() > 0
