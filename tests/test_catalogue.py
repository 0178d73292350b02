"""Every catalogued query with SQL gives the same rows, columns and values as DuckDB."""

import pytest

from ebbline.catalog.queries import oracle_sql, queries
from tools.compare import compare, connect

SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    status, n, detail = compare(spark, duck, sf, queries()[name], SQL[name])
    assert status == "ok", detail
    if name not in ("tail_segment", "short_series_report"):
        assert n > 0


def test_names_of_the_inventory():
    missing = set("""scan_meter scan_location scan_occupant volume_source_join charge_source_join
        cutoffs_source_join save_tables read_tables write_feature_table read_feature_table
        write_predictions write_model_stats write_model_coefs best_run_registry occupant_dedupe
        occupant_default_dates date_consistency occupant_key label_charges label_volumes
        label_unknown_location geocode_lookup align_monthly_pad align_monthly_sum align_monthly_mean
        assemble_date wrap_align null_invalid null_outliers interpolate_linear fill_zero late_flag
        clean_tables eligible_occupants ever_cutoff_flag customer_metadata clip_history usable_series
        log_volume zscore_series zscore_seasonal segment_by_cutoffs tail_segment pair_segments
        single_segment backward_windows window_labels latest_window future_cutoff_label prior_cutoffs
        charge_window_stats volume_window_stats volume_window_skew anomaly_window_stats
        seasonal_anomaly_window_stats window_coverage_report binary_label feature_table
        impute_cutoff_stats drop_incomplete_occupants predict_fill_zero label_choice feature_sweep
        select_features stratified_split class_weights smote_oversample encode_categoricals
        train_logistic_regularized train_logistic_plain train_random_forest stratified_folds depth_grid
        score_batch metric_auc metric_logloss metric_r2 best_model model_coefs train_sweep
        save_load_model predict_current risk_table risk_percentages dedupe_location
        anonymize_addresses threshold_filter predicted_cutoffs expected_total expected_mean map_points
        category_share customer_table map_cells fetch_tables geocode_best short_series_report""".split()) - set(queries())
    assert not missing
