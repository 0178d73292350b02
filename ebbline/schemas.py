"""Table schemas and the column lists every stage agrees on.

Missing values are NULL everywhere.  NaN is turned into NULL when a table is
opened (``functions.columns.null_for_nan``), because Spark orders NaN above every
number and an unknown reading would otherwise count as an anomaly.
"""

from __future__ import annotations

from pyspark.sql import types as T

_INT, _LONG, _DOUBLE = T.IntegerType(), T.LongType(), T.DoubleType()
_STR, _TS = T.StringType(), T.TimestampNTZType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


# Column names and types of the six input tables.
METER = _table(
    meter_id=_LONG, cis_cust_id=_STR, cis_location_id=_STR, location_id=_LONG,
    cust_type=_STR, cust_type_code=_INT, meter_type=_STR, meter_size=_DOUBLE,
    meter_size_units=_STR, meter_size_lowflow=_DOUBLE, num_units=_INT,
)
LOCATION = _table(
    location_id=_LONG, meter_address=_STR, municipality=_INT, subdivision=_STR,
    route=_STR, aggregate_cust_type_code=_INT,
)
OCCUPANT = _table(location_id=_LONG, cis_occupant_id=_INT, move_in_date=_TS, move_out_date=_TS)
VOLUME = _table(
    location_id=_LONG, meter_id=_LONG, charge_id=_LONG, meter_read_at=_TS,
    volume_kgals=_DOUBLE, volume_unit=_STR, unbilled=_STR,
)
CHARGE = _table(
    charge_id=_LONG, cis_bill_id=_STR, location_id=_LONG, billing_period_end=_TS,
    base_charge=_DOUBLE, vol_charge=_DOUBLE, total_charge=_DOUBLE,
    late_charge=_DOUBLE, tampering_charge=_DOUBLE,
)
CUTOFFS = _table(id=_LONG, location_id=_LONG, cis_occupant_id=_INT, cutoff_at=_TS)

TABLES: dict[str, T.StructType] = {
    "meter": METER,
    "location": LOCATION,
    "occupant": OCCUPANT,
    "volume": VOLUME,
    "charge": CHARGE,
    "cutoffs": CUTOFFS,
}


# Data columns a gap month does not inherit from the month before.
CHARGE_DATA = [
    "location_id", "base_charge", "vol_charge", "total_charge", "late_charge", "tampering_charge",
]
VOLUME_DATA = ["volume_kgals", "unbilled"]

# Names of the window statistics.
CHARGE_STATS = ["f_late", "mean_charge_tot", "mean_charge_late"]
ANOMALY_STATS = [
    "f_anom3_vol", "f_anom4_vol", "f_anom5_vol", "max_anom_vol",
    "f_anom3_vol_log", "f_anom4_vol_log", "f_anom5_vol_log", "max_anom_vol_log",
    "f_manom3_vol", "f_manom4_vol", "f_manom5_vol", "max_manom_vol",
    "f_manom3_vol_log", "f_manom4_vol_log", "f_manom5_vol_log", "max_manom_vol_log",
]
VOLUME_STATS = ["skew_vol", "f_zero_vol", *ANOMALY_STATS, "mean_vol"]
STATS = CHARGE_STATS + VOLUME_STATS

# The 21 statistics that are imputed or zero-filled; f_zero_vol is not among them.
IMPUTED_STATS = ["f_late", "mean_charge_tot", "mean_charge_late", "mean_vol", "skew_vol", *ANOMALY_STATS]

ID_COLUMNS = [
    "occupant_id", "location_id", "latitude", "longitude", "meter_address", "municipality",
    "cust_type", "cust_type_code", "meter_size", "segment", "window", "label",
    "cutoff_strict", "cutoff", "nCutPrior", "cut_prior",
]
FEATURE_COLUMNS = ID_COLUMNS + STATS
