"""Plain SQL for DuckDB that computes what each catalogued query must return.

Written as common table expressions that restate the rules row by row (windows, joins,
moments), independent of how the Spark operators are planned.
"""

from __future__ import annotations

import re

from ebbline.catalog.fixtures import FIXTURES, PREDICT_REF, TRAIN_REF
from ebbline.schemas import CHARGE_STATS, FEATURE_COLUMNS, IMPUTED_STATS, STATS

# Coefficients of the logit used where a query must not depend on a fitted model.
LOGIT = {"intercept": -1.5, "f_late": 3.0, "f_zero_vol": 2.0, "f_anom3_vol": 1.0}
THRESHOLD = 50.0
OCC = "occupant_id"

TRAIN, PREDICT = f"TIMESTAMP '{TRAIN_REF}'", f"TIMESTAMP '{PREDICT_REF}'"

CTES: dict[str, str] = {k: v.format(TS="TIMESTAMP") for k, v in FIXTURES.items()}


def _label(table: str, row_id: str, ts: str) -> str:
    return f"""
        SELECT r.*, CASE WHEN k.location_id IS NULL AND r.{ts} IS NOT NULL
                         THEN printf('%d-%03d', r.location_id, 0) ELSE b.occupant_id END AS occupant_id
        FROM {table} r
        LEFT JOIN (SELECT DISTINCT location_id FROM occ_c) k ON k.location_id = r.location_id
        LEFT JOIN (SELECT x.{row_id}, o.occupant_id,
                          row_number() OVER (PARTITION BY x.{row_id} ORDER BY o.move_in_date DESC,
                              o.cis_occupant_id DESC, o.move_out_date DESC) AS pick
                   FROM {table} x JOIN occ_c o ON o.location_id = x.location_id
                        AND x.{ts} BETWEEN o.move_in_date AND o.move_out_date) b
               ON b.{row_id} = r.{row_id} AND b.pick = 1"""


CTES |= {
    "occ_d": """
        SELECT * EXCLUDE (n) FROM (
            SELECT *, count(*) OVER (PARTITION BY location_id, cis_occupant_id) AS n FROM occupant
            WHERE location_id IS NOT NULL AND cis_occupant_id IS NOT NULL)
        WHERE n = 1 OR move_out_date IS NOT NULL""",
    "occ_c": """
        SELECT location_id, cis_occupant_id,
               coalesce(move_in_date, TIMESTAMP '1800-01-01') AS move_in_date,
               coalesce(move_out_date, TIMESTAMP '2099-12-31') AS move_out_date, data_set_id,
               printf('%d-%03d', location_id, cis_occupant_id) AS occupant_id
        FROM occ_d""",
    "cutoffs_k": "SELECT *, printf('%d-%03d', location_id, cis_occupant_id) AS occupant_id FROM cutoffs",
    "charge_l": _label("charge", "charge_id", "billing_period_end"),
    "volume_l": _label("volume", "charge_id", "meter_read_at"),
    "location_c": """
        SELECT l.*, g.latitude, g.longitude FROM location l
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY address_key
                                                ORDER BY latitude, longitude) AS k FROM geocode) g
               ON g.k = 1 AND g.address_key = substr(l.meter_address, 1, length(l.meter_address) - 5)""",
    "volume_n": """
        SELECT * REPLACE (CASE WHEN volume_kgals >= 0 THEN volume_kgals END AS volume_kgals,
                          CASE WHEN location_id > 0 THEN location_id END AS location_id,
                          CASE WHEN meter_id > 0 THEN meter_id END AS meter_id) FROM volume_l""",
    "volume_o": """
        SELECT * EXCLUDE (mu, sd) REPLACE (
                   CASE WHEN occupant_id IS NOT NULL AND sd > 0 AND (volume_kgals - mu) / sd > 5
                        THEN NULL ELSE volume_kgals END AS volume_kgals)
        FROM (SELECT *, avg(volume_kgals) OVER (PARTITION BY occupant_id) AS mu,
                     stddev_samp(volume_kgals) OVER (PARTITION BY occupant_id) AS sd FROM volume_n)""",
    "volume_p": """
        SELECT *, row_number() OVER (PARTITION BY occupant_id ORDER BY meter_read_at, charge_id) AS pos
        FROM volume_o""",
    "volume_b": """
        SELECT *,
               max(CASE WHEN volume_kgals IS NOT NULL THEN pos END) OVER (PARTITION BY occupant_id
                   ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
               min(CASE WHEN volume_kgals IS NOT NULL THEN pos END) OVER (PARTITION BY occupant_id
                   ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
        FROM volume_p""",
    "volume_i": """
        SELECT b.* EXCLUDE (pos, before, after) REPLACE (
                 CASE WHEN b.occupant_id IS NULL OR b.volume_kgals IS NOT NULL THEN b.volume_kgals
                      WHEN b.after IS NULL THEN x.volume_kgals
                      WHEN b.before IS NOT NULL THEN x.volume_kgals
                           + (y.volume_kgals - x.volume_kgals) * ((b.pos - b.before) / (b.after - b.before))
                 END AS volume_kgals)
        FROM volume_b b
        LEFT JOIN volume_p x ON x.occupant_id = b.occupant_id AND x.pos = b.before
        LEFT JOIN volume_p y ON y.occupant_id = b.occupant_id AND y.pos = b.after""",
    "volume_c": "SELECT * REPLACE (coalesce(volume_kgals, 0) AS volume_kgals) FROM volume_i",
    "charge_c": """
        SELECT * REPLACE (coalesce(total_charge, 0) AS total_charge,
                          coalesce(late_charge, 0) AS late_charge),
               CASE WHEN coalesce(late_charge, 0) > 0 THEN 1 ELSE 0 END AS late
        FROM charge_l""",
    "lens": "SELECT CAST(unnest([{LENS}]) AS INTEGER) AS n",
}
#: Joined with themselves or used more than once: computed once whatever the planner would choose.
STORED = ("volume_p", "volume_b", "volume_i", "volume_c")


def _profile(table: str, ts: str, ref: str, value: str | None) -> str:
    extra = "" if value is None else f""",
               avg(CASE WHEN {ts} <= {ref} THEN {value} END) AS mu,
               stddev_pop(CASE WHEN {ts} <= {ref} THEN {value} END) AS sd,
               avg(CASE WHEN {ts} <= {ref} THEN ln(CASE WHEN {value} = 0 THEN 0.1 ELSE {value} END) END) AS lmu,
               stddev_pop(CASE WHEN {ts} <= {ref}
                               THEN ln(CASE WHEN {value} = 0 THEN 0.1 ELSE {value} END) END) AS lsd"""
    return f"""
        SELECT occupant_id, min({ts}) AS t0, least(max({ts}), {ref}) AS t1,
               count(*) FILTER (WHERE {ts} <= {ref}) AS nrec{extra}
        FROM {table} WHERE occupant_id IS NOT NULL
        GROUP BY occupant_id HAVING count(*) FILTER (WHERE {ts} <= {ref}) > 0"""


def _segments(s: str) -> dict[str, str]:
    month = "INTERVAL 1 MONTH"
    tail = f"""
        SELECT occupant_id, segment, lo, hi, label, n_cut_prior FROM (
            SELECT p.occupant_id,
                   count(*) FILTER (WHERE r.cutoff_at > p.t0 AND r.cutoff_at <= p.t1 + {month}) AS segment,
                   coalesce(max(r.cutoff_at) FILTER (WHERE r.cutoff_at > p.t0
                            AND r.cutoff_at <= p.t1 + {month}) + {month}, any_value(p.t0)) AS lo,
                   any_value(p.t1 + {month}) AS hi,
                   CASE WHEN count(*) FILTER (WHERE r.cutoff_at > p.t1 + {month}) > 0
                        THEN 1 ELSE 0 END AS label,
                   count(*) FILTER (WHERE r.cutoff_at <= p.t1 + {month}) AS n_cut_prior
            FROM {s}_prof p JOIN ranked r USING (occupant_id) GROUP BY p.occupant_id)
        WHERE lo < hi"""
    return {
        f"{s}_valid": f"""
            SELECT r.occupant_id, r.cutoff_at, r.rnk, p.t0,
                   row_number() OVER (PARTITION BY occupant_id ORDER BY rnk) - 1 AS segment,
                   lag(r.cutoff_at) OVER (PARTITION BY occupant_id ORDER BY rnk) AS prev
            FROM ranked r JOIN {s}_prof p USING (occupant_id)
            WHERE r.cutoff_at > p.t0 AND r.cutoff_at <= p.t1 + {month}""",
        f"{s}_tailall": tail,
        f"{s}_seg": f"""
            SELECT occupant_id, segment, coalesce(prev + {month}, t0) AS lo, cutoff_at AS hi,
                   2 AS label, rnk AS n_cut_prior FROM {s}_valid
            UNION ALL SELECT * FROM {s}_tailall WHERE label = 1
            UNION ALL SELECT occupant_id, 0, t0, t1, 0, 0 FROM {s}_prof
                      WHERE occupant_id NOT IN (SELECT occupant_id FROM cutoffs_k)""",
    }


_Z = """CASE WHEN p.nrec > 2 AND p.sd > 0 THEN (r.volume_kgals - p.mu) / p.sd ELSE 0 END AS za,
               CASE WHEN p.nrec > 2 AND p.lsd > 0 THEN (r.vol_log - p.lmu) / p.lsd ELSE 0 END AS zl,
               CASE WHEN p.nrec > 24 AND p.sd > 0
                    THEN coalesce((r.volume_kgals - p.mu) / p.sd, 0) ELSE 0 END AS zm,
               CASE WHEN p.nrec > 24 AND p.lsd > 0
                    THEN coalesce((r.vol_log - p.lmu) / p.lsd, 0) ELSE 0 END AS zml"""

_WINDOW_STATS = ["avg(volume_kgals) AS mean_vol",
                 "count(*) FILTER (WHERE volume_kgals = 0) / any_value(n) AS f_zero_vol",
                 """CASE WHEN count(volume_kgals) < count(*) THEN NULL
                         WHEN min(volume_kgals) = max(volume_kgals) THEN 0
                         ELSE abs(avg(power(volume_kgals - wm, 3))
                                  / power(avg(power(volume_kgals - wm, 2)), 1.5)) END AS skew_vol"""]
for _kind, _denominator, _cols in (("anom", "za", ("za", "zl")), ("manom", "zm", ("zm", "zml"))):
    for _col, _name in zip(_cols, ("vol", "vol_log")):
        for _k in (3, 4, 5):
            _WINDOW_STATS.append(
                f"count(*) FILTER (WHERE abs({_col}) > {_k}) / nullif(count({_denominator}), 0)"
                f" AS f_{_kind}{_k}_{_name}"
            )
        _WINDOW_STATS.append(f"max(abs({_col})) AS max_{_kind}_{_name}")
_CHARGE_STATS = ("avg(late) AS f_late, avg(total_charge) AS mean_charge_tot, "
                 "avg(late_charge) AS mean_charge_late")

CTES |= {
    "ranked": f"""
        SELECT occupant_id, id, cutoff_at,
               row_number() OVER (PARTITION BY occupant_id ORDER BY cutoff_at, id) - 1 AS rnk
        FROM cutoffs_k WHERE cutoff_at <= {TRAIN}""",
    "volume_g": "SELECT *, ln(CASE WHEN volume_kgals = 0 THEN 0.1 ELSE volume_kgals END) AS vol_log FROM volume_c",
    "c_prof": _profile("charge_c", "billing_period_end", TRAIN, None),
    "v_prof": _profile("volume_c", "meter_read_at", TRAIN, "volume_kgals"),
    **_segments("c"),
    **_segments("v"),
    "v_z": f"""
        SELECT r.*, {_Z} FROM volume_g r JOIN v_prof p USING (occupant_id)
        WHERE r.meter_read_at <= {TRAIN}""",
    "c_rec": f"""
        SELECT r.*, s.segment, s.label, s.n_cut_prior,
               row_number() OVER (PARTITION BY r.occupant_id, s.segment
                                  ORDER BY billing_period_end DESC, charge_id DESC) - 1 AS k
        FROM charge_c r JOIN c_seg s ON s.occupant_id = r.occupant_id
             AND r.billing_period_end BETWEEN s.lo AND s.hi
        WHERE r.billing_period_end <= {TRAIN}""",
    "v_rec": """
        SELECT r.*, s.segment,
               row_number() OVER (PARTITION BY r.occupant_id, s.segment
                                  ORDER BY meter_read_at DESC, charge_id DESC) - 1 AS k
        FROM v_z r JOIN v_seg s ON s.occupant_id = r.occupant_id
             AND r.meter_read_at BETWEEN s.lo AND s.hi""",
    "c_num": "SELECT c_rec.*, n, k // n AS win FROM c_rec CROSS JOIN lens",
    "v_num": """
        SELECT *, avg(volume_kgals) OVER (PARTITION BY occupant_id, segment, win, n) AS wm
        FROM (SELECT v_rec.*, n, k // n AS win FROM v_rec CROSS JOIN lens)""",
    "c_stat": f"""
        SELECT occupant_id, segment, win, n, {_CHARGE_STATS}, any_value(label) AS seg_label,
               any_value(n_cut_prior) AS n_cut_prior, min(billing_period_end) AS c_from,
               max(billing_period_end) AS c_to
        FROM c_num GROUP BY occupant_id, segment, win, n HAVING count(*) = n""",
    "v_stat": f"""
        SELECT occupant_id, segment, win, n, {', '.join(_WINDOW_STATS)},
               min(meter_read_at) AS v_from, max(meter_read_at) AS v_to,
               count(*) AS n_records, count(za) AS n_anom, count(zm) AS n_manom
        FROM v_num GROUP BY occupant_id, segment, win, n HAVING count(*) = n""",
    "win_t": """
        SELECT c.*, v.* EXCLUDE (occupant_id, segment, win, n),
               CASE WHEN win = 0 OR seg_label = 0 THEN seg_label ELSE 1 END AS label
        FROM c_stat c JOIN v_stat v USING (occupant_id, segment, win, n)""",
    "occ_first": """
        SELECT * EXCLUDE (k) FROM (
            SELECT *, row_number() OVER (PARTITION BY occupant_id
                                         ORDER BY move_in_date, move_out_date, location_id) AS k
            FROM occ_c) WHERE k = 1""",
    "custs": """
        SELECT o.occupant_id, o.location_id, o.move_in_date, o.move_out_date,
               CASE WHEN o.occupant_id IN (SELECT occupant_id FROM cutoffs_k) THEN 1 ELSE 0 END AS cutoff,
               CASE WHEN l.location_id IS NULL THEN 0.0 ELSE l.latitude END AS latitude,
               CASE WHEN l.location_id IS NULL THEN 0.0 ELSE l.longitude END AS longitude,
               CASE WHEN l.location_id IS NULL THEN 'unknown' ELSE l.meter_address END AS meter_address,
               CASE WHEN l.location_id IS NULL THEN -1 ELSE l.municipality END AS municipality,
               CASE WHEN d.meter_id IS NULL THEN 'unknown' ELSE d.cust_type END AS cust_type,
               CASE WHEN d.meter_id IS NULL THEN -1 ELSE d.cust_type_code END AS cust_type_code,
               CASE WHEN d.meter_id IS NULL THEN -1.0 ELSE d.meter_size END AS meter_size
        FROM occ_first o
        LEFT JOIN location_c l ON l.location_id = o.location_id
        LEFT JOIN (SELECT location_id, min(meter_id) AS meter_id FROM meter GROUP BY location_id) m
               ON m.location_id = o.location_id
        LEFT JOIN meter d ON d.meter_id = m.meter_id""",
}

_IDS = """c.occupant_id, c.location_id, c.latitude, c.longitude, c.meter_address, c.municipality,
               c.cust_type, c.cust_type_code, c.meter_size"""
CTES |= {
    "feat_t": f"""
        SELECT w.n AS n_samples, {_IDS}, w.segment, w.win AS "window", w.label,
               CASE WHEN w.label = 2 THEN 1 ELSE 0 END AS cutoff_strict, c.cutoff,
               w.n_cut_prior AS "nCutPrior", CASE WHEN w.n_cut_prior > 0 THEN 1 ELSE 0 END AS cut_prior,
               {', '.join('w.' + s for s in STATS)}
        FROM win_t w JOIN custs c USING (occupant_id) WHERE c.move_in_date <= {TRAIN}""",
    # prediction: the latest records up to the reference date
    "cp_prof": _profile("charge_c", "billing_period_end", PREDICT, None),
    "vp_prof": _profile("volume_c", "meter_read_at", PREDICT, "volume_kgals"),
    "vp_z": f"""
        SELECT r.*, {_Z} FROM volume_g r JOIN vp_prof p USING (occupant_id)
        WHERE r.meter_read_at <= {PREDICT}""",
    "cp_num": f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY occupant_id
                              ORDER BY billing_period_end DESC, charge_id DESC) AS k FROM charge_c
                       WHERE occupant_id IS NOT NULL AND billing_period_end <= {PREDICT})
             CROSS JOIN lens WHERE k <= n""",
    "vp_num": """
        SELECT *, avg(volume_kgals) OVER (PARTITION BY occupant_id, n) AS wm
        FROM (SELECT *, row_number() OVER (PARTITION BY occupant_id
                              ORDER BY meter_read_at DESC, charge_id DESC) AS k FROM vp_z)
             CROSS JOIN lens WHERE k <= n""",
    "cp_stat": f"""SELECT occupant_id, n, {_CHARGE_STATS} FROM cp_num
                   GROUP BY occupant_id, n HAVING count(*) = n""",
    "vp_stat": f"""SELECT occupant_id, n, {', '.join(_WINDOW_STATS)} FROM vp_num
                   GROUP BY occupant_id, n HAVING count(*) = n""",
    "ahead": f"""
        SELECT occupant_id, n, CASE WHEN months <= n THEN 2 ELSE 1 END AS label, months
        FROM (SELECT occupant_id, CAST(round_even(
                         (epoch(min(cutoff_at)) - epoch({PREDICT})) / 86400.0::DOUBLE / 30.436875::DOUBLE,
                         0) AS INTEGER) AS months
              FROM cutoffs_k WHERE cutoff_at > {PREDICT} GROUP BY occupant_id) CROSS JOIN lens""",
    "priors": f"""SELECT occupant_id, count(*) FILTER (WHERE cutoff_at <= {PREDICT}) AS n_prior
                  FROM cutoffs_k GROUP BY occupant_id""",
    "feat_p": f"""
        SELECT b.n AS n_samples, {_IDS}, 0 AS segment, 0 AS "window", coalesce(a.label, 0) AS label,
               CASE WHEN a.label = 2 THEN 1 ELSE 0 END AS cutoff_strict, c.cutoff,
               coalesce(p.n_prior, 0) AS "nCutPrior",
               CASE WHEN p.n_prior > 0 THEN 1 ELSE 0 END AS cut_prior,
               {', '.join(('x.' if s in CHARGE_STATS else 'y.') + s for s in STATS)}
        FROM (SELECT occupant_id, n FROM cp_prof JOIN vp_prof USING (occupant_id) CROSS JOIN lens) b
        JOIN custs c USING (occupant_id)
        LEFT JOIN cp_stat x ON x.occupant_id = b.occupant_id AND x.n = b.n
        LEFT JOIN vp_stat y ON y.occupant_id = b.occupant_id AND y.n = b.n
        LEFT JOIN ahead a ON a.occupant_id = b.occupant_id AND a.n = b.n
        LEFT JOIN priors p ON p.occupant_id = b.occupant_id
        WHERE c.move_out_date >= {PREDICT}""",
    "feat_pz": f"""SELECT * REPLACE ({', '.join(f'coalesce({s}, 0) AS {s}' for s in IMPUTED_STATS)})
                   FROM feat_p""",
}

CTES |= {
    "phased": f"""
        SELECT g.*, p.nrec, (row_number() OVER (PARTITION BY g.occupant_id
                                                ORDER BY meter_read_at, charge_id) - 1) % 12 AS phase
        FROM volume_g g JOIN v_prof p USING (occupant_id) WHERE meter_read_at <= {TRAIN}""",
    "phase_spread": """
        SELECT occupant_id, phase, avg(volume_kgals) AS mu, stddev_pop(volume_kgals) AS sd,
               avg(vol_log) AS lmu, stddev_pop(vol_log) AS lsd FROM phased GROUP BY occupant_id, phase""",
    # anomalies of readings whose gaps are still open
    "holed_z": f"""
        SELECT r.charge_id, r.occupant_id, r.meter_read_at,
               CASE WHEN p.nrec > 2 AND p.sd > 0 THEN (r.volume_kgals - p.mu) / p.sd ELSE 0 END AS za
        FROM volume_o r JOIN (
            SELECT occupant_id, count(*) AS nrec, stddev_pop(volume_kgals) AS sd, avg(volume_kgals) AS mu
            FROM volume_o WHERE occupant_id IS NOT NULL AND meter_read_at <= {TRAIN}
            GROUP BY occupant_id) p USING (occupant_id)
        WHERE r.meter_read_at <= {TRAIN}""",
    "holed_num": """
        SELECT z.*, s.segment, (row_number() OVER (PARTITION BY z.occupant_id, s.segment
                                ORDER BY meter_read_at DESC, charge_id DESC) - 1) // 6 AS win
        FROM holed_z z JOIN v_seg s ON s.occupant_id = z.occupant_id
             AND z.meter_read_at BETWEEN s.lo AND s.hi""",
}

# -- missing statistics: holes are punched by arithmetic so that there is something to fill --
_HOLES = ", ".join(
    f"CASE WHEN (location_id * 7 + segment * 5 + \"window\" * 3 + {i}) % 37 = 0"
    f" THEN CAST(NULL AS DOUBLE) ELSE {s} END AS {s}"
    for i, s in enumerate(IMPUTED_STATS, 1) if i % 4 == 1
)


def _filled(source: str, label: str) -> dict[str, str]:
    values = ", ".join(f"({i}, {s})" for i, s in enumerate(IMPUTED_STATS, 1))
    drawn = ", ".join(
        f"coalesce((SELECT d.v FROM {source}_draw d WHERE d.occupant_id = f.occupant_id"
        f" AND d.n_samples = f.n_samples AND d.c = {i}), {s}) AS {s}"
        for i, s in enumerate(IMPUTED_STATS, 1)
    )
    missing = " OR ".join(f"{s} IS NULL" for s in IMPUTED_STATS)
    return {
        f"{source}_cells": f"""
            SELECT f.n_samples, f.occupant_id, f.location_id, f.segment, f."window", x.c, x.v
            FROM {source} f, LATERAL (VALUES {values}) x(c, v) WHERE f.{label} = 1""",
        f"{source}_donors": f"""
            SELECT n_samples, c, v,
                   row_number() OVER (PARTITION BY n_samples, c ORDER BY
                       md5(occupant_id || '|' || segment || '|' || "window")) - 1 AS number,
                   count(*) OVER (PARTITION BY n_samples, c) AS donors
            FROM {source}_cells WHERE v IS NOT NULL""",
        f"{source}_draw": f"""
            SELECT r.n_samples, r.occupant_id, r.c, d.v
            FROM (SELECT DISTINCT n_samples, occupant_id, location_id, c FROM {source}_cells
                  WHERE v IS NULL) r
            JOIN {source}_donors d ON d.n_samples = r.n_samples AND d.c = r.c
                 AND d.number = (r.location_id * 7919 + r.c) % d.donors""",
        f"{source}_imp": f"SELECT * REPLACE ({drawn}) FROM {source} f",
        f"{source}_fin": f"""
            SELECT * FROM {source}_imp f WHERE NOT EXISTS (
                SELECT 1 FROM {source}_imp b WHERE b.occupant_id = f.occupant_id
                AND b.n_samples = f.n_samples AND b.{label} = 0 AND ({missing}))""",
    }


CTES |= {
    "holed": f"SELECT * REPLACE ({_HOLES}) FROM feat_t",
    **_filled("holed", "cutoff_strict"),
    "holed_loose": "SELECT * FROM holed",
    **_filled("holed_loose", "cutoff"),
    **_filled("feat_t", "cutoff_strict"),
}

# -- model data and scores --------------------------------------------------------------------
_XB = " + ".join(
    f"CAST({w} AS DOUBLE)" if c == "intercept" else f"CAST({w} AS DOUBLE) * {c}"
    for c, w in LOGIT.items()
)
# a missing input counts as the mean of the training rows for n = 6
_XB_FILLED = " + ".join(
    f"CAST({w} AS DOUBLE)" if c == "intercept"
    else f"CAST({w} AS DOUBLE) * coalesce({c}, (SELECT avg({c}) FROM feat_t WHERE n_samples = 6))"
    for c, w in LOGIT.items()
)
_PREFIX = "md5(occupant_id || '|' || segment || '|' || \"window\")"
CTES |= {
    "strata": f"""
        SELECT *, CASE WHEN cutoff_strict = 0 THEN 'nocut'
                       WHEN segment = max(CASE WHEN cutoff_strict = 1 THEN segment END)
                            OVER (PARTITION BY occupant_id) THEN 'cut0' ELSE 'cut1' END AS stratum,
               {_PREFIX} AS digest
        FROM feat_t""",
    "split": """
        SELECT *, CASE WHEN cnt > 1 AND rk <= ceil(CAST(0.2 AS DOUBLE) * cnt)
                       THEN 'test' ELSE 'train' END AS subset
        FROM (SELECT *, count(*) OVER (PARTITION BY stratum) AS cnt,
                     row_number() OVER (PARTITION BY stratum ORDER BY digest) AS rk FROM strata)""",
    "scored_t": f"SELECT *, 1 / (1 + exp(-({_XB}))) AS p_cutoff FROM feat_t",
    "scored_p": f"SELECT *, 1 / (1 + exp(-({_XB_FILLED}))) AS p_cutoff FROM feat_pz WHERE n_samples = 36",
    "risk_all": """
        SELECT occupant_id, location_id, latitude, longitude, meter_address, municipality, cust_type,
               meter_size, "nCutPrior", mean_charge_tot, mean_charge_late, mean_vol,
               p_cutoff * 100 AS p_cutoff, f_late * 100 AS f_late, f_zero_vol * 100 AS f_zero_vol,
               f_anom3_vol * 100 AS f_anom3_vol, f_manom3_vol * 100 AS f_manom3_vol
        FROM scored_p""",
    "risk_one": """
        SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY location_id
                                         ORDER BY occupant_id) AS k FROM risk_all) WHERE k = 1""",
    "risk": """
        SELECT * REPLACE (list_extract(['1234 N MAIN ST, ANYTOWN, USA', '2345 N MAIN ST, ANYTOWN, USA',
                                        '3456 N MAIN ST, ANYTOWN, USA', '4567 N MAIN ST, ANYTOWN, USA'],
                                       CAST(location_id % 4 + 1 AS BIGINT)) AS meter_address)
        FROM risk_one""",
    "above": f"SELECT * FROM risk WHERE p_cutoff >= {THRESHOLD}",
}


def with_ctes(select: str, lens: tuple[int, ...] = (6,)) -> str:
    """The select with every table expression it needs, in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\b[a-z][a-z0-9_]*\b", text):
            if name in CTES and name not in needed:
                needed.add(name)
                visit(CTES[name])

    visit(select)
    parts = [
        f"{name} AS {'MATERIALIZED ' if name in STORED else ''}({CTES[name].replace('{LENS}', ', '.join(map(str, lens)))})"
        for name in CTES if name in needed
    ]
    if parts and select.lstrip().startswith("WITH"):
        select = f"SELECT * FROM ({select})"
    return f"WITH {', '.join(parts)}\n{select}" if parts else select


def r6(*columns: str) -> str:
    """Rounded columns under their own names."""
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


FEATURE_SELECT = ", ".join(
    f"round({c}, 6) AS {c}" if c in STATS or c in ("latitude", "longitude", "meter_size")
    else f'"{c}"' for c in FEATURE_COLUMNS
)
