"""Windows, bins, tables and defaults that results depend on."""

# Radii, the mainshock rule and the spans of observation and target.
EARTH_RADIUS_KM = 6371.0
MERCATOR_RADIUS_M = 6378137.0

MAINSHOCK_MIN_MAG = 6.0
MAINSHOCK_MAX_DEPTH_KM = 70.0
AFTERSHOCK_RADIUS_KM = 100.0
OBSERVATION_DAYS = 3.0
TARGET_DAYS = 30.0

# Forecast windows in hours after the mainshock, (lower, upper].
WINDOWS = {"T1": (0.0, 24.0), "T2": (24.0, 72.0), "T3": (72.0, 168.0)}
# The single horizon, all bounds, and the hours a window may observe.
SINGLE_HORIZON = ("H168", 0.0, 168.0)
WINDOW_BOUNDS = {"T1": (0.0, 24.0), "T2": (24.0, 72.0), "T3": (72.0, 168.0), "H168": (0.0, 168.0)}
OBSERVED_HOURS = {"T1": 0, "T2": 24, "T3": 72, "H168": 0}

# Four time buckets per window in hours, (lower, upper].
TIME_BUCKETS = {
    "T1": ((0.0, 3.0), (3.0, 6.0), (6.0, 12.0), (12.0, 24.0)),
    "T2": ((24.0, 36.0), (36.0, 48.0), (48.0, 60.0), (60.0, 72.0)),
    "T3": ((72.0, 96.0), (96.0, 120.0), (120.0, 144.0), (144.0, 168.0)),
    "H168": ((0.0, 12.0), (12.0, 48.0), (48.0, 96.0), (96.0, 168.0)),
}

# Magnitude drop of the rule forecast per window.
RULE_DROP = {"T1": 1.15, "T2": 1.35, "T3": 1.55}
# Fixed value.
RULE_DROP_OTHER = 1.35

# Gardner & Knopoff (1974) windows: (mag from, mag to, days, km).
GK_WINDOWS = (
    (2.0, 2.5, 6.0, 30.0),
    (2.5, 3.0, 11.5, 30.0),
    (3.0, 3.5, 22.0, 40.0),
    (3.5, 4.0, 42.0, 50.0),
    (4.0, 4.5, 83.0, 60.0),
    (4.5, 5.0, 155.0, 70.0),
    (5.0, 5.5, 290.0, 80.0),
    (5.5, 6.0, 510.0, 90.0),
    (6.0, 6.5, 790.0, 100.0),
    (6.5, 7.0, 915.0, 110.0),
    (7.0, 7.5, 960.0, 120.0),
    (7.5, 8.0, 985.0, 130.0),
    (8.0, 99.0, 1000.0, 140.0),
)
# Window of other magnitudes.
GK_OTHER = (1000.0, 140.0)

# Hours of the cumulative counts.
BIN_HOURS = (1, 6, 12, 24, 72)

# Boundary classes with their own indicator column.
PLATE_TYPES = ("SUB", "OTF", "OSR", "UNK")

# Focal-mechanism columns copied from the matched catalog row.
FOCAL_NUMERIC = (
    "strike1", "dip1", "rake1", "strike2", "dip2", "rake2",
    "plunge_P", "trend_P", "plunge_T", "trend_T", "f_clvd",
)

# Columns that any window may use.
META_COLUMNS = (
    "mainshock_id", "mainshock_time", "mainshock_lat", "mainshock_lon", "mainshock_mag",
    "mainshock_depth", "has_target_aftershock", "target_max_mag", "target_time_to_max_days",
)
# Columns known at the mainshock.
STATIC_COLUMNS = (
    "mainshock_mag", "mainshock_depth", "plate_boundary_distance_km", *FOCAL_NUMERIC,
    "gcmt_time_diff_seconds", "gcmt_distance_km", "focal_mechanism_valid",
)
STATIC_PREFIXES = ("plate_type_", "fault_type_")
# Prefixes of columns that need the full 72 h of observation.
OBSERVATION_PREFIXES = (
    "early_", "gr_", "omori_", "anisotropy_", "count_", "energy_", "etas_", "bath_",
    "productivity_", "mag_ratio_", "mag_diff_", "energy_per_", "log_energy_", "count_ratio_",
    "energy_ratio_", "omori_p_", "omori_decay_", "etas_p_", "aniso_", "plate_dist_", "log_plate_",
    "b_value_", "log_depth", "depth_mag_", "productivity_per_", "decay_count_", "decay_energy_",
)
WINDOW_TARGETS = tuple(
    name for w in WINDOWS for name in (f"target_{w}_max_mag", f"target_{w}_time_to_max_hours")
)
WINDOW_FLAGS = tuple(f"has_{w}_aftershock" for w in WINDOWS)

# Fill values for missing features (global seismology priors).
FEATURE_DEFAULTS = {
    "gr_b_value": 1.0, "gr_a_value": 5.0, "gr_mc": 4.0, "gr_n": 5, "gr_valid": 0,
    "omori_p": 1.0, "omori_c": 0.05, "omori_k": 1.0, "omori_nll": 10.0, "omori_n": 8,
    "omori_p_boundary_hit": 0, "omori_valid": 0,
    "etas_mu": 0.01, "etas_K0": 0.001, "etas_alpha": 1.0, "etas_c": 0.05, "etas_p": 1.0,
    "etas_nll": 10.0, "etas_n": 8, "etas_valid": 0, "etas_branching_ratio": 0.3,
    "etas_expected_count": 8.0, "etas_triggered_fraction": 0.3, "etas_triggered_mag_sum": 12.0,
    "etas_bg_rate_total": 3.0,
    "anisotropy_major_axis_km": 50.0, "anisotropy_minor_axis_km": 25.0,
    "anisotropy_axis_ratio": 2.0, "anisotropy_azimuth_deg": 90.0, "anisotropy_n": 3,
    "anisotropy_valid": 0,
    "bath_deficit": 1.2, "bath_early_max_mag": 0.0, "bath_valid": 0,
    "productivity_index": 0.0, "focal_mechanism_valid": 0,
    "strike1": 0.0, "dip1": 45.0, "rake1": 0.0, "strike2": 0.0, "dip2": 45.0, "rake2": 0.0,
    "plunge_P": 0.0, "trend_P": 0.0, "plunge_T": 0.0, "trend_T": 0.0, "f_clvd": 0.0,
    "gcmt_time_diff_seconds": 86400.0, "gcmt_distance_km": 100.0,
    "early_aftershock_count": 0, "early_max_mag": 0.0, "early_mean_mag": 0.0, "early_energy_sum": 0.0,
    "count_1h": 0, "energy_1h": 0.0, "count_6h": 0, "energy_6h": 0.0, "count_12h": 0,
    "energy_12h": 0.0, "count_24h": 0, "energy_24h": 0.0, "count_72h": 0, "energy_72h": 0.0,
    "advanced_early_event_count": 0,
}
# Fill values that depend on the nearest boundary.
FEATURE_DEFAULTS_BY_PLATE = {
    "SUB": {
        "gr_b_value": 0.8, "omori_p": 1.2, "omori_k": 2.0, "etas_mu": 0.02, "etas_K0": 0.005,
        "etas_expected_count": 12.0, "etas_bg_rate_total": 5.0, "anisotropy_major_axis_km": 70.0,
        "anisotropy_minor_axis_km": 40.0, "anisotropy_axis_ratio": 2.5, "productivity_index": 1.0,
    },
    "OSR": {
        "gr_b_value": 1.1, "omori_p": 1.0, "etas_expected_count": 8.0,
        "anisotropy_major_axis_km": 40.0, "anisotropy_minor_axis_km": 20.0,
        "anisotropy_axis_ratio": 2.0,
    },
    "OTF": {
        "gr_b_value": 1.0, "omori_p": 1.0, "etas_expected_count": 8.0,
        "anisotropy_major_axis_km": 45.0, "anisotropy_minor_axis_km": 25.0,
        "anisotropy_axis_ratio": 2.2,
    },
    "UNK": {
        "gr_b_value": 1.0, "omori_p": 0.9, "omori_k": 0.5, "etas_mu": 0.005, "etas_K0": 0.0005,
        "etas_expected_count": 5.0, "etas_bg_rate_total": 1.5, "anisotropy_major_axis_km": 30.0,
        "anisotropy_minor_axis_km": 15.0, "anisotropy_axis_ratio": 1.8, "productivity_index": -0.5,
    },
}
