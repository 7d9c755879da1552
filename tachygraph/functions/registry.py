"""The 38 features by name and position."""

from __future__ import annotations

#: The features' names in their order.
FEATURES = (
    "avg", "sd", "rmssd", "rmssd_dt", "skew", "kurt", "pnnx", "nnx", "triangular_index", "quantile_25", "quantile_50", "quantile_75", "variance",
    "csi", "csim", "cvi", "sd1", "sd2", "csi_slope", "csim_slope", "csi_filtered", "csim_filtered", "csi_filtered_slope", "csim_filtered_slope",
    "hr_diff", "hr_diff_slope", "hr_diff_filtered", "hr_diff_filtered_slope",
    "ulf", "vlf", "lf", "hf", "lf_hf_ratio", "total_power",
    "mf_hurst_max", "mf_coef_left", "mf_coef_center", "mf_coef_right",
)
FEATURES_30 = FEATURES[:13]
FEATURES_60 = FEATURES[13:28]
SPECTRAL = FEATURES[28:34]
FRACTAL = FEATURES[34:]

#: A feature's name by its position, and its position by its name; what is not there is a KeyError.
NAMES = dict(enumerate(FEATURES))
POSITIONS = {name: position for position, name in NAMES.items()}
