"""The threshold set and fixed codes of the evidence archive. Values are settings, given in the order of their groups."""

from __future__ import annotations

from dataclasses import dataclass


# The threshold set T-2026.09-01, by its groups and keys, and a few limits that stand in the rules.
@dataclass(frozen=True)
class Thresholds:
    id: str = "T-2026.09-01"
    # quality
    cloud_dilate_px: int = 3
    shadow_dilate_px: int = 2
    shadow_heights_m: tuple[int, ...] = (500, 1000, 1500, 2000, 3000)
    shadow_dark_nir: float = 0.16
    haze_hot_mad_k: float = 4.0
    haze_min_hot: float = 0.02
    haze_least_clear: int = 500
    snow_ndsi: float = 0.4
    snow_min_green: float = 0.3
    saturation_dn: int = 65535
    terrain_min_cos_i: float = 0.15
    terrain_min_slope: float = 10.0
    object_min_usable: float = 0.8
    obs_min_usable_fraction: float = 0.05
    reference_min_usable: float = 0.6
    # registration
    max_correctable_px: float = 2.0
    min_correct_px: float = 0.1
    residual_edge_suppress_px: float = 0.5
    min_peak_ratio: float = 3.0
    edge_band_px: int = 1
    sliver_max_width_px: float = 1.5
    sliver_edge_share: float = 0.6
    # radiometry
    max_norm_rmse: float = 0.04
    gain_range: tuple[float, float] = (0.8, 1.25)
    invariant_cap: int = 1500
    invariant_least: int = 200
    probe_offset_dn: int = 950
    # season
    peer_radius_m: int = 5000
    peer_min_pixels: int = 200
    min_abs_peer_z: float = 2.0
    green_season_months: tuple[int, ...] = (8, 9, 10, 11)
    same_season_window_days: int = 45
    jrc_seasonal_occurrence: tuple[int, int] = (5, 95)
    water_departure_min_fraction: float = 0.10
    # size
    mmu_px: int = 10
    mmu_water_px: int = 20
    road_elongation: float = 5.0
    # detection
    p_detect: float = 0.6
    stable_window: int = 4
    stable_min_obs: int = 3
    stable_agreement: float = 0.8
    object_post_share: float = 0.6
    object_pre_share: float = 0.6
    sample_per_class: int = 400
    # persistence
    provisional_confirming_obs: int = 1
    confirmed_confirming_obs: int = 2
    confirmed_min_span_days: int = 20
    insufficient_data_days: int = 60
    reverse_consecutive_contradicting: int = 2
    # temporal
    abrupt_sharpness: float = 0.7
    gradual_min_intermediate_obs: int = 3
    long_gap_days: int = 45
    # confidence
    level_low: float = 0.4
    level_high: float = 0.7
    # review
    audit_slice_fraction: float = 0.07
    uncertainty_slice_fraction: float = 0.05
    # retrieval
    background_sample: int = 5000
    fetch_k: int = 200
    exclusion_radius_m: int = 1500
    mmr_lambda: float = 0.7
    negative_lambda: float = 0.5
    near_default_m: int = 500


T = Thresholds()

# The bits of the quality mask.
NODATA, SATURATED, CLOUD, HAZE, SHADOW, SNOW, TERRAIN, EDGE = 1, 2, 4, 8, 16, 32, 64, 128

# Priorities of job kinds; other kinds have 100.
JOB_PRIORITY = {"ingest_scan": 10, "register_scene": 20, "process_scene": 40, "classify_observation": 50, "embed_observation": 60, "change_update": 90, "watchset_rerun": 95, "cluster": 120}

# The kinds of jobs that follow a finished one, with the name and the columns of their dedupe key.
JOB_AFTER = {
    "ingest_scan": [("process_scene", "process", ("scene_id", "aoi_id"))],
    "register_scene": [("process_scene", "process", ("scene_id", "aoi_id"))],
    "process_scene": [("classify_observation", "classify", ("observation_id",))],
    "classify_observation": [("embed_observation", "embed", ("observation_id",)), ("change_update", "change", ("aoi_id",))],
}

# The grid.
PIXEL_M, STRIDE_PX, TILE_PX = 10, 64, 128
STRIDE_M, TILE_M, MARGIN_M, BLOCK_M = 640, 1280, 320, 2560
TEST_SHARE = 0.3
GENESIS = "0" * 64
