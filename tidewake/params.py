"""Tunables of the engine. Every plan takes a ``Params``; nothing reads globals."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Fixed values of the matching semantics.
    kn_to_ms: float = 0.514444
    min_sog_kn: float = 0.5
    candidate_pad_m: float = 30_000.0
    probe_radius_m: float = 4_000.0
    probe_separation_m: float = 600.0
    probe_target: int = 750
    large_type_min: int = 60
    large_type_max: int = 89
    recall_radius_m: float = 500.0
    underway_sog_kn: float = 1.0
    fix_max_age_s: int = 1_800
    match_radius_m: float = 200.0
    azimuth_shift_s: float = 90.0
    course_error: float = 0.25
    max_chance_rate: float = 0.10
    fusion_window_h: float = 2.0
    active_window_min: int = 240
    retention_days: int = 5
    stale_after_s: int = 60
    warmup_h: float = 6.0
    warmup_cap_h: float = 8.0
    gap_min: float = 60.0
    pu_ceiling: float = 25_000.0
    pu_budget: float = 30_000.0
    search_days: int = 7
    min_coverage: float = 0.85
    min_scene_age_h: float = 3.0
    mosaic_back_s: int = 60
    mosaic_forward_s: int = 600
    pass_gap_s: int = 1_200
    tile_px: int = 800
    tile_overlap_px: int = 160
    iou_threshold: float = 0.5
    min_separation_m: float = 150.0
    pixel_m: float = 10.0
    max_fetch_px: int = 2_400
    db_min: float = -25.0
    db_max: float = 0.0
    bucket_high: float = 0.6
    bucket_medium: float = 0.25
    conf_threshold: float = 0.1
    land_buffer_m: float = 1.0
    probe_land_clearance_m: float = 300.0
    #: Side of the grid cells of distance joins, in degrees.
    cell_deg: float = 0.05


DEFAULT = Params()
