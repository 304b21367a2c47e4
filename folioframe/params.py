"""Limits that the operators share; every one can be given another value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    min_confidence: float = 0.15
    near_horizontal: float = 5.0
    cell_min_w: int = 20
    cell_max_w: int = 1200
    cell_min_h: int = 20
    cell_max_h: int = 400
    component_min_area: int = 200
    component_max_share: float = 0.85
    component_max_aspect: int = 40
    white_level: int = 180
    white_share: float = 0.65
    rectangularity: float = 0.55
    assign_share: float = 0.5
    near_share: float = 0.3
    near_distance: int = 50
    neighbour_align: int = 8
    neighbour_gap: int = 10
    crossing_window: int = 100
    min_crossings: int = 2
    side_tolerances: tuple[int, int] = (5, 9)
    bounding_reach: tuple[int, int] = (30, 120)
    corner_level: int = 128
    hough_votes: int = 20
    hough_length: int = 15
    hough_gap: int = 15
    least_cells: int = 3
    dedup_iou: float = 0.45
    dedup_ratio: float = 0.68
    batch_size: int = 40
    tile: int = 2200
    tile_overlap: int = 220
    min_gap: int = 80
    keep_days: int = 7


DEFAULT = Params()
