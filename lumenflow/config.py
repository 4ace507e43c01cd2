"""Option records of the pipelines. The defaults are those that published results rest on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class FlowNetwork:
    label: int = 2
    default_radius_mm: float = 1.0
    gap_mm: float = 15.0
    alpha: float = 10.0
    gap_mode: str = "mst"
    p_in_mmhg: float = 100.0
    p_out_mmhg: float = 5.0
    viscosity: float = 3.5e-3
    radius_floor_mm: float = 0.1


@dataclass(frozen=True)
class GapFilling:
    gap_mm: float = 8.0
    step: float = 0.5
    blend: float = 0.6
    weights: tuple[float, float, float] = (0.40, 0.35, 0.25)
    hu_centre: float = 250.0
    auto: float = 0.65
    review: float = 0.35
    facing: float = -0.4
    converge: float = 2.0
    island_voxels: int = 50


@dataclass(frozen=True)
class Completion:
    threshold: float = 0.44
    island_voxels: int = 10
    scales: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0)
    gap_mm: float = 10.0
    weights: tuple[float, ...] = (0.35, 0.30, 0.20, 0.15)
    radius_floor: float = 2.0
    auto: float = 0.50
    review: float = 0.25
    converge: float = 2.5


@dataclass(frozen=True)
class Landmarks:
    scales: tuple[float, float, float] = (1.0, 6.0, 0.5)
    threshold: float = 0.015
    cluster_mm: float = 3.0
    top_n: int = 25
    radius_mm: float = 8.0
    patch: int = 5
    least_similarity: float = 0.25
    high_similarity: float = 0.6


@dataclass(frozen=True)
class BandSearch:
    grid: int = 60
    fine: int = 50
    bins: int = 2000
    sweep: int = 60
