"""Run configuration and the bit layout that follows from it."""

from __future__ import annotations

import math
from dataclasses import MISSING, dataclass, fields


@dataclass(frozen=True)
class PipelineConfig:
    """Named scalars of a run. The last five have defaults; the others must be given."""

    refraction_coefficient_k: float
    earth_radius_m: float
    observer_eye_height_m: float
    cell_per_degree: float
    meters_per_degree_lat: float
    azimuth_min_deg: float
    azimuth_max_deg: float
    azimuth_step_deg: float
    strip_height_deg: float
    coast_march_max_km: float
    worker_threads: int
    dem_lru_capacity: int
    ocean_lru_capacity: int
    dem_dir: str
    osm_water_polygons_path: str
    coast_obstruction_skip_m: float = 0.0
    sample_spacing_arcsec: float = 1 / 3
    strip_tilt_margin_deg: float | None = None
    west_edge_max_land_frac: float = 0.05
    osm_inland_water_path: str = ""

    @staticmethod
    def parse(text: str) -> PipelineConfig:
        """key = value lines; # starts a comment, lines without = are skipped, the last of equal keys counts."""
        found = {}
        for line in text.splitlines():
            key, eq, value = line.split("#")[0].partition("=")
            if eq:
                found[key.strip()] = value.strip()
        kinds, out = {"float": float, "int": int, "str": str, "float | None": float}, {}
        for f in fields(PipelineConfig):
            if f.name in found:
                out[f.name] = kinds[f.type](found[f.name])
            elif f.default is MISSING:
                raise KeyError(f"missing configuration key: {f.name}")
        return PipelineConfig(**out)

    @property
    def curvature(self) -> float:
        """Drop of the line of sight by squared distance; refraction of one half or more means a flat earth."""
        return max(0.0, (1 - 2 * self.refraction_coefficient_k) / (2 * self.earth_radius_m))

    @property
    def spacing_m(self) -> float:
        return self.sample_spacing_arcsec / 3600 * self.meters_per_degree_lat


@dataclass(frozen=True)
class BitLayout:
    """One bit for each azimuth, then a flag bit that marks land with data."""

    azimuth_min: float
    azimuth_max: float
    step: float

    @property
    def bit_count(self) -> int:
        return math.floor((self.azimuth_max - self.azimuth_min) / self.step + 0.5) + 1

    @property
    def flag_bit(self) -> int:
        return self.bit_count

    @property
    def bytes_per_pixel(self) -> int:
        return (self.bit_count + 8) // 8

    @property
    def words(self) -> int:
        """32-bit words that hold the bits: 64-bit ones would need the sign."""
        return self.bit_count // 32 + 1

    def bit_index(self, azimuth: float) -> int | None:
        i = math.floor((azimuth - self.azimuth_min) / self.step + 0.5)
        return i if 0 <= i < self.bit_count else None


PRODUCTION = BitLayout(233.0, 309.0, 1.0)
