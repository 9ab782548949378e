"""Grid, tile and map arithmetic as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from vespera.config import PipelineConfig


def tile_of(lat: Column, lon: Column) -> tuple[Column, Column]:
    """South and west of the one-degree tile that owns a point."""
    return F.floor(lat).cast("int"), F.floor(lon).cast("int")


def north_west_corner(south: Column, west: Column) -> tuple[Column, Column]:
    """Northern edge and degrees west of a tile, as elevation files are named after."""
    return south + 1, -west


def along_perp(lat: Column, lon: Column, lat0: float, lon0: float, azimuth: float, config: PipelineConfig) -> tuple[Column, Column]:
    """Metres along the march, which heads away from an azimuth, and across it."""
    b, phi = math.radians((azimuth + 180) % 360), math.radians(lat0)
    e = (lon - F.lit(lon0)) * F.lit(config.meters_per_degree_lat * math.cos(phi))
    n = (lat - F.lit(lat0)) * F.lit(config.meters_per_degree_lat)
    return e * F.lit(math.sin(b)) + n * F.lit(math.cos(b)), e * F.lit(math.cos(b)) - n * F.lit(math.sin(b))


def ray_of(perp: Column, spacing: Column) -> Column:
    """The ray nearest a pixel; halves go away from zero."""
    return F.round(perp / spacing).cast("long")


def sample_of(distance: Column, spacing: Column, last: Column) -> Column:
    """The sample nearest a pixel on its ray, clamped to the ray; null over one step before its start."""
    return F.when(distance >= -spacing, F.least(F.greatest(F.round(distance / spacing).cast("long"), F.lit(0).cast("long")), last))


def interior(row: Column, col: Column, height: Column, width: Column) -> Column:
    """Distance of a pixel to the nearest edge but the western one."""
    return F.least(row + 0.5, height - row - 0.5, width - col - 0.5)


def unit_x(lon: Column) -> Column:
    return (lon + 180) / 360


def unit_y(lat: Column) -> Column:
    s = F.sin(F.radians(lat))
    return F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)


def map_tile(unit: Column, zoom: int) -> Column:
    """Index of the map tile of a zoom that holds a unit coordinate."""
    return F.least(F.greatest(F.floor(unit * 2**zoom), F.lit(0)), F.lit(2**zoom - 1)).cast("int")


def sunset_azimuths(days: DataFrame, lon: float = -122.5) -> DataFrame:
    """days (day, lat, ...) with azimuth, the compass azimuth of the sunset, by the usual low-precision almanac; null where the sun does not set.

    Noon is taken at UTC-8. Each step is a column of its own: as one expression they would be written out again and again.
    """
    r = math.pi / 180
    tilt, j0, lw = r * 23.4397, 0.0009, -lon * r
    c = F.col

    def sun(out: DataFrame, at: str, to: str) -> DataFrame:
        """Anomaly, ecliptic longitude and declination at a time."""
        m, l = c(f"__m{to}"), c(f"__l{to}")  # noqa: E741
        out = out.withColumn(f"__m{to}", (c(at) * 0.98560028 + 357.5291) * r)
        out = out.withColumn(f"__l{to}", m + (F.sin(m) * 1.9148 + F.sin(m * 2) * 0.02 + F.sin(m * 3) * 0.0003) * r + (102.9372 * r + math.pi))
        return out.withColumn(f"__d{to}", F.asin(F.sin(l) * math.sin(tilt)))

    noon = F.datediff("day", F.lit("1970-01-01").cast("date")) + F.lit(20 / 24) + F.lit(2440587.5 - 2451545)
    out = days.withColumn("__phi", c("lat") * r).withColumn("__n", F.round(noon - j0 - lw / (2 * math.pi)))
    out = sun(out.withColumn("__t1", c("__n") + (j0 + lw / (2 * math.pi))), "__t1", "1")
    out = out.withColumn("__cosw", (F.lit(math.sin(-0.833 * r)) - F.sin("__phi") * F.sin("__d1")) / (F.cos("__phi") * F.cos("__d1")))
    w = F.when(c("__cosw").between(-1.0, 1.0), F.acos("__cosw"))
    out = out.withColumn("__t2", (w + lw) / (2 * math.pi) + c("__n") + j0 + F.sin("__m1") * 0.0053 - F.sin(c("__l1") * 2) * 0.0069)
    out = sun(out, "__t2", "2")
    ascension = F.atan2(F.sin("__l2") * math.cos(tilt), F.cos("__l2"))
    out = out.withColumn("__hour", (c("__t2") * 360.9856235 + 280.16) * r - lw - ascension)
    az = F.atan2(F.sin("__hour"), F.cos("__hour") * F.sin("__phi") - F.tan("__d2") * F.cos("__phi")) / r + 180
    return out.withColumn("azimuth", F.pmod(az, F.lit(360.0))).drop("__phi", "__n", "__t1", "__m1", "__l1", "__d1", "__cosw", "__t2", "__m2", "__l2", "__d2", "__hour")
