"""From boxes to masks: strips, rays, samples, lines of sight, and the pixels that inherit their verdicts.

Two tiers share the formulas. The relational one has a row for each sample, which suits checks and small
boxes. The vectorised one has a task row for each strip and azimuth and emits packed pixel rows, which
suits production grids of 10^10 verdicts: only masks are shuffled, never samples.

A strip is its own frame: its southern edge fixes the length of a degree of longitude, so the height of
strips is a parameter of the result and not of the partitioning. Sample positions are k * step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vespera.config import BitLayout, PipelineConfig
from vespera.operators.rasters import accumulate, flag_land
from vespera.operators.terrain import verdicts

RAY = ("box_idx", "strip", "az", "j")
PIXEL = ("box_idx", "strip", "row", "col")

#: lat, lon -> values, over arrays
Lookup = Callable[[np.ndarray, np.ndarray], np.ndarray]


def layout_of(config: PipelineConfig) -> BitLayout:
    return BitLayout(config.azimuth_min_deg, config.azimuth_max_deg, config.azimuth_step_deg)


def strips(boxes: DataFrame, config: PipelineConfig) -> DataFrame:
    """boxes (box_idx, north, west, south, east) cut from south to north; the last strip ends at the box's edge.

    Adds strip, min_lat, height and width in pixels, row_off (pixel rows of the box above the strip) and
    cos_phi. A box without a pixel is an error.
    """
    cpd, tall = F.lit(float(config.cell_per_degree)), F.lit(float(config.strip_height_deg))
    pixels = lambda extent: F.round(extent * cpd).cast("int")
    rows, width = pixels(F.col("north") - F.col("south")), pixels(F.col("east") - F.col("west"))
    out = boxes.withColumns({"rows": rows, "width": width})
    bad = (F.col("rows") < 1) | (F.col("width") < 1)
    out = out.withColumn("rows", F.when(bad, F.raise_error(F.lit("a box holds no pixel"))).otherwise(F.col("rows")))
    count = F.greatest(F.ceil((F.col("north") - F.col("south")) / tall - 1e-9).cast("int"), F.lit(1))
    out = out.withColumn("strip", F.explode(F.sequence(F.lit(0), count - 1)))
    out = out.withColumn("min_lat", F.col("south") + F.col("strip") * tall)
    top = F.least(F.col("min_lat") + tall, F.col("north"))
    out = out.withColumn("height", pixels(top - F.col("min_lat"))).filter("height > 0")
    above = F.col("rows") - pixels(F.col("min_lat") - F.col("south")) - F.col("height")
    return out.select("box_idx", "strip", "min_lat", "west", "height", "width", above.alias("row_off"), F.cos(F.radians("min_lat")).alias("cos_phi"))


def azimuths(config: PipelineConfig) -> list[tuple[int, float, float]]:
    """bit, sine and cosine of the march's bearing for every azimuth of the window: a fixed, small list."""
    layout = layout_of(config)
    out = []
    for i in range(layout.bit_count):
        b = math.radians((config.azimuth_min_deg + i * config.azimuth_step_deg + 180) % 360)
        out.append((i, math.sin(b), math.cos(b)))
    return out


def slices(of: DataFrame, config: PipelineConfig) -> DataFrame:
    """strips by azimuth: az (its bit), sin_b, cos_b, and the steps of a pixel in metres (east, north)."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("az"), F.lit(s).alias("sin_b"), F.lit(c).alias("cos_b")) for i, s, c in azimuths(config)]))
    mpd = float(config.meters_per_degree_lat)
    step = mpd / float(config.cell_per_degree)
    out = of.withColumn("__a", each).select("*", "__a.*").drop("__a")
    return out.withColumns({"east": F.lit(step) * F.col("cos_phi"), "north": F.lit(step)})


def rays(of: DataFrame, config: PipelineConfig) -> DataFrame:
    """A row for each ray j that a slice's pixels can need, with its seed on the western edge (n0) and its last step (k_max)."""
    s = F.lit(config.spacing_m)
    corners = [(e, n) for e in (F.lit(0.0), F.col("width") * F.col("east")) for n in (F.lit(0.0), F.col("height") * F.col("north"))]
    perp = [e * F.col("cos_b") - n * F.col("sin_b") for e, n in corners]
    along = F.greatest(*[e * F.col("sin_b") + n * F.col("cos_b") for e, n in corners])
    j = lambda extreme, pad: F.round(extreme(*perp) / s).cast("long") + pad
    out = of.withColumns({"along_max": along, "j": F.explode(F.sequence(j(F.least, -1), j(F.greatest, 1)))})
    out = out.withColumn("n0", -F.col("j") * s / F.col("sin_b"))
    out = out.withColumn("k_max", F.floor((F.col("along_max") + s - F.col("n0") * F.col("cos_b")) / s).cast("int"))
    return out.filter("k_max >= 0")


def samples(of: DataFrame, config: PipelineConfig) -> DataFrame:
    """A row for each step k of rays, with lat and lon; steps past the last pixel can't change a verdict and are left out."""
    s, mpd = F.lit(config.spacing_m), F.lit(float(config.meters_per_degree_lat))
    out = of.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("k_max"))))
    lat = F.col("min_lat") + (F.col("n0") + F.col("k") * s * F.col("cos_b")) / mpd
    lon = F.col("west") + F.col("k") * s * F.col("sin_b") / (mpd * F.col("cos_phi"))
    return out.select(*RAY, "k", (F.col("n0") * F.col("cos_b")).alias("seed"), lat.alias("lat"), lon.alias("lon"))


def judge(walked: DataFrame, config: PipelineConfig) -> DataFrame:
    """Verdicts of samples (..., h, water); a coast beyond the march's limit is none."""
    near = F.col("k") * F.lit(config.spacing_m) <= F.lit(config.coast_march_max_km * 1000.0)
    searched = walked.withColumn("water", F.col("water") | ~near)
    return verdicts(searched, config.spacing_m, config.curvature, config.observer_eye_height_m, config.coast_obstruction_skip_m, RAY)


def gather(of: DataFrame, judged: DataFrame, config: PipelineConfig) -> DataFrame:
    """PIXEL columns, bit and visible: each pixel takes the verdict of the nearest sample of the nearest ray.

    Verdicts become a list for each ray, in the partitioning that judged them, so pixels meet them in one
    equi-join. A pixel over a step before the crossing, or on a ray without land, is not visible.
    """
    s = F.lit(config.spacing_m)
    listed = judged.groupBy(*RAY).agg(
        F.min(F.col("seed") + F.col("k0") * s).alias("along_c"),
        F.transform(F.sort_array(F.collect_list(F.struct("k", "visible"))), lambda x: x["visible"]).alias("seen"),
    )
    cells = of.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    e, n = F.col("col") * F.col("east"), F.col("row") * F.col("north")
    cells = cells.select(*PIXEL, "az", F.round((e * F.col("cos_b") - n * F.col("sin_b")) / s).cast("long").alias("j"), (e * F.col("sin_b") + n * F.col("cos_b")).alias("along"))
    dist = F.col("along") - F.col("along_c")
    index = F.least(F.greatest(F.round(dist / s).cast("int"), F.lit(0)), F.size("seen") - 1)
    met = cells.join(listed, list(RAY), "left")
    return met.select(*PIXEL, F.col("az").alias("bit"), F.coalesce(F.when(dist >= -s, F.get("seen", index)), F.lit(False)).alias("visible"))


def pixel_points(of: DataFrame, config: PipelineConfig) -> DataFrame:
    """The pixels of strips with their points (lat, lon); row 0 lies in the south."""
    cpd = F.lit(float(config.cell_per_degree))
    out = of.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    return out.select(*PIXEL, (F.col("min_lat") + F.col("row") / cpd).alias("lat"), (F.col("west") + F.col("col") / cpd).alias("lon"))


def sweep(boxes: DataFrame, config: PipelineConfig, look: Callable[[DataFrame], DataFrame], water: Column | None = None) -> DataFrame:
    """Masks (PIXEL columns, w0, w1, ...) of boxes, one row for each sample on the way.

    look adds h and water to rows with lat and lon, by a join or by column expressions; water is the
    expression that tells pixels at sea from lat and lon, by default what look says.
    """
    of = strips(boxes, config)
    by_azimuth = slices(of, config)
    judged = judge(look(samples(rays(by_azimuth, config), config)), config)
    masks = accumulate(gather(by_azimuth, judged, config), layout_of(config), PIXEL)
    points = pixel_points(of, config)
    sea = (points.withColumn("water", water) if water is not None else look(points)).select(*PIXEL, "water")
    return flag_land(masks.join(sea, list(PIXEL)), layout_of(config), F.col("water")).drop("water")


def _half_away(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def slice_pixels(row, config: PipelineConfig, elevation: Lookup, water: Lookup) -> np.ndarray:
    """visible (height, width) of one strip and azimuth: the relational formulas over arrays, one ray at a time."""
    s, root = config.spacing_m, math.sqrt(config.curvature)
    mpd = float(config.meters_per_degree_lat)
    h, w, sin_b, cos_b = int(row.height), int(row.width), row.sin_b, row.cos_b
    e, n = np.arange(w) * row.east, np.arange(h)[:, None] * row.north
    ray_of = _half_away((e * cos_b - n * sin_b) / s).astype(np.int64)
    along = e * sin_b + n * cos_b
    along_max = max(x * sin_b + y * cos_b for x in (0.0, w * row.east) for y in (0.0, h * row.north))
    out = np.zeros((h, w), bool)
    order = np.argsort(ray_of, axis=None, kind="stable")
    ids, first = np.unique(ray_of.ravel()[order], return_index=True)
    for j, at in zip(ids.tolist(), np.split(order, first[1:])):
        n0 = -j * s / sin_b
        k_max = math.floor((along_max + s - n0 * cos_b) / s)
        if k_max < 0:
            continue
        k = np.arange(k_max + 1)
        lat, lon = row.min_lat + (n0 + k * s * cos_b) / mpd, row.west + k * s * sin_b / (mpd * row.cos_phi)
        land = np.flatnonzero(~water(lat, lon) & (k * s <= config.coast_march_max_km * 1000.0))
        if not land.size:
            continue
        k0 = int(land[0])
        x = (k[k0:] - k0) * s
        height = np.nan_to_num(np.asarray(elevation(lat[k0:], lon[k0:]), np.float64), nan=0.0)
        reach = np.sqrt(np.maximum(height, 0)) - x * root
        highest = np.maximum.accumulate(np.where(x >= config.coast_obstruction_skip_m, np.maximum(reach, 0.0), 0.0))
        seen = np.sqrt(np.maximum(height + config.observer_eye_height_m, 0)) - x * root >= highest
        dist = along.ravel()[at] - (n0 * cos_b + k0 * s)
        index = np.clip(_half_away(dist / s).astype(np.int64), 0, len(seen) - 1)
        out.ravel()[at] = seen[index] & (dist >= -s)
    return out


def sweep_packed(boxes: DataFrame, config: PipelineConfig, elevation: Lookup, water: Lookup, tasks: int | None = None) -> DataFrame:
    """box_idx, strip, row and mask: the bytes of the row's pixels, pixel by pixel, as the relational tier's words hold them.

    The lookups are sent to the executors and called with arrays of points; they may open tiles there and
    keep some. Every strip and azimuth is a row of its own, dealt to so many tasks, by default as many as there are rows; a task holds one slice at a time
    and emits its rows as packed bits. The OR sees one row for each azimuth of a pixel row.
    """
    layout = layout_of(config)
    bits, size = layout.bit_count, layout.bytes_per_pixel

    def swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                packed = np.packbits(slice_pixels(row, config, elevation, water), axis=1)
                yield pd.DataFrame({"box_idx": row.box_idx, "strip": row.strip, "row": np.arange(len(packed), dtype=np.int32), "az": row.az, "width": row.width, "west": row.west, "lat": row.min_lat + np.arange(len(packed)) / float(config.cell_per_degree), "seen": [p.tobytes() for p in packed]})

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        width, lat, west = int(group.width.iloc[0]), float(group.lat.iloc[0]), float(group.west.iloc[0])
        flags = np.zeros((width, size * 8), np.uint8)
        for az, seen in zip(group.az, group.seen):
            flags[:, az] |= np.unpackbits(np.frombuffer(seen, np.uint8), count=width)
        flags[:, bits] = 1
        lon = west + np.arange(width) / float(config.cell_per_degree)
        flags[water(np.full(width, lat), lon)] = 0
        mask = np.packbits(flags, axis=1, bitorder="little").tobytes()
        return pd.DataFrame({"box_idx": group.box_idx.iloc[:1].to_numpy(), "strip": group.strip.iloc[:1].to_numpy(), "row": group.row.iloc[:1].to_numpy(), "mask": [mask]})

    work = slices(strips(boxes, config), config)
    # Ranges of few rows hold one each, where hashes would deal some tasks several and others none; a number that is given is kept, however tiny the rows.
    work = work.repartitionByRange(tasks or max(1, work.count()), "box_idx", "strip", "az")
    rows = work.mapInPandas(swept, "box_idx int, strip int, row int, az int, width int, west double, lat double, seen binary")
    return rows.groupBy("box_idx", "strip", "row").applyInPandas(merged, "box_idx int, strip int, row int, mask binary")


def marched_km(boxes: DataFrame, config: PipelineConfig) -> DataFrame:
    """boxes with required_km, the longest march that a pixel can need, and covers: whether the configured one reaches it."""
    turn = [abs(math.sin(math.radians(a + 180))) for a in (config.azimuth_min_deg, config.azimuth_max_deg)]
    wide = (F.col("east") - F.col("west")) * F.lit(float(config.meters_per_degree_lat)) * F.cos(F.radians("south"))
    out = boxes.withColumn("required_km", wide / F.lit(max(min(turn), 1e-9)) / 1000.0)
    return out.withColumn("covers", F.col("required_km") <= F.lit(float(config.coast_march_max_km)))


def working_set(of: DataFrame, config: PipelineConfig) -> DataFrame:
    """lat, lon of the one-degree tiles that strips can read; the margin is configured, or just what the slowest ray drifts."""
    turn = [math.radians(a + 180) for a in (config.azimuth_min_deg, config.azimuth_max_deg)]
    drift = max(abs(math.cos(b) / math.sin(b)) for b in turn)
    cpd = float(config.cell_per_degree)
    degrees = F.col("width") / cpd
    margin = F.lit(config.strip_tilt_margin_deg) if config.strip_tilt_margin_deg is not None else degrees * F.col("cos_phi") * drift
    south, north = F.col("min_lat") - margin, F.col("min_lat") + F.col("height") / cpd + margin
    tiles = lambda a, b: F.explode(F.sequence(F.floor(a).cast("int"), F.floor(b - 1e-9).cast("int")))
    return of.withColumn("lat", tiles(south, north)).withColumn("lon", tiles(F.col("west"), F.col("west") + degrees)).select("box_idx", "strip", "lat", "lon").distinct()


def to_coast(points: DataFrame, azimuth: float, step_km: float, max_km: float, water: Lookup, radius_km: float = 6371.0) -> DataFrame:
    """points (lat, lon, ...) moved along a bearing to the first land, on its landward side within 0.1 m; unmoved where none is met.

    Degrees of longitude shrink with the latitude of each step, so a path doesn't depend on where it began.
    """
    per_degree, theta = radius_km * math.pi / 180, math.radians(azimuth)
    up, across = step_km * math.cos(theta) / per_degree, step_km * math.sin(theta) / per_degree
    halvings = max(0, math.ceil(math.log2(step_km / 0.0001)))
    steps = math.floor(max_km / step_km + 1e-9)

    def moved(lat: np.ndarray, lon: np.ndarray, part) -> tuple[np.ndarray, np.ndarray]:
        return lat + part * up, lon + part * across / np.cos(np.radians(lat + part * up / 2))

    @F.pandas_udf("lat double, lon double")
    def coast(lats: pd.Series, lons: pd.Series) -> pd.DataFrame:
        lat, lon = lats.to_numpy(float).copy(), lons.to_numpy(float).copy()
        end_lat, end_lon = lat.copy(), lon.copy()
        going = np.arange(len(lat))[~(np.isnan(lat) | np.isnan(lon))]
        for _ in range(steps):
            if not going.size:
                break
            next_lat, next_lon = moved(lat[going], lon[going], 1.0)
            sea = water(next_lat, next_lon)
            hit = going[~sea]
            wet, dry = np.zeros(len(hit)), np.ones(len(hit))
            for _ in range(halvings if hit.size else 0):
                middle = (wet + dry) / 2
                is_sea = water(*moved(lat[hit], lon[hit], middle))
                wet, dry = np.where(is_sea, middle, wet), np.where(is_sea, dry, middle)
            end_lat[hit], end_lon[hit] = moved(lat[hit], lon[hit], dry)
            lat[going], lon[going] = next_lat, next_lon
            going = going[sea]
        return pd.DataFrame({"lat": end_lat, "lon": end_lon})

    names = [c for c in points.columns if c not in ("lat", "lon")]
    return points.withColumn("__c", coast("lat", "lon")).select(*names, "__c.lat", "__c.lon")
