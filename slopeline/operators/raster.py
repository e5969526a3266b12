"""Pixel tables: sampling joins, mosaics and terrain gradients.

A raster is a table (layer, row, col, v). Grids are worked on in square tiles with a one-cell halo, so
one shuffle on the tile serves both directions and a window never holds more than a tile's edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 256
# Metres per degree of latitude and of longitude at the equator.
METRES_LAT, METRES_LON = 110574.0, 111320.0


def pixel_of(lon: Column, lat: Column, origin_lon: float, origin_lat: float, step_lon: float,
             step_lat: float, nearest: bool) -> tuple[Column, Column]:
    """(row, col) of a point; ``step_lat`` is negative when rows run south.

    ``nearest`` rounds half to even (daily rain grids), otherwise the cell that contains the point.
    """
    x = (lon - F.lit(origin_lon)) / F.lit(step_lon)
    y = (lat - F.lit(origin_lat)) / F.lit(step_lat)
    cell = F.rint if nearest else F.floor
    return cell(y).cast("bigint"), cell(x).cast("bigint")


def sample_pixels(points: DataFrame, pixels: DataFrame, row: Column, col: Column,
                  on: dict[str, str] | None = None, name: str = "v", clean: bool = True) -> DataFrame:
    """Left join of points to their pixel; outside or nodata is NULL.

    ``on`` maps point columns to pixel columns that must also agree, such as the day to the layer.
    """
    on = on or {}
    px = pixels.select(*[F.col(p).alias(f"_k_{i}") for i, p in enumerate(on.values())],
                       F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("v").alias("_v"))
    cond = (row == F.col("_r")) & (col == F.col("_c"))
    for i, c in enumerate(on):
        cond = cond & (F.col(c) == F.col(f"_k_{i}"))
    value = F.when(F.col("_v") >= 0, F.col("_v")) if clean else F.col("_v")
    return points.join(px, cond, "left").select(*points.columns, value.alias(name))


def mosaic(pixels: DataFrame, order: str, keys: Sequence[str] = ("row", "col"), nodata: float = -9999.0) -> DataFrame:
    """First valid value per cell in tile order, as a partial aggregate."""
    valid = F.col("v").isNotNull() & (F.col("v") != F.lit(nodata))
    return pixels.groupBy(*keys).agg(F.min_by("v", F.when(valid, F.col(order))).alias("v"))


def _tiled(pixels: DataFrame, by: Sequence[str], tile: int) -> DataFrame:
    """Every pixel in its own tile and, on a tile edge, as halo in the neighbour tile."""
    def home(c):
        return F.floor(F.col(c) / tile)

    def spread(c):
        at = F.col(c) - home(c) * tile
        return F.array_compact(F.array(home(c), F.when(at == 0, home(c) - 1), F.when(at == tile - 1, home(c) + 1)))

    out = pixels.select(*by, "row", "col", "v", home("row").alias("_hr"), home("col").alias("_hc"),
                        F.explode(spread("row")).alias("_tr"), spread("col").alias("_cs"))
    return out.select("*", F.explode("_cs").alias("_tc")).drop("_cs")


def gradients(pixels: DataFrame, by: Sequence[str] = (), dx: Column | None = None, dy: Column | None = None,
              tile: int = TILE) -> DataFrame:
    """dz_dx and dz_dy per pixel: central differences inside, one-sided at the edges of the grid.

    A NULL neighbour makes the difference NULL, as NaN does in array arithmetic. ``dx`` and ``dy`` are
    the cell sizes (columns or 1).
    """
    by = list(by)
    t = _tiled(pixels, by, tile).repartition(*by, "_tr", "_tc")
    across = Window.partitionBy(*by, "_tr", "_tc", "row").orderBy("col")
    down = Window.partitionBy(*by, "_tr", "_tc", "col").orderBy("row")

    def diff(w, axis, size):
        # neighbours are adjacent cells that exist; a missing pixel row is the edge of the grid
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        has_before = F.lag(axis).over(w) == F.col(axis) - 1
        has_after = F.lead(axis).over(w) == F.col(axis) + 1
        hb, ha = F.coalesce(has_before, F.lit(False)), F.coalesce(has_after, F.lit(False))
        step = size if size is not None else F.lit(1.0)
        return (F.when(hb & ha, (after - before) / (2 * step)).when(ha, (after - F.col("v")) / step)
                .when(hb, (F.col("v") - before) / step))

    out = t.withColumn("dz_dx", diff(across, "col", dx)).withColumn("dz_dy", diff(down, "row", dy))
    return out.where((F.col("_tr") == F.col("_hr")) & (F.col("_tc") == F.col("_hc"))).select(
        *by, "row", "col", "v", "dz_dx", "dz_dy")


def slope_uniform(pixels: DataFrame, by: Sequence[str] = (), cell_m: float = 90.0, tile: int = TILE) -> DataFrame:
    """Slope in degrees on a grid with square cells."""
    g = gradients(pixels, by, F.lit(cell_m), F.lit(cell_m), tile)
    return g.withColumn("slope_degrees", F.degrees(F.atan(F.sqrt(F.pow("dz_dx", 2) + F.pow("dz_dy", 2))))).drop(
        "dz_dx", "dz_dy")


def slope_geographic(pixels: DataFrame, origin_lat: float, step_lat: float, step_lon: float, by: Sequence[str] = (),
                     nodata: float = -9999.0, tile: int = TILE) -> DataFrame:
    """Slope in degrees on a degree grid; nodata pixels have none and pass none to their neighbours."""
    clean = pixels.withColumn("v", F.when(F.col("v") != F.lit(nodata), F.col("v")))
    g = gradients(clean, by, None, None, tile)
    lat = F.lit(origin_lat) + (F.col("row") + F.lit(0.5)) * F.lit(step_lat)
    mx = g["dz_dx"] / (F.lit(abs(step_lon) * METRES_LON) * F.cos(F.radians(lat)))
    my = g["dz_dy"] / F.lit(abs(step_lat) * METRES_LAT)
    return g.withColumn("slope_degrees", F.when(F.col("v").isNotNull(), F.degrees(F.atan(F.hypot(mx, my))))).drop(
        "dz_dx", "dz_dy")


def aspect(pixels: DataFrame, by: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Compass aspect in degrees from unit gradients: 90 - atan2(-dy, dx), lifted to 0..360."""
    g = gradients(pixels, by, None, None, tile)
    a = F.lit(90.0) - F.degrees(F.atan2(-F.col("dz_dy"), F.col("dz_dx")))
    return g.withColumn("aspect_degrees", F.when(a < 0, a + 360).otherwise(a)).drop("dz_dx", "dz_dy")
