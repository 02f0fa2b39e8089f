"""Raster assembly: one row per image line (DOY, Y), never a whole image.

Present pixels are grouped per line into a map ``X -> value`` (a line is
bounded by the image width, whatever the data volume), and the dense
line is read out over ``sequence(x0, x1)`` so grid gaps become nulls.
Lines with no pixel at all come from the per-date box table (one row per
date), exploded over ``sequence(y0, y1)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expr import ndvi8, stretch8


def _lines(df: DataFrame) -> DataFrame:
    box = df.groupBy("DOY").agg(F.min("X").alias("x0"), F.max("X").alias("x1"),
                                F.min("Y").alias("y0"), F.max("Y").alias("y1"))
    return box.select("DOY", "x0", "x1", F.explode(F.sequence("y0", "y1")).alias("Y"))


def raster_layers(df: DataFrame, layers: dict) -> DataFrame:
    """Dense image lines for several layers at once.

    ``layers`` maps an output name to a column expression evaluated per
    pixel; the result has ``DOY, Y, x0`` and one array column per layer.
    The sparse pixels of a line are sorted by X and expanded in one pass:
    each pixel contributes the nulls of the gap before it and its value,
    the line is closed with the trailing gap -- O(width) per line (a map
    lookup per cell would be O(width x pixels)).
    """
    names = list(layers)
    cells = df.select("DOY", "Y", "X", F.struct(*[layers[n].alias(n) for n in names]).alias("v"))
    per_line = cells.groupBy("DOY", "Y").agg(F.array_sort(F.collect_list(F.struct("X", "v"))).alias("s"))
    # lines: one row per (date, image row); the box table has one row per date
    j = _lines(df).join(per_line, ["DOY", "Y"], "left")
    s, x0, x1 = F.col("s"), F.col("x0"), F.col("x1")
    last = F.coalesce(F.element_at(s, -1)["X"], x0 - 1)
    vtype = cells.schema["v"].dataType

    none = F.when(F.lit(False), F.element_at(s, 1)["v"])  # a pixel that is not there

    def piece(e, i):
        prev_end = F.when(i == 0, x0).otherwise(F.element_at(s, i)["X"] + 1)
        return F.concat(F.array_repeat(F.when(F.lit(False), e["v"]), e["X"] - prev_end), F.array(e["v"]))

    empty = F.array().cast(T.ArrayType(vtype))
    line = F.concat(F.coalesce(F.flatten(F.transform(s, piece)), empty), F.array_repeat(none, x1 - last))
    # one walk over the pixels for all layers; each layer is then a field of the line's cells
    return j.select("DOY", "Y", "x0", line.alias("_line")).select(
        "DOY", "Y", "x0", *[F.col("_line").getField(n).alias(n) for n in names])


def raster_rows(df: DataFrame, band: str) -> DataFrame:
    return raster_layers(df, {"values": F.col(band)})


def raster_rgb(df: DataFrame, fill: int = 0) -> DataFrame:
    return raster_layers(df, {"R": stretch8("B04", fill), "G": stretch8("B03", fill), "B": stretch8("B02", fill)})


def raster_all_layers(df: DataFrame) -> DataFrame:
    """RGB, NDVI and the quality-flag layers of every date, one wide aggregation."""
    return raster_layers(df, {
        "R": stretch8("B04"), "G": stretch8("B03"), "B": stretch8("B02"), "NDVI8": ndvi8("NDVI"),
        "cloud": F.col("cloud"), "adj_cloud": F.col("adj_cloud"), "cloud_shadow": F.col("cloud_shadow"),
        "snow_ice": F.col("snow_ice"), "water": F.col("water"),
    })


def raster_compare(original: DataFrame, recovered: DataFrame, bands=("B02", "B03", "B04")) -> DataFrame:
    """Original and recovered values of the same pixels, with their difference."""
    o = original.select("X", "Y", "DOY", *[F.col(b).cast("double").alias(f"orig_{b}") for b in bands])
    r = recovered.select("X", "Y", "DOY", *[F.col(b).cast("double").alias(f"rec_{b}") for b in bands])
    j = o.join(r, ["X", "Y", "DOY"])
    return j.select("X", "Y", "DOY", *[f"orig_{b}" for b in bands], *[f"rec_{b}" for b in bands],
                    *[(F.col(f"rec_{b}") - F.col(f"orig_{b}")).alias(f"diff_{b}") for b in bands])
