"""Scene (pixel time-series) sources and sinks.

A scene is a long table, one row per (X, Y, DOY).  On a cluster it is
read from CSV or parquet with an explicit schema; for tests it is the
``scene`` view derived from ``lineitem`` (see FIXTURES.md), expressed
here with the DataFrame API so Catalyst pushes the column pruning into
the parquet scan and does the grouping with a partial (map-side)
aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import table

# Column list of a scene file (bands, quality flags, angles).
BAND_COLUMNS = ["B01", "B02", "B03", "B04", "B05", "B06", "B07", "B09", "B10", "B11"]
FLAG_COLUMNS = ["cirrus", "cloud", "adj_cloud", "cloud_shadow", "snow_ice", "water", "aero"]
ANGLE_COLUMNS = ["SAA", "SZA", "VAA", "VZA"]

SCENE_FILE_SCHEMA = T.StructType(
    [T.StructField("X", T.IntegerType()), T.StructField("Y", T.IntegerType()),
     T.StructField("DOY", T.IntegerType())]
    + [T.StructField(b, T.IntegerType()) for b in BAND_COLUMNS]
    + [T.StructField(f, T.IntegerType()) for f in FLAG_COLUMNS]
    + [T.StructField(a, T.DoubleType()) for a in ANGLE_COLUMNS]
)

# Grid used by queries and the bench (scales with lineitem); 40 x 25 is the
# small grid of the fixture table.
NX, NY = 20000, 1000


def scene_from_lineitem(lineitem: DataFrame, nx: int = NX, ny: int = NY) -> DataFrame:
    """The ``scene`` fixture view: one row per (X, Y, DOY) cell of lineitem."""
    c = (
        lineitem.groupBy(
            (F.lit(1500) + F.col("l_partkey") % nx).alias("X"),
            (F.lit(980) + F.col("l_suppkey") % ny).alias("Y"),
            (F.lit(171) + F.lit(8) * (F.col("l_orderkey") % 7)).alias("DOY"),
        ).agg(
            F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("p"),
            F.sum(F.col("l_quantity").cast("long")).alias("q"),
        )
    )
    p, q, x = F.col("p"), F.col("q"), F.col("X")

    def gap(mod, expr):
        return F.when(p % mod == 0, F.lit(-9999)).otherwise(expr).cast("int")

    def flag(cond):
        return F.when(cond, 1).otherwise(0).cast("int")

    return c.select(
        F.col("X").cast("int").alias("X"),
        F.col("Y").cast("int").alias("Y"),
        F.col("DOY").cast("int").alias("DOY"),
        gap(29, p % 3300 - 200).alias("B02"),
        gap(29, (p + 7 * q) % 3300 - 200).alias("B03"),
        gap(29, (p + 13 * q) % 3300 + 1).alias("B04"),
        gap(31, (p + 29 * q) % 6000 + 1).alias("B05"),
        flag(q % 4 == 0).alias("cloud"),
        flag(q % 7 == 0).alias("adj_cloud"),
        flag(q % 9 == 0).alias("cloud_shadow"),
        flag(q % 37 == 0).alias("snow_ice"),
        flag(x % 13 == 0).alias("water"),
    )


def scene(spark: SparkSession, sf_dir: str, nx: int = NX, ny: int = NY) -> DataFrame:
    return scene_from_lineitem(table(spark, sf_dir, "lineitem"), nx, ny)


def scene_sql(nx: int = NX, ny: int = NY) -> str:
    """The same view as SQL text (DuckDB oracle and Spark SQL)."""
    return f"""
WITH c AS (
  SELECT 1500 + l_partkey % {nx} AS X, 980 + l_suppkey % {ny} AS Y,
         171 + 8 * (l_orderkey % 7) AS DOY,
         SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS p,
         SUM(CAST(l_quantity AS BIGINT)) AS q
  FROM lineitem GROUP BY 1, 2, 3)
SELECT CAST(X AS INT) AS X, CAST(Y AS INT) AS Y, CAST(DOY AS INT) AS DOY,
  CAST(CASE WHEN p % 29 = 0 THEN -9999 ELSE p % 3300 - 200 END AS INT) AS B02,
  CAST(CASE WHEN p % 29 = 0 THEN -9999 ELSE (p + 7 * q) % 3300 - 200 END AS INT) AS B03,
  CAST(CASE WHEN p % 29 = 0 THEN -9999 ELSE (p + 13 * q) % 3300 + 1 END AS INT) AS B04,
  CAST(CASE WHEN p % 31 = 0 THEN -9999 ELSE (p + 29 * q) % 6000 + 1 END AS INT) AS B05,
  CAST(CASE WHEN q % 4 = 0 THEN 1 ELSE 0 END AS INT) AS cloud,
  CAST(CASE WHEN q % 7 = 0 THEN 1 ELSE 0 END AS INT) AS adj_cloud,
  CAST(CASE WHEN q % 9 = 0 THEN 1 ELSE 0 END AS INT) AS cloud_shadow,
  CAST(CASE WHEN q % 37 = 0 THEN 1 ELSE 0 END AS INT) AS snow_ice,
  CAST(CASE WHEN X % 13 = 0 THEN 1 ELSE 0 END AS INT) AS water
FROM c"""


# ---------------------------------------------------------------- file I/O

def read_scene_csv(spark: SparkSession, path: str, schema: T.StructType = SCENE_FILE_SCHEMA) -> DataFrame:
    """Scan scene CSV files with a header and an explicit schema (no inference pass)."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header; no positional index column is written."""
    df.write.mode(mode).option("header", True).csv(path)


def read_csv_drop_unnamed(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read results back and drop columns whose name starts with ``Unnamed``.

    With a schema the read is a single pass; without one the header is read
    as strings and numeric columns are recovered by ``try_cast`` per column.
    """
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    return df.select([F.col(f"`{c}`") for c in df.columns if not c.startswith("Unnamed")])


def write_partitioned(df: DataFrame, path: str, by: str = "DOY", mode: str = "overwrite") -> None:
    """Persist a scene as parquet partitioned by date so date filters prune files."""
    df.write.mode(mode).partitionBy(by).parquet(path)
