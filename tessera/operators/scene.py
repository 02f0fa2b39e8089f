"""Scene operators: cleanup, projections, splits, hold-outs and unions.

All functions are ``DataFrame -> DataFrame``.  Values computed from the
whole table (minimum X, maximum of a band) are scalar subqueries
(``DataFrame.scalar()``): Spark runs them once as a separate job, with no
join against the big side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expr import (
    BANDS, CLOUD_FLAGS, DEFAULT_DOYS, FILL_BANDS, MISSING_SENTINEL, SCENE_COLUMNS, TRAIN_COLUMNS,
    all_of, any_null, any_of, ndvi, ndvi8, quantize, reflectance, sentinel_null, stretch8,
)
from tessera.operators.ids import dense_ids

# ------------------------------------------------------------ introspection


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns (driver-side schema introspection)."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def check_columns(df: DataFrame, expected: list[str]) -> None:
    """Raise when the frame's column set differs from ``expected``."""
    if set(df.columns) != set(expected):
        raise ValueError(
            f"column mismatch: got {sorted(df.columns)}, expected {sorted(expected)}"
        )


def table_from_rows(spark: SparkSession, rows, columns: list[str]) -> DataFrame:
    """Table from row tuples and column names; the width must match."""
    rows = list(rows)
    if not columns:
        raise ValueError("table_from_rows: columns is empty")
    if rows and len(rows[0]) != len(columns):
        raise ValueError(f"table_from_rows: rows are {len(rows[0])} wide, columns name {len(columns)}")
    return spark.createDataFrame(rows, columns)


# ------------------------------------------------------------ projections


def sentinel_to_null(df: DataFrame, cols: list[str] | None = None, sentinel: int = MISSING_SENTINEL) -> DataFrame:
    """Replace the missing sentinel by null in every numeric column."""
    cols = cols if cols is not None else numeric_columns(df)
    return df.withColumns({c: sentinel_null(c, sentinel) for c in cols})


def with_ndvi(df: DataFrame, out: str = "NDVI") -> DataFrame:
    return df.withColumn(out, ndvi("B05", "B04"))


def with_pixel_ids(df: DataFrame, out: str = "PID") -> DataFrame:
    """Dense pixel id over the whole table, before any clip or date filter."""
    return dense_ids(df, ["X", "Y"], out)


def project(df: DataFrame, cols: list[str] = SCENE_COLUMNS) -> DataFrame:
    return df.select(*cols)


def project_cast(df: DataFrame, cols: list[str] = TRAIN_COLUMNS, dtype: str = "int",
                 keep: tuple[str, ...] = ("NDVI",)) -> DataFrame:
    """Project and cast each column; a column with a value that cannot be cast stays as it is.

    Columns in ``keep`` are not cast (an integer NDVI would truncate to 0);
    pass ``keep=()`` to mirror that truncation.  Only text columns can fail:
    they are looked through once.
    """
    types = dict(df.dtypes)
    texts = [c for c in cols if c not in keep and types.get(c) == "string"]
    if texts:
        fails = df.agg(*[F.max(F.col(c).isNotNull() & F.col(c).try_cast(dtype).isNull()).alias(c)
                         for c in texts]).first()
        keep = (*keep, *[c for c in texts if fails[c]])
    return df.select(*[F.col(c) if c in keep else F.col(c).try_cast(dtype).alias(c) for c in cols])


def scale_reflectance(df: DataFrame, bands=("B04", "B03", "B02"), digits: int = 4,
                      as_int: bool = False) -> DataFrame:
    return df.withColumns({b: reflectance(b, digits, as_int) for b in bands})


def scale_quantize(df: DataFrame, bands=("B04", "B03", "B02"), digits: int = 4) -> DataFrame:
    return df.withColumns({b: quantize(b, digits) for b in bands})


def stretch_rgb(df: DataFrame, fill: int = 0, scaled: bool = False) -> DataFrame:
    """8-bit R, G, B from B04, B03, B02; already-scaled bands are only truncated."""
    if scaled:
        conv = {n: F.coalesce(F.pmod(F.col(b).cast("int"), F.lit(256)), F.lit(fill))
                for n, b in (("R", "B04"), ("G", "B03"), ("B", "B02"))}
    else:
        conv = {n: stretch8(b, fill) for n, b in (("R", "B04"), ("G", "B03"), ("B", "B02"))}
    return df.select("X", "Y", "DOY", *[v.alias(k) for k, v in conv.items()])


def ndvi_stretch(df: DataFrame, fill: int = 255) -> DataFrame:
    return df.select("X", "Y", "DOY", ndvi8("NDVI", fill).alias("NDVI8"))


def missing_mask(df: DataFrame, bands=BANDS) -> DataFrame:
    """1 where the band is missing, else 0, per pixel and date."""
    return df.select("X", "Y", "DOY", *[F.col(b).isNull().cast("int").alias(b) for b in bands])


def mask_bands(df: DataFrame, bands=FILL_BANDS) -> DataFrame:
    """Null out a band list for every row (types kept)."""
    types = dict(df.dtypes)
    return df.withColumns({b: F.lit(None).cast(types[b]) for b in bands})


def mask_cloudy(df: DataFrame, bands=FILL_BANDS, flags=CLOUD_FLAGS) -> DataFrame:
    """Null out bands only where any cloud flag is 1."""
    cloudy = any_of([F.col(f) == 1 for f in flags])
    return df.withColumns({b: F.when(~cloudy, F.col(b)) for b in bands})


def drop_rename(df: DataFrame, drop: list[str], names: list[str]) -> DataFrame:
    """Drop columns, then rename all remaining ones positionally."""
    return df.drop(*drop).toDF(*names)


def reverse_columns(df: DataFrame) -> DataFrame:
    return df.select(*reversed(df.columns))


def fill_with_max(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fill missing cells with the one maximum of all ``cols`` (a scalar subquery)."""
    most = [F.max(c) for c in cols]
    whole = df.agg((F.greatest(*most) if len(most) > 1 else most[0]).alias("m"))
    types = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(c), whole.select("m").scalar().cast(types[c])) for c in cols})


# ------------------------------------------------------------ filters


def clip_box(df: DataFrame, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    """Keep a box given relative to the table's minimum X / Y, ends inclusive."""
    x0 = df.agg(F.min("X")).scalar()
    y0 = df.agg(F.min("Y")).scalar()
    return df.filter(
        F.col("X").between(x0 + x1, x0 + x2) & F.col("Y").between(y0 + y1, y0 + y2)
    )


def select_doys(df: DataFrame, doys=DEFAULT_DOYS, keep_pos: bool = False) -> DataFrame:
    """Rows of the listed dates, in the order of the list; a repeated date repeats its rows.

    Strictly ascending lists are a pushed-down ``isin`` that leaves the rows
    where they are (stores are kept by date).  Others join the (bounded,
    list-sized) position table by broadcast and sort by the position.
    """
    doys = [int(d) for d in doys]
    if all(a < b for a, b in zip(doys, doys[1:])) and not keep_pos:
        return df.filter(F.col("DOY").isin(doys))
    spark = df.sparkSession
    lst = spark.createDataFrame([(i, d) for i, d in enumerate(doys)], "_pos int, DOY int")
    out = df.join(F.broadcast(lst), "DOY")
    out = out.select(*df.columns, "_pos").orderBy("_pos")
    return out if keep_pos else out.drop("_pos")


def rows_missing(df: DataFrame) -> DataFrame:
    return df.filter(any_null(df.columns))


def rows_complete(df: DataFrame) -> DataFrame:
    return df.dropna(how="any")


def rows_clear(df: DataFrame, flags=CLOUD_FLAGS) -> DataFrame:
    return df.dropna(how="any").filter(all_of([F.col(f) == 0 for f in flags]))


def rows_cloudy(df: DataFrame, flags=CLOUD_FLAGS) -> DataFrame:
    return df.dropna(how="any").filter(any_of([F.col(f) == 1 for f in flags]))


def _in_box(clear: DataFrame, x1, y1, x2, y2):
    x0 = clear.agg(F.min("X")).scalar()
    y0 = clear.agg(F.min("Y")).scalar()
    return F.col("X").between(x0 + x1, x0 + x2) & F.col("Y").between(y0 + y1, y0 + y2)


def aoi_holdout(clear: DataFrame, doy: int, x1: int, y1: int, x2: int, y2: int,
                mask_test: bool = False) -> tuple[DataFrame, DataFrame]:
    """Hold out a box on one date: test = clear rows of ``doy`` inside the box
    (box relative to the clear minima), train = the exact complement."""
    tagged = clear.withColumn("_test", (F.col("DOY") == doy) & _in_box(clear, x1, y1, x2, y2))
    test = tagged.filter("_test").drop("_test")
    train = tagged.filter(~F.col("_test")).drop("_test")
    if mask_test:
        test = mask_bands(test, [b for b in FILL_BANDS if b in test.columns])
    return train, test


def aoi_ts_holdout(clear: DataFrame, x1: int, y1: int, x2: int, y2: int) -> tuple[DataFrame, DataFrame]:
    """Hold out a box over all dates; test bands are always masked."""
    tagged = clear.withColumn("_test", _in_box(clear, x1, y1, x2, y2))
    test = mask_bands(tagged.filter("_test").drop("_test"), [b for b in FILL_BANDS if b in clear.columns])
    train = tagged.filter(~F.col("_test")).drop("_test")
    return train, test


def pixel_series(df: DataFrame, x: int, y: int) -> DataFrame:
    return df.filter((F.col("X") == x) & (F.col("Y") == y))


def distinct_doys(df: DataFrame) -> DataFrame:
    return df.select("DOY").distinct()


# ------------------------------------------------------------ unions


def to_impute(cloudy: DataFrame, missing: DataFrame, bands=FILL_BANDS) -> DataFrame:
    """Cloudy rows with bands nulled plus the rows that already miss values."""
    return mask_bands(cloudy, [b for b in bands if b in cloudy.columns]).unionByName(missing)


def sort_raster(df: DataFrame) -> DataFrame:
    return df.orderBy("Y", "X", "DOY")


def inference_all(imputed: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    return sort_raster(imputed.unionByName(train).unionByName(test))


def inference_clear(imputed: DataFrame, clear: DataFrame) -> DataFrame:
    return sort_raster(imputed.unionByName(clear))


# ------------------------------------------------------------ aggregates


def box_size(df: DataFrame) -> DataFrame:
    """Raster width and height per date."""
    return df.groupBy("DOY").agg(
        (F.max("X") - F.min("X") + 1).alias("box_x"),
        (F.max("Y") - F.min("Y") + 1).alias("box_y"),
    )


# ------------------------------------------------------------ pipeline state


@dataclass
class SceneTables:
    """The prepared scene and its splits (immutable DataFrames)."""

    data: DataFrame      # date-selected, projected, 12 columns, with PID
    missing: DataFrame   # rows with any null
    clear: DataFrame     # complete, no cloud flag
    cloudy: DataFrame    # complete, some cloud flag


def prepare(raw: DataFrame, doys=DEFAULT_DOYS, cols=SCENE_COLUMNS) -> DataFrame:
    """Sentinel cleanup, NDVI, pixel ids (whole table), dates, projection."""
    df = with_pixel_ids(with_ndvi(sentinel_to_null(raw)))
    return project(select_doys(df, doys), cols)


def split(data: DataFrame, train_cols=TRAIN_COLUMNS, dtype: str | None = "int") -> SceneTables:
    """Missing / clear / cloudy split, then the training projection + cast."""
    def narrow(d):
        return project_cast(d, train_cols, dtype) if dtype else project(d, train_cols)
    return SceneTables(
        data=narrow(data),
        missing=narrow(rows_missing(data)),
        clear=narrow(rows_clear(data)),
        cloudy=narrow(rows_cloudy(data)),
    )
