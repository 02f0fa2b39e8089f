"""Scene flows: prepared tables, hold-out and the recovery of one date."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.expr import BANDS, DEFAULT_DOYS, SCENE_COLUMNS
from tessera.operators import fill, scene as sc
from tessera.session import checkpoint_dir
from tessera.sources.ordered import OrderedTable, write_ordered
from tessera.sources.scene import NX, NY, scene

# Parameters of the registered queries.  The box is relative to the minimum
# X / Y; it is sized for the 20000 x 1000 grid (the small-grid fixture box
# X 5..20, Y 2..8 holds only a few rows there).
DOY = 211
BOX = (0, 0, 499, 49)


def source_key(spark: SparkSession, sf_dir: str, name: str, *parameters) -> str:
    """Key of what is derived from a table: every part file of it plus the parameters."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, parts = fs.listFiles(p, True), []
    while files.hasNext():
        st = files.next()
        parts.append((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    ident = f"{p.toString()}|{sorted(parts)}|{parameters}|v3"
    return hashlib.sha1(ident.encode()).hexdigest()[:16]


def prepared(spark: SparkSession, sf_dir: str, doys=DEFAULT_DOYS) -> DataFrame:
    """Sentinel cleanup, NDVI, pixel id, dates and the 12-column projection.

    The prepared scene is written once per application as parquet
    partitioned by DOY in the shared checkpoint folder (the scene store):
    the global pixel numbering runs once, every later query reads the
    store, and date filters prune to one partition directory.  It is written
    to a folder of its own and renamed when complete, so that two
    applications never write the same files.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/scene-store/{source_key(spark, sf_dir, 'lineitem', NX, NY, list(doys))}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(done):
        base = sc.with_ndvi(sc.sentinel_to_null(scene(spark, sf_dir)))
        out = sc.project(sc.select_doys(sc.with_pixel_ids(base), doys))
        fresh = f"{path}-{uuid.uuid4().hex}"
        out.write.partitionBy("DOY").parquet(fresh)
        if not fs.exists(done):  # else another application was faster: its copy holds the same rows
            fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), jvm.org.apache.hadoop.fs.Path(path))
        if not fs.exists(done):
            raise RuntimeError(f"the scene store could not be published at {path}")
    return spark.read.parquet(path).select(*SCENE_COLUMNS)


def ordered(spark: SparkSession, sf_dir: str, doys=DEFAULT_DOYS) -> OrderedTable:
    """The prepared scene in (DOY, Y, X) order with its positional index, written once for each state of the source."""
    key = source_key(spark, sf_dir, "lineitem", NX, NY, list(doys), "ordered")
    path = f"{checkpoint_dir(spark).rstrip('/')}/scene-ordered/{key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(done):
        fresh = f"{path}-{uuid.uuid4().hex}"
        write_ordered(prepared(spark, sf_dir, doys), ["DOY", "Y", "X"], fresh)
        if not fs.exists(done):  # else another application was faster: its copy holds the same rows
            fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), jvm.org.apache.hadoop.fs.Path(path))
        if not fs.exists(done):
            path = fresh
    return OrderedTable(spark, path)


def tables(spark: SparkSession, sf_dir: str, dtype: str | None = "int") -> sc.SceneTables:
    return sc.split(prepared(spark, sf_dir), dtype=dtype)


def impute_table(t: sc.SceneTables) -> DataFrame:
    """Cloudy rows with bands nulled plus rows that already miss values."""
    return sc.to_impute(t.cloudy, t.missing)


def recover_doy(spark: SparkSession, sf_dir: str, doy: int = DOY, method: str = "median",
                bands=BANDS) -> DataFrame:
    """Recover one date: fill, merge, keep skipped rows, add clear rows, sort.

    The model is the back-off context fit over all clear rows; the merge of
    the model output and the rows it skipped is one left join (see
    ``fill.impute(keep_unfilled=True)``).
    """
    t = tables(spark, sf_dir)
    todo = impute_table(t).filter(F.col("DOY") == doy)
    clear_d = t.clear.filter(F.col("DOY") == doy)
    # of the pixel contexts only those of this date's pixels are fitted
    pixels = todo.select("PID").distinct()
    fitted = [(ctx, fill.context_table(t.clear.join(pixels, "PID", "left_semi") if "PID" in ctx else t.clear,
                                       ctx, bands, method, i)) for i, ctx in enumerate(fill.DEFAULT_CONTEXTS)]
    filled = fill.impute_fitted(todo, fitted, bands, keep_unfilled=True)
    return sc.sort_raster(filled.unionByName(clear_d))


def recover_with(spark: SparkSession, sf_dir: str, imputer, doy: int = DOY, bands=BANDS) -> DataFrame:
    """Recovery with any imputer ``(rows, train) -> rows`` (e.g. a batch model)."""
    t = tables(spark, sf_dir)
    todo = impute_table(t).filter(F.col("DOY") == doy)
    clear_d = t.clear.filter(F.col("DOY") == doy)
    out = imputer(todo.select("PID", "DOY", *bands), t.clear)
    return sc.sort_raster(fill.merge_recovered(todo, out, ("PID", "DOY"), bands).unionByName(clear_d))
