"""Registered queries (Spark) and their DuckDB oracle SQL.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> str``.
checked rows-only plus property tests in ``tests/``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.expr import BANDS, FILL_BANDS
from tessera.operators import fill, scene as sc
from tessera.plans import oracle as o
from tessera.plans import recover as rc
from tessera.sources import scene as src

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


X1, Y1, X2, Y2 = rc.BOX
DOY = rc.DOY
REPEAT_DOYS = [211, 171, 211]


def _nulled(spark, d):
    return sc.sentinel_to_null(src.scene(spark, d))


# ------------------------------------------------------------------ sources

@query("scene_scan", o.with_scene("SELECT * FROM scene"))
def q_scene_scan(spark, d):
    return src.scene(spark, d)


@query("sentinel_to_null", o.with_scene("SELECT * FROM s0"))
def q_sentinel_to_null(spark, d):
    return _nulled(spark, d)


# ------------------------------------------------------------------ projections

@query("project_scene", o.with_scene("SELECT * FROM data"))
def q_project_scene(spark, d):
    return rc.prepared(spark, d)


@query("project_cast", o.with_scene("SELECT * FROM data9"))
def q_project_cast(spark, d):
    return rc.tables(spark, d).data


@query("ndvi", o.with_scene("SELECT X, Y, DOY, NDVI FROM s1"))
def q_ndvi(spark, d):
    return sc.with_ndvi(_nulled(spark, d)).select("X", "Y", "DOY", "NDVI")


def _refl_sql(as_int: bool, quant: bool = False):
    cols = []
    for b in ("B02", "B03", "B04"):
        v = f"round_even({o.capped(b)}, 4)"
        if as_int:
            v = f"CAST(trunc({v} * 10000) AS INTEGER)"
        if quant:
            v = f"({v} * 255)"
        cols.append(f"{v} AS {b}")
    return o.with_scene(f"SELECT X, Y, DOY, {', '.join(cols)} FROM s0")


@query("reflectance", _refl_sql(False))
def q_reflectance(spark, d):
    return sc.scale_reflectance(_nulled(spark, d)).select("X", "Y", "DOY", *BANDS)


@query("reflectance_int", _refl_sql(True))
def q_reflectance_int(spark, d):
    return sc.scale_reflectance(_nulled(spark, d), as_int=True).select("X", "Y", "DOY", *BANDS)


@query("quantize", _refl_sql(False, quant=True))
def q_quantize(spark, d):
    return sc.scale_quantize(_nulled(spark, d)).select("X", "Y", "DOY", *BANDS)


@query("stretch8", o.with_scene(
    "SELECT X, Y, DOY, " + ", ".join(
        f"{o.pmod256_trunc(o.capped(b) + ' * 255', 0)} AS {n}"
        for n, b in (("R", "B04"), ("G", "B03"), ("B", "B02"))) + " FROM s0"))
def q_stretch8(spark, d):
    return sc.stretch_rgb(_nulled(spark, d))


@query("ndvi8", o.with_scene(
    f"SELECT X, Y, DOY, {o.pmod256_trunc('NDVI * 255', 255)} AS NDVI8 FROM s1"))
def q_ndvi8(spark, d):
    return sc.ndvi_stretch(sc.with_ndvi(_nulled(spark, d)))


@query("missing_mask", o.with_scene(
    "SELECT X, Y, DOY, " + ", ".join(f"CAST({b} IS NULL AS INTEGER) AS {b}" for b in BANDS) + " FROM s0"))
def q_missing_mask(spark, d):
    return sc.missing_mask(_nulled(spark, d))


@query("mask_bands", o.with_scene(
    "SELECT CAST(NULL AS INTEGER) AS B02, CAST(NULL AS INTEGER) AS B03, CAST(NULL AS INTEGER) AS B04, "
    "CAST(NULL AS INTEGER) AS B05, CAST(NULL AS DOUBLE) AS NDVI, cloud, adj_cloud, cloud_shadow, X, Y, DOY, PID "
    "FROM data"))
def q_mask_bands(spark, d):
    return sc.mask_bands(rc.prepared(spark, d), FILL_BANDS)


@query("mask_cloudy", o.with_scene(
    "SELECT " + ", ".join(
        f"CASE WHEN cloud = 1 OR adj_cloud = 1 OR cloud_shadow = 1 THEN NULL ELSE {b} END AS {b}"
        for b in FILL_BANDS) + ", cloud, adj_cloud, cloud_shadow, X, Y, DOY, PID FROM data"))
def q_mask_cloudy(spark, d):
    return sc.mask_cloudy(rc.prepared(spark, d))


DROP_NAMES = ["b2", "b3", "b4", "b5", "ndvi", "x", "y", "doy", "pid"]


@query("drop_rename", o.with_scene(
    "SELECT " + ", ".join(f"{a} AS {b}" for a, b in zip(o.T9, DROP_NAMES)) + " FROM data"))
def q_drop_rename(spark, d):
    return sc.drop_rename(rc.prepared(spark, d), ["cloud", "adj_cloud", "cloud_shadow"], DROP_NAMES)


@query("reverse_columns", o.with_scene("SELECT " + ", ".join(reversed(o.T9)) + " FROM clear"))
def q_reverse_columns(spark, d):
    return sc.reverse_columns(rc.tables(spark, d).clear)


@query("fill_with_max", o.with_scene(
    "SELECT " + ", ".join(f"COALESCE({b}, (SELECT greatest({', '.join(f'max({x})' for x in FILL_BANDS)}) FROM data)) "
                          f"AS {b}" for b in FILL_BANDS)
    + ", cloud, adj_cloud, cloud_shadow, X, Y, DOY, PID FROM data"))
def q_fill_with_max(spark, d):
    return sc.fill_with_max(rc.prepared(spark, d), FILL_BANDS)


# ------------------------------------------------------------------ filters

@query("clip_box", o.with_scene(
    f"SELECT * FROM s0 WHERE X BETWEEN (SELECT min(X) FROM s0) + {X1} AND (SELECT min(X) FROM s0) + {X2} "
    f"AND Y BETWEEN (SELECT min(Y) FROM s0) + {Y1} AND (SELECT min(Y) FROM s0) + {Y2}"))
def q_clip_box(spark, d):
    return sc.clip_box(_nulled(spark, d), X1, Y1, X2, Y2)


@query("select_doys", o.with_scene(
    "SELECT s0.* FROM s0 JOIN (VALUES " + ", ".join(f"({i}, {v})" for i, v in enumerate(REPEAT_DOYS))
    + ") AS l(pos, d) ON s0.DOY = l.d"))
def q_select_doys(spark, d):
    return sc.select_doys(_nulled(spark, d), REPEAT_DOYS)


@query("rows_missing", o.with_scene("SELECT * FROM missing12"))
def q_rows_missing(spark, d):
    return sc.rows_missing(rc.prepared(spark, d))


@query("rows_complete", o.with_scene(f"SELECT * FROM data WHERE {o.not_null_all(o.S12.split(', '))}"))
def q_rows_complete(spark, d):
    return sc.rows_complete(rc.prepared(spark, d))


@query("rows_clear", o.with_scene("SELECT * FROM clear12"))
def q_rows_clear(spark, d):
    return sc.rows_clear(rc.prepared(spark, d))


@query("rows_cloudy", o.with_scene("SELECT * FROM cloudy12"))
def q_rows_cloudy(spark, d):
    return sc.rows_cloudy(rc.prepared(spark, d))


def _box_sql(src_: str, ref: str = "clear") -> str:
    return (f"X BETWEEN (SELECT min(X) FROM {ref}) + {X1} AND (SELECT min(X) FROM {ref}) + {X2} "
            f"AND Y BETWEEN (SELECT min(Y) FROM {ref}) + {Y1} AND (SELECT min(Y) FROM {ref}) + {Y2}")


@query("aoi_test", o.with_scene(f"SELECT * FROM clear WHERE DOY = {DOY} AND {_box_sql('clear')}"))
def q_aoi_test(spark, d):
    return sc.aoi_holdout(rc.tables(spark, d).clear, DOY, X1, Y1, X2, Y2)[1]


@query("aoi_train", o.with_scene(f"SELECT * FROM clear WHERE NOT (DOY = {DOY} AND {_box_sql('clear')})"))
def q_aoi_train(spark, d):
    return sc.aoi_holdout(rc.tables(spark, d).clear, DOY, X1, Y1, X2, Y2)[0]


_MASKED9 = ("CAST(NULL AS INTEGER) AS B02, CAST(NULL AS INTEGER) AS B03, CAST(NULL AS INTEGER) AS B04, "
            "CAST(NULL AS INTEGER) AS B05, CAST(NULL AS DOUBLE) AS NDVI, X, Y, DOY, PID")


@query("aoi_ts_test", o.with_scene(f"SELECT {_MASKED9} FROM clear WHERE {_box_sql('clear')}"))
def q_aoi_ts_test(spark, d):
    return sc.aoi_ts_holdout(rc.tables(spark, d).clear, X1, Y1, X2, Y2)[1]


@query("aoi_ts_train", o.with_scene(f"SELECT * FROM clear WHERE NOT ({_box_sql('clear')})"))
def q_aoi_ts_train(spark, d):
    return sc.aoi_ts_holdout(rc.tables(spark, d).clear, X1, Y1, X2, Y2)[0]


# Pixel lookup: the pixel at the minimum (X, Y) corner plus fixed offsets
# would change with data; a fixed coordinate present at every scale is used.
PIXEL = (1501, 981)


@query("pixel_series", o.with_scene(f"SELECT * FROM data WHERE X = {PIXEL[0]} AND Y = {PIXEL[1]}"))
def q_pixel_series(spark, d):
    return sc.pixel_series(rc.prepared(spark, d), *PIXEL)


@query("impute_inputs_doy", o.with_scene(
    f"SELECT *, 'to_impute' AS part FROM ti WHERE DOY = {DOY} "
    f"UNION ALL SELECT *, 'clear' AS part FROM clear WHERE DOY = {DOY}"))
def q_impute_inputs_doy(spark, d):
    t = rc.tables(spark, d)
    a = rc.impute_table(t).filter(F.col("DOY") == DOY).withColumn("part", F.lit("to_impute"))
    b = t.clear.filter(F.col("DOY") == DOY).withColumn("part", F.lit("clear"))
    return a.unionByName(b)


@query("distinct_doys", o.with_scene("SELECT DISTINCT DOY FROM data"))
def q_distinct_doys(spark, d):
    return sc.distinct_doys(rc.prepared(spark, d))


# ------------------------------------------------------------------ unions, ids, sort

@query("to_impute", o.with_scene("SELECT * FROM ti"))
def q_to_impute(spark, d):
    return rc.impute_table(rc.tables(spark, d))


_FILLED_ALL = o.median_fill_ctes("ti", "clear", "fa")
_FILLED_SEL = ("SELECT f_B02 AS B02, f_B03 AS B03, f_B04 AS B04, B05, NDVI, X, Y, DOY, PID FROM fa "
               "WHERE f_B02 IS NOT NULL AND f_B03 IS NOT NULL AND f_B04 IS NOT NULL")


@query("inference_all", o.with_scene(
    f"{_FILLED_SEL} UNION ALL SELECT * FROM clear ORDER BY Y, X, DOY", _FILLED_ALL))
def q_inference_all(spark, d):
    t = rc.tables(spark, d)
    imputed = fill.impute(rc.impute_table(t), t.clear)
    train, test = sc.aoi_holdout(t.clear, DOY, X1, Y1, X2, Y2)
    return sc.inference_all(imputed, train, test)


@query("inference_clear", o.with_scene(
    f"{_FILLED_SEL} UNION ALL SELECT * FROM clear ORDER BY Y, X, DOY", _FILLED_ALL))
def q_inference_clear(spark, d):
    t = rc.tables(spark, d)
    return sc.inference_clear(fill.impute(rc.impute_table(t), t.clear), t.clear)


@query("pixel_ids", o.with_scene("SELECT DISTINCT X, Y, PID FROM pid"))
def q_pixel_ids(spark, d):
    """The numbered distinct (X, Y) keys themselves: no join back, no second distinct."""
    from tessera.operators.ids import number_sorted
    numbered, _ = number_sorted(_nulled(spark, d).select("X", "Y").distinct(), ["X", "Y"], "PID")
    return numbered


@query("box_size", o.with_scene(
    "SELECT DOY, max(X) - min(X) + 1 AS box_x, max(Y) - min(Y) + 1 AS box_y FROM s0 GROUP BY DOY"))
def q_box_size(spark, d):
    return sc.box_size(_nulled(spark, d))


@query("sort_raster", o.with_scene("SELECT * FROM data ORDER BY Y, X, DOY"))
def q_sort_raster(spark, d):
    return sc.sort_raster(rc.prepared(spark, d))


# ------------------------------------------------------------------ joins and fill

_TID = f"tid AS (SELECT * FROM ti WHERE DOY = {DOY})"
# Imputer restricted to the pixel context: rows of pixels without clear
# data are skipped, which exercises the skipped-row paths.
_PIX_ONLY = (("PID",),)
_PIX_FILL = o.median_fill_ctes("tid", "clear", "fp", contexts=_PIX_ONLY)
_PIX_OUT = ("po AS (SELECT PID, DOY, f_B02 AS B02, f_B03 AS B03, f_B04 AS B04 FROM fp "
            "WHERE f_B02 IS NOT NULL AND f_B03 IS NOT NULL AND f_B04 IS NOT NULL)")


def _pixel_imputed(t):
    todo = rc.impute_table(t).filter(F.col("DOY") == DOY)
    out = fill.impute(todo.select("PID", "DOY", *BANDS), t.clear, contexts=_PIX_ONLY)
    return todo, out


@query("merge_overwrite", o.with_scene(
    "SELECT po.B02, po.B03, po.B04, tid.B05, tid.NDVI, tid.X, tid.Y, tid.DOY, tid.PID "
    "FROM tid LEFT JOIN po USING (PID, DOY)", ",\n".join([_TID, _PIX_FILL, _PIX_OUT])))
def q_merge_overwrite(spark, d):
    todo, out = _pixel_imputed(rc.tables(spark, d))
    return fill.merge_overwrite(todo, out)


@query("rows_not_imputed", o.with_scene(
    "SELECT * FROM tid WHERE NOT EXISTS (SELECT 1 FROM po WHERE po.PID = tid.PID AND po.DOY = tid.DOY)",
    ",\n".join([_TID, _PIX_FILL, _PIX_OUT])))
def q_rows_not_imputed(spark, d):
    todo, out = _pixel_imputed(rc.tables(spark, d))
    return fill.rows_not_imputed(todo, out)


@query("recovered_scene", o.with_scene(
    "SELECT CASE WHEN po.PID IS NULL THEN tid.B02 ELSE po.B02 END AS B02, "
    "CASE WHEN po.PID IS NULL THEN tid.B03 ELSE po.B03 END AS B03, "
    "CASE WHEN po.PID IS NULL THEN tid.B04 ELSE po.B04 END AS B04, "
    "tid.B05, tid.NDVI, tid.X, tid.Y, tid.DOY, tid.PID FROM tid LEFT JOIN po USING (PID, DOY) "
    f"UNION ALL SELECT * FROM clear WHERE DOY = {DOY} ORDER BY Y, X, DOY",
    ",\n".join([_TID, _PIX_FILL, _PIX_OUT])))
def q_recovered_scene(spark, d):
    return rc.recover_with(
        spark, d, lambda rows, train: fill.impute(rows, train, contexts=_PIX_ONLY))


_REC_FILL = o.median_fill_ctes("tid", "clear", "fr")
_OK = "f_B02 IS NOT NULL AND f_B03 IS NOT NULL AND f_B04 IS NOT NULL"


@query("recover_doy", o.with_scene(
    "SELECT " + ", ".join(f"CASE WHEN {_OK} THEN f_{b} ELSE {b} END AS {b}" for b in BANDS)
    + f", B05, NDVI, X, Y, DOY, PID FROM fr UNION ALL SELECT * FROM clear WHERE DOY = {DOY} "
    "ORDER BY Y, X, DOY", ",\n".join([_TID, _REC_FILL])))
def q_recover_doy(spark, d):
    return rc.recover_doy(spark, d)


@query("impute_median", o.with_scene(_FILLED_SEL, _FILLED_ALL))
def q_impute_median(spark, d):
    t = rc.tables(spark, d)
    return fill.impute(rc.impute_table(t), t.clear)


# Further query groups register themselves on import.
from tessera.plans import q_metrics  # noqa: E402,F401
from tessera.plans import q_text  # noqa: E402,F401
from tessera.plans import q_raster_log  # noqa: E402,F401
from tessera.plans import q_tokens  # noqa: E402,F401
from tessera.plans import q_fill  # noqa: E402,F401
