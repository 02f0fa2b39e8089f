"""Registered queries: raster lines and training-log analytics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.expr import BANDS
from tessera.operators import raster as ra, runlog as rl, scene as sc
from tessera.plans import oracle as o
from tessera.plans import recover as rc
from tessera.plans.registry import DOY, _nulled, query
from tessera.session import checkpoint_dir
from tessera.sources.tables import table

# ------------------------------------------------------------------ raster

_BOX = ("box AS (SELECT DOY, min(X) AS x0, max(X) AS x1, min(Y) AS y0, max(Y) AS y1 FROM {src} GROUP BY DOY),\n"
        "lines AS (SELECT DOY, x0, x1, CAST(unnest(range(y0, y1 + 1)) AS INTEGER) AS Y FROM box)")


def _raster_sql(src: str, layers: dict[str, str]) -> str:
    v = "{" + ", ".join(f"'{k}': {e}" for k, e in layers.items()) + "}"
    pl = f"pl AS (SELECT DOY, Y, map_from_entries(list({{'k': X, 'v': {v}}})) AS m FROM {src} GROUP BY DOY, Y)"
    cols = ", ".join(
        f"list_transform(range(x0, x1 + 1), lambda x: map_extract_value(m, CAST(x AS INTEGER)).{k}) AS {k}"
        for k in layers)
    return _BOX.format(src=src) + ",\n" + pl, f"SELECT lines.DOY, lines.Y, x0, {cols} FROM lines LEFT JOIN pl USING (DOY, Y)"


def _stretch_sql(b: str, fill: int = 0) -> str:
    return o.pmod256_trunc(o.capped(b) + " * 255", fill)


def _with_raster(src: str, layers: dict[str, str]) -> str:
    ctes, body = _raster_sql(src, layers)
    return o.with_scene(body, ctes)


@query("raster_rows", _with_raster("s0", {"values": "B02"}))
def q_raster_rows(spark, d):
    return ra.raster_rows(_nulled(spark, d), "B02")


_RGB = {"R": _stretch_sql("B04"), "G": _stretch_sql("B03"), "B": _stretch_sql("B02")}


@query("raster_rgb", _with_raster("s0", _RGB))
def q_raster_rgb(spark, d):
    return ra.raster_rgb(_nulled(spark, d))


@query("raster_layers", _with_raster("s1", {
    **_RGB, "NDVI8": o.pmod256_trunc("NDVI * 255", 255), "cloud": "cloud", "adj_cloud": "adj_cloud",
    "cloud_shadow": "cloud_shadow", "snow_ice": "snow_ice", "water": "water"}))
def q_raster_layers(spark, d):
    return ra.raster_all_layers(sc.with_ndvi(_nulled(spark, d)))


def _recover_cte() -> str:
    from tessera.plans.registry import _OK, _REC_FILL, _TID
    body = ("SELECT " + ", ".join(f"CASE WHEN {_OK} THEN f_{b} ELSE {b} END AS {b}" for b in BANDS)
            + f", B05, NDVI, X, Y, DOY, PID FROM fr UNION ALL SELECT * FROM clear WHERE DOY = {DOY}")
    return ",\n".join([_TID, _REC_FILL, f"rec AS ({body})"])


@query("raster_compare", o.with_scene(
    "SELECT d.X, d.Y, d.DOY, " + ", ".join(f"CAST(d.{b} AS DOUBLE) AS orig_{b}" for b in BANDS) + ", "
    + ", ".join(f"CAST(rec.{b} AS DOUBLE) AS rec_{b}" for b in BANDS) + ", "
    + ", ".join(f"CAST(rec.{b} AS DOUBLE) - CAST(d.{b} AS DOUBLE) AS diff_{b}" for b in BANDS)
    + f" FROM data d JOIN rec ON d.X = rec.X AND d.Y = rec.Y AND d.DOY = rec.DOY WHERE d.DOY = {DOY}",
    _recover_cte()))
def q_raster_compare(spark, d):
    original = rc.prepared(spark, d).filter(F.col("DOY") == DOY)
    return ra.raster_compare(original, rc.recover_doy(spark, d))


# ------------------------------------------------------------------ training log

# Log records derived from events: run = event_id % 4, step = rank of
# event_id within its run, loss = value.
LOG_SQL = ("log AS (SELECT CAST(event_id % 4 AS INTEGER) AS run, CAST(row_number() OVER "
           "(PARTITION BY event_id % 4 ORDER BY event_id) AS BIGINT) AS step, value AS loss FROM events)")


def events_log(spark, d):
    ev = table(spark, d, "events").select(
        (F.col("event_id") % 4).cast("int").alias("run"), "event_id", F.col("value").alias("loss"))
    ranked = rl.record_rank(ev, "event_id")
    return ranked.select("run", F.col("rank").cast("long").alias("step"), "loss")


def _ordered_log(spark, d):
    return rl.ordered_log(events_log(spark, d), f"{checkpoint_dir(spark).rstrip('/')}/ordered-log-{uuid.uuid4().hex}")


@query("log_flatten", "WITH " + LOG_SQL + " SELECT run, step, loss FROM log")
def q_log_flatten(spark, d):
    """Write the log as JSON lines in the shared checkpoint folder, read it back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/runlog-{uuid.uuid4().hex}"
    events_log(spark, d).write.mode("overwrite").json(path)
    return rl.read_log_lines(spark, path).select("run", "step", "loss")


RUN_RECORDS = 500  # records of a run: a state is one JSON object


@query("log_history", f"""
SELECT event_id // {RUN_RECORDS} AS run, CAST(row_number() OVER (PARTITION BY event_id // {RUN_RECORDS}
         ORDER BY event_id) - 1 AS INTEGER) AS idx, event_id % {RUN_RECORDS} AS step, value AS loss,
       CAST(NULL AS DOUBLE) AS epoch, CAST(user_id AS DOUBLE) AS learning_rate FROM events""")
def q_log_history(spark, d):
    """Nested ``log_history`` states of many runs, written to the shared folder, read back and flattened."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/states-{uuid.uuid4().hex}"
    ev = table(spark, d, "events").select(
        F.floor(F.col("event_id") / RUN_RECORDS).cast("long").alias("run"), "event_id",
        F.struct(F.col("user_id").cast("double").alias("learning_rate"), F.col("value").alias("loss"),
                 (F.col("event_id") % RUN_RECORDS).alias("step")).alias("r"))
    states = ev.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("event_id", "r"))).getField("r")
                                   .alias("log_history"))
    states.write.json(path)
    return rl.read_state_lines(spark, path)


@query("stitch_steps", "WITH " + LOG_SQL + """,
runs AS (SELECT run, max(step) AS last_step FROM log GROUP BY run),
sh AS (SELECT run, sum(last_step) OVER (ORDER BY run ROWS UNBOUNDED PRECEDING) - last_step AS shift FROM runs)
SELECT log.run, step, loss, step + shift AS global_step FROM log JOIN sh USING (run)""")
def q_stitch_steps(spark, d):
    return rl.stitch_steps(events_log(spark, d))


@query("loss_delta", "WITH " + LOG_SQL + """
SELECT run, step, loss, loss - COALESCE(lag(loss) OVER (ORDER BY run, step), loss) AS delta FROM log""")
def q_loss_delta(spark, d):
    return rl.loss_delta(_ordered_log(spark, d))


def _tail_sql() -> str:
    parts = [f"SELECT 'n//{k}' AS cut, run, step, loss, pos FROM p WHERE pos >= floor(n / {k})"
             for k in rl.TAIL_DIVISORS]
    parts.append("SELECT 'n//2+n//4' AS cut, run, step, loss, pos FROM p WHERE pos >= floor(n / 2) + floor(n / 4)")
    return ("WITH " + LOG_SQL + ",\np AS (SELECT run, step, loss, row_number() OVER (ORDER BY run, step) - 1 AS pos, "
            "count(*) OVER () AS n FROM log)\n" + " UNION ALL ".join(parts))


@query("log_tail", _tail_sql())
def q_log_tail(spark, d):
    return rl.log_tail(_ordered_log(spark, d))
