"""SQL building blocks for the DuckDB oracle queries.

Each oracle query is plain SQL over the driver's views; the scene chain
below mirrors ``sources.scene`` + ``operators.scene`` step by step.
"""

from __future__ import annotations

from tessera.functions.expr import DEFAULT_DOYS, REFLECT_MAX, REFLECT_MIN, REFLECT_SCALE
from tessera.sources.scene import NX, NY, scene_sql

RAW_COLS = ["X", "Y", "DOY", "B02", "B03", "B04", "B05", "cloud", "adj_cloud", "cloud_shadow",
            "snow_ice", "water"]
S12 = "B02, B03, B04, B05, NDVI, cloud, adj_cloud, cloud_shadow, X, Y, DOY, PID"
T9 = ["B02", "B03", "B04", "B05", "NDVI", "X", "Y", "DOY", "PID"]


def not_null_all(cols) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in cols)


def any_null_sql(cols) -> str:
    return "(" + " OR ".join(f"{c} IS NULL" for c in cols) + ")"


def cast9(src: str) -> str:
    parts = [c if c == "NDVI" else f"TRY_CAST({c} AS INTEGER) AS {c}" for c in T9]
    return f"SELECT {', '.join(parts)} FROM {src}"


def scene_ctes(nx: int = NX, ny: int = NY, doys=DEFAULT_DOYS) -> str:
    """``WITH`` body defining scene, s0 (nulls), s1 (NDVI), pid, data, the
    12-column splits and their 9-column casts."""
    s12 = S12.split(", ")
    nulls = ", ".join(f"NULLIF({c}, -9999) AS {c}" for c in RAW_COLS)
    doy_list = ", ".join(str(d) for d in doys)
    return f"""scene AS ({scene_sql(nx, ny)}),
s0 AS (SELECT {nulls} FROM scene),
s1 AS (SELECT *, (CAST(B05 AS DOUBLE) - CAST(B04 AS DOUBLE))
          / NULLIF(CAST(B05 AS DOUBLE) + CAST(B04 AS DOUBLE), 0) AS NDVI FROM s0),
pid AS (SELECT *, CAST(dense_rank() OVER (ORDER BY X, Y) - 1 AS BIGINT) AS PID FROM s1),
data AS (SELECT {S12} FROM pid WHERE DOY IN ({doy_list})),
missing12 AS (SELECT * FROM data WHERE {any_null_sql(s12)}),
clear12 AS (SELECT * FROM data WHERE {not_null_all(s12)}
            AND cloud = 0 AND adj_cloud = 0 AND cloud_shadow = 0),
cloudy12 AS (SELECT * FROM data WHERE {not_null_all(s12)}
             AND (cloud = 1 OR adj_cloud = 1 OR cloud_shadow = 1)),
data9 AS ({cast9('data')}),
missing AS ({cast9('missing12')}),
clear AS ({cast9('clear12')}),
cloudy AS ({cast9('cloudy12')}),
ti AS (SELECT CAST(NULL AS INTEGER) AS B02, CAST(NULL AS INTEGER) AS B03, CAST(NULL AS INTEGER) AS B04,
              CAST(NULL AS INTEGER) AS B05, CAST(NULL AS DOUBLE) AS NDVI, X, Y, DOY, PID FROM cloudy
       UNION ALL SELECT B02, B03, B04, B05, NDVI, X, Y, DOY, PID FROM missing)"""


def with_scene(body: str, extra: str = "", **kw) -> str:
    ctes = scene_ctes(**kw)
    if extra:
        ctes += ",\n" + extra
    return f"WITH {ctes}\n{body}"


def capped(c: str) -> str:
    v = f"(CAST({c} AS DOUBLE) * CAST({REFLECT_SCALE} AS DOUBLE))"
    v = f"(CASE WHEN {v} > CAST({REFLECT_MAX} AS DOUBLE) THEN CAST({REFLECT_MAX} AS DOUBLE) ELSE {v} END)"
    return f"(({v} - CAST({REFLECT_MIN} AS DOUBLE)) / CAST({REFLECT_MAX - REFLECT_MIN!r} AS DOUBLE))"


def pmod256_trunc(expr: str, fill: int) -> str:
    v = f"CAST(trunc({expr}) AS INTEGER)"
    return f"COALESCE(((({v}) % 256) + 256) % 256, {fill})"


def median_fill_ctes(src: str = "ti", train: str = "clear", prefix: str = "f",
                     bands=("B02", "B03", "B04"), contexts=(("PID",), ("DOY",), ())) -> str:
    """CTEs computing back-off medians and the coalesced band values ``f_B0x``."""
    parts = []
    joins = []
    for i, ctx in enumerate(contexts):
        meds = ", ".join(f"median({b}) AS c{i}_{b}" for b in bands)
        if ctx:
            keys = ", ".join(ctx)
            parts.append(f"{prefix}c{i} AS (SELECT {keys}, {meds} FROM {train} GROUP BY {keys})")
            joins.append(f"LEFT JOIN {prefix}c{i} USING ({keys})")
        else:
            parts.append(f"{prefix}c{i} AS (SELECT {meds} FROM {train})")
            joins.append(f"CROSS JOIN {prefix}c{i}")
    coal = ", ".join(
        f"COALESCE({b}, {', '.join(f'c{i}_{b}' for i in range(len(contexts)))}) AS f_{b}" for b in bands
    )
    parts.append(f"{prefix} AS (SELECT {src}.*, {coal} FROM {src} {' '.join(joins)})")
    return ",\n".join(parts)
