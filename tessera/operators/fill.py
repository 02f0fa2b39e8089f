"""Conditional fill from back-off context tables.

A context is a list of key columns, e.g. ``["PID"]``, ``["DOY"]``, ``[]``.
For each context we aggregate the training rows once (partial aggregation
map-side, one shuffle on the context keys) and join the result to the rows
to fill.  Missing cells take the value of the longest context that has
data; present cells are never changed.

* ``median``: exact ``F.median`` per group (its buffer is a value->count map,
  so a hot group costs memory per *distinct* value, not per row); over the
  whole table from value counts that are range-partitioned and summed up, so
  no task holds all values.
* ``mode``: the most frequent value, ties to the smallest, any type that has
  an order.  Contexts of few rows each (pixels) take one shuffle of the rows
  and ``F.mode`` (its buffer is a value->count map as well); the others count
  values first and take the least ``(-count, value)``, so that a group of many
  values is spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import BANDS, all_of, any_of
from tessera.operators.ids import cumulative_sum

DEFAULT_CONTEXTS = (("PID",), ("DOY",), ())
FEW_ROWS = 64  # of a context value on average

def _ctx_name(i: int, band: str) -> str:
    return f"_c{i}_{band}"


def context_table(train: DataFrame, ctx, bands, method: str = "median", i: int = 0) -> DataFrame:
    """One row per context value with the statistic of every band."""
    ctx = list(ctx)
    if method == "median":
        if not ctx:
            return whole_medians(train, bands).select(*[F.col(b).alias(_ctx_name(i, b)) for b in bands])
        return train.groupBy(*ctx).agg(*[F.median(b).alias(_ctx_name(i, b)) for b in bands])
    if method == "mode":
        types = dict(train.dtypes)
        out = None
        for kind in dict.fromkeys(types[b] for b in bands):  # bands of unlike types are counted apart
            part = modes(train, ctx, [b for b in bands if types[b] == kind])
            out = part if out is None else out.join(part, ctx, "full") if ctx else out.join(part, F.lit(True), "full")
        return out.select(*ctx, *[F.col(b).alias(_ctx_name(i, b)) for b in bands])
    raise ValueError(f"unknown method {method!r}")


def modes(train: DataFrame, ctx: list[str], bands: list[str]) -> DataFrame:
    """(ctx..., bands...): the most frequent value of each band, all bands (of one type) in one pass."""
    if ctx:
        rows, groups = train.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(*ctx))).first()
        if rows <= FEW_ROWS * groups:
            return small_group_modes(train, ctx, bands)
    long = train.select(*ctx, *[F.col(b).alias(f"_v_{b}") for b in bands]).unpivot(
        ctx, [f"_v_{b}" for b in bands], "_band", "_value").filter(F.col("_value").isNotNull())
    counts = long.groupBy(*ctx, "_band", "_value").agg(F.count(F.lit(1)).alias("_n"))
    best = counts.groupBy(*ctx, "_band").agg(F.min(F.struct(-F.col("_n"), F.col("_value")))["_value"].alias("_best"))
    wide = best.groupBy(*ctx).pivot("_band", [f"_v_{b}" for b in bands]).agg(F.first("_best"))
    return wide.select(*ctx, *[F.col(f"_v_{b}").alias(b) for b in bands])


def small_group_modes(train: DataFrame, ctx: list[str], bands: list[str]) -> DataFrame:
    """The same for contexts of few rows each: one shuffle of the rows, a value->count map for each band."""
    def value(b):  # -0.0 counts as 0.0
        return F.col(b) + F.lit(0.0).cast(types[b]) if types[b] in ("double", "float") else F.col(b)

    types = dict(train.dtypes)
    known = any_of([F.col(b).isNotNull() for b in bands])
    return train.filter(known).groupBy(*ctx).agg(*[F.mode(value(b), True).alias(b) for b in bands])


def whole_medians(df: DataFrame, bands) -> DataFrame:
    """One row with the exact median (double) of each band over all rows, null for a band without values.

    The counts of the distinct values are range-partitioned by (band, value)
    and summed up; the two values at the middle ranks are picked by their
    running counts.  Nothing but the table of partition sums is global.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("value"))
                                         for b in bands])).alias("c")).select("c.*").filter("value is not null")
    counts = long.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = cumulative_sum(counts, ["value"], "n", "upto", group=["band"])
    total = upto.groupBy("band").agg(F.max("upto").alias("total"))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)  # ranks from 0
    inside = [(F.col("upto") - F.col("n") <= r) & (r < F.col("upto")) for r in (low, high)]
    mid = upto.join(total, "band").agg(*[
        ((F.max(F.when((F.col("band") == b) & inside[0], F.col("value")))
          + F.max(F.when((F.col("band") == b) & inside[1], F.col("value")))) / 2).alias(b) for b in bands])
    return mid


def fit_contexts(train: DataFrame, bands=BANDS, contexts=DEFAULT_CONTEXTS, method: str = "median"):
    """Fitted back-off tables, longest context first."""
    return [(list(ctx), context_table(train, ctx, bands, method, i)) for i, ctx in enumerate(contexts)]


def _attach(rows: DataFrame, fitted, bands) -> DataFrame:
    out = rows
    for i, (ctx, tbl) in enumerate(fitted):
        ctx = list(ctx)
        if not ctx:
            # Global statistics: one scalar subquery returning a struct.
            packed = tbl.select(F.struct(*[_ctx_name(i, b) for b in bands]).alias("s")).scalar()
            out = out.withColumns({_ctx_name(i, b): packed[_ctx_name(i, b)] for b in bands})
        else:
            out = out.join(tbl, ctx, "left")  # AQE broadcasts a table that is small
    return out


def impute(rows: DataFrame, train: DataFrame, bands=BANDS, contexts=DEFAULT_CONTEXTS,
           method: str = "median", keep_unfilled: bool = False) -> DataFrame:
    """Fill missing ``bands`` of ``rows`` from ``train``.

    A row that cannot be completed is omitted (``keep_unfilled=False``) or
    returned unchanged (``keep_unfilled=True``: the merge used by recovery).
    Output keeps the columns of ``rows``; filled bands become doubles for
    ``median``.
    """
    return impute_fitted(rows, fit_contexts(train, bands, contexts, method), bands, keep_unfilled)


def impute_fitted(rows: DataFrame, fitted, bands=BANDS, keep_unfilled: bool = False) -> DataFrame:
    """Fill from already fitted (e.g. saved and reloaded) context tables."""
    joined = _attach(rows, fitted, bands)
    filled = {b: F.coalesce(F.col(b), *[F.col(_ctx_name(i, b)) for i in range(len(fitted))]) for b in bands}
    ok = all_of([v.isNotNull() for v in filled.values()])
    if keep_unfilled:
        cols = [F.when(ok, filled[c]).otherwise(F.col(c)).alias(c) if c in filled else F.col(c)
                for c in rows.columns]
        return joined.select(*cols)
    return joined.filter(ok).select(*[filled[c].alias(c) if c in filled else F.col(c) for c in rows.columns])


def merge_overwrite(left: DataFrame, right: DataFrame, keys=("PID", "DOY"), bands=BANDS) -> DataFrame:
    """Left join on keys; bands are overwritten from the right even when null."""
    keys = list(keys)
    r = right.select(*keys, *[F.col(b).alias(f"_r_{b}") for b in bands])
    j = left.join(r, keys, "left")
    return j.select(*[F.col(f"_r_{c}").alias(c) if c in bands else F.col(c) for c in left.columns])


def rows_not_imputed(left: DataFrame, right: DataFrame, keys=("PID", "DOY")) -> DataFrame:
    """Rows of ``left`` with no match in the model output."""
    return left.join(right.select(*keys), list(keys), "left_anti")


def merge_recovered(left: DataFrame, imputed: DataFrame, keys=("PID", "DOY"), bands=BANDS) -> DataFrame:
    """Imputed rows overwrite their bands; rows the model skipped stay as they are.

    One left join with a match marker replaces join + anti-join + union.
    """
    keys = list(keys)
    r = imputed.select(*keys, F.lit(True).alias("_hit"), *[F.col(b).alias(f"_r_{b}") for b in bands])
    j = left.join(r, keys, "left")
    return j.select(*[
        F.when(F.col("_hit"), F.col(f"_r_{c}")).otherwise(F.col(c)).alias(c) if c in bands else F.col(c)
        for c in left.columns
    ])


def context_counts(train: DataFrame, bands=BANDS, contexts=DEFAULT_CONTEXTS,
                   keys=("PID", "DOY")) -> DataFrame:
    """Counts of every band value by each back-off context, one long table.

    Columns: ``context`` (e.g. ``PID``, ``DOY``, ``all``), the key columns
    (null where not part of the context), ``band``, ``value``, ``n``.
    """
    long = train.unpivot(list(keys), list(bands), "band", "value").filter(F.col("value").isNotNull())
    out = None
    for ctx in contexts:
        ctx = list(ctx)
        g = long.groupBy(*ctx, "band", "value").agg(F.count(F.lit(1)).alias("n"))
        g = g.select(F.lit("_".join(ctx) or "all").alias("context"),
                     *[F.col(k) if k in ctx else F.lit(None).cast(dict(train.dtypes)[k]).alias(k) for k in keys],
                     "band", "value", "n")
        out = g if out is None else out.unionByName(g)
    return out
