"""Distribution and evaluation metrics as Spark aggregations.

Every metric is a single (partial, map-side) aggregation; nothing is
collected to the driver.  Results are one-row DataFrames (or one row per
group / output).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import col_


def value_dist(df: DataFrame, col: str) -> DataFrame:
    """Normalised value counts, nulls excluded: (value, n, p)."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(
        F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("p", F.col("n") / total)


def missing_counts(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Missing cells per row plus the total over the table (scalar subquery)."""
    per_row = df.select(*keys, sum(F.col(c).isNull().cast("int") for c in cols).alias("n_missing"))
    total = per_row.agg(F.sum("n_missing").cast("long")).scalar()
    return per_row.withColumn("total_missing", total)


def mae(df: DataFrame, pred: str, ref: str, weight: str | None = None, digits: int = 9) -> DataFrame:
    """Mean absolute error, optionally weighted by a column."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    err = F.abs(F.col(pred).cast("double") - F.col(ref).cast("double"))
    return df.agg(F.round(F.sum(w * err) / F.sum(w), digits).alias("mae"))


def mae_multi(df: DataFrame, preds: str, refs: str, weight: str | None = None,
              output_weights: list[float] | None = None, digits: int = 9) -> DataFrame:
    """Multi-output MAE over array columns.

    Returns one row per output (``output`` = o0, o1, ...: the raw values)
    plus a row ``uniform_average`` (or ``weighted_average`` with
    ``output_weights``).  Outputs are exploded with their position, so each
    output's sum is an ordinary grouped aggregate.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pairs = df.select(w.alias("_w"), F.posexplode(F.arrays_zip(F.col(preds).alias("p"),
                                                               F.col(refs).alias("r"))).alias("i", "pr"))
    per = pairs.groupBy("i").agg(
        (F.sum(F.col("_w") * F.abs(F.col("pr.p").cast("double") - F.col("pr.r").cast("double")))
         / F.sum("_w")).alias("m"))
    raw = per.select(F.concat(F.lit("o"), F.col("i").cast("string")).alias("output"),
                     F.round("m", digits).alias("mae"))
    if output_weights:
        ow = F.element_at(F.array(*[F.lit(float(x)) for x in output_weights]), F.col("i") + 1)
        avg = per.agg((F.sum(ow * F.col("m")) / F.lit(float(sum(output_weights)))).alias("m"))
        label = "weighted_average"
    else:
        avg = per.agg(F.avg("m").alias("m"))
        label = "uniform_average"
    return raw.unionByName(avg.select(F.lit(label).alias("output"), F.round("m", digits).alias("mae")))


def accuracy(df: DataFrame, pred, ref, weight: str | None = None, normalize: bool = True,
             digits: int = 9) -> DataFrame:
    """Share (or weighted count) of rows whose prediction equals the reference.

    Array columns compare as a whole (multilabel: all labels equal).
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    hit = F.when(col_(pred) == col_(ref), F.lit(1.0)).otherwise(F.lit(0.0))
    num = F.sum(w * hit)
    val = num / F.sum(w) if normalize else num
    return df.agg(F.round(val, digits).alias("accuracy"))


def prf_weighted(df: DataFrame, pred: str, ref: str, digits: int = 9) -> DataFrame:
    """Support-weighted precision, recall and F1 (zero division gives 0).

    Confusion counts per class come from two grouped counts joined on the
    class (one row per class), then one weighted aggregate.
    """
    tp_fn = df.groupBy(F.col(ref).alias("cls")).agg(
        F.count(F.lit(1)).alias("support"),
        F.sum((F.col(pred) == F.col(ref)).cast("long")).alias("tp"))
    pred_n = df.groupBy(F.col(pred).alias("cls")).agg(F.count(F.lit(1)).alias("npred"))
    per = tp_fn.join(pred_n, "cls", "full").na.fill(0, ["support", "tp", "npred"])
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("npred").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    per = per.select("support", prec.alias("pr"), rec.alias("rc"))
    f1 = F.when(F.col("pr") + F.col("rc") > 0,
                F.lit(2.0) * F.col("pr") * F.col("rc") / (F.col("pr") + F.col("rc"))).otherwise(F.lit(0.0))
    s = F.sum("support").cast("double")
    return per.agg(
        F.round(F.sum(F.col("support") * F.col("pr")) / s, digits).alias("precision"),
        F.round(F.sum(F.col("support") * F.col("rc")) / s, digits).alias("recall"),
        F.round(F.sum(F.col("support") * f1) / s, digits).alias("f1"),
    )


def l1_l2(truth: DataFrame, imputed: DataFrame, keys=("PID", "DOY"), bands=("B02", "B03", "B04"),
          digits: int = 6) -> DataFrame:
    """Mean per-row L1 and L2 distance between truth and imputed bands.

    Rows are aligned by key (not position); a NaN-free mean over matched
    rows, with matched and unmatched counts reported alongside.
    """
    keys = list(keys)
    t = truth.select(*keys, *[F.col(b).cast("double").alias(f"t_{b}") for b in bands])
    i = imputed.select(*keys, F.lit(1).alias("_hit"), *[F.col(b).cast("double").alias(f"i_{b}") for b in bands])
    j = t.join(i, keys, "left")
    diffs = [F.col(f"t_{b}") - F.col(f"i_{b}") for b in bands]
    l1 = sum(F.abs(d) for d in diffs)
    l2 = F.sqrt(sum(d * d for d in diffs))
    return j.agg(
        F.round(F.coalesce(F.avg(l1), F.lit(0.0)), digits).alias("L1"),
        F.round(F.coalesce(F.avg(l2), F.lit(0.0)), digits).alias("L2"),
        F.count("_hit").alias("n_matched"),
        F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).cast("long").alias("n_unmatched"),
    )


def band_histogram(df: DataFrame, col: str, bins: int = 256) -> DataFrame:
    """Histogram with ``bins`` equal bins between min and max; last bin closed; empty bins count 0.

    Min and max are scalar subqueries; the bin is computed per row and
    counted with one grouped aggregate.
    """
    mm = df.agg(F.min(col).cast("double").alias("mn"), F.max(col).cast("double").alias("mx"))
    mn = mm.select("mn").scalar()
    mx = mm.select("mx").scalar()
    v = F.col(col).cast("double")
    raw = F.floor((v - mn) * F.lit(float(bins)) / F.when(mx > mn, mx - mn).otherwise(F.lit(1.0)))
    b = F.least(raw.cast("int"), F.lit(bins - 1))
    counts = df.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
