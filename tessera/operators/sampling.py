"""Deterministic sampling, splits, row selection and shuffles.

Randomness is a hash of stable keys and a seed (never ``rand()``), so a
result does not depend on partitioning or task retries.  An exact cut by
hash rank counts the hashes by their high bits, finds the bucket that
holds the rank, ranks only that bucket and filters by the threshold: no
sort, copy or numbering of the table.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import mix, mix_keys
from tessera.operators.ids import positions

BUCKET_SHIFT = 16  # 2^16 buckets of the 32-bit hash


def hashed(df: DataFrame, h: Column) -> DataFrame:
    """``df`` with the hash in ``_h``, computed once per row.

    The added zero is not deterministic for Catalyst, which therefore keeps
    filters on ``_h`` above this projection instead of copying the hash into
    them, where each of its parts would be computed again and again.
    """
    return df.withColumn("_h", h + F.monotonically_increasing_id() * F.lit(0))


def rank_below(df: DataFrame, keys: list[str], cut) -> Column:
    """Condition that holds for the first rows of a hashed table in order of (_h, keys).

    ``cut`` is their number, or gives it for the number of all rows.  Counts
    by the high bits find the bucket of the cut, counts of the hashes in that
    bucket the hash; only where rows of that one hash are parted are they
    ordered by their keys.
    """

    def find(counts, cut):
        for value, n in sorted(counts):
            if n >= cut:
                return value, cut, n
            cut -= n
        return None, cut, 0

    bucket = F.shiftright("_h", BUCKET_SHIFT)
    counts = [(r[0], r[1]) for r in df.groupBy(bucket.alias("b")).count().collect()]
    if any(b is None for b, _ in counts):
        raise ValueError(f"rows with a null key among {keys}: the order of their hash is not defined")
    cut = cut(sum(n for _, n in counts)) if callable(cut) else cut
    if cut <= 0:
        return F.lit(False)
    place, cut, _ = find(counts, cut)
    if place is None:
        return F.lit(True)
    inside = df.filter(bucket == place)
    value, cut, n = find([(r[0], r[1]) for r in inside.groupBy("_h").count().collect()], cut)
    if n == cut:
        return F.col("_h") <= value
    last = inside.filter(F.col("_h") == value).select(*keys).orderBy(*keys).limit(cut) \
        .agg(F.max(F.struct(*keys)).alias("m")).first()["m"]
    types = dict(df.dtypes)
    upto = F.struct(*[F.lit(last[k]).cast(types[k]).alias(k) for k in keys])
    return (F.col("_h") < value) | ((F.col("_h") == value) & (F.struct(*keys) <= upto))


def exact_split(df: DataFrame, keys: list[str], test_frac: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train/test split with exactly ceil(f * n) test rows, the first in order of (hash, keys).

    ``keys`` are unique; a null key raises an error.
    """
    rows = hashed(df, mix_keys(keys, seed))
    test = rank_below(rows, keys, lambda n: int(-(-Fraction(str(test_frac)) * n // 1)))
    return rows.filter(~test).drop("_h"), rows.filter(test).drop("_h")


def shuffle_rows(df: DataFrame, keys: list[str], seed: int = 42) -> DataFrame:
    """Full seeded shuffle: a global sort on a hash of stable keys."""
    return df.orderBy(mix_keys(keys, seed), *keys)


def shuffled_positions(df: DataFrame, keys: list[str], seed: int = 42, out: str = "pos") -> DataFrame:
    """Every row with its place (0-based) in the seeded shuffle."""
    return positions(df.withColumn("_h", mix_keys(keys, seed)), ["_h", *keys], out).drop("_h")


def row_ids(df: DataFrame, order: list[str], out: str = "row_id") -> DataFrame:
    """Positional row numbers (0-based) in a given order, distributed."""
    return positions(df, order, out)


def rows_by_id(df: DataFrame, ids: list[int], id_col: str = "row_id") -> DataFrame:
    """Rows at the listed positions, with the list position (repeats repeat)."""
    spark = df.sparkSession
    lst = spark.createDataFrame([(i, int(v)) for i, v in enumerate(ids)], f"_pos int, {id_col} long")
    return df.join(F.broadcast(lst), id_col).orderBy("_pos")


def row_slice(df: DataFrame, start: int, stop: int, id_col: str = "row_id") -> DataFrame:
    return df.filter((F.col(id_col) >= start) & (F.col(id_col) < stop))


def head_n(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """First n rows in a stable order (top-k: Spark plans TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def balanced_sample(df: DataFrame, cls: str, key: str, n: int, seed: int = 42, classes=(0, 1)) -> DataFrame:
    """N = min(n, n0, n1, ...); N // 2 rows of each class, the first in order of (hash, key).

    A class without rows counts 0, so the sample is empty then.
    """
    rows = hashed(df.filter(F.col(cls).isin(*classes)), mix(F.col(key), seed))
    have = {r[0]: r[1] for r in rows.groupBy(cls).count().collect()}
    per_class = min(n, *(have.get(c, 0) for c in classes)) // 2
    keep = F.lit(False)
    for c in classes:
        own = F.col(cls) == F.lit(c)
        keep = keep | (own & rank_below(rows.filter(own), [key], per_class))
    return rows.filter(keep).drop("_h")


def anchor_series(df: DataFrame, clear: DataFrame, doy: int, seed: int = 42) -> DataFrame:
    """Full series of one seeded anchor pixel among pixels clear on ``doy``.

    The anchor is the pixel with the smallest hash (ties by PID): one
    scalar subquery, then a filter on the whole table.
    """
    cand = clear.filter(F.col("DOY") == doy).select("PID", mix(F.col("PID"), seed).alias("_h"))
    anchor = cand.agg(F.min(F.struct("_h", "PID")).alias("m")).select("m.PID").scalar()
    return df.filter(F.col("PID") == anchor)
