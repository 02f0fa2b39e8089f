"""Randomised draws: start samplers, temperature draws and row synthesis.

The neural sampler of the source pipeline is re-aimed at frequency tables:
a draw is an inverse-CDF lookup.  Every value of a group owns an interval
of whole numbers as long as its weight; a draw is a number below the
group's total.  The lookup is an ordered merge: interval starts and draws
are range-partitioned and sorted together, each draw takes the value of the
last start before it as its sorted partition streams by, and one row per
partition is handed on to the next.
Rows out equal rows in, whatever the number of values.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expr import any_null, mix_keys, pick, uniform
from tessera.operators.ids import cumulative_sum, number_sorted, positions
from tessera.operators.prompts import is_number
from tessera.session import reliable_checkpoint

WEIGHT_UNIT = 1 << 36  # weight of a group's most frequent value where the temperature is not 1


def draw_weights(counts: DataFrame, weight: str, group: list[str], temperature: float) -> DataFrame:
    """``counts`` with ``_w``: n at temperature 1, else (n / largest n of the group) ** (1 / T) in units of 2^-36.

    Relative to the largest count nothing overflows at any temperature; a
    value whose share is below a unit has no weight and is left out.
    """
    if temperature <= 0:
        raise ValueError(f"temperature {temperature} is not above 0")
    n = F.col(weight)
    if temperature == 1.0:
        return counts.withColumn("_w", n.cast("long"))
    if group:
        top = counts.groupBy(*group).agg(F.max(n).alias("_top"))
        rows, most = counts.join(top, group), F.col("_top")
    else:
        rows, most = counts, counts.agg(F.max(n)).scalar()
    share = F.pow(n.cast("double") / most.cast("double"), 1.0 / temperature)
    rows = rows.withColumn("_w", F.floor(share * WEIGHT_UNIT + 0.5).cast("long")).filter(F.col("_w") > 0)
    return rows.drop("_top")


def intervals(counts: DataFrame, value: str, weight: str, group: list[str], temperature: float = 1.0):
    """(group..., value, _w, _from): each value's weight and where its interval starts; and (group..., _total).

    Values are ordered by count descending, then value.
    """
    t = draw_weights(counts, weight, group, temperature).select(*group, value, "_w", (-F.col(weight)).alias("_neg"))
    cum = cumulative_sum(t, ["_neg", value], "_w", "_cum", group=group)
    totals = cum.groupBy(*group).agg(F.max("_cum").alias("_total"))
    return cum.select(*group, value, "_w", (F.col("_cum") - F.col("_w")).alias("_from")), totals


def interval_lookup(rows: DataFrame, starts: DataFrame, value: str, out: str, spread: list[str]) -> DataFrame:
    """``rows`` (_g, _pos, ...) with the value of the last start (_g, _from) at or before each place.

    Every group of ``rows`` has a start at 0.  Rows of one place are spread
    over partitions by the columns ``spread``.
    """
    types, kind = dict(rows.dtypes), dict(starts.dtypes)[value]
    others = [c for c in rows.columns if c not in ("_g", "_pos")]
    both = starts.select("_g", F.col("_from").alias("_pos"), F.lit(0).alias("_kind"), F.col(value).alias("_v"),
                         *[F.lit(None).cast(types[c]).alias(c) for c in others]).unionByName(
        rows.select("_g", "_pos", F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_v"), *others))
    order = ["_g", "_pos", "_kind", *spread]
    # one job samples the range bounds, another writes: keep the rows for both
    both = both.persist(StorageLevel.MEMORY_AND_DISK)
    ranged = reliable_checkpoint(both.repartitionByRange(*order).sortWithinPartitions(*order)) \
        .withColumn("_part", F.spark_partition_id())
    both.unpersist()
    last = ranged.filter("_kind = 0 AND _v IS NOT NULL").groupBy("_part").agg(F.max(F.struct("_g", "_pos", "_v")).alias("m"))
    ends = {r["_part"]: r["_v"] for r in last.select("_part", "m._v").collect()}  # one row per partition
    carry, held = [], None
    for part in range(ranged.rdd.getNumPartitions()):
        carry.append(held)
        held = ends.get(part, held)

    def run(batches):
        """The draws of a sorted partition, each with the value of the last start before it."""
        import numpy as np
        import pyarrow as pa

        held = None
        for b in batches:
            if not b.num_rows:
                continue
            values = b.column("_v")
            if held is None:
                held = pa.array([carry[b.column("_part")[0].as_py()]], values.type)
            draws = b.column("_kind").to_numpy() == 1
            known = ~draws & values.is_valid().to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(known, np.arange(1, b.num_rows + 1), 0))
            values = pa.concat_arrays([held, values]).take(pa.array(at))
            held, draws = values[-1:], pa.array(draws)
            yield pa.RecordBatch.from_arrays([*(b.column(c).filter(draws) for c in others), values.filter(draws)],
                                             names=[*others, out])

    schema = T.StructType([T.StructField(c, ranged.schema[c].dataType) for c in others]
                          + [T.StructField(out, ranged.schema["_v"].dataType)])
    return ranged.mapInArrow(run, schema)


def place(u, total):
    """A uniform number in [0, 1) as a place below ``total``."""
    return F.least(F.floor(u * total.cast("double")).cast("long"), total - 1)


def cdf_table(counts: DataFrame, value: str, weight: str = "n", temperature: float = 1.0) -> DataFrame:
    """(value, w, lo, hi): the shares of a count table as intervals of [0, 1), the most frequent value first."""
    starts, totals = intervals(counts, value, weight, [], temperature)
    total = totals.select("_total").scalar().cast("double")
    return starts.select(value, F.col("_w").alias("w"), (F.col("_from").cast("double") / total).alias("lo"),
                         ((F.col("_from") + F.col("_w")).cast("double") / total).alias("hi"))


def draw(rows: DataFrame, counts: DataFrame, u: str, value: str, out: str, temperature: float = 1.0) -> DataFrame:
    """``rows`` (their key first) with a value of the count table (``value``, n) for each number ``u`` in [0, 1)."""
    starts, totals = intervals(counts.filter(F.col(value).isNotNull()), value, "n", [], temperature)
    at = rows.withColumn("_pos", place(F.col(u), totals.select("_total").scalar()))
    return interval_lookup(at.withColumn("_g", F.lit(0)), starts.withColumn("_g", F.lit(0)), value, out, rows.columns[:1])


# ------------------------------------------------------------------ K1 start samplers

def start_categorical(rows: DataFrame, key: str, col: str, counts: DataFrame, seed: int = 42) -> DataFrame:
    """Weighted draw with replacement of a start value; text ``"col is v,"``."""
    r = rows.select(key, uniform(F.col(key), seed).alias("_u"))
    d = draw(r, counts, "_u", "value", "value")
    return d.select(key, F.concat(F.lit(col + " is "), F.col("value").cast("string"), F.lit(",")).alias("start"))


def start_continuous(rows: DataFrame, key: str, col: str, values: DataFrame, seed: int = 42,
                     decimals: int = 5) -> DataFrame:
    """Resample observed values uniformly (no noise); text ``"col is 1.23450,"``."""
    numbered, n = number_sorted(values.select(col, "_k"), [col, "_k"], "_i")
    r = rows.select(key, F.floor(uniform(F.col(key), seed) * F.lit(float(n))).alias("_i"))
    j = r.join(numbered.select("_i", col), "_i")
    return j.select(key, F.concat(F.lit(col + " is "), F.format_string(f"%.{decimals}f", F.col(col)),
                                  F.lit(",")).alias("start"))


def start_random(rows: DataFrame, key: str, cols: list[str], seed: int = 42) -> DataFrame:
    """A random column name as the start: ``"col is "``."""
    names = F.array(*[F.lit(c) for c in cols])
    name = F.element_at(names, (pick(F.col(key), len(cols), seed) + 1).cast("int"))
    return rows.select(key, F.concat(name, F.lit(" is ")).alias("start"))


def fit_record(train: DataFrame, conditional: str | None = None) -> dict:
    """What a fit leaves for later draws: columns, numeric columns, the conditional column and its distribution.

    The conditional column is the last one unless named.  Its distribution is
    chosen by type: ``continuous`` for numbers, else ``categorical``; both
    are kept as counts of the values that are not null.
    """
    conditional = conditional or train.columns[-1]
    if conditional not in train.columns:
        raise ValueError(f"{conditional!r} is no column of the training rows")
    numeric = [c for c, t in train.dtypes if is_number(t)]
    counts = (train.filter(F.col(conditional).isNotNull()).groupBy(F.col(conditional).alias("value"))
              .agg(F.count(F.lit(1)).alias("n")))
    return {"columns": train.columns, "numeric": numeric, "conditional": conditional,
            "kind": "continuous" if conditional in numeric else "categorical", "counts": counts}


def start_from_record(rows: DataFrame, key: str, record: dict, seed: int = 42, decimals: int = 5) -> DataFrame:
    """Start texts drawn from the fitted column: ``"Sex is female,"`` or ``"Age is 26.00000,"``."""
    u = rows.select(key, uniform(F.col(key), seed).alias("_u"))
    drawn = draw(u, record["counts"], "_u", "value", "value")
    text = F.format_string(f"%.{decimals}f", F.col("value").cast("double")) if record["kind"] == "continuous" \
        else F.col("value").cast("string")
    return drawn.select(key, F.concat(F.lit(record["conditional"] + " is "), text, F.lit(",")).alias("start"))


def choose_sampler(col: str | None = None, dist=None, record: dict | None = None):
    """Pick the start sampler: categorical for a count table, continuous for a
    value column; name and distribution go together.  Without both, the
    column of the last fit decides, and without a fit a random column."""
    if (col is None) != (dist is None):
        raise ValueError("start column name and distribution must be given together")
    if col is None:
        return record["kind"] if record else "random"
    if isinstance(dist, DataFrame):
        cols = set(dist.columns)
        if {"value", "n"} <= cols:
            return "categorical"
        if col in cols:
            return "continuous"
    raise ValueError("distribution must be a (value, n) count table or a value column table")


def start_texts(rows: DataFrame, key: str, record: dict | None = None, cols: list[str] | None = None,
                seed: int = 42) -> DataFrame:
    """Start texts by the sampler that :func:`choose_sampler` picks without a column."""
    if choose_sampler(record=record) == "random":
        return start_random(rows, key, cols or [], seed)
    return start_from_record(rows, key, record, seed)


# ------------------------------------------------------------------ K5 temperature draw

def context_levels(train: DataFrame, bands: list[str], contexts) -> DataFrame:
    """(_g, _value, n): counts of every band's values in each context, one after the other rolled up.

    ``_g`` names level, context and band.  A context whose keys are part of
    the one before is summed from its counts, not from the rows.
    """
    names = sorted({c for ctx in contexts for c in ctx})
    long = (train.select(*names, *[F.col(b).cast("double").alias(b) for b in bands])
            .unpivot(names, list(bands), "_band", "_value").filter(F.col("_value").isNotNull())) if names else \
        train.select(F.explode(F.array(*[F.struct(F.lit(b).alias("_band"), F.col(b).cast("double").alias("_value"))
                                         for b in bands])).alias("c")).select("c.*").filter("_value is not null")
    out, above, held = None, None, None
    for level, ctx in enumerate(contexts):
        rolled = above is not None and set(ctx) <= above
        src, n = (held, F.sum("n")) if rolled else (long, F.count(F.lit(1)))
        held, above = src.groupBy(*ctx, "_band", "_value").agg(n.alias("n")), set(ctx)
        part = held.dropna(subset=list(ctx)) if ctx else held
        part = part.select(level_key(level, ctx).alias("_g"), "_value", "n")
        out = part if out is None else out.unionByName(part)
    return out


def level_key(level: int, ctx):
    """Number of the group of a level, band and context: a 64-bit hash, so that groups sort and join as numbers.

    Among n groups two share one with probability n * n / 2**65.  Null where
    a key of the context is null: such a row matches nothing on this level.
    """
    return F.when(~any_null(ctx), F.xxhash64(F.lit(level), F.col("_band"), *[F.col(c) for c in ctx]))


def impute_draw(rows: DataFrame, train: DataFrame, key: str, bands: list[str],
                contexts=(("DOY",), ()), temperature: float = 1.0, seed=42, stream: int = 1) -> DataFrame:
    """Fill missing cells by sampling from context counts with weights n^(1/T).

    All bands and contexts go through one pass: counts by context, rolled up
    from one to the next, intervals of all groups in one cumulative table,
    and one ordered merge that draws every missing cell from the longest
    context that has data.  Cells are pivoted back to columns, keyed by
    ``key``.  Band i draws from hash stream ``stream + i``, so bands are
    independent of each other.
    """
    contexts = [list(c) for c in contexts]
    ctx_cols = sorted({c for ctx in contexts for c in ctx})
    counts = reliable_checkpoint(context_levels(train, bands, contexts))
    starts, totals = intervals(counts, "_value", "n", ["_g"], temperature)
    cell = F.explode(F.array(*[F.struct(F.lit(b).alias("_band"), F.lit(i).alias("_bi"),
                                        F.col(b).cast("double").alias("_orig")) for i, b in enumerate(bands)]))
    types = dict(train.dtypes)  # keys are hashed: both sides need one type
    cells = (rows.select(key, *[F.col(c).cast(types[c]).alias(c) for c in ctx_cols], cell.alias("_c"))
             .select(key, *ctx_cols, "_c._band", "_c._bi", "_c._orig")
             .filter(F.col("_orig").isNull())
             .withColumn("_u", F.coalesce(*[F.when(F.col("_bi") == i, uniform(F.col(key), seed, stream + i))
                                            for i in range(len(bands))])))
    for level, ctx in enumerate(contexts):
        own = totals.select(F.col("_g").alias(f"_g{level}"), F.col("_total").alias(f"_t{level}"))
        cells = cells.withColumn("_g", level_key(level, ctx)).join(own, F.col("_g") == F.col(f"_g{level}"), "left")
    levels = range(len(contexts))
    cells = cells.select(key, "_band", F.coalesce(*[F.col(f"_g{i}") for i in levels]).alias("_g"), place(
        F.col("_u"), F.coalesce(*[F.col(f"_t{i}") for i in levels])).alias("_pos")).filter("_g is not null")
    drawn = interval_lookup(cells, starts, "_value", "_drawn", [key])
    wide = drawn.groupBy(key).pivot("_band", list(bands)).agg(F.first("_drawn"))
    wide = wide.select(key, *[F.col(b).alias(f"_w_{b}") for b in bands])
    out = rows.join(wide, key, "left")
    return out.select(*[F.coalesce(F.col(c).cast("double"), F.col(f"_w_{c}")).alias(c) if c in bands
                        else F.col(c) for c in rows.columns])


# ------------------------------------------------------------------ K6 synthesis

def draw_number(cols: list[str], seed: int):
    """63 hash bits of several key columns (portable: ``mix`` twice)."""
    return F.shiftleft(mix_keys(cols, seed, 1).bitwiseAND(F.lit((1 << 31) - 1)), 32).bitwiseOR(mix_keys(cols, seed, 2))


def next_band(rows: DataFrame, tree: DataFrame, start_col: str, before: list[str], band: str, seed: int,
              stream: int) -> DataFrame:
    """``rows`` (with _draw) and a value of ``band`` given the start column and the bands ``before`` it."""
    contexts = [list(c) for c in dict.fromkeys([(start_col, *before), (start_col,), ()])]
    out, held = None, tree.filter(F.col(band).isNotNull()).withColumn("_band", F.lit(band)) \
        .withColumn("_value", F.col(band))
    weight = "_n"
    for level, ctx in enumerate(contexts):  # each level is summed from the one before
        held = held.groupBy(*ctx, "_band", "_value").agg(F.sum(weight).alias("n"))
        weight = "n"
        part = held.select(level_key(level, ctx).alias("_g"), "_value", "n").filter("_g is not null")
        out = part if out is None else out.unionByName(part)
    starts, totals = intervals(reliable_checkpoint(out), "_value", "n", ["_g"])
    cells = rows.withColumn("_band", F.lit(band)).withColumn("_u", uniform(F.col("_draw"), seed, stream))
    for level, ctx in enumerate(contexts):
        own = totals.select(F.col("_g").alias(f"_g{level}"), F.col("_total").alias(f"_t{level}"))
        cells = cells.withColumn("_g", level_key(level, ctx)).join(own, F.col("_g") == F.col(f"_g{level}"), "left")
    levels = range(len(contexts))
    cells = cells.select(*rows.columns, F.coalesce(*[F.col(f"_g{i}") for i in levels]).alias("_g"), place(
        F.col("_u"), F.coalesce(*[F.col(f"_t{i}") for i in levels])).alias("_pos")).filter("_g is not null")
    return interval_lookup(cells, starts, "_value", band, ["_draw"])


def synthesize(spark_rows: DataFrame, key: str, train: DataFrame, start_col: str, bands: list[str],
               n: int, seed: int = 42, max_rounds: int = 14) -> DataFrame:
    """Draw exactly ``n`` rows: the start column from its marginal, then each band
    given the start column and the bands drawn before it (back-off: the start
    column, then all rows).

    The bands are one walk down a tree of counts (start, first band, second
    band, ...): a band takes one table of intervals and one merge, whose
    groups are the prefixes of the rows drawn so far and the two shorter
    contexts.  A round draws for every key as often as rows are missing; ``max_rounds``
    rounds in a row without a complete row raise an error.
    """
    keys = reliable_checkpoint(spark_rows.select(key))
    have = keys.count()
    if n and not have:
        raise ValueError("no keys to draw for")
    counts = train.groupBy(F.col(start_col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # what all bands need: the counts of whole rows, of which every prefix is rolled up
    tree = reliable_checkpoint(train.select(start_col, *[F.col(b).cast("double").alias(b) for b in bands])
                               .groupBy(start_col, *bands).agg(F.count(F.lit(1)).alias("_n")))
    got, total, fruitless, rnd = None, 0, 0, 0
    while total < n or got is None:
        copies = max(1, -(-(n - total) // max(1, have)))
        r = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy"))
        r = r.withColumn("_draw", draw_number([key, "_copy"], rnd))
        rows = draw(r.withColumn("_u", uniform(F.col("_draw"), seed)), counts, "_u", "value", start_col)
        rows = rows.select(key, "_copy", "_draw", start_col)
        for i, b in enumerate(bands):
            rows = next_band(rows, tree, start_col, bands[:i], b, seed, i + 1)
        rows = reliable_checkpoint(rows.dropna(how="any").drop("_draw").withColumn("_round", F.lit(rnd)))
        k = rows.count()
        got = rows if got is None else got.unionByName(rows)
        total, rnd = total + k, rnd + 1
        fruitless = fruitless + 1 if k == 0 else 0
        if fruitless >= max_rounds:
            raise RuntimeError(f"{total} of {n} rows after {rnd} rounds, the last {fruitless} without any")
    numbered = positions(got, ["_round", "_copy", key], "_row")
    return numbered.filter(F.col("_row") < n).drop("_round", "_copy", "_row")
