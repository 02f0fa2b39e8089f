"""Global numbering without a single-partition window.

``dense_ids`` gives the 0-based rank of each distinct key in sorted order
(the pixel id of a scene); ``positions`` numbers whole rows by a unique
sort key; ``cumulative_sum`` adds up a column in order.  All range-partition
and sort the rows once and write them reliably (range bounds are sampled and
must not change between two uses); a task numbers or adds up its rows in
order, batch by batch, and a table with one row per partition gives the
offsets.  Rows are not shuffled again by their partition.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.expr import any_null
from tessera.session import checkpoint_dir, reliable_checkpoint


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def number_sorted(keys: DataFrame, order: list[str], out: str, n: int | None = None) -> tuple[DataFrame, int]:
    """Number the rows of ``keys`` 0..N-1 in ``order``; returns (numbered, N).

    Work per row is a range shuffle and a sort; only the per-partition count
    table (one row per partition) is combined globally.
    """
    # The range bounds are sampled by one job and the checkpoint written by
    # another: keep the input for both instead of computing it twice.
    src = keys.persist(StorageLevel.MEMORY_AND_DISK)
    # Without an explicit count AQE may coalesce adjacent ranges of small
    # inputs (order is kept); large inputs keep spark.sql.shuffle.partitions.
    byrange = src.repartitionByRange(n, *order) if n else src.repartitionByRange(*order)
    ranged = reliable_checkpoint(byrange.sortWithinPartitions(*order))
    src.unpersist()
    tagged = ranged.select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().alias("_mono"),
    )
    # One count per partition (what zipWithIndex does): bounded by the
    # partition count, never by the rows.  Offsets go back as a broadcast.
    counts = sorted((r[0], r[1]) for r in tagged.groupBy("_part").agg(F.count(F.lit(1))).collect())
    offsets, run = [], 0
    for part, cnt in counts:
        offsets.append((int(part), run))
        run += int(cnt)
    total = run
    spark = keys.sparkSession
    off_df = spark.createDataFrame(offsets or [(0, 0)], "_part int, _off long")
    local = F.col("_mono") - F.shiftleft(F.col("_part").cast("long"), 33)
    numbered = tagged.join(F.broadcast(off_df), "_part").select(
        *[F.col(c) for c in keys.columns], (F.col("_off") + local).alias(out)
    )
    return numbered, int(total)


def key_changes(cols, last):
    """Whether the keys of each row (Arrow arrays) differ from those of the row before.

    ``last`` has the keys of the row before the first, as arrays of one row, or is None.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    differ = np.zeros(len(cols[0]), bool)
    differ[:1] = last is None
    for i, c in enumerate(cols):
        whole = pa.concat_arrays([last[i], c]) if last else c
        x, y = whole[:-1], whole[1:]
        unlike = pc.not_equal(x, y)
        if pa.types.is_floating(c.type):
            unlike = pc.and_not(unlike, pc.and_(pc.is_nan(x), pc.is_nan(y)))
        differ[0 if last else 1:] |= unlike.to_numpy(zero_copy_only=False)
    return differ


def dense_ids(df: DataFrame, keys: list[str], out: str = "PID", n: int | None = None) -> DataFrame:
    """0-based dense rank of the sorted distinct ``keys``; null where a key is null.

    Rows are shuffled once, by ranges of the keys; a task numbers its keys as
    it writes its rows.  Rows with a null key are spread by their content.
    """
    rest = [c for c in df.columns if c not in keys]
    rows = df.select(*keys, *rest, F.when(any_null(keys), F.xxhash64(*df.columns)).alias("_void"))
    order = [*keys, "_void"]  # null for all rows that count: those of one key stay together
    ranged = rows.repartitionByRange(n, *order) if n else rows.repartitionByRange(*order)
    tagged = ranged.sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    names = [*keys, *rest, "_part", "_local"]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last, number = None, -1
        for b in batches:
            local = np.full(b.num_rows, -1)
            void = b.column("_void").is_null().to_numpy(zero_copy_only=False)
            cols = [b.column(k).filter(pa.array(void)) for k in keys]
            if void.any():
                local[void] = number + np.cumsum(key_changes(cols, last))
                last, number = [c[-1:] for c in cols], int(local[void][-1])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), pa.array(local, mask=~void)],
                                             names=names)

    schema = T.StructType([tagged.schema[c] for c in names[:-1]] + [T.StructField("_local", T.LongType())])
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/ids-{uuid.uuid4().hex}"
    tagged.mapInArrow(run, schema).write.parquet(path)
    written = df.sparkSession.read.schema(schema).parquet(path)
    counts = sorted((r[0], r[1]) for r in written.groupBy("_part").agg(F.max("_local")).collect())
    offsets, total = [], 0
    for part, most in counts:  # one row per partition
        offsets.append((part, total))
        total += 0 if most is None else most + 1
    off_df = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _off long")
    return written.join(F.broadcast(off_df), "_part").select(
        *keys, *rest, (F.col("_off") + F.col("_local")).alias(out))


def positions(df: DataFrame, order: list[str], out: str = "row_id", n: int | None = None) -> DataFrame:
    """0-based position of every row of ``df`` sorted by the unique key ``order``."""
    numbered, _ = number_sorted(df, order, out, n)
    return numbered


def cumulative_sum(df: DataFrame, order: list[str], value: str, out: str = "cum",
                   group: list[str] | None = None, n: int | None = None) -> DataFrame:
    """Running sum of ``value`` in ``order`` (inclusive), optionally restarted per group.

    Rows are range-partitioned, sorted and checkpointed; a task adds up its
    rows in order.  What goes on from one partition to the next is the sum of
    its last group, from a table with one row per partition.  Rows with a
    null in the group are left out, a null value adds nothing.
    """
    group = group or []
    full = [*group, *order]
    parts = _num_partitions(df, n)
    kind = "double" if dict(df.dtypes)[value] in ("double", "float") else "long"
    rows = df.dropna(subset=group) if group else df
    ranged = reliable_checkpoint(rows.repartitionByRange(parts, *full).sortWithinPartitions(*full))
    tagged = ranged.withColumns({"_part": F.spark_partition_id(),
                                 "_add": F.coalesce(F.col(value).cast(kind), F.lit(0).cast(kind))})

    def sums(b, last, held):
        """Running sums of a batch that goes on from ``held`` in the group ``last``; the group and sum at its end."""
        import numpy as np

        cols, add = [b.column(g) for g in group], b.column("_add").to_numpy()
        new = key_changes(cols, last) if group else np.zeros(len(add), bool)
        new[0] &= last is not None
        start = np.maximum.accumulate(np.where(new, np.arange(len(add)), 0))
        goes_on = start == 0 if not new[0] else np.zeros(len(add), bool)

        def within(values, held):
            total = np.cumsum(values)  # whole numbers wrap around: the differences stay exact
            total -= (total - values)[start]
            total[goes_on] += held
            return total

        total = within(add, held)
        if add.dtype == np.int64 and np.abs(within(add.astype(float), float(held))).max() > 9.2e18:
            raise OverflowError("a running sum passes 64 bits")
        return total, [c[-1:] for c in cols], total[-1].item()

    def ends(batches):
        """The first and last group of a partition, whether they are one, and the sum of the last."""
        import pyarrow as pa

        begin, last, held, changes = None, None, 0, 0
        for b in batches:
            if b.num_rows:
                cols = [b.column(g) for g in group]
                if begin is None:
                    begin, part = [c[:1] for c in cols], b.column("_part")[:1]
                changes += int(key_changes(cols, last)[1 if last is None else 0:].sum()) if group else 0
                _, last, held = sums(b, last, held)
        if last is not None:
            yield pa.RecordBatch.from_arrays(
                [part, *begin, *last, pa.array([changes == 0]), pa.array([held])], names=end_names)

    end_names = ["_part", *[f"_a{i}" for i in range(len(group))], *[f"_z{i}" for i in range(len(group))], "_one", "_sum"]
    types = [ranged.schema[g].dataType for g in group]
    end_schema = T.StructType([T.StructField(c, t) for c, t in zip(end_names, [
        T.IntegerType(), *types, *types, T.BooleanType(), T.DoubleType() if kind == "double" else T.LongType()])])
    k = len(group)
    carry, last, held = {}, None, 0
    for r in sorted(tagged.select("_part", *group, "_add").mapInArrow(ends, end_schema).collect(), key=lambda r: r[0]):
        goes_on = last is not None and _alike(r[1:1 + k], last)
        carry[r[0]] = held if goes_on else 0
        held = r["_sum"] + (held if goes_on and r["_one"] else 0)
        last = r[1 + k:1 + 2 * k]
    kept = df.columns
    names = [*kept, out]

    def run(batches):
        import pyarrow as pa

        last, held = None, None
        for b in batches:
            if b.num_rows:
                if held is None:
                    held = carry[b.column("_part")[0].as_py()]
                total, last, held = sums(b, last, held)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(total)], names=names)

    schema = T.StructType([*ranged.schema.fields, T.StructField(out, T.DoubleType() if kind == "double" else T.LongType())])
    return tagged.mapInArrow(run, schema)


def _alike(a, b) -> bool:
    """Whether two keys are the same; NaN is NaN."""
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))
