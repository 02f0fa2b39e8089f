"""Training-log analytics: stitching runs, loss deltas, log tails.

A log is ``(run, step, loss[, epoch, learning_rate])``.  Only tables with
one row per run (bounded by the number of runs) are ordered globally;
record-level work is joins on keys, so no run is gathered into one task.
The per-run tables carry no broadcast hint: AQE broadcasts them once their
runtime size is known to be under the threshold.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.ids import positions
from tessera.sources.ordered import OrderedTable, write_ordered

LOG_RECORD = T.StructType([
    T.StructField("epoch", T.DoubleType()), T.StructField("learning_rate", T.DoubleType()),
    T.StructField("loss", T.DoubleType()), T.StructField("step", T.LongType()),
])
TRAINER_STATE = T.StructType([T.StructField("log_history", T.ArrayType(LOG_RECORD))])


def _full_path(spark: SparkSession, path: str) -> str:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().getPath()


def read_trainer_states(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Flatten ``{"log_history": [...]}`` files; run = position of the path in ``paths``.

    Paths are taken literally (``run[0]/state.json`` is no pattern) and told
    apart by their full names.
    """
    escaped = [re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]
    df = spark.read.schema(TRAINER_STATE).json(escaped, multiLine=True)
    recs = df.select(F.col("_metadata.file_path").alias("_f"), F.posexplode("log_history").alias("idx", "r"))
    local = F.regexp_replace(F.regexp_replace("_f", r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), r"\+", "%2B")
    name = F.url_decode(local)
    run = F.coalesce(*[F.when(name == _full_path(spark, p), F.lit(i)) for i, p in enumerate(paths)])
    return recs.select(run.alias("run"), "idx", "r.step", "r.loss", "r.epoch", "r.learning_rate")


def flatten_states(states: DataFrame, run: str = "run") -> DataFrame:
    """One row per record of a table of trainer states (``run``, ``log_history``): run, idx and the record's fields.

    A state without records, or with a null history, gives no row.
    """
    recs = states.select(F.col(run).alias("run"), F.posexplode("log_history").alias("idx", "r"))
    return recs.select("run", "idx", "r.step", "r.loss", "r.epoch", "r.learning_rate")


def read_state_lines(spark: SparkSession, path: str) -> DataFrame:
    """A folder of trainer states, one JSON object ``{"run", "log_history": [...]}`` a line, flattened."""
    schema = T.StructType([T.StructField("run", T.LongType()), *TRAINER_STATE.fields])
    return flatten_states(spark.read.schema(schema).json(path))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines log records ``{"run", "step", "loss", ...}`` with an explicit schema."""
    schema = "run INT, step LONG, loss DOUBLE, epoch DOUBLE, learning_rate DOUBLE"
    return spark.read.schema(schema).json(path)


def _run_table(log: DataFrame) -> DataFrame:
    """One row per run: last step, last loss, record count (bounded by #runs)."""
    return log.groupBy("run").agg(
        F.max("step").alias("last_step"),
        F.max_by("loss", "step").alias("last_loss"),
        F.count(F.lit(1)).alias("n"),
    )


def _per_run_window():
    # the run table has one row per run: a global order over it is bounded
    return Window.orderBy("run").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def stitch_steps(log: DataFrame) -> DataFrame:
    """Shift each run's steps by the sum of the last steps of earlier runs."""
    runs = _run_table(log)
    shift = runs.select("run", (F.sum("last_step").over(_per_run_window()) - F.col("last_step"))
                        .alias("shift"))
    return log.join(shift, "run").withColumn("global_step", F.col("step") + F.col("shift")).drop("shift")


def ordered_log(log: DataFrame, path: str) -> OrderedTable:
    """The log written in (run, step) order into ``path``, a folder that all executors share."""
    write_ordered(log, ["run", "step"], path)
    return OrderedTable(log.sparkSession, path)


def loss_delta(log: OrderedTable) -> DataFrame:
    """Loss minus the previous record's loss in (run, step) order; the first is 0.

    The record before is the neighbour in an ordered log; only one value for
    each file crosses a border, and no run is shuffled or joined.
    """
    rows = log.with_previous("loss", "_prev")
    return rows.select("run", "step", "loss", (F.col("loss") - F.coalesce("_prev", "loss")).alias("delta"))


def record_rank(log: DataFrame, order: str = "step") -> DataFrame:
    """1-based rank of each record inside its run, via global positions."""
    pos = positions(log, ["run", order], "_pos")
    first = pos.groupBy("run").agg(F.min("_pos").alias("_first"))
    return pos.join(first, "run").withColumn(
        "rank", F.col("_pos") - F.col("_first") + 1).drop("_first")


# The cuts of the log tail.
TAIL_DIVISORS = [12, 10, 6, 4, 3, 2]


def log_tail(log: OrderedTable) -> DataFrame:
    """Rows from position n//k for each k, and from n//2 + n//4, labelled by cut.

    Each cut reads the files of an ordered log from its position on.
    """
    n = log.total
    cuts = [(f"n//{k}", n // k) for k in TAIL_DIVISORS] + [("n//2+n//4", n // 2 + n // 4)]
    out = None
    for name, start in cuts:
        part = log.slice(start, n, "pos").select(F.lit(name).alias("cut"), "run", "step", "loss", "pos")
        out = part if out is None else out.unionByName(part)
    return out
