"""Ordered tables with a positional index: a slice reads only the files that hold it.

A table is range-partitioned and sorted by a unique key once and written as
one Parquet file per partition.  The index is the number of rows of each
file, in order; a row's position is its file's offset plus its place in the
file (``_metadata.row_index``), so nothing is numbered and no row carries
its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_ordered(df: DataFrame, order: list[str], path: str, n: int | None = None) -> None:
    """Write ``df`` sorted by ``order`` (unique keys), one file per range of keys."""
    ranged = df.repartitionByRange(n, *order) if n else df.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.option("maxRecordsPerFile", 0).parquet(path)


class OrderedTable:
    """A table written by :func:`write_ordered`; ``offsets`` has (file, first position, rows) in order."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.table = spark.read.parquet(path)
        counts = self.table.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()
        self.offsets, first = [], 0
        for r in sorted(counts, key=lambda r: r["file"].rsplit("/", 1)[1]):  # part-00000, part-00001, ...
            self.offsets.append((r["file"], first, r["n"]))
            first += r["n"]
        self.total = first

    def _read(self, files, out: str) -> DataFrame:
        """The rows of some files with their positions."""
        if not files:
            return self.table.limit(0).withColumn(out, F.lit(None).cast("long"))
        rows = self.spark.read.schema(self.table.schema).parquet(*[f for f, _, _ in files])
        rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        table = self.spark.createDataFrame([(f, a) for f, a, _ in files], "_file string, _first long")
        rows = rows.join(F.broadcast(table), "_file")  # a row for each file
        return rows.select(*self.table.columns, (F.col("_first") + F.col("_at")).alias(out))

    def positions(self, out: str = "row_id") -> DataFrame:
        return self._read(self.offsets, out)

    def slice(self, start: int, stop: int, out: str = "row_id") -> DataFrame:
        """Rows at positions [start, stop), read from the files that hold them."""
        files = [(f, a, n) for f, a, n in self.offsets if a < stop and a + n > start]
        return self._read(files, out).filter((F.col(out) >= start) & (F.col(out) < stop))

    def rows(self, ids: list[int], out: str = "row_id", place: str = "_pos") -> DataFrame:
        """Rows at the listed positions with their place in the list (repeats repeat), in its order."""
        ids = [int(i) for i in ids]
        files = [(f, a, n) for f, a, n in self.offsets if any(a <= i < a + n for i in ids)]
        lst = self.spark.createDataFrame(list(enumerate(ids)), f"{place} int, {out} long")
        return self._read(files, out).join(F.broadcast(lst), out).orderBy(place)

    def with_previous(self, col: str, out: str) -> DataFrame:
        """Every row with ``col`` of the row before it (null for the first of all).

        ``lag`` runs inside each file; a file's first row takes the last value
        of the file before, a table of one row for each file.
        """
        rows = self.table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
        kind = dict(self.table.dtypes)[col]
        ends = {r["_file"]: r["v"] for r in rows.groupBy("_file").agg(
            F.max_by(F.struct(col), F.col("_at"))[col].alias("v")).collect()}
        names = [f for f, _, _ in self.offsets]
        borders = self.spark.createDataFrame(
            [(f, ends[names[i - 1]] if i else None) for i, f in enumerate(names)], f"_file string, _border {kind}")
        w = Window.partitionBy("_file").orderBy("_at")
        joined = rows.join(F.broadcast(borders), "_file")
        previous = F.when(F.col("_at") == 0, F.col("_border")).otherwise(F.lag(col).over(w))
        return joined.select(*self.table.columns, previous.alias(out))
