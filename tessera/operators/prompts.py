"""Completion of prompts: any subset of a row as text, the rest from back-off tables of the training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import fill
from tessera.operators.text import PLACEHOLDER, text_to_row

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def is_number(kind: str) -> bool:
    return kind.startswith(NUMBERS)


def parse_prompts(prompts: DataFrame, train: DataFrame, key: str, text_col: str = "prompt") -> DataFrame:
    """``key`` and the columns of ``train`` in their types: ``"Sex is female, Age is 26"``.

    Columns that a prompt does not name, ``None`` and text that is no value
    of the column's type are null; the trailing ``"Age is"`` of a prompt
    names a column without a value.
    """
    parsed = text_to_row(prompts, train.columns, text_col, key)
    return parsed.select(key, *[
        F.when(F.col(c) != PLACEHOLDER, F.col(c)).try_cast(t).alias(c) for c, t in train.dtypes])


def complete_prompts(prompts: DataFrame, train: DataFrame, key: str, contexts=None,
                     text_col: str = "prompt") -> DataFrame:
    """Whole rows for prompts: given cells stay, each missing one comes from the first context that has data.

    ``contexts`` are lists of columns, longest first; by default each column
    by itself in order, then none.  Numbers take the exact median of the
    context, other types the most frequent value (ties to the smallest).  A
    context that holds the missing column, or a cell that the prompt leaves
    open, is passed over.  Whole-number columns take the truncated median.
    """
    if contexts is None:
        contexts = [[c] for c in train.columns] + [[]]
    rows = parse_prompts(prompts, train, key, text_col)
    out, filled = rows, {}
    for at, (c, t) in enumerate(train.dtypes):
        own = [list(x) for x in contexts if c not in x]
        method = "median" if is_number(t) else "mode"
        names = []
        for i, ctx in enumerate(own):
            stat = fill.context_table(train.dropna(subset=ctx) if ctx else train, ctx, [c], method, i)
            name = f"_f{at}_{i}"
            stat = stat.select(*ctx, F.col(fill._ctx_name(i, c)).alias(name))
            if ctx:
                out = out.join(stat, ctx, "left")
            else:
                out = out.withColumn(name, stat.scalar())
            names.append(name)
        filled[c] = F.coalesce(F.col(c), *[F.col(n).cast(t) for n in names])
    return out.select(key, *[filled[c].alias(c) for c in train.columns])
