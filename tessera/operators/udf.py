"""Pluggable batch imputers (the slow path, Arrow-batched).

``impute_with`` hands Arrow batches of rows to any user model through
``mapInPandas``; ``impute_with_retry`` wraps it in the retry contract of
the source pipeline: coerce the model output, keep complete rows, send the
rest back with a new seed, at most ``max_retries`` rounds, then omit.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import reliable_checkpoint


def impute_with(rows: DataFrame, model: Callable[[pd.DataFrame, int], pd.DataFrame], bands: list[str],
                seed: int = 0, batch_rows: int | None = None) -> DataFrame:
    """Run ``model(batch, seed) -> batch`` on Arrow batches of ``rows``.

    The output keeps the input schema; band columns are coerced to double
    (bad values become null).  ``batch_rows`` is the most rows per call.
    """
    schema = rows.select(*[F.col(c).cast("double").alias(c) if c in bands else F.col(c)
                           for c in rows.columns]).schema
    cols = rows.columns

    def run(batches):
        for pdf in batches:
            for a in range(0, len(pdf), batch_rows or max(1, len(pdf))):
                out = model(pdf.iloc[a:a + (batch_rows or len(pdf))].copy(), seed)
                for b in bands:
                    out[b] = pd.to_numeric(out[b], errors="coerce").astype("float64")
                yield out[cols]

    return rows.mapInPandas(run, schema)


def impute_with_retry(rows: DataFrame, model, key: list[str], bands: list[str], max_retries: int = 15,
                      seed: int = 0) -> DataFrame:
    """Retry incomplete rows with a new seed; rows still incomplete are omitted.

    Each round's output is checkpointed reliably, so a lost executor never
    re-runs earlier model rounds.
    """
    done = None
    todo = rows
    for r in range(max_retries):
        out = reliable_checkpoint(impute_with(todo, model, bands, seed + r))
        ok = out.dropna(how="any", subset=bands)
        done = ok if done is None else done.unionByName(ok)
        todo = rows.join(done.select(*key), key, "left_anti")
        if todo.isEmpty():
            break
    return done
