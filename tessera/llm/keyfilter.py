"""A bitmap of hashed keys that keeps most rows without a partner out of a shuffle.

Its size is fixed, so its broadcast is bounded at any input size; once it
fills up more rows pass, and the join that follows decides as before.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 20  # 8 MB of bits


def key_filter(keys: DataFrame, col: str):
    """A function of a long column: true for every key of ``keys``, seldom for others."""
    import numpy as np

    word = F.pmod(F.shiftright(col, 6), F.lit(WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(col).bitwiseAND(F.lit(63)).cast("int"))
    found = keys.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(WORDS, np.int64)
    words[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def check(column: pa.Array) -> pa.Array:
        k = column.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array((shared.value[(k >> 6) % WORDS] >> (k & 63)) & 1 == 1)

    return check
