"""Exact top-k search by distributed histogram selection.

Every candidate is scored against a block of queries.  Global histograms
of the scores, refined round by round around each query's k-th value, end
in that value itself; a last pass keeps the scores above it and, of those
equal to it, as many as are still missing, by the smallest id.  Nothing
but counts and at most k rows of each task and query is ever moved.

Edge cases: vectors that are null or hold null, NaN or infinite components
take no part, nor does a null id; vectors of another length than the
query's are no candidates; rows with one id are each a query and a
candidate of their own, and only the query's own row is left out; fewer
candidates than k give as many rows; scores beyond a long are clipped to
it; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

SCALE = 256
QUERY_EVERY = 50
BLOCK = 2048   # queries per block: what a task holds besides its rows
BINS = 256
CHUNK = 1024   # candidates scored at a time
LONG = 2**63 - 1

RESULT = "query_id long, rank int, vec_id long, score long"


def integer_vectors(vecs: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and its vector as floor(scale * component)."""
    e = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(
        e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vecs.select(F.col("vec_id").cast("long"), "embedding").filter(usable)
            .select("vec_id", F.transform(e, lambda x: F.floor(x.cast("double") * scale)).alias("v")))


class Block:
    """A block of queries and where each one's k-th score lies so far."""

    def __init__(self, rows, k: int):
        import numpy as np

        self.k = k
        self.ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
        self.rows = np.array([r["row"] for r in rows], dtype=np.int64)
        self.by_length: dict[int, tuple] = {}
        for n in {len(r["v"]) for r in rows}:
            at = [i for i, r in enumerate(rows) if len(r["v"]) == n]
            self.by_length[n] = (np.array(at), np.array([rows[i]["v"] for i in at], dtype=np.int64)
                                 .reshape(len(at), n))
        self.lo = self.hi = self.above = self.least = None

    def scored(self, batches):
        """(numbers of the queries, candidate ids, scores, own): own marks a query's own row."""
        import numpy as np

        for b in batches:
            ids, own = (b.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row"))
            lists = b.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            lengths = np.diff(ends)
            for n, (at, q) in self.by_length.items():
                same = np.flatnonzero(lengths == n)
                for i in range(0, len(same), CHUNK):
                    rows = same[i:i + CHUNK]
                    c = flat[ends[rows][:, None] + np.arange(n)].reshape(len(rows), n)
                    yield at, ids[rows], scores(c, q), own[rows][:, None] == self.rows[at][None, :]


def scores(c, q):
    """Exact inner products of integer rows."""
    import numpy as np

    most = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (c, q)]
    bound = most[0] * most[1] * max(1, c.shape[1])
    if bound < 2**52:
        return (c.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    if bound < 2**62:
        return c @ q.T
    return np.clip(c.astype(object) @ q.T.astype(object), -LONG, LONG).astype(np.int64)


def score_range(cands: DataFrame, block: Block):
    """Least and greatest score and number of candidates of each query."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        n = len(block.ids)
        low, high, count = np.full(n, LONG), np.full(n, -LONG), np.zeros(n, np.int64)
        for at, _, s, own in block.scored(batches):
            low[at] = np.minimum(low[at], np.where(own, LONG, s).min(axis=0))
            high[at] = np.maximum(high[at], np.where(own, -LONG, s).max(axis=0))
            count[at] += (~own).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), *map(pa.array, (low, high, count))],
                                         names=["q", "low", "high", "n"])

    return (cands.mapInArrow(run, "q long, low long, high long, n long").groupBy("q")
            .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")))


def histogram(cands: DataFrame, block: Block):
    """(query, bin, count) over each query's window.

    A task leaves out the bins below those that already hold k of its own
    scores: the k-th value of all cannot lie there.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        n = len(block.ids)
        counts = np.zeros((n, BINS), np.int64)
        step = bin_width(block)
        for at, _, s, own in block.scored(batches):
            inside = ~own & (s >= block.lo[at]) & (s <= block.hi[at])
            bins = (s - block.lo[at]) // step[at]
            key = (at[None, :] * BINS + bins)[inside]
            counts += np.bincount(key, minlength=n * BINS).reshape(n, BINS)
        better = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        q, bins = np.nonzero((counts > 0) & (better < block.k))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(bins), pa.array(counts[q, bins])],
                                         names=["q", "bin", "n"])

    return (cands.mapInArrow(run, "q long, bin long, n long").groupBy("q", "bin")
            .agg(F.sum("n").alias("n")))


def bin_width(block: Block):
    import numpy as np

    return np.maximum(1, (block.hi - block.lo) // BINS + 1)


def locate(cands: DataFrame, block: Block) -> None:
    """Narrow every query's window to its k-th score."""
    import numpy as np

    n = len(block.ids)
    block.lo, block.hi = np.ones(n, np.int64), np.zeros(n, np.int64)
    block.above, block.least = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in score_range(cands, block).collect():
        if r["n"]:
            block.lo[r["q"]], block.hi[r["q"]] = r["low"], r["high"]
            block.least[r["q"]] = min(block.k, r["n"])
    while (block.hi > block.lo).any():
        step, found = bin_width(block), {}
        for r in histogram(cands, block).collect():
            found.setdefault(r["q"], []).append((r["bin"], r["n"]))
        for q, bins in found.items():
            for x, count in sorted(bins, reverse=True):
                if block.above[q] + count >= block.least[q]:
                    low = block.lo[q] + x * step[q]
                    block.lo[q], block.hi[q] = low, min(block.hi[q], low + step[q] - 1)
                    break
                block.above[q] += count


def pick(cands: DataFrame, block: Block) -> DataFrame:
    """Scores above the k-th, and the smallest ids among those equal to it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ties: dict[int, np.ndarray] = {}
        for at, ids, s, own in block.scored(batches):
            c, j = np.nonzero(~own & (s > block.hi[at]) & (block.least[at] > 0))
            out = [at[j], ids[c], s[c, j]]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), names=["q", "vec_id", "score"])
            c, j = np.nonzero(~own & (s == block.hi[at]) & (block.least[at] > 0))
            order = np.argsort(j, kind="stable")
            c, j = c[order], j[order]
            for x in np.unique(j):
                q = int(at[x])
                new = ids[c[np.searchsorted(j, x):np.searchsorted(j, x, "right")]]
                need = int(block.least[q] - block.above[q])
                ties[q] = np.sort(np.concatenate([ties.get(q, new[:0]), new]))[:need]
        for q, ids in ties.items():
            out = [np.repeat(q, len(ids)), ids, np.repeat(block.hi[q], len(ids))]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), names=["q", "vec_id", "score"])

    best = cands.mapInArrow(run, "q long, vec_id long, score long")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    names = F.array(*[F.lit(int(i)) for i in block.ids])
    return (best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= block.k)
            .select(F.get(names, F.col("q").cast("int")).alias("query_id"), "rank", "vec_id", "score"))


def top_k(vecs: DataFrame, k: int = 5, every: int = QUERY_EVERY, block: int = BLOCK) -> DataFrame:
    """Each query's k best rows: query_id, rank, vec_id, score.

    Queries (rows whose id is divisible by ``every``) come to the driver a
    block at a time; each block's answer is stored before the next begins.
    """
    spark = vecs.sparkSession
    cands = stored(integer_vectors(vecs).withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = cands.filter(F.pmod("vec_id", F.lit(every)) == 0).toLocalIterator()
    parts = []
    while rows := list(islice(queries, block)):
        now = Block(rows, k)
        locate(cands, now)
        parts.append(stored(pick(cands, now), "topk"))
    if not parts:
        return spark.createDataFrame([], RESULT)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
