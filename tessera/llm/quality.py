"""Quality classifier: naive-Bayes support vectors.

Indicators of character n-grams (n = 1..3) and of the text's shape (its
length, how many of its words are distinct, how many repeat the one before)
are scaled by their log-count ratio between the classes; a linear
hinge-loss model is fitted on them by dual coordinate descent, and a
logistic curve through margins of rows that the fit has not seen turns its
margin into a score.

The model is fitted on a bounded sample: the ``most`` labelled texts with
the least hash, none over ``max_chars`` long.

Edge cases: a null text counts as empty; a row labelled twice counts with
its lower label, a null label not at all; with labels of one class, or
none, every score is that class (1 without any); repeated rows are judged
each on its own; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_crc, release_memory
from tessera.llm.ngrams import Grams

MOST = 4000
MAX_CHARS = 20_000
ALPHABET = 96
SMOOTH = 1.0
COST = 1.0
ROUNDS = 12
CALIBRATE_EVERY = 4   # each fourth row of the sample places the logistic curve
THRESHOLD = 0.3
N_LENGTHS, N_SHARES = 24, 11  # classes of a text's length, and of a share in tenths

SCORED = "doc_id long, held_out boolean, score double, predicted int"


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MOST, max_chars: int = MAX_CHARS):
    """(text, label) of a bounded number of labelled rows whose crc32 mod 5 is not 0."""
    spark = docs.sparkSession
    known = (labels.filter((id_crc() % 5 != 0) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
             .withColumn("h", F.xxhash64("doc_id")))
    rows = known.orderBy("h", "doc_id").limit(most).collect()
    if not rows:
        return []
    chosen = F.broadcast(spark.createDataFrame(rows, known.schema))  # at most `most` rows
    text = F.coalesce("text", F.lit(""))
    found = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
             .filter(F.length("text") <= max_chars).join(chosen, "doc_id")
             .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"),
                                    F.first("h").alias("h"))
             .collect())
    return [(r["text"], r["quality"]) for r in sorted(found, key=lambda r: (r["h"], r["doc_id"]))]


def shape(text: str) -> tuple[int, int, int]:
    """Class of the length (powers of two); distinct and stuttered words in tenths."""
    words = text.split()
    n = max(1, len(words))
    return (min(N_LENGTHS - 1, len(text).bit_length()), 10 * len(set(words)) // n,
            10 * sum(map(str.__eq__, words, words[1:])) // n)


class QualityModel:
    def __init__(self, sample):
        import numpy as np

        self.constant = None
        y = np.array([1.0 if q else -1.0 for _, q in sample])
        if len(set(y.tolist())) < 2:
            self.constant = float(not len(y) or y[0] > 0)
            return
        texts = [t for t, _ in sample]
        self.grams = Grams(texts, ALPHABET)
        x = [self.indicators(t) for t in texts]
        n = len(self.grams.grams) + N_LENGTHS + 2 * N_SHARES
        fit = np.arange(len(y)) % CALIBRATE_EVERY != 0
        if len(set(y[fit].tolist())) < 2:
            fit[:] = True
        ratio = self.log_count_ratio([x[i] for i in np.flatnonzero(fit)], y[fit], n)
        weights, bias = self.descend([x[i] for i in np.flatnonzero(fit)], y[fit], ratio)
        self.ratio, self.weights, self.bias = ratio, weights * ratio, bias
        rest = ~fit if len(set(y[~fit].tolist())) == 2 else fit
        margins = np.array([self.margin(x[i]) for i in np.flatnonzero(rest)])
        self.slope, self.shift = self.logistic(margins, y[rest])

    def indicators(self, text: str):
        """Numbers of the features that the text has."""
        import numpy as np

        n, (length, distinct, stutter) = len(self.grams.grams), shape(text)
        return np.concatenate([np.flatnonzero(self.grams.present(text)),
                               [n + length, n + N_LENGTHS + distinct, n + N_LENGTHS + N_SHARES + stutter]])

    @staticmethod
    def log_count_ratio(x, y, n):
        import numpy as np

        good, bad = (SMOOTH + np.bincount(np.concatenate([f for f, v in zip(x, y) if v == s]), minlength=n)
                     for s in (1, -1))
        return np.log(good / good.sum()) - np.log(bad / bad.sum())

    @staticmethod
    def descend(x, y, ratio):
        """Dual coordinate descent for the hinge loss; the rarer class weighs as much in all."""
        import numpy as np

        rows = [(f, ratio[f] / np.sqrt(ratio[f] @ ratio[f] + 1)) for f in x]
        cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * COST
        square = np.array([float(v @ v) + 1 for _, v in rows])  # the bias is a feature of value 1
        w, b, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(y))
        for turn in range(ROUNDS):
            for i in np.random.default_rng(turn).permutation(len(y)):
                f, v = rows[i]
                slope = y[i] * (w[f] @ v + b) - 1
                new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
                if new != alpha[i]:
                    step = (new - alpha[i]) * y[i]
                    alpha[i] = new
                    w[f] += step * v
                    b += step
        return w, b

    def margin(self, features) -> float:
        scale = math.sqrt(float(self.ratio[features] @ self.ratio[features]) + 1)
        return float(self.weights[features].sum()) / scale + self.bias

    @staticmethod
    def logistic(margins, y):
        """Slope and shift of a logistic curve, by Newton steps on smoothed targets."""
        import numpy as np

        good, bad = (y > 0).sum(), (y < 0).sum()
        t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
        spread = margins.std() or 1.0
        z = np.stack([margins / spread, np.ones(len(y))], axis=1)
        p = np.zeros(2)
        for _ in range(60):
            s = 1 / (1 + np.exp(-np.clip(z @ p, -30, 30)))
            h = (z * (s * (1 - s))[:, None]).T @ z + 1e-3 * np.eye(2)
            p += np.clip(np.linalg.solve(h, z.T @ (t - s) - 1e-3 * p), -2, 2)
        return float(p[0] / spread), float(p[1])

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        z = self.slope * self.margin(self.indicators(text or "")) + self.shift
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = MOST) -> QualityModel:
    return QualityModel(labelled_sample(docs, labels, most))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the alphabet

    def run(batches):
        for b in batches:
            score = [shared.value.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), b.column("held_out"), pa.array(score, pa.float64()),
                 pa.array([int(s >= THRESHOLD) for s in score], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "text").mapInArrow(run, SCORED)


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The documents whose score reaches the threshold (a null text is scored as an empty one).

    Repeated rows and all columns stay as they are; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shared.value.score(t.as_py()) >= THRESHOLD for t in texts], pa.bool_())
            release_memory()

    return docs.filter(good("text"))
