"""Language identification by string kernels.

The kernel of two texts is the number of n-grams (n = 1..3, lower-cased)
that both hold, over the root of the product of their own numbers.
Nystroem landmarks turn it into features, and one ridge regression for
each language (against the rest) is fitted on them.  The kernel is linear
in the presence vector, so landmark kernels, whitening and regression fold
into one matrix: a batch of texts is scored by a product with it.

The model is fitted on a bounded sample: of each language the
``per_lang`` texts with the least hash, none over ``max_chars`` long.

Edge cases: a text that is null or has no letter is ``und`` with score 0,
as is every text when there is nothing to learn from; ties go to the
language that sorts first; repeated rows are judged each on its own; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_crc
from tessera.llm.ngrams import Grams

PER_LANG = 500
MAX_CHARS = 20_000
LANDMARKS = 256
ALPHABET = 64
RIDGE = 1e-2
CHUNK = 64
UNKNOWN = "und"

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def training_sample(docs: DataFrame, per_lang: int = PER_LANG, max_chars: int = MAX_CHARS):
    """(text, lang) of a bounded number of the rows whose crc32 mod 3 is not 1."""
    rows = (docs.filter((id_crc() % 3 != 1) & F.col("lang").isNotNull()
                        & F.col("text").rlike(r"\p{L}") & (F.length("text") <= max_chars))
            .select("doc_id", "text", "lang", F.xxhash64("doc_id", "text").alias("h")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    # a hash below this bound holds a little more than per_lang rows of the language
    share = {x: min(1.0, 1.3 * per_lang / n + 20 / n) for x, n in counts.items()}
    keep = F.lit(False)
    for lang, p in share.items():
        bound = int(-2**63 + p * (2**64 - 1))
        keep |= (F.col("lang") == lang) & (F.col("h") <= F.lit(min(bound, 2**63 - 1)))
    taken: dict[str, list] = {}
    for r in sorted(rows.filter(keep).collect(), key=lambda r: (r["h"], r["doc_id"] or 0)):
        if len(own := taken.setdefault(r["lang"], [])) < per_lang:
            own.append(r["text"])
    return [(t, lang) for lang in sorted(taken) for t in taken[lang]]


class LanguageModel:
    def __init__(self, sample, landmarks: int = LANDMARKS, ridge: float = RIDGE):
        import numpy as np

        texts = [t.lower() for t, _ in sample]
        self.langs = sorted({x for _, x in sample})
        self.grams = Grams(texts, ALPHABET)
        held = np.array([self.grams.present(t) for t in texts], np.float32)
        held /= np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1))
        # landmarks: evenly over the sample, which is in order of language
        at = np.unique(np.linspace(0, len(texts) - 1, min(landmarks, len(texts))).astype(int))
        own = held[at]
        values, vectors = np.linalg.eigh((own @ own.T).astype(np.float64))
        inverse = np.where(values > 1e-6 * values.max(), 1 / np.sqrt(np.maximum(values, 1e-12)), 0)
        white = vectors * inverse
        features = (held @ own.T).astype(np.float64) @ white
        target = np.array([[1.0 if x == lang else -1.0 for lang in self.langs] for _, x in sample])
        self.bias = target.mean(axis=0)
        gram = features.T @ features + ridge * len(texts) / len(at) * np.eye(features.shape[1])
        fitted = np.linalg.solve(gram, features.T @ (target - self.bias))
        self.matrix = (own.T @ (white @ fitted).astype(np.float32)).astype(np.float32)

    def score(self, texts: list[str]):
        """One row of regression values for each text."""
        import numpy as np

        held = np.array([self.grams.present(t.lower()) for t in texts], np.float32)
        norm = np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1))
        return held @ self.matrix / norm + self.bias


def identify_language(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> DataFrame:
    """doc_id, held_out, predicted language and score (0 to 1) of every text."""
    sample = training_sample(docs, per_lang)
    model = LanguageModel(sample, landmarks) if sample else None
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the alphabet

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import regex

        letter, model = regex.compile(r"\p{L}"), shared.value
        for b in batches:
            texts = b.column("text").to_pylist()
            pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            judged = [i for i, t in enumerate(texts) if t and model and letter.search(t)]
            for a in range(0, len(judged), CHUNK):
                at = judged[a:a + CHUNK]
                values = model.score([texts[i] for i in at])
                for i, v, x in zip(at, values.max(axis=1), values.argmax(axis=1)):
                    pred[i], score[i] = model.langs[x], float(np.clip((v + 1) / 2, 0, 1))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), b.column("held_out"),
                 pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "text", (id_crc() % 3 == 1).alias("held_out")) \
        .select("doc_id", "held_out", "text").mapInArrow(run, PREDICTED)
