"""Phrases of two to four words that stand together more often than their parts let expect.

Words of each language are counted first; those with at least ``LEAST``
occurrences are numbered, and the texts are stored as streams of word
numbers in which every other word and every end of a piece is a gap.
Candidates are Apriori-safe: a phrase is one only where the phrases of its
first and of its last words are candidates too, and tasks report it often
enough.  The candidates form double-array tries, which tasks get by
broadcast; a task advances the states of all places of its text level by
level, counts the accepting states, and the shards' counts are summed.

A trie holds at most MAX_PHRASES phrases; more candidates are counted by
several tries, one pass over the stored streams each.  Up to MAX_WORDS
frequent words are looked up in a broadcast table; if there are more, words
get their numbers by a join.

Edge cases: a null text is empty; a null language is ``und``; ties in the
score go to the shortest first part, ties in the ranking to the more
frequent phrase, then to its bytes; repeated rows count each; an empty table
gives no rows; other columns are ignored; a text of any length is read in
segments.  Words are known by 64-bit hashes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import shingles
from tessera.llm.common import release_memory, stored
from tessera.llm.doublearray import DoubleArray
from tessera.llm.shingles import Shingler

LEAST = 30
LONGEST = 4
TOP = 2000
MAX_WORDS = 1 << 22     # 48 MB of hashes and numbers
MAX_PHRASES = 1 << 20   # some 16 MB of trie
SLICE = 1 << 12         # phrases whose counts are a row; MAX_PHRASES is a multiple
HELD = 1 << 21          # words or places that a task holds before it hands counts on
STREAM = 1 << 20        # word numbers in a stored stream
SALTS = 64
BREAKS = b".,;:!?\n\v\f\r"
GAP = -1


# --- words ---------------------------------------------------------------------------------------

class PieceReader:
    """Hashes of the words of texts (A-Z lower-cased) and where pieces start."""

    def __init__(self):
        import numpy as np

        self.shingler = Shingler(1)
        self.breaks = np.isin(np.arange(256), list(BREAKS))
        self.shingler.space = self.breaks | np.isin(np.arange(256), [32, 9])

    def part(self, data: bytes):
        """Start and hash of each word, and the number of piece ends before it; and those of the whole."""
        import numpy as np

        ends = np.cumsum(self.breaks[np.frombuffer(data, np.uint8)])
        start, h = self.shingler.words(data)
        return start, h.view(np.int64), ends[start], int(ends[-1]) if len(ends) else 0

    def runs(self, texts):
        """(bytes, start of each word, its hash, whether a piece starts there) of runs of texts.

        A long text is a run of its own, read in segments that end between words.
        """
        import numpy as np

        for run in self.shingler.batches(texts):
            data = b"\n".join(run)
            found, a, before = [], 0, 0
            while a < len(data):
                b = min(len(data), a + 2 * shingles.SEGMENT)
                while b < len(data) and not self.shingler.space[data[b]]:
                    b += 1
                start, h, piece, ends = self.part(data[a:b])
                found.append((start + a, h, piece + before))
                a, before = b, before + ends
            if found:
                start, h, piece = (np.concatenate(x) for x in zip(*found))
                yield data, start, h, np.diff(piece, prepend=-1) > 0


def by_language(batch):
    import numpy as np

    langs = batch.column("lang").to_pylist()
    rows = {}
    for i, lang in enumerate(langs):
        rows.setdefault(lang, []).append(i)
    for lang, at in rows.items():
        yield lang, batch.column("text").take(pa.array(np.array(at))).to_pylist()


def count_words(batches):
    """lang, h, n: occurrences of the words of a task's texts."""
    import numpy as np

    reader, held = PieceReader(), {}

    def flush():
        for lang, parts in held.items():
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            for a in range(0, len(h), 1 << 16):
                k = len(h[a:a + (1 << 16)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * k, pa.string()), pa.array(h[a:a + k]), pa.array(n[a:a + k])],
                    names=["lang", "h", "n"])
        held.clear()

    size = 0
    for b in batches:
        for lang, texts in by_language(b):
            for _, _, h, _ in reader.runs(texts):
                held.setdefault(lang, []).append(h)
                size += len(h)
                if size >= HELD:
                    yield from flush()
                    size = 0
        release_memory()
    yield from flush()


def stream(ids, new):
    """Word numbers with GAP for other words and before new pieces; lone words are left out."""
    import numpy as np

    out = np.full(len(ids) + int(new.sum()), GAP, np.int32)
    out[np.arange(len(ids)) + np.cumsum(new)] = ids
    known = out >= 0
    near = np.append(known[1:], False) | np.concatenate([[False], known[:-1]])
    out[~near] = GAP
    known = out >= 0
    return out[known | np.concatenate([[False], known[:-1]])]


def encode_streams(shared):
    """lang, text -> streams of word numbers, and the words of the numbers that a task meets."""

    def run(batches):
        import numpy as np

        reader, tables = PieceReader(), shared.value
        seen = {lang: np.zeros(len(h), bool) for lang, (h, _) in tables.items()}
        for b in batches:
            held, size = [], 0
            for lang, texts in by_language(b):
                if lang not in tables:
                    continue
                hashes, numbers = tables[lang]
                for data, start, h, new in reader.runs(texts):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    known = hashes[at] == h
                    held.append(stream(np.where(known, numbers[at], GAP), new))
                    held.append(np.array([GAP], np.int32))
                    size += len(held[-2]) + 1
                    at, start = at[known], start[known]
                    fresh, where = np.unique(at[~seen[lang][at]], return_index=True)
                    if len(fresh):
                        begin = start[~seen[lang][at]][where]
                        gaps = np.flatnonzero(reader.shingler.space[np.frombuffer(data, np.uint8)])
                        end = np.append(gaps, len(data))[np.searchsorted(gaps, begin)]
                        seen[lang][fresh] = True
                        words = [data[i:j].lower() for i, j in zip(begin.tolist(), end.tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.nulls(len(fresh), pa.binary()), pa.array(numbers[fresh].astype(np.int32)),
                             pa.array(words, pa.binary())], names=["ids", "id", "word"])
                    if size >= STREAM:
                        yield stream_batch(held)
                        held, size = [], 0
            if held:
                yield stream_batch(held)
            held = None
            release_memory()

    return run


def stream_batch(held):
    import numpy as np

    return pa.RecordBatch.from_arrays(
        [pa.array([np.concatenate(held).tobytes()], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())],
        names=["ids", "id", "word"])


# --- the numbered words ------------------------------------------------------------------------------

def frequent_words(docs: DataFrame, least: int):
    """(lang, h, n) of the frequent words, and lang, n of all words."""
    counts = stored(docs.mapInArrow(count_words, "lang string, h long, n long")
                    .groupBy("lang", "h").agg(F.sum("n").alias("n")), "word-counts")
    return counts.filter(F.col("n") >= least), counts.groupBy("lang").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame) -> DataFrame:
    """Rows of a stored table with dense numbers (``id``), by a running sum over its partitions."""
    words = words.withColumn("m", F.monotonically_increasing_id())
    part = F.shiftright("m", 33)
    sizes = {r["p"]: r["c"] for r in words.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}
    before, offsets = 0, []
    for p in sorted(sizes):
        offsets.append((p, before))
        before += sizes[p]
    table = words.sparkSession.createDataFrame(offsets, "p long, before long")  # a row for each partition
    inside = F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    return (words.withColumn("p", part).join(F.broadcast(table), "p")
            .withColumn("id", (F.col("before") + inside).cast("int")).drop("m", "p", "before"))


def lookup_tables(words: DataFrame):
    """{lang: (sorted hashes, numbers)} of at most MAX_WORDS words, for all executors."""
    import numpy as np

    found = words.select("lang", "h", "id").toArrow()
    lang, h, ids = (found.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "h", "id"))
    tables = {}
    for name in set(lang.tolist()):
        some = np.flatnonzero(lang == name)
        some = some[np.argsort(h[some])]
        tables[name] = (h[some], ids[some])
    return words.sparkSession.sparkContext.broadcast(tables)


def streams_by_join(docs: DataFrame, words: DataFrame) -> DataFrame:
    """The same streams where the words are too many for a broadcast: a row for each word, joined and gathered."""

    def split(batches):
        import numpy as np

        reader, key = PieceReader(), 0
        for b in batches:
            for lang, texts in by_language(b):
                for data, start, h, new in reader.runs(texts):
                    gaps = np.flatnonzero(reader.shingler.space[np.frombuffer(data, np.uint8)])
                    end = np.append(gaps, len(data))[np.searchsorted(gaps, start)]
                    word = [data[i:j].lower() for i, j in zip(start.tolist(), end.tolist())]
                    key += 1
                    k = len(h)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * k, pa.int64()), pa.array(np.arange(k)), pa.array([lang] * k, pa.string()),
                         pa.array(h), pa.array(new), pa.array(word, pa.binary())],
                        names=["run", "at", "lang", "h", "new", "word"])

    def gather(key, rows):
        import numpy as np

        rows = rows.sort_by("at")
        ids = rows.column("id").fill_null(GAP).to_numpy()
        new = np.asarray(rows.column("new").to_pylist(), bool)
        return pa.Table.from_batches([stream_batch([stream(ids, new), np.array([GAP], np.int32)])])

    places = stored(docs.mapInArrow(split, "run long, at long, lang string, h long, new boolean, word binary")
                    .withColumn("copy", F.spark_partition_id()), "word-places")
    joined = places.join(words.select("lang", "h", "id"), ["lang", "h"], "left")
    runs = joined.select("run", "copy", "at", "id", "new").groupBy("run", "copy").applyInArrow(
        gather, "ids binary, id int, word binary")
    names = joined.filter("id is not null").groupBy("id").agg(F.min("word").alias("word"))
    return runs.unionByName(names.select(F.lit(None).cast("binary").alias("ids"), "id", "word"))


# --- candidates and their counts --------------------------------------------------------------------

class Block:
    """A trie of phrases (numbered from ``first`` on) with words of its own numbering."""

    def __init__(self, phrases, first: int, whole: bool):
        import numpy as np

        self.words = np.unique(phrases[phrases >= 0])
        own = np.where(phrases >= 0, np.searchsorted(self.words, phrases), -1)
        self.trie = DoubleArray(own, len(self.words))
        self.first, self.whole, self.count = first, whole, len(phrases)
        self.table = None

    def own(self, ids):
        """Word numbers of a stream by the block's numbering."""
        import numpy as np

        if self.table is None:
            top = int(self.words[-1]) + 2 if len(self.words) else 1
            self.table = np.full(top, GAP, np.int32) if top <= MAX_WORDS + 2 else False
            if self.table is not False:
                self.table[self.words] = np.arange(len(self.words), dtype=np.int32)
        if self.table is not False:
            return self.table[np.minimum(ids, len(self.table) - 1)]  # a gap is -1, the last entry
        at = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
        return np.where(self.words[at] == ids, at, GAP)


def summed(found, names):
    import numpy as np

    key, n = np.unique(np.concatenate(found), return_counts=True)
    for a in range(0, len(key), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(key[a:a + (1 << 16)]), pa.array(n[a:a + (1 << 16)])], names=names)


def grow_pairs(batches):
    """Pairs of neighbouring frequent words: key (first << 31 | second), n."""
    import numpy as np

    held, size = [], 0
    for b in batches:
        for ids in b.column("ids"):
            ids = np.frombuffer(ids.as_py(), np.int32).astype(np.int64)
            ok = (ids[:-1] >= 0) & (ids[1:] >= 0)
            held.append((ids[:-1][ok] << 31) | ids[1:][ok])
            size += len(held[-1])
            if size >= HELD:
                yield from summed(held, ["key", "n"])
                held, size = [], 0
    if held:
        yield from summed(held, ["key", "n"])


def grow_phrases(shared, k: int):
    """Phrases of k + 1 words whose first k are a phrase of the trie: key (number << 31 | last word), n.

    With one trie for all, the last k must be one as well.
    """

    def run(batches):
        import numpy as np

        block = shared.value
        held, size = [], 0
        for b in batches:
            for ids in b.column("ids"):
                ids = np.frombuffer(ids.as_py(), np.int32)
                state = dict(block.trie.walk(block.own(ids), k)).get(k)
                if state is None or len(state) < 2:
                    continue
                last = ids[k:].astype(np.int64)
                ok = (state[:-1] >= 0) & (last >= 0)
                if block.whole:
                    ok &= state[1:] >= 0
                held.append(((block.trie.leaf[state[:-1][ok]].astype(np.int64) + block.first) << 31) | last[ok])
                size += len(held[-1])
                if size >= HELD:
                    yield from summed(held, ["key", "n"])
                    held, size = [], 0
        if held:
            yield from summed(held, ["key", "n"])

    return run


def count_phrases(shared):
    """slice, counts: accepting states of all levels, as the counts of SLICE phrases a row."""

    def run(batches):
        import numpy as np

        block = shared.value
        total = np.zeros(-(-block.count // SLICE) * SLICE, np.int64)
        for b in batches:
            for ids in b.column("ids"):
                for _, state in block.trie.walk(block.own(np.frombuffer(ids.as_py(), np.int32)), LONGEST):
                    leaf = block.trie.leaf[state[state >= 0]]
                    total += np.bincount(leaf[leaf >= 0], minlength=len(total))
        parts = total.reshape(-1, SLICE)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(some + block.first // SLICE), pa.array([parts[i].tobytes() for i in some], pa.binary())],
            names=["slice", "counts"])

    return run


def sum_shards(size: int):
    """pid, a: the counts of a slice, summed over all shards."""

    def run(key, table):
        import numpy as np

        total = np.zeros(size, np.int64)
        for counts in table.column("counts"):
            total += np.frombuffer(counts.as_py(), np.int64)
        some = np.flatnonzero(total)
        return pa.table({"pid": pa.array(some + key[0].as_py() * size), "a": pa.array(total[some])})

    return run


def blocks(phrases: DataFrame, total: int):
    """Broadcast tries of at most MAX_PHRASES phrases each (id, w: its words)."""
    import numpy as np

    if not total:
        return
    sc = phrases.sparkSession.sparkContext
    for a in range(0, total, MAX_PHRASES):
        some = phrases.filter(F.col("id").between(a, a + MAX_PHRASES - 1)).select(
            "id", *[F.get("w", F.lit(i)).alias(f"w{i}") for i in range(LONGEST)]).toArrow()
        order = np.argsort(some.column("id").to_numpy())
        rows = np.stack([some.column(f"w{i}").fill_null(GAP).to_numpy() for i in range(LONGEST)], axis=1)[order]
        yield sc.broadcast(Block(rows.astype(np.int64), a, total <= MAX_PHRASES))


def over_blocks(streams: DataFrame, phrases: DataFrame, task, schema: str) -> DataFrame:
    """The rows of one pass over the streams for each trie, written before the next trie is sent."""
    out, total = None, phrases.count()
    for shared in blocks(phrases, total):
        part = stored(streams.mapInArrow(task(shared), schema), "phrase-pass")
        out = part if out is None else out.unionByName(part)
        shared.destroy()
    return out if out is not None else streams.sparkSession.createDataFrame([], schema)


def candidate_phrases(streams: DataFrame, least: int) -> DataFrame:
    """id, w (word numbers): the candidates of two to LONGEST words, level by level."""
    word = F.col("key").bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    head = F.shiftright("key", 31)

    def often(rows):
        return rows.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)

    pairs = often(streams.mapInArrow(grow_pairs, "key long, n long"))
    level = numbered(stored(pairs.select(F.array(head.cast("int"), word).alias("w")), "phrases-2"))
    levels = [level]
    for k in range(2, LONGEST):
        grown = often(over_blocks(streams, level, lambda shared, k=k: grow_phrases(shared, k), "key long, n long"))
        longer = grown.select(head.alias("id"), word.alias("last")).join(level, "id").select(
            F.concat("w", F.array("last")).alias("w"))
        level = numbered(stored(longer, f"phrases-{k + 1}"))
        levels.append(level)
    every = levels[0].select("w")
    for more in levels[1:]:
        every = every.unionByName(more.select("w"))
    # phrases that start alike share a trie: each then holds the beginnings of all its phrases
    return numbered(stored(every.repartitionByRange(F.col("w")).sortWithinPartitions("w"), "candidates"))


# --- scores -----------------------------------------------------------------------------------------

def phrase_scores(found: DataFrame, words: DataFrame) -> DataFrame:
    """lang, w, a, l, r, score of every candidate (w, a) that no longer one takes the place of."""
    of_words = words.select("lang", F.array("id").alias("w"), F.col("n").alias("f"))
    named = found.join(words.select("lang", F.col("id").alias("first")), F.get("w", F.lit(0)) == F.col("first"))
    named = stored(named.select("lang", "w", "a"), "counted-phrases")
    parts = of_words.unionByName(named.select("lang", "w", F.col("a").alias("f"))).select("w", "f")
    cuts = named.select("w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    cuts = cuts.withColumn("head", F.slice("w", F.lit(1), F.col("cut"))) \
        .withColumn("tail", F.slice("w", F.col("cut") + 1, F.size("w") - F.col("cut")))
    cuts = cuts.join(parts.select(F.col("w").alias("head"), F.col("f").alias("l")), "head") \
        .join(parts.select(F.col("w").alias("tail"), F.col("f").alias("r")), "tail")
    score = F.expr("CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(7, 0)) "
                   "div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    best = cuts.groupBy("w").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    spans = F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("w") - 1),
        lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.slice("w", i, k))))
    inside = (named.filter(F.size("w") > 2).select("a", F.explode(spans).alias("w"))
              .groupBy("w").agg(F.max("a").alias("longer")))
    covered = F.lit(100).cast("decimal(20,0)") * F.col("longer") >= F.lit(80).cast("decimal(20,0)") * F.col("a")
    return (named.join(inside, "w", "left").filter(~F.coalesce(covered, F.lit(False))).join(best, "w")
            .select("lang", "w", "a", "best.l", "best.r", "best.score"))


def spelled(phrases: DataFrame, names: DataFrame) -> DataFrame:
    """``phrases`` with the text of their words (w) in ``phrase``."""
    words = phrases.select("w", F.posexplode("w").alias("at", "id")).join(names, "id")
    texts = words.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("x"))
    return phrases.join(texts.select("w", F.array_join(F.col("x.word"), " ").alias("phrase")), "w")


def top_phrases(phrases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language, first within salted parts so that no task gets a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = Window.partitionBy("lang", "salt").orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    some = (phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
            .withColumn("place", F.row_number().over(part)).filter(F.col("place") <= top).drop("salt", "place"))
    return some.withColumn("rank", F.row_number().over(whole).cast("long")).filter(F.col("rank") <= top)


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first phrases of ``docs`` (text, lang)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text is not null")
    often, totals = frequent_words(texts, least)
    words = stored(numbered(stored(often, "frequent-words")), "numbered-words")
    if words.count() <= MAX_WORDS:
        encoded = stored(texts.mapInArrow(encode_streams(lookup_tables(words)), "ids binary, id int, word binary"),
                         "word-streams")
    else:
        encoded = stored(streams_by_join(texts, words), "word-streams")
    streams = encoded.filter("ids is not null").select("ids")
    names = (encoded.filter("id is not null").groupBy("id")
             .agg(F.min("word").alias("word")).select("id", F.col("word").cast("string").alias("word")))
    phrases = stored(candidate_phrases(streams, least), "candidate-phrases")
    counted = over_blocks(streams, phrases, count_phrases, "slice long, counts binary").groupBy("slice").applyInArrow(
        sum_shards(SLICE), "pid long, a long")
    found = phrases.join(counted, phrases["id"] == counted["pid"]).filter(F.col("a") >= least).select("w", "a")
    ranked = top_phrases(spelled(phrase_scores(found, words), names), top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
