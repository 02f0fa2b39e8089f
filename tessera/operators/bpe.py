"""Byte-pair merges learned to a vocabulary budget, many merges per job.

The distinct pre-tokens are stored as streams of symbol numbers (0 to 255
are bytes, 256 + r is the r-th merge) with a gap after each word, and a
count for each word.  A round gives all tasks the merges chosen last; they
apply them, and report how the counts of neighbouring pairs changed in the
words that the merges touch.  The driver keeps the pairs above a floor
count: a pair that exists can only lose occurrences, and all occurrences of
a new pair lie in touched words, so no pair below the floor can pass it
unseen.  The floor is lowered by a full count when the leaders reach it.

One round takes several merges as long as they cannot affect each other: in
order of count, a pair joins the batch if it shares no symbol in a way that
a merge before it would consume, and if its count is above that of any pair
that the merges before it can create.  That bound is exact context counts,
the most frequent neighbour on either side of the pair, which tasks report
for the leaders of the round before and for new pairs.  The merges are
those that one merge at a time gives.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir

GAP = -1
BLOCK = 1 << 16    # words in a stored stream when it is first made
STREAM = 1 << 20   # symbols at least in a stream that a task handles at once, if it has as many
SUMMED = 1 << 21   # new rows that a task collects before it sums them
KEPT = 1 << 20     # pairs that the driver keeps
LEADERS = 128      # pairs whose contexts are counted in each round
BATCH = 64         # merges in a round at most: bounds what a round reports
STORE_EVERY = 4    # rounds whose merges tasks apply again before the streams are written


# --- inside tasks --------------------------------------------------------------------------------

def merge_word(symbols: list, ranks: dict) -> list:
    """A word's symbols after all merges of ``ranks`` ((a, b) -> number of ab), the first learned first."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best = min(((ranks[p], p) for p in zip(symbols, symbols[1:]) if p in ranks), default=None)
        if best is None:
            break
        new, (a, b) = best
        out, i = [], 0
        while i < len(symbols):
            if i + 1 < len(symbols) and symbols[i] == a and symbols[i + 1] == b:
                out.append(new)
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


class PairNumbers:
    """The number of each of a few pairs, -1 for all others; ``symbols`` is above every symbol met."""

    def __init__(self, firsts, seconds, numbers, symbols: int):
        import numpy as np

        a, row = np.unique(firsts, return_inverse=True)
        b, column = np.unique(seconds, return_inverse=True)
        self.row, self.column = np.zeros(symbols + 1, np.int32), np.zeros(symbols + 1, np.int32)
        self.row[a], self.column[b] = np.arange(1, len(a) + 1), np.arange(1, len(b) + 1)
        self.numbers = np.full((len(a) + 1, len(b) + 1), -1, np.int32)
        self.numbers[row + 1, column + 1] = numbers
        self.first = self.row > 0

    def find(self, stream):
        """(places, numbers) of the pairs; a gap looks at the last entry, which no symbol has."""
        import numpy as np

        at = np.flatnonzero(self.first[stream[:-1]])
        number = self.numbers[self.row[stream[at]], self.column[stream[at + 1]]]
        hit = number >= 0
        return at[hit], number[hit]


def merge_places(stream, batch):
    """(places, new symbols) of the merges (a, b, new) of a batch, which never overlap."""
    import numpy as np

    a, b, new = (np.array(x, np.int64) for x in zip(*batch))
    symbols = int(max(stream.max(initial=0), a.max(), b.max())) + 1
    at, made = PairNumbers(a, b, new, symbols).find(stream)
    if (a == b).any():  # runs of one symbol: every other place, from the left
        run = np.cumsum(np.diff(at, prepend=-2) != 1)
        start = np.flatnonzero(np.diff(run, prepend=0))
        offset = np.arange(len(at)) - start[run - 1] if len(at) else at
        keep = ~np.isin(made, new[a == b]) | (offset % 2 == 0)
        at, made = at[keep], made[keep]
    return at, made


def merge_stream(stream, batch):
    """The stream after the merges of a batch."""
    return merge_at(stream, *merge_places(stream, batch))[0] if batch else stream


def merge_at(stream, at, made):
    """The stream after merges at these places, and which entries of the old one are left."""
    import numpy as np

    left = np.ones(len(stream), bool)
    left[at + 1] = False
    out = stream.copy()
    out[at] = made
    return out[left], left


def numbered(merges) -> list:
    """Pieces (a, b) of a merge list as (a, b, new) of symbols."""
    ranks, number = {}, {f"{i:02X}": i for i in range(256)}
    for i, (a, b) in enumerate(merges):
        ranks[number[a], number[b]] = number[a + b] = 256 + i
    return sorted(((a, b, new) for (a, b), new in ranks.items()), key=lambda m: m[2])


def apart(merges) -> list:
    """A list of merges (a, b, new) as batches in a row whose merges never overlap."""
    out, firsts, seconds = [], set(), set()
    for a, b, new in merges:
        if (not out or b in firsts or a in seconds or max(a, b) >= out[-1][0][2]
                or (a == b and (a in firsts or b in seconds)) or any(x == y for x, y, _ in out[-1][-1:])):
            out.append([])
            firsts, seconds = set(), set()
        out[-1].append((a, b, new))
        firsts.add(a)
        seconds.add(b)
    return out


def weighted(keys, weights):
    import numpy as np

    unique, of = np.unique(keys, return_inverse=True)
    return unique, np.bincount(of, weights, len(unique)).astype(np.int64)  # exact below 2**53


def keys_at(stream, at):
    """Which of the places hold a pair within a word, and these pairs (a << 32 | b)."""
    import numpy as np

    at = at[stream[at] != GAP]
    at = at[stream[at + 1] != GAP]
    return at, (stream[at].astype(np.int64) << 32) | stream[at + 1]


class Sums:
    """Weights summed by (pair, side) over the blocks of a task."""

    def __init__(self):
        self.parts, self.rows = [], 0

    def add(self, pairs, sides, weights):
        self.parts.append((pairs, sides, weights))
        self.rows += len(pairs)
        if self.rows > SUMMED:
            self.parts, self.rows = [self.total()], 0

    def total(self):
        import numpy as np

        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        pairs, sides, weights = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((sides, pairs))
        pairs, sides, weights = pairs[order], sides[order], weights[order]
        start = np.flatnonzero(np.concatenate([[True], (np.diff(pairs) != 0) | (np.diff(sides) != 0)])[:len(pairs)])
        weights = np.add.reduceat(weights, start) if len(start) else weights
        return pairs[start], sides[start], weights


def read_blocks(batches, pending):
    """(stream, counts) of the stored blocks, small ones joined, with the pending batches applied."""
    import numpy as np

    def joined(streams, counts):
        stream = np.concatenate(streams)
        for batch in pending:
            stream = merge_stream(stream, batch)
        return stream, np.concatenate(counts)

    streams, counts, size = [], [], 0
    for b in batches:
        for ids, n in zip(b.column("ids"), b.column("n")):
            streams.append(np.frombuffer(ids.as_py(), np.int32))
            counts.append(np.frombuffer(n.as_py(), np.int64))
            size += len(streams[-1])
            if size >= STREAM:
                yield joined(streams, counts)
                streams, counts, size = [], [], 0
    if streams:
        yield joined(streams, counts)


def symbol_weights(stream, counts):
    """The count of its word for every entry of the stream."""
    import numpy as np

    return np.repeat(counts, np.diff(np.flatnonzero(stream == GAP), prepend=-1))


def rows_of(pair, side, n):
    return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(side), pa.array(n)], names=["pair", "side", "n"])


def pack_words(known):
    """pieces (hex bytes), n -> blocks of streams, with batches of known merges applied."""

    def run(batches):
        import numpy as np

        for b in batches:
            pieces, n = b.column("pieces").to_pylist(), b.column("n").to_numpy().astype(np.int64)
            for a in range(0, len(pieces), BLOCK):
                stream = []
                for p in pieces[a:a + BLOCK]:
                    stream += bytes.fromhex(p)
                    stream.append(GAP)
                stream = np.array(stream, np.int32)
                for batch in known:
                    stream = merge_stream(stream, batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([stream.tobytes()], pa.binary()),
                     pa.array([n[a:a + BLOCK].tobytes()], pa.binary())], names=["ids", "n"])

    return run


def full_count(pending):
    def run(batches):
        import numpy as np

        sums = Sums()
        for stream, counts in read_blocks(batches, pending):
            at, keys = keys_at(stream, np.arange(len(stream) - 1))
            pair, n = weighted(keys, symbol_weights(stream, counts)[at])
            sums.add(pair, np.zeros(len(pair), np.int64), n)
        yield rows_of(*sums.total())

    return run


def apply_round(pending, batch, leaders, base):
    """Changes of pair counts (side 0) and contexts of the leaders and of pairs with symbols from ``base`` on.

    A context is a neighbour; the side is the neighbour's sign.  The leaders' symbols are below ``base``,
    so their contexts are summed in one array of (side, leader, neighbour).
    """

    def run(batches):
        import numpy as np

        known, symbols = np.array(leaders, np.int64), base + len(batch)
        lead = PairNumbers(known >> 32, known & 0xFFFFFFFF, np.arange(len(known)), symbols)
        near = np.zeros(2 * len(known) * symbols, np.int64)
        sums = Sums()
        for stream, counts in read_blocks(batches, pending):
            weights = symbol_weights(stream, counts)
            if batch:
                at, made = merge_places(stream, batch)
                after, left = merge_at(stream, at, made)
                was = np.zeros(len(stream), bool)
                was[at - 1] = was[at] = was[at + 1] = True  # place -1 is the last gap
                old, old_keys = keys_at(stream, np.flatnonzero(was))
                lost, weights = weights[old], weights[left]
                fresh = after >= base
                new, new_keys = keys_at(after, np.flatnonzero(fresh[:-1] | fresh[1:]))
                pair, n = weighted(np.concatenate([old_keys, new_keys]), np.concatenate([-lost, weights[new]]))
                sums.add(pair[n != 0], np.zeros(int((n != 0).sum()), np.int64), n[n != 0])
                sums.add(*contexts(after, weights, new, new_keys))
                stream = after
            if len(known):
                at, number = lead.find(stream)
                before, behind = stream[at - 1], stream[at + 2]  # place -1 is the last gap
                for side, by in enumerate((before, behind)):
                    ok = by != GAP
                    place = (side * len(known) + number[ok].astype(np.int64)) * symbols + by[ok]
                    near += np.bincount(place, weights[at[ok]], len(near)).astype(np.int64)
        yield rows_of(*sums.total())
        found = np.flatnonzero(near)
        side, by = found // (len(known) * symbols) if len(found) else found, found % symbols
        yield rows_of(known[found // symbols % max(1, len(known))], np.where(side == 0, by + 1, -by - 1), near[found])

    return run


def contexts(stream, weights, at, keys):
    """(pair, neighbour, weight) of the pairs ``keys`` at these places."""
    import numpy as np

    before, behind = stream[at - 1].astype(np.int64), stream[at + 2].astype(np.int64)
    left, right = before != GAP, behind != GAP
    return (np.concatenate([keys[left], keys[right]]), np.concatenate([before[left] + 1, -behind[right] - 1]),
            np.concatenate([weights[at[left]], weights[at[right]]]))


def store_blocks(pending):
    def run(batches):
        for stream, counts in read_blocks(batches, pending):
            yield pa.RecordBatch.from_arrays([pa.array([stream.tobytes()], pa.binary()),
                                              pa.array([counts.tobytes()], pa.binary())], names=["ids", "n"])

    return run


# --- the driver's part -------------------------------------------------------------------------

class Leaders:
    """Counts of the pairs above a floor, the largest first; ties go to the smallest pair of pieces."""

    def __init__(self, pieces: list[str], counts: dict, floor: int):
        self.pieces, self.counts, self.floor = pieces, counts, floor
        self.heap = [self.entry(p) for p in counts]
        heapq.heapify(self.heap)

    def entry(self, pair: int):
        a, b = pair >> 32, pair & 0xFFFFFFFF
        return -self.counts[pair], f"{self.pieces[a]} {self.pieces[b]}", pair

    def change(self, pair: int, n: int) -> None:
        """A known pair loses occurrences; a new one comes with all of its."""
        if pair in self.counts:
            self.counts[pair] += n
        elif n >= self.floor:
            self.counts[pair] = n
        else:
            return
        if self.counts[pair] < max(1, self.floor):
            del self.counts[pair]
        else:
            heapq.heappush(self.heap, self.entry(pair))

    def take(self, k: int):
        """The first ``k`` as (pair, count)."""
        out, back = [], []
        while self.heap and len(out) < k:
            e = heapq.heappop(self.heap)
            if self.counts.get(e[2]) == -e[0] and (not back or back[-1] != e):
                out.append((e[2], -e[0]))
                back.append(e)
        for e in back:
            heapq.heappush(self.heap, e)
        return out


def choose_batch(leaders, bounds: dict, most: int):
    """The pairs that one merge at a time would take next, as far as contexts tell."""
    out, bound, firsts, seconds = [], 0, set(), set()
    for pair, n in leaders:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        if len(out) >= most or (out and n <= bound) or b in firsts or a in seconds:
            break
        out.append((pair, n))
        if pair not in bounds or a == b:
            break
        bound = max(bound, bounds[pair])
        firsts.add(a)
        seconds.add(b)
    return out


class Trainer:
    """Rounds over the stored streams of the words of ``table`` (pieces, n)."""

    def __init__(self, table: DataFrame, initial=()):
        import uuid

        self.spark = table.sparkSession
        self.folder = f"{checkpoint_dir(self.spark).rstrip('/')}/bpe-{uuid.uuid4().hex}"
        self.pieces = [f"{i:02X}" for i in range(256)]
        known = numbered(initial)
        self.pieces += [a + b for a, b in initial]
        self.pending, self.rounds, self.stored = [], 0, 0
        # few bytes and much work: adaptive execution would leave too few tasks
        table = table.repartition(2 * self.spark.sparkContext.defaultParallelism)
        self.blocks = self.store(table.mapInArrow(pack_words(apart(known)), "ids binary, n binary"))

    def store(self, blocks: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.stored}"
        blocks.write.parquet(path)
        if self.stored:
            self.delete(f"{self.folder}/{self.stored - 1}")  # its jobs have ended
        self.stored += 1
        return self.spark.read.schema("ids binary, n binary").parquet(path)

    def delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def count(self) -> Leaders:
        """All pairs, or those above the least power of two that leaves at most KEPT."""
        sums = (self.blocks.mapInArrow(full_count(self.pending), "pair long, side long, n long")
                .groupBy("pair").agg(F.sum("n").alias("n")))
        path = f"{self.folder}/pairs-{self.rounds}"
        sums.write.parquet(path)
        sums = self.spark.read.schema("pair long, n long").parquet(path)
        sizes = sorted(((r["k"], r["c"]) for r in sums.groupBy(F.floor(F.log2("n")).alias("k"))
                        .agg(F.count(F.lit(1)).alias("c")).collect()), reverse=True)
        total, floor = 0, 1
        for k, c in sizes:
            if total and total + c > KEPT:
                floor = 1 << (k + 1)
                break
            total += c
        found = sums.filter(F.col("n") >= floor).toArrow()
        return Leaders(self.pieces, dict(zip(found.column("pair").to_pylist(), found.column("n").to_pylist())), floor)

    def round(self, batch, watched):
        """(pair, change, bound) after the merges of ``batch``."""
        rows = self.blocks.mapInArrow(apply_round(self.pending, batch, [p for p, _ in watched], batch[0][2] if batch
                                                  else len(self.pieces)), "pair long, side long, n long")
        sums = rows.groupBy("pair", "side").agg(F.sum("n").alias("n"))
        found = sums.groupBy("pair").agg(F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("change"),
                                         F.max(F.when(F.col("side") != 0, F.col("n"))).alias("bound")).toArrow()
        self.pending = [*self.pending, batch] if batch else self.pending
        self.rounds += 1
        if len(self.pending) >= STORE_EVERY:
            self.blocks = self.store(self.blocks.mapInArrow(store_blocks(self.pending), "ids binary, n binary"))
            self.pending = []
        return zip(*(found.column(c).to_pylist() for c in ("pair", "change", "bound")))

    def train(self, n_merges: int) -> list:
        """[(a, b, count)] of the next merges, as pieces."""
        merges, leaders, bounds, batch = [], self.count(), {}, []
        while len(merges) < n_merges:
            watched = leaders.take(LEADERS)
            known = {p for p, _ in watched}
            bounds = {p: 0 for p in known}
            for pair, change, bound in self.round(batch, watched):
                if change:
                    leaders.change(pair, change)
                if bound is not None:
                    bounds[pair] = bound
                elif pair >> 32 >= len(self.pieces) - len(batch) or pair & 0xFFFFFFFF >= len(self.pieces) - len(batch):
                    bounds[pair] = 0  # a new pair without neighbours
            first = leaders.take(min(BATCH, n_merges - len(merges)) + 1)
            if not first:
                if leaders.floor <= 1:
                    break
                leaders, batch = self.count(), []  # the leaders are used up: count again with a lower floor
                continue
            chosen = choose_batch(first, bounds, min(BATCH, n_merges - len(merges)))
            batch = []
            for pair, n in chosen:
                a, b = pair >> 32, pair & 0xFFFFFFFF
                batch.append((a, b, len(self.pieces)))
                merges.append((self.pieces[a], self.pieces[b], n))
                self.pieces.append(self.pieces[a] + self.pieces[b])
        return merges


def train_merges(table: DataFrame, n_merges: int, initial=()) -> DataFrame:
    """``n_merges`` merges learned from ``table`` (pieces, n), after those of ``initial``; (rank, a, b, n).

    The most frequent pair first, ties to the smallest pair of pieces.  An
    empty table gives none; fewer are learned where no pair is left.
    """
    initial = list(initial)
    trainer = Trainer(table, initial)
    merges = trainer.train(n_merges)
    trainer.delete(trainer.folder)
    rows = [(i + len(initial), a, b, n) for i, (a, b, n) in enumerate(merges)]
    return table.sparkSession.createDataFrame(rows, "rank int, a string, b string, n long")


def merged_words(words, batches):
    """The symbols of all words (a string array), one after the other, and how many each has."""
    import numpy as np

    data = [w.encode() for w in words.to_pylist()]
    ends = np.cumsum([len(w) + 1 for w in data], dtype=np.int64) - 1  # a gap after each word
    stream = np.full(len(data) + sum(map(len, data)), GAP, np.int32)
    inside = np.ones(len(stream), bool)
    inside[ends] = False
    stream[inside] = np.frombuffer(b"".join(data), np.uint8)
    for batch in batches if len(stream) else ():
        stream = merge_stream(stream, batch)
    return stream[stream != GAP], np.diff(np.flatnonzero(stream == GAP), prepend=-1) - 1


def encode_texts(df: DataFrame, merges: list[tuple[str, str]], pretoken: str, text_col: str = "text",
                 first_id: int = 256) -> DataFrame:
    """``df`` with ``ids``: token ids of each text by a whole merge list (byte b is id first_id - 256 + b).

    The distinct pre-tokens of an Arrow batch are merged at once.  A null text has null ids.
    """
    shared = df.sparkSession.sparkContext.broadcast(apart(numbered(merges)))  # as many entries as the vocabulary
    shift = first_id - 256

    @F.arrow_udf("array<int>")
    def encode(words: pa.Array) -> pa.Array:
        import numpy as np
        import pyarrow.compute as pc

        coded = words.flatten().dictionary_encode()
        word, per_row = coded.indices.to_numpy(), pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        symbols, sizes = merged_words(coded.dictionary, shared.value)
        n = sizes[word]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat((np.cumsum(sizes) - sizes)[word] - ends[:-1], n) + np.arange(ends[-1])
        offsets = ends[np.concatenate([[0], np.cumsum(per_row)])]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(symbols[at] + shift, pa.int32()),
                                        mask=words.is_null())

    pieces = F.regexp_extract_all(F.concat(F.lit(" "), F.col(text_col)), F.lit(pretoken), 0)
    return df.withColumn("ids", encode(pieces))
