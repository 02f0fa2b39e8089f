"""Removal of repeated byte strings, found by suffix arrays.

Each byte covered by a string of ``length`` bytes that also starts anywhere
else, in the same text or another, is removed.  A window (the string that
starts at one place) is known by its anchor, the least hashed gram inside
it; equal windows have equal anchors.  A piece is a run of windows with one
anchor, so each task can cut its own texts.  Pieces whose anchor occurs once
hold no repeated window.  Of the others each different piece is fetched once,
with the number of its places, and goes to a shard by its anchor.  A shard
sorts its suffixes in two stages (``suffixes``) and compares neighbours:
windows with a common prefix of ``length`` bytes, and windows of pieces with
several places, are repeated.

An anchor with more than HOT different pieces (the edge of a passage that
many texts share) is split: its pieces are cut by the distance between
window and anchor, and meet again by the bytes that all windows of a cut
share; cuts that are still too many come down to single windows, where a
group is one string.

Edge cases: a null text is empty; texts shorter than ``length`` keep all;
repeated rows are each other's copies; matches never cross texts; a text of
any length is cut in runs of CHUNK windows; an empty table gives no rows;
other columns are ignored.  Anchors, pieces and rows are known by 64-bit
hashes; windows in a shard are compared byte by byte.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import passing, release_memory, stored
from tessera.llm.keyfilter import key_filter
from tessera.llm.shingles import _mix
from tessera.llm.suffixes import SEPARATOR, common_prefixes, load_words, suffix_order

LENGTH = 200
CHUNK = 1 << 18   # windows of a long text looked at together (below 2**24: places share a word with hashes)
SHARD = 2048      # pieces that a task sorts together
HOT = 2000        # different pieces of one anchor beyond which it is split
WIDTH = 16        # windows in a cut of a split piece
BATCH = 1 << 15   # pieces handed on at a time


# --- inside tasks ------------------------------------------------------------------------------

def gram_bytes(length: int) -> int:
    return max(8, length // 32 * 8)


def gram_hashes(data: bytes, gram: int):
    """A hash of the ``gram`` bytes from each place on."""
    import numpy as np

    n = len(data) - gram + 1
    words = load_words(data, len(data), 0)
    h = words[:n].copy()
    for j in range(8, gram, 8):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[j:j + n]
    return _mix(h)


def cut_pieces(data: bytes, length: int):
    """(first window, number of windows, place of the anchor in the piece, anchor) of the pieces of a text."""
    import numpy as np

    gram = gram_bytes(length)
    span = length - gram + 1  # grams in a window
    for base in range(0, len(data) - length + 1, CHUNK):
        part = data[base:base + CHUNK + length - 1]
        h = gram_hashes(part, gram)
        windows = len(part) - length + 1
        # hash above, place below: the leftmost of the least grams wins
        key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        rows = np.concatenate([key, np.full(-len(key) % span, 2 ** 64 - 1, np.uint64)]).reshape(-1, span)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:windows], ahead[span - 1:span - 1 + windows])
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
        size = np.diff(np.append(first, windows))
        yield first + base, size, anchor[first] - first, h[anchor[first]].view(np.int64)


def list_pieces(length: int):
    """rk, data -> g (anchor), h (hash of the piece's bytes), rk, start, size, at."""

    def run(batches):
        import numpy as np
        import xxhash

        digest = xxhash.xxh64_intdigest
        names = ["g", "h", "rk", "start", "size", "at"]

        def rows(held):
            first, size, at, g, rk, h = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays(
                [pa.array(g), pa.array(h.view(np.int64)), pa.array(rk), pa.array(first.astype(np.int32)),
                 pa.array(size.astype(np.int32)), pa.array(at.astype(np.int32))], names=names)

        for b in batches:
            held, count = [], 0
            for rk, data in zip(b.column("rk").to_pylist(), b.column("data")):
                data = data.as_py()
                for first, size, at, g in cut_pieces(data, length):
                    h = np.fromiter((digest(data[i:i + k + length - 1]) for i, k in zip(first.tolist(), size.tolist())),
                                    np.uint64, len(first))
                    held.append((first, size, at, g, np.full(len(first), rk, np.int64), h))
                    count += len(first)
                    if count >= BATCH:
                        yield rows(held)
                        held, count = [], 0
            if held:
                yield rows(held)
            held = None
            release_memory()

    return run


def fetch_pieces(length: int):
    """data, wanted -> the bytes of the wanted pieces."""

    def run(batches):
        for b in batches:
            for data, wanted in zip(b.column("data"), b.column("wanted")):
                data, wanted = data.as_py(), wanted.as_py()
                for a in range(0, len(wanted), BATCH):
                    part = wanted[a:a + BATCH]
                    cut = [data[w["start"]:w["start"] + w["size"] + length - 1] for w in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w[c] for w in part], t) for c, t in
                         (("g", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("at", pa.int32()))]
                        + [pa.array(cut, pa.binary())], names=["g", "h", "n", "at", "data"])
            release_memory()

    return run


def split_pieces(length: int, width: int):
    """Cuts of ``width`` windows by their distance from the anchor, keyed by the bytes that they all hold."""

    def run(batches):
        import xxhash

        names = ["g", "h", "lo", "n", "g2", "h2", "at2", "data2"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

        def signed(x):
            return x - (1 << 64) if x >> 63 else x

        for b in batches:
            out = []
            for g, h, n, at, data in zip(*(b.column(c).to_pylist() for c in ("g", "h", "n", "at", "data"))):
                size = len(data) - length + 1
                for j in range((at - size + 1) // width, at // width + 1):
                    near, far = at - j * width, at - j * width - width + 1  # last and first window of the cut
                    lo, hi = max(0, far), min(size - 1, near)
                    own = data[lo:hi + length]
                    key = xxhash.xxh64(data[near:far + length], seed=(g ^ j) & (2 ** 64 - 1)).intdigest()
                    out.append((g, h, lo, n, signed(key), signed(xxhash.xxh64_intdigest(own)), at - lo, own))
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=names)
            out = None
            release_memory()

    return run


def repeated_windows(pieces: list[bytes], counts, length: int):
    """Marks (piece, window) as two arrays: the windows of different pieces, or of a piece that has
    several places, that share ``length`` bytes with another window."""
    import numpy as np

    text = bytes([SEPARATOR]).join(pieces)
    sizes = np.array([len(p) for p in pieces], np.int64)
    start = np.cumsum(sizes + 1) - sizes - 1
    change = np.zeros(len(text) + 1, np.int64)
    change[start] += 1
    change[start + sizes - length + 1] -= 1
    whole = np.cumsum(change[:-1]) > 0
    order = suffix_order(text, whole, length)
    same = common_prefixes(order, text, -(-length // 8) * 8) >= length
    repeated = same | np.append(same[1:], False)
    piece = np.searchsorted(start, order, side="right") - 1
    # a string of a piece with several places is repeated, and so is what equals it (marked above)
    repeated |= np.asarray(counts)[piece] > 1
    at = np.sort(order[repeated])
    piece = np.searchsorted(start, at, side="right") - 1
    return piece, at - start[piece]


def sort_shard(length: int):
    """Runs [lo, hi) of the repeated windows of each piece of a shard."""

    def run(key, table):
        import numpy as np

        index = {}
        for i, k in enumerate(zip(table.column("g").to_pylist(), table.column("h").to_pylist())):
            index.setdefault(k, i)  # a piece may come from several copies of its row
        table = table.take(pa.array(list(index.values()), pa.int64()))
        data, n = table.column("data").to_pylist(), table.column("n").to_numpy()
        piece, at = repeated_windows(data, n, length)
        new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(piece) != 0)]) if len(at) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1 if len(first) else first
        of = pa.array(piece[first])
        out = pa.table({"g": table.column("g").take(of), "h": table.column("h").take(of),
                        "lo": pa.array(at[first].astype(np.int32)), "hi": pa.array((at[last] + 1).astype(np.int32))})
        release_memory()
        return out

    return run


def remove_runs(batches):
    """doc_id, data, runs -> doc_id, n_bytes, spans (maximal removed runs), kept."""
    import numpy as np

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for b in batches:
        for i in range(b.num_rows):
            data, runs = b.column("data")[i].as_py(), b.column("runs")[i].values
            spans, kept = [], []
            if runs is not None and len(runs):
                a, z = (runs.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in (0, 1))
                order = np.argsort(a, kind="stable")
                a, z = a[order], np.maximum.accumulate(z[order])
                new = np.concatenate([[True], a[1:] > z[:-1]])
                first = np.flatnonzero(new)
                spans = list(zip(a[first].tolist(), z[np.append(first[1:], len(a)) - 1].tolist()))
            end = 0
            for x, y in spans:
                kept.append(data[end:x])
                end = y
            kept.append(data[end:])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").slice(i, 1), pa.array([len(data)], pa.int64()),
                 pa.array([[{"start": x, "end": y} for x, y in spans]], span), pa.array([b"".join(kept)], pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"])
        release_memory()


# --- the plan ------------------------------------------------------------------------------------

def sorted_runs(pieces: DataFrame, length: int) -> DataFrame:
    """(g, h, lo, hi) of all pieces, each anchor's in one shard."""
    shards = -(-pieces.count() // SHARD) or 1
    return (pieces.groupBy(F.pmod(F.xxhash64("g"), F.lit(shards)).alias("shard"))
            .applyInArrow(sort_shard(length), "g long, h long, lo int, hi int"))


def find_runs(pieces: DataFrame, length: int, keep, width: int = WIDTH) -> DataFrame:
    """Runs of repeated windows of ``pieces`` (g, h, n, at, data); anchors with too many pieces are split."""
    hot = keep(pieces.groupBy("g").count().filter(F.col("count") > HOT).select("g"), "hot-anchors")
    if not width or hot.isEmpty():
        return sorted_runs(pieces, length)
    cuts = keep(pieces.join(hot, "g", "left_semi").select("g", "h", "n", "at", "data").mapInArrow(
        split_pieces(length, width),
        "g long, h long, lo int, n long, g2 long, h2 long, at2 int, data2 binary"), "cuts")
    inner = (cuts.groupBy(F.col("g2").alias("g"), F.col("h2").alias("h"))
             .agg(F.sum("n").alias("n"), F.any_value("at2").alias("at"), F.any_value("data2").alias("data")))
    found = find_runs(keep(inner, "cut-pieces"), length, keep, 1 if width > 1 else 0)
    found = found.select(F.col("g").alias("g2"), F.col("h").alias("h2"), F.col("lo").alias("lo2"), "hi")
    back = cuts.select("g", "h", "lo", "g2", "h2").join(found, ["g2", "h2"]).select(
        "g", "h", (F.col("lo") + F.col("lo2")).alias("lo"), (F.col("lo") + F.col("hi")).alias("hi"))
    return sorted_runs(pieces.join(hot, "g", "left_anti"), length).unionByName(back)


def repeated_runs(rows: DataFrame, length: int, keep) -> DataFrame:
    """(rk, runs): for each row of (rk, data) with repeated windows the byte runs that these cover."""
    every = (rows.filter(F.octet_length("data") >= length).select("rk", "data")
             .mapInArrow(list_pieces(length), "g long, h long, rk long, start int, size int, at int"))
    again = keep(every.groupBy("g").count().filter("count > 1").select("g"), "anchors")
    places = keep(every.filter(key_filter(again, "g")("g")).join(again, "g"), "places")
    different = keep(places.groupBy("g", "h").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("rk", "start", "size", "at")).alias("one")), "pieces")
    asked = different.select("one.*", "g", "h", "n").groupBy("rk").agg(
        F.collect_list(F.struct("g", "h", "n", "start", "size", "at")).alias("wanted"))
    pieces = keep(rows.filter(key_filter(different.select("one.rk"), "rk")("rk")).join(asked, "rk")
                    .select("data", "wanted")
                    .mapInArrow(fetch_pieces(length), "g long, h long, n long, at int, data binary"), "piece-bytes")
    found = find_runs(pieces, length, keep)
    run = F.struct((F.col("start") + F.col("lo")).alias("a"),
                   (F.col("start") + F.col("hi") + F.lit(length - 1)).alias("z"))
    return (places.select("g", "h", "rk", "start").join(found, ["g", "h"]).groupBy("rk")
            .agg(F.collect_set(run).alias("runs")))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs of bytes) and kept (the bytes left) for each row of ``docs``."""
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    rows = rows.withColumn("rk", F.xxhash64("doc_id", "data"))
    with passing(docs.sparkSession) as keep:
        runs = stored(repeated_runs(rows, length, keep), "repeats")
    touched = key_filter(runs, "rk")
    span = "array<struct<start: long, end: long>>"
    cut = (rows.filter(touched("rk")).join(runs, "rk", "left").select("doc_id", "data", "runs")
           .mapInArrow(remove_runs, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, spans {span}, kept binary"))
    whole = rows.filter(~touched("rk")).select(
        "doc_id", F.octet_length("data").cast("long").alias("n_bytes"),
        F.array().cast(span).alias("spans"), F.col("data").alias("kept"))
    return cut.unionByName(whole)


def repeat_digest(removed: DataFrame) -> DataFrame:
    return removed.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
