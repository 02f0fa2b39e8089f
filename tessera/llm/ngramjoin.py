"""N-gram Jaccard join over a token-group matrix.

Two documents link when the Jaccard similarity of their sets of word
shingles reaches a threshold.  Documents with one and the same set are one
set from the start.  The prefixes of two similar sets, their rarest
shingles and EXTRA per cent more, share that many shingles, so only sets
that share so many with others go on.

Those are parted into blocks of bounded size, first by their least shingle
hash, then by their most shared prefix shingle, and inside a block all
links are found at once; hubs that visit all blocks of one key tie them
together.  The second blocks, parted by component where one is large
there, are the groups.  The token-group matrix tells how much of a set's
prefix each other group holds; a group is opened only if that, and then
the share of the set in the union of the group's shingles, is enough.
Sets that are linked already are not compared again, but no link between
components is missed.

Edge cases: null or empty texts, and texts without words, have no shingles
and are linked with nothing; a null doc_id takes part, but names no
component unless all its members are null; repeated rows link as copies;
an empty table gives no rows; extra columns are ignored.  Shingles and
sets are known by 64-bit hashes: among n of them two differing ones meet
with probability n * n / 2**65.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import passing, release_memory, stored
from tessera.llm.components import components
from tessera.llm.shingles import Shingler, set_id

WORDS = 5
PERCENT = 75
GROUP = 256       # sets in a block, and queries sent to a group at a time
RUN_TOKENS = 1 << 19     # shingles that a task holds before it hands them on
BITMAP_WORDS = 1 << 20   # 8 MB of bits
LARGE = 8         # sets of one component that are a group of their own in a block
COMMON = 65_536   # frequent shingles that go last in the order; the order never changes a result
EXTRA = 10        # per cent of a set's shingles that a prefix is longer than it must be


# --- inside tasks ------------------------------------------------------------------------------

def intersections(sets):
    """Sizes of the intersections of all pairs of a few sets."""
    import numpy as np

    n = len(sets)
    out = np.zeros((n, n), np.int64)
    if not n:
        return out
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else []
    held = np.diff(np.append(start, len(every)))
    for d in range(2, 9):  # tokens of few sets: pair by pair
        rows = owner[start[held == d][:, None] + np.arange(d)] if (held == d).any() else None
        if rows is not None:
            i, j = np.triu_indices(d, 1)
            pairs = (rows[:, i] * n + rows[:, j]).ravel()
            out += np.bincount(pairs, minlength=n * n).reshape(n, n)
    many = np.flatnonzero(held > 8)
    out = out + out.T
    for a in range(0, len(many), 4096):  # the others by products of presence matrices
        part = many[a:a + 4096]
        m = np.zeros((n, len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), held[part])
        m[owner[np.concatenate([np.arange(start[t], start[t] + held[t]) for t in part])], column] = 1
        out += (m @ m.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def linked(sets, percent: int):
    """Which pairs reach the threshold."""
    import numpy as np

    common = intersections(sets)
    size = np.array([len(s) for s in sets], np.int64)
    return 100 * common >= percent * (size[:, None] + size[None, :] - common)


def local_roots(ids, links, first):
    """For each set the first member of its component: the hubs in ``first``, then the least id."""
    import numpy as np

    root = -np.ones(len(ids), int)
    for i in sorted(range(len(ids)), key=lambda i: (first.get(ids[i], len(first)), ids[i])):
        if root[i] >= 0:
            continue
        ahead = [i]
        root[i] = i
        while ahead:
            new = np.flatnonzero(links[ahead].any(axis=0) & (root < 0))
            root[new] = i
            ahead = new.tolist()
    return [ids[r] for r in root]


def read_sets(column):
    """A list column of longs as arrays."""
    import numpy as np

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    return [flat[a:b] for a, b in zip(ends[:-1].astype(int), ends[1:].astype(int))]


# --- passes over the texts --------------------------------------------------------------------

def with_text_hash(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))


def frequent(sets, names):
    """Rows of the shingles that many of some sets hold."""
    import numpy as np

    token, c = np.unique(np.concatenate(sets), return_counts=True)
    often = c >= max(4, len(sets) // 500)
    none = pa.nulls(int(often.sum()), pa.int64())
    return pa.RecordBatch.from_arrays([none] * 5 + [pa.array(token[often]), pa.array(c[often])], names=names)


def describe(docs: DataFrame, words: int) -> DataFrame:
    """A row for each document (its set's id, size and least hash), and counts of frequent shingles."""

    def run(batches):
        shingler = Shingler(words)
        names = ["doc_id", "th", "sid", "n", "least", "token", "c"]
        for b in batches:
            ids, sizes, least, seen, kept, held = [], [], [], set(), [], 0
            for s in shingler.sets(b.column("text").to_pylist()):
                sid = set_id(s) if len(s) else None
                ids.append(sid)
                sizes.append(len(s))
                least.append(int(s[0]) if len(s) else None)
                if len(s) and sid not in seen:
                    seen.add(sid)
                    kept.append(s)
                    held += len(s)
                if held >= RUN_TOKENS:
                    yield frequent(kept, names)
                    kept, held = [], 0
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(least, pa.int64()), none, none], names=names)
            if kept:
                yield frequent(kept, names)
            kept = None
            release_memory()

    return docs.mapInArrow(run, "doc_id long, th long, sid long, n long, least long, token long, c long")


def needed(n, percent: int = EXTRA):
    """How many prefix shingles a set of size n must share (a number or a column)."""
    return -(-percent * n // 100) if isinstance(n, int) else F.ceil(n * percent / 100)


def prefix_rows(found):
    import numpy as np

    n = [len(t) for t, _, _ in found]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([t for t, _, _ in found])),
         pa.array(np.repeat(np.array([x for _, x, _ in found], np.int64), n)),
         pa.array(np.repeat(np.array([x for _, _, x in found], bool), n))], names=["token", "sid", "frequent"])


def prefixes(docs: DataFrame, words: int, percent: int, common) -> DataFrame:
    """(token, sid, frequent) of every set's prefix: its rarest shingles, ties by hash."""
    import numpy as np

    token = np.array(sorted(common), np.int64)
    place = np.array([common[t] for t in token.tolist()], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((token, place))  # at most COMMON entries

    def run(batches):
        shingler, (token, place) = Shingler(words), shared.value
        for b in batches:
            seen, out, held = set(), [], 0
            for s in shingler.sets(b.column("text").to_pylist()):
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                size = len(s) - -(-percent * len(s) // 100) + needed(len(s))
                at = np.minimum(np.searchsorted(token, s), max(0, len(token) - 1))
                often = token[at] == s if len(token) else np.zeros(len(s), bool)
                light = s[~often][:size]
                heavy = s[often]
                heavy = heavy[np.argsort(place[at[often]], kind="stable")][:size - len(light)] \
                    if len(light) < size else heavy[:0]
                out += [(light.copy(), sid, False), (heavy, sid, True)]
                held += size
                if held >= RUN_TOKENS:
                    yield prefix_rows(out)
                    out, held = [], 0
            if out:
                yield prefix_rows(out)
            out = None
            release_memory()

    return docs.select("text").mapInArrow(run, "token long, sid long, frequent boolean")


def shared_tokens(rows: DataFrame) -> DataFrame:
    """(token, sid) of the prefix shingles that more than one set may hold.

    Frequent shingles are left as they are (a later step drops those of
    one component), so no key of the window is large.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("token")
    light = (rows.filter("not frequent").withColumn("lo", F.min("sid").over(w))
             .withColumn("hi", F.max("sid").over(w)).filter("lo <> hi"))
    return light.select("token", "sid").unionByName(rows.filter("frequent").select("token", "sid")).distinct()


def bitmap(keys: DataFrame, col: str):
    """A bitmap of fixed size in which the bit of every (hashed) key is set, for all executors."""
    import numpy as np

    word = F.pmod(F.shiftright(col, 6), F.lit(BITMAP_WORDS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(col).bitwiseAND(F.lit(63)).cast("int"))
    words = np.zeros(BITMAP_WORDS, np.int64)
    for r in keys.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("bits")).collect():
        words[r["w"]] = r["bits"]
    return keys.sparkSession.sparkContext.broadcast(words)


def may_hold(words):
    """Whether a key's bit is set: true for every key of the bitmap, seldom for others."""

    @F.arrow_udf("boolean")
    def check(keys: pa.Array) -> pa.Array:
        import numpy as np

        k = keys.to_numpy(zero_copy_only=False).astype(np.int64)
        return pa.array((words.value[(k >> 6) % BITMAP_WORDS] >> (k & 63)) & 1 == 1)

    return check


def load_sets(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """sid and shingles of the sets of which ``chosen`` names a document.

    A bitmap of the chosen texts keeps most other texts out of the shuffle
    (all pass once it is full; the join decides).  A task gives each set once.
    """

    def run(batches):
        shingler, seen = Shingler(words), set()
        for b in batches:
            keep = []
            for i, sid in enumerate(b.column("sid").to_pylist()):
                if sid not in seen:
                    seen.add(sid)
                    keep.append(i)
            for a in range(0, len(keep), 500):
                part = b.take(pa.array(keep[a:a + 500], pa.int64()))
                sets = list(shingler.sets(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("sid"), pa.array(sets, pa.list_(pa.int64()))], names=["sid", "tokens"])

    docs = docs.filter(may_hold(bitmap(chosen, "th"))("th"))
    same = (docs["th"] == chosen["th"]) & docs["doc_id"].eqNullSafe(chosen["doc_id"])
    return (docs.join(chosen, same).select(chosen["sid"], docs["text"])
            .mapInArrow(run, "sid long, tokens array<long>"))


# --- blocks and groups -----------------------------------------------------------------------------------

def assign_blocks(keys: DataFrame, size: int) -> DataFrame:
    """sid, block, hub rank and home: blocks of the sets of one key; its two hubs visit each block."""
    hashes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("sid").alias("h0"),
                                     F.max("sid").alias("h1"))
    parts = F.ceil(F.col("k") / size).cast("int")
    hub = F.when(F.col("sid") == F.col("h0"), 0).when(F.col("sid") == F.col("h1"), 1)
    rows = keys.join(hashes, "key").select("sid", "key", "k", hub.alias("hub"), parts.alias("parts"),
                                           F.pmod(F.xxhash64("sid"), parts).cast("int").alias("home"))
    where = F.when(F.col("hub").isNotNull(), F.sequence(F.lit(0), F.col("parts") - 1)) \
        .otherwise(F.array("home"))
    return rows.withColumn("part", F.explode(where)).select(
        "sid", F.xxhash64("key", "part").alias("block"), "hub", (F.col("part") == F.col("home")).alias("home"),
        (F.col("k") > 1).alias("more"))


def link_inside(members: DataFrame, percent: int) -> DataFrame:
    """Every member of a block (a) with the root of its component there (b)."""

    def run(key, table):
        tokens = dict(zip(table.column("sid").to_pylist(), read_sets(table.column("tokens"))))
        rank = dict(zip(table.column("sid").to_pylist(), table.column("hub").to_pylist()))
        ids = sorted(tokens)
        hubs = {i: rank[i] for i in ids if rank[i] is not None}
        roots = local_roots(ids, linked([tokens[i] for i in ids], percent), hubs)
        release_memory()
        return pa.table({"a": pa.array(ids, pa.int64()), "b": pa.array(roots, pa.int64())})

    return members.groupBy("block").applyInArrow(run, "a long, b long")


def named_groups(labels: DataFrame) -> DataFrame:
    """gid and rank of every label: a block's large components are groups of their own, the others one."""
    size = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    here = labels.groupBy("block", "comp").agg(F.count(F.lit(1)).alias("here"))
    large = F.col("here") >= LARGE
    return labels.join(here, ["block", "comp"]).join(size, "comp").select(
        "sid", "n", "comp", F.xxhash64("block", F.when(large, F.col("comp"))).alias("gid"),
        F.when(large, F.col("size")).otherwise(0).alias("rank"))


def candidates(tokens: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(sid, gid): sets and the groups of higher rank that hold enough of their prefixes.

    Of two groups the one of lower rank (ties: of the lesser gid) asks the
    other; groups of none but the set's own component are left out.
    """
    rows = tokens.join(groups, "sid")
    spread = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    rows = rows.join(spread.select("token"), "token")
    asked = rows.groupBy("token", F.col("gid").alias("other"), F.col("rank").alias("higher")).agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"),
        F.min("n").alias("least"), F.max("n").alias("most"))
    up = (F.col("rank") < F.col("higher")) | ((F.col("rank") == F.col("higher")) & (F.col("gid") < F.col("other")))
    foreign = (F.col("lo") != F.col("comp")) | (F.col("hi") != F.col("comp"))
    alike = ((100 * F.col("n") >= percent * F.col("least")) & (100 * F.col("most") >= percent * F.col("n")))
    held = (rows.join(asked, "token").filter(up & foreign & alike).groupBy("sid", "n", "other")
            .agg(F.count(F.lit(1)).alias("c"), F.min("least").alias("least")))
    smallest = F.greatest("least", F.ceil(F.col("n") * percent / 100))  # of the members that may be similar
    return held.filter(F.col("c") >= needed(F.least(F.col("n"), smallest))).select("sid", F.col("other").alias("gid"))


def open_groups(asked: DataFrame, groups: DataFrame, sets: DataFrame, percent: int, size: int) -> DataFrame:
    """Edges between components: a query's and those of similar members of an opened group.

    ``asked`` has (sid, gid); many queries of one group go to it in parts.
    """
    count = asked.groupBy("gid").agg(F.count(F.lit(1)).alias("k"))
    parts = F.ceil(F.col("k") / size)
    queries = asked.join(count, "gid").select(
        "sid", "gid", F.pmod(F.xxhash64("sid"), parts).alias("part"), F.lit(True).alias("query"))
    members = groups.join(count, "gid").select(
        "sid", "gid", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"),
        F.lit(False).alias("query"))
    rows = queries.unionByName(members).join(groups.select("sid", "comp"), "sid").join(sets, "sid")

    def run(key, table):
        import numpy as np
        tokens = read_sets(table.column("tokens"))
        asks, comp = table.column("query").to_pylist(), table.column("comp").to_pylist()
        inside = [i for i, q in enumerate(asks) if not q]
        union = np.unique(np.concatenate([tokens[i] for i in inside] or [np.zeros(0, np.int64)]))
        # at least this share of a set must lie in the group's union
        queries = [i for i, q in enumerate(asks) if q and 100 * np.isin(
            tokens[i], union, assume_unique=True).sum() >= percent * len(tokens[i])]
        found = set()
        if queries and inside:
            links = linked([tokens[i] for i in queries + inside], percent)[:len(queries), len(queries):]
            found = {(comp[queries[q]], comp[inside[m]]) for q, m in np.argwhere(links)}
        release_memory()
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()),
                         "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("gid", "part").applyInArrow(run, "a long, b long").filter("a <> b").distinct()


def renamed(labels: DataFrame, edges: DataFrame, keep) -> DataFrame:
    """Labels after the components at the ends of ``edges`` have become one."""
    new = components(edges, keep).withColumnRenamed("node", "comp")
    return labels.join(new, "comp", "left").withColumn("comp", F.coalesce("component", "comp")) \
        .select(*labels.columns)


def sharing(rows: DataFrame, tokens: DataFrame, percent: int, keep):
    """One document for each set that shares enough of its prefix with others, and these sets' tokens."""
    one = rows.filter("sid is not null").groupBy("sid", "least", "n").agg(F.min(F.struct("th", "doc_id")).alias("d"))
    shares = tokens.groupBy("sid").agg(F.count(F.lit(1)).alias("c"))
    found = keep(one.join(shares, "sid").filter(F.col("c") >= needed(F.ceil(F.col("n") * percent / 100)))
                 .select("sid", "least", "n", "d.th", "d.doc_id"), "found")
    return found, keep(tokens.join(found.select("sid"), "sid"), "tokens")


def described(docs: DataFrame, words: int, percent: int, group: int, keep) -> DataFrame:
    """doc_id, text hash, set id, set size and component's name of every document."""
    docs = with_text_hash(docs)
    seen = keep(describe(docs, words), "sets")
    rows = seen.filter("token is null")
    common = {r["token"]: i for i, r in enumerate(
        seen.filter("token is not null").groupBy("token").agg(F.sum("c").alias("c"))
        .orderBy(F.desc("c"), "token").limit(COMMON).orderBy("c", "token").select("token").collect())}
    with passing(docs.sparkSession) as briefly:
        found, tokens = sharing(rows, briefly(
            shared_tokens(prefixes(docs, words, percent, common)), "tokens"), percent, keep)
    sets = keep(load_sets(docs, found, words), "shingles")
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    top = (tokens.join(held, "token").groupBy("sid").agg(F.max(F.struct("df", "token")).alias("m"))
           .select("sid", F.col("m.token").alias("top")))
    links = None
    for keys in (found.select("sid", F.col("least").alias("key")), top.select("sid", F.col("top").alias("key"))):
        blocks = keep(assign_blocks(keys, group), "blocks")
        inside = keep(link_inside(blocks.filter("more").join(sets, "sid"), percent), "inside")
        own = inside.filter("a <> b")
        links = own if links is None else links.unionByName(own)
    labels = blocks.filter("home").select("sid", "block").join(found.select("sid", "n"), "sid") \
        .withColumn("comp", F.col("sid"))
    labels = keep(renamed(labels, links, keep), "labels")
    groups = keep(named_groups(labels), "groups")
    asked = keep(candidates(tokens, groups, percent), "asked")
    labels = keep(renamed(labels, keep(open_groups(asked, groups, sets, percent, group), "links"),
                          keep), "labels")
    return rows.select("doc_id", "th", "sid", "n").join(labels.select("sid", "comp"), "sid", "left") \
        .select("doc_id", "th", "n", F.coalesce("comp", "sid").alias("comp"))


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT,
                      group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every document."""
    with passing(docs.sparkSession) as keep:
        rows = stored(described(docs, words, percent, group, keep), "components")
    names = rows.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "comp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, group: int = GROUP) -> DataFrame:
    """The documents, of each component only the one with the least doc_id.

    Documents without words all stay; rows that repeat an id and its text
    count once.
    """
    with passing(docs.sparkSession) as keep:
        rows = stored(described(docs, words, percent, group, keep), "components")
    first = rows.filter("comp is not null").groupBy("comp").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("d"))
    kept = first.select("d.doc_id", "d.th").unionByName(
        rows.filter("comp is null").select("doc_id", "th").distinct())
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("th").alias("_kept"))
    texts = docs.withColumn("_th", F.xxhash64("text"))
    return (texts.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_kept")))
            .dropDuplicates(["doc_id", "_th"]).select(*docs.columns))
