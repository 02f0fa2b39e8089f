"""Lexical retrieval packing: documents that share rare words fill one window.

Words are counted over all documents.  Documents are dealt into shards of
bounded size by their rarest word that another one holds as well; a seed
never sees documents of other shards.  Each shard builds a BM25 inverted
index of its documents with the counts over all; a window starts from a seed (what is left
of the document cut last, else the next unused one) and takes the seed's
best unused neighbours, those that fit whole first; the best of the rest is
cut where the window is full.  Only a shard's last window can be short.

Edge cases: a null or empty text is the end id alone; repeated rows are
packed each; a text longer than a window fills several; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import copy
import zlib

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import release_memory
from tessera.llm.tokens import END_ID, Cut, encoder, tokenizer_file

WINDOW = 1024
SHARD_BYTES = 8 << 20
CHUNK_BYTES = 16 << 20  # texts whose words are counted together
CHUNKS_A_RANGE = 4      # chunks whose words make up a range of terms to sum, about
STALE = 0.85            # an index is narrowed when fewer than this share of its documents are unused
K1, LENGTH_SHARE = 1.2, 0.75
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]{2,}")

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def terms_of(text: str) -> list[str]:
    """Words between white space; runs of scripts written without spaces also as character pairs."""
    out = text.split()
    if not text.isascii():
        for run in UNSPACED.findall(text):
            out += [run[i:i + 2] for i in range(len(run) - 1)]
    return out


def hashes(terms):
    """64-bit hashes of a list of terms (text or UTF-8), the same in every worker."""
    import numpy as np
    from pandas.util import hash_array

    out = np.empty(len(terms), object)
    out[:] = terms
    return hash_array(out, categorize=False).view(np.int64)


class TermNumbers(dict):
    """term -> its hash; ``of`` hashes the new terms of a text at once."""

    def of(self, text: str):
        import numpy as np

        words = terms_of(text)
        if new := [w for w in dict.fromkeys(words) if w not in self]:
            self.update(zip(new, hashes(new).tolist()))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class TermCounts:
    """How often each of ``n`` texts holds each term.

    ``vocabulary`` has the terms' hashes in ascending order; ``owner`` (text), ``at`` (place in the
    vocabulary) and ``tf`` have one entry for each term of each text, ordered by text, then term;
    ``sizes`` the number of terms of each text, repeated ones included.
    """

    def __init__(self, n, owner, rank, vocabulary, sizes):
        """One entry of ``owner`` (text) and ``rank`` (place in the vocabulary) for each term of each text."""
        import numpy as np

        self.n, self.vocabulary, self.sizes = n, vocabulary, sizes
        width = max(1, len(vocabulary))
        key = owner.astype(np.int64)
        key *= width
        key += rank
        key.sort()
        new = np.flatnonzero(np.diff(key, prepend=-1))
        self.tf = np.diff(new, append=len(key))
        self.owner, self.at = np.divmod(key[new], width)

    @classmethod
    def of_terms(cls, docs):
        """Counts of arrays of terms."""
        import numpy as np

        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        vocabulary, rank = np.unique(np.concatenate([*docs, np.zeros(0, np.int64)]), return_inverse=True)
        return cls(len(docs), np.repeat(np.arange(len(docs)), sizes), rank, vocabulary, sizes)

    @classmethod
    def of(cls, texts):
        """Counts of texts (a ``Cut`` of them, a list or an Arrow array; null: empty)."""
        from itertools import chain, compress

        import numpy as np

        cut = texts if isinstance(texts, Cut) else Cut(texts)
        # a word is one term, an empty one none; odd ones (all white space beyond the space and all unspaced
        # scripts have such bytes) are cut further
        one, odd = (cut.sizes > 0) & ~cut.odd, np.flatnonzero(cut.odd)
        more = [terms_of(cut.words[i].decode()) for i in odd.tolist()]
        terms = hashes([*compress(cut.words, one.tolist()), *(t.encode() for t in chain.from_iterable(more))])
        vocabulary, rank = np.unique(terms, return_inverse=True)
        n = int(one.sum())
        single = np.full(len(one), -1, np.int32)
        single[one] = rank[:n]
        many, first = np.zeros((2, len(one)), np.int64)
        many[odd] = np.fromiter(map(len, more), np.int64, len(more))
        first[odd] = n + np.cumsum(many[odd]) - many[odd]
        owner = np.repeat(np.arange(len(cut.many), dtype=np.int32), cut.many)
        found = single.take(cut.numbers)
        at = np.flatnonzero(many.take(cut.numbers))  # the odd words' places
        k = many[cut.numbers[at]]
        which = np.repeat(first[cut.numbers[at]] - np.cumsum(k) + k, k) + np.arange(k.sum())
        kept = found >= 0
        owner = np.concatenate([owner[kept], np.repeat(owner[at], k)])
        found = np.concatenate([found[kept], rank[which].astype(np.int32)])
        return cls(len(cut.many), owner, found, vocabulary, np.bincount(owner, minlength=len(cut.many)))


class Bm25:
    """Inverted index over one shard: postings of the words that two of its documents at least hold.

    ``docs`` are ``TermCounts`` or arrays of terms.  ``df`` (for each document: counts of its words in
    ascending order of the words, or all of them in one array), ``total`` and ``mean`` are those of all
    documents; without them, of the shard.
    """

    def __init__(self, docs, df=None, total=None, mean=None):
        import numpy as np

        if not isinstance(docs, TermCounts):
            docs = TermCounts.of_terms(docs)
        n, at, owner = docs.n, docs.at, docs.owner
        here = np.bincount(at, minlength=len(docs.vocabulary))
        size = docs.sizes.astype(np.float64)
        mean = mean or (size.mean() if n else 1.0)
        norm = K1 * (1 - LENGTH_SHARE + LENGTH_SHARE * size / max(1.0, mean))
        if df is None:
            df = here[at]
        elif isinstance(df, list):
            df = np.concatenate([*df, np.zeros(0, np.int64)])
        shared = here[at] > 1
        at, owner, tf, df = at[shared], owner[shared], docs.tf[shared], df[shared]
        idf = np.log1p(((total or n) - df + 0.5) / (df + 0.5))
        weight = idf * tf * (K1 + 1) / (tf + norm[owner])
        order = np.argsort(at, kind="stable")
        self.n, self.docs, self.weights, self.terms = n, owner[order], weight[order], at[order]
        here[here == 1] = 0
        self.here, self.starts = here, np.cumsum(here) - here
        self.asks = np.split(at, np.cumsum(np.bincount(owner, minlength=n))[:-1]) if n else []
    def narrowed(self, wanted):
        """An index that finds the wanted documents only, numbered anew in the same order; ``asks`` stay."""
        import numpy as np

        out, held = copy.copy(self), wanted[self.docs]
        out.n = int(wanted.sum())
        out.docs, out.weights, out.terms = (np.cumsum(wanted) - 1)[self.docs[held]], self.weights[held], self.terms[held]
        out.here = np.bincount(out.terms, minlength=len(self.here))
        out.starts = np.cumsum(out.here) - out.here
        return out

    def scores(self, doc: int):
        """Score of every document as a neighbour of ``doc``: its words' weights, summed in order of the words."""
        import numpy as np

        asks = self.asks[doc]
        k = self.here[asks]
        ends = np.cumsum(k)
        at = np.repeat(self.starts[asks] - ends + k, k)
        at += np.arange(len(at))
        return np.bincount(self.docs.take(at), self.weights.take(at), self.n)

    def neighbours(self, doc: int, unused):
        """Unused documents that share a word with ``doc``, best first (ties: in order)."""
        import numpy as np

        score = self.scores(doc)
        hits = np.flatnonzero((score > 0) & unused)
        return hits[np.argsort(-score[hits], kind="stable")].tolist()


def fill_windows(lengths, index: Bm25, window: int):
    """(document, start, length, window number, offset) of every piece."""
    import numpy as np

    sizes, unused = np.array(lengths, np.int64), np.ones(len(lengths), bool)
    live = np.arange(len(lengths))  # documents of the index
    ahead, out, number = 0, [], 0
    left = None  # (document, start) of what is left of the document cut last
    while True:
        while ahead < len(lengths) and not unused[ahead]:
            ahead += 1
        if left is None:
            if ahead == len(lengths):
                return out
            left, unused[ahead] = (ahead, 0), False
        seed, start = left
        n = min(window, lengths[seed] - start)
        out.append((seed, start, n, number, 0))
        offset, left = n, (seed, start + n) if start + n < lengths[seed] else None
        if offset < window:
            open_ = unused[live]
            if open_.sum() < STALE * len(live):
                index, live = index.narrowed(open_), live[open_]
                open_ = unused[live]
            score, size = index.scores(seed) * open_, sizes[live]
            while offset < window:  # whole neighbours first
                fits = np.where(size <= window - offset, score, 0.0)
                best = int(fits.argmax()) if len(live) else -1
                if best < 0 or not fits[best]:
                    break
                doc = int(live[best])
                out.append((doc, 0, lengths[doc], number, offset))
                score[best], unused[doc] = 0.0, False
                offset += lengths[doc]
            best = int(score.argmax()) if score.any() else -1
            while offset < window:
                if best >= 0:  # the best that does not fit is cut, and fills the window
                    doc = int(live[best])
                else:
                    while ahead < len(lengths) and not unused[ahead]:
                        ahead += 1
                    if ahead == len(lengths):
                        break
                    doc = ahead
                unused[doc] = False
                n = min(window - offset, lengths[doc])
                out.append((doc, 0, n, number, offset))
                offset += n
                if n < lengths[doc]:
                    left = (doc, n)
        number += 1


def packed(text: bytes, df) -> bytes:
    """A text and its words' counts as one compressed value; ``unpacked`` gives them back."""
    import pyarrow as pa

    planes = df.astype("<i8").view("u1").reshape(-1, 8).T.tobytes()  # bytes of one place together: most are zero
    return pa.Codec("zstd", 1).compress(text + planes, asbytes=True)


def unpacked(body: bytes, text_bytes: int, terms: int):
    import numpy as np
    import pyarrow as pa

    raw = pa.Codec("zstd").decompress(body, text_bytes + 8 * terms, asbytes=True)
    planes = np.frombuffer(raw, np.uint8, offset=text_bytes).reshape(8, terms)
    return raw[:text_bytes].decode(), np.ascontiguousarray(planes.T).view("<i8").ravel()


def placed(docs: DataFrame, rows: int, chunks: int, group_bytes: float, row_bytes: float,
           compressed: bool = False) -> DataFrame:
    """Each row with the counts of its words over all documents, their mean length and its place.

    The place is the rarest word that another document holds as well, cut into ``parts`` where the
    documents of that word would be more than ``group_bytes``; no place where no word is shared.
    Words are counted for each chunk of documents first.  A chunk's words are sent in ranges of their
    hashes, in ascending order, and only their counts come back.  ``compressed`` gives ``body``,
    ``text_bytes`` and ``terms`` (see ``unpacked``) in place of ``text`` and ``df``.
    """
    ranges = max(1, chunks // CHUNKS_A_RANGE)
    apart = F.xxhash64("doc_id", "text")
    chunked = (docs.select("doc_id", "text", apart.alias("apart"))
               .withColumn("chunk", F.pmod("apart", F.lit(chunks))).groupBy("chunk"))

    def count(key, table):
        import numpy as np
        import pyarrow as pa

        counts = TermCounts.of(table.column("text"))
        edges = [-(1 << 63) + (i << 64) // ranges for i in range(ranges)]
        ends = np.append(np.searchsorted(counts.vocabulary, np.array(edges, np.int64)), len(counts.vocabulary))
        ends = pa.array(ends, pa.int32())
        n = np.bincount(counts.at, minlength=len(counts.vocabulary))
        out = pa.table({
            "chunk": pa.array(np.full(ranges, key[0].as_py())), "range": pa.array(np.arange(ranges)),
            "term": pa.ListArray.from_arrays(ends, pa.array(counts.vocabulary, pa.int64())),
            "n": pa.ListArray.from_arrays(ends, pa.array(n, pa.int32())),
            "words": pa.array(np.full(ranges, counts.sizes.sum()))})
        del counts, n
        release_memory()
        return out

    def add(key, table):
        import numpy as np
        import pyarrow as pa

        term, n = (table.column(c).combine_chunks() for c in ("term", "n"))
        _, at = np.unique(term.flatten().to_numpy(), return_inverse=True)
        df = np.bincount(at, n.flatten().to_numpy()).astype(np.int64)[at]
        ends = np.append(0, np.cumsum(term.value_lengths().to_numpy()))
        words = sum(table.column("words").to_pylist())
        out = pa.table({
            "chunk": table.column("chunk"), "range": table.column("range"),
            "df": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(df, pa.int64())),
            "words": pa.array(np.full(len(ends) - 1, words))})
        del term, n, at, df
        release_memory()
        return out

    counts = (chunked.applyInArrow(count, "chunk long, range long, term array<long>, n array<int>, words long")
              .groupBy("range").applyInArrow(add, "chunk long, range long, df array<long>, words long"))

    def place(key, table, known):
        import numpy as np
        import pyarrow as pa

        known = known.sort_by("range")
        words = known.column("words")[0].as_py()
        mean = words / rows if words > 1 else 0.0
        text = table.column("text")
        own = TermCounts.of(text)
        df = known.column("df").combine_chunks().flatten().to_numpy()[own.at]
        # the rarest shared word of a document, of equally rare ones that of the least hash
        width, none = max(1, len(own.vocabulary)), (1 << 63) - 1
        first = np.flatnonzero(np.diff(own.owner, prepend=-1))
        best = np.full(len(table), none)
        if len(first):
            best[own.owner[first]] = np.minimum.reduceat(np.where(df > 1, df * width + own.at, none), first)
        alone = best == none
        best[alone] = 0
        places = own.vocabulary[best % width] if len(own.vocabulary) else best
        parts = np.maximum(1, -np.floor_divide(-(best // width) * row_bytes, group_bytes)).astype(np.int64)
        ends = np.append(0, np.cumsum(np.bincount(own.owner, minlength=len(table))))
        out = {"doc_id": table.column("doc_id"), "apart": table.column("apart"),
               "place": pa.array(places, pa.int64(), mask=alone), "parts": pa.array(np.where(alone, 1, parts)),
               "mean": pa.array(np.full(len(table), mean))}
        if compressed:
            raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in text]
            out |= {"body": pa.array([packed(t, df[a:b]) for t, a, b in zip(raw, ends, ends[1:])], pa.binary()),
                    "text_bytes": pa.array(list(map(len, raw)), pa.int64()), "terms": pa.array(np.diff(ends))}
        else:
            out |= {"text": text, "df": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(df, pa.int64()))}
        del known, own, df
        release_memory()
        return pa.table(out)

    held = "body binary, text_bytes long, terms long" if compressed else "text string, df array<long>"
    return chunked.cogroup(counts.groupBy("chunk")).applyInArrow(
        place, f"doc_id long, apart long, place long, parts long, mean double, {held}")


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None,
         shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Pieces of all documents; ``sequence_id`` is the shard's number, then the window's."""
    path = vocabulary or tokenizer_file()
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    total = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    # an id takes at least its end token: rows count too
    size, rows = (total[0] or 0) + 64 * total[1], total[1]
    shards = max(1, -(-size // shard_bytes))

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        shard = key[0].as_py()
        mean = table.column("mean")[0].as_py()
        rest = [unpacked(*r) for r in zip(*(table.column(c).to_pylist() for c in ("body", "text_bytes", "terms")))]
        order = sorted(((i, t, df) for i, (t, df) in zip(table.column("doc_id").to_pylist(), rest)),
                       key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        texts = [t for _, t, _ in order]
        cut = Cut(texts)
        index = Bm25(TermCounts.of(cut), [df for _, _, df in order], rows, mean)
        coded = encoder(path).encode_all(texts, cut)
        end = np.array([END_ID], np.uint32)
        ids = [np.concatenate([x, end]) for x, _ in coded]
        lengths = [len(x) for x in ids]
        pieces = fill_windows(lengths, index, window)
        doc = [p[0] for p in pieces]
        crc = [zlib.crc32(ids[d][a:a + n].astype("<u4").tobytes()) for d, a, n, _, _ in pieces]
        cols = [[order[d][0] for d in doc], [p[1] for p in pieces], [p[2] for p in pieces], crc,
                [lengths[d] for d in doc], [(shard << 32) + p[3] for p in pieces],
                [p[4] for p in pieces]]
        out = pa.table([pa.array(c, pa.int64()) for c in cols],
                       names=["doc_id", "start", "length", "ids_crc32", "doc_tokens",
                              "sequence_id", "offset"])
        del order, rest, texts, cut, coded, ids, pieces, doc, cols, index
        release_memory()
        return out

    chunks = max(1, -(-size // CHUNK_BYTES))
    docs = placed(docs, rows, chunks, shard_bytes / 4, size / max(1, rows), compressed=True)
    near = F.when(F.col("place").isNull(), F.col("apart")).otherwise(F.xxhash64("place", F.pmod("apart", "parts")))
    shard = F.pmod(near, F.lit(shards))
    return (docs.select("doc_id", "body", "text_bytes", "terms", "mean", shard.alias("shard"))
            .groupBy("shard").applyInArrow(run, PIECES))
