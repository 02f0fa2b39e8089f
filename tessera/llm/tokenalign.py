"""Alignment of the tokens of two tokenizers over whole texts.

Both tokenizers read a text whole: A (byte-level BPE) the text after a
space, B (pieces with byte fallback) the text, to which it adds that space.
Neither joins a word with what stands before a single space, so words that
were read before are not tokenised again: a word leads to its window.
Byte offsets where a token of each ends are shared ends.  Those before a
token that starts with a space on both sides are anchors: they split the
text into windows, mostly words, and a window's alignment depends on its
token ids alone, so it is worked out once for each tuple of ids and then
looked up.  Inside a window the shared ends cut the tokens into groups, and
the two tokens that end at a shared end are linked.

Of two linked tokens the shorter one's bytes end the longer one, so there
are at most ``most_pairs`` different links, whatever the corpus: their
counts are broadcast.

Edge cases: texts that are null or empty, or whose token bytes, joined,
differ from the space and the text on either side (U+2581 in a text), have
no tokens; long texts are tokenised in segments that start at single spaces,
where neither tokenizer joins; repeated rows count each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release_memory, stored

SEGMENT = 1 << 17      # characters of a text tokenised together
MEMO = 400_000         # windows and words that a worker keeps
HELD = 1 << 21         # links that a task holds before it hands them on
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
CROWDED = re.compile(r"^ | $|  |\s \s")  # spaces that either tokenizer may join with a neighbour
FORMS = 1 << 16        # ids have 16 bits
SHIFT = 15             # bits of an id of B in a link's code


def byte_level() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


def vocabulary_a(path: str) -> list[bytes]:
    """Bytes of each id of A."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    to_byte = byte_level()
    out = [b""] * (max(model["model"]["vocab"].values()) + 1)
    for token, i in model["model"]["vocab"].items():
        out[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
    return out


def vocabulary_b(model) -> list[bytes]:
    """Bytes of each id of B."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece) if model.is_byte(i) else None
        out.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
    return out


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of tokens there are of which one ends the other: no corpus has more different links."""
    from collections import Counter

    def ends(some, others, first):
        held = Counter(others)
        return sum(held[t[k:]] for t in some for k in range(first, len(t)))

    return ends(a, b, 0) + ends(b, a, 1)


class Pair:
    """The two tokenizers and what is known of windows."""

    def __init__(self, path_a: str, path_b: str):
        import numpy as np
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.bytes_a = vocabulary_a(path_a)
        ranks = {t: i for i, t in enumerate(self.bytes_a) if t and t != b"<|endoftext|>"}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = vocabulary_b(self.b)
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.forms = [f"{i}{mark}" for mark in ",|,;" for i in range(FORMS)]  # inside and at the end of a group
        self.space_a, self.space_b = (np.array([t[:1] == b" " for t in x]) for x in (self.bytes_a, self.bytes_b))
        self.clear()

    def clear(self):
        """Forget the windows."""
        self.number, self.text, self.links, self.sizes = {}, [], [], []
        self.words = {}  # word after a single space -> its window, -1 where the bytes differ

    def tokens(self, text: str):
        """Ids of both sides, or None where their bytes are not the text's."""
        import numpy as np

        own = b" " + text.encode("utf-8", "replace")
        a = self.a.encode_to_numpy(" " + text, disallowed_special=())
        b = self.b.encode(text)
        if (b"".join(map(self.bytes_a.__getitem__, a.tolist())) != own
                or b"".join(map(self.bytes_b.__getitem__, b)) != own):
            return None
        return np.asarray(a, np.uint16), np.array(b, np.uint16)

    def windows(self, a, b) -> list[int]:
        """Numbers of the windows between the anchors of two token sequences over the same bytes."""
        import numpy as np

        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.zeros(int(end_a[-1]) + 1, bool)
        ends[end_b] = True
        last_a = np.flatnonzero(ends[end_a])           # tokens of A that end with one of B
        last_b = np.searchsorted(end_b, end_a[last_a])
        inner = slice(0, len(last_a) - 1)              # the last shared end is that of the text
        anchor = np.flatnonzero(self.space_a[a[last_a[inner] + 1]] & self.space_b[b[last_b[inner] + 1]])
        cut_a = np.concatenate([[0], last_a[anchor] + 1, [len(a)]])
        cut_b = np.concatenate([[0], last_b[anchor] + 1, [len(b)]])
        raw_a, raw_b = a.tobytes(), b.tobytes()
        at_a, at_b = (2 * cut_a).tolist(), (2 * cut_b).tolist()
        keys = [(raw_a[i:j], raw_b[k:m]) for i, j, k, m in zip(at_a, at_a[1:], at_b, at_b[1:])]
        numbers = list(map(self.number.get, keys))
        new = {key: t for t, (key, n) in enumerate(zip(keys, numbers)) if n is None}
        if new:
            which = np.zeros(len(keys), bool)
            which[list(new.values())] = True
            edge = np.concatenate([[0], anchor + 1, [len(last_a)]])
            self.learn(keys, which, a, b, cut_a, cut_b, last_a, last_b, edge)
            numbers = list(map(self.number.__getitem__, keys))
        return numbers

    def learn(self, keys, which, a, b, cut_a, cut_b, last_a, last_b, edge) -> None:
        """Work out the groups (as text) and links of new windows, marked in ``which``, by their shared ends."""
        import numpy as np

        def part(tokens, last, cut):
            """The windows' tokens, whether each ends a group, and its group."""
            ends = np.zeros(len(tokens), bool)
            ends[last] = True
            inside = np.repeat(which, np.diff(cut))
            ends = ends[inside]
            return tokens[inside].astype(np.int64), ends, np.cumsum(ends) - ends

        own_a, ends_a, group_a = part(a, last_a, cut_a)
        own_b, ends_b, group_b = part(b, last_b, cut_b)
        before_b = np.concatenate([[0], np.flatnonzero(ends_b) + 1])   # tokens of B in the groups before
        after_a = np.flatnonzero(ends_a) + 1                           # tokens of A up to a group's end
        place = np.empty(len(own_a) + len(own_b), np.int64)            # a group's tokens of A, then those of B
        place[np.arange(len(own_a)) + before_b[group_a]] = own_a + ends_a * FORMS
        place[np.arange(len(own_b)) + after_a[group_b]] = own_b + (2 + ends_b) * FORMS
        spelled = list(map(self.forms.__getitem__, place.tolist()))
        links = ((a[last_a].astype(np.uint32) << SHIFT) | b[last_b]).tobytes()
        size = (np.diff(cut_a) + np.diff(cut_b))[which]
        stop = np.cumsum(size)
        some = np.flatnonzero(which).tolist()
        for t, x, y, i, j in zip(some, (stop - size).tolist(), stop.tolist(), (4 * edge[:-1][which]).tolist(),
                                 (4 * edge[1:][which]).tolist()):
            self.number[keys[t]] = len(self.text)
            self.text.append("".join(spelled[x:y])[:-1])
            self.links.append(links[i:j])
            self.sizes.append(len(keys[t][0]) << 31 | len(keys[t][1]) >> 1)

    def read(self, text: str):
        """Numbers of the windows of a text, or None where the bytes differ."""
        if CROWDED.search(text):
            found = self.tokens(text)
            return None if found is None else self.windows(*found)
        words = text.split(" ")
        numbers = list(map(self.words.get, words))
        if None in numbers:
            self.learn_words(list({w for w, n in zip(words, numbers) if n is None}))
            numbers = list(map(self.words.__getitem__, words))
        return None if -1 in numbers else numbers

    def learn_words(self, words: list[str]) -> None:
        """The windows of new words, which are tokenised together."""
        found = self.tokens(" ".join(words))
        numbers = [] if found is None else self.windows(*found)
        if len(numbers) == len(words):
            self.words.update(zip(words, numbers))
        elif len(words) == 1:
            self.words[words[0]] = -1
        else:
            for w in words:
                self.learn_words([w])

    def align(self, text: str | None):
        """(n_a, n_b, sha256 of the groups, codes of the links), or None for a text without tokens."""
        if not text:
            return None
        n, digest, codes, first = 0, hashlib.sha256(), [], True
        for part in segments(text):
            if len(self.text) + len(self.words) > MEMO:
                self.clear()
            numbers = self.read(part)
            if numbers is None:
                return None
            groups = ";".join(map(self.text.__getitem__, numbers))
            digest.update((groups if first else ";" + groups).encode())
            codes += map(self.links.__getitem__, numbers)
            n, first = n + sum(map(self.sizes.__getitem__, numbers)), False
        return n >> 32, n & (2 ** 32 - 1), digest.hexdigest(), b"".join(codes)


def segments(text: str):
    """The text cut at single spaces (left out: each segment is read after one) about every SEGMENT characters."""
    a = 0
    while len(text) - a > SEGMENT and (found := LONE_SPACE.search(text, a + SEGMENT)):
        yield text[a:found.start()]
        a = found.end()
    yield text[a:]


_pairs: dict = {}


def pair(path_a: str, path_b: str) -> Pair:
    """One pair for each worker process and files."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


def align_texts(path_a: str, path_b: str):
    """doc_id, text -> doc_id, n_a, n_b, groups_sha256, links (codes as 32-bit integers)."""

    def run(batches):
        own = pair(path_a, path_b)
        names = ["doc_id", "n_a", "n_b", "groups_sha256", "links"]

        def rows(ids, out):
            return pa.RecordBatch.from_arrays(
                [ids] + [pa.array([r[i] for r in out], t) for i, t in
                         enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary()))], names=names)

        for b in batches:
            texts, out, held, done = b.column("text"), [], 0, 0
            for i in range(b.num_rows):
                found = own.align(texts[i].as_py())
                if found is None:
                    out.append((0, 0, "", b""))
                else:
                    out.append(found)
                    held += len(found[3]) // 4
                if held >= HELD:
                    yield rows(b.column("doc_id").slice(done, len(out)), out)
                    done, out, held = i + 1, [], 0
            if out:
                yield rows(b.column("doc_id").slice(done, len(out)), out)
            out = None
            release_memory()

    return run


def count_links(batches):
    """code, n: the links of a task."""
    import numpy as np

    held, size = [], 0

    def summed():
        code, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], names=["code", "n"])

    for b in batches:
        for links in b.column("links"):
            held.append(np.frombuffer(links.as_py(), np.uint32))
            size += len(held[-1])
            if size >= HELD:
                yield summed()
                held, size = [], 0
    if held:
        yield summed()


def score_links(shared):
    """doc_id, ..., links -> n_links, n_best, count_sum."""

    def run(batches):
        import numpy as np

        code, n, best = shared.value
        for b in batches:
            links = [np.frombuffer(x.as_py(), np.uint32) for x in b.column("links")]
            sums = np.zeros((len(links), 3), np.int64)
            for i, x in enumerate(links):
                if len(x):
                    at = np.searchsorted(code, x)
                    sums[i] = len(x), best[at].sum(), n[at].sum()
            keep = [c for c in b.schema.names if c != "links"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(sums[:, i]) for i in range(3)],
                                             names=keep + ["n_links", "n_best", "count_sum"])

    return run


def link_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n, best: every linked pair of ids, its count, and whether it is the highest of its id of B."""
    pairs = aligned.select("links").mapInArrow(count_links, "code long, n long") \
        .groupBy("code").agg(F.sum("n").alias("n"))
    pairs = pairs.select(F.shiftright("code", SHIFT).alias("a"),
                         F.col("code").bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("b"), "n")
    top = pairs.groupBy("b").agg(F.max("n").alias("top"))
    return pairs.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str):
    """Per document its token counts, the hash of its groups and its links' scores; and the table of linked pairs."""
    import numpy as np
    import sentencepiece

    kind = dict(docs.dtypes)["doc_id"]
    aligned = stored(docs.select("doc_id", "text").mapInArrow(
        align_texts(path_a, path_b), f"doc_id {kind}, n_a long, n_b long, groups_sha256 string, links binary"), "aligned")
    counts = stored(link_counts(aligned), "link-counts")
    model = sentencepiece.SentencePieceProcessor(model_file=path_b)
    bound = most_pairs(vocabulary_a(path_a), vocabulary_b(model))
    rows = counts.count()
    if rows > bound:
        raise ValueError(f"{rows} linked pairs, but the vocabularies allow {bound} only")
    found = counts.toArrow()
    code = (found.column("a").to_numpy() << SHIFT) | found.column("b").to_numpy()
    order = np.argsort(code)
    shared = docs.sparkSession.sparkContext.broadcast(
        (code[order].astype(np.uint32), found.column("n").to_numpy()[order], found.column("best").to_numpy(
            zero_copy_only=False)[order]))
    scored = aligned.mapInArrow(
        score_links(shared), f"doc_id {kind}, n_a long, n_b long, groups_sha256 string, n_links long, n_best long, "
                             "count_sum long")
    return scored.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum",
                         "groups_sha256"), counts
