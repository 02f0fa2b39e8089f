"""Byte-level BPE ids of whole texts, each distinct word encoded once.

A text is cut before every space that does not stand between two other
white-space characters; the tokenizer's own pattern always cuts there
too, so the pieces can be encoded apart, equal ones once.
"""

from __future__ import annotations

import re

SPECIAL = "<|endoftext|>"
END_ID = 0
UNSAFE = re.compile(r"\s \s")
# bytes of white space and those that can begin one beyond ASCII, or a character above U+07FF
ODD_BYTES = [*range(9, 14), *range(28, 32), 0xC2, *range(0xE0, 0x100)]
LONG_WORD = 64  # bytes; longer words are hashed one by one


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Cut:
    """Words between single spaces of a list or Arrow array of texts (null: empty).

    ``words`` are the distinct ones (UTF-8), ``sizes`` their bytes, ``odd`` says which have a byte of
    ODD_BYTES; ``numbers`` are those of the words of all texts in order, ``many`` how many each text has.
    Words are told apart by 64-bit hashes of their length and bytes.
    """

    def __init__(self, texts):
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        from pandas.util import hash_array

        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        texts = texts.fill_null("")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else [0]
        base, end = int(offsets[0]), int(offsets[-1])
        raw = data.slice(base, end - base).to_pybytes() if data is not None else b""
        padded, offsets = np.frombuffer(raw + bytes(LONG_WORD), np.uint8), np.asarray(offsets) - base
        spaces = np.flatnonzero(padded[:len(raw)] == 32)
        start = np.insert(spaces + 1, np.searchsorted(spaces + 1, offsets[:-1]), offsets[:-1])
        stop = np.insert(spaces, np.searchsorted(spaces, offsets[1:]), offsets[1:])
        size = stop - start
        eight = np.ndarray((len(padded) - 7,), np.uint64, padded, strides=(1,))  # the 8 bytes from each place on
        keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

        def mix(key, start, size):
            key = key ^ (eight[start] & keep.take(np.minimum(size, 8)))
            key *= np.uint64(0xD6E8FEB86659FD93)
            key ^= key >> np.uint64(32)
            key *= np.uint64(0xC2B2AE3D27D4EB4F)
            key ^= key >> np.uint64(29)
            return key

        key = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), start, size)
        todo, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
        while len(todo):
            key[todo] = mix(key[todo], start[todo] + done, size[todo] - done)
            done += 8
            todo = todo[size[todo] > done]
        if len(big := np.flatnonzero(size > LONG_WORD)):
            words = np.empty(len(big), object)
            words[:] = [raw[a:b] for a, b in zip(start[big].tolist(), stop[big].tolist())]
            key[big] = hash_array(words, categorize=False)
        self.numbers, _ = pd.factorize(key)  # in order of appearance
        first = np.flatnonzero(np.diff(np.maximum.accumulate(self.numbers), prepend=-1))
        start, stop = start[first], stop[first]
        self.numbers = self.numbers.astype(np.int32)
        self.words = [raw[a:b] for a, b in zip(start.tolist(), stop.tolist())]
        self.sizes = stop - start
        odd = np.flatnonzero(np.frombuffer(raw.translate(bytes(b in ODD_BYTES for b in range(256))), bool))
        self.odd = np.searchsorted(odd, stop) > np.searchsorted(odd, start)
        self.many = np.diff(np.searchsorted(spaces, offsets)) + 1


class WordEncoder:
    """Ids by the vocabulary of ``path`` (its ranks lie beside it as ``.tiktoken``)."""

    def __init__(self, path: str):
        import base64

        import numpy as np
        import public_tokenizers
        import tiktoken

        with open(path.rsplit(".", 1)[0] + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                     special_tokens={SPECIAL: len(ranks)})
        self.n_bytes = np.zeros(len(ranks) + 1, np.int64)
        for word, i in ranks.items():
            self.n_bytes[i] = len(word)
        self.n_bytes[len(ranks)] = len(SPECIAL)

    def encode(self, text: str):
        import numpy as np

        return np.asarray(self.bpe.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)

    def encode_words(self, cut: Cut):
        """Ids of the distinct words, each with a space before it: all ids, where those of a word start, their number."""
        from itertools import compress

        import numpy as np

        plain = (cut.sizes > 0) & ~cut.odd
        for i in np.flatnonzero(cut.odd).tolist():
            word = cut.words[i].decode()
            plain[i] = not word[0].isspace() and not word[-1].isspace()
        start, length = np.zeros((2, len(plain)), np.int64)
        ids = np.zeros(0, np.uint32)
        if plain.any():
            ids = self.encode((b" " + b" ".join(compress(cut.words, plain.tolist()))).decode())
            ends = np.cumsum(self.n_bytes[ids])
            stop = np.searchsorted(ends, np.cumsum(cut.sizes[plain] + 1)) + 1
            start[plain] = np.r_[0, stop[:-1]]
            length[plain] = stop - start[plain]
        more, n = [ids], len(ids)
        for i in np.flatnonzero(~plain).tolist():
            own = self.encode(" " + cut.words[i].decode())
            start[i], length[i] = n, len(own)
            more.append(own)
            n += len(own)
        return np.concatenate(more), start, length, plain

    def encode_all(self, texts: list[str], cut: Cut | None = None):
        """For each text: its ids (uint32) and the numbers of its words; ``cut``: that of these texts."""
        import numpy as np

        cut = cut or Cut(texts)
        ids, start, length, plain = self.encode_words(cut)
        bare = (~plain).take(cut.numbers)  # beside white space of the word's own, or empty
        last = np.cumsum(cut.many)
        first = last - cut.many
        n = length.take(cut.numbers)
        n[first] = 0  # a text's first word has no space before it
        stop = np.cumsum(n)
        at = np.repeat(start.take(cut.numbers) - stop + n, n)
        at += np.arange(len(at))
        ids, stop, out = ids.take(at), np.append(0, stop), []
        for text, a, b, x, y in zip(texts, first.tolist(), last.tolist(), stop[first].tolist(), stop[last].tolist()):
            w = cut.numbers[a + 1:b]
            whole = bool((bare[a:b - 1] & bare[a + 1:b]).any()) and UNSAFE.search(text) is not None
            head = self.encode(text if whole else cut.words[cut.numbers[a]].decode())
            out.append((head if whole or x == y else np.concatenate([head, ids[x:y]]), w))
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
