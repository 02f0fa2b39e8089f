"""Suffix arrays by two-stage sorting, over runs of bytes that 0xFF separates (UTF-8 never holds it).

Suffixes smaller than their successors are sorted directly, by their first
``depth`` bytes.  The others follow by one scan over the buckets of first
bytes: a suffix larger than its successor comes right after all that the
scan has placed before it in its bucket.  The order is that of the first
``depth`` bytes; equal strings of that length lie side by side, in any
order among themselves.
"""

from __future__ import annotations

SEPARATOR = 0xFF


def load_words(text: bytes, n: int, pad: int):
    """Eight bytes from every place on, big-endian, so that numbers compare as the bytes do."""
    import numpy as np

    raw = np.frombuffer(text + b"\0" * (pad + 16), np.uint8)
    return np.ndarray((n + pad,), ">u8", raw, 0, (1,)).astype(np.uint64)


def smaller_than_next(t):
    """Whether each suffix is smaller than its successor; the last one is not."""
    import numpy as np

    n = len(t)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    out[:-1] = t[:-1] < t[1:]
    same = np.flatnonzero(t[:-1] == t[1:])
    if len(same):  # the next place that differs decides; at the end of all, the shorter is smaller
        differs = np.flatnonzero(np.append(t[:-1] != t[1:], True))
        out[same] = out[differs[np.searchsorted(differs, same)]]
    return out


def sort_directly(at, words, text, depth: int):
    """``at`` in the order of the first ``depth`` bytes."""
    import numpy as np

    first = words[at]
    order = np.argsort(first, kind="stable")
    at, first = at[order], first[order]
    new = np.concatenate([[True], first[1:] != first[:-1]]) if len(at) else np.zeros(0, bool)
    tied = np.flatnonzero(~new | np.append(~new[1:], False))
    if len(tied):
        raw = np.frombuffer(text + b"\0" * (depth + 1), np.uint8)
        strings = np.ndarray((len(text) + 1,), f"S{depth}", raw, 0, (1,))
        some = at[tied]
        at[tied] = some[np.argsort(strings[some], kind="stable")]
    return at


def suffix_order(text: bytes, wanted, depth: int):
    """Places marked in ``wanted`` (booleans) in the order of their suffixes' first ``depth`` bytes."""
    import numpy as np

    t = np.frombuffer(text, np.uint8)
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    small = smaller_than_next(t)
    # what induces a wanted place lies on the way to the next suffix that is sorted directly
    seeds = np.flatnonzero(small)
    marked = np.flatnonzero(wanted)
    to = np.append(seeds, n - 1)[np.searchsorted(seeds, marked)]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, marked, 1)
    np.add.at(change, to + 1, -1)
    kept = np.cumsum(change[:-1]) > 0
    words = load_words(text, n, depth + 8)
    direct = sort_directly(np.flatnonzero(small & kept), words, text, depth)
    large = kept & ~small
    starts = np.searchsorted(t[direct], np.arange(257))
    pending = [[] for _ in range(256)]
    if large[n - 1]:
        pending[t[n - 1]].append(np.array([n - 1]))  # followed by the empty suffix, the least of all
    out = []
    for c in range(256):
        found = []
        wave = np.concatenate(pending[c]) if pending[c] else np.zeros(0, np.int64)
        pending[c] = []
        for step in range(depth + 1):  # successors in the same bucket: one wave for each repeat of the byte
            if not len(wave):
                break
            found.append(wave)
            before = wave[wave > 0] - 1
            wave = before[large[before] & (t[before] == c)]
        if len(wave):  # the rest of long runs of the byte is equal as far as ``depth`` goes
            others = np.concatenate([[-1], np.flatnonzero(t != c)])
            start = others[np.searchsorted(others, wave) - 1] + 1
            size = wave - start + 1
            rest = np.repeat(wave, size) - (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
            found.append(rest[large[rest]])
        bucket = np.concatenate(found + [direct[starts[c]:starts[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[large[before] & (t[before] > c)]
        first = t[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        edges = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, edges) if len(before) else []:
            pending[t[part[0]]].append(part)
    every = np.concatenate(out) if out else np.zeros(0, np.int64)
    return every[wanted[every]]


def common_prefixes(order, text: bytes, depth: int):
    """Length of the common prefix of each suffix and the one before it, up to ``depth`` (a multiple of 8)."""
    import numpy as np

    lcp = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return lcp
    words = load_words(text, len(text), depth + 8)
    alive = np.arange(1, len(order))
    for step in range(0, depth, 8):
        a, b = words[order[alive] + step], words[order[alive - 1] + step]
        same = a == b
        differ = (a ^ b)[~same].astype(">u8").view(np.uint8).reshape(-1, 8) != 0
        lcp[alive[~same]] = step + differ.argmax(axis=1)
        alive = alive[same]
        if not len(alive):
            break
    lcp[alive] = depth
    return lcp
