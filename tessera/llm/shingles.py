"""Hashed word shingles of whole texts, computed a batch of bytes at a time."""

from __future__ import annotations

SEGMENT = 1 << 20


def _mix(x):
    """Finaliser of splitmix64 over an array."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of ``k``-word shingles as sorted arrays of 64-bit hashes.

    Words are runs without ASCII white space, A-Z lower-cased.  A text with
    fewer words is one shingle of all of them; one without words has none.
    """

    def __init__(self, k: int = 5):
        import numpy as np

        self.k = k
        byte = np.arange(256, dtype=np.uint64)
        low = np.where((byte >= 65) & (byte <= 90), byte + np.uint64(32), byte)
        self.values = _mix((low + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        self.space = np.isin(byte, [32, 9, 10, 11, 12, 13])
        self.powers = np.ones(1, np.uint64)
        self.lanes = _mix(np.arange(1, k + 2, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)

    def power(self, n: int):
        import numpy as np

        if n > len(self.powers):
            with np.errstate(over="ignore"):
                self.powers = np.concatenate([[np.uint64(1)], np.cumprod(
                    np.full(2 * n, 0xA0761D6478BD642D, np.uint64), dtype=np.uint64)])
        return self.powers

    def words(self, data: bytes):
        """(start, hash) of every word of a piece of text."""
        import numpy as np

        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        gap = self.space[raw]
        start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        if not len(start):
            return start, np.zeros(0, np.uint64)
        end = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
        length = end - start
        at = np.arange(len(raw))   # place within the word
        at[start[0]:] -= np.repeat(start, np.diff(np.append(start, len(raw))))
        at[gap] = 0
        value = np.where(gap, np.uint64(0), self.values[raw] * self.power(int(length.max()))[at])
        return start, _mix(np.add.reduceat(value, start) + length.astype(np.uint64))

    def batches(self, texts):
        """Runs of texts of about SEGMENT bytes; a longer text is a run of its own."""
        run, size = [], 0
        for t in texts:
            b = (t or "").encode("utf-8", "replace")
            if run and size + len(b) > SEGMENT:
                yield run
                run, size = [], 0
            run.append(b)
            size += len(b) + 1
        if run:
            yield run

    def word_hashes(self, run: list[bytes]):
        """Word hashes of a run of texts and the number of words of each."""
        import numpy as np

        if len(run) > 1:
            start, h = self.words(b"\n".join(run))
            ends = np.cumsum([len(b) + 1 for b in run])
            return h, np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
        data, parts, a = run[0], [], 0
        while a < len(data):  # a long text in segments that end between words
            b = min(len(data), a + SEGMENT)
            while b < len(data) and not self.space[data[b]]:
                b += 1
            parts.append(self.words(data[a:b])[1])
            a = b
        h = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        return h, np.array([len(h)])

    def sets(self, texts):
        """For each text the sorted distinct hashes of its shingles (int64)."""
        import numpy as np

        k = self.k
        for run in self.batches(texts):
            h, counts = self.word_hashes(run)
            full = np.zeros(max(0, len(h) - k + 1), np.uint64)
            for j in range(k):
                full += h[j:len(h) - k + 1 + j] * self.lanes[j] if len(full) else full
            full = _mix(full)
            end = np.cumsum(counts)
            for n, b in zip(counts.tolist(), end.tolist()):
                if n >= k:
                    yield np.unique(full[b - n:b - k + 1].view(np.int64))
                elif n:
                    few = (h[b - n:b] * self.lanes[:n]).sum(dtype=np.uint64, keepdims=True)
                    yield _mix(few + self.lanes[k:] * np.uint64(n)).view(np.int64)
                else:
                    yield np.zeros(0, np.int64)


def set_id(tokens) -> int:
    """64-bit fingerprint of a set of hashes."""
    import numpy as np

    mixed = _mix(tokens.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    size = np.array([len(tokens)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(_mix(mixed.sum(dtype=np.uint64, keepdims=True) + size).view(np.int64)[0])
