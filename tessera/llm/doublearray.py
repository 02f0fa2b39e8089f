"""Double-array tries over sequences of word numbers, walked for all places of a text at once.

States are slots: the child of state s by word c is slot base[s] + c, and
check[slot] = s tells that the slot is that child.  The children of the
root are the slots 0 to words - 1.
"""

from __future__ import annotations

TRIES = 64  # places tried together for the children of a state
ROUNDS = 4


class DoubleArray:
    """``phrases``: a row of word numbers each (-1 after the end); their prefixes of two or more words are in it too."""

    def __init__(self, phrases, n_words: int):
        import numpy as np

        phrases = np.asarray(phrases, np.int64)
        size = max(64, 2 * (n_words + len(phrases)))
        self.base = np.zeros(size, np.int32)
        self.check = np.full(size, -1, np.int32)
        self.leaf = np.full(size, -1, np.int32)  # number of the phrase that ends in a state
        self.n_words = n_words
        self.used = np.zeros(size, bool)
        self.used[:n_words] = True
        length = (phrases >= 0).sum(axis=1)
        state = phrases[:, 0].copy()  # of each phrase's prefix of the length at hand
        for k in range(2, phrases.shape[1] + 1):
            some = np.flatnonzero(length >= k)
            if not len(some):
                break
            pair = state[some] * n_words + phrases[some, k - 1]
            unique, of = np.unique(pair, return_inverse=True)
            slots = self.place(unique // n_words, unique % n_words)
            state[some] = slots[of]
            ends = some[length[some] == k]
            self.leaf[state[ends]] = ends
        top = int(np.flatnonzero(self.used)[-1]) + 1 if self.used.any() else 1
        self.base, self.check, self.leaf = self.base[:top], self.check[:top], self.leaf[:top]
        del self.used

    def grow(self, size: int) -> None:
        import numpy as np

        more = size - len(self.used)
        if more > 0:
            self.base = np.append(self.base, np.zeros(more, np.int32))
            self.check = np.append(self.check, np.full(more, -1, np.int32))
            self.leaf = np.append(self.leaf, np.full(more, -1, np.int32))
            self.used = np.append(self.used, np.zeros(more, bool))

    def place(self, parent, word):
        """Slots of the children (sorted by parent, then word)."""
        import numpy as np

        first = np.flatnonzero(np.concatenate([[True], np.diff(parent) != 0]))
        many = np.diff(np.append(first, len(parent)))
        out = np.zeros(len(parent), np.int64)
        pick = np.random.default_rng(len(parent))
        self.grow(int(self.used.sum()) + 3 * len(parent))
        for i in np.argsort(-many, kind="stable"):  # those with many children first, while there is room
            if many[i] == 1:
                break
            rows = slice(first[i], first[i] + many[i])
            offset = word[rows] - word[first[i]]
            room = len(self.used) - int(offset[-1])
            at = -1
            for _ in range(ROUNDS if room > self.n_words else 0):
                some = pick.integers(self.n_words, room, TRIES)
                some = some[~self.used[some[:, None] + offset[None, :8]].any(axis=1)]
                at = next((int(f) for f in some if not self.used[f + offset].any()), -1)
                if at >= 0:
                    break
            if at < 0:  # behind all others
                at = len(self.used)
                self.grow(at + int(offset[-1]) + 1)
            out[rows] = at + offset
            self.used[at + offset] = True
            self.base[parent[first[i]]] = at - word[first[i]]
            self.check[at + offset] = parent[first[i]]
        single = first[many == 1]  # any free slot will do
        if len(single):
            self.grow(int(self.used.sum()) + len(single))
            slots = np.flatnonzero(~self.used)[:len(single)]
            if len(slots) < len(single):
                self.grow(len(self.used) + len(single))
                slots = np.flatnonzero(~self.used)[:len(single)]
            out[single] = slots
            self.used[slots] = True
            self.base[parent[single]] = slots - word[single]
            self.check[slots] = parent[single]
        return out

    def advance(self, states, words):
        """The states after one more word each; -1 where there is none."""
        import numpy as np

        to = self.base[states].astype(np.int64) + words
        ok = (states >= 0) & (words >= 0) & (to >= self.n_words) & (to < len(self.check))
        to[~ok] = 0
        ok &= self.check[to] == states
        return np.where(ok, to, -1)

    def walk(self, words, most: int = 4):
        """For k = 2, 3, ...: the state after k words from every place (arrays shorter by k - 1)."""
        import numpy as np

        states = np.where(words < self.n_words, words, -1)
        for k in range(2, most + 1):
            if len(words) < k:
                return
            states = self.advance(states[:len(words) - k + 1], words[k - 1:])
            yield k, states
