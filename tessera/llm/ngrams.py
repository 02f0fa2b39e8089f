"""Character n-gram presence over a learned alphabet and vocabulary."""

from __future__ import annotations


class Grams:
    """The n-grams (n = 1..3) that at least ``least`` training texts hold.

    The ``size - 1`` most frequent characters of the training texts have
    symbols of their own; all others share symbol 0.
    """

    def __init__(self, texts: list[str], size: int, least: int = 2):
        import numpy as np

        self.size = size
        counts = np.zeros(0x110000, np.int64)
        for t in texts:
            counts += np.bincount(self.points(t), minlength=0x110000)
        top = np.argsort(-counts, kind="stable")[:size - 1]
        self.letters = top[counts[top] > 0]
        self.arm()
        held = np.zeros(size + size**2 + size**3, np.int32)
        for t in texts:
            held[np.unique(self.keys(t))] += 1
        self.grams = np.flatnonzero(held >= least)
        self.arm()

    @staticmethod
    def points(text: str):
        import numpy as np

        return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)

    def arm(self) -> None:
        """Lookup tables (built anew in each worker: only letters and grams travel)."""
        import numpy as np

        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[self.letters] = np.arange(1, len(self.letters) + 1)
        if "grams" in self.__dict__:
            self.slot = np.full(self.size + self.size**2 + self.size**3, len(self.grams), np.int32)
            self.slot[self.grams] = np.arange(len(self.grams))

    def __getstate__(self):
        return {"size": self.size, "letters": self.letters, "grams": self.grams}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.arm()

    def keys(self, text: str):
        """Number of every n-gram of the text, repeated ones too."""
        import numpy as np

        s, a = self.symbol[self.points(text)], self.size
        two = s[:-1] * a + s[1:]
        return np.concatenate([s, a + two, a + a * a + two[:-1] * a + s[2:]])

    def present(self, text: str):
        """0/1 for every gram of the vocabulary."""
        import numpy as np

        n = len(self.grams)
        return np.bincount(self.slot[self.keys(text)], minlength=n + 1)[:n] > 0
