"""Suffix sorting and the removal of repeated strings against brute force."""

import hashlib
import random

import numpy as np
from llm_data import docs_of  # noqa: F401

from tessera.llm import suffixdedup
from tessera.llm.suffixdedup import cut_pieces, remove_repeats, repeat_digest, repeated_windows
from tessera.llm.suffixes import common_prefixes, suffix_order


def test_two_stage_order_equals_plain_sorting():
    rnd = random.Random(1)
    for _ in range(1500):
        alphabet = rnd.choice([b"ab", b"abc", b"a", b"\0a\xff", bytes(range(256))])
        s = bytes(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80)))
        depth = rnd.choice([8, 16, 96])
        wanted = np.array([rnd.random() < rnd.choice([0.2, 0.9]) for _ in s], bool)
        got = suffix_order(s, wanted, depth)
        assert sorted(got.tolist()) == np.flatnonzero(wanted).tolist()
        keys = [s[i:i + depth].ljust(depth, b"\0") for i in got]
        assert keys == sorted(keys)
        padded = [s[i:].ljust(96, b"\0")[:depth] for i in got]
        lcp = common_prefixes(got, s, depth)
        for a, b, n in zip(padded, padded[1:], lcp[1:]):
            same = next((k for k in range(depth) if a[k] != b[k]), depth)
            assert n == same
    long = b"x" + b"z" * 100_000 + b"y" + b"z" * 50_000
    order = suffix_order(long, np.ones(len(long), bool), 200)
    assert np.array_equal(np.sort(order), np.arange(len(long)))


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for b in texts:
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (i, _), b in zip(rows, texts):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed, n, length):
    """Texts that share passages about as long as ``length``, at their ends and inside."""
    rnd = random.Random(seed)
    some = ["".join(rnd.choice("abé ") for _ in range(rnd.randint(length // 2, 3 * length))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(some) if rnd.random() < 0.5 else
                 "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 2 * length)))
                 for _ in range(rnd.randint(0, 5))]
        rows.append((i, "".join(parts)))
    return rows


def digest(docs, length):
    return sorted(map(tuple, repeat_digest(remove_repeats(docs, length)).collect()), key=str)


def test_pieces_cover_all_windows_and_meet_by_anchor(monkeypatch):
    rnd = random.Random(2)
    for chunk in (1 << 20, 64):
        monkeypatch.setattr(suffixdedup, "CHUNK", chunk)
        for length in (16, 40, 200):
            data = bytes(rnd.choice(b"ab") for _ in range(700)) * 2
            anchors, windows = {}, []
            for first, size, at, g in cut_pieces(data, length):
                for f, s, a, x in zip(first.tolist(), size.tolist(), at.tolist(), g.tolist()):
                    assert s - 1 <= a <= length
                    for p in range(f, f + s):
                        windows.append(p)
                        assert anchors.setdefault(data[p:p + length], (x, f + a - p)) == (x, f + a - p)
            assert windows == list(range(len(data) - length + 1))


def test_repeats_equal_brute_force(docs_of, spark):
    for length in (16, 40):
        rows = passages(3, 60, length)
        rows += [(60, None), (61, ""), (62, "x" * (5 * length)), (63, rows[5][1]), (63, rows[5][1]), (None, rows[7][1])]
        docs = docs_of(rows, ["spans", "rk", "g", "n_bytes"]).repartition(4)
        assert digest(docs, length) == brute(rows, length)
    assert remove_repeats(docs_of([])).count() == 0
    one = digest(docs_of([(1, "abc"), (2, "abc")]), 200)
    assert one == brute([(1, "abc"), (2, "abc")], 200)


def test_hot_anchors_are_split(docs_of, monkeypatch):
    rnd = random.Random(4)
    monkeypatch.setattr(suffixdedup, "HOT", 5)
    monkeypatch.setattr(suffixdedup, "SHARD", 16)
    shared = "".join(rnd.choice("abcdef ") for _ in range(90))

    def noise(k):
        return "".join(rnd.choice("abcdef ") for _ in range(k))

    rows = [(i, noise(60) + shared[rnd.randint(0, 30):rnd.randint(55, 90)] + noise(60)) for i in range(60)]
    assert digest(docs_of(rows), 40) == brute(rows, 40)


def test_long_text(docs_of, monkeypatch):
    monkeypatch.setattr(suffixdedup, "CHUNK", 5000)
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdefghij ") for _ in range(30_000))
    rows = [(1, base), (2, base[20_000:] + "!" + base[:9000]), (3, "z" * 20_000)]
    assert digest(docs_of(rows), 200) == brute(rows, 200)


def test_windows_of_pieces():
    a, b = b"0123456789abcdefghij", b"xx0123456789abcdefgh"
    piece, at = repeated_windows([a, b, b"qqqqqqqqqqqqqqqr!"], [1, 1, 1], 16)
    assert list(zip(piece.tolist(), at.tolist())) == [(0, 0), (0, 1), (0, 2), (1, 2), (1, 3), (1, 4)]
    assert len(repeated_windows([a], [2], 16)[0]) == 5 and len(repeated_windows([a], [1], 16)[0]) == 0
