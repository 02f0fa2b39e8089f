"""Double-array tries and phrase mining against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import phrases as module
from tessera.llm import shingles
from tessera.llm.doublearray import DoubleArray
from tessera.llm.phrases import mine_phrases

ROWS = "doc_id long, text string, lang string, score string, id string"


def test_trie_finds_what_plain_search_finds():
    rnd = random.Random(1)
    for _ in range(150):
        words = rnd.randint(1, 30)
        some = set()
        for _ in range(rnd.randint(0, 80)):
            p = tuple(rnd.randrange(words) for _ in range(rnd.randint(2, 4)))
            some |= {p[:k] for k in range(2, len(p) + 1)} if rnd.random() < 0.5 else {p}
        some = sorted(some)
        trie = DoubleArray(np.array([list(p) + [-1] * (4 - len(p)) for p in some], int).reshape(-1, 4), words)
        text = [rnd.randint(-1, words - 1) for _ in range(300)]
        got = Counter()
        for _, states in trie.walk(np.array(text)):
            leaf = trie.leaf[states[states >= 0]]
            got.update(leaf[leaf >= 0].tolist())
        number = {p: i for i, p in enumerate(some)}
        want = Counter(number[g] for i in range(300) for k in (2, 3, 4)
                       if i + k <= 300 and (g := tuple(text[i:i + k])) in number)
        assert got == want


def brute(rows, least, top):
    f, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        c = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in c.items():
            longer = [b for q, b in c.items() if len(q) > len(p)
                      and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, cut = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = ["a", "the", "New", "york", "City", "é", "Ünder", "x-y", "of", "state"]
    fixed = ["new York city hall", "state of the art", "the the the the"]
    rows = []
    for i in range(n):
        parts = [rnd.choice(fixed) if rnd.random() < 0.3 else rnd.choice(words) for _ in range(rnd.randint(0, 40))]
        text = "".join(p + rnd.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\x0b"]) for p in parts)
        rows.append((i, text, rnd.choice(["en", "en", "fr", None]), "x", "y"))
    return rows + [(n, None, "en", "x", "y"), (n + 1, "", "de", "x", "y"), (None, "one two", None, "x", "y"),
                   (n + 2, "state of the art " * 400, "en", "x", "y"), (0, rows[0][1], rows[0][2], "x", "y")]


@pytest.mark.parametrize("limits", [{}, {"MAX_PHRASES": 8, "SLICE": 4}, {"MAX_WORDS": 3}, {"HELD": 50, "STREAM": 40}])
def test_phrases_equal_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(module, name, value)
    rows = corpus(3, 80)
    docs = spark.createDataFrame(rows, ROWS).repartition(3)
    got = mine_phrases(docs, least=12, top=20)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 12, 20)


def test_long_text_and_empty_table(spark, monkeypatch):
    rnd = random.Random(4)
    text = " ".join(rnd.choice(["p", "q", "rr", "s.", "t"]) for _ in range(20_000))
    rows = [(1, text, "en", "x", "y"), (2, "z" * 50_000 + " p q", "en", "x", "y")]
    monkeypatch.setattr(shingles, "SEGMENT", 500)
    assert sorted(map(tuple, mine_phrases(spark.createDataFrame(rows, ROWS)).collect())) == brute(rows, 30, 2000)
    assert mine_phrases(spark.createDataFrame([], ROWS)).count() == 0
    assert mine_phrases(spark.createDataFrame([(1, None, None, "", "")], ROWS)).count() == 0
