"""N-gram Jaccard join, components and decontamination against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_data import docs_of, near_copies  # noqa: F401

from tessera.llm import shingles as shingle_module
from tessera.llm.components import components
from tessera.llm.decontam import Item, drop_leaks, find_leaks, folded
from tessera.llm.ngramjoin import intersections, keep_one, similar_documents
from tessera.llm.shingles import Shingler

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    common = Counter((a, b) for h in holders.values() for n, a in enumerate(h) for b in h[:n])
    for (a, b), c in common.items():
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("group", [8, 256])
def test_join_equals_brute_force(docs_of, group):
    rows = near_copies()
    out = similar_documents(docs_of(rows, ["component_id", "n", "comp"]).repartition(3), group=group)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    assert {r[0]: (r[1], r[2]) for r in out.collect()} == brute(rows)


def test_join_edges(docs_of, spark):
    assert similar_documents(docs_of([])).count() == 0
    long = " ".join(str(i) for i in range(60_000))
    rows = [(7, long), (3, long + " more"), (5, ""), (None, "p q r s t u"), (9, "P q r s t u"), (9, "P q r s t u")]
    out = sorted(similar_documents(docs_of(rows)).collect(), key=str)
    got = {(r.doc_id, r.component_id) for r in out}
    assert got == {(7, 3), (3, 3), (5, 5), (None, 9), (9, 9)} and len(out) == 6
    kept = keep_one(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 9]


def test_shingles_by_hash_are_the_same_sets():
    rnd = random.Random(1)
    parts = ["a", "B", "é", "\x0b", " ", " ", "\n", "\t", "\x1c", "x", "\u3000", ""]
    texts = [None, ""] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    by_set = {}
    for segment in (32, 1 << 20):
        shingle_module.SEGMENT, before = segment, shingle_module.SEGMENT
        for t, s in zip(texts, Shingler().sets(texts)):
            own = shingle_set(t)
            assert len(s) == len(own)
            assert by_set.setdefault(frozenset(own), tuple(s.tolist())) == tuple(s.tolist())
        shingle_module.SEGMENT = before
    assert len(set(by_set.values())) == len(by_set)


def test_intersections():
    rnd = np.random.default_rng(2)
    sets = [np.unique(rnd.integers(0, 60, n)) for n in rnd.integers(0, 50, 30)]
    got = intersections(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert got[i, j] == len(set(a.tolist()) & set(b.tolist()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (400, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100, 400: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_myers_distance():
    rnd = random.Random(3)
    for _ in range(300):
        item = "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 90)))
        text = "".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 120)))
        assert Item(0, item, 0.1).distance(text) == plain_distance(item, text)


def edited(rnd, text, n):
    t = list(text)
    for _ in range(n):
        i = rnd.randrange(len(t))
        t[i:i + 1] = rnd.choice([[], ["q"], [t[i], "q"]])
    return "".join(t)


def test_leaks_equal_brute_force(docs_of, spark):
    rnd = random.Random(4)
    words = ["thing", "of", "there", "Anonymous", "a", "river", "stone", "blue"]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(8, 25)))) for i in range(12)]
    items += [(100, None), (None, "x y"), (101, "  "), (102, "of")]
    rows = []
    for i in range(60):
        filler = " ".join(rnd.choice(words) for _ in range(30))
        item = rnd.choice(items[:12])[1]
        rows.append((i, f"{filler}\n{edited(rnd, item, rnd.randint(0, 14))}  {filler}" if i % 3 else filler))
    rows += [(60, None), (61, ""), (62, items[0][1].upper()), (62, items[0][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in rows:
        for n, x in items:
            if t and x and n is not None and folded(x):
                item = Item(n, folded(x), 0.08)
                if (d := plain_distance(item.text, folded(t))) <= item.budget:
                    want.append((i, n, d, item.budget))
    for item_chars in (100, 1 << 20):
        got = find_leaks(docs_of(rows, ["item_id", "distance"]), bench, item_chars=item_chars)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        left = drop_leaks(docs_of(rows), bench, item_chars=item_chars)
        assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in rows if i not in {w[0] for w in want})
    assert find_leaks(docs_of(rows), bench.limit(0)).count() == 0
    assert find_leaks(docs_of([]), bench).count() == 0
