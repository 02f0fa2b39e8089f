"""Benchmark decontamination: pigeonhole edit matching.

Texts and items are compared lower-cased with white space as single
spaces.  An item may occur with up to ``rate`` of its length in edits;
split into one piece more than that, at least one piece must occur
unchanged.  One automaton of all pieces finds those hits in a whole text,
a q-gram count discards most windows around them, and Myers' bit-parallel
distance decides the rest.

Edge cases: null or empty texts hold no item; null or blank items, or
ones without an id, are never found; repeated rows are judged each on its
own; items with equal text are each reported; an empty benchmark or an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release_memory

RATE = 0.08
GRAM = 4
ITEM_CHARS = 4 << 20   # characters of items in one automaton; more are searched in several passes

FOUND = "doc_id long, item_id long, distance int, budget int"


def folded(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): the item in budget + 1 parts of nearly equal length."""
    cuts = [len(item) * j // (budget + 1) for j in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


class Item:
    def __init__(self, item_id: int, text: str, rate: float):
        self.id, self.text = item_id, text
        self.budget = int(rate * len(text))
        self.grams = [text[i:i + GRAM] for i in range(len(text) - GRAM + 1)]
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def near(self, window: str) -> bool:
        """An edit spoils at most GRAM of the item's grams; the others must be there."""
        have = {window[i:i + GRAM] for i in range(len(window) - GRAM + 1)}
        return sum(g in have for g in self.grams) >= len(self.grams) - self.budget * GRAM

    def distance(self, window: str) -> int:
        """Least edit distance between the item and any part of the window (Myers)."""
        if self.text in window:
            return 0
        m = len(self.text)
        full, top, masks = (1 << m) - 1, 1 << m - 1, self.masks
        up, down, score, best = full, 0, m, m
        for c in window:
            eq = masks.get(c, 0)
            vertical = eq | down
            diagonal = ((eq & up) + up ^ up | eq) & full
            plus = down | ~(diagonal | up) & full
            minus = up & diagonal
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
                best = min(best, score)
            plus, minus = plus << 1 & full, minus << 1 & full
            up = minus | ~(vertical | plus) & full
            down = plus & vertical
        return best


def automaton(items: list[Item]):
    import ahocorasick

    words: dict[str, list[tuple[int, int]]] = {}
    for n, item in enumerate(items):
        for offset, piece in pieces(item.text, item.budget):
            words.setdefault(piece, []).append((n, offset))
    auto = ahocorasick.Automaton()
    for word, places in words.items():
        auto.add_word(word, (len(word), places))
    auto.make_automaton()
    return auto


def search(text: str, items: list[Item], auto) -> list[tuple[int, int]]:
    """(number of the item, its distance) for every item within its budget."""
    starts: dict[int, set[int]] = {}
    for end, (size, places) in auto.iter(text):
        for n, offset in places:
            starts.setdefault(n, set()).add(end - size + 1 - offset)
    found = []
    for n, at in starts.items():
        item, best = items[n], None
        k, m = item.budget, len(item.text)
        low = high = None
        spans = []
        for a in sorted(at):
            if high is not None and a - k <= high:
                high = a + m + k
            else:
                if high is not None:
                    spans.append((low, high))
                low, high = a - k, a + m + k
        spans.append((low, high))
        for low, high in spans:
            window = text[max(0, low):high]
            if item.near(window):
                d = item.distance(window)
                best = d if best is None else min(best, d)
        if best is not None and best <= k:
            found.append((n, best))
    return found


def item_blocks(benchmark: DataFrame, most: int):
    """The items, folded, in blocks of bounded size."""
    block, size = [], 0
    rows = benchmark.select("item_id", "text").filter("item_id is not null and text is not null")
    for r in rows.toLocalIterator():
        text = folded(r["text"])
        if text:
            block.append((r["item_id"], text))
            size += len(text)
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_items(docs: DataFrame, block: list[tuple[int, str]], rate: float) -> DataFrame:
    def run(batches):
        items = [Item(i, t, rate) for i, t in block]
        auto = automaton(items)
        for b in batches:
            rows = [(doc_id, items[n].id, d, items[n].budget)
                    for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                    if text for n, d in search(folded(text), items, auto)]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 2 + [pa.int32()] * 2)],
                names=["doc_id", "item_id", "distance", "budget"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE,
               item_chars: int = ITEM_CHARS) -> DataFrame:
    """doc_id, item_id, edit distance and budget of every benchmark item found in a document."""
    spark = docs.sparkSession
    out = None
    for block in item_blocks(benchmark, item_chars):
        part = find_items(docs, block, rate)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], FOUND) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE,
               item_chars: int = ITEM_CHARS) -> DataFrame:
    """The documents in whose text no benchmark item occurs.

    Null and empty texts hold none; repeated rows and all columns stay as
    they are; an empty table stays empty, an empty benchmark drops nothing.
    """
    for block in item_blocks(benchmark, item_chars):
        docs = docs.filter(~holds_item(block, rate)(F.col("text")))
    return docs


def holds_item(block: list[tuple[int, str]], rate: float):
    @F.arrow_udf("boolean")
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = [Item(i, t, rate) for i, t in block]
        auto = automaton(items)
        for texts in batches:
            yield pa.array([bool((t := x.as_py()) and search(folded(t), items, auto)) for x in texts], pa.bool_())
            release_memory()

    return holds
