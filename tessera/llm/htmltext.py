"""HTML extraction: wrappers by union-free regular-expression inference.

A page is a stream of block tags and text slots, brought into balance by
the usual implied end tags.  The streams of one host are aligned one after
the other: what only some hold becomes optional, what follows itself
becomes a repeated group, and every run of text a slot.  The outcome is
one wrapper (a union-free regular expression) for each host.  A text that
a slot holds on every page of the host that has the slot is a literal of
the wrapper; outside an article or main container it is no content, inside
one nothing is dropped.  A slot with other texts varies.  Slots are
judged once by the containers around them, and where no slot varies but in
containers that class names set apart, those are the article's.  A page's
text is what its host's wrapper finds in the slots of the article.

Repeated siblings fold already inside a page, so pages of a host often
share their shape: distinct shapes are counted first and aligned in rounds,
by groups of bounded size, until each host has one.

Edge cases: null or empty html gives the empty text; null urls share one
wrapper; unclosed, crossed or cut tags are repaired; where backtracking
takes long, the same match is found by trying each step once at each place
of the page, so that no result hangs on the clock; a page that its wrapper
does not fit is judged by its own containers, and ``wrapped`` is false;
repeated rows are judged each on its own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

GROUP = 64        # shapes that one task aligns, about
MATCH_SECONDS = 2.0
LEAST_PAGES = 10  # of different html: on fewer, the same text may be chance
HELD = 50_000     # slots that a task holds before it hands them on
BROADCAST_BYTES = 8 << 20
ELSEWHERE = 3     # rank of a block outside any article or main container
MAX_DEPTH = 100   # blocks nested deeper part the text, but are no containers of their own

# HTML's elements by their part in the page.
INLINE = set("""a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label
    mark meter nobr output progress q rp rt ruby s samp small source span strike strong sub sup time
    track tt u var wbr""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg math object select".split())
CLOSES_P = set("""address article aside blockquote center details dialog dir div dl fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table
    ul""".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
               "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
               "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPES = {"ul", "ol", "dl", "table", "menu"}
APART_TAGS = set("nav footer aside form menu dialog button fieldset head".split())
APART_ROLES = set("navigation banner contentinfo complementary search form dialog alert".split())
APART_WORDS = set("""ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments
    consent cookie cookies disqus footer header login masthead menu modal nav navbar navigation
    newsletter notice notices pager pagination popup promo promoted recommended related replies reply
    search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split())
ARTICLE_WORDS = set("article content entry post story".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"""
                 r"""|<(/?)([A-Za-z][^\s/>]*+)((?>"[^"]*"|'[^']*'|[^'">])*+)(?:>|\Z)""", re.DOTALL)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

EXTRACTED = "page_id long, url string, text string, n_chars long, wrapped boolean"


def signature(name: str, attrs: str) -> str:
    """The element's name with what its class, id and role say, without digits."""
    if not attrs.strip():
        return name
    said = {k.lower(): re.sub(r"\d+", "", v.strip("\"'")) for k, v in ATTR.findall(attrs)}
    out = name
    for mark, k in ((".", "class"), ("#", "id"), ("@", "role")):
        if words := " ".join(sorted(said.get(k, "").split())):
            out += mark + words
    return out


def stream(html: str) -> list[tuple[str, str]]:
    """Balanced ("<", signature), (">", signature) and ("#", text) of a page."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []   # (name, signature) of open blocks
    text: list[str] = []
    too_deep: dict[str, int] = {}       # open blocks beyond MAX_DEPTH
    at = 0

    def flush():
        if run := " ".join(unescape("".join(text)).split()):
            out.append(("#", run))
        text.clear()

    def close(n):
        flush()
        while len(stack) > n:
            out.append((">", stack.pop()[1]))

    def find(names):
        """Place of the nearest open block of these names within the innermost scope."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in SCOPES:
                break
        return None

    while m := TAG.search(html, at):
        text.append(html[at:m.start()])
        at = m.end()
        slash, name, attrs = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not name:
            continue
        if name == "br":
            text.append(" ")
        elif name in RAW:
            if not slash and not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
        elif name in INLINE:
            continue
        elif slash:
            if too_deep.get(name):
                flush()
                too_deep[name] -= 1
            elif any(name == n for n, _ in stack):
                close(max(i for i, (n, _) in enumerate(stack) if n == name))
        else:
            flush()
            if name in CLOSES_P and (i := find({"p"})) is not None:
                close(i)
            if name in SAME_CLOSES and (i := find(SAME_CLOSES[name])) is not None:
                close(i)
            if name in VOID:
                continue
            if len(stack) == MAX_DEPTH:
                too_deep[name] = too_deep.get(name, 0) + 1
            else:
                stack.append((name, signature(name, attrs)))
                out.append(("<", stack[-1][1]))
    text.append(html[at:])
    close(0)
    return out


# --- templates: [kind, signature, items]; items are [template, quantifier] ---------------------

def key(t) -> str:
    return t[0] + t[1] if t[0] != "(" else "(" + " ".join(key(x) for x, _ in t[2]) + ")"


def joined(a: str, b: str) -> str:
    """Quantifier that allows what either allows."""
    none, many = a in "?*" or b in "?*", a in "+*" or b in "+*"
    return ("*" if none else "+") if many else ("?" if none else "1")


def merged(a, b):
    return [a[0], a[1], align(a[2], b[2])]


def fold(items):
    """Neighbours alike become one repeated item; repeated sequences of items a repeated group."""
    out = []
    for t, q in items:
        if out and key(out[-1][0]) == key(t):
            both_none = out[-1][1] in "?*" and q in "?*"
            out[-1] = [merged(out[-1][0], t), "*" if both_none else "+"]
        else:
            out.append([t, q])
    i = 0
    while i < len(out):
        keys = [key(t) for t, _ in out]
        for n in range(2, (len(out) - i) // 2 + 1):
            if keys[i:i + n] == keys[i + n:i + 2 * n]:
                body, j = out[i:i + n], i + n
                while keys[j:j + n] == keys[i:i + n]:
                    body = align(body, out[j:j + n])
                    j += n
                out[i:j] = [[["(", "", body], "+"]]
                break
        i += 1
    return out


def grouped(items, other):
    """Sequences of ``items`` that ``other`` holds as a group become groups as well."""
    for t, _ in other:
        if t[0] == "(":
            want, i = [key(x) for x, _ in t[2]], 0
            while i + len(want) <= len(items):
                if [key(x) for x, _ in items[i:i + len(want)]] == want:
                    items = [*items[:i], [["(", "", items[i:i + len(want)]], "1"], *items[i + len(want):]]
                i += 1
    return items


def align(a, b):
    """Items that both sequences hold, in order, the others optional."""
    a, b = grouped(a, b), grouped(b, a)
    ka, kb = [key(t) for t, _ in a], [key(t) for t, _ in b]
    if ka == kb:
        return [[merged(x, y), joined(p, q)] for (x, p), (y, q) in zip(a, b)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1],
                             best[i + 1][j + 1] + 1 if ka[i] == kb[j] else 0)
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and ka[i] == kb[j] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append([merged(a[i][0], b[j][0]), joined(a[i][1], b[j][1])])
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], joined(a[i][1], "?")])
            i += 1
        else:
            out.append([b[j][0], joined(b[j][1], "?")])
            j += 1
    return fold(out)


def shape(tokens) -> list:
    """The folded items of one page."""
    level, stack = [], []
    for kind, said in tokens:
        if kind == "#":
            level.append([["#", "", []], "1"])
        elif kind == "<":
            stack.append((said, level))
            level = []
        else:
            said, outer = stack.pop()
            outer.append([["<", said, fold(level)], "1"])
            level = outer
    return fold(level)


# --- what a slot holds, by the containers around it -------------------------------------------

def said_words(sig: str) -> set[str]:
    return {w.lower() for w in WORD.findall(re.split(r"[.#@]", sig + ".", maxsplit=1)[1])}


def rank(path: tuple[str, ...], by_class: bool = True) -> int | None:
    """0: inside an article, 1: main, 2: a block named like one, 3: elsewhere; None: apart.

    Without ``by_class`` the names in class and id set nothing apart.
    """
    best = 3
    for i, sig in enumerate(path):
        name = re.split(r"[.#@]", sig, maxsplit=1)[0]
        words = said_words(sig)
        role = sig.rpartition("@")[2] if "@" in sig else ""
        if name == "article":
            best = 0
        elif name == "main" or role == "main":
            best = min(best, 1)
        elif name in ("html", "body"):
            continue
        elif name in APART_TAGS or role in APART_ROLES:
            return None
        elif name == "header":   # of the site, or of the article: then its headings belong to it
            inner = re.split(r"[.#@]", path[-1], maxsplit=1)[0]
            if best == 3 or inner not in HEADINGS:
                return None
        elif by_class and words & APART_WORDS:
            return None
        elif words & ARTICLE_WORDS:
            best = min(best, 2)
    return best


def text_key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little",
                          signed=True)


class Wrapper:
    """A host's template as a regular expression over one character for each tag, "#" for text.

    ``learned`` has the literals of its slots, [slot, keys of texts], and the slots that vary.
    """

    def __init__(self, items, learned=None):
        import regex

        self.items = items
        self.symbols: dict[tuple[str, str], str] = {}
        self.ranks: list[int | None] = []
        self.unnamed: list[int | None] = []
        self.pattern = regex.compile(self.expression(items, ()))
        literals, varying = learned or ([], [])
        self.literals = {(n, t) for n, texts in literals for t in texts}
        if varying and all(self.ranks[n] is None for n in varying):
            for n in varying:
                self.ranks[n] = self.unnamed[n]

    def symbol(self, kind: str, sig: str) -> str:
        return self.symbols.setdefault((kind, sig), chr(0xF0000 + len(self.symbols)))

    def expression(self, items, path) -> str:
        out = ""
        for (kind, sig, inner), q in items:
            if kind == "#":
                self.ranks.append(rank(path))
                self.unnamed.append(rank(path, by_class=False))
                body = f"(?P<s{len(self.ranks) - 1}>#)"
            elif kind == "(":
                body = self.expression(inner, path)
            else:
                body = self.symbol("<", sig) + self.expression(inner, (*path, sig)) + self.symbol(">", sig)
            out += body if q == "1" else f"(?:{body}){q}"
        return out

    def numbered(self, tokens) -> list[tuple[int, str]] | None:
        """(slot, text) of every text of the page, in its order; None if it doesn't fit."""
        page = "".join("#" if k == "#" else self.symbols.get((k, s), "?") for k, s in tokens)
        try:
            m = self.pattern.fullmatch(page, timeout=MATCH_SECONDS)
            found = [(a, n) for n in range(len(self.ranks)) for a, _ in m.spans(f"s{n}")] if m else None
        except TimeoutError:
            found = self.walk(page)
        return None if found is None else [(n, tokens[a][1]) for a, n in sorted(found)]

    def steps(self):
        """The pattern as (character, slot, next step) or (None, first choice, second choice)."""
        out, slot = [], 0

        def add(items):
            nonlocal slot
            for (kind, sig, inner), q in items:
                at = len(out)
                if q in "?*":
                    out.append(None)
                start = len(out)
                if kind == "#":
                    out.append(("#", slot, start + 1))
                    slot += 1
                elif kind == "(":
                    add(inner)
                else:
                    out.append((self.symbols["<", sig], None, start + 1))
                    add(inner)
                    out.append((self.symbols[">", sig], None, len(out) + 1))
                if q in "+*":
                    out.append((None, start, len(out) + 1))
                if q in "?*":
                    out[at] = (None, start, len(out))

        add(self.items)
        return out

    def walk(self, page: str) -> list[tuple[int, int]] | None:
        """(place, slot) of the match that backtracking finds first; no step is tried twice at a place."""
        steps, n = self.steps(), len(page) + 1
        tried = bytearray((len(steps) + 1) * n // 8 + 1)
        waiting = [(0, 0, None)]
        while waiting:
            step, at, trail = waiting.pop()
            while True:
                k = step * n + at
                if tried[k >> 3] >> (k & 7) & 1:
                    break
                tried[k >> 3] |= 1 << (k & 7)
                if step == len(steps):
                    if at < len(page):
                        break
                    found = []
                    while trail:
                        trail, *hit = trail
                        found.append(tuple(hit))
                    return found
                char, a, b = steps[step]
                if char is None:
                    waiting.append((b, at, trail))
                    step = a
                elif at < len(page) and page[at] == char:
                    if a is not None:
                        trail = (trail, at, a)
                    step, at = b, at + 1
                else:
                    break
        return None

    def slots(self, tokens) -> list[tuple[int | None, str]] | None:
        """(rank, text) of every text of the page; literals outside an article or main container are apart."""
        found = self.numbered(tokens)
        if found is None:
            return None
        if not self.literals:
            return [(self.ranks[n], t) for n, t in found]
        return [(None if self.ranks[n] == ELSEWHERE and (n, text_key(t)) in self.literals else self.ranks[n], t)
                for n, t in found]


def own_slots(tokens) -> list[tuple[int | None, str]]:
    """The same without a wrapper."""
    path, out = [], []
    for kind, said in tokens:
        if kind == "#":
            out.append((rank(tuple(path)), said))
        elif kind == "<":
            path.append(said)
        else:
            path.pop()
    return out


def main_text(slots) -> str:
    best = min((r for r, _ in slots if r is not None), default=None)
    return "\n".join(t for r, t in slots if r == best and r is not None)


# --- over tables -----------------------------------------------------------------------------

def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long"), "url", "html", host.alias("host"))


def page_shapes(pages: DataFrame) -> DataFrame:
    """host, shape and its number of pages."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [json.dumps(shape(stream(t or "")), separators=(",", ":"))
                     for t in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(found, pa.string())],
                                             names=["host", "shape"])

    return (pages.select("host", "html").mapInArrow(run, "host string, shape string")
            .groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n")))


def aligned(shapes: DataFrame, *by: str) -> DataFrame:
    """One wrapper for the shapes of each group, aligned in order of their number of pages."""

    def run(key_, table):
        import pyarrow as pa

        rows = sorted(zip(table.column("n").to_pylist(), table.column("shape").to_pylist()),
                      key=lambda r: (-r[0], r[1]))
        wrapper = json.loads(rows[0][1])
        for _, other in rows[1:]:
            wrapper = align(wrapper, json.loads(other))
        return pa.table({"host": [key_[0].as_py()], "n": [sum(n for n, _ in rows)],
                         "shape": [json.dumps(wrapper, separators=(",", ":"))]})

    return shapes.groupBy(*by).applyInArrow(run, "host string, n long, shape string")


def dealt(shapes: DataFrame, group: int) -> DataFrame:
    """Shapes with a salt that cuts those of each host into groups of about ``group``."""
    held = shapes.groupBy("host").agg(F.count(F.lit(1)).alias("held"))
    salt = F.pmod(F.xxhash64("shape"), F.ceil(F.col("held") / group))
    return shapes.join(held, "host").select("host", "n", "shape", salt.alias("salt"))


def infer_wrappers(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """host, its number of pages and its wrapper; ``pages`` has host and html."""
    shapes = stored(page_shapes(pages).select("host", "n", "shape"), "shapes")
    while (shapes.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        shapes = stored(aligned(dealt(shapes, group), "host", "salt"), "shapes")
    return shapes


class Wrappers(dict):
    """The wrappers that a task has built."""

    def of(self, *said: str | None) -> Wrapper:
        if said not in self:
            if len(self) > 500:
                self.clear()
            self[said] = Wrapper(*(x and json.loads(x) for x in said))
        return self[said]


def met(a, b):
    """Literals, whether other texts were seen, and some pages' keys, of two parts of a slot's pages."""
    return [a[0] & b[0], a[1] or b[1] or a[0] != b[0], set(sorted(a[2] | b[2])[:LEAST_PAGES])]


SLOTS = "host string, slot int, texts array<long>, varies boolean, pages array<long>"


def learn_slots(pages: DataFrame) -> DataFrame:
    """host and, as JSON, its wrapper's literals and varying slots; ``pages`` has its wrapper as ``shape``.

    A literal is in the slot's texts on all pages: what meets of them, so parts meet in any order.
    """

    def run(batches):
        import pyarrow as pa

        known, seen = Wrappers(), {}

        def rows():
            cols = zip(*((h, n, list(t), v, list(p)) for (h, n), (t, v, p) in seen.items()))
            types = (pa.string(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              names=["host", "slot", "texts", "varies", "pages"])

        for b in batches:
            for host, html, wrapper in zip(*(b.column(c).to_pylist() for c in ("host", "html", "shape"))):
                texts: dict[int, set[int]] = {}
                for n, t in known.of(wrapper).numbered(stream(html or "")) or []:
                    texts.setdefault(n, set()).add(text_key(t))
                page = {text_key(html or "")}
                for n, own in texts.items():
                    new = [own, False, page]
                    seen[host, n] = met(seen[host, n], new) if (host, n) in seen else new
            if len(seen) > HELD:
                yield rows()
                seen.clear()
        if seen:
            yield rows()

    def meet(key_, table):
        import pyarrow as pa

        slots = {}
        for r in table.to_pylist():
            new = [set(r["texts"]), r["varies"], set(r["pages"])]
            slots[r["slot"]] = met(slots[r["slot"]], new) if r["slot"] in slots else new
        sure = {n: x for n, x in sorted(slots.items()) if len(x[2]) == LEAST_PAGES}
        learned = [[[n, sorted(x[0])] for n, x in sure.items() if x[0]], [n for n, x in sure.items() if x[1]]]
        return pa.table({"host": [key_[0].as_py()], "learned": [json.dumps(learned)]})

    return pages.mapInArrow(run, SLOTS).groupBy("host").applyInArrow(meet, "host string, learned string")


def with_table(pages: DataFrame, table: DataFrame, text: str, how: str) -> DataFrame:
    """``pages`` joined to a table of one row for each host.

    A table whose texts take at most BROADCAST_BYTES goes to all tasks, and
    no html is shuffled; a larger one is joined by host.
    """
    size = table.agg(F.sum(F.octet_length("host") + F.octet_length(text))).first()[0] or 0
    return pages.join(F.broadcast(table) if size <= BROADCAST_BYTES else table, "host", how)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, main text, its length and whether the host's wrapper fits, of every page."""
    pages = with_host(pages)
    wrappers = infer_wrappers(pages).select("host", "shape")
    wrapped = with_table(pages, wrappers, "shape", "inner").select("page_id", "url", "html", "host", "shape")
    learned = stored(learn_slots(wrapped), "literals")

    def run(batches):
        import pyarrow as pa

        known = Wrappers()
        for b in batches:
            texts, wrapped = [], []
            for html, *said in zip(*(b.column(c).to_pylist() for c in ("html", "shape", "learned"))):
                tokens = stream(html or "")
                slots = known.of(*said).slots(tokens)
                wrapped.append(slots is not None)
                texts.append(main_text(own_slots(tokens) if slots is None else slots))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64()), pa.array(wrapped, pa.bool_())],
                names=["page_id", "url", "text", "n_chars", "wrapped"])

    return (with_table(wrapped, learned, "learned", "left").select("page_id", "url", "html", "shape", "learned")
            .mapInArrow(run, EXTRACTED))
