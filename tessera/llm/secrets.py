"""Secret scan: keyword automaton, anchored patterns near hits, checksums.

Every whole text is scanned once by an Aho-Corasick automaton of the
keywords; a pattern is matched only at the place of a keyword hit.  Runs
of hexadecimal digits have no keyword: they are found by their alphabet.
Token kinds that carry a checksum are kept only when it holds.

Edge cases: a null or empty text has no spans (counts 0, the digest of the
empty string); a null doc_id stays null; repeated rows are judged each on
its own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release_memory

BASE_KINDS = ("assign", "access", "hex")
CHECKED_KINDS = ("github", "npm")
KINDS = BASE_KINDS + CHECKED_KINDS

# The patterns of the base kinds and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
# Prefixed tokens of 30 random characters and 6 of checksum.
GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign",
    "apikey": "assign", "api_key": "assign", "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM}

SCAN_SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
               "spans string")


def base62(number: int, width: int) -> str:
    out = ""
    while number:
        number, r = divmod(number, 62)
        out = BASE62[r] + out
    return out.rjust(width, "0")


def checksum_ok(token: str) -> bool:
    """The last 6 characters are the base-62 CRC-32 of the 30 before them."""
    body = token[token.index("_") + 1:]
    return base62(zlib.crc32(body[:-6].encode()), 6) == body[-6:]


def accept(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m.group(2)) >= ASSIGN_LEAST
    if kind == "access":
        return m.end() - m.start() >= ACCESS_LEAST
    return checksum_ok(m.group())


def keyword_automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        auto.add_word(word, (len(word), kind))
    auto.make_automaton()
    return auto


def keyword_text(text: str) -> str:
    """Lower-cased copy with the same positions (it only has to contain every hit)."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate({c: c + 32 for c in range(65, 91)})


def find_spans(text: str, auto) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every secret, by start, then kind."""
    found = []
    ended = dict.fromkeys(PATTERNS, 0)
    # hits arrive by their end; a pattern must see its own by their start
    hits = sorted((end - n + 1, kind) for end, (n, kind) in auto.iter(keyword_text(text)))
    for start, kind in hits:
        if start < ended[kind]:
            continue
        if m := PATTERNS[kind].match(text, start):
            ended[kind] = m.end()
            if accept(kind, m):
                found.append((start, KINDS.index(kind), m.end()))
    found += [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def spans_text(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def masked(text: str, found) -> str:
    """The text with every secret (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    for a, k, b in found:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, digest of the base spans, and all spans, per document."""

    def scan(batches):
        auto = keyword_automaton()
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                found = find_spans(text, auto) if text else []
                kinds = [k for _, k, _ in found]
                base = spans_text(x for x in found if x[1] < len(BASE_KINDS))
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2),
                             hashlib.sha256(base.encode()).hexdigest(), spans_text(found)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]),
                 *(pa.array(c, pa.string()) for c in cols[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, SCAN_SCHEMA)


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The documents with their secrets masked and ``n_chars`` renewed where the text changed.

    A null text stays null; repeated rows stay; an empty table stays empty.
    """

    @F.arrow_udf("string")
    def mask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        auto = keyword_automaton()
        for texts in batches:
            yield pa.array([masked(t, f) if (t := x.as_py()) and (f := find_spans(t, auto)) else t
                            for x in texts], pa.string())
            release_memory()

    new = docs.withColumn("_masked", mask("text"))
    changed = ~F.col("_masked").eqNullSafe(F.col("text"))
    keep = {"text": F.col("_masked")}
    if "n_chars" in docs.columns:
        keep["n_chars"] = F.when(changed, F.length("_masked")).otherwise(F.col("n_chars")) \
            .cast(docs.schema["n_chars"].dataType)
    return new.select(*(keep[c].alias(c) if c in keep else F.col(c) for c in docs.columns))
