"""URL filters: rules indexed by their rarest literal token.

A rule is a host with a path prefix, or a host pattern.  Every rule is
compiled to one regular expression over ``host + path`` and filed under
the rarest of the literal tokens that any match must hold as a whole
token; rarity is counted over the tokens of all given URLs.  A URL's
tokens fetch the candidate rules, and only those run their expression.

Edge cases: a null URL, or one without ``://``, has empty host and path
and no fitting rule; a null page_id stays null; a URL of any length is read
whole; repeated rows are judged each on its own; of fitting rules the
longest wins (ties: the smaller text); an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[A-Za-z0-9]+")
URL = re.compile(r".*?://([^/?#]*)([^?#]*)", re.DOTALL)
MAX_RULES = 200_000  # rules travel to every task; more must be given in several calls


@dataclass(frozen=True)
class Rule:
    """``text`` is ``host/path`` (``net/es/``), or with ``*`` a host pattern (``*.ads.*``)."""

    text: str
    verdict: str

    @property
    def is_pattern(self) -> bool:
        return "*" in self.text

    def regex(self) -> str:
        if self.is_pattern:
            body = "[^/]*".join(re.escape(x) for x in self.text.split("*"))
            return rf"^(?:{body})(?=/|$)"
        return rf"^(?:[^/]*\.)?{re.escape(self.text)}"

    def tokens(self) -> list[str]:
        """Literal tokens that every match holds between token borders."""
        t, out = self.text, []
        for m in TOKEN.finditer(t):
            left_open = m.start() > 0 and t[m.start() - 1] == "*"
            right_open = m.end() < len(t) and t[m.end()] == "*" or \
                m.end() == len(t) and not self.is_pattern
            if not left_open and not right_open:
                out.append(m.group())
        return out


# The rules of the query, in their given order.
QUERY_RULES = [
    Rule("com/", "allow"), Rule("example.com/en/", "block"), Rule("www.example.com/en/", "allow"),
    Rule("net/es/", "block"), Rule("net/fr/", "block"),
]
# Default block patterns, a parameter of ``judge_urls``: hosts in which one of these words of advertising,
# gambling, adult, pharmacy and fraud sites stands between dots or hyphens.
SPAM_WORDS = """ad ads adserver adservice adtrack affiliate banner banners popunder popup tracker
    bet bets betting bingo casino casinos gambling jackpot lottery poker roulette slots
    adult cams escort escorts porn sex xxx cialis pharma pills viagra
    crack keygen malware payday phishing scam spam warez""".split()


def word_patterns(words, verdict: str = "block") -> list[Rule]:
    """Host patterns in which each word is a whole part of a host's label."""
    return [Rule(f"{left}{w}{right}", verdict) for w in words for left in ("", "*.", "*-") for right in (".*", "-*")]


SPAM_RULES = word_patterns(SPAM_WORDS)

JUDGE_SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def split_url(url: str | None) -> tuple[str, str]:
    m = URL.match(url or "")
    if not m:
        return "", ""
    return m.group(1).translate({c: c + 32 for c in range(65, 91)}), m.group(2)


def token_counts(urls: DataFrame, wanted: list[str]) -> dict[str, int]:
    """In how many of all URLs each of the rules' own tokens occurs (as many rows as the rules have tokens)."""
    if not wanted:
        return {}
    own = F.broadcast(urls.sparkSession.createDataFrame([(w,) for w in wanted], "token string"))  # bounded by MAX_RULES
    key = F.regexp_replace(F.lower("url"), "[^a-z0-9]+", " ")
    rows = (urls.select(F.explode(F.array_distinct(F.split(key, " "))).alias("token"))
            .join(own, "token").groupBy("token").count().collect())
    return {r["token"]: r["count"] for r in rows}


def build_index(rules: list[Rule], counts: dict[str, int]):
    """token -> numbers of the rules filed under it; the rules without a safe token apart."""
    index: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        if tokens := rule.tokens():
            best = min(tokens, key=lambda t: (counts.get(t.lower(), 0), -len(t), t))
            index.setdefault(best, []).append(i)
        else:
            always.append(i)
    return index, always


class Expressions(dict):
    """The rules' expressions, compiled when first fetched."""

    def __init__(self, rules: list[Rule]):
        super().__init__()
        self.rules = rules

    def __missing__(self, i: int):
        found = self[i] = re.compile(self.rules[i].regex())
        return found


def judge_urls(pages: DataFrame, rules: list[Rule], patterns: list[Rule] | None = None,
               default: str = "allow") -> DataFrame:
    """page_id, host, path, fitting rule, verdict (the rule's, else the patterns', else default)."""
    patterns = SPAM_RULES if patterns is None else patterns
    if len(rules) + len(patterns) > MAX_RULES:
        raise ValueError(f"{len(rules) + len(patterns)} rules; at most {MAX_RULES} in one call")
    every = [*rules, *patterns]
    pages = pages.select("page_id", "url")
    wanted = sorted({t.lower() for r in every for t in r.tokens()})
    index, always = build_index(every, token_counts(pages, wanted))
    n_rules = len(rules)

    def judge(batches):
        import pyarrow as pa

        compiled = Expressions(every)
        for b in batches:
            rows = []
            for url in b.column("url").to_pylist():
                host, path = split_url(url)
                key = host + path
                numbers = {i for t in set(TOKEN.findall(key)) for i in index.get(t, ())}
                numbers.update(always)
                fits = [i for i in numbers if key and compiled[i].match(key)]
                own = [every[i] for i in fits if i < n_rules]
                rule = min(own, key=lambda r: (-len(r.text), r.text), default=None)
                if rule:
                    verdict = rule.verdict
                else:
                    other = min((every[i] for i in fits if i >= n_rules),
                                key=lambda r: (-len(r.text), r.text), default=None)
                    verdict = other.verdict if other else default
                rows.append((host, path, rule and rule.text, verdict))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id").cast(pa.int64()), *(pa.array(c, pa.string()) for c in cols)],
                names=["page_id", "host", "path", "rule", "verdict"])

    return pages.mapInArrow(judge, JUDGE_SCHEMA)
