"""URL filters (operator 3): pattern rules indexed by their rarest literal token.

A URL's host and path are cut into tokens (runs of a-z, 0-9). A rule is filed under the rarest of the tokens that any
URL fitting it must contain, so a URL's tokens fetch the few candidates, and only their regular expressions run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsumugi.llm.common import giving_way, unused

TOKEN = r"[a-z0-9]+"


class Rule(NamedTuple):
    """name: as reported (null for a plain pattern). pattern: run with search() over host + path. tokens: all in any URL that fits."""

    name: str | None
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    length: int = 0


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host, its subdomains, and the paths that start with path."""
    # a path may end within a token of the URL, so only tokens that end before its last character are sure
    whole = re.findall(TOKEN, host) + re.findall(TOKEN + r"(?=[^a-z0-9])", path)
    return Rule(host + path, rf"\A(?:[^/]*\.)?{re.escape(host)}(?=/|\Z){re.escape(path)}", verdict, tuple(dict.fromkeys(whole)), len(host + path))


def pattern_rule(pattern: str, verdict: str, *tokens: str) -> Rule:
    return Rule(None, pattern, verdict, tokens)


def filter_rule(text: str, verdict: str) -> Rule:
    """A rule from a filter's text: * stands for any characters, ^ for a separator (none of a-z, 0-9, % . _ -) or the end, || in
    front for the begin of a host or subdomain, | in front or behind for the begin or end. It fits anywhere in host + path.

    Tokens are the text's runs of a-z and 0-9 that can't go on in the URL: another character or an anchor is on either side.
    """
    own = text.translate(LOWER)
    head = r"\A(?:[^/]*\.)?" if own.startswith("||") else r"\A" if own.startswith("|") else ""
    tail = r"\Z" if own.endswith("|") and own.strip("|") else ""
    body = own.strip("|")
    pattern = "".join(".*" if c == "*" else r"(?:[^a-z0-9%._-]|\Z)" if c == "^" else re.escape(c) for c in body)
    marked = ("/" if head else "*") + body + ("/" if tail else "*")
    return Rule(None, head + pattern + tail, verdict, tuple(dict.fromkeys(re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", marked))))


def read_rules(rules: DataFrame) -> tuple[Rule, ...]:
    """Rules from a table of host, path, pattern and verdict: a site rule where host isn't null, else a filter's text in pattern.

    A table of rules is configuration: it comes to the driver and each executor holds all of it. Rows without a verdict, or
    without host and pattern, are ignored; of equal rows one counts; their order doesn't matter.
    """
    out = set()
    for r in rules.select("host", "path", "pattern", "verdict").distinct().collect():
        if r["verdict"] is not None and (r["host"] is not None or r["pattern"]):
            out.add(site_rule(r["host"], r["path"] or "", r["verdict"]) if r["host"] is not None else filter_rule(r["pattern"], r["verdict"]))
    return tuple(sorted(out, key=lambda r: (r.name or "", r.pattern, r.verdict)))


#: Site rules: the longest that fits decides.
SITE_RULES = (
    site_rule("com", "/", "allow"),
    site_rule("example.com", "/en/", "block"),
    site_rule("www.example.com", "/en/", "allow"),
    site_rule("net", "/es/", "block"),
    site_rule("net", "/fr/", "block"),
)
#: Patterns for URLs that no site rule fits: a block pattern that fits decides, else the URL is allowed.
PATTERN_RULES = tuple(
    pattern_rule(rf"(?:\A|[.-]){a}[-_]{b}(?=[.-]|/|\Z)", "block", a)
    for a, b in (
        ("spam", r"farm[0-9]*"), ("link", r"farm[0-9]*"), ("cheap", "pills?"), ("online", "(?:casino|pharmacy|poker)"),
        ("free", "(?:porn|xxx|sex)"), ("adult", "(?:cams?|chat|videos?)"), ("payday", "loans?"), ("click", "bait"),
    )
) + tuple(  # the same without a separator are one token, which ends in any number for farms: no token is sure then
    pattern_rule(rf"(?:\A|[.-]){joined}(?=[.-]|/|\Z)", "block", joined)
    for joined in ("cheappill", "cheappills", "onlinecasino", "onlinepharmacy", "onlinepoker", "freeporn", "freexxx", "freesex", "adultcam", "adultcams", "adultchat", "adultvideo", "adultvideos", "paydayloan", "paydayloans", "clickbait")
) + (pattern_rule(r"(?:\A|[.-])(?:spam|link)farm[0-9]*(?=[.-]|/|\Z)", "block"),) + tuple(pattern_rule(rf"(?:\A|[./-]){word}(?=[./-]|\Z)", "block", word) for word in ("porn", "xxx", "casino", "viagra", "warez", "malware", "phishing", "doubleclick")) + tuple(pattern_rule(rf"\A(?:[^/]*[.-])?{word}(?=[.-]|/|\Z)", "block", word) for word in ("adult", "ads", "adserver", "bets", "betting", "spam", "tracker"))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    found = re.match(r"([^/?#]*)([^?#]*)", rest, re.DOTALL)
    return found[1].translate(LOWER), found[2]


LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}


class Index:
    """Rules by their rarest token. counts: how many URLs have each token (absent: none)."""

    def __init__(self, rules: tuple[Rule, ...], counts: dict[str, int]):
        self.by_token: dict[str | None, list[tuple[Rule, re.Pattern]]] = {}
        for r in rules:
            rarest = min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None)
            self.by_token.setdefault(rarest, []).append((r, re.compile(r.pattern, re.DOTALL)))
        self.find = re.compile(TOKEN).findall

    def judge(self, url: str | None) -> tuple[str, str, str | None, str]:
        """Host, path, the name of the site rule that decides (else None) and the verdict."""
        host, path = split_url(url)
        full, best, blocked = host + path, None, False
        for token in {None, *self.find(full.translate(LOWER))}:
            for r, pattern in self.by_token.get(token, ()):
                if r.name is None:
                    blocked = blocked or r.verdict == "block" and bool(pattern.search(full.translate(LOWER)))
                elif (best is None or (r.length, r.verdict) > (best.length, best.verdict)) and pattern.search(full):
                    best = r
        return host, path, best and best.name, best.verdict if best else "block" if blocked else "allow"


def token_counts(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> dict[str, int]:
    """In how many URLs each of the rules' own tokens occurs: as many rows as the rules have tokens, at most."""
    own = sorted({t for r in rules for t in r.tokens})
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(url), F.lit(TOKEN), F.lit(0)))
    found = pages.select(F.explode(F.array_intersect(tokens, F.lit(own))).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in found.collect()}


def filter_urls(pages: DataFrame, keys: list[str], url: str = "url", sites: tuple[Rule, ...] = SITE_RULES, patterns: tuple[Rule, ...] = PATTERN_RULES) -> DataFrame:
    """keys, host, path, rule and verdict (allow or block) of each row of pages.

    The longest site rule that fits decides (of equal ones one that blocks); where none fits, a pattern that blocks; else the URL is allowed.
    sites and patterns may come from a table (read_rules). A URL that is
    null, empty or without :// has an empty host and path, no rule, and is allowed. Repeated rows give repeated results;
    only the keys and the URLs are read; a key named like a result gives way. No shuffle but for the token counts.
    """
    keys = giving_way(keys, ["host", "path", "rule", "verdict"])
    rules = (*sites, *patterns)
    counts = token_counts(pages, rules, url)
    one = pages.select(*[pages[k].alias(k) for k in keys], pages[url].alias(unused("_url", keys)))
    schema = T.StructType([*one.schema.fields[:-1], *[T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]])
    names = [f.name for f in schema.fields]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules, counts)
        for batch in batches:
            found = [index.judge(u) for u in batch.column(batch.num_columns - 1).to_pylist()]
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, pa.string()) for c in columns]], names=names)

    return one.mapInArrow(kernel, schema)
