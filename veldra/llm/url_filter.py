"""URL filters (operator 5).

A rule is a pattern with its action.  It is indexed once, under the rarest of its literal tokens (counts of the
rules' tokens over all URLs; a rule without a whole token goes to a list of its own).  A URL's tokens fetch
candidate rules, and only those run their regular expressions.  Host rules (a host with its subdomains and a path
prefix) decide by the longest match; where none fits, pattern rules give the verdict: allow patterns first, then
block patterns, else allow.

Cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is allowed; repeated rows and
null ids are judged row by row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[A-Za-z0-9]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains if the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def tokens(self) -> list[str]:
        """Tokens that any fitting URL holds whole: the path's last one may go on in the URL."""
        whole = [t.lower() for t in _TOKEN.findall(self.host)]
        path = _TOKEN.findall(self.path)
        return whole + [t.lower() for t in (path if not self.path[-1:].isalnum() else path[:-1])]

    @property
    def regex(self) -> str:
        return rf"(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"


@dataclass(frozen=True)
class PatternRule:
    """``*`` stands for any characters and ``^`` for a character that is no letter or digit, or the end; matches
    anywhere in the URL, without regard to the case of ASCII letters."""

    action: str
    pattern: str

    @property
    def tokens(self) -> list[str]:
        return [m[0].lower() for m in _TOKEN.finditer(self.pattern) if self.pattern[m.start() - 1 : m.start()] not in ("", "*") and self.pattern[m.end() : m.end() + 1] not in ("", "*")]

    @property
    def regex(self) -> str:
        return "".join({"*": ".*", "^": "(?:[^A-Za-z0-9]|$)"}.get(c, re.escape(c)) for c in self.pattern)


#: The rules of the op5 query, and the pattern rules that judge what they leave open.
HOST_RULES = (
    HostRule("allow", "org", "/"), HostRule("block", "example.org", "/es/"), HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"), HostRule("block", "com", "/de/"),
)
PATTERN_RULES = (
    PatternRule("allow", "^robots.txt^"), PatternRule("block", "/ads/"), PatternRule("block", "^adserver^"), PatternRule("block", "/banner/*/click^"),
    PatternRule("block", "^casino^"), PatternRule("block", "^sessionid="), PatternRule("block", "/cgi-bin/"), PatternRule("block", "^login^"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path)."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:end].translate(_UPPER), rest[end:]
    return host, re.split(r"[?#]", tail, maxsplit=1)[0]


class RuleIndex:
    """Rules under their rarest token."""

    def __init__(self, rules, counts: dict[str, int]):
        self.by_token: dict[str, list] = {}
        self.rest = []
        for number, rule in enumerate(rules):
            entry = (number, rule, re.compile(rule.regex, re.IGNORECASE | re.ASCII | re.DOTALL if isinstance(rule, PatternRule) else 0))
            tokens = sorted(set(rule.tokens), key=lambda t: (counts.get(t, 0), t))
            (self.by_token.setdefault(tokens[0], []) if tokens else self.rest).append(entry)

    def candidates(self, tokens: set[str]):
        for token in tokens & self.by_token.keys():
            yield from self.by_token[token]
        yield from self.rest


def url_tokens(url: str) -> set[str]:
    return {t.lower() for t in _TOKEN.findall(url)}


def judge(url: str | None, hosts: RuleIndex, patterns: RuleIndex) -> tuple[str, str, str | None, str]:
    """(host, path, rule, verdict)."""
    host, path = split_url(url)
    if not host and not path:
        return host, path, None, "allow"
    tokens = url_tokens(url or "")
    fits = [(len(rule.name), rule.name, rule) for _, rule, regex in hosts.candidates(tokens) if regex.match(host + path if path else host) and path.startswith(rule.path) and (host == rule.host or host.endswith("." + rule.host))]
    if fits:
        rule = max(fits, key=lambda f: f[:2])[2]
        return host, path, rule.name, rule.action
    hit = [(n, rule.action) for n, rule, regex in patterns.candidates(tokens) if regex.search(url or "")]
    return host, path, None, min(hit, key=lambda h: (h[1] != "allow", h[0]))[1] if hit else "allow"


def token_counts(pages: DataFrame, wanted: frozenset[str], url_col: str = "url") -> dict[str, int]:
    """URLs that hold each of the rules' tokens: as many rows as the rules have tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(t for url in batch.column(0).to_pylist() if url for t in url_tokens(url) & wanted)
            yield pa.RecordBatch.from_pydict({"token": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    rows = pages.select(F.col(url_col).cast("string").alias("url")).mapInArrow(run, "token string, n long")
    return {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def filter_urls(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The op5 query: (page_id, host, path, rule, verdict)."""
    counts = token_counts(pages, frozenset(t for r in (*host_rules, *pattern_rules) for t in r.tokens), url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, patterns = RuleIndex(host_rules, counts), RuleIndex(pattern_rules, counts)
        for batch in batches:
            if batch.num_rows:
                found = list(zip(*(judge(u, hosts, patterns) for u in batch.column(1).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in found)], ["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), r(rhost, rpath, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), f AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT h.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, f.rule,
  coalesce(f.action, CASE WHEN host = '' AND path = '' OR url IS NULL OR regexp_matches(url, '(?i)[^a-z0-9]robots\.txt([^a-z0-9]|$)') THEN 'allow'
    WHEN regexp_matches(url, '(?i)/ads/|[^a-z0-9]adserver([^a-z0-9]|$)|/banner/.*/click([^a-z0-9]|$)|[^a-z0-9]casino([^a-z0-9]|$)|[^a-z0-9]sessionid=|/cgi-bin/|[^a-z0-9]login([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN f ON f.page_id = h.page_id
"""
