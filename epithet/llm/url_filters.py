"""URL filters: pattern rules indexed by their rarest literal token.

A URL's tokens fetch the few rules filed under them, and only those run their regular expressions.
Rules are written in the common filter-list form: ``||host/path`` is anchored at a host or one of
its subdomains, ``*`` stands for anything, ``^`` for a separator or the end.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epithet.llm.common import Shared

# Bound of the rule list that goes to every task, in characters of its patterns.
MAX_RULE_CHARS = 32_000_000
TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``action`` is allow or block.  ``host_rule`` rules go before the other patterns."""

    pattern: str
    action: str = "block"
    host_rule: bool = False

    @classmethod
    def host(cls, host_path: str, action: str) -> Rule:
        """The host of ``host/path`` with all subdomains, for paths that start with its path."""
        return cls("||" + host_path, action, host_rule=True)

    @property
    def name(self) -> str:
        return self.pattern.removeprefix("||")

    def literals(self) -> list[str]:
        """Tokens that every matching URL has in full: runs with a literal boundary on both sides."""
        body = self.pattern.lower()
        if body.startswith("||"):
            body = "^" + body[2:]
        return re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", body)

    def regex(self) -> re.Pattern[str]:
        """Over the lower-cased host followed by the path."""
        body, head = self.pattern, ""
        if body.startswith("||"):
            body, head = body[2:], r"^(?:[^/]*\.)?"
        parts = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}
        return re.compile(head + "".join(parts.get(c, re.escape(c)) for c in body), re.S)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


class RuleIndex:
    """Rules by their rarest literal token; rules without one are tried on every URL."""

    def __init__(self, rules: Sequence[Rule], frequency: dict[str, int]):
        self.by_token: dict[str, list[tuple[re.Pattern[str], Rule]]] = defaultdict(list)
        self.everywhere: list[tuple[re.Pattern[str], Rule]] = []
        for rule in rules:
            tokens = rule.literals()
            entry = (rule.regex(), rule)
            if tokens:
                self.by_token[min(tokens, key=lambda t: (frequency.get(t, 0), t))].append(entry)
            else:
                self.everywhere.append(entry)

    def candidates(self, text: str) -> Iterator[tuple[re.Pattern[str], Rule]]:
        yield from self.everywhere
        for token in dict.fromkeys(TOKEN.findall(ascii_lower(text))):
            yield from self.by_token.get(token, ())

    def judge(self, host: str, path: str) -> tuple[str | None, str | None, str]:
        """(host rule, pattern, verdict): the longest host rule decides, then the longest pattern."""
        text = host + path
        hits = [rule for regex, rule in self.candidates(text) if regex.search(text)] if host else []
        order = lambda rule: (len(rule.name), rule.name)
        hosts = max((r for r in hits if r.host_rule), key=order, default=None)
        other = max((r for r in hits if not r.host_rule), key=order, default=None)
        decides = hosts or other
        return (
            hosts.name if hosts else None,
            other.pattern if other else None,
            decides.action if decides else "allow",
        )


def token_frequency(urls: DataFrame, rules: Sequence[Rule], col: str = "url") -> dict[str, int]:
    """How many URLs hold each literal token of the rules, over all URLs.

    The result has at most one row for each token of the rule list.
    """
    wanted = sorted({t for rule in rules for t in rule.literals()})
    if not wanted:
        return {}
    spark = urls.sparkSession
    names = spark.createDataFrame([(t,) for t in wanted], "token string")
    tokens = urls.select(
        F.explode(F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit("([a-z0-9]+)")))).alias("token")
    )
    counts = tokens.groupBy("token").count().join(names, "token", "left_semi")
    return {r["token"]: r["count"] for r in counts.collect()}


def filter_urls(
    pages: DataFrame, rules: Iterable[Rule], id_col: str = "page_id", col: str = "url"
) -> DataFrame:
    """(id, host, path, rule, verdict, pattern) for every row; rows are neither joined nor shuffled.

    A null URL, one without ``://`` or one with an empty host meets no rule and is allowed.  Among
    rules of one kind that match, the longest wins, ties by code point.  Other columns are ignored,
    whatever their names; repeated rows are judged alike.  The rule list is a parameter and goes to
    every task, so its size is checked.
    """
    rules = list(rules)
    if sum(len(r.pattern) for r in rules) > MAX_RULE_CHARS:
        raise ValueError(f"the patterns have over {MAX_RULE_CHARS} characters; split the rule list")
    index = Shared(pages.sparkSession, RuleIndex(rules, token_frequency(pages, rules, col)))
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["host", "path", "rule", "verdict", "pattern"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = index.value
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, pattern, verdict = judged.judge(host, path)
                rows.append((host, path, rule, verdict, pattern))
            columns = [pa.array([r[i] for r in rows], pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *names])

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} string" for n in names)
    return pages.select(id_col, col).mapInArrow(judge, schema)


# The rules of the registered query, and patterns of advertising and spam sites.
PAGE_RULES = (
    Rule.host("com/", "allow"),
    Rule.host("example.com/en/", "block"),
    Rule.host("www.example.com/en/", "allow"),
    Rule.host("net/es/", "block"),
    Rule.host("net/fr/", "block"),
    Rule("||adult-", "block"),
    Rule("||ads-track.", "block"),
    Rule("||casino-", "block"),
    Rule("||cheap-pills.", "block"),
    Rule("||free-bets.", "block"),
    Rule("||spam-farm.", "block"),
)


def judge_pages(pages: DataFrame) -> DataFrame:
    """The verdict on every page; see ``filter_urls`` for null and odd URLs.  Repeated rows are judged
    alike, and an empty table gives no rows."""
    return filter_urls(pages, PAGE_RULES)
