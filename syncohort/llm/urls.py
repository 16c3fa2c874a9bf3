"""URL filters: rules found through their rarest literal token.

A rule is a pattern on host and path together with literal tokens `[a-z0-9]+` that any
matching URL must hold as whole tokens. Of its tokens the one with the fewest URLs in
the corpus becomes its index entry. URLs are taken apart into tokens, tokens fetch
rules, and only a fetched rule's pattern is run. Rules without a literal token are
run on every URL.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed rules on hosts and paths; the longest that fits wins.
SITE_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: First parts of host names that the pattern rules block.
BLOCKED_NAMES = (
    "ads", "adult", "casino", "cheap", "free-bets", "malware", "phishing", "porn", "spam", "warez"
)


@dataclass(frozen=True)
class Rule:
    """`rank` orders rules that match one URL; `name` is null for a method's own rule."""

    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    name: str | None = None


def site_rule(verdict: str, name: str) -> Rule:
    """A host with its subdomains and a path's beginning, as `example.com/en/`."""
    host, slash, path = name.partition("/")
    text = host.lower() + slash + path
    tokens = re.findall("[a-z0-9]+", host.lower()) + re.findall("[a-z0-9]+(?=/)", path.lower())
    return Rule(verdict, rf"^([^/]*\.)?{re.escape(text)}", tuple(tokens), 1000 + len(name), name)


def name_rule(verdict: str, word: str) -> Rule:
    """A host with a label `word` or one that begins with `word-`."""
    return Rule(verdict, rf"^([^/]*\.)?{re.escape(word)}[.-]", tuple(word.split("-")), 0)


RULES = (
    *(site_rule(*r) for r in SITE_RULES),
    *(name_rule("block", w) for w in BLOCKED_NAMES),
)


def host_of(url: Column) -> Column:
    """Between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")


def tokens_of(host: Column, path: Column) -> Column:
    text = F.translate(F.concat(host, path), _UPPER, _LOWER)
    return F.array_distinct(F.filter(F.split(text, "[^a-z0-9]+"), lambda t: t != ""))


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of `pages` (page_id, url, ...).

    Of the rules that match, the one with the highest rank decides (then block before
    allow, then the lower name); where none does, `default`. rule is the deciding rule's
    name, null for unnamed rules and defaults. A null url and one without `://` have an
    empty host and path and get the default. Rows that repeat a page_id or url, or have a
    null page_id, are judged one by one. Other columns are ignored.
    """
    spark = pages.sparkSession
    parts = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    places = parts.select("host", "path").distinct()
    table = spark.createDataFrame(
        [(k, r.verdict, r.pattern, list(r.tokens), r.rank, r.name) for k, r in enumerate(rules)],
        "rule_no int, verdict string, pattern string, tokens array<string>, rank int, rule string",
    )
    literal = table.select("rule_no", F.explode("tokens").alias("token"))
    taken = places.select("host", "path", F.explode(tokens_of(F.col("host"), F.col("path"))).alias("token"))
    # Counts of the rules' own tokens only; a token that no URL has is the rarest.
    seen = taken.join(literal.select("token").distinct(), "token").groupBy("token").count()
    index = (
        literal.join(seen, "token", "left")
        .groupBy("rule_no")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    fetched = taken.join(index, "token").select("host", "path", "rule_no")
    if bare := [F.lit(k) for k, r in enumerate(rules) if not r.tokens]:
        fetched = fetched.union(places.select("host", "path", F.explode(F.array(*bare))))
    fetched = fetched.join(table.drop("tokens"), "rule_no")
    matched = fetched.where("concat(host, path) rlike pattern")
    best = matched.groupBy("host", "path").agg(
        F.max(
            F.struct("rank", (F.col("verdict") == "block").alias("_block"), (-F.col("rule_no")).alias("_no"), "rule", "verdict")
        ).alias("best")
    )
    return parts.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
