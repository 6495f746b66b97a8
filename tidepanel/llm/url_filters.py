"""URL filters: pattern rules, found through an index on each rule's rarest literal token.

A URL's tokens fetch the rules that could fit it, and only those run their regular expression. Everything on the
main path is DataFrame functions.

Defined results: a null URL, or one without ``://``, has empty host and path and runs no site rule; an empty table
gives an empty table; repeated rows are each judged; a URL of any length is judged whole; of site rules that fit, the
longest wins, so there are no ties, and of patterns the first in the list; other columns of the input are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side

#: Up to so many rules the index is a constant inside the projection; beyond, a joined table.
INLINE_RULES = 256
#: Up to so many index rows the joined table is broadcast.
BROADCAST_RULES = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """One compiled rule. ``site`` rules fit ``host + path``, the others the whole lower-cased URL."""

    text: str
    verdict: str
    site: bool
    regex: str
    tokens: tuple[str, ...]
    rank: int

    def key(self) -> tuple:
        return (0 if self.site else 1, -self.rank, self.text)


def site_rule(text: str, verdict: str) -> Rule:
    """``host/path``: fits the host and all its subdomains where the URL's path starts with the rule's path."""
    host, slash, path = text.partition("/")
    literal = host + slash + path
    regex = r"^(?:[^/?#]*\.)?" + re.escape(literal)
    # the last token of the path may go on in the URL ("/en" fits "/english"), so it can't be looked up
    tokens = re.findall(r"[a-z0-9]+(?![a-z0-9]*$)", literal.lower()) if literal[-1:].isalnum() else re.findall(r"[a-z0-9]+", literal.lower())
    return Rule(text, verdict, True, regex, tuple(dict.fromkeys(tokens)), len(text))


def pattern_rule(pattern: str, verdict: str) -> Rule:
    """``||`` stands for the start of a host or of one of its labels, ``^`` for a separator or the end, ``*`` for anything."""
    body, regex = pattern.lower(), ""
    if body.startswith("||"):
        body, regex = body[2:], r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"
        start = True
    else:
        start = False
    for part in re.findall(r"\*|\^|[^*^]+", body):
        regex += {"*": r"[\s\S]*", "^": r"(?:[^a-z0-9_.%-]|\z)"}.get(part) or re.escape(part)
    tokens = [
        m.group()
        for m in re.finditer(r"[a-z0-9]+", body)
        if (m.start() > 0 or start) and m.end() < len(body) and body[m.start() - 1 : m.start()] != "*" and body[m.end()] != "*"
    ]
    return Rule(pattern, verdict, False, regex, tuple(dict.fromkeys(tokens)), 1_000_000 * (verdict == "allow") + len(pattern))


def read_rules(lines: Iterable[str]) -> list[Rule]:
    """The rules of a list, a line each: a pattern, or ``site:`` and a host with the start of a path; ``@@`` before either allows instead of blocking.
    Empty lines and those that begin with ``!`` or ``#`` are skipped."""
    rules = []
    for line in map(str.strip, lines):
        if not line or line[0] in "!#":
            continue
        verdict = "allow" if line.startswith("@@") else "block"
        body = line.removeprefix("@@")
        rules.append(site_rule(body.removeprefix("site:").strip(), verdict) if body.startswith("site:") else pattern_rule(body, verdict))
    return rules


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """The distinct runs of ASCII letters and digits, lower-cased; the empty token leads to rules without a literal one."""
    flat = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    return F.array_union(F.split(flat, "[^a-z0-9]+"), F.array(F.lit("")))


def rarest_tokens(pages: DataFrame, url: str, rules: Sequence[Rule]) -> dict[Rule, str]:
    """The token of each rule that the fewest rows' URLs have. Only counts of tokens that rules hold reach the driver."""
    held = sorted({t for r in rules for t in r.tokens})
    if not held:
        return {r: "" for r in rules}
    wanted = F.broadcast(pages.sparkSession.createDataFrame([(t,) for t in held], "token string")) if len(held) <= BROADCAST_RULES else pages.sparkSession.createDataFrame([(t,) for t in held], "token string")
    counts = pages.select(F.explode(url_tokens(F.col(url))).alias("token")).join(wanted, "token").groupBy("token").count()
    seen = {row[0]: row[1] for row in counts.collect()}
    return {r: min(r.tokens, key=lambda t: (seen.get(t, 0), -len(t), t)) if r.tokens else "" for r in rules}


def _candidate(rule: Rule, order: int) -> Column:
    return F.struct(
        F.lit(order).alias("order"), F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"), F.lit(rule.site).alias("site"), F.lit(rule.regex).alias("regex")
    )


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", default: str = "allow", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Rows of ``keep`` with ``host``, ``path``, ``rule`` (of the longest fitting site rule, else null), ``verdict`` and ``pattern``.

    A fitting site rule decides; else the first fitting pattern rule, allowing ones first, longer ones before shorter;
    else ``default``.
    """
    ordered = sorted(rules, key=Rule.key)
    token_of = rarest_tokens(pages, url, ordered)
    rows = pages.select(*[F.col(c) for c in keep], F.col(url).alias("_url"))
    rows = rows.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    rows = rows.withColumns({"_site": F.concat("host", "path"), "_low": F.translate(F.coalesce("_url", F.lit("")), UPPER, LOWER)})
    fits = lambda c: F.when(c["site"], F.rlike(F.col("_site"), c["regex"]) & (F.col("host") != "")).otherwise(F.rlike(F.col("_low"), c["regex"]))
    if len(ordered) <= INLINE_RULES:
        index: dict[str, list[Column]] = {}
        for order, rule in enumerate(ordered):
            index.setdefault(token_of[rule], []).append(_candidate(rule, order))
        if not index:
            return rows.select(*keep, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit(None).cast("string").alias("pattern"))
        lookup = F.map_from_arrays(F.array(*[F.lit(t) for t in index]), F.array(*[F.array(*c) for c in index.values()]))
        found = F.flatten(F.filter(F.transform(url_tokens(F.col("_url")), lambda t: F.try_element_at(lookup, t)), lambda c: c.isNotNull()))
        judged = rows.withColumn("_hit", F.array_min(F.filter(found, fits)))
    else:
        spark = pages.sparkSession
        table = spark.createDataFrame([(token_of[r], o, r.text, r.verdict, r.site, r.regex) for o, r in enumerate(ordered)], "token string, `order` int, rule string, verdict string, site boolean, regex string")
        urls = rows.select("_url", "host", "_site", "_low").distinct()
        candidates = urls.withColumn("token", F.explode(url_tokens(F.col("_url")))).join(small_side(table, BROADCAST_RULES), "token")
        struct = F.struct("order", "rule", "verdict", "site", "regex")
        hits = candidates.where(F.when(F.col("site"), F.expr("_site rlike regex") & (F.col("host") != "")).otherwise(F.expr("_low rlike regex"))).groupBy("_low", F.col("_url").alias("_u")).agg(F.min(struct).alias("_hit"))
        judged = rows.join(hits.drop("_low"), F.col("_url").eqNullSafe(F.col("_u")), "left")
    hit = F.col("_hit")
    return judged.select(
        *keep, "host", "path",
        F.when(hit["site"], hit["rule"]).alias("rule"),
        F.coalesce(hit["verdict"], F.lit(default)).alias("verdict"),
        F.when(~hit["site"], hit["rule"]).alias("pattern"),
    )
