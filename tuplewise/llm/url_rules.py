"""Operator 8: URL filters whose pattern rules are indexed by their rarest literal token.

A rule is a wildcard pattern (`*` any run, `^` a separator or the end, `||` a
host label start, `|` an end of the URL) for one verdict. Its literal tokens
that have a separator on both sides must occur as whole tokens in any URL that
it matches; the one that is rarest over all URLs is its index entry. A URL's
tokens fetch candidate rules, and only these run their regular expressions.
All of it is native DataFrame work: one counting pass over the URLs for the
rarity, then the lookup.

A list of rules of moderate length is a hash table held as a literal, and the
lookup a map-only pass. A longer one is a table that the URLs' tokens join; the
pairs of URL and candidate are sorted by rule, so that each regular expression
is compiled once a task. Rules without a token are one alternation per verdict.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, require

#: Rules by host suffix and path prefix; the longest that fits wins.
HOST_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

#: Pattern rules for what the host rules leave open; allow beats block.
PATTERN_RULES = (
    *((f"||{w}^", "block") for w in ("adult", "casino", "porn", "xxx", "warez", "torrents", "sexcam", "escorts", "gambling", "pokies")),
    *((f"||{w}-*.", "block") for w in ("adult", "cheap", "discount", "replica", "bonus")),
    *((f"||*-{w}.", "block") for w in ("pills", "meds", "viagra", "casino", "porn", "replica", "bets", "dating")),
    *((f"-{w}.", "block") for w in ("pills", "viagra", "casino")),
    ("||spam-farm.", "block"),
    ("spam-farm.", "block"),
    ("||free-*casino", "block"),
    ("||free-*prizes", "block"),
    ("casino", "block"),
    ("free-prizes.", "block"),
    *((f"/{w}/", "block") for w in ("ads", "adserver", "banners", "popunder", "sponsored", "doorway", "linkfarm")),
    *((f"/{w}^", "block") for w in ("wp-login.php", "xmlrpc.php", "eval-stdin.php", "adclick.php")),
    *((f"&{w}=", "block") for w in ("affiliate_id", "aff_sub", "click_id", "clickid", "subid")),
    *((f"?{w}=", "block") for w in ("affiliate_id", "clickid", "popup_id")),
    ("/banner/*/click^", "block"),
    ("/track/*/pixel^", "block"),
    ("utm_source=spam^", "block"),
    ("utm_medium=popunder^", "block"),
    ("://docs.*/ads/", "allow"),
    ("://developer.*/ads/", "allow"),
    ("/research/*/casino^", "allow"),
)

#: As many rules are a literal of the plan; more are joined. The results are the same.
LITERAL_RULES = 2_000
_BUCKETS = 1024


@dataclass(frozen=True)
class Rule:
    pattern: str
    verdict: str

    @property
    def regex(self) -> str:
        p, out = self.pattern, ""
        if p.startswith("||"):
            p, out = p[2:], r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"
        elif p.startswith("|"):
            p, out = p[1:], "^"
        end = "$" if p.endswith("|") else ""
        for c in p.removesuffix("|"):
            out += {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|$)"}.get(c, "\\" + c if c in r"\.[]{}()+-?$|/" else c)
        return out + end

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that stand between separators in whatever matches."""
        p = self.pattern.lower()
        at_label = p.startswith("||")
        core = p.lstrip("|")
        found = []
        for m in re.finditer("[a-z0-9]+", core):
            before = core[m.start() - 1] if m.start() else ("." if at_label or p.startswith("|") else "*")
            after = core[m.end()] if m.end() < len(core) else "*"
            if before != "*" and after != "*":
                found.append(m[0])
        return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-case host and path of a URL; both empty for null or without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def url_tokens(lowered: Column) -> Column:
    return F.array_distinct(F.split(lowered, "[^a-z0-9]+"))


def index_rules(pages: DataFrame, rules: list[Rule], url: Column) -> list[tuple[str, Rule]]:
    """(token, rule): each rule under its rarest token, '' if it has none.

    Rarity is counted over every URL, for the rules' tokens only: what comes
    back to the driver is bounded by the rules.
    """
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return [("", r) for r in rules]
    tokens = url_tokens(F.lower(url))
    if len(wanted) <= LITERAL_RULES:
        tokens = pages.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, wanted)))).alias("token"))
    else:
        tokens = pages.select(F.explode(tokens).alias("token")).join(pages.sparkSession.createDataFrame([(t,) for t in wanted], "token string"), "token", "left_semi")
    seen = dict.fromkeys(wanted, 0) | {r.token: r.n for r in tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [(min(r.tokens, key=lambda t: (seen[t], -len(t), t), default=""), r) for r in rules]


def _always(rules: list[Rule], verdict: str) -> Column:
    """Whether a rule without a token matches, in alternations of at most 200."""
    found = [r.regex for r in rules if r.verdict == verdict]
    hit = F.lit(False)
    for at in range(0, len(found), 200):
        hit |= F.rlike(F.col("_low"), F.lit("|".join(f"(?:{x})" for x in found[at : at + 200])))
    return hit


def _looked_up(step: DataFrame, host_rules: Sequence[tuple], indexed: list[tuple[str, Rule]]) -> DataFrame:
    """Add rule, _fixed, _block and _allow to rows of host, path and _low, from a literal."""
    name = fixed = F.lit(None).cast("string")
    for h, p, v in sorted(host_rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        name, fixed = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(fixed)
    table: list[list[tuple[str, Rule]]] = [[] for _ in range(_BUCKETS)]
    for token, rule in indexed:
        table[zlib.crc32(token.encode()) % _BUCKETS].append((token, rule))
    entry = lambda token, r: F.struct(F.lit(token).alias("token"), F.lit(r.regex).alias("regex"), F.lit(r.verdict).alias("verdict"))
    none = F.expr("cast(array() as array<struct<token:string,regex:string,verdict:string>>)")
    index = F.array(*(F.array(*(entry(t, r) for t, r in bucket)) if bucket else none for bucket in table))
    fetched = F.flatten(F.transform(url_tokens(F.col("_low")), lambda t: F.filter(F.get(index, F.crc32(t.cast("binary")) % _BUCKETS), lambda r: r["token"] == t)))
    hit = lambda v: F.exists("_candidates", lambda r: (r["verdict"] == v) & F.rlike(F.col("_low"), r["regex"]))
    step = step.select("*", fetched.alias("_candidates"), name.alias("rule"), fixed.alias("_fixed"))
    return step.select("*", hit("block").alias("_block"), hit("allow").alias("_allow"))


def _joined(step: DataFrame, host_rules: Sequence[tuple], indexed: list[tuple[str, Rule]]) -> DataFrame:
    """The same from tables of rules of any length, broadcast only by Spark's own check of their size."""
    spark = step.sparkSession
    step = materialise(step.select("*", F.monotonically_increasing_id().alias("_row")), "urls")
    rules = spark.createDataFrame([(t, r.regex, r.verdict) for t, r in indexed], "token string, regex string, verdict string")
    pairs = step.select("_row", "_low", F.explode(url_tokens(F.col("_low"))).alias("token")).join(rules, "token")
    hits = pairs.sortWithinPartitions("regex").filter(F.rlike("_low", F.col("regex")))
    hits = hits.groupBy("_row").agg(F.bool_or(F.col("verdict") == "block").alias("_block"), F.bool_or(F.col("verdict") == "allow").alias("_allow"))
    # A host's suffixes, each a candidate of its own.
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = spark.createDataFrame([(h, p, v, i) for i, (h, p, v) in enumerate(host_rules)], "suffix string, prefix string, fixed string, place int")
    fits = step.select("_row", "path", F.explode(suffixes).alias("suffix")).join(hosts, "suffix").filter(F.col("path").startswith(F.col("prefix")))
    best = F.struct((F.length("suffix") + F.length("prefix")).alias("a"), F.length("suffix").alias("b"), F.col("place"), F.concat("suffix", "prefix").alias("rule"), "fixed")
    fits = fits.groupBy("_row").agg(F.max(best).alias("best"))
    both = step.join(hits, "_row", "left").join(fits, "_row", "left")
    return both.select(*step.columns, F.coalesce("_block", F.lit(False)).alias("_block"), F.coalesce("_allow", F.lit(False)).alias("_allow"), F.col("best.rule").alias("rule"), F.col("best.fixed").alias("_fixed"))


def filter_urls(pages: DataFrame, *, host_rules: Sequence[tuple] = HOST_RULES, pattern_rules: Sequence[tuple] = PATTERN_RULES, url_col: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to pages; other columns of these names are replaced.

    rule is host+path of the longest host rule that fits (ties: the longer
    host, then the later rule), else null. verdict is that rule's, else block
    if a pattern rule for block matches and none for allow, else allow. Null,
    empty and malformed URLs have empty host and path, fit no host rule and are
    allowed unless a pattern matches; very long ones are read whole. Rows are
    judged one by one, so ties, repeated rows and empty tables need nothing.
    There is no bound on the rules but the driver's memory, as they are given
    there. Up to LITERAL_RULES there is no shuffle but that of the counts.
    """
    require(pages, url_col)
    rules = [Rule(*r) for r in pattern_rules]
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    host, path = host_and_path(url)
    indexed = index_rules(pages, rules, url)
    always, indexed = [r for t, r in indexed if not t], [(t, r) for t, r in indexed if t]
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    names = [f"c{i}" for i in range(len(keep))]  # no clash with what is added
    step = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)), host.alias("host"), path.alias("path"), F.lower(url).alias("_low"))
    found = (_looked_up if len(rules) + len(host_rules) <= LITERAL_RULES else _joined)(step, host_rules, indexed)
    block, allow = (F.col(f"_{v}") | _always(always, v) for v in ("block", "allow"))
    verdict = F.coalesce("_fixed", F.when(block & ~allow, "block").otherwise("allow"))
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "host", "path", "rule", verdict.alias("verdict"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).drop("url")
