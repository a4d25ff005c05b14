"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host and a path prefix (``example.com/en/``); it fits its host and all
subdomains where the path starts with the rule's. Every rule is filed under the one
of its literal tokens that the table's URLs hold least often. The tokens of a URL
fetch the rules filed under them, only those run their regular expression, and the
longest that fits decides; the method's own words are rules of the same index that
yield to all others. DataFrame functions only.

Defined results: a null URL, or one without ``://``, has an empty host and path
and fits no rule; repeated URLs are judged once and joined back; an empty table or
an empty list of rules is allowed; other columns of the table are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT, join_hot, saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An index of at most so many rules is broadcast (a rule has at most MAX_RULE_CHARS characters), a larger one is joined by a shuffle.
BROADCAST_RULES = 10_000
MAX_RULE_CHARS = 512


@dataclass(frozen=True)
class UrlRule:
    """``action`` (allow or block) for a host and its subdomains, where the path starts as the rule's: ``host/path``."""

    action: str
    pattern: str


#: Words that the method itself blocks as a whole part of a host or path, where no rule fits: rules of the index like others.
BLOCKED_WORDS = ("casino", "poker", "viagra", "porn", "xxx")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(F.when(F.instr(url, "://") > 0, host), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)), F.lit(""))


def url_tokens(host_path: Column, bare: bool = False) -> Column:
    """The distinct runs of ASCII letters and digits, as they are and in lower case; with ``bare`` also the empty token, under which rules without a token are filed."""
    tokens = F.array_union(F.split(host_path, "[^A-Za-z0-9]+"), F.split(F.translate(host_path, UPPER, LOWER), "[^A-Za-z0-9]+"))
    return F.array_union(tokens, F.array(F.lit(""))) if bare else tokens


def _rule_rows(rules: list[UrlRule]) -> list[tuple]:
    rows = []
    for r in rules:
        if len(r.pattern) > MAX_RULE_CHARS:
            raise ValueError("a rule is too long")
        host, _, path = r.pattern.partition("/")
        whole = f"{host.lower()}/{path}"
        # the last run may go on in the URL, so it is a token only if something else follows it
        tokens = sorted({*re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", whole)}) or [""]
        rows.append((r.pattern, r.action, r"(?s)^(?:[^/]*\.)?" + re.sub(r"([^A-Za-z0-9/])", r"\\\1", whole), tokens))
    # the method's own words have no rule to name; URLs write them in upper or lower case
    return rows + [(None, "block", rf"(?s)(^|.*[^A-Za-z0-9])(?i:{w})($|[^A-Za-z0-9].*)", [w]) for w in BLOCKED_WORDS]


def rule_index(spark: SparkSession, rules: list[UrlRule], urls: DataFrame) -> DataFrame:
    """(token, rule, action, regex): each rule under its token that the fewest of ``urls`` (column host_path) hold."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("rule", "action", "regex")] + [T.StructField("tokens", T.ArrayType(T.StringType()))])
    rows = spark.createDataFrame(_rule_rows(rules), schema)
    filed = rows.select("rule", "action", "regex", F.explode("tokens").alias("token"))
    seen = urls.select(F.explode(url_tokens(F.col("host_path"))).alias("token"))
    seen = seen.join(_hinted(filed.select("token").distinct(), rules), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = filed.join(seen, "token", "left").groupBy("rule", "action", "regex").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    return rarest.select(F.col("rarest.token").alias("token"), "rule", "action", "regex")


def _hinted(df: DataFrame, rules: list[UrlRule]) -> DataFrame:
    return F.broadcast(df) if len(rules) <= BROADCAST_RULES else df


def judge_urls(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; ``rule`` is null where the method's own words decide."""
    spark = pages.sparkSession
    url = F.col("url")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"))
    # a URL's host and path without case, query or fragment: what rules can tell apart
    rows = rows.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("host_path", F.concat("host", "path"))
    known = saved(rows.where(F.length("host_path") > 0).groupBy("host_path").agg(F.count("*").alias("c")), "urls")
    distinct = known.select("host_path")
    index = _hinted(rule_index(spark, rules, distinct), rules)
    bare = any(tokens == [""] for *_, tokens in _rule_rows(rules))
    candidates = distinct.select("host_path", F.explode(url_tokens(F.col("host_path"), bare)).alias("token")).join(index, "token")
    fits = candidates.where(F.expr("host_path rlike regex"))
    best = fits.groupBy("host_path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("best"))
    # rows without a host and path fit nothing
    met = join_hot(rows.where(F.length("host_path") > 0), best, "host_path", "left", known.where(F.col("c") > HOT).select("host_path"))
    judged = met.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict"))
    return judged.unionByName(rows.where(F.length("host_path") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict")))
