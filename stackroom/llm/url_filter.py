"""URL filtering by pattern rules, by DataFrame functions only.

A rule has a host and the beginning of a path; * in either stands for any characters, within a host's label or across the
path. Every rule is indexed under its rarest literal token (rare among the tokens of the urls that are judged): a label of
its host or a segment of its path without *. The tokens of a url fetch candidate rules from that index, and only those
candidates run their regular expression.

Defined cases: a null url, or one without "://", has an empty host and path and fits no rule; a repeated url is judged
row by row; very long urls are judged whole; a rule without any literal token is refused; of rules that fit the one with
the most literal characters wins, of these the greatest by name; with no rules every url gets the default verdict; an
empty table gives an empty result; columns other than the key and url pass through, those of the names added here are
replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.llm.common import ascii_lower, maybe_broadcast, table

#: (action, host, path): the path begins with a slash.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_tokens(host: Column) -> Column:
    return F.transform(F.filter(F.split(host, r"\."), _literal), lambda x: F.concat(F.lit("h:"), x))


def _literal(piece: Column) -> Column:
    return (piece != "") & ~piece.contains("*")


def path_tokens(path: Column, whole: bool) -> Column:
    """Segments of a path. Those of a rule's prefix count only where a slash closes them: whole is False."""
    parts = F.split(path, "/")
    closed = parts if whole else F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(F.filter(closed, _literal), lambda x: F.concat(F.lit("p:"), x))


def _expression(part: Column, any_run: str) -> Column:
    """A rule's part as a regular expression: literals quoted, * as a run."""
    return F.array_join(F.transform(F.split(part, r"\*"), lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), any_run)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rule, action, pattern (a regular expression over host + path), width (literal characters), r_tokens. The rules are
    one literal of the plan."""
    said = F.lit(json.dumps([{"action": a, "r_host": h, "r_path": p} for a, h, p in rules]))
    rows = spark.range(1).select(F.inline(F.from_json(said, "array<struct<action: string, r_host: string, r_path: string>>")))
    return rows.select(
        F.concat("r_host", "r_path").alias("rule"), "action",
        F.concat(F.lit("(?s)^(?:[^/]*\\.)?"), _expression(F.col("r_host"), "[^/.]*"), _expression(F.col("r_path"), ".*")).alias("pattern"),
        F.length(F.replace(F.concat("r_host", "r_path"), F.lit("*"), F.lit(""))).alias("width"),
        F.concat(host_tokens(F.col("r_host")), path_tokens(F.col("r_path"), False)).alias("r_tokens"),
    )


def url_tokens(urls: DataFrame) -> DataFrame:
    return urls.select("host", "path", F.explode(F.array_distinct(F.concat(host_tokens(F.col("host")), path_tokens(F.col("path"), True)))).alias("token"))


def rule_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rules with `token`, the one of their literal tokens that the fewest urls hold."""
    each = rules.select("*", F.explode("r_tokens").alias("token"))
    wanted = F.broadcast(each.select("token").distinct())
    seen = tokens.join(wanted, "token").groupBy("token").agg(F.count("*").alias("seen"))
    ranked = each.join(seen, "token", "left").groupBy("rule", "action", "pattern", "width")
    return ranked.agg(F.min(F.struct(F.coalesce("seen", F.lit(0)), "token")).alias("best")).select(
        "rule", "action", "pattern", "width", F.col("best.token").alias("token")
    )


def has_literal(host: str, path: str) -> bool:
    """Whether a rule has a token to be indexed by: a label, or a segment that a slash closes."""
    return any(x and "*" not in x for x in [*host.split("."), *path.split("/")[:-1]])


def judge_urls(pages: DataFrame, key: str, rules: list[tuple[str, str, str]] = RULES, default: str = DEFAULT_VERDICT) -> DataFrame:
    """pages with host, path, rule (of the longest rule that fits, else null) and verdict.

    Distinct (host, path) pairs are judged once; hot pairs are pre-aggregated by the distinct before any shuffle.
    """
    spark = pages.sparkSession
    if not all(has_literal(host, path) for _, host, path in rules):
        raise ValueError("a rule needs a literal token")
    rest = [c for c in pages.columns if c not in (key, "host", "path", "rule", "verdict", "url")]
    at = pages.select(F.struct(key, *rest).alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not rules:
        return at.select("row.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    places = at.select("host", "path").distinct()
    tokens = url_tokens(places)
    index = rule_index(rule_table(spark, rules), tokens)
    fits = tokens.join(maybe_broadcast(index, len(rules)), "token").where(F.rlike(F.concat("host", "path"), F.col("pattern")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("width", "rule", "action")).alias("best"))
    return at.join(best, ["host", "path"], "left").select(
        "row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), "page_id")


OP7_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(action, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), f AS (
  SELECT page_id, max({'w': length(rhost || rpath), 'rule': rhost || rpath, 'action': action}) AS best
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id
)
SELECT u.page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict
FROM u LEFT JOIN f USING (page_id)
"""
