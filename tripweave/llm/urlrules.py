"""URL rules, found by their rarest literal token, in DataFrame operations alone.

Host rules name a host and the beginning of a path. Pattern rules are text with `^` for
anything but a letter or digit (or an end of the URL), `*` for anything, and `|` at an end
of the pattern for that end of the URL. Every rule becomes a regular expression and the words
of letters and digits that any URL it fits must have. A rule is filed under the one of its
words that the fewest URLs have. The words of a URL fetch the rules filed under them, and
only these run their expressions.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tripweave.operators.keyed import is_small

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = "[^0-9a-z]+"
#: Filed under this word, which every URL has, if no word of the rule is sure.
ANY_URL = ""

# The host rules to be applied, then block and allow patterns.
HOST_RULES = (("com/", ALLOW), ("example.com/en/", BLOCK), ("www.example.com/en/", ALLOW),
              ("net/es/", BLOCK), ("net/fr/", BLOCK))
PATTERN_RULES = (
    ("^ads^track^", BLOCK), ("^adserver^", BLOCK), ("^adult^x^", BLOCK), ("^bet^now^", BLOCK), ("^casino^", BLOCK),
    ("^cheap^pills^", BLOCK), ("^doubleclick^", BLOCK), ("^escort*^", BLOCK), ("^free^bets^", BLOCK),
    ("^keygen^", BLOCK), ("^link^farm^", BLOCK), ("^malware^", BLOCK), ("^payday^loan*^", BLOCK), ("^phishing^", BLOCK),
    ("^porn*^", BLOCK), ("^pornhub^", BLOCK), ("^spam^farm^", BLOCK), ("^torrent*^", BLOCK), ("^viagra^", BLOCK),
    ("^warez^", BLOCK), ("^xxx^", BLOCK), (".exe|", BLOCK), (".zip|", BLOCK), ("/search?*q=", BLOCK),
    ("^casino^history^", ALLOW), ("^torrent^river^", ALLOW), ("^malware^research^", ALLOW))


class Rule(NamedTuple):
    rule: str
    action: str
    is_host: bool
    expression: str
    words: tuple[str, ...]


def host_rule(rule: str, action: str) -> Rule:
    """A host with all its subdomains, and the beginning of the path, which is read with case.

    A word of the host is sure: dots or the ends of the host are around it. A word of the path
    is sure if a character of the rule stands behind it.
    """
    host, slash, path = rule.partition("/")
    host, path = host.lower(), slash + path
    words = re.findall("[0-9a-z]+", host) + re.findall("[0-9a-z]+(?=[^0-9a-z])", path.lower())
    expression = r"^(?:[^/]*\.)?" + re.escape(host) + (re.escape(path) if path else "(?:/|$)")
    return Rule(rule, action, True, expression, tuple(dict.fromkeys(words)))


def pattern_rule(rule: str, action: str) -> Rule:
    """A pattern over the lower-cased URL; words next to `*` or an open end may be parts of
    longer words and are not sure."""
    text = rule.lower()
    body = text.removeprefix("|").removesuffix("|")
    first, last = text.startswith("|"), text.endswith("|")
    parts = ["^" if first else ""]
    for piece in re.findall(r"\^|\*|[^*^]+", body):
        parts.append({"^": "(?:^|$|[^0-9a-z])", "*": ".*"}.get(piece) or re.escape(piece))
    words = [found.group() for found in re.finditer("[0-9a-z]+", body)
             if (body[found.start() - 1] != "*" if found.start() else first)
             and (body[found.end()] != "*" if found.end() < len(body) else last)]
    return Rule(rule, action, False, "(?s)" + "".join(parts) + ("$" if last else ""), tuple(dict.fromkeys(words)))


def default_rules() -> list[Rule]:
    return [host_rule(*rule) for rule in HOST_RULES] + [pattern_rule(*rule) for rule in PATTERN_RULES]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without a `://` or a URL."""
    at = F.instr(url, "://")
    behind = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(behind, r"^[^/?#]*", 0)
    path = F.regexp_extract(behind, r"^[^/?#]*([^?#]*)", 1)
    return (F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit("")))


def words_of(url: Column) -> Column:
    """Distinct words of letters and digits of the lower-cased URL, and the word of every URL."""
    return F.array_distinct(F.concat(F.array(F.lit(ANY_URL)), F.split(F.lower(url), NOT_WORD)))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, *rule[:4], list(rule.words)) for i, rule in enumerate(rules)]
    return spark.createDataFrame(
        rows, "rule_id int, rule string, action string, is_host boolean, expression string, words array<string>")


def rule_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule under its rarest word (`word`), by the number of URLs of `_url` that have it.

    Only words of rules are counted, per task first, so hot words send one row per task.
    """
    wanted = rules.select(F.explode("words").alias("word")).distinct()
    counts = urls.select(F.explode(words_of(F.col("_url"))).alias("word")).join(
        _light(wanted), "word").groupBy("word").agg(F.count("*").alias("_urls"))
    filed = rules.select("rule_id", F.explode("words").alias("word")).join(counts, "word", "left").groupBy("rule_id").agg(
        F.min_by("word", F.struct(F.coalesce("_urls", F.lit(0)), "word")).alias("word"))
    return rules.join(filed, "rule_id", "left").withColumn("word", F.coalesce("word", F.lit(ANY_URL))).drop("words")


def _light(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if is_small(rows) else rows


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and pattern of every page.

    `rule` is the longest host rule that fits; it decides. Without one the longest pattern
    decides (of equal ones a block), and without that the page is allowed. Fits are found
    once per distinct URL and joined back, so pages with one URL share them. A null URL, or one
    without `://`, has neither host nor path and fits no host rule; null fits no pattern
    either. Repeated rows and null ids stay as they are, an empty table gives no rows, and
    further columns are not read.
    """
    known = rule_table(pages.sparkSession, default_rules() if rules is None else rules)
    rows = pages.select(pages["page_id"].alias("page_id"), pages["url"].cast("string").alias("_url"))
    urls = rows.filter("_url IS NOT NULL").select("_url")
    candidates = urls.select("_url", F.explode(words_of(F.col("_url"))).alias("word")).join(
        _light(rule_index(urls, known)), "word")
    host, path = host_and_path(F.col("_url"))
    subject = F.when(F.col("is_host"), F.concat(host, path)).otherwise(F.lower("_url"))
    fits = candidates.filter(F.regexp_like(subject, F.col("expression")))
    length, ahead = F.length("rule"), F.when(F.col("action") == BLOCK, 1).otherwise(0)
    rank = F.struct(length, ahead, "rule")
    best = fits.groupBy("_url").agg(
        F.max_by(F.struct("rule", "action"), F.when(F.col("is_host"), rank)).alias("_host_rule"),
        F.max_by(F.struct("rule", "action"), F.when(~F.col("is_host"), rank)).alias("_pattern"))
    return rows.join(best, "_url", "left").select(
        "page_id", host.alias("host"), path.alias("path"), F.col("_host_rule.rule").alias("rule"),
        F.coalesce("_host_rule.action", "_pattern.action", F.lit(ALLOW)).alias("verdict"),
        F.col("_pattern.rule").alias("pattern"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql(rules: list[Rule] | None = None) -> str:
    """All rules tried on all pages, the plain way, for comparison."""
    rules = default_rules() if rules is None else rules
    hosts = ", ".join(f"({_quoted(r.rule)}, {_quoted(r.rule.partition('/')[0])}, "
                      f"{_quoted('/' + r.rule.partition('/')[2])}, {_quoted(r.action)})" for r in rules if r.is_host)
    patterns = ", ".join(f"({_quoted(r.rule)}, {_quoted(r.expression)}, {_quoted(r.action)})" for r in rules if not r.is_host)
    return f"""
WITH hosts(rule, rule_host, rule_path, action) AS (VALUES {hosts}),
patterns(rule, expression, action) AS (VALUES {patterns}),
parts AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
keyed AS (SELECT *, row_number() OVER () AS k FROM cut),
by_host AS (
  SELECT k, arg_max(h.rule, length(h.rule)) AS rule, arg_max(h.action, length(h.rule)) AS action FROM keyed, hosts h
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k),
by_pattern AS (
  SELECT k, arg_max(p.rule, (length(p.rule), p.action = 'block', p.rule)) AS rule,
    arg_max(p.action, (length(p.rule), p.action = 'block', p.rule)) AS action
  FROM keyed, patterns p WHERE regexp_matches(lower(url), p.expression) GROUP BY k)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, h.rule,
  coalesce(h.action, p.action, 'allow') AS verdict, p.rule AS pattern
FROM keyed LEFT JOIN by_host h USING (k) LEFT JOIN by_pattern p USING (k)
"""
