"""URL filters: pattern rules indexed by their rarest literal token, all in DataFrame functions.

A rule names literal tokens that every URL it fits must hold. Each rule is indexed under the one that fewest URLs hold;
a URL's tokens fetch candidate rules, and only those run their regular expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import prepare, read


@dataclass(frozen=True)
class Rule:
    """`pattern` is searched in the whole URL, or in host and path for a rule of a list; `text` is a list rule's own form."""

    pattern: str
    literals: tuple[str, ...]
    verdict: str
    text: str | None = None


def list_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits a host and its subdomains, if the URL's path starts with the rule's.

    The part of the path after its last mark may go on in the URL, so it is no literal.
    """
    literals = re.findall(r"[a-z0-9]+", host.lower()) + re.findall(r"[a-z0-9]+(?=[^a-z0-9])", path.lower())
    return Rule(rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(literals)), verdict, host + path)


#: The standing list: (verdict, host, path).
LIST = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: The standing patterns, for URLs that no rule of the list fits: hosts named for advertisements or spam, pages behind forms, and doubles of pages.
PATTERNS = (
    Rule(r"(?i)^ftp://", ("ftp",), "block"),
    *(Rule(rf"(?i)://(?:[^/?#]*[.-])?{word}[.-]", (word,), "block") for word in ("ads", "adult", "bets", "casino", "pills", "spam")),
    Rule(r"(?i)/cgi-bin/", ("cgi", "bin"), "block"),
    Rule(r"(?i)/wp-admin/", ("wp", "admin"), "block"),
    Rule(r"(?i)/login(?:[/?#.]|$)", ("login",), "block"),
    Rule(r"(?i)/signup(?:[/?#.]|$)", ("signup",), "block"),
    Rule(r"(?i)/cart(?:[/?#.]|$)", ("cart",), "block"),
    Rule(r"(?i)[?&]sessionid=", ("sessionid",), "block"),
    Rule(r"(?i)[?&]replytocom=", ("replytocom",), "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as rows; they come from the driver, which bounds their number."""
    rows = [F.struct(F.lit(k).alias("rule_id"), F.lit(r.pattern).alias("pattern"), F.array(*map(F.lit, r.literals or ("",))).alias("literals"), F.lit(r.verdict).alias("verdict"), F.lit(r.text).cast("string").alias("rule")) for k, r in enumerate(rules)]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*rows)))


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url", broadcast_rules: int = 100_000) -> DataFrame:
    """All columns of `pages` with host, path, rule and verdict.

    The longest fitting rule of a list decides (equal lengths: the first in alphabetical order); else a fitting pattern,
    where block beats allow; else `default`. A null URL, or one without `://`, has an empty host and path and gets
    `default` unless a pattern fits it. Rules without literals are tried on all URLs. Each distinct URL is judged once, so
    repeated rows get equal verdicts. Up to `broadcast_rules` rules the index is sent to all tasks; larger ones are joined.
    Columns named host, path, rule or verdict are replaced. An empty table gives an empty one.
    """
    spark = prepare(pages.sparkSession)
    base = pages.drop("host", "path", "rule", "verdict")
    key = "__url"
    urls = base.select(F.col(url).alias(key)).filter(F.col(key).isNotNull()).distinct()
    tokens = F.array_append(F.array_distinct(F.split(F.translate(F.col(key), UPPER, LOWER), "[^a-z0-9]+")), F.lit(""))
    held = urls.select(key, F.explode(F.array_distinct(tokens)).alias("token"))

    small = (lambda df: F.broadcast(df)) if len(rules) <= broadcast_rules else (lambda df: df)
    table = _table(spark, rules) if rules else _table(spark, [Rule("$.^", ("",), default)])
    literals = table.select("rule_id", F.explode("literals").alias("token"))
    counts = held.join(small(literals.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("n"))
    ranked = literals.join(counts, "token", "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    index = table.drop("literals").join(ranked, "rule_id").select("pattern", "verdict", "rule", F.col("rarest.token").alias("token"))

    target = F.when(F.col("rule").isNotNull(), F.concat(host(F.col(key)), path(F.col(key)))).otherwise(F.col(key))
    fits = held.join(small(index), "token").filter(F.rlike(target, F.col("pattern")))
    listed = F.when(F.col("rule").isNotNull(), F.struct((-F.length("rule")).alias("n"), "rule", "verdict"))
    other = F.when(F.col("rule").isNull(), F.col("verdict"))
    best = fits.groupBy(key).agg(F.min(listed).alias("listed"), F.max(other).alias("other"))
    out = base.join(best, base[url] == best[key], "left")
    return out.select(*base.columns, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", "other", F.lit(default)).alias("verdict"))


def op5(spark, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), [*(list_rule(*r) for r in LIST), *PATTERNS]).drop("url")


def _sql() -> str:
    """The same by trying every rule on every URL."""
    fixed = " union all ".join(f"select '{h}' h, '{p}' p, '{v}' v" for v, h, p in LIST)
    patterns = " or ".join(f"regexp_matches(coalesce(url, ''), '{r.pattern}')" for r in PATTERNS)
    return f"""
    with parsed as (
      select row_number() over () as id, page_id, url,
        translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path
      from pages),
    rules as ({fixed}),
    hits as (
      select id, h || p as rule, v, row_number() over (partition by id order by length(h || p) desc, h || p) as n
      from parsed, rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
    select page_id, host, path, rule, coalesce(v, case when {patterns} then 'block' else 'allow' end) as verdict
    from parsed left join (select * from hits where n = 1) using (id)"""


SQL = _sql()
