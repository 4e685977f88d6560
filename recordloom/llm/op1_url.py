"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over host + path with literal tokens that every match must
contain. Token frequencies are counted over all URLs; each rule is indexed by its rarest
literal, the tokens of a URL fetch the rules indexed by them, and only those rules run their
expression. A rule without literals is fetched by every URL.

Site rules (host, path) fit the host and its subdomains where the URL's path starts with the
rule's; the longest wins, ties go to the smaller string. Where none fits, a URL is blocked if a
pattern of the method matches, and allowed otherwise.

Up to INLINE_RULES rules travel inside the plan, and pages are only scanned. Longer lists join
on the token, over distinct sites, so a hot site counts once.

Nulls: a null URL, or one without ``://``, has an empty host and path and no tokens: it is
allowed, unless a rule without literals matches the empty string. Rows are judged one by one,
so repeated rows and null ids come back as they are; other columns are ignored. A very long URL is
judged whole. An empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INLINE_RULES = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``kind`` is site or pattern; ``weight`` decides between site rules that fit."""

    name: str
    action: str
    regex: str
    literals: tuple[str, ...]
    kind: str = "pattern"

    @property
    def weight(self) -> int:
        return len(self.name)


def site_rule(action: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains, and all paths that start with ``path`` (which starts with /)."""
    pieces = [t for t in re.split("[^A-Za-z0-9]+", host + path) if t]
    if re.search("[A-Za-z0-9]$", path):  # the path may go on inside this token
        pieces = pieces[:-1]
    return Rule(host + path, action, r"^(?:[^/]*\.)?" + re.escape(host + path), tuple(dict.fromkeys(pieces)), "site")


SITE_RULES = [
    site_rule("allow", "com", "/"),
    site_rule("block", "example.com", "/en/"),
    site_rule("allow", "www.example.com", "/en/"),
    site_rule("block", "net", "/es/"),
    site_rule("block", "net", "/fr/"),
]

#: The method's own rules, for URLs that no site rule fits.
PATTERN_RULES = [
    Rule("link farm", "block", r"(^|[.-])spam-farm[.]", ("spam", "farm")),
    Rule("login page", "block", r"/login([./]|$)", ("login",)),
    Rule("tag listing", "block", r"/tag/[^/]+/page/[0-9]+", ("tag", "page")),
    Rule("gambling", "block", r"(^|[./-])casino([./-]|$)", ("casino",)),
]


def site_columns(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a URL, both empty without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), F.regexp_extract(url, parts, 2)


def _tokens(site: Column) -> Column:
    return F.array_distinct(F.filter(F.split(site, "[^A-Za-z0-9]+"), lambda t: t != ""))


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How many URLs hold each of the given tokens; as many rows reach the driver as there are tokens."""
    host, path = site_columns(F.col("url"))
    wanted = F.array_intersect(_tokens(F.concat(host, path)), F.array(*map(F.lit, tokens)))
    rows = urls.select(F.explode(wanted).alias("token")).groupBy("token").count().collect()
    return {t: 0 for t in tokens} | {r["token"]: r["count"] for r in rows}


def index_token(rule: Rule, counts: dict[str, int]) -> str:
    """The rarest literal of a rule, the empty string if it has none."""
    return min(rule.literals, key=lambda t: (counts[t], t), default="")


def judge_urls(pages: DataFrame, rules: list[Rule], key: str = "page_id", inline: int = INLINE_RULES) -> DataFrame:
    """key, host, path, rule, verdict, pattern for each row of ``pages`` (which has a ``url``)."""
    spark = pages.sparkSession
    literals = sorted({t for r in rules for t in r.literals})
    counts = token_counts(pages, literals) if literals else {}
    host, path = site_columns(F.col("url"))
    sites = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    sites = sites.withColumn("site", F.concat("host", "path"))
    fits = "struct<cost:int,name:string,action:string,kind:string,regex:string>"
    rows = [(index_token(r, counts), (-r.weight, r.name, r.action, r.kind, r.regex)) for r in rules]
    if len(rules) <= inline:
        by_token: dict[str, list] = {}
        for token, rule in rows:
            by_token.setdefault(token, []).append(rule)
        names = ["cost", "name", "action", "kind", "regex"]
        lists = [F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in own)) for own in by_token.values()]
        keys = F.array(*map(F.lit, by_token)) if by_token else F.array().cast("array<string>")
        index = F.map_from_arrays(keys, F.array(*lists) if lists else F.array().cast(f"array<array<{fits}>>"))
        wanted = F.array_intersect(F.concat(_tokens(F.col("site")), F.array(F.lit(""))), keys)
        fetched = F.flatten(F.transform(wanted, lambda t: F.element_at(index, t)))
        matched = sites.withColumn("fit", F.filter(fetched, lambda r: F.regexp_like(F.col("site"), r["regex"])))
    else:
        table = spark.createDataFrame(rows, f"token string, rule {fits}")
        probes = sites.select("site").distinct().select("site", F.explode(F.concat(_tokens(F.col("site")), F.array(F.lit("")))).alias("token"))
        found = probes.join(table, "token").filter(F.regexp_like(F.col("site"), F.col("rule.regex")))
        found = found.groupBy("site").agg(F.collect_set("rule").alias("fit"))  # at most the rules that match one site
        matched = sites.join(found, "site", "left").withColumn("fit", F.coalesce("fit", F.array().cast(f"array<{fits}>")))
    site = F.array_min(F.filter("fit", lambda r: r["kind"] == "site"))
    pattern = F.array_min(F.filter("fit", lambda r: r["kind"] == "pattern"))
    verdict = F.coalesce(site["action"], pattern["action"], F.lit("allow"))
    return matched.select(key, "host", "path", site["name"].alias("rule"), verdict.alias("verdict"), pattern["name"].alias("pattern"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), SITE_RULES + PATTERN_RULES)


def _sql_sites() -> str:
    def fits(rule: Rule) -> str:
        host, slash, path = rule.name.partition("/")
        return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{slash}{path}')"

    return " ".join(f"when {fits(r)} then '{r.name}'" for r in sorted(SITE_RULES, key=lambda r: (-r.weight, r.name)))


OP1_SQL = f"""
with p as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path
  from pages),
r as (
  select *, case {_sql_sites()} end as rule,
         case {" ".join(f"when regexp_matches(host || path, '{r.regex}') then '{r.name}'" for r in sorted(PATTERN_RULES, key=lambda r: (-r.weight, r.name)))} end as pattern
  from p)
select page_id, host, path, rule, pattern,
       case when rule in ({", ".join(f"'{r.name}'" for r in SITE_RULES if r.action == "allow")}) then 'allow'
            when rule is not null or pattern is not null then 'block' else 'allow' end as verdict
from r
"""
