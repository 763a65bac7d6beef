"""URL filters: host and path rules, then pattern rules found by a rare token.

A pattern rule names the literal tokens that every URL it matches must hold.
The rule is indexed by the one of them that fewest URLs of the table contain;
the distinct tokens of a URL fetch their candidate rules by an equi-join, and
regular expressions run on those candidates only. A rule without a token is an
error. Everything is a DataFrame expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class PathRule:
    """Fits the host, all its subdomains, and paths that start with ``path``."""

    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class PatternRule:
    """Blocks URLs (A-Z lower-cased) in which the regular expression is found;
    ``tokens`` are runs of ``[a-z0-9]`` that every such URL has as whole tokens."""

    name: str
    pattern: str
    tokens: tuple[str, ...]


PATH_RULES = (
    PathRule("com", "/en/", "block"),
    PathRule("example.com", "/en/7", "allow"),
    PathRule("net", "/de/", "allow"),
    PathRule("example.net", "/de/8", "block"),
    PathRule("org", "/es/", "block"),
)
def _host_rule(*tokens: str) -> PatternRule:
    """Blocks hosts in which the tokens stand one after the other, set apart by
    dots or hyphens, as in ``free-bets.io`` and ``www.free.bets.com``."""
    return PatternRule("-".join(tokens), r"://([^/?#]*[.-])?" + "[.-]".join(tokens) + r"[.-]", tokens)


def _path_rule(token: str) -> PatternRule:
    """Blocks URLs with the token as a whole part of the path."""
    return PatternRule(f"/{token}/", rf"://[^/?#]*/([^?#]*/)?{token}/", (token,))


#: What advertising, gambling, pill, adult and spam hosts are commonly named by;
#: nothing here is taken from a list.
HOST_TOKENS = (
    ("ads", "track"), ("ad", "server"), ("ad", "click"), ("ads", "media"), ("click", "track"), ("pop", "ads"), ("banner", "ads"), ("track", "pixel"),
    ("casino",), ("poker",), ("roulette",), ("jackpot",), ("slots", "win"), ("free", "bets"), ("sports", "bets"), ("bet", "win"), ("lotto", "win"),
    ("cheap", "pills"), ("buy", "pills"), ("online", "pharmacy"), ("viagra",), ("cialis",), ("weight", "loss", "pills"),
    ("adult", "x"), ("adult", "video"), ("adult", "chat"), ("porn",), ("xxx",), ("sex", "cam"), ("live", "sex"), ("hot", "girls"),
    ("spam", "farm"), ("link", "farm"), ("free", "iphone"), ("win", "prize"), ("fast", "loans"), ("payday", "loans"), ("replica", "watches"), ("free", "crypto"), ("get", "rich"),
)
PATH_TOKENS = ("adserver", "doubleclick", "adclick", "popunder", "affiliate")
PATTERN_RULES = (*(_host_rule(*t) for t in HOST_TOKENS), *map(_path_rule, PATH_TOKENS))


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    got = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(got(1), UPPER, LOWER), got(2)


def _fitting(host: Column, path: Column, rules: tuple[PathRule, ...]) -> Column:
    """The longest fitting path rule as a struct (n, rule, verdict), or null."""
    known = [
        F.when(
            ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path)),
            F.struct(F.lit(len(r.host + r.path)).alias("n"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")),
        )
        for r in rules
    ]
    return F.array_max(F.array(*known)) if known else F.lit(None).cast("struct<n:int,rule:string,verdict:string>")


def tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.translate(url, UPPER, LOWER), "[^a-z0-9]+"), lambda t: t != ""))


def pattern_hits(urls: DataFrame, rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """(url, pattern): for each distinct matching URL its first rule by name.

    Every rule needs a token to be found by. The index is joined without a hint:
    Spark broadcasts it by its size or shuffles on the token.
    """
    if bare := [r.name for r in rules if not r.tokens]:
        raise ValueError(f"rules without a token: {bare}")
    spark = urls.sparkSession
    urls = urls.select("url").filter(F.col("url").isNotNull())
    listed = spark.createDataFrame([(r.name, r.pattern, t) for r in rules for t in r.tokens], "name string, pattern string, token string")
    each = urls.select("url", F.explode(tokens(F.col("url"))).alias("token"))
    seen = each.join(listed.select("token").distinct(), "token").groupBy("token").count()
    ranked = listed.join(seen, "token", "left").groupBy("name", "pattern").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("m"))
    index = ranked.select("name", F.col("pattern").alias("expression"), F.col("m.token").alias("token"))
    lower = F.translate(F.col("url"), UPPER, LOWER)
    found = each.join(index, "token").filter(F.rlike(lower, F.col("expression")))
    return found.groupBy("url").agg(F.min("name").alias("pattern"))


def judge_urls(pages: DataFrame, path_rules: tuple[PathRule, ...] = PATH_RULES, pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """Adds host, path, rule, pattern and verdict to (page_id, url).

    A fitting path rule decides, the longest first; else a pattern that is
    found blocks; else the URL is allowed. Null URLs and such without ``://``
    have an empty host and path and fit no path rule. Repeated rows are judged
    alike, also where page_ids are null or shared. An empty table gives no rows;
    other columns are not read.
    """
    host, path = parts(F.col("url"))
    out = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    out = out.withColumn("_fit", _fitting(F.col("host"), F.col("path"), path_rules))
    out = out.join(pattern_hits(pages, pattern_rules), "url", "left")
    return out.select(
        "page_id", "url", "host", "path", F.col("_fit.rule").alias("rule"), "pattern",
        F.coalesce(F.col("_fit.verdict"), F.when(F.col("pattern").isNotNull(), F.lit("block")), F.lit("allow")).alias("verdict"),
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_sql() -> str:
    """The same verdicts by testing every rule on every URL."""
    fits = " UNION ALL ".join(f"SELECT '{r.host}' AS h, '{r.path}' AS p, '{r.verdict}' AS v" for r in PATH_RULES)
    blocks = " OR ".join(f"regexp_matches(translate(url, '{UPPER}', '{LOWER}'), '{r.pattern}')" for r in PATTERN_RULES)
    return f"""
WITH rules AS ({fits}),
u AS (SELECT page_id, url,
        translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
        coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path,
        coalesce({blocks}, false) AS bad
      FROM pages),
f AS (SELECT u.*, (SELECT max({{'n': length(h || p), 'rule': h || p, 'v': v}}) FROM rules
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS r FROM u)
SELECT page_id, host, path, r.rule AS rule,
  coalesce(r.v, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM f
"""
