"""URL filters by host-suffix and path-prefix rules.

Each url is expanded into expressions, one for each suffix of its host at a dot and each prefix of its path that is as
long as some rule's path. Expressions and rules meet in an equi-join on a short prefix of their SHA-256; the full
digests then confirm, and of the rules that fit the longest wins. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadfast.llm.common import ascii_lower, table

#: Rules of the registered query: host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
DEFAULT = "allow"
#: Hex digits of the digest that the join compares first.
SHORT = 8
#: Up to so many rules the rules' side is broadcast (about 150 bytes each); beyond, both sides are dealt by the short hash.
BROADCAST_RULES = 200_000


def url_host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A to Z lower-cased; '' for null or where :// is missing."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end to the first ? or #; '' for null or where :// is missing."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "verdict")]))


def _digests(df: DataFrame) -> DataFrame:
    return df.withColumn("digest", F.sha2(F.col("expression"), 256)).withColumn("short", F.substring("digest", 1, SHORT))


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row for each row of pages: id, host, path, rule (host + path of the winner, null if none fits), verdict.

    rules has host, path and verdict. A rule fits its own host and all subdomains if the url's path starts with the
    rule's path. The longest host + path wins, then the longer host, then the verdict 'block'. Repeated rules count once.
    Null urls and urls without :// have empty host and path and fit no rule whose host is not empty. Null ids are kept.
    Repeated rows each get their row. Other columns of pages are dropped, so their names can't clash. No page or no rule: no row, or the default.
    """
    rules = rules.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("host", "path", "verdict"))).filter("host <> ''").distinct()
    by_rule = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' > 'allow'
    by_rule = _digests(by_rule.select(F.concat("host", F.lit("\n"), "path").alias("expression"), F.concat("host", "path").alias("rule"), F.length("host").alias("of_host"), "verdict"))
    n_rules = by_rule.count()
    if n_rules <= BROADCAST_RULES:
        by_rule = F.broadcast(by_rule)
    # how long rules' paths are: at most one number for each length, so a small list
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat_ws(".", F.slice(labels, k, F.size(labels) - k + 1)))
    reach = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")) if lengths else F.array().cast("array<int>")
    # urls of one host and path give the same expressions: each distinct pair is judged once, with map-side combine
    # those without a host fit no rule and meet none, as many as they may be
    known, unknown = urls.filter("host <> ''"), urls.filter("host = ''")
    pairs = known.select("host", "path").distinct()
    expressions = _digests(
        pairs.select("host", "path", F.explode(suffixes).alias("suffix"))
        .select("host", "path", "suffix", F.explode(reach).alias("n"))
        .select("host", "path", F.concat("suffix", F.lit("\n"), F.substring("path", F.lit(1), F.col("n"))).alias("expression"))
    )
    found = expressions.alias("e").join(by_rule.alias("r"), "short").filter("e.digest = r.digest and e.expression = r.expression")
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "of_host", F.col("r.verdict").alias("verdict"), "rule")).alias("best"))
    judged = known.join(best, ["host", "path"], "left").select("id", "host", "path", "best")
    judged = judged.unionByName(unknown.withColumn("best", F.lit(None).cast(best.schema["best"].dataType)))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), rule_table(spark))


OP5_SQL = r"""
with p as (
  select page_id,
         case when url is null or position('://' in url) = 0 then '' else substr(url, position('://' in url) + 3) end as rest
  from pages
), q as (
  select page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from p
), r(rhost, rpath, verdict) as (
  values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m as (
  select page_id, max_by(rhost || rpath, length(rhost || rpath)) as rule, max_by(verdict, length(rhost || rpath)) as verdict
  from q join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by page_id
)
select q.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') as verdict
from q left join m on q.page_id = m.page_id
"""
