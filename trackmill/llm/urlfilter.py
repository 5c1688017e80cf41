"""URL filter: host-suffix and path-prefix expressions, joined to rules on short hashes.

Every URL is expanded into (host suffix, path directory) expressions. An equi-join on the
first 8 hex digits of their SHA-256 finds candidate rules; the whole digest and the rule's
whole path confirm them; the longest confirmed rule wins. The expansion is as deep as the
deepest rule, so long hosts and paths cost no more than the rules ask for.

Only DataFrame functions are used. One shuffle: a URL's candidates are folded to one long
before it (partial aggregation), whatever the number of rules that fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmill.sources.tables import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the query: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT = "allow"
SHORT = 8
_HOST_SPAN = 1 << 24  # above the length of any host


def url_host(url: Column) -> Column:
    """Between the first :// and the next of / ? # or the end, A-Z lower-cased; empty if there is no ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(host, path, verdict) of literal rules, as a local relation."""
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if not rules:
        return spark.sql("SELECT '' AS host, '' AS path, '' AS verdict WHERE false")
    rows = ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(host, path, verdict)")


def _directory(path: Column) -> Column:
    """The path up to its last slash, included."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def filter_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of urls; other columns are ignored.

    rules has host, path, verdict (allow or block); rows with a null in them are ignored. A
    rule fits its host and all subdomains when the url's path starts with the rule's path.
    The longest rule (host and path together) wins; of equally long ones that with the longer
    host; of contradicting copies of one rule, block. No rule: `default`, and rule is null.
    A null url, or one without ://, has an empty host and path. A null id stays a null id;
    repeated rows give repeated results; an empty table gives no rows.
    """
    rules = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), (F.col("verdict") == "block").cast("long").alias("r_block")).dropna()
    sizes = rules.agg(F.coalesce(F.max(F.size(F.split("r_host", r"\."))), F.lit(1)).alias("labels"), F.coalesce(F.max(F.size(F.split("r_path", "/"))), F.lit(1)).alias("parts")).first()
    digest = lambda host, path: F.sha2(F.concat(host, path), 256)
    rules = rules.withColumn("r_digest", digest(F.col("r_host"), _directory(F.col("r_path")))).withColumn("r_short", F.substring("r_digest", 1, SHORT))
    total = F.length("r_host") + F.length("r_path")
    rules = rules.withColumn("r_code", ((total.cast("long") * _HOST_SPAN + F.length("r_host")) * 2 + F.col("r_block")))

    url = F.col(url_col).cast("string")
    parts = urls.select(F.col(id_col).alias("k_id"), url_host(url).alias("k_host"), url_path(url).alias("k_path"))
    labels, dirs = F.split("k_host", r"\."), F.split("k_path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(sizes["labels"]))), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))
    depth = F.least(F.size(dirs) - 1, F.lit(sizes["parts"] - 1))
    prefixes = F.concat(F.array(F.lit("")), F.when(depth >= 1, F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(F.array_join(F.slice(dirs, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>")))
    digests = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: digest(s, p))))
    # the null digest at place 0 joins no rule: one row for each copy of a page, by which copies are counted
    wide = parts.select("k_id", "k_host", "k_path", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), digests)).alias("k_at", "k_digest")).withColumn("k_short", F.substring("k_digest", 1, SHORT))
    found = wide.join(rules, F.col("k_short") == F.col("r_short"), "left")
    fits = (F.col("k_digest") == F.col("r_digest")) & F.startswith(F.col("k_path"), F.col("r_path"))
    best = found.groupBy("k_id", "k_host", "k_path").agg(F.max(F.when(fits, F.col("r_code"))).alias("code"), F.count_if(F.col("k_at") == 0).alias("copies"))
    half = F.shiftright("code", 1)
    host_len = (half % _HOST_SPAN).cast("int")
    path_len = ((half / _HOST_SPAN).cast("long") - host_len).cast("int")
    rule = F.when(F.col("code").isNotNull(), F.concat(F.right("k_host", host_len), F.substring(F.col("k_path"), F.lit(1), path_len)))
    verdict = F.when(F.col("code").isNull(), F.lit(default)).when(F.col("code") % 2 == 1, F.lit("block")).otherwise(F.lit("allow"))
    one = best.select("k_id", "k_host", "k_path", "code", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_"))
    return one.select(F.col("k_id").alias(id_col), F.col("k_host").alias("host"), F.col("k_path").alias("path"), rule.alias("rule"), verdict.alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_table(spark))


SQL = {
    "op2_url_filter": """
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT row_number() OVER () AS n, page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest
), rules(r_host, r_path, r_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fit AS (
  SELECT n, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS k
  FROM parts JOIN rules ON (host = r_host OR suffix(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (n)
"""
}
