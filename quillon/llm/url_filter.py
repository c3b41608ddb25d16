"""URL filters: rules by host and path, found by hash prefixes of a URL's expressions.

A rule is (verdict, host, path).  It fits a URL whose host is the rule's or a subdomain of it and whose path starts with the rule's; of
those that fit, the one with the longest text (host and path) wins, then the one with the longer host, then block.  A rule is keyed by its host
and its path up to the last slash.  A URL is expanded into the expressions that such keys can equal: its host's last labels, in the
numbers of labels that rules have, times its path up to a slash, in the numbers of slashes that keys have.  Expressions and keys meet in
an equi-join on the first 32 bits of their SHA-256; then the full digests, and the rest of the rule's path, are compared.  SQL functions only.

Rows are first counted by id, host, path and input partition, so repeated rows are worked on once, and the same partitioning serves the
choice of the longest rule.  Rules are broadcast if they are measured to be small; else they are dealt out by prefix and salt, since an expression such as ``com/`` may be
in a third of all URLs.

Defined results: a URL that is null or has no ``://`` has an empty host and path, and without a rule for those none fits; null and
repeated ids and repeated rows are kept, a row each; an empty table gives no rows; without rules every URL gets the default.  Very long URLs are
taken whole: the rules bound how many expressions there are.  Other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BROADCAST = 16 << 20
SALTS = 32
RULE = "verdict string, host string, path string"
# The rules of the query.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What lies behind the first ``://``: up to a slash, question or number sign in lower case (A-Z), then up to one of the latter two."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), CAPITALS, SMALL), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def short(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def keyed(rules: DataFrame) -> DataFrame:
    """rules with rule (its text), key_digest, key_short and the numbers of labels and slashes of its key; one for each host and path."""
    tidy = rules.select("verdict", F.translate("host", CAPITALS, SMALL).alias("host"), F.coalesce("path", F.lit("")).alias("path")).where("host is not null and verdict is not null")
    one = tidy.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block before allow
    folder = F.regexp_extract("path", "^(?s:.*/)?", 0)
    digest = F.sha2(F.concat("host", folder), 256)
    return one.select("verdict", "path", F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), labels(F.col("host")).alias("n_labels"), slashes(folder).alias("n_slashes"), digest.alias("key_digest"), short(digest).alias("key_short"))


def expressions(host: str, path: str, n_labels: list[int], n_slashes: list[int]) -> Column:
    """SQL for all expressions of a URL that a key can equal."""
    ints = lambda xs: f"cast(array({', '.join(map(str, sorted(xs)))}) as array<int>)"
    suffixes = f"transform(filter({ints(n_labels)}, k -> k <= length({host}) - length(replace({host}, '.', '')) + 1), k -> substring_index({host}, '.', -k))"
    prefixes = f"transform(filter({ints(n_slashes)}, k -> k <= length({path}) - length(replace({path}, '/', ''))), k -> if(k = 0, '', concat(substring_index({path}, '/', k), '/')))"
    return F.expr(f"flatten(transform({suffixes}, s -> transform({prefixes}, p -> concat(s, p))))")


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict (the rule's, else the default)."""
    known = keyed(rules)
    size, n_labels, n_slashes = known.agg(F.coalesce(F.sum(F.length("rule") + F.length("path") + 100), F.lit(0)), F.collect_set("n_labels"), F.collect_set("n_slashes")).first()
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.spark_partition_id().alias("part"))
    row = ["page_id", "host", "path", "part"]
    counted = rows.groupBy(*row).agg(F.count("*").alias("copies"))
    each = counted.withColumn("expression", F.explode_outer(expressions("host", "path", n_labels, n_slashes))).withColumn("digest", F.sha2("expression", 256)).withColumn("short", short(F.col("digest")))
    known = known.select("key_short", "key_digest", F.struct(F.length("rule").alias("length"), "host_length", "verdict", "rule", F.col("path").alias("rule_path")).alias("found"))
    if size <= MOST_BROADCAST:
        joined = each.join(F.broadcast(known), F.col("short") == F.col("key_short"), "left")
    else:
        each = each.withColumn("salt", F.pmod(F.xxhash64(*row), F.lit(SALTS)).cast("int"))
        known = known.withColumn("key_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = each.join(known, (F.col("short") == F.col("key_short")) & (F.col("salt") == F.col("key_salt")), "left")
    sure = (F.col("digest") == F.col("key_digest")) & F.startswith("path", F.col("found.rule_path"))
    best = joined.groupBy(*row).agg(F.max("copies").alias("copies"), F.max(F.when(sure, F.col("found"))).alias("best"))
    out = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, RULE)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


QUERIES = {"op12_url_filter": op12_url_filter}
_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE = {
    "op12_url_filter": f"""
with u as (select page_id, row_number() over () as r, case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), '{CAPITALS}', '{SMALL}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
k as (select * from (values {_VALUES}) as t(verdict, rule_host, rule_path)),
m as (select r, rule_host || rule_path as rule, verdict, row_number() over (partition by r order by length(rule_host || rule_path) desc, length(rule_host) desc, verdict desc) as place
  from p join k on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join (select * from m where place = 1) using (r)"""
}
