"""URL filters by a sort-merge range join of reversed hosts with the intervals of host rules.

A host reads from its last label, each label closed by a dot, so that the subdomains of a host are one interval of
keys: from ``net.example.`` up to ``net.example/`` (a slash follows the dot in byte order).  Intervals of hosts nest
or are apart.  The rules' bounds cut the line of keys into pieces, each with one stack of active rules, the innermost
on top; a sorted sweep gives every distinct host the stack of the piece it lies in.  Pages then meet their host's
stack and take its longest rule that starts their path.

The sweep runs in parallel: range partitions are swept on their own, and the stack that is active at the end of one
is handed to the next.  Only distinct hosts are swept, so a host with a third of all pages is one row there; the
join back has one row for each host on its right, so runtime splitting of skewed partitions applies.

Defined cases: a null url, or one without ``://``, has empty host and path and fits no rule.  Repeated rules count
once.  Of rules of equal length the one with the longer host wins, then ``block``.  No rules: all get the default.
Extra columns pass through; the added ones (host, path, rule, verdict) replace columns of those names.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from arborlake.llm.common import ascii_lower, cut, table

#: (host, path, verdict); the rules of the registered query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, rule_verdict string")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def bounds(rules: DataFrame) -> DataFrame:
    """(key, stack): from each key on, the rules that are active there, longest first.

    A rule's interval lies in those of the hosts it is a subdomain of, so the stack at its start holds the rules of
    its own and of these hosts, and at its end those of these hosts only.
    """
    rules = rules.select("rule_host", "rule_path", "rule_verdict").distinct()
    hosts = rules.select(F.col("rule_host").alias("host")).distinct()
    labels = F.split("host", r"\.", -1)
    up = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = hosts.select("host", F.explode(up).alias("rule_host")).join(rules, "rule_host")
    entry = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host").alias("host_size"),
        F.col("rule_verdict").alias("verdict"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_path").alias("path"))
    at = wide.groupBy("host").agg(
        F.sort_array(F.collect_list(entry), asc=False).alias("own"),
        F.sort_array(F.collect_list(F.when(F.col("rule_host") != F.col("host"), entry)), asc=False).alias("outer"))
    start = host_key(F.col("host"))
    end = F.concat(F.substring(start, F.lit(1), F.length(start) - 1), F.lit("/"))
    return at.select(F.explode(F.array(
        F.struct(start.alias("key"), F.col("own").alias("stack")),
        F.struct(end.alias("key"), F.col("outer").alias("stack")))).alias("b")).select("b.*")


def sweep(keys: DataFrame, at: DataFrame) -> DataFrame:
    """(key, stack) of distinct ``keys``: the stack of the greatest bound up to the key, null before the first."""
    rows = at.select("key", F.lit(0).alias("kind"), "stack").unionByName(
        keys.select("key", F.lit(1).alias("kind")), allowMissingColumns=True)
    # Range splitters are sampled anew whenever a plan runs, so the parts are written once.
    parts = cut(rows.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "hosts")
    ends = parts.where("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("handed"))
    every = parts.select("part").distinct().join(ends, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    handed = every.select("part", F.last("handed", ignorenulls=True).over(before).alias("handed"))
    within = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = parts.withColumn("stack", F.last("stack", ignorenulls=True).over(within)).where("kind = 1")
    return swept.join(handed, "part").select("key", F.coalesce("stack", "handed").alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict."""
    host, path = split_url(F.col(url))
    kept = pages.drop("host", "path", "rule", "verdict") if url not in ("host", "path", "rule", "verdict") else pages
    pages = kept.withColumns({"host": host, "path": path})
    hosts = pages.select("host").distinct().withColumn("key", host_key(F.col("host")))
    stacks = sweep(hosts, bounds(rules)).where(F.size("stack") > 0).select(F.col("key").alias("_key"), F.col("stack").alias("_stack"))
    fits = F.filter("_stack", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.try_element_at(fits, F.lit(1))
    return (
        pages.withColumn("_key", host_key(F.col("host"))).join(stacks, "_key", "left")
        .withColumns({"rule": best["rule"], "verdict": F.coalesce(best["verdict"], F.lit(default))}).drop("_key", "_stack"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
   regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
named AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM split),
judged AS (SELECT *, CASE
   WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
   WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
   WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
   WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM named)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""
