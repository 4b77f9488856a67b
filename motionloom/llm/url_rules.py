"""Operator 7: URL filter rules by a sort-merge range join. DataFrame functions only.

A host's key is its labels in reverse order, each with a dot after it
(``www.example.net`` gives ``net.example.www.``). A rule's host then covers
the interval of the keys that begin with its own, and a rule's path covers the
interval of the paths that begin with it. In both cases two intervals are
nested or apart, so one sweep serves both: the points and the ends of the
intervals are sorted together; the running sum of starts less ends is the
height of the stack, and the entry on top of a stack of height d is the last
interval that started at height d.

The hosts are swept first, by their top label. The rule host on top of the
stack brings those below it. Then the paths are swept, once for each rule host
on their host's stack, among that host's rules. Of the rules found the longest
decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Points of a sweep that go to one task, at least; with more rules there it is as many as those.
POINTS = 250_000


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) tuples as a DataFrame of rules."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def sweep(points: DataFrame, intervals: DataFrame, share: int = POINTS) -> DataFrame:
    """Points (part, key, point) with the ``value`` of the innermost interval of their part that has them, else null.

    intervals: part, key, value; an interval holds the keys that begin with
    its own. Keys are strings and differ within a part. They are compared by
    their UTF-8 bytes, and an interval ends with the byte FF, which no text
    has. A part with over ``share`` points is dealt to several tasks by a hash
    of the points, each with all of the part's intervals, but to so few that
    the copies of the intervals are no more than the points.
    """
    point = points.schema["point"].dataType.simpleString()
    value = intervals.schema["value"].dataType.simpleString()
    sizes = points.groupBy("part").agg(F.count("*").alias("points"))
    sizes = sizes.join(intervals.groupBy("part").agg(F.count("*").alias("rules")).hint("merge"), "part")
    # There are fewer parts to be dealt than points / share.
    wide = sizes.select("part", F.ceil(F.col("points") / F.greatest(F.lit(share), "rules")).cast("int").alias("salts")).filter("salts > 1")
    salts = F.coalesce("salts", F.lit(1))
    key = F.col("key").cast("binary")
    left = points.join(F.broadcast(wide), "part", "left")
    left = left.select("part", F.pmod(F.xxhash64("key", "point"), salts).cast("int").alias("salt"), key.alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("step"), "point", F.lit(None).cast(value).alias("value"))
    right = intervals.join(F.broadcast(wide), "part", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    none = F.lit(None).cast(point).alias("point")
    starts = right.select("part", "salt", key.alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step"), none, "value")
    ends = right.select("part", "salt", F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), none, F.lit(None).cast(value).alias("value"))
    so_far = Window.partitionBy("part", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = left.unionByName(starts).unionByName(ends).withColumn("height", F.sum("step").over(so_far))
    level = Window.partitionBy("part", "salt", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    events = events.filter("kind < 2").withColumn("top", F.last("value", ignorenulls=True).over(level))
    return events.filter("kind = 1").select("part", "point", F.when(F.col("height") > 0, F.col("top")).alias("value"))


def _clean_rules(rules: DataFrame) -> DataFrame:
    """One rule for each host and path, as (host, path, rule struct)."""
    rules = rules.filter(F.coalesce(F.col("host"), F.lit("")) != "").select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.withColumn("text", F.concat("host", "path"))
    one = F.struct(F.length("text").alias("size"), F.length("host").alias("host_size"), F.col("text").alias("rule"), "verdict")
    return rules.groupBy("host", "path").agg(F.max(one).alias("rule"))


def stacks(rules: DataFrame) -> DataFrame:
    """For each rule host: its key, and the rule hosts whose intervals hold it, itself included."""
    hosts = rules.select("host").distinct()
    labels = F.split("host", r"\.", -1)
    tails = hosts.withColumn("labels", labels).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("labels"))))
    tails = tails.select(F.col("host").alias("own"), F.array_join(F.expr("slice(labels, k, size(labels))"), ".").alias("host"))
    held = tails.join(hosts, "host").groupBy("own").agg(F.sort_array(F.collect_set("host")).alias("stack"))
    return held.select(reversed_key(F.col("own")).alias("key"), "stack")


def match_hosts(hosts: DataFrame, rules: DataFrame, share: int = POINTS) -> DataFrame:
    """hosts: distinct ``host`` values. Columns: host, stack (the rule hosts that hold it); hosts without any are left out."""
    top = F.substring_index("key", ".", 1).alias("part")
    intervals = stacks(rules).select(top, "key", F.col("stack").alias("value"))
    points = hosts.select(reversed_key(F.col("host")).alias("key"), F.col("host").alias("point")).select(top, "key", "point")
    return sweep(points, intervals, share).filter("value IS NOT NULL").select(F.col("point").alias("host"), F.col("value").alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", share: int = POINTS) -> DataFrame:
    """Columns: the id column, host, path, rule, verdict.

    A rule fits its host and all subdomains, if the url's path starts with the
    rule's. Of the fitting rules the longest (host and path together) wins; of
    equally long ones that with the longer host, then the greatest text; of
    several verdicts for one rule the greatest. Rules with no host are left
    out. Defined results: a null url, or one without ``://``, has an empty
    host and path, no rule and the default verdict; repeated rows give
    repeated results; empty tables give no rows (or, for empty rules,
    defaults). Only the two named columns are read.

    Shuffles: the distinct hosts and the distinct (host, path) of hosts that a
    rule holds, both summed up where they are read, and the pages once, by
    (host, path); a url with a large share of the rows is split by the
    adaptive skew join.
    """
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"))
    rows = rows.select("page", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = _clean_rules(rules)
    distinct = rows.filter("host <> ''").select("host", "path").distinct()
    held = distinct.join(match_hosts(rows.filter("host <> ''").select("host").distinct(), rules, share), "host")
    points = held.select(F.explode("stack").alias("part"), F.col("path").alias("key"), F.struct("host", "path").alias("point"))
    found = sweep(points, rules.select(F.col("host").alias("part"), F.col("path").alias("key"), F.col("rule").alias("value")), share)
    best = found.groupBy("point").agg(F.max("value").alias("best")).select("point.host", "point.path", "best")
    joined = rows.join(best, ["host", "path"], "left")
    return joined.select(F.col("page").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
