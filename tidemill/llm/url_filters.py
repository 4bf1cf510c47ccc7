"""URL filters by a sort-merge range join, in DataFrame functions alone.

A rule is a host, which stands for itself and all its subdomains, and a path
that the url's path begins with. Both are prefixes once hosts are turned
around: com.example. begins com.example.www. and nothing else. A prefix is the
interval of keys that begin with it, and such intervals nest or lie apart.

The sweep sorts keys and interval ends together. Rules are few beside keys, so
what the stack of open rules would hold is worked out for them beforehand: at
the start of an interval its own rule is on top, at its end the rule around
it. Each key then takes what the last end before it says. Keys are dealt by
range; a range starts with what the ranges before it left open, carried over
in one row a range. Keys are distinct hosts or paths, so a host with a third
of all pages is one key, and the pages themselves meet the result in an
equi-join that Spark splits where a key is hot.

Paths are swept first: the rule paths that a url's path begins with form a
chain, named by the longest. Hosts are swept within each rule path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import keep, small, width

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z as a-z) and path of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    empty = F.lit("")
    return F.coalesce(F.translate(host, _UPPER, _LOWER), empty), F.coalesce(path, empty)


def reversed_host(host: Column) -> Column:
    """com.example.www. for www.example.com; each label ends with a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _hex(c: Column) -> Column:
    """Text whose order is that of the bytes of ``c``."""
    return F.hex(F.encode(c, "UTF-8"))


def _boundaries(prefixes: DataFrame) -> DataFrame:
    """(scope, at, kind, top): from a place on, the innermost of the nested ``prefixes`` (scope, prefix); null for none.

    Prefixes are short, so the one around each is found among its own beginnings.
    """
    cuts = F.explode(F.sequence(F.lit(0), F.greatest(F.length("prefix") - 1, F.lit(0))))
    shorter = prefixes.where(F.length("prefix") > 0).withColumn("cut", cuts).select("scope", "prefix", F.substring(F.col("prefix"), F.lit(1), F.col("cut")).alias("begin"))
    known = prefixes.select("scope", F.col("prefix").alias("begin"))
    around = shorter.join(known, ["scope", "begin"]).groupBy("scope", "prefix").agg(F.max_by("begin", F.length("begin")).alias("around"))
    both = prefixes.join(around, ["scope", "prefix"], "left")
    opens = both.select("scope", _hex(F.col("prefix")).alias("at"), F.lit(1).alias("kind"), F.length("prefix").alias("deep"), F.col("prefix").alias("top"))
    # G comes after every hexadecimal digit, so an interval ends after all keys that begin with its prefix
    closes = both.select("scope", F.concat(_hex(F.col("prefix")), F.lit("G")).alias("at"), F.lit(0).alias("kind"), (-F.length("prefix")).alias("deep"), F.col("around").alias("top"))
    return opens.unionByName(closes)


def innermost(keys: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``keys`` (scope, key; distinct) with ``top``: the longest of ``prefixes`` (scope, prefix; distinct) that the key begins with, or null."""
    events = _boundaries(prefixes).select("scope", "at", "kind", "deep", F.struct("top").alias("says"), F.lit(None).cast("string").alias("key"))
    swept = keys.select("scope", _hex(F.col("key")).alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("deep"), F.lit(None).cast("struct<top:string>").alias("says"), "key")
    order = ["scope", "at", "kind", "deep"]
    dealt = events.unionByName(swept).repartitionByRange(width(keys.sparkSession), *order).withColumn("range", F.spark_partition_id())
    dealt = keep(dealt, "ranges")  # both readers below see the same ranges
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = dealt.withColumn("said", F.last(F.when(F.col("says").isNotNull(), F.struct("scope", "says")), ignorenulls=True).over(inside))
    # one row a range: what is open at its end, and so at the start of the next
    last = told.groupBy("range").agg(F.max_by(F.struct("said"), F.struct(*order)).alias("end"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("range", F.last(F.col("end.said"), ignorenulls=True).over(before).alias("carried"))
    found = told.where("kind = 2").join(F.broadcast(carried), "range")
    said = F.coalesce("said", "carried")
    return found.select("scope", "key", F.when(said["scope"] == F.col("scope"), said["says"]["top"]).alias("top"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``pages`` has page_id and url, ``rules`` host, path and verdict; other
    columns are left out. Of the rules that fit the longest wins, by host and
    path together; of equally long ones that with the longer host. A page that no rule
    fits has a null rule and the ``default`` verdict, as has a null or empty url, or one without ``://``. Rules
    repeated for one host and path count once, block before allow; rules with a null part are left out.
    A rule with an empty host fits urls without a host only. Repeated pages are judged each; page_id may be null.
    """
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = rules.where("host is not null and path is not null and verdict is not null")
    known = known.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = known.withColumn("prefix", reversed_host(F.col("host")))

    paths = known.select(F.lit("").alias("scope"), F.col("path").alias("prefix")).distinct()
    chain = innermost(read.select(F.lit("").alias("scope"), F.col("path").alias("key")).distinct(), paths)
    named = read.join(chain.select(F.col("key").alias("path"), F.col("top").alias("longest")).where("longest is not null"), "path", "left")

    # each rule path with those it begins with, itself included
    cuts = F.explode(F.sequence(F.lit(0), F.length("longest")))
    begun = paths.select(F.col("prefix").alias("longest")).withColumn("cut", cuts).select("longest", F.substring(F.col("longest"), F.lit(1), F.col("cut")).alias("scope"))
    begun = begun.join(paths.select(F.col("prefix").alias("scope")), "scope")
    hosts = named.where("longest is not null").select("host", "longest").distinct().join(begun, "longest").withColumn("key", reversed_host(F.col("host")))
    swept = innermost(hosts.select("scope", "key").distinct(), known.select(F.col("path").alias("scope"), "prefix"))
    ruled = known.select(F.col("path").alias("scope"), F.col("prefix").alias("top"), F.concat("host", "path").alias("rule"), "verdict")
    fitting = hosts.join(swept.where("top is not null"), ["scope", "key"]).join(ruled, ["scope", "top"])
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("top"), "rule"))
    # kept before the pages meet it, so that a hot host's pages can be split
    won = small(fitting.groupBy("host", "longest").agg(best.alias("won")), "won")
    judged = named.join(won, ["host", "longest"], "left")
    return judged.select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def keep_allowed(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id and url parts of the pages that are allowed."""
    return judge(pages, rules, default).where("verdict = 'allow'")
