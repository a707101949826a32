"""URL rules by a sort-merge range join, with DataFrame functions only.

A host is keyed by its labels in reverse, each ended by a mark that sorts below every label
character, so the host and all its subdomains are one interval of keys. Rule hosts open and close
their intervals; one sorted pass over hosts and these events keeps the stack of open rules: slot j
is the last interval opened at depth j, and slots up to the current depth are open. The path
prefixes of the open rules are then tested, and the longest rule wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swatchwork.runtime import united

#: (host, path, verdict) of the contract.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


@dataclass(frozen=True)
class UrlParams:
    """``otherwise``: verdict of a URL that no rule fits. ``lanes``: number of sorted passes that
    the URLs are dealt to, whatever their hosts; every lane gets all rule events. None: as many as
    the session has shuffle partitions."""

    otherwise: str = "allow"
    lanes: int | None = None


_LABEL_END, _CLOSE = "\x01", "\x02"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse, each with its end mark; control characters of odd hosts are set apart."""
    safe = F.regexp_replace(host, "[\x00-\x02]", "\x03")
    return F.concat(F.array_join(F.reverse(F.split(safe, r"\.", -1)), _LABEL_END), F.lit(_LABEL_END))


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, p: UrlParams = UrlParams()) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (page_id, url, ...).

    ``rules``: host, path, verdict. A null URL, or one without ``://``, has an empty host and path,
    which no rule fits. Of rules that fit, the longest (host and path together) wins, then the
    first by name, then by verdict. Repeated rows are judged alike; null rule fields leave a rule
    out; no rules leave every row to ``otherwise``. Other columns are ignored.
    """
    spark = pages.sparkSession
    lanes = p.lanes or int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    held = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").dropna().distinct()
    # One stack entry a rule host, with all its paths.
    by_host = held.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("path", "verdict"))).alias("paths")).withColumn("key", host_key(F.col("host")))
    depth = F.size(F.split("host", r"\.", -1))
    levels = by_host.agg(F.max(depth)).first()[0] or 0  # nested rule hosts have ever more labels
    entry = "struct<host:string,paths:array<struct<path:string,verdict:string>>>"
    lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    # Closings sort before openings, and both before the URLs of the same key.
    events = by_host.select(
        F.explode(F.array(
            F.struct(F.col("key").alias("key"), F.lit(1).alias("step"), F.struct("host", "paths").cast(entry).alias("opened")),
            F.struct(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit(_CLOSE)).alias("key"), F.lit(-1).alias("step"), F.lit(None).cast(entry).alias("opened")),
        )).alias("e")
    ).select(lane.alias("lane"), "e.*")
    none = lambda kind: F.lit(None).cast(kind)
    events = events.select("lane", "key", "step", "opened", none("long").alias("page_id"), none("string").alias("host"), none("string").alias("path"), F.lit(False).alias("is_url"))
    dealt = F.pmod(F.xxhash64("page_id", "path"), F.lit(lanes)).cast("int")
    urls = rows.select(dealt.alias("lane"), host_key(F.col("host")).alias("key"), F.lit(0).alias("step"), none(entry).alias("opened"), "page_id", "host", "path", F.lit(True).alias("is_url"))
    order = Window.partitionBy("lane").orderBy("key", "is_url", "step").rowsBetween(Window.unboundedPreceding, 0)
    swept = urls.transform(united, events).withColumn("depth", F.sum("step").over(order))
    slots = [F.last(F.when((F.col("step") == 1) & (F.col("depth") == j), F.col("opened")), ignorenulls=True).over(order).alias(f"slot{j}") for j in range(1, levels + 1)]
    stacked = swept.select("page_id", "host", "path", "is_url", "depth", *slots).filter("is_url")
    fits = F.array().cast("array<struct<size:int,rule:string,verdict:string>>")
    for j in range(1, levels + 1):
        s = F.col(f"slot{j}")
        named = _named(s)
        fits = F.concat(fits, F.when(F.col("depth") >= j, named).otherwise(F.array().cast("array<struct<size:int,rule:string,verdict:string>>")))
    best = F.try_element_at(F.array_sort(fits), F.lit(1))
    return stacked.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(p.otherwise)).alias("verdict"))


def _named(slot: Column) -> Column:
    """Rules of a stack entry whose path fits, longest first when sorted."""
    return F.transform(
        F.filter(slot["paths"], lambda r: F.startswith(F.col("path"), r["path"])),
        lambda r: F.struct((-F.length(slot["host"]) - F.length(r["path"])).alias("size"), F.concat(slot["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict")),
    )
