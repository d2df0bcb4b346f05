"""URL rules as a sort-merge range join.

A host is turned round (``a.example.net`` becomes ``net.example.a.``), so that a rule's host and all its
subdomains are one interval of the sorted keys. Intervals nest or are disjoint. Every rule host adds two
boundary rows, one where its interval opens and one behind its end; a boundary row holds the stack of rules
that are active from there on. URLs and boundaries are range-partitioned and swept in key order: a URL takes
the stack of the last boundary before it, and the longest rule of the stack whose path fits decides.

Only rule rows are joined with rule rows. The URL side is shuffled by range on (key, id), so that one host
with a third of all URLs is cut into many ranges, and no URL is ever compared with a rule outside its stack.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartlens.llm.common import ascii_lower
from cartlens.staging import stage

_PART = "_part"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where it is null or has no ``://``.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path
    follows it up to ``?``, ``#`` or the end.
    """
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot, as bytes: subdomains share the key as a prefix."""
    return F.encode(F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\.", -1))), F.lit(".")), "UTF-8")


def _boundaries(rules: DataFrame) -> DataFrame:
    """key, stack: the rules active from ``key`` on, up to the next boundary."""
    rules = (
        rules.select(
            ascii_lower(F.coalesce("host", F.lit(""))).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            "verdict",
        )
        .groupBy("host", "path")
        .agg(F.max(F.col("verdict") == "block").alias("block"))
        .select(
            "host",
            F.struct(
                (F.length("host") + F.length("path")).alias("size"),
                F.length("host").alias("host_size"),
                F.col("path"),
                F.concat("host", "path").alias("rule"),
                F.when(F.col("block"), "block").otherwise("allow").alias("verdict"),
            ).alias("rule"),
        )
    )
    hosts = rules.select("host").distinct()
    labels = F.split("host", r"\.", -1)
    above = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels) - i + 1)),
    )
    chain = hosts.select("host", F.posexplode(above).alias("up", "parent")).join(
        rules.withColumnRenamed("host", "parent"), "parent"
    )
    stacks = chain.groupBy("host").agg(
        F.array_sort(F.collect_list("rule")).alias("opened"),
        F.array_sort(F.collect_list(F.when(F.col("up") > 0, F.col("rule")))).alias("closed"),
    )
    key = host_key(F.col("host"))
    # No UTF-8 text has the byte FF, so key + FF sorts behind every key with that prefix.
    ends = F.array(
        F.struct(key.alias("key"), F.col("opened").alias("stack")),
        F.struct(F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.col("closed").alias("stack")),
    )
    return stacks.select(F.explode(ends).alias("b")).select("b.key", "b.stack")


def filter_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    url: str = "url",
    keep: Sequence[str] = ("page_id",),
    default: str = "allow",
) -> DataFrame:
    """``keep`` columns, host, path, rule (null if none fits) and verdict of every row of ``pages``.

    ``rules`` has host, path, verdict (``allow`` or ``block``). A rule fits its host and all subdomains where
    the URL's path starts with the rule's path. The longest rule (host and path together, then host) wins; for
    the same host and path twice, ``block`` wins. Null urls have an empty host and path, which only a rule with
    an empty host fits; repeated rows are judged each; an empty rule table gives ``default`` everywhere; other
    columns of ``pages``, also ones named like a result, are not read. Rule columns that are null count as empty.
    """
    host, path = url_parts(F.col(url))
    urls = pages.select(F.struct(*keep).alias("row"), host.alias("host"), path.alias("path")).select(
        host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "row", "host", "path"
    )
    bounds = _boundaries(rules)
    both = urls.unionByName(bounds.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    ranged = both.repartitionByRange("key", "kind", F.xxhash64("row", "path")).withColumn(
        _PART, F.spark_partition_id()
    )
    ranged = stage(ranged, "urls")

    # What each range hands on to the next ones: at most one row per range.
    tails = ranged.groupBy(_PART).agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("tail"))
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(_PART, F.last("tail", ignorenulls=True).over(earlier).alias("carried"))

    sweep = Window.partitionBy(_PART).orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = F.coalesce(F.last("stack", ignorenulls=True).over(sweep), F.col("carried"))
    fits = F.filter("active", lambda rule: F.startswith(F.col("path"), rule["path"]))
    return (
        ranged.join(F.broadcast(carried), _PART)
        .withColumn("active", active)
        .filter(F.col("kind") == 1)
        .select("row", "host", "path", F.array_max(fits).alias("best"))
        .select(
            "row.*",
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        )
    )
