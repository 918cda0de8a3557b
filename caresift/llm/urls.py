"""URL filters: a sort-merge range join of URLs with host and path rules, in DataFrame operations only.

A canonical key is the host with its labels reversed, a ``#`` (which neither host nor path holds), and the path.  At the
depth of a rule's host, all URLs that fit it have the rule's key as a prefix, so that a rule is the interval from its
key up to its key followed by byte 255.  Intervals of prefixes nest or are disjoint.  Starts, ends and the URLs' keys are
sorted together; a sweep over them keeps the stack of active rules as "the rule on top after this border", the top after
an end being the parent of the rule that ends.  The sweep is split by ranges of keys, and only the last border of each
range is carried to the next ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caresift.llm.common import unused
from caresift.operators.ordered import running_before

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _reversed(host: Column) -> Column:
    return F.reverse(F.split(host, "[.]", -1))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.concat_ws(".", labels), F.lit("#"), path).cast("binary")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(verdict, host, path)`` as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def prepared_rules(rules: DataFrame) -> DataFrame:
    """Distinct rules that can fit anything, with key, rule string and number of host labels; block beats allow."""
    host, path = F.translate("host", UPPER, LOWER), F.coalesce("path", F.lit(""))
    usable = F.col("host").isNotNull() & (host != "") & ~host.rlike("[/?#]") & ((path == "") | path.startswith("/")) & ~path.rlike("[?#]")
    return (
        rules.where(usable & F.col("verdict").isin("allow", "block"))
        .groupBy(host.alias("host"), path.alias("path")).agg(F.max("verdict").alias("verdict"))
        .select(_key(_reversed(F.col("host")), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), "verdict", F.size(F.split("host", "[.]", -1)).alias("labels"))
    )


def parents(rules: DataFrame) -> DataFrame:
    """``key, parent``: the innermost other rule around each rule, null for outermost ones."""
    step = F.col("step")
    borders = rules.select("key", F.col("key").alias("at"), F.lit(1).alias("step")).unionByName(rules.select("key", F.concat("key", F.lit(b"\xff")).alias("at"), F.lit(-1).alias("step")))
    deep = running_before(borders, [], ["at"], {"open": "step"}).where(step == 1).select("key", F.col("open").alias("level"))
    # The parent of a rule with n open ones around it is the last rule before it with n - 1 open ones.
    asked = deep.select(F.col("level"), "key", F.lit(1).alias("asks"), F.lit(None).cast("binary").alias("given"))
    given = deep.select((F.col("level") + 1).alias("level"), "key", F.lit(0).alias("asks"), F.col("key").alias("given"))
    return running_before(asked.unionByName(given), ["level"], ["key", "asks"], {"parent": "given"}, how="max").where("asks = 1").select("key", "parent")


def judged_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows and columns of ``pages`` plus ``host``, ``path``, ``rule`` and ``verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's.  Of several, the longest (host and path
    together) wins, then the one with more host labels; equal rules with both verdicts block.  Without a fitting rule
    ``rule`` is null and the verdict ``default``.  A null URL or one without ``://`` has an empty host and path.  Rules
    with a null or empty host, or whose path starts with another character than ``/``, fit nothing.  Columns of the
    four names are replaced.  URLs are judged once per distinct host and path.
    """
    source = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).drop("rule", "verdict")
    ready = prepared_rules(rules)
    deepest = ready.agg(F.max("labels")).first()[0] or 0
    if not deepest:
        return source.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    value = F.struct(F.length("rule").alias("size"), "labels", "rule", "verdict")
    rated = ready.select("key", value.alias("value"))
    around = parents(ready).join(rated.select(F.col("key").alias("parent"), F.col("value").alias("outer")), "parent", "left")
    starts = rated.select(F.col("key").alias("at"), F.lit(0).alias("kind"), "value")
    ends = around.select(F.concat("key", F.lit(b"\xff")).alias("at"), F.lit(0).alias("kind"), F.col("outer").alias("value"))
    borders = starts.unionByName(ends).select("at", "kind", F.struct("at", "value").alias("top"), F.lit("").alias("host"), F.lit("").alias("path"))

    labels = _reversed(F.col("host"))
    probes = (
        source.where(F.col("host") != "").select("host", "path").distinct()
        .withColumn("level", F.explode(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest)))))
        .select(_key(F.slice(labels, 1, F.col("level")), F.col("path")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(borders.schema["top"].dataType).alias("top"), "host", "path")
    )
    swept = running_before(borders.unionByName(probes), [], ["at", "kind", "host", "path"], {"active": "top"}, hot=True, how="max")
    name = unused(pages, "_best")
    best = swept.where("kind = 1").groupBy("host", "path").agg(F.max("active.value").alias(name))
    return source.join(best, ["host", "path"], "left").select(
        *[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")], "host", "path", F.col(name)["rule"].alias("rule"), F.coalesce(F.col(name)["verdict"], F.lit(default)).alias("verdict"),
    )
