"""Category graph, per-user overlay and retrieval plan (JN-07 … JN-12, AG-39, AG-40, SET-04).

The overlay works on one row per user: conditions and medications are arrays inside the profile row and the rule tables
are short literals.  Edge lookups join the category graph, which has one row per linked pair of categories; it is counted
and then broadcast (``checked_broadcast``), since a shuffle on its twenty categories would be as skewed as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caresift import constants as K
from caresift.functions import weights as W
from caresift.operators import kb
from caresift.operators.sizes import checked_broadcast, dealt, parts_of

#: So many users are read by one task, each of whom becomes up to some hundred boosts.
USER_ROWS = 20_000
#: The boosts, edges and history of so many queries or anchors meet in one task.
PLAN_ROWS = 5_000
EDGE = ["user_id", "src", "dst"]
BOOST_COLUMNS = ["user_id", "src", "dst", "boost", "source_type", "reason"]


def edges(docs: DataFrame) -> DataFrame:
    """``(src, dst, edge_type, base_weight)`` with ``cat:`` and ``sub:`` node names, from knowledge-base documents."""
    cats = docs.select(F.col("slug").alias("target"))
    cat = lambda c: F.concat(F.lit("cat:"), c)
    sub = F.concat_ws(":", F.lit("sub"), "category", "subcategory")
    ceiling = F.when(F.col("link_type") == "strong", F.lit(K.STRONG_MAX)).otherwise(F.lit(K.WEAK_MAX))
    # a weak link written after a strong one to the same target replaces it
    last = F.max_by(F.struct("link_type", "cross_hits"), F.struct(F.col("link_type") == "weak", "sec", "blk", "pos")).alias("l")
    linked = (
        kb.links(docs).join(cats, "target", "left_semi")
        .groupBy("category", "target").agg(last).select("category", "target", "l.*")
        .select(cat(F.col("category")).alias("src"), cat(F.col("target")).alias("dst"),
                F.col("link_type").alias("edge_type"), W.count_weight(F.col("cross_hits"), ceiling).alias("base_weight"))
    )
    children = kb.subcategories(docs).select("category", "subcategory").distinct()
    parent = F.lit("parent_child").alias("edge_type"), F.lit(K.PARENT_WEIGHT).alias("base_weight")
    down = children.select(cat(F.col("category")).alias("src"), sub.alias("dst"), *parent)
    up = children.select(sub.alias("src"), cat(F.col("category")).alias("dst"), *parent)
    rel = (
        kb.related(docs).join(cats, "target", "left_semi").select("category", "subcategory", "target").distinct()
        .select(sub.alias("src"), cat(F.col("target")).alias("dst"), F.lit("related").alias("edge_type"),
                F.lit(K.RELATED_WEIGHT).alias("base_weight"))
        .join(up.select("src", "dst"), ["src", "dst"], "left_anti")
    )
    return linked.unionByName(down).unionByName(up).unionByName(rel)


def nodes(docs: DataFrame) -> DataFrame:
    """``(node, node_type, category, display_name)``."""
    cats = docs.select(F.concat(F.lit("cat:"), "slug").alias("node"), F.lit("category").alias("node_type"),
                       F.col("slug").alias("category"), F.col("name").alias("display_name"))
    subs = kb.subcategories(docs).select(F.concat_ws(":", F.lit("sub"), "category", "subcategory").alias("node"),
                                         F.lit("subcategory").alias("node_type"), "category", F.col("name").alias("display_name"))
    return cats.unionByName(subs.dropDuplicates(["node"]))


def anchored(profiles: DataFrame, graph: DataFrame) -> DataFrame:
    """Active conditions whose subcategory is in the graph: ``(user_id, cat, sub, condition)``."""
    return _anchored(dealt(profiles, USER_ROWS), graph)


def _anchored(profiles: DataFrame, graph: DataFrame) -> DataFrame:
    conditions = (
        profiles.select("user_id", F.explode("conditions").alias("c")).where(F.coalesce("c.active", F.lit(True)))
        .select("user_id", F.concat(F.lit("cat:"), "c.category_id").alias("cat"),
                F.concat_ws(":", F.lit("sub"), "c.category_id", "c.subcategory_id").alias("sub"), F.col("c.name").alias("condition"))
    )
    known = graph.where(F.col("src").startswith("sub:")).select(F.col("src").alias("sub")).distinct()
    return conditions.join(checked_broadcast(known), "sub", "left_semi")


def anchor_boosts(anchors: DataFrame, graph: DataFrame) -> DataFrame:
    """JN-11: out-edges of the categories of anchored conditions: 0.30 on strong links, 0.25 on others."""
    out = checked_broadcast(graph.where(F.col("src").startswith("cat:") & F.col("dst").startswith("cat:")))
    return anchors.join(out, anchors["cat"] == out["src"]).select(
        "user_id", "src", "dst", F.when(F.col("edge_type") == "strong", 0.30).otherwise(0.25).alias("boost"),
        F.lit("anchor").alias("source_type"),
        F.format_string("User has %s in %s", "condition", F.substring("src", 5, 1000)).alias("reason"),
    )


def expand_boosts(anchors: DataFrame, graph: DataFrame) -> DataFrame:
    """JN-11: Related edges of anchored subcategories: 0.15."""
    rel = checked_broadcast(graph.where(F.col("edge_type") == "related").select("src", "dst"))
    return anchors.join(rel, anchors["sub"] == rel["src"]).select(
        "user_id", "src", "dst", F.lit(0.15).alias("boost"), F.lit("expand").alias("source_type"),
        F.concat(F.lit("Related link from anchored subcategory "), "src").alias("reason"),
    )


def _rules(rows: list[tuple], names: list[str]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def active_categories(conditions: Column) -> Column:
    kept = F.filter(conditions, lambda c: F.coalesce(c["active"], F.lit(True)))
    return F.array_distinct(F.transform(kept, lambda c: c["category_id"]))


def between_nodes(boosts: DataFrame, graph: DataFrame) -> DataFrame:
    """Only boosts both of whose ends are nodes of the graph."""
    nodes = checked_broadcast(graph.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    for end in ("src", "dst"):
        boosts = boosts.join(nodes.withColumnRenamed("node", end), end, "left_semi")
    return boosts


def comorbidity_boosts(profiles: DataFrame, graph: DataFrame, rules: list[tuple] = K.COMORBIDITY) -> DataFrame:
    """JN-09: rules both of whose categories the user has, between nodes of the graph.  One pass over the profile row."""
    table = _rules(rules, ["a", "b", "src", "dst", "boost", "reason"])
    have = active_categories(F.col("conditions"))
    boosts = (
        profiles.withColumn("_have", have)
        .select("user_id", F.explode_outer(F.filter(table, lambda r: F.array_contains("_have", r["a"]) & F.array_contains("_have", r["b"]))).alias("r"))
        .where(F.col("r").isNotNull())
        .select("user_id", F.concat(F.lit("cat:"), "r.src").alias("src"), F.concat(F.lit("cat:"), "r.dst").alias("dst"),
                "r.boost", F.lit("comorbidity").alias("source_type"), "r.reason")
    )
    return between_nodes(boosts, graph)


def demographic_boosts(profiles: DataFrame, anchors: DataFrame, graph: DataFrame, ages: list[tuple] = K.AGE_BOOSTS, sexes: list[tuple] = K.SEX_BOOSTS) -> DataFrame:
    """JN-10: age and sex rules, from every anchored category (from all the graph's categories when none is anchored)."""
    by_user = anchors.groupBy("user_id").agg(F.collect_set("cat").alias("_cats"))
    age_table = _rules(ages, ["lo", "hi", "dst", "boost", "reason"])
    sex_table = _rules(sexes, ["sex", "dst", "boost", "reason"])
    by_age = F.transform(
        F.filter(age_table, lambda r: (F.col("age") >= r["lo"]) & (F.col("age") < r["hi"])),
        lambda r: F.struct(r["dst"].alias("dst"), r["boost"].alias("boost"), F.concat(r["reason"], F.lit(" (age "), F.col("age").cast("string"), F.lit(")")).alias("reason")),
    )
    by_sex = F.transform(
        F.filter(sex_table, lambda r: F.col("sex") == r["sex"]),
        lambda r: F.struct(r["dst"].alias("dst"), r["boost"].alias("boost"), r["reason"].alias("reason")),
    )
    nodes = graph.select(F.explode(F.array("src", "dst")).alias("node")).where(F.col("node").startswith("cat:"))
    every = nodes.agg(F.sort_array(F.collect_set("node"))).scalar()  # the categories of one graph: a few dozen
    none = F.filter(by_sex, lambda _: F.lit(False))
    boosts = (
        profiles.join(by_user, "user_id", "left")
        .select("user_id", F.coalesce("_cats", every).alias("_cats"),
                F.explode_outer(F.concat(F.coalesce(by_age, none), F.coalesce(by_sex, none))).alias("r"))
        .where(F.col("r").isNotNull())
        .select("user_id", F.explode("_cats").alias("src"), F.concat(F.lit("cat:"), "r.dst").alias("dst"), "r.boost",
                F.lit("demographic").alias("source_type"), "r.reason")
        .where(F.col("src") != F.col("dst"))
    )
    return between_nodes(boosts, graph)


def medication_boosts(profiles: DataFrame, graph: DataFrame) -> DataFrame:
    """JN-12: each medication's category towards medications (0.10) and back (0.05), between nodes of the graph."""
    meds = F.lit(f"cat:{K.MEDICATIONS}")
    cat = F.concat(F.lit("cat:"), "m.category_id")
    taken = profiles.select("user_id", F.explode("medications").alias("m")).where(F.col("m.category_id") != K.MEDICATIONS)
    both = F.array(
        F.struct(cat.alias("src"), meds.alias("dst"), F.lit(0.10).alias("boost"),
                 F.format_string("User takes %s (%s)", "m.name", "m.category_id").alias("reason")),
        F.struct(meds.alias("src"), cat.alias("dst"), F.lit(0.05).alias("boost"),
                 F.format_string("Medication %s relates to %s", "m.name", "m.category_id").alias("reason")),
    )
    boosts = taken.select("user_id", F.explode(both).alias("b")).select(
        "user_id", "b.src", "b.dst", "b.boost", F.lit("medication").alias("source_type"), "b.reason"
    )
    return between_nodes(boosts, graph)


def user_overlay(profiles: DataFrame, graph: DataFrame) -> DataFrame:
    """All boosts of all users.  Users are dealt over tasks by their number, since each becomes many rows."""
    profiles = dealt(profiles, USER_ROWS)
    anchors = _anchored(profiles, graph)
    parts = [anchor_boosts(anchors, graph), expand_boosts(anchors, graph), comorbidity_boosts(profiles, graph),
             demographic_boosts(profiles, anchors, graph), medication_boosts(profiles, graph)]
    out = parts[0].select(*BOOST_COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*BOOST_COLUMNS))
    return out


def both_directions(boosts: DataFrame, parts: int) -> DataFrame:
    """Positive boosts summed per (user, src, dst) with each boost counted for the edge and its reverse, in ``parts`` tasks."""
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    # dealt by edge before they are summed: hardly two are the same edge of a user, so sums per task would only fill its memory
    each = boosts.where(F.col("boost") > 0).select("user_id", "boost", F.explode(ends).alias("e")).select("user_id", "e.src", "e.dst", "boost")
    return each.repartition(parts, *EDGE).groupBy(*EDGE).agg(F.sum("boost").alias("boosts"))


def retrieval_plan(queries: DataFrame, graph: DataFrame, boosts: DataFrame, history: DataFrame, anchors: DataFrame, now: Column) -> DataFrame:
    """JN-07, JN-08, PRJ-25: ``(query_id, category, weight, bucket)``.

    ``queries`` is ``(query_id, user_id, primary_category)``; ``history`` is ``(user_id, src, dst, cnt, last_used)``.
    What meets on (user, src, dst) is dealt over tasks by the number of queries and anchors, both counted first; users
    without either have boosts too, so there are never fewer tasks than Spark's own shuffles have.
    """
    least = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts_of(queries, PLAN_ROWS), parts_of(anchors, PLAN_ROWS), least)
    total = both_directions(boosts, parts)
    asked = queries.select("query_id", "user_id", F.concat(F.lit("cat:"), "primary_category").alias("src"))
    out = graph.where(F.col("src").startswith("cat:") & F.col("dst").startswith("cat:")).select("src", "dst", "base_weight")
    linked = checked_broadcast(out)
    direct = asked.join(linked, "src").select("query_id", "user_id", "src", "dst", "base_weight", F.lit(True).alias("direct"))
    known = out.select("src").union(out.select(F.col("dst").alias("src"))).distinct()
    extra = (
        asked.join(checked_broadcast(known), "src", "left_semi")
        .join(anchors.select("user_id", F.col("cat").alias("dst")).distinct(), "user_id")
        .where(F.col("src") != F.col("dst"))
        .join(linked.select("src", "dst"), ["src", "dst"], "left_anti")
        .select("query_id", "user_id", "src", "dst", F.lit(0.0).alias("base_weight"), F.lit(False).alias("direct"))
    )
    days = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_used").cast("timestamp"))) / 86_400_000_000)
    weighted = (
        direct.unionByName(extra).repartition(parts, *EDGE)
        .join(total, EDGE, "left")
        .join(history.repartition(parts, *EDGE), EDGE, "left")
        .where(F.col("direct") | F.col("boosts").isNotNull())
        .withColumn("weight", W.effective_weight(
            F.col("base_weight"), F.coalesce("boosts", F.lit(0.0)),
            F.when(F.col("direct") & F.col("cnt").isNotNull(), W.history_boost(F.col("cnt"), days)).otherwise(0.0)))
    )
    return weighted.select(
        "query_id", F.substring("dst", 5, 1000).alias("category"), "weight", W.load_bucket(F.col("weight")).alias("bucket")
    )


def baseline_weights(plans: DataFrame) -> DataFrame:
    """AG-39: a user's weight of a category is the largest over all primaries."""
    return plans.groupBy("user_id", "category").agg(F.max("weight").alias("weight"))


def adjusted_weights(base: DataFrame, adjustments: DataFrame, keys: list[str]) -> DataFrame:
    """SET-04, PRJ-26: guarded adjustments replace or extend the base weights; buckets are set anew."""
    moved = adjustments.select(*keys, "category", F.col("proposed"))
    return (
        base.join(moved, [*keys, "category"], "full_outer")
        .withColumn("weight", F.when(F.col("proposed").isNotNull(), W.guarded_adjustment(F.col("weight"), F.col("proposed"))).otherwise(F.col("weight")))
        .withColumn("bucket", W.load_bucket(F.col("weight"))).drop("proposed")
    )


def memory_weights(plan: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """AG-40: +0.10 per novel fact, then +0.15 per graduated fact, from 0.3 when absent, at most 0.95.

    ``facts`` is ``(keys…, category, graduated)``.
    """
    counted = facts.where(F.col("category") != "").groupBy(*keys, "category").agg(
        F.count_if(~F.col("graduated")).alias("fresh"), F.count_if(F.col("graduated")).alias("grown")
    )
    joined = plan.join(counted, [*keys, "category"], "full_outer")
    start = F.coalesce("weight", F.lit(0.3))
    after = F.when(F.coalesce("fresh", F.lit(0)) > 0, F.least(start + 0.10 * F.col("fresh"), F.lit(0.95))).otherwise(start)
    grown = F.when(F.coalesce("grown", F.lit(0)) > 0, F.least(after + 0.15 * F.col("grown"), F.lit(0.95))).otherwise(after)
    return joined.withColumn("weight", grown).drop("fresh", "grown")


def rebuilt_for(changed: DataFrame, graph: DataFrame, old_boosts: DataFrame) -> DataFrame:
    """STR-05: boosts after profile changes; other users keep theirs and query history is not touched."""
    kept = old_boosts.join(changed.select("user_id"), "user_id", "left_anti")
    return kept.select(*BOOST_COLUMNS).unionByName(user_overlay(changed, graph))
