"""Analysis of evaluation results (AG-25 … AG-37, AG-46, WN-03, WN-09, WN-10, JN-15, JN-16)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caresift import constants as K
from caresift.functions import text as X
from caresift.operators import ordered
from caresift.operators.ordered import HOT_ROWS
from caresift.operators.sizes import checked_broadcast
from caresift.session import cut_lineage

#: Prompts of up to so many samples are paired inside their group: at most so many pairs a sample.
PAIR_ROWS = 64


def result_matrix(metrics: DataFrame, rows: Sequence[str], columns: str, values: Sequence, value: str = "value", agg=F.avg) -> DataFrame:
    """AG-25: one row per ``rows``, one column per given value of ``columns``."""
    return metrics.groupBy(*rows).agg(*[agg(F.when(F.col(columns) == v, F.col(value))).alias(str(v)) for v in values])


def lift(scores: DataFrame, by: Sequence[str], condition: str = "condition", value: str = "score") -> DataFrame:
    """AG-26: differences between the conditions ``baseline``, ``brain`` and ``full``; null where one is missing."""
    pick = lambda c: F.max(F.when(F.col(condition) == c, F.col(value)))
    wide = scores.groupBy(*by).agg(*[pick(c).alias(c) for c in ("baseline", "brain", "full")])
    return wide.withColumns({
        "brain_lift": F.col("brain") - F.col("baseline"), "full_lift": F.col("full") - F.col("baseline"),
        "full_vs_brain": F.col("full") - F.col("brain"),
    })


def theme_summary(examples: DataFrame, tags: str = "example_tags") -> DataFrame:
    """AG-27: examples per theme (category null) and per category within a theme, with percentages."""
    theme = F.get(F.filter(tags, lambda t: t.startswith("theme:")), F.lit(0))
    cats = F.filter(tags, lambda t: t.startswith("physician_agreed_category:"))
    rows = examples.select(theme.alias("theme"), F.explode(F.concat(F.array(F.lit(None).cast("string")), cats)).alias("category"))
    counts = rows.groupBy("theme", "category").agg(F.count(F.lit(1)).alias("cnt"))
    in_theme = F.max(F.when(F.col("category").isNull(), F.col("cnt"))).over(Window.partitionBy("theme"))
    total = F.sum(F.when(F.col("category").isNull(), F.col("cnt"))).over(Window.partitionBy())
    return counts.withColumn(
        "pct", F.when(F.col("category").isNull(), F.col("cnt") * 100.0 / total).otherwise(F.col("cnt") * 100.0 / in_theme)
    )


def criteria_summary(examples: DataFrame) -> DataFrame:
    """AG-27: rubric criteria per level and axis tag, with percentages of all criteria."""
    tags = examples.select(F.explode("rubrics").alias("r")).select(F.explode("r.tags").alias("tag"))
    kind = X.tag_prefix(F.col("tag"))
    counts = tags.where(kind.isin("level", "axis")).groupBy(kind.alias("kind"), "tag").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.withColumn("pct", F.col("cnt") * 100.0 / F.sum("cnt").over(Window.partitionBy("kind")))


QUANTILES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


def size_quantiles(df: DataFrame, keys: Sequence[str], value: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """AG-28: seven quantiles and the mean (q = null) of a size."""
    quantiles = ordered.exact_quantiles(df, keys, value, QUANTILES, hot_rows).select(*keys, "q", "value")
    means = df.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias("value")).select(*keys, F.lit(None).cast("double").alias("q"), "value")
    return quantiles.unionByName(means)


def quantile_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = 800) -> DataFrame:
    """AG-28 for sizes that keep arriving: one KLL sketch per group, ``(keys, n, sketch)``, to be written per day or load.

    Tasks build their own sketches before the shuffle, so a hot group moves a few kilobytes a task.  The rank error of a
    quantile is about 2.3 / ``k`` ** 0.97 of the rows of its group with 99 % confidence, 0.35 % as set.  Null values count nowhere;
    a group of nulls alone has n = 0.
    """
    number = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.count(number).alias("n"), F.kll_sketch_agg_double(number, k).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = QUANTILES, k: int = 800) -> DataFrame:
    """Quantiles of any number of written sketches, merged by ``keys``: ``(keys, n, q, value)``; rows are not read again."""
    merged = sketches.where(F.col("n") > 0).groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    ranks = F.array(*[F.lit(float(q)) for q in quantiles])
    pairs = F.arrays_zip(ranks.alias("q"), F.kll_sketch_get_quantile_double("sketch", ranks).alias("value"))
    return merged.select(*keys, "n", F.explode(pairs).alias("p")).select(*keys, "n", "p.q", "p.value")


def repeated_criteria(rubrics: DataFrame, criterion: str = "criterion") -> DataFrame:
    """AG-29: number of distinct criteria and of criteria seen more than once."""
    counts = rubrics.groupBy(criterion).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("distinct_criteria"), F.count_if(F.col("n") > 1).alias("repeated_criteria"))


def examples_with_tag(examples: DataFrame, tag: str = "level:cluster") -> DataFrame:
    """AG-29: examples with at least one criterion of the tag."""
    return examples.where(F.exists("rubrics", lambda r: F.array_contains(r["tags"], tag)))


def label_count_range(labels: DataFrame, cluster: str = "cluster") -> DataFrame:
    """AG-30: all labels, and the least, most and mean number per category."""
    counts = labels.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("labels"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.avg("n").alias("mean_n"))


def _subset_share(m: Column, n: Column, k: int) -> Column:
    """C(m, k) / C(n, k) without factorials."""
    share = F.lit(1.0)
    for j in range(k):
        share = share * (F.greatest(m - j, F.lit(0)) / (n - j))
    return share


def worst_at_k(scores: DataFrame, ks: Sequence[int], model: str = "model", prompt: str = "prompt_id", score: str = "score", hot_rows: int = HOT_ROWS) -> DataFrame:
    """AG-31 per prompt: mean over all k-subsets of the samples of their minimum; ``(model, prompt, k, value)``.

    Closed form on distinct scores: a score held by c samples with b smaller ones is the minimum of
    C(n-b,k) - C(n-b-c,k) of the C(n,k) subsets.  Prompts with fewer than k samples have no value for k.
    """
    keys = [model, prompt]
    counts = ordered.value_counts(scores, keys, score, hot_rows)
    sized = ordered.join_groups(counts, counts.groupBy(*keys).agg(F.sum("cnt").alias("n")), keys)
    left = F.col("n") - F.col("before")
    sums = [
        F.sum(F.when(F.col("n") >= k, F.col(score) * (_subset_share(left, F.col("n"), k) - _subset_share(left - F.col("cnt"), F.col("n"), k)))).alias(f"_w{k}")
        for k in ks
    ]
    wide = sized.groupBy(*keys).agg(*sums)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_w{k}").alias("value")) for k in ks])
    return wide.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.k", "r.value").where(F.col("value").isNotNull())


def mean_worst_at_k(per_prompt: DataFrame, model: str = "model") -> DataFrame:
    """AG-31: clipped mean over prompts."""
    return per_prompt.groupBy(model, "k").agg(X.clip01(F.avg("value")).alias("value"), F.count(F.lit(1)).alias("prompts"))


def run_variability(scores: DataFrame, model: str = "model", run: str = "run_id", score: str = "score") -> DataFrame:
    """AG-32: mean, min, max and population std over runs of the clipped mean score of a run."""
    runs = scores.groupBy(model, run).agg(X.clip01(F.avg(score)).alias("s"))
    return runs.groupBy(model).agg(
        F.avg("s").alias("mean"), F.min("s").alias("min"), F.max("s").alias("max"), F.stddev_pop("s").alias("std"), F.count("s").alias("runs")
    )


def _by_size(scores: DataFrame, prompt: str, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Samples of prompts with at most ``most`` of them, and those of larger prompts (None if a counting job finds none)."""
    sizes = scores.groupBy(prompt).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > most).select(prompt)
    if large.isEmpty():
        return scores, None
    large = checked_broadcast(cut_lineage(large))
    return ordered.join_groups(scores, large, [prompt], "left_anti"), ordered.join_groups(scores, large, [prompt], "left_semi")


def _paired_wins(scores: DataFrame, prompt: str, model: str, values: Sequence[str], decides: Callable[[Column, Column], Column]) -> DataFrame:
    """Wins of small prompts: a prompt's samples meet in one shuffle and are paired there; no pair is shuffled or written."""
    held = scores.groupBy(prompt).agg(F.collect_list(F.struct(F.col(model).alias("model"), *values)).alias("_s"))
    pairs = held.select(prompt, "_s", F.explode("_s").alias("_a")).select(prompt, "_a", F.explode("_s").alias("_b")).where(decides(F.col("_a"), F.col("_b")))
    return pairs.groupBy(prompt, F.col("_a.model").alias("model_a"), F.col("_b.model").alias("model_b")).agg(F.count(F.lit(1)).alias("wins"))


def wins(scores: DataFrame, model: str = "model", prompt: str = "prompt_id", score: str = "score", hot_rows: int = HOT_ROWS, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """JN-15: ``(prompt, model_a, model_b, wins)``: sample pairs in which a scored above b, without writing pairs.

    Prompts of up to ``pair_rows`` samples are paired inside their group, so only samples are shuffled.  In larger ones, for
    every distinct score of a prompt and every model of the prompt, the number of that model's samples below it
    comes from one running sum, so work grows with samples times models.  A null prompt or model is one like any other;
    samples without a score are in no pair.
    """
    scores = scores.where(F.col(score).isNotNull())
    small, large = _by_size(scores, prompt, min(pair_rows, hot_rows))
    found = _paired_wins(small, prompt, model, [F.col(score).alias("score")], lambda a, b: a["score"] > b["score"])
    return found if large is None else found.unionByName(_counted_wins(large, model, prompt, score, hot_rows))


def _counted_wins(scores: DataFrame, model: str, prompt: str, score: str, hot_rows: int) -> DataFrame:
    held = scores.groupBy(prompt, model, score).agg(F.count(F.lit(1)).alias("c"))
    models = held.select(prompt, model).distinct()
    levels = held.select(prompt, score).distinct()
    every = ordered.join_groups(levels, models, [prompt]).select(prompt, model, score, F.lit(0).cast("long").alias("c"))
    grid = every.unionByName(held).groupBy(prompt, model, score).agg(F.sum("c").alias("c"))
    # a model meets at most as many levels as its prompt has samples
    hot = ordered.has_hot_group(scores, [prompt], hot_rows)
    below = ordered.running_before(grid, [prompt, model], [score], {"below": "c"}, hot=hot)
    below = below.select(prompt, score, F.col(model).alias("model_b"), "below").where(F.col("below") > 0)
    return (
        ordered.join_groups(held, below, [prompt, score])
        .groupBy(prompt, F.col(model).alias("model_a"), "model_b").agg(F.sum(F.col("c") * F.col("below")).alias("wins"))
    )


def _close(a: Column, b: Column, limit: float) -> Column:
    return F.abs(a - b) / ((a + b) / 2) <= limit


def _length_bounds(length: Column, limit: float) -> tuple[Column, Column]:
    """Shortest and longest whole length within the symmetric relative difference, by the exact float test."""
    close = lambda b: _close(length, b, limit)
    lo0 = F.ceil(length * ((2 - limit) / (2 + limit)))
    hi0 = F.floor(length * ((2 + limit) / (2 - limit)))
    lo = F.when(close(lo0 - 1) & (lo0 > 1), lo0 - 1).when(close(lo0), lo0).otherwise(lo0 + 1)
    hi = F.when(close(hi0 + 1), hi0 + 1).when(close(hi0), hi0).otherwise(hi0 - 1)
    return lo, hi


def length_controlled_wins(scores: DataFrame, limit: float = 0.1, model: str = "model", prompt: str = "prompt_id",
                           score: str = "score", length: str = "length", hot_rows: int = HOT_ROWS, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """JN-15 with length control: pairs whose whole-number lengths differ by at most ``limit`` relative to their mean.

    Prompts of up to ``pair_rows`` samples are paired inside their group.  In larger ones a sample counts the samples of each model with a smaller score and a length in its window.
    Scores become ranks within the prompt; ``ranks below r`` is split into dyadic blocks (one per set bit of r), every
    sample is entered in the block of each level it belongs to, and within a block the lengths in a window are a
    difference of two running sums.  Work grows with samples times models times log(samples).  A null prompt or model is
    one like any other; samples without a score or a positive length are in no pair.
    """
    scores = scores.where((F.col(length) > 0) & F.col(score).isNotNull())
    small, large = _by_size(scores, prompt, min(pair_rows, hot_rows))
    values = [F.col(score).alias("score"), F.col(length).alias("length")]
    found = _paired_wins(small, prompt, model, values, lambda a, b: (a["score"] > b["score"]) & _close(a["length"], b["length"].cast("long"), limit))
    return found if large is None else found.unionByName(_counted_length_wins(large, limit, model, prompt, score, length, hot_rows))


def _counted_length_wins(scores: DataFrame, limit: float, model: str, prompt: str, score: str, length: str, hot_rows: int) -> DataFrame:
    # a block holds at most each sample of its prompt once and is asked about two ends of each
    hot = ordered.has_hot_group(scores, [prompt], hot_rows // 3)
    held = scores.groupBy(prompt, model, score, length).agg(F.count(F.lit(1)).alias("c"))
    distinct = held.select(prompt, score).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    ranks = ordered.running_before(distinct, [prompt], [score], {"rank": "_one"}, hot=hot).drop("_one")
    top = F.expr("greatest(1, cast(ceil(log2(_m + 1)) as int))")
    size = ranks.groupBy(prompt).agg(F.max("rank").alias("_m")).select(prompt, top.alias("_levels"))
    ranked = ordered.join_groups(ordered.join_groups(held, ranks, [prompt, score]), size, [prompt])
    level = F.explode(F.sequence(F.lit(0), F.col("_levels") - 1)).alias("level")
    block = F.expr("shiftright(rank, level)")

    entered = (
        ranked.select(prompt, F.col(model).alias("model_b"), length, "c", "rank", level)
        .groupBy(prompt, "model_b", "level", block.alias("block"), F.col(length).cast("long").alias("at")).agg(F.sum("c").alias("entered"))
        .select(prompt, "model_b", "level", "block", "at", F.lit(1).alias("kind"), "entered",
                F.lit(None).cast(scores.schema[model].dataType).alias("model_a"), F.lit(0).cast("long").alias("times"))
    )
    lo, hi = _length_bounds(F.col(length), limit)
    asking = (
        ranked.select(prompt, F.col(model).alias("model_a"), F.col("c").alias("times"), "rank", lo.alias("lo"), hi.alias("hi"), level)
        .where(F.expr("shiftright(rank, level) % 2 = 1"))
        .withColumn("block", block - 1)
        .select(prompt, "model_a", "times", "level", "block",
                F.explode(F.array(F.struct(F.col("lo").cast("long").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("hi").cast("long").alias("at"), F.lit(2).alias("kind")))).alias("e"))
        .groupBy(prompt, "model_a", "level", "block", "e.at", "e.kind").agg(F.sum("times").alias("times"))
    )
    opponents = entered.select(prompt, "model_b", "level", "block").distinct()
    asked = ordered.join_groups(asking, opponents, [prompt, "level", "block"]).withColumn("entered", F.lit(0).cast("long"))
    events = entered.unionByName(asked.select(entered.columns))
    counted = ordered.running_before(events, [prompt, "model_b", "level", "block"], ["at", "kind"], {"seen": "entered"}, hot=hot)
    signed = F.when(F.col("kind") == 2, F.col("seen")).otherwise(-F.col("seen")) * F.col("times")
    return (
        counted.where(F.col("kind") != 1).groupBy(prompt, "model_a", "model_b").agg(F.sum(signed).alias("wins"))
        .where(F.col("wins") > 0)
    )


def win_rates(win_counts: DataFrame, prompt: str = "prompt_id") -> DataFrame:
    """AG-33: mean over prompts of the share of decided pairs that a won; prompts with ties only are left out."""
    # both directions from one row: counts dealt by prompt stay where they are
    none = F.lit(0).cast("long")
    ways = F.array(
        F.struct(F.col("model_a"), F.col("model_b"), F.col("wins").alias("won"), none.alias("lost")),
        F.struct(F.col("model_b").alias("model_a"), F.col("model_a").alias("model_b"), none.alias("won"), F.col("wins").alias("lost")))
    both = win_counts.select(prompt, F.explode(ways).alias("_w")).select(prompt, "_w.*")
    per_prompt = both.groupBy(prompt, "model_a", "model_b").agg(F.sum("won").alias("won"), F.sum("lost").alias("lost"))
    rate = F.col("won") / (F.col("won") + F.col("lost"))
    return per_prompt.groupBy("model_a", "model_b").agg(F.avg(rate).alias("win_rate"), F.count(F.lit(1)).alias("prompts"))


def win_order(rates: DataFrame) -> DataFrame:
    """WN-09: models by their mean win rate, with rank."""
    means = rates.groupBy(F.col("model_a").alias("model")).agg(F.avg("win_rate").alias("mean_win_rate"))
    return means.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("mean_win_rate"), "model")))


def win_shrinkage(free: DataFrame, controlled: DataFrame) -> DataFrame:
    """AG-33: how much of the distance from one half disappears under length control."""
    c = controlled.select("model_a", "model_b", F.col("win_rate").alias("controlled"))
    return ordered.join_groups(free.select("model_a", "model_b", F.col("win_rate").alias("free")), c, ["model_a", "model_b"]).withColumn(
        "shrinkage", (F.col("free") - F.col("controlled")) / F.nullif(F.col("free") - 0.5, F.lit(0.0))
    )


def histogram(df: DataFrame, value: str, keys: Sequence[str] = (), bins: int = 20, lo: float | None = None, hi: float | None = None, symmetric: bool = False) -> DataFrame:
    """AG-34: density per bin.  Given bounds clip the values; otherwise bounds come from the data (per group)."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull())
    if lo is not None and hi is not None:
        rows = rows.withColumn("_v", F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), v)))
    else:
        rows = rows.withColumn("_v", v)
    # one row per distinct bin candidate would need bounds first: take them from a small aggregate
    least, most = F.min("_v"), F.max("_v")
    if symmetric:
        far = F.greatest(F.abs(least), F.abs(most))
        bounds = rows.groupBy(*keys).agg((-far).alias("_lo"), far.alias("_hi"), F.count(F.lit(1)).alias("_n"))
    else:
        bounds = rows.groupBy(*keys).agg(least.alias("_lo"), most.alias("_hi"), F.count(F.lit(1)).alias("_n"))
    if keys:
        joined = ordered.join_groups(rows, bounds, keys)
    else:
        bounds_row = bounds.select(F.struct("_lo", "_hi", "_n").alias("b")).scalar()
        joined = rows.withColumn("_b", bounds_row).withColumns({c: F.col("_b")[c] for c in ("_lo", "_hi", "_n")})
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counted = joined.groupBy(*keys, place.cast("long").alias("bin"), "_lo", "_hi", "_n").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.select(
        *keys, "bin", (F.col("_lo") + (F.col("bin") + 0.5) * width).alias("centre"), "cnt",
        (F.col("cnt") / F.nullif(F.col("_n") * width, F.lit(0.0))).alias("density"),
    )


def paired_differences(human: DataFrame, references: DataFrame, prompt: str = "prompt_id") -> DataFrame:
    """JN-16: human score minus the mean score of the references of the same prompt."""
    means = references.groupBy(prompt).agg(F.avg("score").alias("ref_mean"), F.count(F.lit(1)).alias("n_refs"))
    return human.join(means, prompt).select(prompt, "n_refs", (F.col("score") - F.col("ref_mean")).alias("diff"))


def difference_summary(diffs: DataFrame) -> DataFrame:
    """AG-35: share and mean size of positive and negative differences."""
    d = F.col("diff")
    return diffs.agg(
        F.avg((d > 0).cast("double")).alias("share_greater"), F.avg(F.when(d > 0, d)).alias("mean_greater"),
        F.avg((d < 0).cast("double")).alias("share_less"), F.avg(F.when(d < 0, d)).alias("mean_less"), F.count(F.lit(1)).alias("n"),
    )


def reference_completions(examples: DataFrame, group: str) -> DataFrame:
    """FLT-07: the reference completions of the examples of one completion group, one row each."""
    d = F.col("ideal_completions_data")
    return examples.where(d["ideal_completions_group"] == group).select(
        "prompt_id", F.posexplode(d["ideal_completions_ref_completions"]).alias("ref_idx", "completion")
    )


def correlations(df: DataFrame, x: str, y: str, by: Sequence[str] = ("model",), hot_rows: int = HOT_ROWS) -> DataFrame:
    """AG-36: Pearson, Spearman and least-squares line per group."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    ranked = ordered.mid_ranks(ordered.mid_ranks(rows, by, "_x", "_rx", hot_rows), by, "_y", "_ry", hot_rows)
    return ranked.groupBy(*by).agg(
        F.corr("_x", "_y").alias("pearson"), F.corr("_rx", "_ry").alias("spearman"),
        F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.count(F.lit(1)).alias("n"),
    )


def inference_cost(examples: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """AG-37: average cost per example from mean token counts and prices per million tokens, next to the mean score."""
    used = examples.where(F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull())
    means = used.groupBy(model).agg(F.avg("input_tokens").alias("i"), F.avg("output_tokens").alias("o"), F.avg("score").alias("score"))
    return means.join(prices, model).select(
        model, ((F.col("i") * F.col("input_price") + F.col("o") * F.col("output_price")) / 1e6).alias("cost"), "score"
    )


def family_cost_rank(costs: DataFrame, families: DataFrame, model: str = "model") -> DataFrame:
    """WN-10: rank by cost within a model family; models of no family have no rank."""
    window = Window.partitionBy("family").orderBy("cost", model)
    return costs.join(families, model, "left").withColumn(
        "family_rank", F.when(F.col("family").isNotNull(), F.row_number().over(window))
    )


def cost_frontier(costs: DataFrame, model: str = "model") -> DataFrame:
    """WN-10: models that score more than every cheaper one."""
    return ordered.running_max_frontier(costs, [], "cost", "score", [model])


def bar_table(metrics: DataFrame, prefix: str, as_error: bool = False) -> DataFrame:
    """AG-46: value with error bounds for the metrics ``prefix:…``; models ranked by overall score, then name.

    ``metrics`` is ``(model, metric, value, bootstrap_std)``.
    """
    overall = metrics.groupBy("model").agg(F.max(F.when(F.col("metric") == "overall_score", F.col("value"))).alias("_o"))
    order = overall.withColumn("model_rank", F.row_number().over(Window.partitionBy().orderBy(F.desc_nulls_last("_o"), "model"))).drop("_o")
    shown = F.when(F.lit(as_error), 1 - F.col("value")).otherwise(F.col("value"))
    return (
        metrics.where(F.col("metric").startswith(f"{prefix}:")).join(order, "model")
        .select("model", "model_rank", F.substring_index("metric", ":", -1).alias("cluster"), shown.alias("success_rate"),
                F.greatest(F.lit(0.0), shown - F.col("bootstrap_std")).alias("lower"),
                F.least(F.lit(1.0), shown + F.col("bootstrap_std")).alias("upper"))
    )


def same_metrics(metrics: DataFrame, run: str = "model") -> DataFrame:
    """SET-06: metrics that are not present in every run (empty when all runs have the same metrics)."""
    runs = metrics.select(run).distinct().groupBy().agg(F.count(F.lit(1)).alias("n"))
    per_metric = metrics.select(run, "metric").distinct().groupBy("metric").agg(F.count(F.lit(1)).alias("runs"))
    return per_metric.where(F.col("runs") < runs.scalar())
