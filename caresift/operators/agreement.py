"""Agreement between raters (JN-14, AG-14 … AG-18) without ever writing rater pairs.

Precision and recall of a rater against the others only need, per example, how many labels are true and false.  The
counts stand for the pairs: a rater whose label is true meets ``pos - 1`` agreeing and ``neg`` differing colleagues.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rater_counts(labels: DataFrame, example: Sequence[str] = ("example_id",)) -> DataFrame:
    """JN-14: each label with the number of true and false labels of the *other* raters of its example."""
    totals = labels.groupBy(*example).agg(F.count_if("label").alias("_p"), F.count_if(~F.col("label")).alias("_n"))
    own = F.col("label").cast("int")
    return labels.join(totals, list(example)).withColumns(
        {"others_pos": F.col("_p") - own, "others_neg": F.col("_n") - (1 - own)}
    ).drop("_p", "_n")


def model_counts(labels: DataFrame, predictions: DataFrame, example: Sequence[str] = ("example_id",)) -> DataFrame:
    """JN-14 for a model: its prediction with the number of true and false labels of all raters."""
    totals = labels.groupBy(*example).agg(
        F.count_if("label").alias("others_pos"), F.count_if(~F.col("label")).alias("others_neg")
    )
    return predictions.withColumnRenamed("grader_label", "label").join(totals, list(example))


def precision_recall(counts: DataFrame, by: Sequence[str] = (), cluster: str | None = "cluster") -> DataFrame:
    """AG-14: ``(by…, cluster, metric, pred, n, value)``, overall (null cluster) and per cluster; absent when n is 0."""
    self_pos = F.col("label")
    pos, neg = F.col("others_pos"), F.col("others_neg")
    combos = counts.groupBy(*by, *([cluster] if cluster else [])).agg(
        F.sum(F.when(self_pos, pos).otherwise(0)).alias("tp"), F.sum(F.when(self_pos, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(~self_pos, pos).otherwise(0)).alias("fn"), F.sum(F.when(~self_pos, neg).otherwise(0)).alias("tn"),
    )
    if cluster:
        sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")]
        sets = [list(by), [*by, cluster]]
        combos = combos.groupingSets(sets, *by, cluster).agg(*sums)
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(p).alias("pred"), (F.col(a) + F.col(b)).alias("n"), F.col(a).alias("agree"))
        for m, p, a, b in [("precision", "pos", "tp", "fp"), ("precision", "neg", "tn", "fn"),
                           ("recall", "pos", "tp", "fn"), ("recall", "neg", "tn", "fp")]
    ])
    keys = [*by, *([cluster] if cluster else [])]
    return (
        combos.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.metric", "r.pred", "r.n", "r.agree")
        .where(F.col("n") > 0).withColumn("value", F.col("agree") / F.col("n")).drop("agree")
    )


def f1_scores(pr: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG-15: ``(keys…, pred, n, value)`` from precision and recall of the same class."""
    pick = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    wide = pr.groupBy(*keys, "pred").agg(
        pick("precision", "value").alias("p"), pick("precision", "n").alias("np"),
        pick("recall", "value").alias("r"), pick("recall", "n").alias("nr"),
    ).where(F.col("p").isNotNull() & F.col("r").isNotNull())
    f1 = F.when((F.col("p") == 0) & (F.col("r") == 0), 0.0).otherwise(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")))
    return wide.select(*keys, "pred", (F.col("np") + F.col("nr") - F.col("p") * F.col("np")).alias("n"), f1.alias("value"))


def balanced(per_class: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG-16: mean of the positive and negative value, n added; only where both classes exist."""
    return (
        per_class.groupBy(*keys).agg(
            F.sum("n").alias("n"), F.sum("value").alias("_s"), F.count("value").alias("_c"), F.count(F.lit(1)).alias("_k"))
        .where(F.col("_k") == 2)
        .select(*keys, "n", F.when(F.col("_c") == 2, F.col("_s") / 2).alias("value"))
    )


def weighted(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG-17: n-weighted average of values."""
    return values.groupBy(*keys).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value"), F.sum("n").alias("n"))


def model_percentile(physicians: DataFrame, model: DataFrame, theme: str = "theme", min_n: float = 50) -> DataFrame:
    """AG-17: model value, physician average and the model's mid-rank percentile among physicians with enough samples.

    ``physicians`` is ``(theme, rater_id, n, value)``, ``model`` is ``(theme, value)``.
    """
    kept = physicians.where(F.col("n") > min_n)
    grand = physicians.groupBy(theme).agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("physician_avg"))
    joined = kept.join(model.select(theme, F.col("value").alias("model_value")), theme)
    below = (F.col("value") < F.col("model_value")).cast("double") + 0.5 * (F.col("value") == F.col("model_value")).cast("double")
    return joined.groupBy(theme).agg(
        F.count(F.lit(1)).alias("physicians"), F.max("model_value").alias("model_value"), (F.avg(below) * 100).alias("percentile")
    ).join(grand, theme)


def rater_rates(labels: DataFrame, by: Sequence[str] = ("cluster",)) -> DataFrame:
    """AG-18: number of labels and share of positive ones per rater and group."""
    return labels.groupBy("rater_id", *by).agg(
        F.count(F.lit(1)).alias("n_labels"), F.avg(F.col("label").cast("double")).alias("positive_rate")
    )


def exploded_labels(examples: DataFrame) -> DataFrame:
    """SRC-06, AG-30: parallel label and rater arrays to rows."""
    zipped = F.arrays_zip(F.col("binary_labels").alias("label"), F.col("anonymized_physician_ids").alias("rater_id"))
    return examples.select("prompt_id", "completion_id", F.col("category").alias("cluster"), F.posexplode(zipped).alias("pos", "l")).select(
        "prompt_id", "completion_id", "cluster", "pos", "l.label", "l.rater_id"
    )
