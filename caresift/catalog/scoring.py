"""Rubric scores, metrics, agreement and benchmark accuracies on the given tables.

Roles: ``lineitem`` rows are graded rubric items (prompt = order, points = quantity - 25, met = returned, tag = line
status) and rater labels (example = order, rater = supplier, cluster = line status); ``orders`` are scored samples.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from caresift import constants as K
from caresift.catalog.registry import query, r6, sql_text, table
from caresift.functions import answers as A
from caresift.operators import agreement as G
from caresift.operators import failures
from caresift.operators import scoring as S


def items(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("example_id"), F.col("l_suppkey").alias("model"), (F.col("l_quantity") - 25).alias("points"),
        (F.col("l_returnflag") == "R").alias("criteria_met"), F.array("l_linestatus", F.concat(F.lit("line"), F.col("l_linenumber").cast("string"))).alias("tags"))


SCORE = "sum(CASE WHEN met THEN points ELSE 0 END) / nullif(sum(CASE WHEN points > 0 THEN points ELSE 0 END), 0)"
ITEMS_SQL = "it AS (SELECT l_orderkey AS example_id, l_quantity - 25 AS points, l_returnflag = 'R' AS met, l_linestatus AS status, 'line' || l_linenumber AS line FROM lineitem)"


@query("ag_09_rubric_score", f"WITH {ITEMS_SQL} SELECT example_id, round({SCORE}, 6) AS score FROM it GROUP BY 1")
def ag_09(spark, d):
    return S.example_scores(items(spark, d), ["example_id"]).withColumn("score", r6(F.col("score")))


TAGS_SQL = f"{ITEMS_SQL}, tg AS (SELECT example_id, unnest([status, line]) AS metric, points, met FROM it), ts AS (SELECT example_id, metric, {SCORE} AS value FROM tg GROUP BY 1, 2 HAVING {SCORE} IS NOT NULL)"


@query("ag_10_tag_scores", f"WITH {TAGS_SQL} SELECT example_id, metric, round(value, 6) AS value FROM ts")
def ag_10(spark, d):
    return S.tag_scores(items(spark, d), ["example_id"]).withColumn("value", r6(F.col("value")))


@query("ag_10_metric_rows", """
    WITH e AS (SELECT row_number() OVER () AS k, l_quantity - 25 AS p1, l_returnflag = 'R' AS m1, l_discount * 100 - 4 AS p2, l_linestatus = 'O' AS m2 FROM lineitem),
    t AS (SELECT k, unnest(['a', 'b', 'c']) AS metric, unnest([p1, p1, p2]) AS points, unnest([m1, m1, m2]) AS met FROM e UNION ALL SELECT k, unnest(['overall_score', 'x:all', 'overall_score', 'x:all']), unnest([p1, p1, p2, p2]), unnest([m1, m1, m2, m2]) FROM e),
    v AS (SELECT k, metric, sum(CASE WHEN met THEN points ELSE 0 END) / nullif(sum(CASE WHEN points > 0 THEN points ELSE 0 END), 0) AS value FROM t GROUP BY 1, 2)
    SELECT metric, count(value)::BIGINT AS rows_, round(sum(value), 3) AS total FROM v GROUP BY 1""")
def ag_10b(spark, d):
    item = lambda p, m, *tags: F.struct(p.alias("points"), m.alias("criteria_met"), F.array(*[F.lit(t) for t in tags]).alias("tags"))
    rubric = F.array(item(F.col("l_quantity") - 25, F.col("l_returnflag") == "R", "a", "b"), item(F.col("l_discount") * 100 - 4, F.col("l_linestatus") == "O", "c"))
    # every line is an example with two rubric items
    examples = table(spark, d, "lineitem").select("l_orderkey", rubric.alias("rubric_items"), F.array(F.lit("x:all")).alias("example_tags"))
    rows = S.metric_rows(examples, ["l_orderkey"])
    return rows.groupBy("metric").agg(F.count(F.lit(1)).alias("rows_"), F.round(F.sum("value"), 3).alias("total"))


METRICS_SQL = f"{ITEMS_SQL.replace('l_orderkey AS example_id,', 'l_orderkey AS example_id, l_suppkey AS model,')}, tg AS (SELECT example_id, model, unnest([status, line]) AS metric, points, met FROM it), ts AS (SELECT example_id, model, metric, {SCORE} AS value FROM tg GROUP BY 1, 2, 3 HAVING {SCORE} IS NOT NULL)"


def metrics(spark, d):
    return S.tag_scores(items(spark, d), ["example_id", "model"])


@query("ag_11_metric_stats", f"WITH {METRICS_SQL} SELECT model, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max, count(*)::BIGINT AS n_samples FROM ts GROUP BY 1, 2")
def ag_11(spark, d):
    out = S.metric_stats(metrics(spark, d), ["model"])
    return out.withColumns({c: r6(F.col(c)) for c in ("mean", "std", "min", "max")})


@query("ag_11_keyed_stats", f"""WITH {METRICS_SQL}, s AS (SELECT metric, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max, count(*)::DOUBLE AS n FROM ts GROUP BY 1)
    SELECT unnest([metric, metric || ':std', metric || ':min', metric || ':max', metric || ':n_samples']) AS key, round(unnest([mean, std, min, max, n]), 6) AS value FROM s""")
def ag_11b(spark, d):
    return S.keyed_stats(S.metric_stats(metrics(spark, d), []), []).withColumn("value", r6(F.col("value")))


@query("ag_12_clipped_stats", f"WITH {METRICS_SQL} SELECT model, metric, round(greatest(0, least(1, avg(value))), 6) AS mean, count(*)::BIGINT AS n_samples, round(stddev_pop(value) / sqrt(count(*)), 6) AS std_error FROM ts GROUP BY 1, 2")
def ag_12(spark, d):
    out = S.clipped_stats(metrics(spark, d), ["model"])
    return out.withColumns({c: r6(F.col(c)) for c in ("mean", "std_error")})


@query("ag_13_bootstrap_std", f"WITH {METRICS_SQL} SELECT metric, 1000::BIGINT AS replicates, TRUE AS near_analytic FROM ts GROUP BY metric")
def ag_13(spark, d):
    """Is the bootstrap within a tenth of the analytic error (or both next to nothing)?"""
    rows = metrics(spark, d)
    both = S.bootstrap_std(rows, []).join(S.clipped_stats(rows, []), "metric")
    near = F.abs(F.col("bootstrap_std") - F.col("std_error")) <= 0.1 * F.col("std_error") + 1e-9
    return both.select("metric", "replicates", near.alias("near_analytic"))


@query("ag_19_subject_accuracy", "SELECT lang, source, round(avg((quality = toxic)::INT), 6) AS accuracy, count(*)::BIGINT AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def ag_19(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return S.accuracy(rows, ["lang", "source"], "quality", "toxic").withColumn("accuracy", r6(F.col("accuracy")))


_GROUPS = "CASE s " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in K.SUBJECT_CATEGORIES.items()) + " END"
_SUBJECTS = ["anatomy", "econometrics", "virology", "astronomy", "philosophy", "prehistory", "sociology", "machine_learning"]


@query("ag_20_group_accuracy", f"""SELECT g, script, round(avg((l_returnflag = 'R')::INT), 6) AS accuracy, count(*)::BIGINT AS n FROM (
      SELECT *, {_GROUPS} AS g FROM (SELECT *, [{", ".join(sql_text(s) for s in _SUBJECTS)}][(l_partkey % 8 + 1)::INT] AS s, CASE WHEN l_suppkey % 3 = 0 THEN 'group_non_latin' ELSE 'group_latin' END AS script FROM lineitem)) GROUP BY 1, 2""")
def ag_20(spark, d):
    subject = F.element_at(F.array(*[F.lit(s) for s in _SUBJECTS]), (F.col("l_partkey") % 8 + 1).cast("int"))
    lang = F.when(F.col("l_suppkey") % 3 == 0, "ja").when(F.col("l_suppkey") % 3 == 1, "en").otherwise("sw")
    rows = table(spark, d, "lineitem").select(S.subject_group(subject).alias("g"), S.script_group(lang).alias("script"), "l_returnflag", F.lit("R").alias("right"))
    return S.accuracy(rows, ["g", "script"], "l_returnflag", "right").withColumn("accuracy", r6(F.col("accuracy")))


@query("ag_21_short_fact_metrics", """
    WITH s AS (SELECT l_linenumber, avg((l_returnflag = 'R')::INT) AS c, avg((l_returnflag = 'A')::INT) AS i, avg((l_returnflag = 'N')::INT) AS n FROM lineitem GROUP BY 1),
    a AS (SELECT *, c + i AS att, coalesce(c / nullif(c + i, 0), 0) AS acc FROM s)
    SELECT l_linenumber, round(c, 6) AS is_correct, round(i, 6) AS is_incorrect, round(n, 6) AS is_not_attempted, round(att, 6) AS is_given_attempted, round(acc, 6) AS accuracy_given_attempted,
      round(CASE WHEN acc + c > 0 THEN 2 * acc * c / (acc + c) ELSE 0 END, 6) AS f1 FROM a""")
def ag_21(spark, d):
    grade = F.translate("l_returnflag", "RAN", "ABC")
    out = S.short_fact_metrics(table(spark, d, "lineitem").select("l_linenumber", grade.alias("grade")), ["l_linenumber"])
    return out.select("l_linenumber", *[r6(F.col(c)).alias(c) for c in out.columns if c != "l_linenumber"])


@query("ag_22_judged_accuracy", "SELECT o_orderpriority, round(avg((o_orderstatus = 'F')::INT), 6) AS accuracy FROM orders GROUP BY 1")
def ag_22(spark, d):
    judgement = F.concat(F.lit("reasoning: x\nCorrect: "), F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("no"), F.lit("\nconfidence: 90"))
    rows = table(spark, d, "orders").select("o_orderpriority", A.judged_yes(judgement).alias("ok"))
    return rows.groupBy("o_orderpriority").agg(r6(F.avg(F.col("ok").cast("double"))).alias("accuracy"))


@query("ag_23_pass_at_k", """
    WITH p AS (SELECT l_orderkey, count(*) AS n, count_if(l_returnflag = 'R') AS c FROM lineitem GROUP BY 1)
    SELECT round(avg(CASE WHEN n - c < 1 THEN 1.0 ELSE c / n END), 6) AS pass_1, round(avg(CASE WHEN n - c < 2 THEN 1.0 ELSE 1 - ((n - c) * (n - c - 1)) / (n * (n - 1.0)) END), 6)::DOUBLE AS pass_2 FROM p""")
def ag_23(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("c"))
    return per.agg(r6(F.avg(S.pass_at_k(F.col("n"), F.col("c"), 1))).alias("pass_1"), r6(F.avg(S.pass_at_k(F.col("n"), F.col("c"), 2))).alias("pass_2"))


_DIMS = list(K.DIMENSION_WEIGHTS)


@query("ag_24_unified_score", f"""
    WITH x AS (SELECT l_orderkey, [{", ".join(sql_text(n) for n in _DIMS)}, 'other'][((l_linenumber - 1) % 6 + 1)::INT] AS dimension, max(l_discount) AS s FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, array_to_string(list_filter({sorted(_DIMS)}, lambda n: NOT list_contains(list(dimension), n)), ',') AS missing, count_if(dimension = 'other')::BIGINT AS unexpected,
      CASE WHEN count(*) = 5 AND count_if(dimension = 'other') = 0 THEN round(sum(s * CASE dimension {" ".join(f"WHEN {sql_text(n)} THEN {w}" for n, w in K.DIMENSION_WEIGHTS.items())} END), 6) END AS unified_score FROM x GROUP BY 1""")
def ag_24(spark, d):
    dim = F.element_at(F.array(*[F.lit(n) for n in [*_DIMS, "other"]]), (F.pmod(F.col("l_linenumber") - 1, F.lit(6)) + 1).cast("int"))
    rows = table(spark, d, "lineitem").select("l_orderkey", dim.alias("dimension"), F.col("l_discount").alias("score"))
    return S.unified_scores(rows, ["l_orderkey"]).withColumn("unified_score", r6(F.col("unified_score")))


@query("set_03_missing_dimensions", f"""
    WITH x AS (SELECT DISTINCT l_orderkey, [{", ".join(sql_text(n) for n in _DIMS)}, 'other'][((l_linenumber - 1) % 6 + 1)::INT] AS dimension FROM lineitem), g AS (SELECT l_orderkey, list(dimension) AS ds FROM x GROUP BY 1)
    SELECT missing, count(*)::BIGINT AS n FROM (SELECT unnest(list_filter({sorted(_DIMS)}, lambda n: NOT list_contains(ds, n))) AS missing FROM g) GROUP BY 1""")
def set_03(spark, d):
    dim = F.element_at(F.array(*[F.lit(n) for n in [*_DIMS, "other"]]), (F.pmod(F.col("l_linenumber") - 1, F.lit(6)) + 1).cast("int"))
    out = S.unified_scores(table(spark, d, "lineitem").select("l_orderkey", dim.alias("dimension"), F.lit(1.0).alias("score")), ["l_orderkey"])
    return out.where(F.col("missing") != "").select(F.explode(F.split("missing", ",")).alias("missing")).groupBy("missing").agg(F.count(F.lit(1)).alias("n"))


# --- agreement -------------------------------------------------------------------------------------------------

def labels(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("example_id"), F.col("l_suppkey").alias("rater_id"), (F.col("l_returnflag") == "R").alias("label"), F.col("l_linestatus").alias("cluster"))


LABELS_SQL = """lb AS (SELECT l_orderkey AS e, l_suppkey AS rater, l_returnflag = 'R' AS label, l_linestatus AS cluster, row_number() OVER () AS id FROM lineitem),
  pr AS (SELECT a.rater, a.cluster, a.label AS s, b.label AS o FROM lb a JOIN lb b ON a.e = b.e AND a.id <> b.id)"""


def sql_pr(src: str, by: str = "") -> str:
    b = by + ", " if by else ""
    one = lambda m, c, cl, p, v: f"SELECT {b}{cl} AS cluster, '{m}' AS metric, '{p}' AS pred, count(*)::BIGINT AS n, avg((s = o)::INT) AS value FROM {src} WHERE {c} = {v} GROUP BY {b}{'cluster' if cl == 'cluster' else ('1' if by else 'ALL')}"
    return " UNION ALL ".join(one(m, c, cl, p, v) for m, c in (("precision", "s"), ("recall", "o")) for cl in ("NULL", "cluster") for p, v in (("pos", "TRUE"), ("neg", "FALSE")))


def sql_f1(pr: str, keys: str) -> str:
    on = " AND ".join(f"p.{k.strip()} IS NOT DISTINCT FROM r.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {cols}, p.n + r.n - p.value * p.n AS n, CASE WHEN p.value = 0 AND r.value = 0 THEN 0 ELSE 2 * p.value * r.value / (p.value + r.value) END AS value
      FROM {pr} p JOIN {pr} r ON {on} WHERE p.metric = 'precision' AND r.metric = 'recall'"""


@query("jn_14_rater_pairs", f"WITH {LABELS_SQL} SELECT rater AS rater_id, cluster, s AS label, count_if(o)::BIGINT AS others_pos, count_if(NOT o)::BIGINT AS others_neg FROM pr GROUP BY 1, 2, 3")
def jn_14(spark, d):
    counts = G.rater_counts(labels(spark, d)).where(F.col("others_pos") + F.col("others_neg") > 0)
    return counts.groupBy("rater_id", "cluster", "label").agg(F.sum("others_pos").alias("others_pos"), F.sum("others_neg").alias("others_neg"))


@query("ag_14_precision_recall", f"WITH {LABELS_SQL}, p AS ({sql_pr('pr')}) SELECT cluster, metric, pred, n, round(value, 6) AS value FROM p")
def ag_14(spark, d):
    return G.precision_recall(G.rater_counts(labels(spark, d))).withColumn("value", r6(F.col("value")))


@query("ag_15_f1", f"WITH {LABELS_SQL}, p AS ({sql_pr('pr')}), f AS ({sql_f1('p', 'cluster, pred')}) SELECT cluster, pred, round(n, 4) AS n, round(value, 6) AS value FROM f")
def ag_15(spark, d):
    out = G.f1_scores(G.precision_recall(G.rater_counts(labels(spark, d))), ["cluster"])
    return out.withColumns({"n": F.round("n", 4), "value": r6(F.col("value"))})


@query("ag_16_balanced_f1", f"WITH {LABELS_SQL}, p AS ({sql_pr('pr', 'rater')}), f AS ({sql_f1('p', 'rater, cluster, pred')}) SELECT rater AS rater_id, cluster, round(sum(n), 4) AS n, round(avg(value), 6) AS value FROM f GROUP BY 1, 2 HAVING count(*) = 2")
def ag_16(spark, d):
    pr = G.precision_recall(G.rater_counts(labels(spark, d)), ["rater_id"])
    out = G.balanced(G.f1_scores(pr, ["rater_id", "cluster"]), ["rater_id", "cluster"])
    return out.withColumns({"n": F.round("n", 4), "value": r6(F.col("value"))})


@query("ag_17_model_percentile", f"""
    WITH {LABELS_SQL}, p AS ({sql_pr('pr', 'rater')}), f AS ({sql_f1('p', 'rater, cluster, pred')}), b AS (SELECT rater, cluster, sum(n) AS n, avg(value) AS value FROM f WHERE cluster IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 2),
    w AS (SELECT cluster AS theme, sum(value * n) / sum(n) AS avg_ FROM b GROUP BY 1), k AS (SELECT b.*, avg_ FROM b JOIN w ON w.theme = b.cluster WHERE n > 50)
    SELECT cluster AS theme, count(*)::BIGINT AS physicians, round(avg_, 6) AS physician_avg, round(avg((value < avg_)::INT + 0.5 * (value = avg_)::INT) * 100, 4) AS percentile FROM k GROUP BY 1, avg_""")
def ag_17(spark, d):
    pr = G.precision_recall(G.rater_counts(labels(spark, d)), ["rater_id"])
    per = G.balanced(G.f1_scores(pr, ["rater_id", "cluster"]), ["rater_id", "cluster"]).where(F.col("cluster").isNotNull()).withColumnRenamed("cluster", "theme")
    model = G.weighted(per, ["theme"])
    out = G.model_percentile(per, model, "theme", 50)
    return out.select("theme", "physicians", r6(F.col("physician_avg")).alias("physician_avg"), F.round("percentile", 4).alias("percentile"))


@query("ag_18_rater_rates", "SELECT l_suppkey AS rater_id, l_linestatus AS cluster, count(*)::BIGINT AS n_labels, round(avg((l_returnflag = 'R')::INT), 6) AS positive_rate FROM lineitem GROUP BY 1, 2")
def ag_18(spark, d):
    return G.rater_rates(labels(spark, d)).withColumn("positive_rate", r6(F.col("positive_rate")))


# --- failures --------------------------------------------------------------------------------------------------

@query("ag_42_failed_items", """
    SELECT l_orderkey || '-' || l_linenumber AS prompt_id, 'q' || l_suppkey AS query, 'r' || l_partkey AS response, 'size' AS criterion, l_quantity - 25 AS points FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity > 25""")
def ag_42(spark, d):
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    rows = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("prompt_id"),
        F.array(say("user", F.lit("before")), say("assistant", F.lit("hm")), say("user", F.concat(F.lit("q"), F.col("l_suppkey").cast("string")))).alias("prompt"),
        F.array(say("assistant", F.concat(F.lit("r"), F.col("l_partkey").cast("string")))).alias("completion"),
        F.array(F.struct(F.lit("size").alias("criterion"), (F.col("l_quantity") - 25).alias("points"), F.array(F.lit("t")).alias("tags"), (F.col("l_returnflag") == "R").alias("criteria_met"), F.lit("e").alias("explanation"))).alias("rubric_items"))
    return failures.failed_items(rows).select("prompt_id", "query", "response", "criterion", "points")


def tagged(spark, d):
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").select(F.concat_ws("_", "event_type", k.cast("string")).alias("tag"), F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("example_id"))


TAGGED_SQL = "tg AS (SELECT event_type || '_' || (props->>'$.k') AS tag, user_id AS run FROM events)"
ALIAS_SQL = "al AS (SELECT DISTINCT 'click_' || (props->>'$.k') AS new_tag, 'view_' || (props->>'$.k') AS existing_tag FROM events WHERE (props->>'$.k')::INT < 50)"


@query("ag_43_pattern_counts", f"""WITH {TAGGED_SQL}, c AS (SELECT tag, count(*)::BIGINT AS cnt, max(run) AS last_run FROM tg GROUP BY 1)
    SELECT tag, cnt, last_run, tag LIKE 'error%' AS graduated, cnt >= 20 AND tag NOT LIKE 'error%' AS ready FROM c""")
def ag_43(spark, d):
    done = tagged(spark, d).where(F.col("tag").startswith("error")).select("tag").distinct()
    return failures.pattern_counts(tagged(spark, d), done, ready_at=20)


@query("ag_43_stale_patterns", f"WITH {TAGGED_SQL} SELECT tag, max(run) AS last_run FROM tg WHERE tag LIKE 'error%' GROUP BY 1 HAVING 170 - max(run) >= 22")
def ag_43b(spark, d):
    done = tagged(spark, d).where(F.col("tag").startswith("error")).select("tag").distinct()
    return failures.stale_patterns(failures.pattern_counts(tagged(spark, d), done), 170, 22).select("tag", "last_run")


def aliases(spark, d):
    k = F.from_json("props", "k int")["k"]
    return table(spark, d, "events").where(k < 50).select(F.concat(F.lit("click_"), k.cast("string")).alias("new_tag"), F.concat(F.lit("view_"), k.cast("string")).alias("existing_tag")).distinct()


@query("jn_18_merged_tags", f"WITH {TAGGED_SQL}, {ALIAS_SQL} SELECT coalesce(existing_tag, tag) AS tag, count(*)::BIGINT AS n, count(existing_tag)::BIGINT AS merged FROM tg LEFT JOIN al ON new_tag = tag GROUP BY 1")
def jn_18(spark, d):
    return failures.merged_tags(tagged(spark, d), aliases(spark, d)).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_if("merged").alias("merged"))


@query("ag_45_run_summary", f"""WITH {TAGGED_SQL}, {ALIAS_SQL}, m AS (SELECT coalesce(existing_tag, tag) AS tag, existing_tag IS NOT NULL AS merged FROM tg LEFT JOIN al ON new_tag = tag),
    p AS (SELECT tag, count(*) AS n, count_if(merged) AS m FROM m GROUP BY 1), k AS (SELECT 'view_' || l_linenumber AS tag, min(l_suppkey) AS cnt FROM lineitem GROUP BY 1)
    SELECT sum(n)::BIGINT AS failures_analyzed, count_if(cnt IS NULL)::BIGINT AS new_tags, sum(m)::BIGINT AS merged_tags, count_if(n + coalesce(cnt, 0) >= 30)::BIGINT AS graduated FROM p LEFT JOIN k USING (tag)""")
def ag_45(spark, d):
    known = table(spark, d, "lineitem").groupBy(F.concat(F.lit("view_"), F.col("l_linenumber").cast("string")).alias("tag")).agg(F.min("l_suppkey").alias("cnt")).withColumn("graduated", F.lit(False))
    return failures.run_summary(failures.merged_tags(tagged(spark, d), aliases(spark, d)), known, 30)
