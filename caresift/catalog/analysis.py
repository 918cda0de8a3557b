"""Analysis of evaluation results on the given tables.

Roles: ``orders`` are scored samples (model = priority, prompt = customer, score = price, length = day of the year);
conversations, customers and parts stand in where sizes, prices or families are needed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from caresift.catalog.registry import query, r6, table
from caresift.operators import analysis as A
from caresift.operators import ordered

MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def samples(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("model"), F.col("o_custkey").alias("prompt_id"), (F.col("o_totalprice") / 500000).alias("score"),
        F.dayofyear("o_orderdate").cast("long").alias("length"), F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("run_id"))


S_SQL = "s AS (SELECT o_orderpriority AS model, o_custkey AS prompt_id, o_totalprice / 500000 AS score, dayofyear(o_orderdate) AS length, o_orderdate AS date, o_orderstatus AS run_id, o_orderkey AS k FROM orders)"


@query("ag_25_result_matrix", f"WITH {S_SQL} SELECT run_id, " + ", ".join(f"round(avg(CASE WHEN model = '{m}' THEN score END), 6) AS \"{m}\"" for m in MODELS) + " FROM s GROUP BY 1")
def ag_25(spark, d):
    out = A.result_matrix(samples(spark, d), ["run_id"], "model", MODELS, "score")
    return out.select("run_id", *[r6(F.col(f"`{m}`")).alias(m) for m in MODELS])


@query("ag_26_lift", f"""WITH {S_SQL}, w AS (SELECT prompt_id, max(CASE WHEN model = '1-URGENT' THEN score END) AS b, max(CASE WHEN model = '2-HIGH' THEN score END) AS m, max(CASE WHEN model = '5-LOW' THEN score END) AS f FROM s GROUP BY 1)
    SELECT prompt_id, round(m - b, 6) AS brain_lift, round(f - b, 6) AS full_lift, round(f - m, 6) AS full_vs_brain FROM w""")
def ag_26(spark, d):
    condition = F.when(F.col("model") == "1-URGENT", "baseline").when(F.col("model") == "2-HIGH", "brain").when(F.col("model") == "5-LOW", "full")
    out = A.lift(samples(spark, d).withColumn("condition", condition), ["prompt_id"])
    return out.select("prompt_id", *[r6(F.col(c)).alias(c) for c in ("brain_lift", "full_lift", "full_vs_brain")])


@query("ag_27_theme_summary", """
    WITH r AS (SELECT 'theme:' || c_mktsegment AS theme, 'physician_agreed_category:' || c_nationkey AS cat FROM customer),
    c AS (SELECT theme, NULL AS category, count(*)::BIGINT AS cnt FROM r GROUP BY 1 UNION ALL SELECT theme, cat, count(*)::BIGINT FROM r GROUP BY 1, 2)
    SELECT theme, category, cnt, round(CASE WHEN category IS NULL THEN cnt * 100.0 / (SELECT count(*) FROM r) ELSE cnt * 100.0 / max(CASE WHEN category IS NULL THEN cnt END) OVER (PARTITION BY theme) END, 6) AS pct FROM c""")
def ag_27(spark, d):
    tags = F.array(F.lit("other"), F.concat(F.lit("theme:"), "c_mktsegment"), F.concat(F.lit("physician_agreed_category:"), F.col("c_nationkey").cast("string")))
    return A.theme_summary(table(spark, d, "customer").select(tags.alias("example_tags"))).withColumn("pct", r6(F.col("pct")))


@query("ag_27_criteria_summary", """
    WITH t AS (SELECT 'level' AS kind, 'level:' || l_linestatus AS tag FROM lineitem UNION ALL SELECT 'axis', 'axis:' || l_returnflag FROM lineitem), c AS (SELECT kind, tag, count(*)::BIGINT AS cnt FROM t GROUP BY 1, 2)
    SELECT *, round(cnt * 100.0 / sum(cnt) OVER (PARTITION BY kind), 6) AS pct FROM c""")
def ag_27b(spark, d):
    tags = F.array(F.concat(F.lit("level:"), "l_linestatus"), F.concat(F.lit("axis:"), "l_returnflag"), F.lit("plain"))
    return A.criteria_summary(table(spark, d, "lineitem").select(F.array(F.struct(tags.alias("tags"))).alias("rubrics"))).withColumn("pct", r6(F.col("pct")))


@query("ag_28_size_quantiles", """
    WITH v AS (SELECT role, length(text) AS n FROM conversations)
    SELECT role, unnest([0, 0.05, 0.25, 0.5, 0.75, 0.95, 1])::DOUBLE AS q, round(unnest(quantile_cont(n, [0, 0.05, 0.25, 0.5, 0.75, 0.95, 1])), 6)::DOUBLE AS value FROM v GROUP BY 1
    UNION ALL SELECT role, NULL, round(avg(n), 6) FROM v GROUP BY 1""")
def ag_28(spark, d):
    sizes = table(spark, d, "conversations").select("role", F.length("text").alias("n"))
    return A.size_quantiles(sizes, ["role"], "n").withColumn("value", r6(F.col("value")))


@query("ag_28_merged_sketches", """
    SELECT l_returnflag, count(l_extendedprice)::BIGINT AS n, q, TRUE AS within FROM lineitem, unnest([0, 0.05, 0.25, 0.5, 0.75, 0.95, 1]::DOUBLE[]) AS t(q) GROUP BY 1, 3""")
def ag_28b(spark, d):
    """Sketches per ship year, merged; ranks of their quantiles among all rows are within the stated error."""
    rows = table(spark, d, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("year"), "l_extendedprice")
    found = A.sketched_quantiles(A.quantile_sketches(rows, ["l_returnflag", "year"], "l_extendedprice"), ["l_returnflag"])
    wide = found.groupBy("l_returnflag").agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("q", "value"))).alias("at"))
    value = F.col("l_extendedprice").cast("double")
    counts = [(F.count_if(value < F.col("at")[F.lit(q)]), F.count_if(value <= F.col("at")[F.lit(q)])) for q in A.QUANTILES]
    ranks = F.array(*[F.struct(F.lit(q).alias("q"), low.alias("low"), high.alias("high")) for q, (low, high) in zip(A.QUANTILES, counts)])
    error = 0.0035 * F.col("n") + 1
    return (
        rows.join(F.broadcast(wide), "l_returnflag").groupBy("l_returnflag", "n").agg(ranks.alias("ranks"))
        .select("l_returnflag", "n", F.explode("ranks").alias("r"))
        .select("l_returnflag", "n", "r.q", ((F.col("r.low") <= F.col("r.q") * F.col("n") + error) & (F.col("r.high") >= F.col("r.q") * F.col("n") - error)).alias("within"))
    )


@query("ag_29_repeated_criteria", """
    WITH c AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), n AS (SELECT line, count(*) AS n FROM c GROUP BY 1) SELECT count(*)::BIGINT AS distinct_criteria, count_if(n > 1)::BIGINT AS repeated_criteria FROM n""")
def ag_29(spark, d):
    return A.repeated_criteria(table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("criterion")))


@query("ag_29_examples_with_tag", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > 0.05 OR l_discount > 0.05")
def ag_29b(spark, d):
    rubric = lambda c: F.struct(F.array(F.when(c, "level:cluster").otherwise("level:example")).alias("tags"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(rubric(F.col("l_tax") > 0.05), rubric(F.col("l_discount") > 0.05)).alias("rubrics"))
    return A.examples_with_tag(rows).select("l_orderkey", "l_linenumber")


@query("ag_30_label_counts", "WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT sum(n)::BIGINT AS labels, min(n)::BIGINT AS min_n, max(n)::BIGINT AS max_n, round(avg(n), 6) AS mean_n FROM c")
def ag_30(spark, d):
    return A.label_count_range(table(spark, d, "lineitem"), "l_suppkey").withColumn("mean_n", r6(F.col("mean_n")))


WORST_SQL = f"""{S_SQL}, r AS (SELECT model, prompt_id, score, row_number() OVER (PARTITION BY model, prompt_id ORDER BY score) AS i, count(*) OVER (PARTITION BY model, prompt_id) AS n FROM s),
  w AS (SELECT model, prompt_id, k, sum(score * CASE WHEN n - i < k - 1 THEN 0 ELSE k::DOUBLE / n * list_reduce(list_concat([1.0::DOUBLE], list_transform(range(0, k - 1), lambda j: (n - i - j) / (n - 1 - j)::DOUBLE)), lambda a, b: a * b) END) AS value
    FROM r, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE n >= k GROUP BY 1, 2, 3)"""


@query("ag_31_worst_at_k_per_prompt", f"WITH {WORST_SQL} SELECT model, prompt_id, k, round(value + 1e-10, 6) AS value FROM w")
def ag_31(spark, d):
    return A.worst_at_k(samples(spark, d), [1, 2, 3, 4]).withColumn("value", r6(F.col("value") + 1e-10))


@query("ag_31_worst_at_k", f"WITH {WORST_SQL} SELECT model, k, round(greatest(0, least(1, avg(value))), 6) AS value, count(*)::BIGINT AS prompts FROM w GROUP BY 1, 2")
def ag_31b(spark, d):
    return A.mean_worst_at_k(A.worst_at_k(samples(spark, d), [1, 2, 3, 4])).withColumn("value", r6(F.col("value")))


@query("ag_32_run_variability", f"WITH {S_SQL}, r AS (SELECT model, run_id, greatest(0, least(1, avg(score))) AS m FROM s GROUP BY 1, 2) SELECT model, round(avg(m), 6) AS mean, round(min(m), 6) AS min, round(max(m), 6) AS max, round(stddev_pop(m), 6) AS std, count(*)::BIGINT AS runs FROM r GROUP BY 1")
def ag_32(spark, d):
    out = A.run_variability(samples(spark, d))
    return out.withColumns({c: r6(F.col(c)) for c in ("mean", "min", "max", "std")})


def sql_wins(condition: str) -> str:
    return f"""pw AS (SELECT a.prompt_id, a.model AS model_a, b.model AS model_b, count_if(a.score > b.score)::BIGINT AS won, count_if(a.score < b.score)::BIGINT AS lost FROM s a JOIN s b ON a.prompt_id = b.prompt_id AND {condition} GROUP BY 1, 2, 3),
      wr AS (SELECT model_a, model_b, avg(won / (won + lost)) AS win_rate, count(*)::BIGINT AS prompts FROM pw WHERE won + lost > 0 GROUP BY 1, 2)"""


CLOSE = "a.length > 0 AND b.length > 0 AND abs(a.length - b.length) / ((a.length + b.length) / 2.0) <= 0.1"


@query("jn_15_wins", f"WITH {S_SQL}, {sql_wins('TRUE')} SELECT prompt_id, model_a, model_b, won AS wins FROM pw WHERE won > 0")
def jn_15(spark, d):
    return A.wins(samples(spark, d))


@query("jn_15_length_controlled_wins", f"WITH {S_SQL}, {sql_wins(CLOSE)} SELECT prompt_id, model_a, model_b, won AS wins FROM pw WHERE won > 0")
def jn_15b(spark, d):
    return A.length_controlled_wins(samples(spark, d), 0.1)


@query("ag_33_win_rates", f"WITH {S_SQL}, {sql_wins('TRUE')} SELECT model_a, model_b, round(win_rate, 6) AS win_rate, prompts FROM wr")
def ag_33(spark, d):
    return A.win_rates(A.wins(samples(spark, d))).withColumn("win_rate", r6(F.col("win_rate")))


@query("ag_33_win_shrinkage", f"""WITH {S_SQL}, {sql_wins('TRUE')}, {sql_wins(CLOSE).replace('pw', 'pc').replace('wr AS', 'wc AS')}
    SELECT model_a, model_b, round(f.win_rate, 6) AS free, round(c.win_rate, 6) AS controlled, round((f.win_rate - c.win_rate) / nullif(f.win_rate - 0.5, 0), 4) AS shrinkage FROM wr f JOIN wc c USING (model_a, model_b) WHERE model_a <> model_b""")
def ag_33b(spark, d):
    out = A.win_shrinkage(A.win_rates(A.wins(samples(spark, d))), A.win_rates(A.length_controlled_wins(samples(spark, d), 0.1))).where(F.col("model_a") != F.col("model_b"))
    return out.withColumns({"free": r6(F.col("free")), "controlled": r6(F.col("controlled")), "shrinkage": F.round("shrinkage", 4)})


@query("wn_09_win_order", f"WITH {S_SQL}, {sql_wins('TRUE')}, m AS (SELECT model_a AS model, avg(win_rate) AS w FROM wr GROUP BY 1) SELECT model, round(w, 6) AS mean_win_rate, row_number() OVER (ORDER BY w DESC, model) AS rank FROM m")
def wn_09(spark, d):
    out = A.win_order(A.win_rates(A.wins(samples(spark, d))))
    return out.withColumns({"mean_win_rate": r6(F.col("mean_win_rate")), "rank": F.col("rank").cast("bigint")})


@query("ag_34_histogram", f"""WITH {S_SQL}, v AS (SELECT model, greatest(0.1, least(0.9, score)) AS v, count(*) OVER (PARTITION BY model) AS n, min(greatest(0.1, least(0.9, score))) OVER (PARTITION BY model) AS lo, max(greatest(0.1, least(0.9, score))) OVER (PARTITION BY model) AS hi FROM s),
    b AS (SELECT *, (hi - lo) / 20 AS w, least(floor((v - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin FROM v)
    SELECT model, bin, round(lo + (bin + 0.5) * w, 6) AS centre, count(*)::BIGINT AS cnt, round(count(*) / (n * w), 6) AS density FROM b GROUP BY model, bin, lo, w, n""")
def ag_34(spark, d):
    out = A.histogram(samples(spark, d), "score", ["model"], 20, 0.1, 0.9)
    return out.withColumns({"centre": r6(F.col("centre")), "density": r6(F.col("density"))})


@query("ag_34_symmetric_histogram", f"""WITH {S_SQL}, v AS (SELECT score - 0.45 AS v, max(abs(score - 0.45)) OVER () AS m, count(*) OVER () AS n FROM s), b AS (SELECT *, least(floor((v + m) / (2 * m / 201)), 200)::BIGINT AS bin FROM v)
    SELECT bin, count(*)::BIGINT AS cnt, round(count(*) / (n * 2 * m / 201), 6) AS density FROM b GROUP BY bin, n, m""")
def ag_34b(spark, d):
    out = A.histogram(samples(spark, d).withColumn("diff", F.col("score") - 0.45), "diff", [], 201, symmetric=True)
    return out.select("bin", "cnt", r6(F.col("density")).alias("density"))


PAIRED_SQL = f"""{S_SQL}, h AS (SELECT prompt_id, max(score) AS score FROM s WHERE model = '1-URGENT' GROUP BY 1), m AS (SELECT prompt_id, avg(score) AS r, count(*) AS n FROM s WHERE model <> '1-URGENT' GROUP BY 1), df AS (SELECT prompt_id, n, score - r AS diff FROM h JOIN m USING (prompt_id))"""


def paired(spark, d):
    s = samples(spark, d)
    human = s.where(F.col("model") == "1-URGENT").groupBy("prompt_id").agg(F.max("score").alias("score"))
    return A.paired_differences(human, s.where(F.col("model") != "1-URGENT"))


@query("jn_16_paired_differences", f"WITH {PAIRED_SQL} SELECT prompt_id, n::BIGINT AS n_refs, round(diff, 6) AS diff FROM df")
def jn_16(spark, d):
    return paired(spark, d).withColumn("diff", r6(F.col("diff")))


@query("ag_35_difference_summary", f"""WITH {PAIRED_SQL} SELECT round(avg((diff > 0)::INT), 6) AS share_greater, round(avg(CASE WHEN diff > 0 THEN diff END), 6) AS mean_greater, round(avg((diff < 0)::INT), 6) AS share_less,
    round(avg(CASE WHEN diff < 0 THEN diff END), 6) AS mean_less, count(*)::BIGINT AS n FROM df""")
def ag_35(spark, d):
    out = A.difference_summary(paired(spark, d))
    return out.select("n", *[r6(F.col(c)).alias(c) for c in out.columns if c != "n"])


@query("ag_36_correlations", f"""WITH {S_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY length) + (count(*) OVER (PARTITION BY model, length) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY model ORDER BY score) + (count(*) OVER (PARTITION BY model, score) - 1) / 2.0 AS ry FROM s)
    SELECT model, round(corr(length, score), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(regr_slope(score, length), 9) AS slope, round(regr_intercept(score, length), 6) AS intercept, count(*)::BIGINT AS n FROM r GROUP BY 1""")
def ag_36(spark, d):
    out = A.correlations(samples(spark, d), "length", "score")
    return out.select("model", "n", r6(F.col("pearson")).alias("pearson"), r6(F.col("spearman")).alias("spearman"), F.round("slope", 9).alias("slope"), r6(F.col("intercept")).alias("intercept"))


COST_SQL = """c AS (SELECT l_suppkey AS model, round((avg(l_partkey) * (l_suppkey % 7 + 1) + avg(l_orderkey) * (l_suppkey % 5 + 2)) / 1e6, 9) AS cost, avg(l_discount) AS score FROM lineitem GROUP BY 1)"""


def costs(spark, d):
    use = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("model"), F.col("l_partkey").alias("input_tokens"), F.col("l_orderkey").alias("output_tokens"), F.col("l_discount").alias("score"))
    key = F.col("s_suppkey")
    prices = table(spark, d, "supplier").select(key.alias("model"), (key % 7 + 1).alias("input_price"), (key % 5 + 2).alias("output_price"))
    return A.inference_cost(use, prices).withColumn("cost", F.round("cost", 9))


@query("ag_37_inference_cost", f"WITH {COST_SQL} SELECT model, round(cost, 6) AS cost, round(score, 6) AS score FROM c JOIN supplier ON s_suppkey = model")
def ag_37(spark, d):
    return costs(spark, d).select("model", r6(F.col("cost")).alias("cost"), r6(F.col("score")).alias("score"))


@query("wn_10_family_cost_rank", f"WITH {COST_SQL} SELECT model, family, CASE WHEN family IS NOT NULL THEN row_number() OVER (PARTITION BY family ORDER BY cost, model) END AS family_rank FROM c JOIN supplier ON s_suppkey = model LEFT JOIN (SELECT s_suppkey AS k, s_nationkey AS family FROM supplier WHERE s_acctbal > 3000) ON k = model")
def wn_10(spark, d):
    families = table(spark, d, "supplier").where(F.col("s_acctbal") > 3000).select(F.col("s_suppkey").alias("model"), F.col("s_nationkey").alias("family"))
    return A.family_cost_rank(costs(spark, d), families).select("model", "family", F.col("family_rank").cast("bigint").alias("family_rank"))


@query("wn_10_cost_frontier", f"WITH {COST_SQL}, b AS (SELECT *, max(score) OVER (ORDER BY cost, score DESC, model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM c JOIN supplier ON s_suppkey = model) SELECT model, round(cost, 6) AS cost, round(score, 6) AS score FROM b WHERE m IS NULL OR score > m")
def wn_10b(spark, d):
    return A.cost_frontier(costs(spark, d)).select("model", r6(F.col("cost")).alias("cost"), r6(F.col("score")).alias("score"))


@query("wn_03_running_max_frontier", f"""WITH {S_SQL}, b AS (SELECT model, date, max(score) AS score FROM s GROUP BY 1, 2), m AS (SELECT *, max(score) OVER (PARTITION BY model ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b)
    SELECT model, date::DATE AS date, round(score, 6) AS score FROM m WHERE before IS NULL OR score > before""")
def wn_03(spark, d):
    out = ordered.running_max_frontier(samples(spark, d), ["model"], "date", "score")
    return out.select("model", F.col("date").cast("date").alias("date"), r6(F.col("score")).alias("score"))


@query("ag_46_bar_table", f"""WITH {S_SQL}, m AS (SELECT model, 'theme:' || run_id AS metric, avg(score) AS value, stddev_pop(score) AS sd FROM s GROUP BY 1, 2 UNION ALL SELECT model, 'overall_score', avg(score), 0 FROM s GROUP BY 1),
    o AS (SELECT model, row_number() OVER (ORDER BY value DESC, model) AS model_rank FROM m WHERE metric = 'overall_score')
    SELECT model, model_rank, substr(metric, 7) AS cluster, round(1 - value, 6) AS success_rate, round(greatest(0, 1 - value - sd), 6) AS lower, round(least(1, 1 - value + sd), 6) AS upper FROM m JOIN o USING (model) WHERE metric LIKE 'theme:%'""")
def ag_46(spark, d):
    s = samples(spark, d)
    by = s.groupBy("model", F.concat(F.lit("theme:"), "run_id").alias("metric")).agg(F.avg("score").alias("value"), F.stddev_pop("score").alias("bootstrap_std"))
    overall = s.groupBy("model").agg(F.avg("score").alias("value")).select("model", F.lit("overall_score").alias("metric"), "value", F.lit(0.0).alias("bootstrap_std"))
    out = A.bar_table(by.unionByName(overall), "theme", as_error=True)
    return out.select("model", F.col("model_rank").cast("bigint").alias("model_rank"), "cluster", *[r6(F.col(c)).alias(c) for c in ("success_rate", "lower", "upper")])


@query("set_06_same_metrics", "WITH m AS (SELECT DISTINCT c_nationkey AS model, c_mktsegment || floor(c_acctbal / 500)::BIGINT AS metric FROM customer) SELECT metric, count(*)::BIGINT AS runs FROM m GROUP BY 1 HAVING count(*) < (SELECT count(DISTINCT model) FROM m)")
def set_06(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_nationkey").alias("model"), F.concat("c_mktsegment", F.floor(F.col("c_acctbal") / 500).cast("string")).alias("metric"))
    return A.same_metrics(rows)


@query("flt_07_reference_completions", """
    SELECT o_orderkey AS prompt_id, unnest([0, 1, 2, 3])::BIGINT AS ref_idx, unnest([o_orderpriority, o_orderstatus, o_custkey::VARCHAR, 'x']) AS completion FROM orders WHERE o_orderpriority = '3-MEDIUM'""")
def flt_07(spark, d):
    data = F.struct(F.lit("i").alias("ideal_completion"), F.col("o_orderpriority").alias("ideal_completions_group"),
                    F.array("o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string"), F.lit("x")).alias("ideal_completions_ref_completions"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("prompt_id"), data.alias("ideal_completions_data"))
    return A.reference_completions(rows, "3-MEDIUM").withColumn("ref_idx", F.col("ref_idx").cast("bigint"))
