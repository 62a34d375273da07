"""Aggregation, inference, verdict and quality queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinesieve.operators import seq, stats
from kinesieve.plans.sequences import KEYS, ORDER, O, S, events
from kinesieve.sources.tables import table


def mode_consensus(spark, sf_dir):
    """Most frequent k of each clip (the smallest of several) and the share that agrees."""
    counts = events(spark, sf_dir).groupBy("clip_id", "k").agg(F.count("*").alias("n"))
    w = W.partitionBy("clip_id")
    ranked = counts.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "k"))).withColumn("all", F.sum("n").over(w))
    return ranked.filter("r = 1").select("clip_id", "k", F.round(F.col("n") / F.col("all"), 6).alias("share"))


def cell_median_min_count(spark, sf_dir):
    """Median price in cells of quantity and discount that have 30 rows or more."""
    df = table(spark, sf_dir, "lineitem").withColumn("cell_x", F.floor(F.col("l_quantity") / 5)).withColumn("cell_y", F.floor(F.col("l_discount") * 100 / 2 + 1e-9))
    out = df.groupBy("cell_x", "cell_y").agg(F.count("*").alias("n"), F.round(F.percentile("l_extendedprice", 0.5), 3).alias("median"))
    return out.filter("n >= 30")


def top_per_cell_quota(spark, sf_dir):
    """The three highest prices of each supplier, by order and line where equal."""
    w = W.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("l_suppkey", "l_orderkey", "l_linenumber", "r")


def greedy_budget_groups(spark, sf_dir):
    """Whole customers in a hashed order while their orders fit into a budget of 2,000.

    The running sum is taken over hash ranges first and inside a range afterwards, so no window holds
    more than one range.
    """
    sizes = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("h", (F.col("o_custkey") * 2654435761) % 4294967296).withColumn("range", F.floor(F.col("h") / (1 << 24)))
    # 256 ranges whatever the input: a fixed, small table
    ranges = sizes.groupBy("range").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select("range", before.alias("before"))
    inside = F.sum("n").over(W.partitionBy("range").orderBy("h", "o_custkey").rowsBetween(W.unboundedPreceding, 0))
    out = sizes.join(F.broadcast(starts), "range").withColumn("used", F.col("before") + inside)
    return out.filter("used <= 2000").select("o_custkey", "n", "used")


def calm_conditional_rms(spark, sf_dir):
    """RMS of all rows and of the calm ones, the latter only where 20 are calm."""
    df = events(spark, sf_dir)
    calm = F.col("value") < 100
    return df.groupBy("clip_id").agg(F.round(seq.rms(F.col("value")), 5).alias("rms"), F.round(stats.conditional_rms(F.col("value"), calm, 20), 5).alias("calm"), F.count_if(calm).alias("n_calm"))


def pairs(spark, sf_dir):
    """Two runs of each order: the lines of even and of odd number."""
    df = table(spark, sf_dir, "lineitem")
    even = F.col("l_linenumber") % 2 == 0
    return df.groupBy("l_orderkey").agg(F.avg(F.when(even, F.col("l_extendedprice"))).alias("this"), F.avg(F.when(~even, F.col("l_extendedprice"))).alias("other")).filter("this IS NOT NULL AND other IS NOT NULL")


def paired_win_rate(spark, sf_dir):
    df = pairs(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = df.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg((F.col("this") < F.col("other")).cast("int")), 6).alias("win_rate"))
    return out.filter("n >= 3")


def geo_mean_ratio(spark, sf_dir):
    return pairs(spark, sf_dir).agg(F.count("*").alias("n"), F.round(stats.geometric_ratio(F.col("this"), F.col("other")), 5).alias("ratio"))


def noise_grouping_sets(spark, sf_dir):
    """Spread of log ratios pooled, by nation, and by nation and status."""
    df = pairs(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    df = df.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sets = df.groupingSets([[], ["n_name"], ["n_name", "o_orderstatus"]], "n_name", "o_orderstatus")
    return sets.agg(F.count("*").alias("n"), F.round(stats.log_ratio_spread(F.col("this"), F.col("other")), 5).alias("sigma"))


def limits(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy("l_suppkey")
    return df.agg(F.round(F.avg("l_quantity"), 4).alias("quantity"), F.round(F.max("l_discount"), 4).alias("discount"), F.round(F.avg("l_tax"), 4).alias("tax"))


def gate_checks_unpivot(spark, sf_dir):
    """Three checks of each supplier as rows: value, limit and whether it passes."""
    wide = limits(spark, sf_dir)
    rows = wide.selectExpr("l_suppkey", "stack(3, 'quantity', quantity, 25.5D, 'discount', discount, 0.1D, 'tax', tax, 0.04D) AS (check_name, value, bound)")
    return rows.withColumn("pass", F.col("value") <= F.col("bound"))


def verdict_rule(spark, sf_dir):
    """Per supplier: all checks passed, and the change of its tax against a band of 5 %."""
    checks = gate_checks_unpivot(spark, sf_dir).groupBy("l_suppkey").agg(F.bool_and("pass").alias("all_pass"), F.count_if(~F.col("pass")).alias("n_failed"))
    wide = limits(spark, sf_dir).withColumn("change", F.col("tax") / 0.04 - 1)
    return checks.join(wide, "l_suppkey").select("l_suppkey", "all_pass", "n_failed", stats.verdict(F.col("change"), F.lit(0.05)).alias("verdict"))


def percentile_summary(spark, sf_dir):
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    df = events(spark, sf_dir).groupBy("event_type").agg(p.alias("p"), F.max("value").alias("largest"), F.count_if(F.col("value") > 100).alias("n_over"))
    return df.select("event_type", F.round(F.col("p")[0], 4).alias("p50"), F.round(F.col("p")[1], 4).alias("p95"), F.round(F.col("p")[2], 4).alias("p99"), "largest", "n_over")


def affine_clock_fit(spark, sf_dir):
    """Line of time in days over row number, by clip."""
    day = 86_400_000_000
    first = F.first("t").over(seq.ordered(KEYS, ORDER))
    df = events(spark, sf_dir).withColumn("x", F.row_number().over(seq.ordered(KEYS, ORDER)).cast("double")).withColumn("y", (F.col("t") - first) / day)
    return df.groupBy("clip_id").agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 5).alias("intercept"))


def irls_grid_fit(spark, sf_dir):
    """Robust slope through the origin of time over row number: three reweighted passes."""
    day = 86_400_000_000.0
    first = F.first("t").over(seq.ordered(KEYS, ORDER))
    df = events(spark, sf_dir).withColumn("x", (F.row_number().over(seq.ordered(KEYS, ORDER)) - 1).cast("double")).withColumn("y", (F.col("t") - first) / day).select("clip_id", "x", "y")
    df = df.withColumn("w", F.lit(1.0))
    for _ in range(3):
        fit = df.groupBy("clip_id").agg((F.sum(F.col("w") * F.col("x") * F.col("y")) / F.nullif(F.sum(F.col("w") * F.col("x") * F.col("x")), F.lit(0.0))).alias("b"))
        df = df.select("clip_id", "x", "y").join(fit, "clip_id").withColumn("w", 1 / (1 + F.pow(F.col("y") - F.col("b") * F.col("x"), 2))).select("clip_id", "x", "y", "w", "b")
    return fit.select("clip_id", F.round("b", 6).alias("slope"))


def quality_violations(spark, sf_dir):
    """Rows that break the rules of a series, counted by rule and clip."""
    w = seq.ordered(KEYS, ORDER)
    df = events(spark, sf_dir).withColumn("before", F.lag("t").over(w))
    rules = F.array(
        F.when(F.col("t") <= F.col("before"), "time_not_increasing"),
        F.when(F.col("value").isNull(), "value_missing"),
        F.when(F.col("value") < 0, "value_negative"),
        F.when(F.col("t") - F.col("before") > 86_400_000_000, "gap_over_a_day"),
        F.when(F.col("k").isNull(), "property_missing"),
    )
    rows = df.select("clip_id", F.explode(F.array_compact(rules)).alias("rule"))
    return rows.groupBy("clip_id", "rule").agg(F.count("*").alias("n"))


def option_overlay(spark, sf_dir):
    """Defaults of every nation, overlaid by what its name matches; later keys win."""
    rules = spark.createDataFrame([("A", "lens", "wide"), ("AN", "rate", "high"), ("IN", "lens", "narrow")], "pattern string, name string, given string")
    # three rules and three options: constants, so broadcasting them is bounded
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    hits = nations.join(F.broadcast(rules), F.col("n_name").contains(F.col("pattern"))).groupBy("n_nationkey", "name").agg(F.max_by("given", "pattern").alias("given"))
    every = nations.withColumn("d", F.explode(F.array(*[F.struct(F.lit(a).alias("name"), F.lit(b).alias("base")) for a, b in [("lens", "normal"), ("rate", "low"), ("fill", "on")]])))
    every = every.select("n_nationkey", "n_name", "d.name", "d.base")
    return every.join(hits, ["n_nationkey", "name"], "left").select("n_nationkey", "n_name", "name", F.coalesce("given", "base").alias("value"))


def regressions(spark, sf_dir):
    """Metrics of a supplier that are over 5 % worse than its nation's mean, listed per supplier."""
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    long_ = limits(spark, sf_dir).join(sup, "l_suppkey").selectExpr("l_suppkey", "s_nationkey", "stack(2, 'quantity', quantity, 'tax', tax) AS (metric, value)")
    mean = long_.groupBy("s_nationkey", "metric").agg(F.avg("value").alias("mean"))
    worse = long_.join(mean, ["s_nationkey", "metric"]).filter("value > 1.02 * mean")
    return worse.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_list("metric")), ",").alias("metrics"))


def evenly_spread(spark, sf_dir):
    """Five evenly spaced rows of each clip."""
    df = events(spark, sf_dir).withColumn("k", F.row_number().over(seq.ordered(KEYS, ORDER)) - 1).withColumn("n", F.count("*").over(W.partitionBy(*KEYS)))
    pick = F.floor(F.col("k") * 5 / F.col("n")) != F.floor((F.col("k") - 1) * 5 / F.col("n"))
    return df.filter(pick).select("clip_id", F.col("k").cast("long").alias("k"), "event_id")


def bootstrap_mean_ci(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    return stats.bootstrap_mean(df, ["l_returnflag"], "l_quantity", draws=200)


def priced(spark, sf_dir):
    """Prices of line items, full and after the discount."""
    price = F.col("l_extendedprice").cast("double")
    return table(spark, sf_dir, "lineitem").select("l_returnflag", price.alias("full"), (price * (1 - F.col("l_discount").cast("double"))).alias("net"))


def bootstrap_ratio_ci(spark, sf_dir):
    """Share of the full price that is paid, by return flag, with its interval."""
    return stats.bootstrap_ratio(priced(spark, sf_dir), ["l_returnflag"], "net", "full", draws=200)


def bootstrap_difference_ci(spark, sf_dir):
    """Mean discount in money, by return flag, with its interval over pairs."""
    return stats.bootstrap_difference(priced(spark, sf_dir), ["l_returnflag"], "full", "net", draws=200)


PAIRS = """p AS (SELECT l_orderkey, avg(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END) AS this, avg(CASE WHEN l_linenumber % 2 <> 0 THEN l_extendedprice END) AS other
 FROM lineitem GROUP BY 1 HAVING this IS NOT NULL AND other IS NOT NULL)"""
LIMITS = "w AS (SELECT l_suppkey, round(avg(l_quantity), 4) AS quantity, round(max(l_discount), 4) AS discount, round(avg(l_tax), 4) AS tax FROM lineitem GROUP BY 1)"
CHECKS = f"""{LIMITS}, c AS (SELECT l_suppkey, 'quantity' AS check_name, quantity AS value, CAST(25.5 AS DOUBLE) AS bound FROM w
 UNION ALL SELECT l_suppkey, 'discount', discount, CAST(0.1 AS DOUBLE) FROM w UNION ALL SELECT l_suppkey, 'tax', tax, CAST(0.04 AS DOUBLE) FROM w)"""
GRID = f"""{S}, g AS (SELECT clip_id, CAST(row_number() OVER ({O}) - 1 AS DOUBLE) AS x, (t - first_value(t) OVER ({O})) / 86400000000.0 AS y FROM s),
f1 AS (SELECT clip_id, sum(x * y) / nullif(sum(x * x), 0) AS b FROM g GROUP BY 1),
f2 AS (SELECT clip_id, sum(w * x * y) / nullif(sum(w * x * x), 0) AS b FROM (SELECT clip_id, x, y, 1 / (1 + power(y - b * x, 2)) AS w FROM g JOIN f1 USING (clip_id)) GROUP BY 1),
f3 AS (SELECT clip_id, sum(w * x * y) / nullif(sum(w * x * x), 0) AS b FROM (SELECT clip_id, x, y, 1 / (1 + power(y - b * x, 2)) AS w FROM g JOIN f2 USING (clip_id)) GROUP BY 1)"""
K = "s AS (SELECT user_id AS clip_id, event_id, epoch_us(ts) AS t, event_type, value, TRY_CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS INTEGER) AS k FROM events)"
SQL = {
    "mode_consensus": f"""WITH {K}, c AS (SELECT clip_id, k, count(*) AS n FROM s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, k) AS r, sum(n) OVER (PARTITION BY clip_id) AS all_ FROM c)
SELECT clip_id, k, round(n / CAST(all_ AS DOUBLE), 6) AS share FROM r WHERE r = 1""",
    "cell_median_min_count": """SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS cell_x, CAST(floor(l_discount * 100 / 2 + 1e-9) AS BIGINT) AS cell_y, count(*) AS n, round(median(l_extendedprice), 3) AS median
FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 30""",
    "top_per_cell_quota": """SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INTEGER) AS r FROM lineitem) WHERE r <= 3""",
    "greedy_budget_groups": """WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
SELECT * FROM (SELECT o_custkey, n, CAST(sum(n) OVER (ORDER BY (o_custkey * 2654435761) % 4294967296, o_custkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM c) WHERE used <= 2000""",
    "calm_conditional_rms": f"""WITH {S} SELECT clip_id, round(sqrt(avg(value * value)), 5) AS rms,
round(CASE WHEN count(*) FILTER (WHERE value < 100) >= 20 THEN sqrt(avg(value * value) FILTER (WHERE value < 100)) END, 5) AS calm, count(*) FILTER (WHERE value < 100) AS n_calm FROM s GROUP BY 1""",
    "paired_win_rate": f"""WITH {PAIRS} SELECT o_orderpriority, count(*) AS n, round(avg(CASE WHEN this < other THEN 1 ELSE 0 END), 6) AS win_rate
FROM p JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING count(*) >= 3""",
    "geo_mean_ratio": f"WITH {PAIRS} SELECT count(*) AS n, round(exp(avg(ln(this / other))) - 1, 5) AS ratio FROM p",
    "noise_grouping_sets": f"""WITH {PAIRS} SELECT n_name, o_orderstatus, count(*) AS n, round(sqrt(avg(power(ln(this / other), 2))), 5) AS sigma
FROM p JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY GROUPING SETS ((), (n_name), (n_name, o_orderstatus))""",
    "gate_checks_unpivot": f"WITH {CHECKS} SELECT l_suppkey, check_name, value, bound, value <= bound AS pass FROM c",
    "verdict_rule": f"""WITH {CHECKS}, a AS (SELECT l_suppkey, bool_and(value <= bound) AS all_pass, count(*) FILTER (WHERE NOT value <= bound) AS n_failed FROM c GROUP BY 1)
SELECT l_suppkey, all_pass, n_failed, CASE WHEN tax / CAST(0.04 AS DOUBLE) - 1 < -0.05 THEN 'better' WHEN tax / CAST(0.04 AS DOUBLE) - 1 > 0.05 THEN 'worse' ELSE 'same' END AS verdict FROM a JOIN w USING (l_suppkey)""",
    "percentile_summary": f"""WITH {S} SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99,
max(value) AS largest, count(*) FILTER (WHERE value > 100) AS n_over FROM s GROUP BY 1""",
    "affine_clock_fit": f"""WITH {S}, g AS (SELECT clip_id, CAST(row_number() OVER ({O}) AS DOUBLE) AS x, (t - first_value(t) OVER ({O})) / 86400000000.0 AS y FROM s)
SELECT clip_id, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 5) AS intercept FROM g GROUP BY 1""",
    "irls_grid_fit": f"WITH {GRID} SELECT clip_id, round(b, 6) AS slope FROM f3",
    "quality_violations": f"""WITH {K}, d AS (SELECT *, lag(t) OVER ({O}) AS before FROM s),
r AS (SELECT clip_id, 'time_not_increasing' AS rule FROM d WHERE t <= before UNION ALL SELECT clip_id, 'value_missing' FROM d WHERE value IS NULL
 UNION ALL SELECT clip_id, 'value_negative' FROM d WHERE value < 0 UNION ALL SELECT clip_id, 'gap_over_a_day' FROM d WHERE t - before > 86400000000
 UNION ALL SELECT clip_id, 'property_missing' FROM d WHERE k IS NULL)
SELECT clip_id, rule, count(*) AS n FROM r GROUP BY 1, 2""",
    "option_overlay": """WITH r(pattern, name, given) AS (VALUES ('A', 'lens', 'wide'), ('AN', 'rate', 'high'), ('IN', 'lens', 'narrow')),
d(name, base) AS (VALUES ('lens', 'normal'), ('rate', 'low'), ('fill', 'on')),
h AS (SELECT n_nationkey, name, max_by(given, pattern) AS given FROM nation JOIN r ON contains(n_name, pattern) GROUP BY 1, 2)
SELECT n.n_nationkey, n_name, d.name, coalesce(given, base) AS value FROM nation n CROSS JOIN d LEFT JOIN h ON h.n_nationkey = n.n_nationkey AND h.name = d.name""",
    "regressions": f"""WITH {LIMITS}, l AS (SELECT l_suppkey, s_nationkey, 'quantity' AS metric, quantity AS value FROM w JOIN supplier ON s_suppkey = l_suppkey
 UNION ALL SELECT l_suppkey, s_nationkey, 'tax', tax FROM w JOIN supplier ON s_suppkey = l_suppkey),
m AS (SELECT s_nationkey, metric, avg(value) AS mean FROM l GROUP BY 1, 2)
SELECT l_suppkey, string_agg(metric, ',' ORDER BY metric) AS metrics FROM l JOIN m USING (s_nationkey, metric) WHERE value > 1.02 * mean GROUP BY 1""",
    "evenly_spread": f"""WITH {S}, k AS (SELECT *, row_number() OVER ({O}) - 1 AS k, count(*) OVER (PARTITION BY clip_id) AS n FROM s)
SELECT clip_id, k, event_id FROM k WHERE floor(k * 5 / CAST(n AS DOUBLE)) <> floor((k - 1) * 5 / CAST(n AS DOUBLE))""",
}
QUERIES = {name: globals()[name] for name in (*SQL, "bootstrap_mean_ci", "bootstrap_ratio_ci", "bootstrap_difference_ci")}
