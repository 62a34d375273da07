"""Scoreboard queries, with their SQL. A window is a supplier's lines, its camera the nation, and the
two configurations the lines that are returned or not."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinesieve.operators import boards as B
from kinesieve.operators import seq
from kinesieve.plans.sequences import KEYS, ORDER, O, S, events
from kinesieve.sources.rounds import settled
from kinesieve.sources.tables import stored_by, table

SIGMA = 0.02


def windows(spark, sf_dir):
    """Per supplier: metrics of this and the other configuration, calm ones from 60 lines on."""
    df = stored_by(spark, sf_dir, "lineitem", "l_suppkey")  # a mean on a limit is decided by the order of its sum
    this, calm = F.col("l_returnflag") == "N", F.col("l_discount") < 0.05
    of = lambda flag, x: F.avg(F.when(flag, F.col(x)))
    out = df.groupBy(F.col("l_suppkey").alias("window")).agg(
        of(this, "l_quantity").alias("hf"), of(~this, "l_quantity").alias("hf_ref"),
        F.when(F.count_if(this & calm) >= 60, of(this & calm, "l_quantity")).alias("calm"),
        F.when(F.count_if(~this & calm) >= 60, of(~this & calm, "l_quantity")).alias("calm_ref"),
        of(this, "l_tax").alias("crop"), F.count_if(this & (F.col("l_extendedprice") > 60000)).alias("jumps"),
        F.avg(F.when(this, (F.col("l_quantity") > 25).cast("int"))).alias("win"), F.count_if(this).alias("win_n"),
    )
    cameras = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("window"), F.col("s_nationkey").alias("camera"))
    checks = {"hf": F.col("hf") > 25.5, "calm": F.col("calm") > 25.5, "crop": F.col("crop") > 0.0405, "jumps": F.col("jumps") > 110}
    return out.join(cameras, "window").withColumn("fails", B.reasons(checks))


def board_summary(spark, sf_dir):
    out = B.summary(windows(spark, sf_dir), ["camera"], ["hf", "calm", "crop"], F.size("fails") == 0, F.col("win"), F.col("win_n"), {"hf": "hf_ref", "calm": "calm_ref"})
    return out.select("camera", "n", "passed", "beats_hf", "beats_calm", "win_ge_90", *(F.round(c, 5).alias(c) for c in ("mean_hf", "mean_calm", "mean_crop", "ratio_hf", "ratio_calm", "win_pooled")))


def board_fails(spark, sf_dir):
    return B.fail_histogram(windows(spark, sf_dir), ["camera"], "fails")


def board_shifts(spark, sf_dir):
    out = B.shifts(windows(spark, sf_dir), ["camera"], "hf", "hf_ref", SIGMA)
    text = B.shift_text(F.lit("hf"), F.round("change", 6), F.round("band", 6), F.col("verdict"))
    return out.select("camera", "n", F.round("change", 6).alias("change"), F.round("spread", 5).alias("spread"), "n_better", "n_worse", F.round("band", 6).alias("band"), "verdict", text.alias("text"))


def repeated_runs(spark, sf_dir):
    """Two runs of the windows, one of which has lost every fifth calm metric."""
    one = settled(windows(spark, sf_dir), "windows")  # read twice, but summed once
    two = one.withColumn("calm", F.when(F.col("window") % 5 != 0, F.col("calm")))
    return B.same_runs(one, two, ["window"], ["hf", "calm", "crop"])


def quality_pool(spark, sf_dir):
    """Over all lines: RMS of both configurations, of the calm lines, and the reduction."""
    df = table(spark, sf_dir, "lineitem").withColumn("x", F.col("l_quantity") - 25)
    this, calm = F.col("l_returnflag") == "N", F.col("l_discount") < 0.05
    part = lambda flag: B.rms(F.when(flag, F.col("x")))
    out = df.agg(part(~this).alias("before"), part(this).alias("after"), part(~this & calm).alias("calm_before"), part(this & calm).alias("calm_after"), F.avg(calm.cast("int")).alias("calm_share"))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns), F.round(B.reduction(F.col("before"), F.col("after")), 6).alias("reduction"))


def streak_summary(spark, sf_dir):
    """Of every clip's values: RMS, mean, 95 % point, maximum, shares over limits, and a ratio of sums."""
    df = events(spark, sf_dir).groupBy("clip_id").agg(
        F.count("value").alias("n"), B.rms(F.col("value")).alias("rms"), F.avg("value").alias("mean"), F.percentile("value", 0.95).alias("p95"), F.max("value").alias("largest"),
        F.avg((F.col("value") > 100).cast("int")).alias("over_100"), F.avg((F.col("value") > 200).cast("int")).alias("over_200"),
        (F.sum(F.when(F.col("event_type") == "click", F.col("value"))) / F.nullif(F.sum("value"), F.lit(0.0))).alias("share"),
    )
    return df.select("clip_id", "n", *(F.round(c, 5).alias(c) for c in ("rms", "mean", "p95", "largest", "over_100", "over_200", "share")))


def offset_reasons(spark, sf_dir):
    """Why a supplier's mean discount is not taken as its offset, and what is decided."""
    df = stored_by(spark, sf_dir, "lineitem", "l_suppkey").groupBy("l_suppkey").agg(F.avg("l_discount").alias("offset"), (F.stddev_samp("l_discount") / F.sqrt(F.count("*"))).alias("sigma"), F.count("*").alias("n"), F.avg("l_tax").alias("gain"))
    checks = {
        "sigma too large": F.col("sigma") > F.greatest(F.lit(0.0012), 0.025 * F.abs("offset")),
        "outside its bound": F.abs(F.col("offset") - 0.05) > 0.001,
        "few observations": F.col("n") < 580,
    }
    df = df.withColumn("why", B.reasons(checks))
    source = F.when(F.size("why") > 0, F.when(F.col("gain") >= 0.0405, "nuisance only").otherwise("nothing")).when(F.col("gain") >= 0.0395, "offset").otherwise("nothing")
    return df.select("l_suppkey", F.array_join("why", "; ").alias("why"), source.alias("source"))


def coverage_levels(spark, sf_dir):
    """Levels covered without a gap in every second row of a clip; a row between takes the smaller one
    of its neighbours, a last one without a neighbour after it that before."""
    w = seq.ordered(KEYS, ORDER)
    levels = F.array(*(F.col("value") > 30 * k - F.pmod(F.col("event_id") * k, F.lit(11)) * 8 for k in range(1, 7)))
    df = events(spark, sf_dir).withColumn("i", F.row_number().over(w) - 1).withColumn("own", B.covered_levels(levels))
    even = F.col("i") % 2 == 0
    between = F.least(F.lag("own").over(w), F.lead("own").over(w))
    return df.withColumn("covered", F.when(even, F.col("own")).otherwise(between)).select("clip_id", "event_id", "covered")


def clipped_area(spark, sf_dir):
    """Share of the unit square that a part's rectangle covers, by cutting it with four half planes."""
    x, y, w, h = F.pmod(F.col("p_partkey"), F.lit(17)) / 10 - 0.6, F.pmod(F.col("p_partkey"), F.lit(13)) / 10 - 0.5, F.col("p_size") / 40, F.pmod(F.col("p_partkey"), F.lit(7)) / 5 + 0.1
    at = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    df = table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    corners = F.array(at(F.col("x"), F.col("y")), at(F.col("x") + F.col("w"), F.col("y")), at(F.col("x") + F.col("w"), F.col("y") + F.col("h")), at(F.col("x"), F.col("y") + F.col("h")))
    df = df.withColumn("left", B.clipped_polygon(corners, [(-1, 0, 0), (1, 0, 1), (0, -1, 0), (0, 1, 1)]))
    return df.select("p_partkey", F.round(B.polygon_area(F.col("left")), 6).alias("area"))


def spread_of_frames(spark, sf_dir):
    """Central difference of time in each clip, in rows per day, and rows far under the usual rate."""
    w = seq.ordered(KEYS, ORDER)
    df = events(spark, sf_dir).withColumn("span", (F.lead("t").over(w) - F.lag("t").over(w)) / 86_400_000_000)
    df = df.filter("span > 0").withColumn("rate", 2 / F.col("span"))
    usual = df.groupBy("clip_id").agg(F.percentile("rate", 0.5).alias("usual"))
    slow = F.col("rate") < 0.5 * F.col("usual")
    return df.join(usual, "clip_id").groupBy("clip_id").agg(F.round(F.max("usual"), 5).alias("usual"), F.count_if(slow).alias("n_slow"), F.round(F.max("rate"), 4).alias("fastest"))


def status_labels(spark, sf_dir):
    """A label of every clip by its rate and errors."""
    df = events(spark, sf_dir).groupBy("clip_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), (F.max("t") - F.min("t")).alias("span"))
    rate = F.col("n") / (F.col("span") / 86_400_000_000)
    level = F.when(F.col("errors") * 4 > F.col("n"), "unsupported").when(rate >= 3.4, "good").otherwise("limited")
    label = F.when(level == "unsupported", F.lit("too many errors")).when(level == "good", F.format_string("%.1f rows a day", F.round(rate, 1))).otherwise(F.format_string("%.1f rows a day, limited", F.round(rate, 1)))
    return df.select("clip_id", level.alias("level"), label.alias("label"))


WINDOWS = """x AS (SELECT *, l_returnflag = 'N' AS this, l_discount < 0.05 AS calm FROM lineitem),
g AS (SELECT l_suppkey AS window_, avg(l_quantity) FILTER (WHERE this) AS hf, avg(l_quantity) FILTER (WHERE NOT this) AS hf_ref,
 CASE WHEN count(*) FILTER (WHERE this AND calm) >= 60 THEN avg(l_quantity) FILTER (WHERE this AND calm) END AS calm,
 CASE WHEN count(*) FILTER (WHERE NOT this AND calm) >= 60 THEN avg(l_quantity) FILTER (WHERE NOT this AND calm) END AS calm_ref,
 avg(l_tax) FILTER (WHERE this) AS crop, count(*) FILTER (WHERE this AND l_extendedprice > 60000) AS jumps,
 avg(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) FILTER (WHERE this) AS win, count(*) FILTER (WHERE this) AS win_n FROM x GROUP BY 1),
w AS (SELECT g.*, s_nationkey AS camera, list_filter([CASE WHEN hf > 25.5 THEN 'hf' END, CASE WHEN calm > 25.5 THEN 'calm' END, CASE WHEN crop > 0.0405 THEN 'crop' END,
 CASE WHEN jumps > 110 THEN 'jumps' END], lambda c: c IS NOT NULL) AS fails FROM g JOIN supplier ON s_suppkey = window_)"""
SQL = {
    "board_summary": f"""WITH {WINDOWS} SELECT camera, count(*) AS n, count(*) FILTER (WHERE len(fails) = 0) AS passed, count(*) FILTER (WHERE hf < hf_ref) AS beats_hf,
 count(*) FILTER (WHERE calm < calm_ref) AS beats_calm, count(*) FILTER (WHERE win >= 0.9) AS win_ge_90, round(avg(hf), 5) AS mean_hf, round(avg(calm), 5) AS mean_calm, round(avg(crop), 5) AS mean_crop,
 round(exp(avg(CASE WHEN hf > 0 AND hf_ref > 0 THEN ln(hf / hf_ref) END)), 5) AS ratio_hf, round(exp(avg(CASE WHEN calm > 0 AND calm_ref > 0 THEN ln(calm / calm_ref) END)), 5) AS ratio_calm,
 round(sum(win * win_n) / nullif(sum(CASE WHEN win IS NOT NULL THEN win_n END), 0), 5) AS win_pooled FROM w GROUP BY camera""",
    "board_fails": f"""WITH {WINDOWS}, f AS (SELECT camera, unnest(fails) AS "check" FROM w) SELECT camera, "check", count(*) AS n FROM f GROUP BY 1, 2""",
    "board_shifts": f"""WITH {WINDOWS}, r AS (SELECT camera, ln(hf / hf_ref) AS r FROM w WHERE hf > 0 AND hf_ref > 0),
a AS (SELECT camera, count(*) AS n, exp(avg(r)) - 1 AS change, stddev_pop(r) AS spread, count(*) FILTER (WHERE exp(r) - 1 < -0.05) AS n_better, count(*) FILTER (WHERE exp(r) - 1 > 0.05) AS n_worse FROM r GROUP BY 1),
b AS (SELECT *, 0.05 / sqrt(n) AS band, CASE WHEN abs(ln(1 + change)) <= 0.05 / sqrt(n) THEN 'same' WHEN change < 0 THEN 'better' ELSE 'worse' END AS verdict FROM a)
SELECT camera, n, round(change, 6) AS change, round(spread, 5) AS spread, n_better, n_worse, round(band, 6) AS band, verdict,
 printf('hf %+.1f%%', 100 * round(change, 6)) || CASE WHEN verdict = 'same' THEN '' ELSE ' ' || verdict END || printf(' (noise +-%.1f)', 100 * round(band, 6)) AS text FROM b""",
    "repeated_runs": f"""WITH {WINDOWS} SELECT window_ AS "window", CAST(CASE WHEN window_ % 5 = 0 AND calm IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS n_differs, NOT (window_ % 5 = 0 AND calm IS NOT NULL) AS identical FROM w""",
    "quality_pool": """WITH x AS (SELECT power(l_quantity - 25, 2) AS e, l_returnflag = 'N' AS this, l_discount < 0.05 AS calm FROM lineitem),
a AS (SELECT sqrt(avg(e) FILTER (WHERE NOT this)) AS before, sqrt(avg(e) FILTER (WHERE this)) AS after, sqrt(avg(e) FILTER (WHERE NOT this AND calm)) AS calm_before, sqrt(avg(e) FILTER (WHERE this AND calm)) AS calm_after, avg(CASE WHEN calm THEN 1 ELSE 0 END) AS calm_share FROM x)
SELECT round(before, 6) AS before, round(after, 6) AS after, round(calm_before, 6) AS calm_before, round(calm_after, 6) AS calm_after, round(calm_share, 6) AS calm_share, round(1 - after / nullif(before, 0), 6) AS reduction FROM a""",
    "streak_summary": f"""WITH {S} SELECT clip_id, count(value) AS n, round(sqrt(avg(value * value)), 5) AS rms, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.95), 5) AS p95, round(max(value), 5) AS largest,
 round(avg(CAST(value > 100 AS INTEGER)), 5) AS over_100, round(avg(CAST(value > 200 AS INTEGER)), 5) AS over_200, round(sum(value) FILTER (WHERE event_type = 'click') / nullif(sum(value), 0), 5) AS share FROM s GROUP BY 1""",
    "offset_reasons": """WITH a AS (SELECT l_suppkey, avg(l_discount) AS o, stddev_samp(l_discount) / sqrt(count(*)) AS sigma, count(*) AS n, avg(l_tax) AS gain FROM lineitem GROUP BY 1),
w AS (SELECT *, list_filter([CASE WHEN sigma > greatest(0.0012, 0.025 * abs(o)) THEN 'sigma too large' END, CASE WHEN abs(o - 0.05) > 0.001 THEN 'outside its bound' END, CASE WHEN n < 580 THEN 'few observations' END], lambda c: c IS NOT NULL) AS why FROM a)
SELECT l_suppkey, coalesce(array_to_string(why, '; '), '') AS why, CASE WHEN len(why) > 0 THEN CASE WHEN gain >= 0.0405 THEN 'nuisance only' ELSE 'nothing' END WHEN gain >= 0.0395 THEN 'offset' ELSE 'nothing' END AS source FROM w""",
    "coverage_levels": f"""WITH {S}, l AS (SELECT *, row_number() OVER ({O}) - 1 AS i, list_transform([1, 2, 3, 4, 5, 6], lambda k: coalesce(value > 30 * k - (event_id * k) % 11 * 8, false)) AS c FROM s),
o AS (SELECT *, CAST(CASE WHEN list_contains(c, false) THEN list_position(c, false) - 1 ELSE 6 END AS INTEGER) AS own FROM l)
SELECT clip_id, event_id, CASE WHEN i % 2 = 0 THEN own ELSE least(lag(own) OVER ({O}), lead(own) OVER ({O})) END AS covered FROM o""",
    "clipped_area": """WITH p AS (SELECT p_partkey, (p_partkey % 17) / 10.0::DOUBLE - 0.6 AS x, (p_partkey % 13) / 10.0::DOUBLE - 0.5 AS y, p_size / 40.0::DOUBLE AS w, (p_partkey % 7) / 5.0::DOUBLE + 0.1 AS h FROM part)
SELECT p_partkey, round(greatest(least(x + w, 1) - greatest(x, 0), 0) * greatest(least(y + h, 1) - greatest(y, 0), 0), 6) AS area FROM p""",
    "spread_of_frames": f"""WITH {S}, d AS (SELECT clip_id, (lead(t) OVER ({O}) - lag(t) OVER ({O})) / 86400000000.0::DOUBLE AS span FROM s), r AS (SELECT clip_id, 2 / span AS rate FROM d WHERE span > 0),
u AS (SELECT clip_id, median(rate) AS usual FROM r GROUP BY 1)
SELECT clip_id, round(max(usual), 5) AS usual, count(*) FILTER (WHERE rate < 0.5 * usual) AS n_slow, round(max(rate), 4) AS fastest FROM r JOIN u USING (clip_id) GROUP BY 1""",
    "status_labels": f"""WITH {S}, g AS (SELECT clip_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, max(t) - min(t) AS span FROM s GROUP BY 1),
l AS (SELECT clip_id, n / (span / 86400000000.0::DOUBLE) AS rate, CASE WHEN errors * 4 > n THEN 'unsupported' WHEN n / (span / 86400000000.0::DOUBLE) >= 3.4 THEN 'good' ELSE 'limited' END AS level FROM g)
SELECT clip_id, level, CASE level WHEN 'unsupported' THEN 'too many errors' WHEN 'good' THEN printf('%.1f rows a day', round(rate, 1)) ELSE printf('%.1f rows a day, limited', round(rate, 1)) END AS label FROM l""",
}
QUERIES = {name: globals()[name] for name in SQL}
