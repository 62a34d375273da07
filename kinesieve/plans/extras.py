"""Second-tier queries: masks and envelopes, boxes by prefix sums, fits by normal equations, grids,
formatting and predicates."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinesieve.functions import lens as L
from kinesieve.operators import joins, seq
from kinesieve.plans.matching import positions
from kinesieve.plans.sequences import KEYS, ORDER, O, S, events
from kinesieve.sources.tables import table

DAY = 86_400_000_000


def window_mask(spark, sf_dir):
    """Accepted windows of ten rows (RMS under 100) spread to rows, crossfaded over five."""
    df = seq.row_windows(events(spark, sf_dir), KEYS, ORDER, 10)
    accepted = df.groupBy("clip_id", "win").agg((seq.rms(F.col("value")) < 100).cast("double").alias("a"))
    rows = df.join(accepted, ["clip_id", "win"])
    return rows.select("clip_id", "event_id", F.round(F.avg("a").over(seq.ordered(KEYS, ORDER).rowsBetween(-2, 2)), 5).alias("mask"))


def notch_product(spark, sf_dir):
    """Product of triangular notches of half-width 3 around every error."""
    df = positions(spark, sf_dir)
    near = df.filter("event_type = 'error'").select("clip_id", F.col("k").alias("c"), F.explode(F.sequence(F.col("k") - 3, F.col("k") + 3)).alias("k"))
    factor = near.withColumn("f", F.abs(F.col("k") - F.col("c")) / 4.0).groupBy("clip_id", "k").agg(F.min("f").alias("low"), F.sum(F.log(F.when(F.col("f") > 0, F.col("f")))).alias("s"))
    value = F.when(F.col("low") == 0, 0.0).otherwise(F.exp("s"))
    return df.join(factor, ["clip_id", "k"], "left").select("clip_id", "k", F.round(F.coalesce(value, F.lit(1.0)), 8).alias("gain"))


def zoom_envelope(spark, sf_dir):
    """Closing of the values: largest within three rows, then smallest of those."""
    df = positions(spark, sf_dir)
    w = seq.ordered(["clip_id"], ["k"]).rowsBetween(-3, 3)
    df = df.withColumn("top", F.max("value").over(w))
    return df.select("clip_id", "k", F.min("top").over(w).alias("envelope"))


def box_average(spark, sf_dir):
    """Mean over five rows as the difference of two prefix sums."""
    df = positions(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    w = seq.ordered(["clip_id"], ["k"])
    total = F.sum("cents").over(w.rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("p", total).withColumn("before", F.coalesce(F.lag("p", 3).over(w), F.lit(0)))
    ahead = F.coalesce(F.lead("p", 2).over(w), F.last("p").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    rows = F.least(F.col("k") + 2, F.count("*").over(W.partitionBy("clip_id"))) - F.greatest(F.col("k") - 3, F.lit(0))
    return df.select("clip_id", "k", F.round((ahead - F.col("before")) / rows, 4).alias("cents"))


def first_frame_at(spark, sf_dir):
    """First event of each clip at or after the fifth day of its own time."""
    df = events(spark, sf_dir)
    start = df.groupBy("clip_id").agg((F.min("t") + 5 * DAY).alias("at"))
    return df.join(start, "clip_id").filter("t >= at").groupBy("clip_id").agg(F.min(F.struct("t", "event_id")).alias("x")).select("clip_id", "x.event_id")


def spans_semi_join(spark, sf_dir):
    """Events within three hours after any error of the same clip, errors left out."""
    df = events(spark, sf_dir)
    spans = df.filter("event_type = 'error'").select("clip_id", F.col("event_id").alias("span"), F.col("t").alias("start"), (F.col("t") + DAY // 8).alias("stop"))
    bucket = DAY // 8
    wide = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("stop") / bucket)))).select("clip_id", "b", "start", "stop")
    rows = df.filter("event_type <> 'error'").withColumn("b", F.floor(F.col("t") / bucket))
    inside = (rows.clip_id == wide.clip_id) & (rows.b == wide.b) & (rows.t > wide.start) & (rows.t <= wide.stop)
    return rows.join(wide, inside, "left_semi").select("clip_id", "event_id")


def running_span_merge(spark, sf_dir):
    """Windows of one day around every purchase, merged where they overlap."""
    df = events(spark, sf_dir).filter("event_type = 'purchase'").select("clip_id", "event_id", (F.col("t") - DAY // 2).alias("a"), (F.col("t") + DAY // 2).alias("b"))
    w = W.partitionBy("clip_id").orderBy("a", "event_id")
    reach = F.max("b").over(w.rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumn("new", F.coalesce(F.col("a") > reach, F.lit(True)).cast("int"))
    df = df.withColumn("g", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return df.groupBy("clip_id", "g").agg(F.min("a").alias("start"), F.max("b").alias("stop"), F.count("*").alias("n")).drop("g")


def affine_fit(spark, sf_dir):
    """Plane of price over quantity and tax by supplier, from sums of products."""
    df = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"))
    mean = df.groupBy("l_suppkey").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"))
    d = df.join(mean, "l_suppkey").select("l_suppkey", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"), (F.col("z") - F.col("mz")).alias("z"))
    s = d.groupBy("l_suppkey").agg(*(F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xy", "yy", "xz", "yz")))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    s = s.withColumn("det", det).filter("det > 1e-6")
    return s.select("l_suppkey", F.round((F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / F.col("det"), 5).alias("by_quantity"), F.round((F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / F.col("det"), 5).alias("by_tax"))


def band_medians(spark, sf_dir):
    """Median price in twelve bands of quantity, over all lines and by parity of the line."""
    df = table(spark, sf_dir, "lineitem").withColumn("band", F.least(F.lit(11), F.floor((F.col("l_quantity") - 1) * 12 / 50)).cast("long")).withColumn("parity", (F.col("l_linenumber") % 2).cast("string"))
    out = df.groupingSets([["band"], ["band", "parity"]], "band", "parity").agg(F.round(F.percentile("l_extendedprice", 0.5), 3).alias("median"), F.count("*").alias("n"))
    return out.withColumn("parity", F.coalesce("parity", F.lit("all")))


def parabola_vertex(spark, sf_dir):
    """Lowest of ten groups of each supplier's prices, moved to the vertex of its neighbours."""
    df = table(spark, sf_dir, "lineitem").withColumn("g", (F.col("l_orderkey") % 10).cast("int"))
    cost = df.groupBy("l_suppkey", "g").agg(F.round(F.avg("l_extendedprice"), 2).alias("c"))
    w = W.partitionBy("l_suppkey").orderBy("g")
    cost = cost.withColumn("a", F.lag("c").over(w)).withColumn("b", F.lead("c").over(w)).withColumn("r", F.row_number().over(W.partitionBy("l_suppkey").orderBy("c", "g")))
    inside = F.col("a").isNotNull() & F.col("b").isNotNull()
    bend = F.col("a") - 2 * F.col("c") + F.col("b")
    shift = F.when(inside & (bend > 0), 0.5 * (F.col("a") - F.col("b")) / F.when(bend > 0, bend)).otherwise(0.0)
    return cost.filter("r = 1").select("l_suppkey", inside.alias("interior"), F.round(F.col("g") + shift, 4).alias("vertex"))


def low_frequency_share(spark, sf_dir):
    """Share of the first five harmonics in each clip's energy, by sums of sines and cosines."""
    df = positions(spark, sf_dir).withColumn("n", F.count("*").over(W.partitionBy("clip_id"))).withColumn("x", F.col("value") - F.avg("value").over(W.partitionBy("clip_id")))
    sums = [F.sum(F.col("x") * fn(2 * math.pi * h * (F.col("k") - 1) / F.col("n"))) for h in range(1, 6) for fn in (F.cos, F.sin)]
    power = sum((s * s for s in sums[1:]), sums[0] * sums[0])
    out = df.groupBy("clip_id").agg((2 * power / F.max("n")).alias("p"), F.sum(F.col("x") * F.col("x")).alias("e"))
    return out.filter("e > 0").select("clip_id", F.round(F.col("p") / F.col("e"), 5).alias("share"))


def similarity_parts(spark, sf_dir):
    """Rotation, scale and shears of a 2x2 map made from each part."""
    df = table(spark, sf_dir, "part").select("p_partkey", (1 + F.pmod("p_partkey", F.lit(7)) / 50).alias("a"), (F.pmod("p_partkey", F.lit(11)) / 60).alias("b"), (-F.pmod("p_partkey", F.lit(5)) / 40).alias("c"), (1 + F.col("p_size") / 500).alias("d"))
    rot = F.atan2(F.col("c") - F.col("b"), F.col("a") + F.col("d"))
    scale = F.log(F.sqrt(F.col("a") * F.col("d") - F.col("b") * F.col("c")))
    return df.select("p_partkey", F.round(rot, 6).alias("rot"), F.round(scale, 6).alias("logs"), F.round(L.combined_displacement(F.lit(0.0), F.lit(0.0), rot, scale, 1920, 1080), 4).alias("px"))


def inset_grid(spark, sf_dir):
    """Cosine-spaced grid of 8 by 5 points for each region, weights summing to one."""
    reg = table(spark, sf_dir, "region").select("r_regionkey")
    g = reg.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4))))
    u, v = (F.col("i") + 0.5) / 8 * math.pi, (F.col("j") + 0.5) / 5 * math.pi
    g = g.withColumn("w", F.sin(u) * F.sin(v)).withColumn("x", 0.5 - 0.5 * F.cos(u)).withColumn("y", 0.5 - 0.5 * F.cos(v))
    return g.select("r_regionkey", "i", "j", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round(F.col("w") / F.sum("w").over(W.partitionBy("r_regionkey")), 7).alias("weight"))


def tap_weights(spark, sf_dir):
    """Catmull-Rom weights of four taps at each part's fraction."""
    f = F.pmod(F.col("p_partkey"), F.lit(100)) / 100
    df = table(spark, sf_dir, "part").withColumn("f", f)
    f = F.col("f")
    w = (-0.5 * f + f * f - 0.5 * f * f * f, 1 - 2.5 * f * f + 1.5 * f * f * f, 0.5 * f + 2 * f * f - 1.5 * f * f * f, -0.5 * f * f + 0.5 * f * f * f)
    return df.select("p_partkey", *(F.round(x, 9).alias(f"w{i}") for i, x in enumerate(w)))


def rate_snap(spark, sf_dir):
    """Rates made from parts, snapped to n or n*1000/1001 within 0.005."""
    df = table(spark, sf_dir, "part").select("p_partkey", (24 + F.pmod("p_partkey", F.lit(37)) * 1000 / 1001 + F.pmod("p_partkey", F.lit(3)) / 500).alias("rate"))
    ntsc = F.round(F.col("rate") * 1001 / 1000) * 1000 / 1001
    whole = F.round(F.col("rate"))
    snapped = F.when(F.abs(F.col("rate") - whole) <= 0.005, whole).when(F.abs(F.col("rate") - ntsc) <= 0.005, ntsc).otherwise(F.col("rate"))
    return df.select("p_partkey", F.round("rate", 6).alias("rate"), F.round(snapped, 6).alias("snapped"))


def median_rate(spark, sf_dir):
    """Rows a day from the median step, refined by the mean of steps within half of it."""
    df = events(spark, sf_dir).withColumn("dt", F.col("t") - F.lag("t").over(seq.ordered(KEYS, ORDER))).filter("dt > 0")
    typical = df.groupBy("clip_id").agg(F.percentile("dt", 0.5).alias("m"))
    near = df.join(typical, "clip_id").filter("dt BETWEEN 0.5 * m AND 1.5 * m")
    return near.groupBy("clip_id").agg(F.round(DAY / F.avg("dt"), 4).alias("rate"), F.count("*").alias("n"))


def text_labels(spark, sf_dir):
    """Times, sizes, keys and labels as text."""
    df = events(spark, sf_dir).withColumn("s", F.floor(F.col("t") / 1_000_000) % 86_400).withColumn("bytes", F.col("event_id") * 37_501)
    time_ = F.concat(F.floor(F.col("s") / 60).cast("string"), F.lit(":"), F.lpad((F.col("s") % 60).cast("string"), 2, "0"))
    size = F.when(F.col("bytes") < 1000, F.concat(F.col("bytes").cast("string"), F.lit(" B"))).when(F.col("bytes") < 1_000_000, F.concat(F.floor(F.col("bytes") / 1000).cast("string"), F.lit(" kB"))).otherwise(F.concat(F.floor(F.col("bytes") / 1_000_000).cast("string"), F.lit(" MB")))
    level = F.when(F.col("value") > 100, "high").when(F.col("value") > 30, "medium").otherwise("low")
    key = F.concat_ws(":", F.col("clip_id").cast("string"), F.concat_ws("-", F.col("s").cast("string"), (F.col("s") + 60).cast("string")))
    return df.select("event_id", time_.alias("time"), size.alias("size"), level.alias("level"), key.alias("key"))


def lenient_parse(spark, sf_dir):
    """Numbers, progress and paths read from text; what cannot be read is null."""
    df = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("done "), F.col("p_size"), F.lit("/"), F.col("p_partkey"), F.lit(" in /Users/"), F.lower("p_brand"), F.lit("/x")).alias("line"), F.when(F.col("p_partkey") % 4 == 0, F.lit("nan")).when(F.col("p_partkey") % 4 == 1, F.lit("x1")).otherwise(F.col("p_size").cast("string")).alias("raw"))
    from kinesieve.operators.stats import finite

    done = F.regexp_extract("line", r"done (\d+)/(\d+)", 1).cast("int")
    total = F.regexp_extract("line", r"done (\d+)/(\d+)", 2).cast("int")
    return df.select("p_partkey", done.alias("done"), total.alias("total"), F.regexp_replace("line", r"/Users/[^/]+", "~").alias("line"), finite(F.col("raw")).alias("number"))


def exclusive_pairs(spark, sf_dir):
    """Pairs of priorities that no customer's orders share."""
    df = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct()
    # all pairs of the distinct values, which must be few: one row holds them
    values = df.agg(F.collect_set("o_orderpriority").alias("v"))
    values = values.select(F.when(F.size("v") <= 1000, F.col("v")).otherwise(F.raise_error(F.lit("over 1,000 priorities"))).alias("v"))
    both = values.select("v", F.explode("v").alias("a")).select("a", F.explode("v").alias("b")).filter("a < b")
    seen = df.alias("x").join(df.alias("y"), "o_custkey").filter("x.o_orderpriority < y.o_orderpriority").groupBy(F.col("x.o_orderpriority").alias("a"), F.col("y.o_orderpriority").alias("b")).agg(F.count("*").alias("n"))
    return both.join(seen, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n_shared"))


def stale_rows(spark, sf_dir):
    """Customers whose latest order is older than 100 days before the last of all, or missing."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    newest = orders.agg(F.max("last").alias("newest"))
    fresh = orders.join(F.broadcast(newest), F.col("last") >= F.col("newest") - F.expr("INTERVAL 100 DAYS"))
    return table(spark, sf_dir, "customer").join(fresh, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def common_keys(spark, sf_dir):
    """Keys of two configurations: in both, in one only."""
    df = table(spark, sf_dir, "lineitem")
    one, two = df.filter("l_returnflag = 'R'").select("l_partkey"), df.filter("l_linestatus = 'O'").select("l_partkey")
    both = one.intersect(two).withColumn("where_", F.lit("both"))
    return both.unionByName(one.subtract(two).withColumn("where_", F.lit("first"))).unionByName(two.subtract(one).withColumn("where_", F.lit("second")))


def polygon_area(spark, sf_dir):
    """Area of each part's quadrilateral by the shoelace formula, over arrays."""
    x = F.array(F.lit(0.0), F.col("p_size") / 2, F.col("p_size").cast("double"), F.pmod("p_partkey", F.lit(9)) / 3)
    y = F.array(F.lit(0.0), F.pmod("p_partkey", F.lit(4)) * 1.0, F.col("p_size") / 3, F.lit(10.0))
    df = table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), y.alias("y"))
    term = lambda i: F.col("x")[i] * F.col("y")[(i + 1) % 4] - F.col("x")[(i + 1) % 4] * F.col("y")[i]
    return df.select("p_partkey", F.round(F.abs(sum((term(i) for i in range(1, 4)), term(0))) / 2, 4).alias("area"))


def signed_rank(spark, sf_dir):
    """Wilcoxon's signed-rank sums of the paired runs of each supplier, ties at mean ranks."""
    df = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_extendedprice") - F.avg(F.col("l_quantity") * 1500), 2).alias("d")).filter("d <> 0")
    w = W.partitionBy("l_returnflag").orderBy(F.abs("d"))
    tied = W.partitionBy("l_returnflag", F.abs("d"))
    df = df.withColumn("rank", F.rank().over(w) + (F.count("*").over(tied) - 1) / 2)
    plus, minus = F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.sum(F.when(F.col("d") < 0, F.col("rank")))
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.coalesce(plus, F.lit(0.0)).alias("plus"), F.coalesce(minus, F.lit(0.0)).alias("minus"))


def sensor_agreement(spark, sf_dir):
    """Correlation of clicks with the rows of other types just before them, with 10 pairs or more."""
    df = events(spark, sf_dir)
    left, right = df.filter("event_type = 'click'").select("clip_id", "event_id", "t", "value"), df.filter("event_type <> 'click'").select("clip_id", "event_id", "t", F.col("value").alias("other"))
    both = joins.asof(left, right, "clip_id", "t", "event_id", ["other"]).filter("other_r IS NOT NULL")
    return both.groupBy("clip_id").agg(F.count("*").alias("n"), F.round(F.corr("value", "other_r"), 6).alias("corr")).filter("n >= 10")


P = f"{S}, p AS (SELECT clip_id, event_id, t, row_number() OVER ({O}) AS k, count(*) OVER (PARTITION BY clip_id) AS n, event_type, value FROM s)"
SQL = {
    "window_mask": f"""WITH {P}, w AS (SELECT *, least((k - 1) // 10, greatest(1, n // 10) - 1) AS win FROM p),
a AS (SELECT clip_id, win, CASE WHEN sqrt(avg(value * value)) < 100 THEN 1.0 ELSE 0.0 END AS a FROM w GROUP BY 1, 2)
SELECT clip_id, event_id, round(avg(CAST(a AS DOUBLE)) OVER ({O} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 5) AS mask FROM w JOIN a USING (clip_id, win)""",
    "notch_product": f"""WITH {P}, f AS (SELECT a.clip_id, a.k, min(abs(a.k - b.k)) AS low, sum(CASE WHEN a.k <> b.k THEN ln(abs(a.k - b.k) / 4.0) END) AS s
FROM p a JOIN p b ON a.clip_id = b.clip_id AND b.event_type = 'error' AND abs(a.k - b.k) <= 3 GROUP BY 1, 2)
SELECT p.clip_id, p.k, round(coalesce(CASE WHEN low = 0 THEN 0.0 ELSE exp(s) END, 1.0), 8) AS gain FROM p LEFT JOIN f ON p.clip_id = f.clip_id AND p.k = f.k""",
    "zoom_envelope": f"""WITH {P}, m AS (SELECT *, max(value) OVER (PARTITION BY clip_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM p)
SELECT clip_id, k, min(top) OVER (PARTITION BY clip_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS envelope FROM m""",
    "box_average": f"WITH {P} SELECT clip_id, k, round(sum(CAST(round(value * 100) AS BIGINT)) OVER w / CAST(count(*) OVER w AS DOUBLE), 4) AS cents FROM p WINDOW w AS (PARTITION BY clip_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "first_frame_at": f"WITH {P}, a AS (SELECT *, min(t) OVER (PARTITION BY clip_id) + {5 * DAY} AS at_ FROM p) SELECT clip_id, arg_min(event_id, k) AS event_id FROM a WHERE t >= at_ GROUP BY 1",
    "spans_semi_join": f"WITH {S} SELECT clip_id, event_id FROM s a WHERE event_type <> 'error' AND EXISTS (SELECT 1 FROM s b WHERE b.clip_id = a.clip_id AND b.event_type = 'error' AND a.t > b.t AND a.t <= b.t + {DAY // 8})",
    "running_span_merge": f"""WITH {S}, d AS (SELECT clip_id, event_id, t - {DAY // 2} AS a, t + {DAY // 2} AS b FROM s WHERE event_type = 'purchase'),
m AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY clip_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM d),
g AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY a, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT clip_id, min(a) AS start, max(b) AS stop, count(*) AS n FROM g GROUP BY clip_id, g""",
    "affine_fit": """WITH d AS (SELECT l_suppkey, l_quantity AS x, l_tax * 100 AS y, l_extendedprice / 1000 AS z FROM lineitem),
s AS (SELECT l_suppkey, regr_sxx(x, x) AS xx, regr_sxy(x, y) AS xy, regr_sxx(y, y) AS yy, regr_sxy(x, z) AS xz, regr_sxy(y, z) AS yz FROM d GROUP BY 1)
SELECT l_suppkey, round((xz * yy - yz * xy) / (xx * yy - xy * xy), 5) AS by_quantity, round((yz * xx - xz * xy) / (xx * yy - xy * xy), 5) AS by_tax FROM s WHERE xx * yy - xy * xy > 1e-6""",
    "band_medians": """WITH d AS (SELECT *, CAST(least(11, floor((l_quantity - 1) * 12 / 50)) AS BIGINT) AS band, CAST(l_linenumber % 2 AS VARCHAR) AS parity FROM lineitem)
SELECT band, coalesce(parity, 'all') AS parity, round(median(l_extendedprice), 3) AS median, count(*) AS n FROM d GROUP BY GROUPING SETS ((band), (band, d.parity))""",
    "parabola_vertex": """WITH c AS (SELECT l_suppkey, l_orderkey % 10 AS g, round(avg(l_extendedprice), 2) AS c FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, lag(c) OVER w AS a, lead(c) OVER w AS b, row_number() OVER (PARTITION BY l_suppkey ORDER BY c, g) AS r FROM c WINDOW w AS (PARTITION BY l_suppkey ORDER BY g))
SELECT l_suppkey, a IS NOT NULL AND b IS NOT NULL AS interior, round(g + CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a - 2 * c + b > 0 THEN 0.5 * (a - b) / (a - 2 * c + b) ELSE 0.0 END, 4) AS vertex FROM n WHERE r = 1""",
    "low_frequency_share": f"""WITH {P}, x AS (SELECT clip_id, k, n, value - avg(value) OVER (PARTITION BY clip_id) AS x FROM p), h AS (SELECT CAST(unnest(range(1, 6)) AS DOUBLE) AS h),
q AS (SELECT clip_id, h, max(n) AS n, sum(x * cos(2 * pi() * h * (k - 1) / n)) AS c, sum(x * sin(2 * pi() * h * (k - 1) / n)) AS s, sum(x * x) AS e FROM x CROSS JOIN h GROUP BY 1, 2)
SELECT clip_id, round(sum(2 * (c * c + s * s) / n) / max(e), 5) AS share FROM q GROUP BY 1 HAVING max(e) > 0""",
    "similarity_parts": """WITH m AS (SELECT p_partkey, 1 + (p_partkey % 7) / 50.0::DOUBLE AS a, (p_partkey % 11) / 60.0::DOUBLE AS b, -(p_partkey % 5) / 40.0::DOUBLE AS c, 1 + p_size / 500.0::DOUBLE AS d FROM part),
r AS (SELECT p_partkey, atan2(c - b, a + d) AS rot, ln(sqrt(a * d - b * c)) AS logs FROM m)
SELECT p_partkey, round(rot, 6) AS rot, round(logs, 6) AS logs, round(sqrt((rot * rot + logs * logs) * (1920 * 1920 + 1080 * 1080) / 12), 4) AS px FROM r""",
    "inset_grid": """WITH g AS (SELECT r_regionkey, i, j, (i + 0.5) / 8.0::DOUBLE * pi() AS u, (j + 0.5) / 5.0::DOUBLE * pi() AS v FROM region, (SELECT CAST(unnest(range(8)) AS INTEGER) AS i), (SELECT CAST(unnest(range(5)) AS INTEGER) AS j))
SELECT r_regionkey, i, j, round(0.5 - 0.5 * cos(u), 6) AS x, round(0.5 - 0.5 * cos(v), 6) AS y, round(sin(u) * sin(v) / sum(sin(u) * sin(v)) OVER (PARTITION BY r_regionkey), 7) AS weight FROM g""",
    "tap_weights": """WITH d AS (SELECT p_partkey, (p_partkey % 100) / 100.0::DOUBLE AS f FROM part)
SELECT p_partkey, round(-0.5::DOUBLE * f + f * f - 0.5::DOUBLE * f * f * f, 9) AS w0, round(1 - 2.5::DOUBLE * f * f + 1.5::DOUBLE * f * f * f, 9) AS w1, round(0.5::DOUBLE * f + 2 * f * f - 1.5::DOUBLE * f * f * f, 9) AS w2, round(-0.5::DOUBLE * f * f + 0.5::DOUBLE * f * f * f, 9) AS w3 FROM d""",
    "rate_snap": """WITH d AS (SELECT p_partkey, 24 + (p_partkey % 37) * 1000 / 1001.0::DOUBLE + (p_partkey % 3) / 500.0::DOUBLE AS rate FROM part)
SELECT p_partkey, round(rate, 6) AS rate, round(CASE WHEN abs(rate - round(rate)) <= 0.005 THEN round(rate) WHEN abs(rate - round(rate * 1001 / 1000) * 1000 / 1001) <= 0.005 THEN round(rate * 1001 / 1000) * 1000 / 1001 ELSE rate END, 6) AS snapped FROM d""",
    "median_rate": f"""WITH {S}, d AS (SELECT * FROM (SELECT clip_id, t - lag(t) OVER ({O}) AS dt FROM s) WHERE dt > 0), m AS (SELECT clip_id, median(dt) AS m FROM d GROUP BY 1)
SELECT clip_id, round({DAY}.0 / avg(dt), 4) AS rate, count(*) AS n FROM d JOIN m USING (clip_id) WHERE dt BETWEEN 0.5 * m AND 1.5 * m GROUP BY 1""",
    "text_labels": f"""WITH {S}, d AS (SELECT *, t // 1000000 % 86400 AS sec, event_id * 37501 AS bytes FROM s)
SELECT event_id, (sec // 60) || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') AS time, CASE WHEN bytes < 1000 THEN bytes || ' B' WHEN bytes < 1000000 THEN (bytes // 1000) || ' kB' ELSE (bytes // 1000000) || ' MB' END AS size,
CASE WHEN value > 100 THEN 'high' WHEN value > 30 THEN 'medium' ELSE 'low' END AS level, clip_id || ':' || sec || '-' || (sec + 60) AS key FROM d""",
    "lenient_parse": r"""WITH d AS (SELECT p_partkey, p_size, 'done ' || p_size || '/' || p_partkey || ' in /Users/' || lower(p_brand) || '/x' AS line FROM part)
SELECT p_partkey, CAST(regexp_extract(line, 'done (\d+)/(\d+)', 1) AS INTEGER) AS done, CAST(regexp_extract(line, 'done (\d+)/(\d+)', 2) AS INTEGER) AS total, regexp_replace(line, '/Users/[^/]+', '~', 'g') AS line,
CASE WHEN p_partkey % 4 >= 2 THEN CAST(p_size AS DOUBLE) END AS number FROM d""",
    "exclusive_pairs": """WITH d AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders), v AS (SELECT DISTINCT o_orderpriority AS p FROM d),
s AS (SELECT x.o_orderpriority AS a, y.o_orderpriority AS b, count(*) AS n FROM d x JOIN d y ON x.o_custkey = y.o_custkey AND x.o_orderpriority < y.o_orderpriority GROUP BY 1, 2)
SELECT v.p AS a, w.p AS b, coalesce(n, 0) AS n_shared FROM v JOIN v w ON v.p < w.p LEFT JOIN s ON s.a = v.p AND s.b = w.p""",
    "stale_rows": """WITH o AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1)
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM o WHERE last >= (SELECT max(last) FROM o) - INTERVAL 100 DAY)""",
    "common_keys": """WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linestatus = 'O')
SELECT l_partkey, 'both' AS where_ FROM a WHERE l_partkey IN (FROM b) UNION ALL SELECT l_partkey, 'first' FROM a WHERE l_partkey NOT IN (FROM b) UNION ALL SELECT l_partkey, 'second' FROM b WHERE l_partkey NOT IN (FROM a)""",
    "polygon_area": """WITH d AS (SELECT p_partkey, [0.0::DOUBLE, p_size / 2.0::DOUBLE, p_size::DOUBLE, (p_partkey % 9) / 3.0::DOUBLE] AS x, [0.0::DOUBLE, (p_partkey % 4) * 1.0::DOUBLE, p_size / 3.0::DOUBLE, 10.0::DOUBLE] AS y FROM part)
SELECT p_partkey, round(abs(x[1]*y[2]-x[2]*y[1] + x[2]*y[3]-x[3]*y[2] + x[3]*y[4]-x[4]*y[3] + x[4]*y[1]-x[1]*y[4]) / 2, 4) AS area FROM d""",
    "signed_rank": """WITH d AS (SELECT l_suppkey, l_returnflag, round(avg(l_extendedprice) - avg(l_quantity * 1500), 2) AS d FROM lineitem GROUP BY 1, 2), e AS (SELECT * FROM d WHERE d <> 0),
r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_returnflag, abs(d)) - 1) / 2.0::DOUBLE AS r FROM e)
SELECT l_returnflag, count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0.0) AS plus, coalesce(sum(r) FILTER (WHERE d < 0), 0.0) AS minus FROM r GROUP BY 1""",
    "sensor_agreement": f"""WITH {S}, l AS (SELECT * FROM s WHERE event_type = 'click'), r AS (SELECT * FROM s WHERE event_type <> 'click')
SELECT l.clip_id, count(*) AS n, round(corr(l.value, r.value), 6) AS corr FROM l ASOF JOIN r ON l.clip_id = r.clip_id AND l.t >= r.t GROUP BY 1 HAVING count(*) >= 10""",
}
QUERIES = {name: globals()[name] for name in SQL}
