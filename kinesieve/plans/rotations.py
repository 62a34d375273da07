"""Queries of rotation fits, corrections and fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinesieve.functions.rotation import qexp, vec
from kinesieve.operators import corrections, fields, orientation, rendering, rotfit
from kinesieve.operators.windows import placed
from kinesieve.plans.sequences import KEYS, ORDER, O, S, events
from kinesieve.plans.solvers import GROUP, segmented
from kinesieve.sources.tables import table

#: Events stand for frames, eight a second.
FOLDING = corrections.Folding(rate=8.0, slow=0.4, bound=0.4, step=0.15, jump=0.3)


def fitted_rotation(spark, sf_dir):
    """For each label the rotation from the first three numbers of its vectors to the next three."""
    e = F.col("embedding")
    part = lambda i: vec(*[e[i + j].cast("double") for j in range(3)])
    rows = table(spark, sf_dir, "embeddings").filter("label is not null").select("label", part(0).alias("a"), part(3).alias("b"))
    found = rotfit.fit_rotation(rows, ["label"], "a", "b", 0.5)
    turn = [F.round(F.col("rotvec")[c], 4).alias(f"turn_{c}") for c in "xyz"]
    return found.select("label", "n", *turn, F.round("rms", 5).alias("rms"), F.round("inliers", 5).alias("inliers"))


def measured(df):
    """Step errors on three axes, trusted by k: radians of some size made of value and k."""
    k = F.col("k").cast("double")
    return df.withColumns({"ex": (F.col("value") - 60) / 600, "ey": (k - 50) / 500, "ez": (F.col("value") - k) / 2000, "trust": 0.3 + k / 150})


def folded_correction(spark, sf_dir):
    """The correction at each event of its clip's step errors, segment by segment."""
    return corrections.fold(measured(segmented(spark, sf_dir)), GROUP, ORDER, ["ex", "ey", "ez"], "trust", ["cx", "cy", "cz"], FOLDING).select("clip_id", "event_id", "cx", "cy", "cz")


def composed_correction(spark, sf_dir):
    """Each event's errors on three axes, one axis a round, as one rotation."""
    zero = F.lit(0.0)
    axes = F.array(vec(F.col("ex"), zero, zero), vec(zero, F.col("ey"), zero), vec(zero, zero, F.col("ez")))
    rounds = measured(events(spark, sf_dir)).select("clip_id", "event_id", F.posexplode(axes).alias("round", "turn"))
    out = corrections.compose(rounds, ["clip_id", "event_id"], "round", F.col("turn"))
    return out.select("clip_id", "event_id", *[F.round(F.col("q")[c], 6).alias(f"q_{c}") for c in "wxyz"])


def accepted_rounds(spark, sf_dir):
    """Windows of 16 events in which k lies closer to 50 than the value to 60, by a tenth or more."""
    df = placed(events(spark, sf_dir), KEYS, ORDER)
    out = corrections.accepted_windows(df, KEYS, "place", (F.col("value") - 60) / 60, (F.col("k") - 50) / 50, 16, gain=0.1, least=8)
    return out.select("clip_id", "window", "n", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "accepted")


def monthly_fields(spark, sf_dir):
    """Fields of the steps of tax and discount over quantity and price, by month and flag, from all
    lines and from the odd and the even ones, and what of them changes within some months."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.months_between(F.date_trunc("month", "l_shipdate"), F.lit("1990-01-01")).cast("int").alias("month"), (F.col("l_linenumber") % 2).alias("half"),
        (F.col("l_quantity") - 25).alias("x"), (F.col("l_extendedprice") / 2000 - 25).alias("y"), (F.col("l_tax") * 100).alias("dx"), (F.col("l_discount") * 100).alias("dy"),
    )
    keys = ["l_returnflag", "month"]
    whole = fields.fit_fields(rows.drop("half"), keys, 1, 25.0, 5.0, rounds=4).select(*keys, F.col("n").alias("support"), F.col("field").alias("speed"))
    halves = fields.fit_fields(rows, [*keys, "half"], 1, 25.0, 5.0, rounds=4).groupBy(*keys)
    sides = halves.agg(F.max(F.when(F.col("half") == 1, F.col("field"))).alias("first"), F.max(F.when(F.col("half") == 0, F.col("field"))).alias("second"))
    frames = whole.join(sides, keys, "left").withColumn("change", F.lit(None).cast("array<double>"))
    band = fields.Band(rate=12.0, low=0.5, high=4.0, swap=0.3, few=1.0, enough=20.0, noise_span=2.0)
    out = fields.solve_fields(frames, ["l_returnflag"], ["month"], 6, band, halves=True, stretch=1200)
    return out.select("l_returnflag", "month", *[F.round(F.col("field")[i], 4).alias(f"field_{i}") for i in range(6)], F.round("shown", 4).alias("shown"))


def turned(spark, sf_dir):
    """Orientations of a clip's events: turns about three axes by value and k."""
    df = measured(segmented(spark, sf_dir))
    return df.withColumn("q", qexp(vec(F.col("ex"), F.col("ey"), F.col("ez"))))


def calm_orientation(spark, sf_dir):
    """The events' orientations without what turns faster than a tenth of their rate."""
    df = turned(spark, sf_dir).select(*GROUP, *ORDER, *[F.col("q")[c].alias(c) for c in "wxyz"])
    out = orientation.lowpass_orientation(df, GROUP, ORDER, ["w", "x", "y", "z"], 0.1, 1.0, core=512, overlap=128)
    return out.select("clip_id", "event_id", "q_w", "q_x", "q_y", "q_z", "fast_x", "fast_y", "fast_z")


def click_rates(spark, sf_dir):
    """How fast the orientation of the other events turns at each click, in radians a day, over a day."""
    df = turned(spark, sf_dir).withColumn("t", F.col("t") / 86_400_000_000.0)
    clicks = df.filter("event_type = 'click'").select("clip_id", "t", "event_id")
    found = orientation.rate_at(clicks, df.filter("event_type <> 'click'").select("clip_id", "t", "q"), KEYS, 0.5)
    return found.select("clip_id", "event_id", *[F.round(F.col("rate")[c], 5).alias(f"rate_{c}") for c in "xyz"])


#: A lens for the picture that quantity and discount span.
LENS = {"fx": 40.0, "fy": 40.0, "cx": 25.0, "cy": 5.0, "k1": 0.02, "k2": 0.0, "k3": 0.0, "k4": 0.0}


def fitted_render(spark, sf_dir):
    """By return flag and status the turn, spin and focal length that take (quantity, discount) to
    (quantity, tax) as a second picture."""
    rows = table(spark, sf_dir, "lineitem")
    point = lambda u, v: F.struct(F.col(u).cast("double").alias("u"), (F.col(v) * 100).alias("v"))
    lens = F.struct(*[F.lit(v).alias(k) for k, v in LENS.items()])
    matches = rows.select("l_returnflag", "l_linestatus", point("l_quantity", "l_discount").alias("source"), point("l_quantity", "l_tax").alias("render"))
    found = rendering.fit_render(matches, ["l_returnflag", "l_linestatus"], lens, 10.0, (25.0, 5.0), 40.0, c=2.0, rounds=5)
    return found.select("l_returnflag", "l_linestatus", "n", *[F.round(F.col("q")[c], 5).alias(f"q_{c}") for c in "wxyz"], F.round("focal", 3).alias("focal"))


SQL = {
    "accepted_rounds": f"""WITH {S}, p AS (SELECT s.clip_id, s.value, CAST(json_extract(e.props, '$.k') AS INTEGER) AS k, row_number() OVER (PARTITION BY clip_id ORDER BY s.t, s.event_id) - 1 AS place FROM s JOIN events e USING (event_id)),
w AS (SELECT clip_id, place // 16 AS "window", count(*) AS n, sqrt(avg(power((value - 60) / 60, 2))) AS before, sqrt(avg(power((k - 50) / 50.0::DOUBLE, 2))) AS after FROM p WHERE value IS NOT NULL AND k IS NOT NULL GROUP BY 1, 2)
SELECT clip_id, "window", n, round(before, 6) AS before, round(after, 6) AS after, n >= 8 AND after <= 0.9::DOUBLE * before AS accepted FROM w""",
    "composed_correction": f"""WITH {S}, e AS (SELECT s.clip_id, s.event_id, (s.value - 60) / 1200 AS a, (CAST(json_extract(e.props, '$.k') AS DOUBLE) - 50) / 1000 AS b, (s.value - CAST(json_extract(e.props, '$.k') AS DOUBLE)) / 4000 AS c FROM s JOIN events e USING (event_id))
SELECT clip_id, event_id, round(cos(a) * cos(b) * cos(c) - sin(a) * sin(b) * sin(c), 6) AS q_w, round(sin(a) * cos(b) * cos(c) + cos(a) * sin(b) * sin(c), 6) AS q_x,
 round(cos(a) * sin(b) * cos(c) - sin(a) * cos(b) * sin(c), 6) AS q_y, round(cos(a) * cos(b) * sin(c) + sin(a) * sin(b) * cos(c), 6) AS q_z FROM e""",
}
QUERIES = {f.__name__: f for f in (fitted_rotation, folded_correction, composed_correction, accepted_rounds, monthly_fields, calm_orientation, click_rates, fitted_render)}
