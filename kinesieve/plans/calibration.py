"""Queries that fit models to rows: timing by clip, and unknowns that all groups share."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinesieve.operators import fits, seq, timing
from kinesieve.operators.fits import Unknown
from kinesieve.plans.sequences import KEYS, ORDER, events
from kinesieve.sources.tables import table

DAY = 86_400_000_000.0


def fitted_timing(spark, sf_dir):
    """How far the value of the event before lies behind the values themselves, by clip, in days."""
    df = events(spark, sf_dir).withColumn("day", F.col("t") / DAY)
    samples = df.select("clip_id", F.col("day").alias("t"), F.col("value").alias("v"))
    late = F.lag("value").over(seq.ordered(KEYS, ORDER))
    seen = df.select("clip_id", F.col("event_type").alias("track"), F.col("day").alias("t"), late.alias("y"), (F.col("k") / 100 - 0.5).alias("row"), F.lit(0.0).alias("exposure"))
    found = timing.fit_timing(seen, samples, KEYS, timing.Timing(reach=1.0, loss=20.0, block=3.0, rounds=6), width=1.0)
    return found.select("clip_id", "n", *[F.round(c, 4).alias(c) for c in ("coarse", "fine", "offset", "readout", "gain", "slope", "sigma")], "accepted")


SHARED = [Unknown("bend", step=1e-5), Unknown("discount", step=1e-4, prior=0.0, sigma=0.5)]
OWN = [Unknown("base", step=1e-4), Unknown("price", start=1.0, step=1e-4)]


def price_model(shared, own):
    q = F.col("l_quantity")
    return [F.col("l_extendedprice") / 1000 - own[0] - own[1] * q * (1 + shared[0] * q + shared[1] * F.col("l_discount"))]


def shared_curve(spark, sf_dir):
    """Prices by quantity: each supplier's base and unit price, with one bend and one effect of the
    discount for all."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    shared, own = fits.fit_shared(rows, ["l_suppkey"], price_model, SHARED, OWN, c=10.0, rounds=6)
    return own.select("l_suppkey", "n", F.round(F.col("own")[0], 3).alias("base"), F.round(F.col("own")[1], 4).alias("price"), *[F.lit(round(float(x), 5)).alias(u.name) for x, u in zip(shared, SHARED)])


SQL: dict[str, str] = {}
QUERIES = {f.__name__: f for f in (fitted_timing, shared_curve)}
