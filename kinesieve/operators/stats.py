"""Aggregation, inference and verdicts over runs of measured windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def conditional_rms(value: Column, gate: Column, least: int) -> Column:
    """RMS of the gated rows; null under `least` of them."""
    n = F.count_if(gate & value.isNotNull())
    return F.when(n >= least, F.sqrt(F.avg(F.when(gate, value * value))))


def geometric_ratio(this: Column, other: Column) -> Column:
    """exp(mean log ratio) - 1 over pairs of positive values."""
    return F.exp(F.avg(F.when((this > 0) & (other > 0), F.log(this / other)))) - 1


def log_ratio_spread(this: Column, other: Column) -> Column:
    """RMS of the log ratio."""
    r = F.when((this > 0) & (other > 0), F.log(this / other))
    return F.sqrt(F.avg(r * r))


def finite(text: Column) -> Column:
    """A number that is neither missing, NaN nor infinite; null otherwise."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def poisson_table(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson variable, as far as a double tells them from one."""
    top = int(mean + 12 * np.sqrt(mean) + 30)
    steps = np.log(np.arange(1, top + 1))
    logs = np.arange(top + 1) * np.log(mean) - mean - np.concatenate(([0.0], np.cumsum(steps)))
    return np.cumsum(np.exp(logs))


def scrambled(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1) from 64-bit integers, one for each."""
    x = x * np.uint64(0xD1342543DE82EF95) + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xDABA0B6EB09322E3)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xDABA0B6EB09322E3)
    return (x >> np.uint64(11)).astype(float) / (1 << 53)


def bootstrap_draws(df: DataFrame, keys: list[str], values: list[str], draws: int, seed: int, block: int = 2048) -> DataFrame:
    """(keys, draw, weight, total_<value>...): Poisson bootstrap sums of each draw.

    Equal rows are counted first: the weights of m equal rows add up to one Poisson variable of mean
    m. Each distinct row draws its weights from its own hash and the number of the draw, so neither
    partitions nor batches change them, and no group is gathered in one task.
    """
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    numbers = [F.col(v).cast("double").alias(f"total_{v}") for v in values]
    known = df.select(*keys, *numbers).dropna(subset=[f"total_{v}" for v in values])
    rows = known.groupBy(*known.columns).agg(F.count("*").alias("m"))
    rows = rows.withColumn("h", F.xxhash64(*known.columns, F.lit(seed)))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = np.arange(draws, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for pdf in batches:
            for key, part in pdf.groupby(keys, dropna=False):
                total, weight = np.zeros((len(values), draws)), np.zeros(draws)
                for i in range(0, len(part), block):
                    piece = part.iloc[i : i + block]
                    h, m = piece["h"].to_numpy().view(np.uint64), piece["m"].to_numpy()
                    counts = scrambled(h[:, None] + number)
                    for each in np.unique(m):
                        counts[m == each] = np.searchsorted(poisson_table(each), counts[m == each], side="right")
                    total += piece[[f"total_{v}" for v in values]].to_numpy().T @ counts
                    weight += counts.sum(0)
                out = pd.DataFrame({"draw": np.arange(draws), "weight": weight} | {f"total_{v}": x for v, x in zip(values, total)})
                for k, x in zip(keys, key if isinstance(key, tuple) else (key,)):
                    out[k] = x
                yield out[[*keys, "draw", "weight", *(f"total_{v}" for v in values)]]

    totals = ", ".join(f"total_{v} double" for v in values)
    drawn = rows.mapInPandas(sums, f"{fields}, draw int, weight double, {totals}")
    return drawn.groupBy(*keys, "draw").agg(F.sum("weight").alias("weight"), *(F.sum(f"total_{v}").alias(f"total_{v}") for v in values))


def interval(drawn: DataFrame, keys: list[str], statistic: Column, plain: DataFrame) -> DataFrame:
    """`plain` (keys, n, ...) with lo and hi, the 2.5 and 97.5 % points of the statistic over the
    draws; both null with fewer than two observations."""
    ends = drawn.groupBy(*keys).agg(F.percentile(statistic, 0.025).alias("lo"), F.percentile(statistic, 0.975).alias("hi"))
    few = F.col("n") < 2
    return plain.join(ends, keys).select(*plain.columns, F.when(~few, F.col("lo")).alias("lo"), F.when(~few, F.col("hi")).alias("hi"))


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """(keys, n, mean, lo, hi): percentile interval of the mean by a Poisson bootstrap."""
    plain = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))
    drawn = bootstrap_draws(df, keys, [value], draws, seed)
    return interval(drawn, keys, F.col(f"total_{value}") / F.nullif("weight", F.lit(0.0)), plain)


def bootstrap_difference(df: DataFrame, keys: list[str], this: str, other: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """(keys, n, difference, lo, hi): interval of the mean difference of pairs, drawn as pairs."""
    pairs = df.select(*keys, (F.col(this) - F.col(other)).alias("difference"))
    return bootstrap_mean(pairs, keys, "difference", draws, seed).withColumnRenamed("mean", "difference")


def bootstrap_ratio(df: DataFrame, keys: list[str], this: str, other: str, draws: int = 1000, seed: int = 7) -> DataFrame:
    """(keys, n, ratio, lo, hi): interval of the ratio of two means, drawn as pairs; a draw whose
    denominator is zero does not count."""
    both = df.dropna(subset=[this, other])
    ratio = F.avg(F.col(this).cast("double")) / F.nullif(F.avg(F.col(other).cast("double")), F.lit(0.0))
    plain = both.groupBy(*keys).agg(F.count("*").alias("n"), ratio.alias("ratio"))
    return interval(bootstrap_draws(both, keys, [this, other], draws, seed), keys, F.col(f"total_{this}") / F.nullif(f"total_{other}", F.lit(0.0)), plain)


def verdict(change: Column, band: Column) -> Column:
    """better, worse or same: against a band of what noise explains; null without a measurement."""
    return F.when(change.isNull() | band.isNull(), None).when(change < -band, "better").when(change > band, "worse").otherwise("same")
