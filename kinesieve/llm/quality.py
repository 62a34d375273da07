"""Quality and toxicity by hierarchical empirical Bayes.

A document's own evidence is the sum of log-likelihood ratios of its features: hashed words and
buckets of shape measures (marks, capitals, repeated words, line lengths). The counts behind the
ratios are grouped sums over all labelled documents. A logistic calibration, fitted on at most
`calibration_docs` labelled documents chosen by a hash of doc_id, makes the evidence a log-odds.

Sites are shrunk level by level: a host's rate is the posterior mean under a Beta prior around the
global rate, a path's under one around its host's rate. The priors' strengths come from the spread of
the rates between groups (method of moments), also by grouped sums: sites with few labels stay near
their parent. A labelled document's own label is taken out of its site's sums before it is scored.

The posterior adds the site's shift against the global rate to the document's log-odds. A document is
kept unless its quality is under `least_quality` (one in four) or its toxicity `most_toxic` (one in
two) or more; the lower bar for quality keeps clean documents that merely look unusual.

Defined cases: null or empty text has the shape features of emptiness only; a null host or path is a
site of its own; unlabelled documents take part in all but the sums; several labels of a doc_id count
as their rounded mean, null labels not at all; without any label of a kind its posterior is null and
does not decide; rows without doc_id are scored as unlabelled; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesieve.llm.kernels import U64, blocks, normalise, words_of
from kinesieve.llm.storage import keep

#: Hashed word features; shape features follow them.
WORDS = 60_000
SHAPES = 8
STEPS = 12
FEATURES = WORDS + SHAPES * STEPS
BLOCK = 1 << 19
LABELS = ("quality", "toxic")
MARKS = "#$%&*|!{}<>=~^_@\\/"


def shape_features(text: str, words: np.ndarray) -> list[int]:
    """One bucket of each measure of a text."""
    n = max(len(text), 1)
    lines = text.split("\n")
    counts = np.unique(words, return_counts=True)[1] if len(words) else np.ones(1)
    measures = (
        sum(map(text.count, MARKS)) / n * 60,
        sum(1 for c in text if c.isupper()) / n * 15,
        sum(1 for c in text if c.isdigit()) / n * 30,
        counts.max() / max(len(words), 1) * 24,
        len(counts) / max(len(words), 1) * 11,
        np.log2(len(words) + 1) * 0.8,
        np.log2(n / len(lines) + 1),
        (len(lines) - len(set(lines))) / len(lines) * 20,
    )
    return [WORDS + k * STEPS + min(STEPS - 1, int(x)) for k, x in enumerate(measures)]


def features(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, f): the sorted distinct features of each document, as 16-bit numbers."""

    @F.pandas_udf("binary")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = ["" if x is None else x for x in part]
            out = []
            for i, j in blocks(np.fromiter(map(len, texts), np.int64, len(texts)), BLOCK):
                words, bounds = words_of([normalise(x) for x in texts[i:j]])
                hashed = (words % U64(WORDS)).astype(np.int64)
                for text, a, b in zip(texts[i:j], bounds[:-1].tolist(), bounds[1:].tolist()):
                    own = np.concatenate((np.unique(hashed[a:b]), shape_features(text, hashed[a:b])))
                    out.append(own.astype("<u2").tobytes())
            yield pd.Series(out, dtype=object)

    return docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), extract(F.col("text")).alias("f"))


def feature_counts(labelled: DataFrame) -> pd.DataFrame:
    """Per label kind and feature, the documents of each class that have it; FEATURES counts all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(LABELS), 2, FEATURES + 1), np.int64)
        for pdf in batches:
            for f, *values in zip(pdf["f"], *(pdf[x] for x in LABELS)):
                own = np.append(np.frombuffer(f, "<u2"), FEATURES)
                for kind, value in enumerate(values):
                    if not pd.isna(value):
                        sums[kind, int(value), own] += 1
        kind, value, feature = np.nonzero(sums)
        yield pd.DataFrame({"kind": kind, "value": value, "feature": feature, "n": sums[kind, value, feature]})

    rows = labelled.select("f", *LABELS).mapInPandas(run, "kind int, value int, feature int, n long")
    return rows.groupBy("kind", "value", "feature").agg(F.sum("n").alias("n")).toPandas()


def weights(counts: pd.DataFrame, least_z: float = 5.0) -> np.ndarray:
    """Log-likelihood ratios by kind and feature; those that chance explains are zero."""
    table = np.zeros((len(LABELS), 2, FEATURES + 1))
    table[counts["kind"], counts["value"], counts["feature"]] = counts["n"]
    total, have = table[:, :, -1:], table[:, :, :-1]
    rate = (have + 0.5) / (total + 1)
    both = (have.sum(1) + 0.5) / (total.sum(1) + 1)
    spread = np.sqrt(both * (1 - both) * (1 / np.maximum(total[:, 0], 1) + 1 / np.maximum(total[:, 1], 1)))
    z = np.abs(rate[:, 1] - rate[:, 0]) / np.maximum(spread, 1e-12)
    return np.where((z >= least_z) & (total.min(1) > 0), np.log(rate[:, 1] / rate[:, 0]), 0.0)


def calibration(evidence: np.ndarray, truth: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and intercept of a logistic regression on one variable: Newton's method on the scaled
    evidence, steps halved until the penalised loss falls, so that separable labels stay finite."""
    if not len(evidence):
        return 1.0, 0.0
    scale = max(float(evidence.std()), 1e-9)
    x = np.stack((evidence / scale, np.ones(len(evidence))), 1)
    penalty = np.diag([ridge, 1e-3])

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -(2 * truth - 1) * (x @ w)).sum() + 0.5 * w @ penalty @ w)

    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - truth) + penalty @ w
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def evidence_of(blobs, table: np.ndarray) -> np.ndarray:
    return np.array([table[:, np.frombuffer(f, "<u2")].sum(1) for f in blobs]).reshape(-1, len(LABELS))


def strength(groups: DataFrame, n: str, good: str, centre: Column) -> float:
    """Pseudo-count of the Beta prior around `centre`, by the method of moments over groups."""
    rate = F.col(good) / F.col(n)
    own = F.col(n) * F.pow(rate - centre, 2)
    noise = centre * (1 - centre)
    row = groups.filter(F.col(n) > 0).agg(F.sum(own).alias("s"), F.sum(noise).alias("e"), F.sum(F.col(n) * noise).alias("t"), F.count("*").alias("g"), F.sum(n).alias("n")).first()
    if not row["g"] or not row["t"]:
        return 1e6
    # E[s] = e + tau (t - e), where tau = 1 / (strength + 1) is the share of variance between groups
    tau = (row["s"] - row["e"]) / max(row["t"] - row["e"], 1e-9)
    return 1e6 if tau <= 1e-6 else max(1.0, 1 / tau - 1)


def site_rates(labelled: DataFrame) -> tuple[DataFrame, dict[str, float], dict[str, tuple[float, float]]]:
    """Grouped sums by path with their host's, the global rates, and the priors' strengths."""
    sums = [e for x in LABELS for e in (F.count(x).alias(f"n_{x}"), F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(f"k_{x}"))]
    paths = labelled.groupBy("host", "path").agg(*sums)
    hosts = paths.groupBy("host").agg(*(F.sum(f"{c}_{x}").alias(f"h{c}_{x}") for x in LABELS for c in "nk"))
    paths = keep(paths.join(hosts.withColumnRenamed("host", "__h"), F.col("host").eqNullSafe(F.col("__h"))).drop("__h"), "sites")
    total = hosts.agg(*(F.sum(f"h{c}_{x}").alias(f"{c}_{x}") for x in LABELS for c in "nk")).first()
    rates, strengths = {}, {}
    for x in LABELS:
        n, k = total[f"n_{x}"] or 0, total[f"k_{x}"] or 0
        rates[x] = (k + 0.5) / (n + 1) if n else None
        if n:
            s = strength(hosts, f"hn_{x}", f"hk_{x}", F.lit(rates[x]))
            host_rate = (F.col(f"hk_{x}") + s * rates[x]) / (F.col(f"hn_{x}") + s)
            strengths[x] = (s, strength(paths, f"n_{x}", f"k_{x}", host_rate))
    return paths, rates, strengths


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def assess(docs: DataFrame, labels: DataFrame, host: Column, path: Column, trains: Column | None = None, calibration_docs: int = 20_000, least_quality: float = 0.25, most_toxic: float = 0.5) -> DataFrame:
    """Per row: doc_id, doc_quality and doc_toxic (own evidence), host_quality, path_quality, host_toxic
    and path_toxic (shrunk rates), quality and toxic (posteriors), keep. Labels of documents for which
    `trains` (on doc_id) is false are not used."""
    means = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.round(F.avg(x)).cast("int").alias(x) for x in LABELS))
    if trains is not None:
        means = means.filter(trains)
    # the same plan at every size: features are made once and meet the labels by merge
    full = keep(features(docs, host, path).join(means.hint("merge"), "doc_id", "left"), "labelled")
    labelled = full.filter(F.coalesce(*LABELS).isNotNull())
    model = weights(feature_counts(labelled))
    n = labelled.count()
    share = int(min(1.0, calibration_docs / max(n, 1)) * (1 << 30))
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).select("f", *LABELS).toPandas()
    evidence = evidence_of(sample["f"], model)
    fits = []
    for kind, x in enumerate(LABELS):
        use = sample[x].notna().to_numpy()
        fits.append(calibration(evidence[use, kind], sample.loc[use, x].to_numpy(float)))
    shared = docs.sparkSession.sparkContext.broadcast((model, fits))

    @F.pandas_udf("quality double, toxic double")
    def own_odds(blobs: pd.Series) -> pd.DataFrame:
        table, fitted = shared.value
        found = evidence_of(blobs, table)
        return pd.DataFrame({x: np.clip(a * found[:, k] + b, -12, 12) for k, (x, (a, b)) in enumerate(zip(LABELS, fitted))})

    sites, rates, strengths = site_rates(labelled)
    sites = sites.withColumnsRenamed({"host": "__h", "path": "__p"})
    out = full.withColumn("odds", own_odds("f")).join(sites, F.col("host").eqNullSafe(F.col("__h")) & F.col("path").eqNullSafe(F.col("__p")), "left")
    for x in LABELS:
        if rates[x] is None:
            out = out.withColumns({f"{c}_{x}": F.lit(None).cast("double") for c in ("doc", "host", "path")} | {f"p_{x}": F.lit(None).cast("double")})
            continue
        s_host, s_path = strengths[x]
        one, mine = F.col(x).isNotNull().cast("int"), F.coalesce(F.col(x), F.lit(0))
        less = lambda c, own: F.coalesce(F.col(c), F.lit(0)) - own
        host_rate = (less(f"hk_{x}", mine) + s_host * rates[x]) / (less(f"hn_{x}", one) + s_host)
        out = out.withColumn(f"host_{x}", host_rate)
        out = out.withColumn(f"path_{x}", (less(f"k_{x}", mine) + s_path * F.col(f"host_{x}")) / (less(f"n_{x}", one) + s_path))
        odds = F.col(f"odds.{x}") + logit(F.col(f"path_{x}")) - F.lit(float(np.log(rates[x] / (1 - rates[x]))))
        out = out.withColumn(f"doc_{x}", 1 / (1 + F.exp(-F.col(f"odds.{x}")))).withColumn(f"p_{x}", 1 / (1 + F.exp(-odds)))
    good = F.coalesce(F.col("p_quality") >= least_quality, F.lit(True)) & F.coalesce(F.col("p_toxic") < most_toxic, F.lit(True))
    return out.select("doc_id", "doc_quality", "doc_toxic", "host_quality", "path_quality", "host_toxic", "path_toxic", F.col("p_quality").alias("quality"), F.col("p_toxic").alias("toxic"), good.alias("keep"))
