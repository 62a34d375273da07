import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kinesieve.llm import quality
from kinesieve.llm.queries import op7_quality_bayes

DOCS, LABELS = "doc_id long, text string, source string, lang string", "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.1"


def auc(score, truth):
    order = pd.Series(score).rank().to_numpy()
    good = truth.sum()
    return (order[truth].sum() - good * (good + 1) / 2) / (good * (~truth).sum())


def test_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumnsRenamed({"quality": "q", "toxic": "t"})
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 2
    got = op7_quality_bayes(spark, SF).join(labels, "doc_id").filter(held).toPandas()
    assert auc(got["quality"], got["q"].to_numpy() == 1) > 0.9
    assert auc(got["toxic"], got["t"].to_numpy() == 1) > 0.85
    clean, toxic = (got["q"] == 1) & (got["t"] == 0), got["t"] == 1
    assert got.loc[clean, "keep"].mean() > 0.95 and got.loc[toxic, "keep"].mean() < 0.35


def test_sites_shrink(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "a b c", f"host{i % 20}", f"p{i % 3}") for i in range(3000)]
    rate = rng.beta(4, 2, 20)
    labels = [(i, int(rng.random() < rate[i % 20]), None) for i in range(2000)] + [(5000, 1, None)]
    docs = spark.createDataFrame([*rows, (5000, "a b c", "rare", None), (6000, "a b c", None, None)], DOCS)
    got = quality.assess(docs, spark.createDataFrame(labels, LABELS), F.col("source"), F.col("lang")).toPandas().set_index("doc_id").sort_index()
    truth = pd.Series(rate)[[i % 20 for i in range(2000, 3000)]].to_numpy()
    assert np.abs(got.loc[2000:2999, "host_quality"].to_numpy() - truth).mean() < 0.06
    overall = np.mean([x[1] for x in labels])
    assert abs(got.loc[5000, "host_quality"] - overall) < 0.05 and abs(got.loc[6000, "path_quality"] - overall) < 0.05
    assert got["toxic"].isna().all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "s", "l"), (2, "", None, None), (None, "x", "s", "l"), (4, "w " * 20000, "s", "l"), (4, "w", "s", "l")], DOCS).withColumn("quality", F.lit("own"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (4, 0, None), (None, 1, 1), (9, 0, 0)], LABELS)
    assert quality.assess(docs, labels, F.col("source"), F.col("lang")).count() == 5
    assert quality.assess(docs, labels.limit(0), F.col("source"), F.col("lang")).filter("keep").count() == 5
    assert quality.assess(docs.limit(0), labels, F.col("source"), F.col("lang")).collect() == []


def brute_assess(docs, labels, blobs):
    """Everything but the features and the logistic fit, with dictionaries."""
    from collections import Counter, defaultdict

    rows = {d: (host, path) for d, _, host, path in docs}
    out = {d: {} for d in rows}
    for kind, name in enumerate(("quality", "toxic")):
        truth = {d: x[kind] for d, *x in labels if x[kind] is not None and d in rows}
        have, total = (Counter(), Counter()), Counter(truth.values())
        for d, y in truth.items():
            have[y].update(blobs[d])
        weight = {}
        for f in set(have[0]) | set(have[1]):
            p = [(have[y][f] + 0.5) / (total[y] + 1) for y in (0, 1)]
            both = (have[0][f] + have[1][f] + 0.5) / (len(truth) + 1)
            if abs(p[1] - p[0]) / np.sqrt(both * (1 - both) * (1 / total[0] + 1 / total[1])) >= 5:
                weight[f] = np.log(p[1] / p[0])
        evidence = {d: sum(weight.get(f, 0) for f in blobs[d]) for d in rows}
        a, b = quality.calibration(np.array([evidence[d] for d in truth]), np.array([float(y) for y in truth.values()]))
        hosts, paths = defaultdict(list), defaultdict(list)
        for d, y in truth.items():
            hosts[rows[d][0]].append(y)
            paths[rows[d]].append(y)
        rate = (sum(truth.values()) + 0.5) / (len(truth) + 1)

        def strength(groups, centre):
            s = sum(len(v) * (np.mean(v) - centre(k)) ** 2 for k, v in groups.items())
            e = sum(centre(k) * (1 - centre(k)) for k in groups)
            t = sum(len(v) * centre(k) * (1 - centre(k)) for k, v in groups.items())
            tau = (s - e) / max(t - e, 1e-9)
            return 1e6 if tau <= 1e-6 else max(1.0, 1 / tau - 1)

        s_host = strength(hosts, lambda k: rate)
        shrunk = {h: (sum(v) + s_host * rate) / (len(v) + s_host) for h, v in hosts.items()}
        s_path = strength(paths, lambda k: shrunk[k[0]])
        for d, (h, p) in rows.items():
            own = [truth[d]] if d in truth else []
            host = (sum(hosts[h]) - sum(own) + s_host * rate) / (len(hosts[h]) - len(own) + s_host)
            path = (sum(paths[h, p]) - sum(own) + s_path * host) / (len(paths[h, p]) - len(own) + s_path)
            odds = np.clip(a * evidence[d] + b, -12, 12) + np.log(path / (1 - path)) - np.log(rate / (1 - rate))
            out[d] |= {f"host_{name}": host, f"path_{name}": path, name: 1 / (1 + np.exp(-odds))}
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(7)
    docs, labels = [], []
    for d in range(700):
        good, bad = rng.random() < (0.8 if d % 5 else 0.3), rng.random() < 0.3
        words = list(rng.choice([f"w{i}" for i in range(40)], 12)) + ["fine"] * int(good and rng.random() < 0.8) + ["ugly"] * int(bad and rng.random() < 0.9)
        docs.append((d, " ".join(words), f"h{d % 5}", f"p{d % 3}" if d % 11 else None))
        if d < 500:
            labels.append((d, int(good) if d % 7 else None, int(bad)))
    frame = spark.createDataFrame(docs, DOCS)
    features = quality.features(frame, F.col("source"), F.col("lang")).select("doc_id", "f").collect()
    blobs = {r.doc_id: np.frombuffer(bytes(r.f), "<u2").tolist() for r in features}
    expected = brute_assess(docs, labels, blobs)
    got = quality.assess(frame, spark.createDataFrame(labels, LABELS), F.col("source"), F.col("lang")).collect()
    assert len(got) == 700
    for r in got:
        for name, value in expected[r.doc_id].items():
            assert abs(r[name] - value) < 1e-6, (r.doc_id, name)
        assert r["keep"] == (expected[r.doc_id]["quality"] >= 0.25 and expected[r.doc_id]["toxic"] < 0.5)
