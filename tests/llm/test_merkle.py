import hashlib
import zlib

from pyspark.sql import functions as F

from kinesieve.llm import merkle
from kinesieve.llm.queries import op12_merkle_manifest
from tests.conftest import SMALL, TINY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])


def tree(hashes, fanout=3):
    """The root, and each leaf's (left, right) by level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // fanout * fanout : k // fanout * fanout + fanout]
            paths[i].append(("".join(run[: k % fanout]), "".join(run[k % fanout + 1 :])))
            at[i] = k // fanout
        level = [h(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append((r, leaf_of(r, r["text"])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, inner = {}, {}
    for s in names:
        groups[s].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        subs[s], inner[s] = tree([x[1] for x in groups[s]])
    root, outer = tree([subs[s] for s in names])
    out = []
    for s, top in zip(names, outer):
        for (r, own), path in zip(groups[s], inner[s]):
            path = path + top
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            now = leaf_of(r, text)
            for left, right in path:
                now = h(left, now, right)
            out.append((r["doc_id"], own, subs[s], root, h(*[a + b for a, b in path]), now, now == root))
    return sorted(out, key=str)


def same(df, rows):
    got = df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_documents(spark):
    same(op12_merkle_manifest(spark, TINY), [r.asDict() for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()])


def test_odd_rows(spark):
    rows = [(5, "a\nb", None, "x", 3), (5, "a\nb", None, "x", 3), (None, None, None, None, None), (7, "", "", "", 0), (8, "é\n\n" * 5000, "fr", "ü", None), (9, "c", "de", "z", 1), (None, "b", "en", "x", 1), (3, "\n", "en", "", 1)]
    rows += [(100 + i, f"t{i}\n", "en", "hot", i) for i in range(31)]
    df = spark.createDataFrame([(*r, "mine", 4) for r in rows], SCHEMA)
    fields = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows]
    same(merkle.verify_documents(df), fields)
    same(merkle.verify_documents(df.repartition(9)), fields)
    assert merkle.verify_documents(df.limit(0)).collect() == []
    one = df.filter("doc_id = 9")
    same(merkle.verify_documents(one), [x for x in fields if x["doc_id"] == 9])


def test_all_rows_in_one_group(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("source", F.lit("only"))
    same(merkle.verify_documents(docs), [r.asDict() for r in docs.collect()])


def test_fanout_is_a_parameter(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = merkle.manifest(docs, [F.col("text")], F.col("lang"), F.col("doc_id"), fanout=5)
    checked = merkle.verified(rows).agg(F.count("*"), F.sum(F.col("verified").cast("int"))).first()
    assert checked[0] == checked[1] == docs.count()
