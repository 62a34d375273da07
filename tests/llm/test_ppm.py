import math
import zlib
from collections import Counter, defaultdict

import pytest

from kinesieve.llm import ppm
from tests.conftest import TINY

SCHEMA = "doc_id long, text string"


def brute(rows):
    """A trie as dictionaries, walked byte by byte."""
    docs = [(d, (t or "").encode().lower().split()) for d, t in rows]
    held = {i: d is None or zlib.crc32(str(d).encode()) % 7 == 2 for i, (d, _) in enumerate(docs)}
    trie = defaultdict(Counter)
    words = Counter()
    for i, (_, w) in enumerate(docs):
        if held[i]:
            continue
        words.update([*w, b"\n"])
        text = b"\n" * ppm.ORDER + b" ".join(w) + b"\n"
        for p in range(ppm.ORDER, len(text)):
            for k in range(ppm.ORDER + 1):
                trie[text[p - k : p]][text[p]] += 1
    n, v = sum(words.values()), len(words)
    out = []
    for i, (d, w) in enumerate(docs):
        text, score = b"\n" * ppm.ORDER + b" ".join(w) + b"\n", 0.0
        for p in range(ppm.ORDER, len(text)):
            excluded = set()
            for k in range(ppm.ORDER, -1, -1):
                left = {s: c for s, c in trie[text[p - k : p]].items() if s not in excluded}
                total = sum(left.values())
                if text[p] in left:
                    score += math.log10((left[text[p]] - 0.5) / total)
                    break
                if left:
                    score += math.log10(0.5 * len(left) / total)
                excluded |= set(left)
            else:
                score -= math.log10(max(1, 256 - len(trie[b""])))
        tokens = [*w, b"\n"]
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in tokens)
        out.append((d, held[i], len(tokens), sum(words[x] > 0 for x in tokens), n, base, score))
    return out


def compare(spark, rows, **more):
    got = ppm.score(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 3))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute(rows), key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], rel=1e-5, abs=1e-4)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    compare(spark, rows, chunk_bytes=20_000)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, "Aa aa\x00b\nc"), (4, "é" * 300), (5, "x " * 2000), (5, "x y"), (None, "new words"), (7, "\t\r\n")]
    compare(spark, rows)
    assert ppm.score(spark.createDataFrame([], SCHEMA)).collect() == []
    extra = spark.createDataFrame([(1, "a b", 5, "q")], SCHEMA + ", chunk int, kind string")
    assert ppm.score(extra).count() == 1


def test_held_out_documents_score_better_than_words_alone(spark):
    got = ppm.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).filter("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum()


def test_ids_beside_nulls(spark):
    big = (1 << 60) + 1
    out = ppm.score(spark.createDataFrame([(big, "a b"), (None, "b"), (3, "c")], SCHEMA).coalesce(1)).collect()
    held = {r.doc_id: r.held_out for r in out}
    assert held == {big: zlib.crc32(str(big).encode()) % 7 == 2, None: True, 3: zlib.crc32(b"3") % 7 == 2}
