from pyspark.sql import functions as F

from kinesieve.llm import tiling
from tests.conftest import SMALL

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def brute(doc, item, width=5):
    """Greedy string tiling by trying all places, longest match first."""
    d, t = (doc or "").lower().split(), (item or "").lower().split()
    marked_d, marked_t = set(), set()
    while True:
        best = None
        for i in range(len(t)):
            for j in range(len(d)):
                n = 0
                while i + n < len(t) and j + n < len(d) and t[i + n] == d[j + n] and i + n not in marked_t and j + n not in marked_d:
                    n += 1
                if n >= width and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return len(marked_t) / len(t) if t else 0.0
        n, i, j = best
        marked_t.update(range(i, i + n))
        marked_d.update(range(j, j + n))


def leaks(spark, docs, items, **more):
    got = tiling.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **more)
    return {r.doc_id: r for r in got.collect()}


def test_cases(spark):
    words = ITEM.split()
    docs = [
        (1, f"x y {ITEM.upper()} z"),
        (2, " ".join(words[6:] + ["gap"] + words[:6])),
        (3, " ".join(words[:9])),
        (4, " ".join(words[:7] + ["gap"] + words[7:])),
        (5, None),
        (6, ""),
        (7, "alpha " * 3000),
    ]
    items = [(10, ITEM), (11, "too short"), (12, None), (None, ITEM), (13, "alpha " * 20)]
    got = leaks(spark, docs, items)
    for d, text in docs[:6]:
        expected = brute(text, ITEM)
        assert got[d].contaminated == (expected >= 0.8), d
        if expected >= 0.8:
            assert (got[d].item_id, got[d].coverage) == (10, expected)
    assert got[7].item_id == 13 and got[7].coverage == 1.0
    small_blocks = leaks(spark, docs, items, block_words=5)
    assert {d: (r.contaminated, r.item_id, r.coverage) for d, r in small_blocks.items()} == {d: (r.contaminated, r.item_id, r.coverage) for d, r in got.items()}


def test_empty(spark):
    assert leaks(spark, [], [(1, ITEM)]) == {}
    assert not leaks(spark, [(1, ITEM)], [])[1].contaminated
    df = spark.createDataFrame([(1, ITEM, 5)], DOCS + ", item_id int")
    assert tiling.find_leaks(df, spark.createDataFrame([(10, ITEM)], ITEMS)).first().item_id == 10


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(250)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = tiling.find_leaks(docs, spark.createDataFrame(items, ITEMS)).select("doc_id", "text", "contaminated", "item_id").collect()
    flat = lambda x: " ".join(x.lower().split())
    for r in got:
        whole = [i for i, t in items if f" {flat(t)} " in f" {flat(r.text)} "]
        assert not whole or r.contaminated
        if r.contaminated:
            assert brute(r.text, dict(items)[r.item_id]) >= 0.8


def test_query_columns(spark):
    from kinesieve.llm.queries import op8_string_tiling

    got = op8_string_tiling(spark, SMALL)
    assert got.columns == ["doc_id", "contaminated", "n_items", "item_id", "coverage", "item_ids"] and got.filter(F.col("contaminated")).count()
