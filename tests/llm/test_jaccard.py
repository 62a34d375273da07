import numpy as np
import pytest

from kinesieve.llm import jaccard
from kinesieve.llm.components import components
from tests.conftest import TINY

SCHEMA = "doc_id long, text string"


def brute(rows, width, num, den):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return sorted((d, len(sets[d]), find(d)) for d in ids)


def run(spark, rows, *args):
    return sorted(map(tuple, jaccard.similar_components(spark.createDataFrame(rows, SCHEMA).repartition(3), *args).collect()))


def near_copies(rng, n, families, words=60, edits=4):
    rows = []
    for d in range(n):
        base = np.random.default_rng(d % families).integers(0, 500, words)
        text = base.copy()
        for _ in range(int(rng.integers(0, edits + 1))):
            text[int(rng.integers(0, words))] = int(rng.integers(1000, 9000))
        rows.append((d, " ".join(f"w{x}" for x in text)))
    return rows


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_families(spark, width, num):
    rows = near_copies(np.random.default_rng(1), 240, 6)
    # one passage in many documents that are otherwise different
    passage = " ".join(f"p{i}" for i in range(80))
    rng = np.random.default_rng(2)
    rows += [(1000 + i, passage + " " + " ".join(f"u{x}" for x in rng.integers(0, 10**6, int(rng.integers(2, 14))))) for i in range(80)]
    assert run(spark, rows, width, num, 100) == brute(rows, width, num, 100)


def test_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows, 3, 90, 100)


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two"), (8, "a b c"), (9, "A  b\nc "), (10, "x " * 3000), (11, "x x x")]
    assert run(spark, rows) == brute(rows, 3, 90, 100)
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b c d", 5), (1, "a b c d", 5), (None, "a b c d", 5)], SCHEMA + ", n_shingles int")
    assert [tuple(r) for r in jaccard.similar_components(df).collect()] == [(1, 2, 1), (1, 2, 1)]


def just_under(n):
    """Copies of one text, each with two words of its own at places of its own: every pair shares a
    prefix and is under 0.9, though each is over 0.9 with the text itself, which is not there."""
    rng = np.random.default_rng(n)
    rows = []
    for d in range(n):
        words = [f"w{i}" for i in range(110)]
        for at in rng.choice(108, 2, replace=False):
            words[at + 1] = f"own{d}x{at}"
        rows.append((d, " ".join(words)))
    return rows


def test_compared_pairs_grow_linearly(spark):
    compared = []
    for n in (60, 120, 240):
        counts = []
        out = jaccard.similar_rows(spark.createDataFrame(just_under(n), SCHEMA), 3, 90, 100, counts=counts)
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == brute(just_under(n), 3, 90, 100)
        compared.append(sum(counts))
    # a few for each document, however many there are; all pairs would be 28,680 at the end
    assert compared[2] < 4.5 * compared[0] and compared[2] < 10 * 240


def test_rows_that_share_an_id(spark):
    words = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, words), (1, "something else altogether"), (2, words), (2, words + " more"), (3, None)], SCHEMA)
    rows = jaccard.similar_rows(df, 3, 90, 100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(1, 1, 1), (1, 28, 1), (2, 28, 1), (2, 29, 1), (3, 0, 3)]
    assert len({r.component for r in rows}) == 3  # the other text of id 1 is not part of the group


@pytest.mark.parametrize("num", [80, 90])
def test_random_sets(spark, num):
    """Texts of 1 to 40 words that differ in a few, where rounding decides."""
    rng = np.random.default_rng(num)
    rows = []
    for d in range(300):
        base = np.random.default_rng(d % 12).integers(0, 40, int(np.random.default_rng(d % 12).integers(1, 41)))
        keep = base[rng.random(len(base)) > 0.04]
        rows.append((d, " ".join(f"w{x}" for x in np.append(keep, rng.integers(0, 40, int(rng.integers(0, 3)))))))
    assert run(spark, rows, 1, num, 100) == brute(rows, 1, num, 100)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
