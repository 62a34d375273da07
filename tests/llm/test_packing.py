import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinesieve.llm import packing
from kinesieve.llm.queries import tokenizer_path
from tests.conftest import TINY

PATH = tokenizer_path()
ODD = ["", None, "don't stop'll 'S", "<|endoftext|> x<|STARTOFTEXT|>y", "J̌ ǰ İ", "ΑΣ ΣΑΣ.", "a\x1cb\x1f c d e", "12.5% A1b2", "x_y__z ~~", "naïvé", "漢字 かな", "Œuvre, été!", "a" * 5000, "ß µ İ K"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def check(plain, texts):
    got = packing.WordEncoder(PATH).encode(["" if t is None else t for t in texts])
    for t, blob in zip(texts, got):
        assert np.frombuffer(blob, "<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_odd_texts(plain):
    check(plain, ODD)


def test_documents(plain, spark):
    check(plain, [r.text for r in spark.read.parquet(f"{TINY}/documents.parquet").collect()])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbBzZéÉΣσ'.,!<|>_19 \t\n\x1c ́ǰJ̌"), max_size=30), max_size=5))
def test_any_text(plain, texts):
    check(plain, texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_bins(lengths):
    sizes = np.array(lengths)
    bins, n = packing.best_fit_decreasing(sizes, 64)
    assert np.bincount(bins, weights=sizes).max() <= 64 and set(bins) == set(range(n))
    assert packing.lower_bound(sizes, 64) <= n


def test_bounds():
    assert packing.lower_bound(np.array([33] * 7), 64) == 7
    assert packing.lower_bound(np.array([22] * 7), 64) == 4


def verify(rows, texts, plain, capacity):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for d, text in texts.items():
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc.pop(d), key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // capacity)))
        for r in parts:
            assert r.start == r.piece * capacity and r.length == min(capacity, len(ids) - r.start)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert not by_doc
    for parts in by_bin.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_bin)


def test_pack(spark, plain):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for groups in (10, 20_000):
        rows = packing.pack(packing.pieces(docs, PATH, 256), 256, per_group=groups).collect()
        n = verify(rows, texts, plain, 256)
        least = -(-sum(r.length for r in rows) // 256)
        assert n <= least * (1.2 if groups == 10 else 1.01) + 1


def test_odd_rows(spark, plain):
    rows = list(enumerate(ODD))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, length string, bin int")
    verify(packing.pack_documents(df, PATH).collect(), dict(rows), plain, 2048)
    assert packing.pack_documents(df.limit(0), PATH).collect() == []
    twice = packing.pack_documents(df.filter("doc_id = 2").union(df.filter("doc_id = 2")), PATH).collect()
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2


def test_ids_beside_nulls(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "a b"), (None, "b"), (3, "c")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in packing.pack_documents(df, PATH).collect()} == {big, None, 3}
