import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kinesieve.llm import bpe
from kinesieve.llm.queries import op13_byte_bpe, tokenizer_path
from tests.conftest import TINY

PATH, PATTERN = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["", None, "don't we'll I'VE 'r", " \n\t  x \n", "<|endoftext|>", "a" * 700, "漢字かな" * 200, "  " * 400 + "x", "\n" * 500, "é1!'s" * 150, "\x1c\x1d a  b ", "🙂" * 90, "12345 " * 120, "'re" * 300, "x" * 300 + " " * 300 + "'ll" * 100 + "y" * 500]


@pytest.fixture(scope="module")
def plain():
    return bpe.Tokenizer(PATH, PATTERN).coder


def expected(plain, text):
    ids = plain.encode_ordinary(text or "")
    blob = np.array(ids, "<u4").tobytes()
    return len(ids), hashlib.sha256(blob).hexdigest(), hashlib.sha256(plain.decode_bytes(ids)).hexdigest()


def check(df, texts, plain, **sizes):
    rows = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(df, PATH, PATTERN, **sizes).collect()}
    assert rows == {i: expected(plain, t) for i, t in texts.items()}
    for i, t in texts.items():
        assert rows[i][2] == hashlib.sha256((t or "").encode()).hexdigest()


def test_documents(spark, plain):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(docs, texts, plain)
    check(docs, texts, plain, chunk=200, overlap=24)
    assert op13_byte_bpe(spark, TINY).count() == len(texts)


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 1 << 9), (64, 16), (20, 8)])
def test_odd_texts(spark, plain, chunk, overlap):
    df = spark.createDataFrame([(i, t, "mine", 1) for i, t in enumerate(ODD)], "doc_id long, text string, ids string, piece int").repartition(3)
    check(df, dict(enumerate(ODD)), plain, chunk=chunk, overlap=overlap)


def test_rows_without_and_with_equal_ids(spark, plain):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(None, "a b " * 50), (big, "c" * 90), (big, "c" * 90), (None, None)], "doc_id long, text string")
    rows = bpe.encode_documents(df, PATH, PATTERN, chunk=32, overlap=8).collect()
    want = [(None, *expected(plain, "a b " * 50)), (None, *expected(plain, "")), *[(big, *expected(plain, "c" * 90))] * 2]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert bpe.encode_documents(df.limit(0), PATH, PATTERN).collect() == []


def test_pieces_round_trip(spark, plain):
    text = "It's 1 long text, with\n\nlines  and words; " * 40
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    encoded = bpe.encode(bpe.pieces(df, PATH, PATTERN, chunk=128, overlap=32), PATH, PATTERN)
    parts = sorted(encoded.collect(), key=lambda r: r.piece)
    assert len(parts) > 5 and [r.last for r in parts] == [False] * (len(parts) - 1) + [True]
    assert np.frombuffer(b"".join(r.ids for r in parts), "<u4").tolist() == plain.encode_ordinary(text)
    assert b"".join(r.bytes for r in sorted(bpe.decode(encoded, PATH, PATTERN).collect(), key=lambda r: r.piece)).decode() == text


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("ab'srelv 1.\n\t\xa0é漢"), max_size=120), min_size=1, max_size=60))
def test_any_texts(spark, plain, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    check(df, dict(enumerate(texts)), plain, chunk=12, overlap=6)


def test_same_matches_as_the_tokenizer(plain):
    """The pattern splits every character alike in both libraries."""
    import regex
    import tiktoken

    split = regex.compile(PATTERN)
    whole = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=plain._mergeable_ranks, special_tokens={})
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(every), 64):
        text = "".join(f"a{c}1{c}!{c} {c}  b" for c in every[i : i + 64])
        assert [x for m in split.findall(text) for x in whole.encode_ordinary(m)] == plain.encode_ordinary(text), hex(ord(every[i]))
