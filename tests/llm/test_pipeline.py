import corpus_pipeline
from kinesieve.llm import linededup
from kinesieve.llm.queries import tokenizer_path
from tests.conftest import TINY
from tests.llm.test_jaccard import brute as groups_of
from tests.llm.test_linededup import brute as lines_of
from tests.llm.test_packing import verify
from tests.llm.test_tiling import brute as coverage_of


def test_stages_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{TINY}/documents.parquet").limit(120)
    items = [r.text for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, TINY)
        path = str(tmp_path / name)
        out.write.parquet(path)
        rows = spark.read.parquet(path)
        if name == "packing":
            verify(rows.collect(), texts, Tokenizer.from_file(tokenizer_path()), 2048)
            break
        assert rows.columns == docs.columns and rows.dtypes == docs.dtypes
        if name == "language_id":
            expected = texts  # none of these documents is without a language
        elif name == "line_dedup":
            expected = {d: t for d, _, _, t in lines_of(list(texts.items()))}
        elif name == "near_duplicates":
            expected = {d: texts[d] for d, _, c in groups_of(list(texts.items()), 5, 80, 100) if d == c}
        else:
            flat = lambda x: " ".join(x.lower().split())
            holds = lambda t: any(f" {flat(x)} " in f" {flat(t)} " for x in items)
            expected = {d: t for d, t in texts.items() if not holds(t)}
            got = {r.doc_id: r.text for r in rows.collect()}
            assert set(got) <= set(expected)
            # what else went holds an item in parts
            for d in set(expected) - set(got):
                assert max(coverage_of(texts[d], x) for x in items) >= 0.8
            expected = {d: expected[d] for d in got}
        got = {r.doc_id: r.text for r in rows.collect()}
        assert got == expected
        texts, docs = got, rows


def test_rejections_and_copies(spark, tmp_path):
    words = " ".join(f"word{i} and the of" for i in range(60))
    rows = [(1, words, "en", "s", 1), (2, words + " more", "en", "s", 1), (2, words + " more", "en", "s", 1), (3, "123 456", "en", "s", 1), (4, None, None, None, None), (None, words, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, function in corpus_pipeline.STAGES[:3]:
        function(spark, docs, TINY).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert sorted((r.doc_id for r in docs.collect()), key=str) == [1, None]


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, TINY)
    assert out.columns[:2] == ["doc_id", "piece"] and out.count() == out.select("sequence_id", "offset").distinct().count()


def test_emptied_documents_stay(spark):
    line = "the same line of more than forty characters in all of them"
    docs = spark.createDataFrame([(i, line, "en") for i in range(6)], "doc_id long, text string, lang string")
    assert linededup.filter_lines(docs).filter("text = ''").count() == 5
