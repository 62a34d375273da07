"""A training corpus from raw documents: identify languages, drop repeated lines, near duplicates and
leaked benchmark passages, and pack what is left into sequences.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir) and returns the next one's docs,
which are written as Parquet in between; all but the last keep the columns of documents. A stage
deletes the scratch tables of the stage before it, whose result has been written by then.

Defined cases: rows without doc_id pass every filter; rows that repeat a doc_id are documents
of their own, of which the near-duplicate stage keeps one of each group of similar texts; null texts
are rejected by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesieve.llm import jaccard, langid, linededup, packing, storage, tiling
from kinesieve.llm.queries import table, tokenizer_path

#: The near-duplicate stage: words in a shingle, and the similarity as a fraction.
WIDTH, SIMILAR = 5, (80, 100)
_scratch: list[str] = []


def stage(function: Callable) -> Callable:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        storage.small_batches(spark)
        storage.drop(spark, *_scratch)
        with storage.made() as paths:
            out = function(spark, docs, sf_dir)
        _scratch[:] = paths
        return out

    return run


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known or found; rejected ones go."""
    found = langid.identify(docs, langid.learn(docs))
    return found.filter(~F.col("rejected")).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; n_chars follows the text."""
    out = linededup.filter_lines(docs)
    if "n_chars" in docs.columns:
        _, dropped = linededup.count_names(docs)
        out = out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row, with the smallest doc_id."""
    groups = storage.keep(jaccard.similar_rows(docs, WIDTH, *SIMILAR).select("component", "doc_id", "text_hash"), "groups")
    equal = groups.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    first = equal.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash", "rows")).alias("first"))
    chosen = first.select(F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"), F.col("first.rows").alias("__rows"))
    kept = docs.join(chosen, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__hash")))
    once = kept.filter("__rows = 1").select(*docs.columns)
    again = kept.filter("__rows > 1").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return once.unionByName(again).unionByName(docs.filter(F.col("doc_id").isNull()))


@stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of the benchmark."""
    found = tiling.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(~F.col("contaminated")).select(*docs.columns)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in sequences of 2048 tokens. The workers go on
    to other stages, so they keep a small table of words only."""
    return packing.pack_documents(docs, tokenizer_path(), remembered=250_000)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]
#: Language models and tilings are beyond SQL; the tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, function in STAGES[:-1]:
        out = function(spark, docs, sf_dir)
        path = f"{storage.shared_folder(spark)}/kinesieve/stage-{name}-{storage.unique()}"
        out.write.parquet(path)
        if before:
            storage.drop(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
