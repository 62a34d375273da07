"""Line deduplication over levelled sorted runs of line hashes.

The index is a set of runs: tables of (h1, h2, n_docs, keeper), each sorted by hash. A batch of
documents anti-joins the runs to find the lines that are new; those enter with the batch's own
largest doc_id as their keeper, and known lines only add to the count. `fanout` runs of one level
are merged into one run of the next. Batches come in falling order of doc_id, so the first batch
that holds a line holds its keeper too.

Defined cases: null or empty text is one empty line; a doc_id that several rows share counts as one
document and its rows are treated alike; rows without doc_id pass unchanged and are counted nowhere;
an empty table gives no rows; other columns pass through filter_lines() untouched, and where one has the
name of a result, the result's name gets underscores (count_names); a text of very many lines costs
their number times the logarithm of that of its lost keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinesieve.llm.storage import drop, drop_table, keep, new_path

#: White space that is stripped from both ends of a line (fixed values).
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many keys are tried one by one.
FEW = 32
RUN = "h1 long, h2 long, n_docs long, keeper long"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def held(keys: Column, wanted: Column) -> Column:
    """Whether the sorted keys hold this one, by halving where they are many."""
    n = F.size(keys)

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        under = F.coalesce(F.get(keys, middle) < wanted, F.lit(False))
        return F.struct(F.when(under, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(under, s["hi"]).otherwise(middle).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double"))).cast("int"))
    place = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda s: s["lo"])
    return F.when(n <= FEW, F.array_contains(keys, wanted)).otherwise(F.coalesce(F.get(keys, place) == wanted, F.lit(False)))


def count_names(docs: DataFrame) -> tuple[str, str]:
    """What filter_lines() calls its counts: n_lines and n_dropped, or, where docs has such a column, that
    name with as many underscores as make it new."""
    return free_name("n_lines", docs.columns), free_name("n_dropped", docs.columns)


def free_name(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2) of all distinct keys of at least min_chars code points."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("doc_id"), F.explode(text_lines(F.col("text"))).alias("line"))
    keys = rows.select("doc_id", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    return keys.select("doc_id", key_hash(F.col("key")).alias("h")).select("doc_id", "h.h1", "h.h2").distinct()


class LineRuns:
    """Runs by level. The driver holds their paths, a number that grows with the logarithm."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.levels = spark, fanout, {}

    def _write(self, rows: DataFrame, level: int) -> None:
        path = new_path(self.spark, f"run{level}")
        rows.repartition("h1", "h2").sortWithinPartitions("h1", "h2").write.parquet(path)
        self.levels.setdefault(level, []).append(path)

    def rows(self) -> DataFrame:
        """All entries; a line has one for each run that holds it, and one keeper among them."""
        paths = [p for level in self.levels.values() for p in level]
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))

    def add(self, batch: DataFrame) -> None:
        """batch: (doc_id, h1, h2), distinct, of documents that no earlier batch held."""
        own = batch.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("newest"))
        if self.levels:
            # the anti-join, kept as a mark so that the counts of known lines are added in the same pass
            known = self.rows().select("h1", "h2").distinct().withColumn("known", F.lit(True))
            own = own.join(known, ["h1", "h2"], "left")
        else:
            own = own.withColumn("known", F.lit(None).cast("boolean"))
        self._write(own.select("h1", "h2", "n_docs", F.when(F.col("known").isNull(), F.col("newest")).alias("keeper")), 0)
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            paths = self.levels.pop(level)
            self._write(self.merged(self.spark.read.schema(RUN).parquet(*paths)), level + 1)
            drop(self.spark, *paths)
            level += 1


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """(doc_id, keys): per document, the hashes of the line keys that it must lose, sorted."""
    spark = docs.sparkSession
    lines = long_lines(docs, min_chars)
    cuts = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01) if batches > 1 else []
    batch = F.lit(0)
    for cut in sorted({int(c) for c in cuts}):
        batch = batch + F.when(F.col("doc_id") <= F.lit(cut), 1).otherwise(0)
    lines = keep(lines.withColumn("batch", batch.cast("int")), "lines", partition_by="batch")
    runs = LineRuns(spark)
    for b in range(len(set(cuts)) + 1):
        runs.add(lines.filter(F.col("batch") == b).select("doc_id", "h1", "h2"))
    # written, so that the join below reads plain shuffles, of which Spark can split a frequent line's
    frequent = keep(runs.merged(runs.rows()).filter(F.col("n_docs") >= min_docs), "frequent")
    lost = lines.join(frequent.hint("merge"), ["h1", "h2"]).filter(F.col("doc_id") < F.col("keeper"))
    out = keep(lost.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("h1", "h2"))).alias("keys")), "lost")
    for level in runs.levels.values():
        drop(spark, *level)
    drop_table(lines)
    return out


def filter_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All rows and columns of docs with text cleaned, plus n_lines (before) and n_dropped, see count_names()."""
    n_lines, n_dropped = count_names(docs)
    doc, keys, stay = (free_name(name, docs.columns) for name in ("lost_doc", "lost_keys", "lost_stay"))
    lost = repeated_lines(docs, min_chars, min_docs).select(F.col("doc_id").alias(doc), F.col("keys").alias(keys))
    lines = text_lines(F.col("text"))
    kept = F.filter(lines, lambda x: ~F.exists(F.array(key_hash(line_key(x))), lambda h: held(F.col(keys), h)))  # hashed once a line
    # the same plan at every size: the table of lost lines grows with the corpus
    out = docs.join(lost.hint("merge"), F.col("doc_id") == F.col(doc), "left")
    out = out.withColumn(stay, F.when(F.col(keys).isNotNull(), kept)).withColumn(n_lines, F.size(lines).cast("long"))
    out = out.withColumn(n_dropped, F.coalesce(F.col(n_lines) - F.size(stay), F.lit(0)).cast("long"))
    out = out.withColumn("text", F.when(F.col(stay).isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")))
    return out.drop(doc, keys, stay)
