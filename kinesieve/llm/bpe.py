"""Byte-level BPE over texts of any length, from overlapping chunks.

A long text is cut into chunks that overlap. Each chunk is split by the tokenizer's pattern on its own,
in parallel; where two neighbours have a boundary in common inside their overlap, both split alike from
there on, since what the pattern matches depends only on what follows. A chunk hands over to the next
at the first such boundary that does not follow white space, so the pieces between these points split
by themselves as they do within the text, and are encoded one by one. Neighbours without a common
boundary (one word longer than the overlap, say) are glued together and split anew until none is left.
Decoding concatenates the tokens' bytes.

Defined cases: a null text is empty; rows without doc_id and rows repeating one are documents of their
own; a text that no boundary divides is one piece; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinesieve.llm.ids import identified, with_ids
from kinesieve.llm.storage import keep

#: Characters in a chunk and in what it shares with the next.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: The pattern looks at most this far past the end of a match of known extent (a fixed value: the
#: longest contraction).
AHEAD = 3
PIECES = "row long, doc_id long, missing boolean, piece int, last boolean, text string"
CHUNKS = "row long, doc_id long, missing boolean, chunk int, start long, size long, last boolean, text string"
_loaded: dict[tuple[str, str], "Tokenizer"] = {}


class Tokenizer:
    """The ranks of a file and their pattern, loaded once in a worker."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def encode(self, text: str) -> np.ndarray:
        return self.coder.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def boundaries(self, text: str) -> np.ndarray:
        """Where the pattern's matches end."""
        return np.cumsum([len(x) for x in self.split.findall(text)], dtype=np.int64)


def tokenizer(path: str, pattern: str) -> Tokenizer:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Tokenizer(path, pattern)
    return _loaded[path, pattern]


def cut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Overlapping chunks (CHUNKS) of texts longer than one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, doc, gone, text in zip(pdf["row"], pdf["doc_id"], pdf["missing"], pdf["text"]):
                starts = range(0, len(text) - overlap, chunk)
                for i in range(0, len(starts), 64):  # a few at a time: a text of any length stays one string
                    part = [(row, doc, gone, k // chunk, k, chunk, k == starts[-1], text[k : k + chunk + overlap]) for k in starts[i : i + 64]]
                    yield pd.DataFrame(part, columns=["row", "doc_id", "missing", "chunk", "start", "size", "last", "text"])

    return docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "missing", "text").mapInPandas(run, CHUNKS)


def shared_boundaries(chunks: DataFrame, path: str, pattern: str, overlap: int) -> DataFrame:
    """(row, chunk, head, tail): boundaries in what a chunk shares with the one before and the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path, pattern)
        for pdf in batches:
            out = []
            for row, chunk, start, size, last, text in zip(pdf["row"], pdf["chunk"], pdf["start"], pdf["size"], pdf["last"], pdf["text"]):
                ends = own.boundaries(text)
                head = ends[ends <= overlap]
                tail = ends[(ends > size) & (ends <= len(text) - AHEAD)] if not last else ends[:0]
                out.append((row, chunk, *[[start + e for e in part.tolist() if not text[e - 1].isspace()] for part in (head, tail)]))
            yield pd.DataFrame(out, columns=["row", "chunk", "head", "tail"])

    return chunks.mapInPandas(run, "row long, chunk int, head array<long>, tail array<long>")


def meeting(marks: DataFrame) -> DataFrame:
    """(row, chunk, meets): where each chunk but a text's first takes over from the one before it; null
    where they have no boundary in common."""
    before = marks.select("row", (F.col("chunk") + 1).alias("chunk"), "tail")
    return marks.select("row", "chunk", "head").join(before, ["row", "chunk"]).select("row", "chunk", F.array_min(F.array_intersect("head", "tail")).alias("meets"))


def glue(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """Chunks that do not meet as one; numbered anew. A text's chunks are narrow rows of one window, as
    many as one text can have."""
    joined = F.coalesce(F.col("apart"), F.lit(False))
    apart = points.select("row", "chunk", F.col("meets").isNull().alias("apart"))
    order = Window.partitionBy("row").orderBy("chunk")
    runs = chunks.select("row", "chunk").join(apart, ["row", "chunk"], "left").select("row", "chunk", (F.sum(F.when(joined, 0).otherwise(1)).over(order) - 1).cast("int").alias("run"))
    parts = F.sort_array(F.collect_list(F.struct("chunk", "start", "size", "last", "text")))
    each = chunks.join(runs, ["row", "chunk"]).groupBy("row", "run").agg(F.first("doc_id").alias("doc_id"), F.first("missing").alias("missing"), parts.alias("parts"))
    end = F.element_at("parts", -1)
    ahead = F.transform(F.slice("parts", F.lit(1), F.size("parts") - 1), lambda x: F.substring(x.text, F.lit(1), x["size"].cast("int")))
    text = F.concat(F.array_join(ahead, ""), end["text"])
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["size"])
    return each.select("row", "doc_id", "missing", F.col("run").alias("chunk"), F.element_at("parts", 1)["start"].alias("start"), size.alias("size"), end["last"].alias("last"), text.alias("text"))


def between(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """Each chunk's text from where it takes over to where the next one does (PIECES)."""
    begin = points.select("row", "chunk", F.col("meets").alias("begin"))
    end = points.select("row", (F.col("chunk") - 1).alias("chunk"), F.col("meets").alias("end"))
    both = chunks.join(begin, ["row", "chunk"], "left").join(end, ["row", "chunk"], "left")
    first = F.coalesce(F.col("begin") - F.col("start"), F.lit(0))
    length = F.coalesce(F.col("end") - F.col("start"), F.length("text").cast("long")) - first
    piece = F.substring("text", (first + 1).cast("int"), length.cast("int"))
    return both.select("row", "doc_id", "missing", F.col("chunk").alias("piece"), "last", piece.alias("text"))


def stitched(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Pieces (PIECES) of long texts that the pattern splits as it splits the whole."""
    chunks, out = keep(cut(docs, chunk, overlap), "chunks"), None
    while True:
        points = keep(meeting(shared_boundaries(chunks.repartition("row", "chunk"), path, pattern, overlap)), "points")
        open_rows = points.filter("meets is null").select("row").distinct()
        if not open_rows.limit(1).count():
            done = between(chunks, points)
            return done if out is None else out.unionByName(done)
        done = between(chunks.join(open_rows, "row", "left_anti"), points)
        out = done if out is None else out.unionByName(done)
        again = chunks.join(open_rows, "row", "left_semi")
        chunks = keep(glue(again, points), "chunks")


def pieces(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of all texts (PIECES); those of a long text lie in one partition, in order."""
    known = with_ids(docs).withColumn("text", F.coalesce("text", F.lit("")))
    long = F.length("text") > chunk + overlap
    parts = stitched(known.filter(long), path, pattern, chunk, overlap)
    parts = parts.repartition("row").sortWithinPartitions("row", "piece")
    whole = known.filter(~long).select(F.lit(0).cast("long").alias("row"), "doc_id", "missing", F.lit(0).alias("piece"), F.lit(True).alias("last"), "text")
    return whole.unionByName(parts)


def encode(parts: DataFrame, path: str, pattern: str) -> DataFrame:
    """Pieces with ids, little-endian unsigned 32-bit, in place of text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path, pattern)
        for pdf in batches:
            yield pdf.drop(columns="text").assign(ids=[own.encode(x).tobytes() for x in pdf["text"]])

    return parts.mapInPandas(run, PIECES.replace("text string", "ids binary"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encoded pieces with their bytes in place of ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path, pattern)
        for pdf in batches:
            yield pdf.drop(columns="ids").assign(bytes=[own.decode(np.frombuffer(x, "<u4")) for x in pdf["ids"]])

    return encoded.mapInPandas(run, PIECES.replace("text string", "bytes binary"))


def digests(parts: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document n_tokens and the hashes of its ids and of the bytes decoded from them. Pieces are
    taken as they come, so a worker holds one of them at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tokenizer(path, pattern)
        n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
        for pdf in batches:
            out = []
            for doc, last, text in zip(identified(pdf), pdf["last"], pdf["text"]):
                ids = own.encode(text)
                n += len(ids)
                of_ids.update(ids.tobytes())
                of_bytes.update(own.decode(ids))
                if last:
                    out.append((doc, n, of_ids.hexdigest(), of_bytes.hexdigest()))
                    n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
            rows = pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            yield rows.assign(doc_id=pd.array([x[0] for x in out], "Int64"))

    return parts.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Every text encoded and decoded again: n_tokens and both digests."""
    return digests(pieces(docs, path, pattern, chunk, overlap), path, pattern)
