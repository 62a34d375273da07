"""Benchmark decontamination by greedy string tiling.

Words are compared in lower case (A-Z). Runs of `width` words shared by a test item and a document
are the seeds; neighbouring seeds on one diagonal join into maximal matches. The longest match is
marked, what it overlaps is cut back to its unmarked parts, and so on until no match of `width`
words is left. The tiles' share of the item's words is its coverage, whatever their order in the
document, so reordered passages count in full.

The items' seeds are a sorted hash array that each task searches with the running hashes of its
documents. Items come in blocks of at most `block_words` words, so what is broadcast is bounded; a
benchmark with more words is searched block by block.

Defined cases: null texts have no words; an item of fewer than `width` words cannot be tested and
matches nothing; rows without item_id are left out; items that share an id count as that id; rows
without doc_id or repeating one are documents of their own; an empty benchmark leaves every document
clean; an empty table gives no rows; other columns pass through, those named like a result are
replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinesieve.llm.kernels import U64, blocks, chain_hashes, normalise, words_of

WIDTH = 5
HITS = "array<struct<item_id:long,coverage:double,tiles:int,longest:int>>"
BLOCK = 1 << 19


def maximal_matches(item_at: np.ndarray, doc_at: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(item position, document position, words) of all runs of seeds on one diagonal."""
    diagonal = doc_at - item_at
    order = np.lexsort((item_at, diagonal))
    i, d = item_at[order], diagonal[order]
    new = np.ones(len(i), bool)
    new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(i))) + width - 1
    return list(zip(i[first].tolist(), (i[first] + d[first]).tolist(), size.tolist()))


def tiles(matches: list[tuple[int, int, int]], width: int) -> list[tuple[int, int, int]]:
    """Longest first, then by place in the item and in the document; none overlaps another."""
    heap = [(-n, i, j) for i, j, n in matches]
    heapq.heapify(heap)
    in_item: set[int] = set()
    in_doc: set[int] = set()
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        n = -n
        free = [i + k not in in_item and j + k not in in_doc for k in range(n)]
        if all(free):
            out.append((i, j, n))
            in_item.update(range(i, i + n))
            in_doc.update(range(j, j + n))
            continue
        begin = None
        for k, is_free in enumerate([*free, False]):
            if is_free and begin is None:
                begin = k
            elif not is_free and begin is not None:
                if k - begin >= width:
                    heapq.heappush(heap, (begin - k, i + begin, j + begin))
                begin = None
    return out


@dataclass
class ItemBlock:
    """Seeds of a block of items: hashes in order, with the item and the place of each."""

    seeds: np.ndarray
    item: np.ndarray
    place: np.ndarray
    ids: np.ndarray
    words: np.ndarray
    width: int

    @classmethod
    def build(cls, ids: list[int], texts: list, width: int) -> "ItemBlock":
        words, bounds = words_of([normalise(x) for x in texts])
        runs = chain_hashes(words, width)
        n = np.maximum(np.diff(bounds) - width + 1, 0)
        item = np.repeat(np.arange(len(ids)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        seeds = runs[bounds[:-1][item] + place] if len(item) else np.zeros(0, U64)
        order = np.argsort(seeds, kind="stable")
        return cls(seeds[order], item[order], place[order], np.array(ids, np.int64), np.diff(bounds), width)

    def hits(self, texts: list, threshold: float) -> list[list[tuple]]:
        """For each text the items covered to the threshold."""
        words, bounds = words_of([normalise(x) for x in texts])
        out: list[list[tuple]] = [[] for _ in texts]
        runs = chain_hashes(words, self.width)
        if not len(runs) or not len(self.seeds):
            return out
        low = np.minimum(np.searchsorted(self.seeds, runs), len(self.seeds) - 1)
        at = np.flatnonzero(self.seeds[low] == runs)
        doc = np.searchsorted(bounds, at, side="right") - 1
        inside = at + self.width <= bounds[doc + 1]
        at, doc = at[inside], doc[inside]
        low = low[at]
        n = np.searchsorted(self.seeds, runs[at], side="right") - low
        each = np.repeat(np.arange(len(at)), n)
        seed = low[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
        doc, place = doc[each], at[each] - bounds[doc[each]]
        item = self.item[seed]
        order = np.lexsort((item, doc))
        doc, item, place, seed = doc[order], item[order], place[order], seed[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        first = np.append(np.flatnonzero(new), len(doc))
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            size = int(self.words[item[i]])
            mine = self.place[seed[i:j]]
            reach = np.zeros(size + 1, np.int64)
            np.add.at(reach, mine, 1)
            np.add.at(reach, mine + self.width, -1)
            if (np.cumsum(reach) > 0).sum() < threshold * size:  # tiles cover no more than the seeds do
                continue
            found = tiles(maximal_matches(mine, place[i:j], self.width), self.width)
            covered = sum(t[2] for t in found)
            if covered >= threshold * size:
                out[doc[i]].append((int(self.ids[item[i]]), covered / size, len(found), max(t[2] for t in found)))
        return out


def item_blocks(benchmark: DataFrame, width: int, block_words: int) -> Iterator[ItemBlock]:
    items = benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    n = max(1, -(-total // block_words))
    for b in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).toPandas()
        if len(part):
            yield ItemBlock.build(part["item_id"].tolist(), part["text"].tolist(), width)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, width: int = WIDTH, block_words: int = 2_000_000) -> DataFrame:
    """All columns of docs, with contaminated, n_items, item_id and coverage of the best item (ties:
    smallest id), and leaks: every item covered to the threshold."""
    out, columns = docs, []
    for number, block in enumerate(item_blocks(benchmark, width, block_words)):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        run = F.pandas_udf(searcher(shared, threshold), HITS)
        columns.append(f"__leaks{number}")
        out = out.withColumn(columns[-1], run(F.col("text")))
    leaks = F.concat(*columns) if columns else F.array().cast(HITS)
    best = F.array_sort(F.col("leaks"), lambda a, b: F.when(a.coverage > b.coverage, -1).when(a.coverage < b.coverage, 1).when(a.item_id < b.item_id, -1).when(a.item_id > b.item_id, 1).otherwise(0))
    out = out.withColumn("leaks", leaks).drop(*columns).withColumn("__best", best).withColumn("n_items", F.size(F.array_distinct(F.transform("leaks", lambda x: x.item_id))).cast("long"))
    first = F.get("__best", F.lit(0))
    return out.withColumns({"contaminated": F.col("n_items") > 0, "item_id": first.item_id, "coverage": F.coalesce(first.coverage, F.lit(0.0))}).drop("__best")


def searcher(shared, threshold: float):
    """The search of one block of items, over batches of texts."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.tolist()
            sizes = np.fromiter((len(x) if x else 0 for x in texts), np.int64, len(texts))
            hits = [h for i, j in blocks(sizes, BLOCK) for h in shared.value.hits(texts[i:j], threshold)]
            yield pd.Series([[dict(zip(("item_id", "coverage", "tiles", "longest"), h)) for h in x] for x in hits], dtype=object)

    return run
