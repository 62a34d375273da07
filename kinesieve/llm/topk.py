"""Exact top-k inner-product search with a ball tree in every shard.

Vectors become integers, floor(256 * x). A shard is a part of all vectors; its task builds a ball
tree and takes the queries in blocks. A node's bound for a query is q.center + |q| * radius; each
query visits the child with the higher bound first, and leaves a node whose bound is under its kth
score so far. That score is shared: a first round sends every query down to one leaf of each shard,
Spark takes the kth best of all shards per query, and the second round starts from it everywhere.

Equal vectors are one point of the tree that keeps its k+1 smallest different ids, the only ones that
ties can choose (one of them may be the query itself). Repeated rows are dropped before the table is
written, and a search counts an id once at each score, so that no row takes another's place.

Defined cases: a vector that is null, empty or holds a null or non-finite component, or a row
without vec_id, takes no part; queries meet candidates of their own dimension only; rows that repeat
a vec_id and vector count once, and no row is a candidate for a query of its own id; fewer
candidates than k give fewer rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinesieve.llm.storage import keep

LEAF = 128
FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes over the distinct vectors of a shard; the halves of a node are its children."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        points, ids = points[order], ids[order]
        self.points, which = np.unique(points, axis=0, return_inverse=True)
        _, once = np.unique(np.stack((which.ravel(), ids)), axis=1, return_index=True)
        once.sort()
        ids, which = ids[once], which.ravel()[once]
        self.repeats = len(np.unique(ids)) < len(ids)
        by_point = np.argsort(which.ravel(), kind="stable")
        first = np.searchsorted(which.ravel()[by_point], np.arange(len(self.points) + 1))
        self.ids = [ids[by_point[i : min(j, i + k + 1)]] for i, j in zip(first[:-1], first[1:])]
        self.order = np.arange(len(self.points))
        self.center, self.radius, self.span, self.children = [], [], [], []
        self._split(0, len(self.points))

    def _split(self, i: int, j: int) -> int:
        node = len(self.center)
        own = self.points[self.order[i:j]]
        center = own.mean(0)
        away = np.sqrt(((own - center) ** 2).sum(1))
        self.center.append(center)
        self.radius.append(away.max())
        self.span.append((i, j))
        self.children.append(None)
        if j - i > LEAF:
            one = own[away.argmax()]
            two = own[((own - one) ** 2).sum(1).argmax()]
            side = np.argsort(own @ (two - one), kind="stable")
            self.order[i:j] = self.order[i:j][side]
            middle = (i + j) // 2
            self.children[node] = (self._split(i, middle), self._split(middle, j))
        return node

    def bounds(self, node: int, queries: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products, with room for rounding."""
        top = queries @ self.center[node] + norms * self.radius[node]
        return top + 1e-9 * np.abs(top) + 1e-6


class Search:
    """The best candidates of a block of queries: a table of scores and ids, and the kth score."""

    def __init__(self, tree: BallTree, queries: np.ndarray, query_ids: np.ndarray, known: np.ndarray, k: int):
        self.tree, self.queries, self.query_ids, self.k = tree, queries, query_ids, k
        self.norms = np.sqrt((queries**2).sum(1))
        self.known = known
        self.score = np.full((len(queries), k), -np.inf)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)

    def limit(self, at: np.ndarray) -> np.ndarray:
        return np.maximum(self.known[at], self.score[at, -1])

    def visit(self, node: int, at: np.ndarray, single: bool) -> None:
        """Search a node for the queries `at`; single: only the better child of each."""
        tree = self.tree
        if tree.children[node] is None:
            self.leaf(node, at)
            return
        left, right = tree.children[node]
        a = tree.bounds(left, self.queries[at], self.norms[at])
        b = tree.bounds(right, self.queries[at], self.norms[at])
        first_left = a >= b
        turns = [(left, at[first_left], a[first_left]), (right, at[~first_left], b[~first_left])]
        if not single:
            turns += [(right, at[first_left], b[first_left]), (left, at[~first_left], a[~first_left])]
        for child, group, bound in turns:
            if not single:
                group = group[bound >= self.limit(group)]
            if len(group):
                self.visit(child, group, single)

    def leaf(self, node: int, at: np.ndarray) -> None:
        i, j = self.tree.span[node]
        points = self.tree.order[i:j]
        ids = [self.tree.ids[p] for p in points]
        each = np.repeat(np.arange(len(points)), [len(x) for x in ids])
        flat = np.concatenate(ids)
        scores = (self.queries[at] @ self.tree.points[points].T)[:, each]
        scores = np.where(flat[None, :] == self.query_ids[at][:, None], -np.inf, scores)
        all_scores = np.concatenate((self.score[at], scores), 1)
        all_ids = np.concatenate((self.id[at], np.broadcast_to(flat, scores.shape)), 1)
        order = np.lexsort((all_ids, -all_scores), axis=1)
        if self.tree.repeats:  # an id's vectors with the same score count once: the later ones go last
            s, i = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)
            again = np.zeros(s.shape, bool)
            again[:, 1:] = (s[:, 1:] == s[:, :-1]) & (i[:, 1:] == i[:, :-1])
            np.put_along_axis(all_scores, order, np.where(again, -np.inf, s), 1)
            order = np.take_along_axis(order, np.argsort(again, axis=1, kind="stable"), 1)
        order = order[:, : self.k]
        self.score[at] = np.take_along_axis(all_scores, order, 1)
        self.id[at] = np.take_along_axis(all_ids, order, 1)

    def rows(self) -> pd.DataFrame:
        q, r = np.nonzero(np.isfinite(self.score))
        return pd.DataFrame({"query_id": self.query_ids[q], "vec_id": self.id[q, r], "score": self.score[q, r].astype(np.int64)})


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, v, dim) of the rows that take part, repeated ones once."""
    x = F.transform(F.col(column), lambda c: F.floor(F.lit(256) * c.cast("double")).cast("double"))
    sound = F.forall(F.col(column), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    out = vectors.filter(F.col(id_column).isNotNull() & F.coalesce((F.size(column) > 0) & sound, F.lit(False)))
    return out.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("v"), F.size(column).alias("dim")).dropDuplicates(["vec_id", "v"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    """Each query's k best of at most k rows from each shard."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, shard_rows: int = 16_384, query_rows: int = 1_024) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of `vectors` that the condition `queries` (on
    vec_id) picks; candidates are all rows of another id."""
    table = keep(integer_vectors(vectors), "vectors")
    n_shards = max(1, -(-table.count() // shard_rows))
    shards = table.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_shards)).cast("int"))
    asked = table.filter(queries)
    n_blocks = max(1, -(-asked.count() // query_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "vec_id", "v"), F.lit(n_blocks)).cast("int"))

    def pack(pdf: pd.DataFrame) -> tuple[bytes, bytes]:
        return np.stack(pdf["v"]).astype("<f8").tobytes(), pdf["vec_id"].to_numpy("<i8").tobytes()

    def block_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        v, ids = pack(pdf)
        return pd.DataFrame([(int(pdf["block"].iloc[0]), int(pdf["dim"].iloc[0]), v, ids)], columns=["block", "dim", "v", "ids"])

    blocks = asked.groupBy("block", "dim").applyInPandas(block_rows, "block int, dim int, v binary, ids binary")
    blocks = keep(blocks, "query_blocks")
    # the queries of a block go to each shard as one row; the vectors are not repeated
    sent = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))

    def search(single: bool):
        def run(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
            none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
            if not len(mine) or not len(theirs):
                return none
            tree = BallTree(np.stack(mine["v"]), mine["vec_id"].to_numpy(np.int64), k)
            out = [none]
            for _, row in theirs.iterrows():
                ids = np.frombuffer(row["ids"], "<i8")
                known = np.frombuffer(row["known"], "<f8") if row["known"] is not None else np.full(len(ids), -np.inf)
                one = Search(tree, np.frombuffer(row["v"], "<f8").reshape(len(ids), -1), ids, known, k)
                one.visit(0, np.arange(len(ids)), single)
                out.append(one.rows())
            return pd.concat(out, ignore_index=True)

        return run

    group = ["shard", "dim"]
    start = sent.withColumn("known", F.lit(None).cast("binary"))
    first = shards.groupBy(*group).cogroup(start.groupBy(*group)).applyInPandas(search(True), FOUND)
    kth = ranked(first.distinct(), k).groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).filter(F.col("n") == k)

    wide = blocks.select("block", "dim", "ids").mapInPandas(unpacked, "block int, dim int, place int, query_id long")
    known = wide.join(kth.select("query_id", "kth"), "query_id", "left").groupBy("block", "dim").applyInPandas(known_scores, "block int, dim int, known binary")
    second = sent.join(keep(known, "known"), ["block", "dim"])
    found = shards.groupBy(*group).cogroup(second.groupBy(*group)).applyInPandas(search(False), FOUND)
    return ranked(found.distinct(), k).select("query_id", "rank", "vec_id", "score")


def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.itertuples():
            ids = np.frombuffer(row.ids, "<i8")
            yield pd.DataFrame({"block": row.block, "dim": row.dim, "place": np.arange(len(ids), dtype=np.int32), "query_id": ids})


def known_scores(pdf: pd.DataFrame) -> pd.DataFrame:
    """The kth scores of a block, in the order of its queries."""
    pdf = pdf.drop_duplicates("place").sort_values("place")
    scores = pdf["kth"].astype(float).fillna(-np.inf).to_numpy("<f8")
    return pd.DataFrame([(int(pdf["block"].iloc[0]), int(pdf["dim"].iloc[0]), scores.tobytes())], columns=["block", "dim", "known"])
