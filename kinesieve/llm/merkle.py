"""A manifest of a dataset as hash trees: one per group of rows, and one over the groups' roots.

Leaves get their places by row number; a level's nodes are grouped by place divided by the fanout
and hashed into their parents, level by level, until each group has one node, its subroot, and so
again over the subroots. Siblings are gathered by a join per level. These joins go from the roots
down: a parent hands what stands above it to at most `fanout` children, so each join has keys of
that many rows and all of them together little more than the last, while from the leaves up every
level would move every row and meet in one key at the top.

H is lowercase hex SHA-256 of the concatenated inputs, digests as hex text. A leaf is H of the
row's fields, each `-` if null, else its length in UTF-8 bytes, a colon and the text.

Defined cases: a null in any column is a value of its own; rows without a key come first, ties go by
leaf, and equal rows are leaves of their own; a null group comes first; a text of any length is hashed
as a whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesieve.llm.order import ranked
from kinesieve.llm.storage import keep

#: The columns of documents that a leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def framed(column: Column) -> Column:
    """A value with its length, so that no two rows run together into one input."""
    text = column.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return digest(F.concat(*[framed(x) for x in fields]))


def group_name(column: Column) -> Column:
    """A name per group that is never null; null comes first and names keep their order of bytes."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), column.cast("string")))


def climb(leaves: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """The levels above leaves(tree, idx, n, hash), leaves first: (tree, idx, n, hash, children)."""
    levels = [leaves.select("tree", "idx", "n", "hash")]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        place = F.floor(F.col("idx") / fanout).alias("idx")
        runs = levels[-1].filter("n > 1").groupBy("tree", place, F.ceil(F.col("n") / fanout).alias("n"))
        run = runs.agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "hash"))), lambda x: x.hash).alias("children"))
        levels.append(keep(run.withColumn("hash", digest(F.array_join("children", ""))), f"{name}-level"))
        most = -(-most // fanout)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, level, hash): the node that each tree ends in."""
    out = None
    for i, level in enumerate(levels):
        part = level.filter("n = 1").select("tree", F.lit(i).alias("level"), "hash")
        out = part if out is None else out.unionByName(part)
    return out


def descend(levels: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """For each leaf (tree, idx) what its tree's top has in above(tree, level, path, ...), where path
    gets an entry (left, right) of joined siblings for each level below the top, lowest first."""
    carried = [x for x in above.columns if x not in ("tree", "level", "path")]
    down = None
    for i in range(len(levels) - 1, -1, -1):
        top = above.filter(F.col("level") == i).select("tree", F.lit(0).cast("long").alias("idx"), "path", *carried)
        if down is not None:
            run = levels[i + 1].select("tree", "idx", "children").join(down, ["tree", "idx"])
            child = run.select("tree", "idx", "children", "path", *carried, F.posexplode("children").alias("pos", "own"))
            left = F.array_join(F.slice("children", F.lit(1), F.col("pos")), "")
            right = F.array_join(F.slice("children", F.col("pos") + 2, F.lit(fanout)), "")
            step = F.array(F.struct(left.alias("left"), right.alias("right")))
            below = child.select("tree", (F.col("idx") * fanout + F.col("pos")).alias("idx"), F.concat(step, "path").alias("path"), *carried)
            top = below.unionByName(top)
        down = top
    return down


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's hash leads to with its siblings."""
    return F.aggregate(path, start, lambda now, x: digest(F.concat(x.left, now, x.right)))


def siblings_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda x: F.concat(x.left, x.right)), ""))


def manifest(rows: DataFrame, fields: list[Column], group: Column, key: Column, claimed: list[Column] | None = None, fanout: int = 3) -> DataFrame:
    """(key, leaf, claimed_leaf, path, subroot, root) of every row.

    claimed: the fields as somebody else holds them; claimed_leaf is their hash, to be folded with
    the siblings of the row. Path holds the siblings of every level up to the root.
    """
    own = leaf(fields)
    other = leaf(claimed) if claimed else own
    leaves = ranked(rows.select(group_name(group).alias("tree"), key.alias("key"), own.alias("hash"), other.alias("claimed_leaf")), ["key", "hash"], "leaves")
    levels = climb(leaves, fanout, "group")
    subroots = ranked(tops(levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "level", "hash"), ["name"], "subroots")
    high = climb(subroots, fanout, "root")
    root = tops(high).select("tree", "level", F.col("hash").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    named = subroots.join(descend(high, root, fanout), ["tree", "idx"])
    above = keep(named.select(F.col("name").alias("tree"), "level", F.col("hash").alias("subroot"), "root", "path"), "above")
    out = leaves.join(descend(levels, above, fanout), ["tree", "idx"])
    return out.select("key", F.col("hash").alias("leaf"), "claimed_leaf", "path", "subroot", "root")


def verified(rows: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of manifest()."""
    out = rows.withColumn("folded_root", folded(F.col("claimed_leaf"), F.col("path")))
    return out.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def tampered(text: Column, key: Column) -> Column:
    """The text without its line feeds where 2 divides the CRC-32 of the key in decimal."""
    chosen = F.coalesce(F.crc32(key.cast("string")) % 2 == 0, F.lit(False))
    return F.when(chosen, F.translate(text, "\n", "")).otherwise(text)


def verify_documents(docs: DataFrame, fanout: int = 3) -> DataFrame:
    """The manifest of documents by source, and each row checked against it with a text that may have
    been tampered with."""
    fields = [F.col(x) for x in FIELDS]
    claimed = [*fields[:-1], tampered(F.col("text"), F.col("doc_id"))]
    return verified(manifest(docs, fields, F.col("source"), F.col("doc_id"), claimed, fanout))
