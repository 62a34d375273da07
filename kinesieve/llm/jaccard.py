"""Jaccard self-join on word shingles by vertical partitioning of the global shingle order.

1. A shingle that no other document has can't be shared. Chunks of documents send a fixed part of
   the hash space of their shingles to buckets, which tell how many of each document's shingles
   occur nowhere else. A document with more of those than the similarity leaves room for is alone;
   that is a bound, not a sample of documents, and only the others go on.
2. Equal sets are one class. The classes' shingles are counted exactly and ordered by frequency,
   rarest first; those of one class only are dropped, but their number is kept.
3. Similar sets share one of the rarest shingles that a set may not do without (its prefix), and
   their sizes are in the same or neighbouring size classes: classes with both in common are a group.
4. A group compares its members with one leader, the one nearest to what they have in common. With
   delta shingles of difference from the leader (without what only the leader has), u of them nobody else's, x and y differ in at least
   u_x + u_y + |(delta_x - u_x) - (delta_y - u_y)|: members that this bound or a link to the leader
   settles are done. The others differ from each other by their differences from the leader, so two of
   them are similar only if they share enough of these: the rarest ones among the leader's members
   are their prefix, and only members that share one of it, and that the bound (now with what no other
   member of the leader differs in) still allows, are compared.
5. A pair is decided exactly. The frequency order is cut into fragments; Spark joins both sets by
   fragment, counts the overlap of each separately and sums the counts per pair.

A leader of very many pairs is salted; its set is repeated once for each salt.

Defined cases: null text or one without words has an empty set and no links; fewer words than a
shingle give one shingle of all words; rows that repeat a doc_id are documents of their own, rows
that repeat a text are copies; rows without doc_id are left out; an empty table gives no rows; other
columns are not read. Texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinesieve.llm.components import components
from kinesieve.llm.exchange import aligned, answer, bucket_count, pack, requests, text_bytes, unpack, unpack_sorted
from kinesieve.llm.kernels import U64, blocks, chain_hashes, first_of_runs, mix, normalise, words_of
from kinesieve.llm.storage import drop_table, keep

#: Fragments of the frequency order, each two powers of two wide.
FRAGMENTS = 8
#: Pairs of one leader that share a salt.
PER_SALT = 20_000
#: Bits of a row's number that count the rows of its chunk, and of a chunk's that count those of a task.
ROW_BITS, CHUNK_BITS = 20, 14
SEVERAL = np.uint32(0xFFFFFFFF)
WIRE = "kind int, chunk long, bucket int, n long, keys binary, vals binary"
NAMES = [x.split()[0] for x in WIRE.split(", ")]


def shingle_sets(texts: list, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, bounds = words_of([normalise(x) for x in texts])
    full = chain_hashes(words, width)
    out = []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if j - i >= width:
            out.append(np.unique(full[i : j - width + 1]))
        else:
            out.append(chain_hashes(words[i:j], j - i) if j > i else np.zeros(0, U64))
    return out


def set_hashes(one: np.ndarray) -> tuple[int, int]:
    return int(one.sum(dtype=U64).view(np.int64)), int(mix(one).sum(dtype=U64).view(np.int64))


def asked_part(num: int, den: int) -> np.uint64:
    """Shingles with hashes below it are asked for in the first step: two and a half times the part
    that similar sets may differ in."""
    return U64(min((1 << 64) - 1, (1 << 64) * 5 * (den - num) // (2 * den)))


def in_blocks(pdf: pd.DataFrame, limit: int = 1 << 18) -> Iterator[pd.DataFrame]:
    sizes = pdf["text"].map(lambda x: len(x) if x else 0).to_numpy()
    for i, j in blocks(sizes, limit):
        yield pdf.iloc[i:j]


class Chunk:
    """Documents of one task up to a size, numbered across the whole table."""

    def __init__(self, chunk_bytes: int):
        self.chunk_bytes, self.made = chunk_bytes, 0
        self.start()

    def start(self) -> None:
        self.items: list[tuple] = []
        self.sets: list[np.ndarray] = []
        self.size = 0

    @property
    def full(self) -> bool:
        return self.size >= self.chunk_bytes or len(self.items) >= 1 << (ROW_BITS - 1)

    def add(self, item: tuple, one: np.ndarray, size: int) -> None:
        self.items.append(item)
        self.sets.append(one)
        self.size += size

    def close(self) -> tuple[int, list[tuple], list[np.ndarray]]:
        """The chunk's number, items and sets; a new chunk begins."""
        if self.made >> CHUNK_BITS:
            raise ValueError("a task has more chunks than row numbers allow: use smaller partitions")
        number = (TaskContext.get().partitionId() << CHUNK_BITS) + self.made
        out = number, self.items, self.sets
        self.made += 1
        self.start()
        return out


def sign(docs: DataFrame, width: int, num: int, den: int, n_buckets: int, chunk_bytes: int) -> DataFrame:
    """Kind 0: the documents of a chunk; kind 1: its requests, each key with the place of the only
    document of the chunk that has it, or SEVERAL."""
    part = asked_part(num, den)

    def rows_of(chunk: Chunk) -> pd.DataFrame:
        number, items, sets = chunk.close()
        asked = [s[: np.searchsorted(s, part)] for s in sets]
        keys, places = np.concatenate(asked), np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in asked])
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
        first = first_of_runs(keys)
        only = np.where(np.diff(np.append(first, len(keys))) == 1, places[first], SEVERAL)
        rows = [(0, number, -1, len(items), pack(np.array(items, np.int64).T), None)]
        rows += [(1, *r) for r in requests(number, keys[first], only, n_buckets)]
        return pd.DataFrame(rows, columns=NAMES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = Chunk(chunk_bytes)
        for pdf in batches:
            for block in in_blocks(pdf):
                sets = shingle_sets(block["text"].tolist(), width)
                for doc, known, text, one in zip(block["doc_id"].tolist(), block["text_hash"].tolist(), block["text"], sets):
                    chunk.add((doc, known, len(one), *set_hashes(one)), one, len(text) if text else 0)
                if chunk.full:
                    yield rows_of(chunk)
        if chunk.items:
            yield rows_of(chunk)

    named = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return named.mapInPandas(run, WIRE)


def lone_keys(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: per chunk, documents and how many of their keys no other document has."""
    keys = np.concatenate([unpack_sorted(x) for x in pdf["keys"]])
    only = np.concatenate([unpack(x, np.uint32) for x in pdf["vals"]])
    chunk = np.repeat(pdf["chunk"].to_numpy(), pdf["n"].to_numpy())
    order = np.argsort(keys, kind="stable")
    first = first_of_runs(keys[order])
    at = order[first[np.diff(np.append(first, len(keys))) == 1]]
    at = at[only[at] != SEVERAL]
    pairs, counts = np.unique(np.stack((chunk[at], only[at].astype(np.int64)), 1), axis=0, return_counts=True)
    heads = first_of_runs(pairs[:, 0])
    rows = []
    for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(pairs)]):
        rows.append((2, int(pairs[i, 0]), -1, j - i, pack(np.stack((pairs[i:j, 1], counts[i:j])).astype(np.uint32)), None))
    return pd.DataFrame(rows, columns=NAMES)


ROWS = "row long, doc_id long, text_hash long, n_shingles long, set_1 long, set_2 long, lone long"


def rows_with_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    """One chunk's documents, each with the number of asked shingles that nobody else has."""
    mine = pdf[pdf["kind"] == 0].iloc[0]
    fields = unpack(mine["keys"], np.int64).reshape(5, -1)
    lone = np.zeros(fields.shape[1], np.int64)
    for blob in pdf.loc[pdf["kind"] == 2, "keys"]:
        place, count = unpack(blob, np.uint32).reshape(2, -1)
        lone[place] += count
    row = (int(mine["chunk"]) << ROW_BITS) + np.arange(len(lone))
    return pd.DataFrame(dict(zip([x.split()[0] for x in ROWS.split(", ")], (row, *fields, lone))))


def numbered(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """ROWS of all documents that have a doc_id."""
    size = text_bytes(docs)
    signed = keep(sign(docs, width, num, den, bucket_count(size), chunk_bytes=8 << 20), "signed", partition_by="kind")
    lone = signed.filter("kind = 1").groupBy("bucket").applyInPandas(lone_keys, WIRE)
    both = signed.filter("kind = 0").select(*NAMES).unionByName(lone)
    rows = keep(both.groupBy("chunk").applyInPandas(rows_with_counts, ROWS), "rows")
    drop_table(signed)
    return rows


def class_sets(docs: DataFrame, classes: DataFrame, width: int, n_buckets: int, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Kind 0: the sets of a chunk of classes; kind 1: requests for the number of classes by shingle."""

    def rows_of(chunk: Chunk) -> pd.DataFrame:
        number, items, sets = chunk.close()
        keys, counts = np.unique(np.concatenate(sets), return_counts=True)
        state = np.concatenate((np.array(items, np.int64), [len(s) for s in sets], np.concatenate(sets).view(np.int64)))
        rows = [(0, number, -1, len(items), pack(state), None)]
        rows += [(1, *r) for r in requests(number, keys, counts.astype(np.int64), n_buckets)]
        return pd.DataFrame(rows, columns=NAMES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, seen = Chunk(chunk_bytes), set()
        for pdf in batches:
            pdf = pdf[~pdf["cls"].isin(seen)]
            for block in in_blocks(pdf):
                sets = shingle_sets(block["text"].tolist(), width)
                for cls, n, known, text, one in zip(block["cls"].tolist(), block["n"].tolist(), block["set_1"].tolist(), block["text"], sets):
                    if cls not in seen and len(one) == n and set_hashes(one)[0] == known:
                        seen.add(cls)
                        chunk.add(cls, one, len(text))
                if chunk.full:
                    yield rows_of(chunk)
        if chunk.items:
            yield rows_of(chunk)

    wanted = classes.select(F.col("doc_id"), "cls", F.col("n_shingles").alias("n"), "set_1")
    # by merge at every size: what is small here is large elsewhere
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id")
    return texts.select("cls", "n", "set_1", "text").mapInPandas(run, WIRE)


def counted(keys: np.ndarray, which: np.ndarray, vals: np.ndarray) -> np.ndarray:
    return np.bincount(which, weights=vals, minlength=len(keys)).astype(np.int64)


SETS = "cls long, fragment int, n long, u long, shingles array<long>"


def ordered_sets(signed: DataFrame, num: int, den: int, n_buckets: int) -> DataFrame:
    """SETS of the classes that may have partners: fragment -1 holds the prefix, the others the
    shingles of two classes or more by rank of frequency."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mine = pdf[pdf["kind"] == 0].iloc[0]
        raw, m = unpack(mine["keys"], np.int64), int(mine["n"])
        classes, sizes, flat = raw[:m], raw[m : 2 * m], raw[2 * m :].view(U64)
        keys, which = np.unique(flat, return_inverse=True)
        got = pdf[pdf["kind"] == 1]
        often = aligned({b: unpack(r, np.int64) for b, r in zip(got["bucket"], got["vals"])}, keys, n_buckets, dtype=np.int64)
        rank = np.minimum(127, np.floor(4 * np.log2(np.maximum(often, 1)))).astype(U64)
        place = ((rank << U64(56)) | (keys >> U64(8))).view(np.int64)
        alone = often[which] < 2
        place = place[which]
        rows, i = [], 0
        for cls, n in zip(classes.tolist(), sizes.tolist()):
            shared = np.sort(place[i : i + n][~alone[i : i + n]])
            i += n
            u = n - len(shared)
            if len(shared) * den < num * n:
                continue
            first = n - -(-num * n // den) + 1 - u
            rows.append((cls, -1, n, u, shared[:first]))
            part = np.minimum((shared >> 56) >> 3, FRAGMENTS - 1)
            bounds = np.searchsorted(part, np.arange(FRAGMENTS + 1))
            rows += [(cls, f, n, u, shared[bounds[f] : bounds[f + 1]]) for f in range(FRAGMENTS) if bounds[f] < bounds[f + 1]]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in SETS.split(", ")])

    asked = signed.filter("kind = 1").select("chunk", "bucket", "n", "keys", "vals")
    replies = answer(asked, np.int64, counted).select(F.lit(1).alias("kind"), "chunk", "bucket", F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("keys"), F.col("reply").alias("vals"))
    return signed.filter("kind = 0").select(*NAMES).unionByName(replies).groupBy("chunk").applyInPandas(run, SETS)


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b) with the number of shingles that they share: partial overlaps are
    counted by fragment, then summed per pair."""
    heavy = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_SALT).cast("int").alias("salts"))
    salted = pairs.join(heavy, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    whole = sets.filter("fragment >= 0")
    left = whole.select(F.col("cls").alias("a"), "fragment", F.col("shingles").alias("s_a")).join(heavy, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    right = whole.select(F.col("cls").alias("b"), "fragment", F.col("shingles").alias("s_b"))
    both = salted.drop("salts").join(left.drop("salts"), ["a", "salt"]).join(right, ["b", "fragment"])
    part = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("shared"))
    return part.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))


def group_members(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(shingle, size, x, n, u): classes by shingle of their prefix and size class, in groups of two
    or more. Similar sets are at most one size class apart, so each also enters the one below."""
    ratio = math.log(den / num * 1.0001) if num < den else 1e-9
    size = F.floor(F.log("n") / ratio).cast("int")
    base = sets.filter("fragment = -1").select(F.col("cls").alias("x"), "n", "u", size.alias("own"), "shingles")
    every = base.select("x", "n", "u", F.explode(F.array("own", F.col("own") - 1)).alias("size"), "shingles").select("x", "n", "u", "size", F.explode("shingles").alias("shingle"))
    shared = every.groupBy("shingle", "size").agg(F.count("*").alias("m")).filter("m > 1").drop("m")
    return every.join(shared, ["shingle", "size"])


def allowed_pairs(compared: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, n_a, n_b): members of the same leader that may be similar, after what the leader's
    comparisons (a: leader, b: member) have shown. Members linked to the leader are one side.

    Differences are from the leader without what nobody else has, which every member would miss. In
    whole numbers, with wide = den + num and room = den - num: h is the difference from the leader,
    and q what it leaves for a partner, so that similar members have h at most the other's q. Two
    members whose h add up to 0 or less are similar for certain.
    """
    wide, room = den + num, den - num
    delta = F.col("n_a") - F.col("u_a") + F.col("n_b") - 2 * F.col("shared")
    joined = F.col("shared") * den >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * num
    told = compared.select(
        "a", F.col("b").alias("x"), F.col("n_b").alias("n"), "u", joined.alias("joined"),
        (wide * delta - room * F.col("n_b")).alias("h"), (wide * (delta - 2 * F.col("u")) + room * F.col("n_b")).alias("q"),
    )
    apart = F.when(~F.col("joined"), F.col("q")), F.when(~F.col("joined"), F.col("h"))
    best = told.groupBy("a").agg(
        F.max("q").alias("q_any"), F.min("h").alias("h_any"), F.max(apart[0]).alias("q_apart"), F.min(apart[1]).alias("h_apart"),
        F.min_by(F.struct("x", "n"), F.struct("h", "x")).alias("low_any"), F.min_by(F.struct("x", "n"), F.struct(apart[1], "x")).alias("low_apart"),
    )
    other = lambda name: F.when(F.col("joined"), F.col(f"{name}_apart")).otherwise(F.col(f"{name}_any"))
    seen = told.join(best, "a").filter(F.col("h_apart").isNotNull())
    seen = seen.select("a", "x", "n", "u", "joined", "h", "q", other("h").alias("h_low"), other("q").alias("q_top"), other("low").alias("low"))
    left = keep(seen.filter((F.col("q_top") >= F.col("h")) & (F.col("h_low") <= F.col("q"))), "left")
    certain = left.filter((F.col("h") + F.col("h_low") <= 0) & (F.col("x") != F.col("low.x"))).select(F.col("low.x").alias("a"), F.col("x").alias("b"), F.col("low.n").alias("n_a"), F.col("n").alias("n_b"))

    whole = sets.filter("fragment >= 0")
    parts = left.select("a", "x", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    own = whole.select(F.col("cls").alias("x"), "fragment", F.col("shingles").alias("s_x"))
    lead = whole.select(F.col("cls").alias("a"), "fragment", F.col("shingles").alias("s_a"))
    none = F.array().cast("array<long>")
    both = parts.join(own, ["x", "fragment"], "left").join(lead, ["a", "fragment"], "left").select("a", "x", F.coalesce("s_x", none).alias("s_x"), F.coalesce("s_a", none).alias("s_a"))
    differs = keep(both.select("a", "x", F.explode(F.concat(F.array_except("s_x", "s_a"), F.array_except("s_a", "s_x"))).alias("shingle")), "differs")
    often = differs.groupBy("a", "shingle").agg(F.count("*").alias("often"))
    sorted_ = differs.join(often, ["a", "shingle"]).groupBy("a", "x").agg(
        F.count_if(F.col("often") == 1).alias("lone"),
        F.array_sort(F.collect_list(F.when(F.col("often") > 1, F.struct("often", "shingle")))).alias("order"),
    )
    need = F.greatest(F.lit(1), F.ceil((F.col("h") + F.col("h_low")) / (2 * wide))).cast("int")
    marks = left.join(sorted_, ["a", "x"]).withColumn("q", F.col("q") - 2 * wide * F.col("lone")).withColumn("take", F.size("order") - need + 1)
    marks = marks.filter((F.col("take") > 0) & (F.col("h_low") <= F.col("q")))
    # how much two members can still share from a place in their orders on
    marks = marks.select("a", "x", "n", "joined", "h", "q", F.size("order").alias("m"), F.posexplode(F.slice("order", F.lit(1), F.col("take"))).alias("place", "o"))
    marks = keep(marks.select("a", F.col("o.shingle").alias("shingle"), "x", "n", "joined", "h", "q", (F.col("m") - F.col("place")).alias("rest")), "marks")
    drop_table(differs)
    one = marks.select("a", "shingle", F.col("x").alias("x_1"), F.col("n").alias("n_1"), F.col("joined").alias("j_1"), F.col("h").alias("h_1"), F.col("q").alias("q_1"), F.col("rest").alias("rest_1"))
    two = marks.select("a", "shingle", F.col("x").alias("x_2"), F.col("n").alias("n_2"), F.col("joined").alias("j_2"), F.col("h").alias("h_2"), F.col("q").alias("q_2"), F.col("rest").alias("rest_2"))
    met = (F.col("x_1") < F.col("x_2")) & ~(F.col("j_1") & F.col("j_2")) & (F.col("h_1") <= F.col("q_2")) & (F.col("h_2") <= F.col("q_1"))
    near = (F.col("n_1") * den >= F.col("n_2") * num) & (F.col("n_2") * den >= F.col("n_1") * num)
    # at the first shingle in common, what is left must reach what the two have to share
    enough = 2 * wide * F.least("rest_1", "rest_2") >= F.col("h_1") + F.col("h_2")
    found = one.join(two, ["a", "shingle"]).filter(met & near & enough)
    return found.select(F.col("x_1").alias("a"), F.col("x_2").alias("b"), F.col("n_1").alias("n_a"), F.col("n_2").alias("n_b")).unionByName(certain)


def component_labels(sets: DataFrame, num: int, den: int, counts: list | None = None) -> DataFrame:
    """(node, label): the classes that have links, each with the smallest class of its component.
    `counts` gathers the number of pairs that are compared with leaders, and then without them."""
    group = ["shingle", "size"]
    wide, room = den + num, den - num
    members = keep(group_members(sets, num, den).select(*group, "x", "n", "u"), "members")
    slack = room * F.col("n") - wide * F.col("u")
    heads = members.groupBy(*group).agg(F.max_by(F.struct("x", "n", "u"), F.struct(slack, -F.col("x"))).alias("head"))
    led = members.join(heads, group).select(F.col("head.x").alias("a"), F.col("x").alias("b"), F.col("head.n").alias("n_a"), F.col("n").alias("n_b"), F.col("head.u").alias("u_a"), "u")
    first = keep(led.filter("a <> b").distinct(), "led")
    drop_table(members)
    with_leaders = keep(overlaps(first, sets).join(first.select("a", "b", "u_a", "u"), ["a", "b"]), "overlaps")
    drop_table(first)
    second = keep(allowed_pairs(with_leaders, sets, num, den).distinct(), "allowed")
    others = keep(overlaps(second, sets), "overlaps")
    drop_table(second)
    if counts is not None:
        counts += [with_leaders.count(), others.count()]
    both = with_leaders.select(*others.columns).unionByName(others)
    links = both.filter(F.col("shared") * den >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * num).select("a", "b")
    labels = components(links)
    drop_table(with_leaders)
    drop_table(others)
    return labels


def similar_rows(docs: DataFrame, width: int, num: int, den: int, counts: list | None = None) -> DataFrame:
    """For every row with a doc_id: doc_id, text_hash (xxhash64 of the text), n_shingles,
    component_id (smallest doc_id of its component) and component (a number of its own for each)."""
    same = ["n_shingles", "set_1", "set_2"]
    rows = numbered(docs, width, num, den)
    open_ = rows.filter((F.col("n_shingles") > 0) & (F.col("lone") * den <= F.col("n_shingles") * (den - num)))
    grouped = open_.groupBy(*same).agg(F.min("row").alias("cls"), F.min_by("doc_id", "row").alias("doc_id"), F.min("doc_id").alias("least"))
    classes = keep(grouped, "classes")
    n_buckets = bucket_count(text_bytes(docs))
    signed = keep(class_sets(docs, classes, width, n_buckets), "class_sets", partition_by="kind")
    sets = keep(ordered_sets(signed, num, den, n_buckets), "sets")
    drop_table(signed)
    labels = component_labels(sets, num, den, counts=counts)
    drop_table(sets)
    named = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("label", "cls"))
    least = named.filter(F.col("label").isNotNull()).groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component", "left").select(*same, "component", F.coalesce("component_id", "least").alias("component_id"))
    out = rows.join(named, same, "left")
    own = [F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component", "row").alias("component")]
    return out.select("doc_id", "text_hash", "n_shingles", *own)


def similar_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row with a doc_id; similar are two sets with
    den * intersection >= num * union."""
    return similar_rows(docs, width, num, den).select("doc_id", "n_shingles", "component_id")
