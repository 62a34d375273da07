"""Repair of broken conversations at the least cost, by a rank-compressed dynamic program.

A conversation is repaired by one macro edit per row, a run of inserted turns and then what becomes of
the row. Macro edits have codes (inserted turns are I; D, K or R ends a code), no code begins another,
and the codes' order is that of their letters. So two audit strings of equally many codes compare by
their first different code, and instead of the strings a layer keeps, for each state that a repair can
be in, its cost, the rank of its string among the layer's, and a pointer to the state before; the
strings are read back along the pointers at the end.

Rows are put in order over ranges, and runs of `RUN` rows become one node: for each state on entry
and on exit the least cost and, per entry, the ranks of the exits' strings. Nodes combine by
the same step as rows do (an entry's ranks are all that a comparison needs), `RUN` at a time, until a
conversation is one node. The choice then goes back down, so a conversation of any share of the rows is
spread over tasks, all but its digest, one stream of text that a task reads piece by piece.

Defined cases: null roles and texts are one space; a null conv_id is a conversation of its own; null
turns come first, and rows of one turn go by role and then by the hash of their content; repeated rows are
duplicates; a text of any length is judged as a whole; an empty table gives no rows; other columns are
ignored, whatever their names. Texts are equal when their SHA-256 is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinesieve.llm.order import WITHIN, in_order
from kinesieve.llm.storage import drop_table, keep

#: Rows (and nodes) combined into one node, a power of two.
RUN_BITS = 9
#: White space of the contract (fixed values).
WHITE = " \t\n\x0b\x0c\r"
#: States: nothing yet, after system, after user, after assistant. What may follow each.
STATES = 4
FOLLOWS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEEDS = ["u", "u", "a", "u"]
#: Inserted turns that complete a repair in each state.
TAIL = [0, 2, 1, 0]
ROLES = {"u": "user", "a": "assistant"}
DELETE, REROLE, INSERT, LEFT_TRUNCATED = 2, 1, 5, 5
CODES = sorted("I" * j + x for j in range(3) for x in "DKR")
FAR = 1 << 40
INITIALS = "sua"
SOUND, TRUNCATED, UNUSABLE = 0, 1, 2


def macro_edits(initial: str, fault: int, state: int) -> Iterator[tuple[int, int, int]]:
    """(state after, cost, code) of every macro edit of a row in a state."""
    for inserted in range(3):
        for edit in "DKR":
            at, cost = state, INSERT * inserted
            for _ in range(inserted):
                at = FOLLOWS[at, NEEDS[at]]
            if edit == "D":
                cost += DELETE
            else:
                role = initial if edit == "K" else NEEDS[at]
                if fault == UNUSABLE or (at, role) not in FOLLOWS:
                    continue
                at = FOLLOWS[at, role]
                cost += REROLE * (edit == "R") + LEFT_TRUNCATED * (fault == TRUNCATED)
            yield at, cost, CODES.index("I" * inserted + edit)


def step_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each kind of row the cheapest edit between two states, ties to the smaller code."""
    cost = np.full((len(INITIALS) * 3 + 3, STATES, STATES), FAR, np.int64)
    code = np.zeros_like(cost)
    for i, initial in enumerate([*INITIALS, ""]):
        for fault in (SOUND, TRUNCATED, UNUSABLE):
            for state in range(STATES):
                for after, c, k in macro_edits(initial, fault, state):
                    kind = 3 * i + fault
                    if (c, k) < (cost[kind, state, after], code[kind, state, after]):
                        cost[kind, state, after], code[kind, state, after] = c, k
    return cost, code


STEP_COST, STEP_CODE = step_tables()


def lines_of(state: int, code: int) -> tuple[list[str], str | None]:
    """The roles that a macro edit inserts, and the row's role: None if deleted, '' if kept."""
    inserted = []
    for _ in range(CODES[code].count("I")):
        inserted.append(ROLES[NEEDS[state]])
        state = FOLLOWS[state, NEEDS[state]]
    return inserted, {"D": None, "K": ""}.get(CODES[code][-1], ROLES[NEEDS[state]])


def advance(cost: np.ndarray, rank: np.ndarray, by_cost: np.ndarray, by_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One layer: (n, entry, state) costs and ranks, and the (n, state, next) ones of what follows, give
    those of the next layer and the state that each came from."""
    found = cost[:, :, :, None] + by_cost[:, None]
    came = np.argmin(found * STATES + rank[:, :, :, None], axis=2)
    best = np.minimum(np.take_along_axis(found, came[:, :, None], 2)[:, :, 0], FAR)
    n, next_state = np.arange(len(cost))[:, None, None], np.arange(STATES)
    code = by_rank[n, came, next_state]
    order = np.take_along_axis(rank, came, 2) * 16 + code
    return best, np.argsort(np.argsort(order, axis=2, kind="stable"), axis=2), came


def layers(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each place in the longest list, which lists have it and where: longest lists first."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    for t in range(int(lengths.max(initial=0))):
        some = order[: np.searchsorted(-lengths[order], -t)]
        yield some, offsets[some] + t


def combine(offsets: np.ndarray, element: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Each list's elements as one: (n, entry, exit) costs and ranks."""
    n = len(offsets) - 1
    cost = np.where(np.eye(STATES, dtype=bool), 0, np.full((n, STATES, STATES), FAR))
    rank = np.tile(np.arange(STATES), (n, STATES, 1))
    for some, at in layers(offsets):
        cost[some], rank[some], _ = advance(cost[some], rank[some], *element(at))
    return cost, rank


def trace(offsets: np.ndarray, element: Callable, entry: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The state before and after each element on the best way from a list's entry to its exit."""
    n, total = len(offsets) - 1, int(offsets[-1])
    cost = np.where(np.arange(STATES) == entry[:, None], 0, np.full((n, STATES), FAR))[:, None]
    rank = np.tile(np.arange(STATES), (n, 1, 1))
    came = np.zeros((total, STATES), np.int8)
    steps = list(layers(offsets))
    for some, at in steps:
        cost[some], rank[some], pointers = advance(cost[some], rank[some], *element(at))
        came[at] = pointers[:, 0]
    before, after, state = np.zeros(total, np.int64), np.zeros(total, np.int64), leave.copy()
    for some, at in reversed(steps):
        after[at] = state[some]
        state[some] = before[at] = came[at, state[some]]
    return before, after


def by_kind(kinds: np.ndarray) -> Callable:
    return lambda at: (STEP_COST[kinds[at]], STEP_CODE[kinds[at]])


def lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a list column that has no nulls."""
    return np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def elements(batch: pa.RecordBatch) -> tuple[np.ndarray, Callable]:
    """The offsets and the elements of a batch of lists, of rows' kinds or of nodes."""
    if "kinds" in batch.schema.names:
        offsets, kinds = lists(batch["kinds"])
        return offsets, by_kind(kinds.astype(np.int64))
    offsets, cost = lists(batch["costs"])
    cost, rank = cost.reshape(-1, STATES, STATES), lists(batch["ranks"])[1].reshape(-1, STATES, STATES)
    return offsets // STATES**2, lambda at: (cost[at], rank[at].astype(np.int64))


def with_nodes(groups: DataFrame) -> DataFrame:
    """Groups(..., kinds or costs and ranks) with the cost and rank of each as one node."""
    names = [x for x in groups.columns if x not in ("kinds", "costs", "ranks")]
    kinds = ", ".join(f"{x} {groups.schema[x].dataType.simpleString()}" for x in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost, rank = combine(*elements(batch))
            flat = [pa.array(list(x.reshape(len(x), -1)), pa.list_(kind)) for x, kind in ((cost, pa.int64()), (rank, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*[batch[x] for x in names], *flat], [*names, "cost", "rank"])

    return groups.mapInArrow(run, f"{kinds}, cost array<long>, rank array<int>")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text): rows broken in five ways, by the CRC-32 of conversation and turn."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(conversation(), "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name) % 20).alias("fate"))
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(fate == 4, "user").otherwise(F.col("role"))
    copies = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter("fate <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def conversation() -> Column:
    """A conversation's name, never null."""
    return F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string"))).alias("conv")


def in_turn(rows: DataFrame) -> DataFrame:
    """Rows(conv, turn, role, text) in order, written, with at (0, 1, ... over all rows), run, blank,
    truncated and same, a hash of role and text."""
    bare = F.rtrim("text", F.lit(WHITE))
    blank = bare == ""
    base = rows.withColumns({
        "blank": blank, "truncated": ~blank & ~F.right(bare, F.lit(1)).isin(".", "!", "?"),
        "same": F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), "row": F.monotonically_increasing_id(),
    })
    base = keep(base, "turns")
    ordered = in_order(base, ["conv", "turn", "role", "same", "row"], "turns-ordered").drop("row")
    drop_table(base)
    task = F.shiftright("at", WITHIN).alias("task")
    counts = ordered.groupBy(task).agg(F.min("at").alias("first"), F.count("*").alias("here"))
    # one row for each task of the sort: a few hundred bytes for each half million rows
    before = F.sum("here").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("task", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    placed = ordered.withColumn("task", task).join(F.broadcast(shifts), "task").withColumn("at", F.col("at") + F.col("shift"))
    return placed.drop("task", "shift").withColumn("run", F.shiftright("at", RUN_BITS))


def illegal_pairs(parts: Column) -> Column:
    """Neighbours in a list of (first, last) initials that no conversation has."""
    before, after = F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts) - 1)
    pairs = F.zip_with(before, after, lambda x, y: F.concat(x["last"], y["first"]))
    return F.size(F.filter(pairs, lambda x: ~x.isin("su", "ua", "au"))).cast("long")


def shared_turns(parts: Column) -> Column:
    """Neighbours of which the second begins with the turn that the first ends with."""
    before, after = F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts) - 1)
    return F.size(F.filter(F.zip_with(before, after, lambda x, y: x["turn_last"] == y["turn_first"]), lambda x: F.coalesce(x, F.lit(False)))).cast("long")


def add(parts: Column, name: str) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda n, x: n + x[name])


def summary(parts: Column) -> list[Column]:
    """What a list of rows or nodes in order has together."""
    end = F.element_at(parts, -1)
    return [
        F.element_at(parts, 1)["first"].alias("first"), end["last"].alias("last"),
        F.element_at(parts, 1)["turn_first"].alias("turn_first"), end["turn_last"].alias("turn_last"),
        F.array_min(F.transform(parts, lambda x: x["turn_min"])).alias("turn_min"), F.array_max(F.transform(parts, lambda x: x["turn_max"])).alias("turn_max"),
        (add(parts, "turns") - shared_turns(parts)).alias("turns"), (add(parts, "illegal") + illegal_pairs(parts)).alias("illegal"),
        *[add(parts, x).alias(x) for x in ("blank", "duplicate", "truncated")],
    ]


STATS = ("first", "last", "turn_first", "turn_last", "turn_min", "turn_max", "turns", "illegal", "blank", "duplicate", "truncated")


def first_level(placed: DataFrame) -> DataFrame:
    """Runs of rows: (conv, run, begin, kinds, statistics), written."""
    narrow = placed.select("conv", "run", "at", "turn", "blank", "truncated", "same", F.substring("role", 1, 1).alias("initial"))
    often = narrow.groupBy("conv", "same").agg(F.min("at").alias("earliest"), F.count("*").alias("times")).filter("times > 1").drop("times")
    marked = narrow.join(often, ["conv", "same"], "left").withColumn("duplicate", ~F.col("blank") & F.coalesce(F.col("at") > F.col("earliest"), F.lit(False)))
    unusable = F.col("blank") | F.col("duplicate")
    truncated = F.col("truncated") & ~unusable
    fault = F.when(unusable, UNUSABLE).when(truncated, TRUNCATED).otherwise(SOUND)
    initial = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in INITIALS]), F.col("initial")).cast("int"), F.lit(0))
    kind = fault + 3 * F.when(initial > 0, initial - 1).otherwise(len(INITIALS))
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    part = F.struct(
        "at", kind.cast("int").alias("kind"), F.col("initial").alias("first"), F.col("initial").alias("last"),
        *[F.col("turn").alias(x) for x in ("turn_first", "turn_last", "turn_min", "turn_max")], one(F.col("turn").isNotNull()).alias("turns"),
        F.lit(0).cast("long").alias("illegal"), one(F.col("blank")).alias("blank"), one(F.col("duplicate")).alias("duplicate"), one(truncated).alias("truncated"),
    )
    runs = marked.groupBy("conv", "run").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    parts = F.col("parts")
    return keep(runs.select("conv", "run", F.element_at(parts, 1)["at"].alias("begin"), F.transform(parts, lambda x: x["kind"]).alias("kinds"), *summary(parts)), "runs")


def next_level(nodes: DataFrame) -> DataFrame:
    """Nodes of conversations that still have several, `RUN` to one: (conv, run, runs, costs, ranks, ...)."""
    several = nodes.groupBy("conv").agg(F.count("*").alias("nodes")).filter("nodes > 1").select("conv")
    part = F.struct("run", *STATS, "cost", "rank")
    groups = nodes.join(several, "conv", "left_semi").groupBy("conv", F.shiftright("run", RUN_BITS).alias("above")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    parts = F.col("parts")
    inner = [F.flatten(F.transform(parts, lambda x: x["cost"])).alias("costs"), F.flatten(F.transform(parts, lambda x: x["rank"])).alias("ranks")]
    return groups.select("conv", F.col("above").alias("run"), F.transform(parts, lambda x: x["run"]).alias("runs"), *inner, *summary(parts))


def climb(runs: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels up to one node a conversation, and these nodes with the level that each is on."""
    levels, done = [runs], None
    nodes = keep(with_nodes(runs.drop("begin")), "nodes")
    while True:
        up = keep(next_level(nodes), "groups")
        alone = nodes.join(up.select("conv").distinct(), "conv", "left_anti").withColumn("level", F.lit(len(levels) - 1))
        done = alone if done is None else done.unionByName(alone)
        if not up.limit(1).count():
            return levels, done
        levels.append(up)
        nodes = keep(with_nodes(up.drop("runs")), "nodes")


def chosen(tops: DataFrame) -> DataFrame:
    """Nodes of whole conversations with the cheapest exit: `leave`, total `cost` and inserts at the end."""
    ways = F.array(*[F.struct((F.col("cost")[q] + INSERT * TAIL[q]).alias("cost"), F.col("rank")[q].alias("rank"), F.lit(q).alias("leave"), F.lit(TAIL[q]).alias("tail")) for q in range(STATES)])
    best = F.array_min(ways)
    return tops.withColumn("way", best).withColumns({"cost": F.col("way.cost"), "leave": F.col("way.leave"), "tail": F.col("way.tail"), "entry": F.lit(0)}).drop("way", "rank")


def traced(groups: DataFrame, passed: list[str], schema: str, result: Callable) -> DataFrame:
    """Groups(..., entry, leave) with what result() makes of the way through each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, element = elements(batch)
            ends = [batch[x].to_numpy(zero_copy_only=False).astype(np.int64) for x in ("entry", "leave")]
            made = result(batch, offsets, *trace(offsets, element, *ends))
            yield pa.RecordBatch.from_arrays([*[batch[x] for x in passed], *made.values()], [*passed, *made])

    kinds = ", ".join(f"{x} {groups.schema[x].dataType.simpleString()}" for x in passed)
    return groups.mapInArrow(run, f"{kinds}, {schema}")


def inner_ends(batch: pa.RecordBatch, offsets: np.ndarray, before: np.ndarray, after: np.ndarray) -> dict:
    return {k: pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(v.astype(np.int32))) for k, v in (("entries", before), ("leaves", after))}


#: A row's edit as one character: its state before and its code.
BASE = 48


def edit_letters(batch: pa.RecordBatch, offsets: np.ndarray, before: np.ndarray, after: np.ndarray) -> dict:
    kinds = lists(batch["kinds"])[1].astype(np.int64)
    code = STEP_CODE[kinds, before, after]
    letters = (BASE + before * len(CODES) + code).astype(np.uint8).tobytes().decode("ascii")
    bounds = offsets.tolist()
    names = np.array(CODES, object)[code]
    spans = list(zip(bounds, bounds[1:]))
    return {"edits": pa.array([letters[i:j] for i, j in spans]), "audit": pa.array(["".join(names[i:j]) for i, j in spans])}


def edited(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(conv, run, begin, edits, audit) of every run of rows: the choice handed down the levels."""
    ends = None
    for i in range(len(levels) - 1, -1, -1):
        here = tops.filter(F.col("level") == i).select("conv", "run", "entry", "leave")
        if ends is not None:
            pair = F.explode(F.arrays_zip("runs", "entries", "leaves")).alias("x")
            here = here.unionByName(ends.select("conv", pair).select("conv", F.col("x.runs").alias("run"), F.col("x.entries").alias("entry"), F.col("x.leaves").alias("leave")))
        if i:
            groups = levels[i].select("conv", "run", "runs", "costs", "ranks").join(here, ["conv", "run"])
            ends = traced(groups, ["conv", "runs"], "entries array<int>, leaves array<int>", inner_ends)
        else:
            runs = levels[0].select("conv", "run", "begin", "kinds").join(here, ["conv", "run"])
            return traced(runs, ["conv", "run", "begin"], "edits string, audit string", edit_letters)


def repaired(placed: DataFrame, edits: DataFrame, tops: DataFrame) -> DataFrame:
    """(conv, at, lines): the turns (role, text) that stand in place of each row, and those at the end."""
    turn = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    none = F.array().cast("array<struct<role:string,text:string>>")
    blank = lambda roles: F.array(*[turn(F.lit(r), F.lit("")) for r in roles]) if roles else none
    ways = [lines_of(state, code) for state in range(STATES) for code in range(len(CODES))]
    way = F.ascii(F.substr("edits", (F.col("at") - F.col("begin") + 1).cast("int"), F.lit(1))) - BASE + 1
    inserted = F.element_at(F.array(*[blank(i) for i, _ in ways]), way)
    becomes = F.element_at(F.array(*[F.lit(role) for _, role in ways]), way)
    own = F.when(becomes.isNull(), none).otherwise(F.array(turn(F.when(becomes == "", F.col("role")).otherwise(becomes), F.col("text"))))
    rows = placed.select("conv", "run", "at", "role", "text").join(edits.select("conv", "run", "begin", "edits"), ["conv", "run"])
    rows = rows.select("conv", "at", F.concat(inserted, own).alias("lines")).filter(F.size("lines") > 0)
    roles = [ROLES["u"], ROLES["a"]]
    last = tops.filter("tail > 0").select("conv", F.lit((1 << 63) - 1).alias("at"), F.when(F.col("tail") == 1, blank(roles[1:])).otherwise(blank(roles)).alias("lines"))
    return rows.unionByName(last)


def text_digests(lines: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the turns as lines, read in order and never held as a whole."""
    joined = F.array_join(F.transform("lines", lambda x: F.concat(x.role, F.lit(":"), x.text)), "\n").alias("lines")
    ordered = lines.select("conv", "at", joined).repartition("conv").sortWithinPartitions("conv", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, hashlib.sha256()
        for pdf in batches:
            out = []
            for conv, text in zip(pdf["conv"], pdf["lines"]):
                if conv != now:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256(text.encode())
                else:
                    state.update(b"\n" + text.encode())
            yield pd.DataFrame(out, columns=["conv", "repaired_sha256"])
        if now is not None:
            yield pd.DataFrame([(now, state.hexdigest())], columns=["conv", "repaired_sha256"])

    return ordered.mapInPandas(run, "conv string, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows(conv, turn, role, text): each conversation's faults and cost, its audit, and its turns
    after the repair."""
    placed = in_turn(rows)
    levels, nodes = climb(first_level(placed))
    tops = keep(chosen(nodes), "tops")
    edits = keep(edited(levels, tops), "edits")
    pieces = edits.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("run", "audit"))).alias("parts"))
    audits = pieces.select("conv", F.array_join(F.transform("parts", lambda x: x.audit), "").alias("audit"))
    return tops, audits, repaired(placed, edits, tops)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every conversation's faults after damage, the cheapest repair's cost and audit, and the digest of
    the repaired turns."""
    tops, audits, lines = repair(damaged(conversations))
    every = conversations.select("conv_id", conversation()).distinct()
    out = every.join(tops, "conv", "left").join(audits, "conv", "left").join(text_digests(lines), "conv", "left")
    zero = F.lit(0).cast("long")
    number = lambda name: F.coalesce(F.col(name).cast("long"), zero).alias(name)
    gaps = F.coalesce(F.col("turn_max") - F.col("turn_min") + 1 - F.col("turns"), zero).cast("long").alias("gaps")
    audit = F.concat(F.coalesce("audit", F.lit("")), F.repeat(F.lit("I"), F.coalesce("tail", F.lit(0)))).alias("audit")
    return out.select("conv_id", gaps, *[number(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")], audit, F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
