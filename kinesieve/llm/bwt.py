"""Exact removal of repeated byte strings by merging shard Burrows-Wheeler transforms.

A transform of all bytes would need as many merge passes as the longest prefix looked at (400) over
every byte. The texts are therefore parsed first, as in prefix-free parsing: the smallest hash among
every WINDOW neighbouring positions starts a phrase, so equal strings have equal phrases wherever
they lie, but for the two ends. The transforms are over these phrases.

A shard is a chunk of documents. The merge interleaves the suffixes of all shards by refinement: at
depth 0 all are one block, and a pass takes every block in order, steps from each of its suffixes to
the symbol before it (the transform's entry there), and puts that longer suffix into the block of
(symbol, block it came from). A block is named by its first place in the interleave, so names are
ranks, compare as the prefixes do, and two suffixes have one name exactly when they share that many
phrases. Buckets own ranges of the symbol order; shards send each distinct pair once with its count
and get back the merged block's name and size. A block of one is a suffix whose common prefix with
every other ends there: it leaves the merge, and so does what is before it. The number of passes that
a suffix stayed in blocks of two or more is its longest common prefix; no suffix is sorted again.

The block sizes settle almost every 400-byte window. Its phrases, the cut ones at both ends
included, form a run: if that is repeated, so is the window. If the run of the phrases wholly inside
(those fixed by the window's own bytes) is not repeated, neither is the window. Where the inner run
has more occurrences than the outer, the windows themselves are compared: these are the ends of
repeats, and every occurrence with that inner run takes part. Phrases and windows are told apart by
two independent 64-bit hashes.

Defined cases: null text is empty; matches never cross documents; rows without doc_id or repeating
one are documents of their own (equal rows repeat each other, so nothing of 400 bytes or more stays of
them); texts of any length are one document each, hashed a bounded stretch at a time; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinesieve.llm.exchange import bucket_count, pack, pack_sorted, text_bytes, unpack, unpack_sorted
from kinesieve.llm.ids import identified, with_ids
from kinesieve.llm.kernels import U64, blocks, first_of_runs, mix, powers
from kinesieve.llm.storage import drop_part, drop_table, keep

#: Bytes that are hashed at each position, and positions of which the smallest starts a phrase.
GRAM = 16
#: Passes of the merge, so phrases of the longest prefix that it tells.
DEEPEST = 16
BLOCK = 1 << 19
#: Kinds of rows: a shard's texts, its state, and requests or replies (bucket 0 or more).
TEXTS, STATE = -1, -2
ROWS = "chunk long, bucket int, n long, keys binary, vals binary, reply binary"
NAMES = [x.split()[0] for x in ROWS.split(", ")]


def window_of(length: int) -> int:
    """The largest window with which a string of `length` has two disjoint ones inside."""
    return max(1, (length - GRAM + 1) // 2)


#: What a byte counts in each of the two hashes.
WEIGHTS = tuple(mix(np.arange(256, dtype=U64) + U64(x)) for x in (1 << 20, 1 << 40))


def prefix_sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(WEIGHTS[which][data] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def hashes_of(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + mix((ends - starts).astype(U64)))


def fixed_hashes(sums: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    return mix((sums[starts + length] - sums[starts]) * powers(len(sums))[1][starts] + U64(length))


def smallest(data: np.ndarray, window: int) -> np.ndarray:
    """For each position, where the smallest hash of the `window` positions from there is."""
    n = len(data) - GRAM + 1
    if n < window:
        return np.zeros(0, np.int64)
    key = fixed_hashes(prefix_sums(data), np.arange(n), GRAM)
    key = (key & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=U64)
    rows = -(-n // window)
    padded = np.full(rows * window, np.iinfo(U64).max, U64)
    padded[:n] = key
    grid = padded.reshape(rows, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - window + 1
    return (np.minimum(behind[:last], ahead[window - 1 : window - 1 + last]) & U64(0xFFFFFFFF)).astype(np.int64)


class Shard:
    """The phrases of a chunk of texts laid end to end, and where the merge has put their suffixes.

    first: where each phrase starts; low: for phrases started by a smallest hash, the first position
    whose window chooses it, else -1; doc: the text of each phrase; symbol: two hashes of each phrase
    before the merge, then its rank among all phrases of the corpus (-1: nobody else's); block: the
    name of the suffix's block at the depth reached, -1 if it is alone in it or not asked for.
    """

    def __init__(self, ends: np.ndarray, first: np.ndarray, low: np.ndarray, symbol: np.ndarray):
        self.ends, self.first, self.low, self.symbol = ends, first, low, symbol
        self.last = np.append(first[1:], ends[-1] if len(ends) else 0)
        self.doc = np.searchsorted(ends, first, side="right")
        self.depth = 0
        self.block = np.zeros(len(first), np.int64)
        self.sizes = np.zeros((DEEPEST, len(first)), np.int32)  # of the merged blocks, 0: under 2

    @classmethod
    def parse(cls, texts: list[bytes], window: int) -> "Shard":
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        firsts, lows, symbols = [], [], []
        for i, j in blocks(lengths, BLOCK):
            data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
            base = ends[i] - lengths[i]
            if not len(data):
                continue
            choice = smallest(data, window)
            at = first_of_runs(choice)
            picked = choice[at]
            starts = (ends[i:j] - lengths[i:j] - base)[lengths[i:j] > 0]
            first = np.union1d(picked, starts)
            low = np.full(len(first), -1, np.int64)
            low[np.searchsorted(first, picked)] = at
            last = np.append(first[1:], len(data))
            symbols.append(np.stack([hashes_of(prefix_sums(data, k), first, last) for k in (0, 1)]))
            firsts.append(first + base)
            lows.append(np.where(low >= 0, low + base, -1))
        none = np.zeros(0, np.int64)
        return cls(ends, np.concatenate([none, *firsts]), np.concatenate([none, *lows]), np.concatenate([np.zeros((2, 0), U64), *symbols], axis=1))

    def depth_needed(self, length: int) -> np.ndarray:
        """Phrases of the outer run of a window that starts at the end of each phrase."""
        end = np.minimum(self.last + length - 2, self.ends[self.doc] - 1)
        return np.searchsorted(self.first, end, side="right") - np.arange(len(self.first))

    def next_depth(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The suffixes that the next pass places, and the pairs that place them: the symbol and the
        block of the suffix after it. (At depth 1, the two hashes of the phrase.)"""
        n, depth = len(self.first), self.depth + 1
        if depth == 1:
            return np.arange(n), self.symbol[0], self.symbol[1]
        in_doc = np.searchsorted(self.doc, self.doc, side="right") - np.arange(n)
        after = np.append(self.block[1:], -1)
        at = np.flatnonzero((self.block >= 0) & (after >= 0) & (in_doc >= depth) & (self.depth_needed(length) >= depth))
        return at, self.symbol[at].astype(U64), after[at].astype(U64)

    def place(self, at: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> None:
        """Takes the merged blocks of a pass's suffixes."""
        self.depth += 1
        self.block = np.full(len(self.first), -1, np.int64)
        self.block[at] = np.where(sizes >= 2, names, -1)
        self.sizes[self.depth - 1, at] = np.where(sizes >= 2, np.minimum(sizes, 1 << 30), 0)
        if self.depth == 1:
            self.symbol = self.block

    def state(self) -> bytes:
        fields = [self.ends, np.diff(self.first, prepend=0), np.where(self.low >= 0, self.first - self.low, -1)]
        merged = [self.symbol.view(np.int64).ravel()] if not self.depth else [self.symbol, self.block, self.sizes[: self.depth].astype(np.int64).ravel()]
        return pack(np.concatenate([np.array([len(self.ends), len(self.first), self.depth], np.int64), *fields, *merged]))

    @classmethod
    def from_state(cls, blob: bytes) -> "Shard":
        raw = unpack(blob, np.int64)
        d, n, depth = raw[:3].tolist()
        ends, steps, low, rest = np.split(raw[3:], np.cumsum([d, n, n]))
        first = np.cumsum(steps)
        low = np.where(low >= 0, first - low, -1)
        if not depth:
            return cls(ends, first, low, rest.view(U64).reshape(2, n))
        out = cls(ends, first, low, rest[:n])
        out.depth, out.block = depth, rest[n : 2 * n]
        out.sizes[:depth] = rest[2 * n :].reshape(depth, n)
        return out

    def common_bytes(self) -> np.ndarray:
        """Of each text, the bytes of its longest run of whole phrases that another suffix starts with:
        the longest common prefix of its suffixes, by phrases, of DEEPEST at most."""
        shared = (self.sizes >= 2).sum(0)
        last = np.arange(len(self.first)) + np.maximum(shared, 1) - 1
        size = np.where(shared > 0, self.last[last] - self.first, 0) if len(last) else np.zeros(0, np.int64)
        out = np.zeros(len(self.ends), np.int64)
        np.maximum.at(out, self.doc, size)
        return out

    def outcomes(self, length: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For blocks of texts with repeated phrases, parsed with `window`: starts of windows that are settled as
        repeated, and of windows to compare by hash."""
        shift = length - GRAM + 1 - window
        hot = np.zeros(len(self.ends) + 1, bool)
        hot[self.doc[self.sizes[0] >= 2]] = True
        begin = np.concatenate(([0], self.ends[:-1])) if len(self.ends) else self.ends
        long_enough = np.flatnonzero(hot[:-1] & (self.ends - begin >= length))
        chosen = np.flatnonzero(self.low >= 0)
        low = self.low[chosen]
        for i, j in blocks((self.ends - begin)[long_enough], BLOCK):
            docs = long_enough[i:j]
            n = self.ends[docs] - begin[docs] - length + 1
            s = np.repeat(begin[docs] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            x = np.searchsorted(self.first, s, side="right") - 1
            y = np.searchsorted(self.first, s + length - 1, side="right") - 1
            a = chosen[np.searchsorted(low, s, side="right") - 1]
            b = chosen[np.searchsorted(low, s + shift, side="right") - 1]
            outer, inner = self.size_of(x, y - x + 1), self.size_of(a, b - a)
            yield s[outer >= 2], s[(inner != 0) & ((outer < inner) | (outer < 0) | (inner < 0))]

    def size_of(self, suffix: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Interval sizes: 0 for under two, -1 where the depth was not refined."""
        known = depth <= DEEPEST
        return np.where(known, self.sizes[np.minimum(depth, DEEPEST) - 1, suffix], -1)


def by_range(first: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets of hashes: ranges in their order."""
    return (((first >> U64(32)) * U64(n_buckets)) >> U64(32)).astype(np.int64)


def by_rank(first: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets of ranks: the ones that gave them."""
    return (first >> U64(RANK_BITS)).astype(np.int64)


#: Bits of a name that count places within a bucket.
RANK_BITS = 40


def distinct_pairs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, which of them each pair is, and how often each is there."""
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    return a[first], b[first], which, np.diff(np.append(first, len(a)))


def asked_rows(chunk: int, one: np.ndarray, two: np.ndarray, place, n_buckets: int) -> list[tuple]:
    """A chunk's distinct pairs for the buckets that own them, with counts. Buckets own ranges of the
    first value, so the pairs' order is that of the buckets too."""
    a, b, _, counts = distinct_pairs(one, two)
    owner = place(a, n_buckets)
    first = first_of_runs(owner)
    rows = []
    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(a)]):
        rows.append((chunk, int(owner[i]), j - i, pack_sorted(a[i:j]), pack(np.concatenate((b[i:j].view(np.int64), counts[i:j]))), None))
    return rows


def answers(pdf: pd.DataFrame, one: np.ndarray, two: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and sizes of the merged blocks, for each of the pairs that asked_rows() was given."""
    got = pdf[pdf["bucket"] >= 0].sort_values("bucket")
    which = distinct_pairs(one, two)[2]
    parts = [unpack(r, np.int64).reshape(2, -1) for r in got["reply"]]
    names, sizes = np.concatenate([np.zeros((2, 0), np.int64), *parts], axis=1)
    return names[which], sizes[which]


def merged_blocks(pdf: pd.DataFrame, named: bool) -> pd.DataFrame:
    """One bucket of the interleave: equal pairs of all chunks are a block, named by where it starts.
    Without names, all that is told is whether a pair is the only one."""
    ones = np.concatenate([unpack_sorted(x) for x in pdf["keys"]])
    rest = [unpack(x, np.int64).reshape(2, -1) for x in pdf["vals"]]
    twos, counts = np.concatenate(rest, axis=1)
    _, _, which, _ = distinct_pairs(ones, twos.view(U64))
    sizes = np.bincount(which, weights=counts).astype(np.int64)
    if named:
        names = (int(pdf["bucket"].iloc[0]) << RANK_BITS) + np.cumsum(sizes) - sizes
    else:
        names, sizes = np.zeros(len(sizes), np.int64), np.minimum(sizes, 2)
    both = np.split(np.stack((names[which], sizes[which])), np.cumsum(pdf["n"].to_numpy())[:-1], axis=1)
    out = pdf[["chunk", "bucket"]].copy()
    out["n"], out["keys"], out["vals"], out["reply"] = 0, None, None, [pack(x) for x in both]
    return out


def shards(docs: DataFrame, window: int, n_buckets: int, chunk_bytes: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, ordinal = TaskContext.get().partitionId(), 0
        texts: list[bytes] = []
        ids: list = []
        size = 0

        def close() -> pd.DataFrame:
            chunk = (pid << 24) + ordinal
            shard = Shard.parse(texts, window)
            missing = np.array([x is None for x in ids])
            numbers = np.array([0 if x is None else x for x in ids], np.int64)
            blob = pack(np.frombuffer(b"".join(texts), np.uint8), 6)  # stored and shuffled twice
            rows = [(chunk, TEXTS, len(texts), pack(np.concatenate((numbers, missing))), blob, None), (chunk, STATE, 0, shard.state(), None, None)]
            rows += asked_rows(chunk, *shard.symbol, by_range, n_buckets) if len(shard.first) else []
            return pd.DataFrame(rows, columns=NAMES)

        for pdf in batches:
            for doc, text in zip(identified(pdf), pdf["text"].tolist()):
                texts.append((text or "").encode("utf-8", "surrogatepass"))
                ids.append(doc)
                size += len(texts[-1])
                if size >= chunk_bytes:
                    yield close()
                    ordinal, texts, ids, size = ordinal + 1, [], [], 0
        if texts:
            yield close()

    return with_ids(docs).mapInPandas(run, ROWS)


def replied(asked: DataFrame, named: bool) -> DataFrame:
    return asked.filter("bucket >= 0").select(*NAMES).groupBy("bucket").applyInPandas(lambda pdf: merged_blocks(pdf, named), ROWS)


def merge_pass(now: DataFrame, length: int, n_buckets: int) -> DataFrame:
    """Takes the merged blocks of a pass into each shard and asks for those of the next depth."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(pdf["chunk"].iloc[0])
        shard = Shard.from_state(pdf.loc[pdf["bucket"] == STATE, "keys"].iloc[0])
        rows = []
        if len(shard.first):
            at, one, two = shard.next_depth(length)
            shard.place(at, *answers(pdf, one, two, n_buckets))
            if shard.depth < DEEPEST:
                _, one, two = shard.next_depth(length)
                rows = asked_rows(chunk, one, two, by_rank, n_buckets)
        return pd.DataFrame([(chunk, STATE, 0, shard.state(), None, None), *rows], columns=NAMES)

    state = now.filter(F.col("bucket") == STATE).select(*NAMES)
    return state.unionByName(replied(now, True)).groupBy("chunk").applyInPandas(run, ROWS)


def hashes_at(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Both hashes of the windows at sorted starts (of the second 32 bits, as there are many windows),
    with sums over a bounded stretch at a time."""
    out, i = [np.zeros((2, 0), U64)], 0
    while i < len(starts):
        base = starts[i]
        j = np.searchsorted(starts, base + BLOCK, side="right")
        part = starts[i:j]
        stretch = data[base : part[-1] + length]
        out.append(np.stack([fixed_hashes(prefix_sums(stretch, k), part - base, length) for k in (0, 1)]))
        i = j
    both = np.concatenate(out, axis=1)
    both[1] >>= U64(32)
    return both


def compare_windows(now: DataFrame, texts: DataFrame, length: int, window: int, n_buckets: int) -> DataFrame:
    """Per shard: each text's longest common run, what is settled, the windows to compare, and the
    requests for them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk = int(pdf["chunk"].iloc[0])
        shard = Shard.from_state(pdf.loc[pdf["bucket"] == STATE, "keys"].iloc[0])
        data = unpack(pdf.loc[pdf["bucket"] == TEXTS, "vals"].iloc[0], np.uint8)
        settled, open_ = [np.zeros((0, 2), np.int64)], [np.zeros(0, np.int64)]
        for sure, compare in shard.outcomes(length, window):
            if len(sure):
                at = np.flatnonzero(np.concatenate(([True], np.diff(sure) > 1)))
                settled.append(np.stack((sure[at], sure[np.append(at[1:], len(sure)) - 1] + length), 1))
            open_.append(compare)
        spans, starts = np.concatenate(settled), np.concatenate(open_)
        rows = asked_rows(chunk, *hashes_at(data, starts, length), by_range, n_buckets) if len(starts) else []
        state = np.concatenate(([len(shard.ends), len(spans), len(starts)], shard.ends, shard.common_bytes(), spans.ravel(), np.diff(starts, prepend=0)))
        rows.append((chunk, STATE, 0, pack(state.astype(np.int64)), None, None))
        return pd.DataFrame(rows, columns=NAMES)

    state = now.filter(F.col("bucket") == STATE).select(*NAMES)
    return state.unionByName(texts).groupBy("chunk").applyInPandas(run, ROWS)


def repeated_runs(pdf: pd.DataFrame, length: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a shard, its texts' ends and longest common runs, and starts and ends of the runs
    of bytes that repeated strings cover, in order."""
    raw = unpack(pdf.loc[pdf["bucket"] == STATE, "keys"].iloc[0], np.int64)
    data = unpack(pdf.loc[pdf["bucket"] == TEXTS, "vals"].iloc[0], np.uint8)
    n_docs, n_spans, n_starts = raw[:3].tolist()
    ends, common, spans, steps = np.split(raw[3:], np.cumsum([n_docs, n_docs, 2 * n_spans]))
    starts = np.cumsum(steps)
    if len(starts):
        starts = starts[answers(pdf, *hashes_at(data, starts, length), n_buckets)[1] >= 2]
    spans = np.concatenate((spans.reshape(-1, 2), np.stack((starts, starts + length), 1)))
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    doc = np.searchsorted(ends, spans[:, 0], side="right")
    reach = np.maximum.accumulate(spans[:, 1]) if len(spans) else np.zeros(0, np.int64)
    new = np.ones(len(spans), bool)
    new[1:] = (spans[1:, 0] > reach[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return data, ends, common, spans[at, 0], reach[np.append(at[1:], len(spans)) - 1] if len(at) else reach


def merged_shards(docs: DataFrame, length: int, window: int, n_buckets: int, chunk_bytes: int, passes: int = DEEPEST, lean: bool = False) -> tuple[DataFrame, DataFrame]:
    """The shards, of which only the texts are left if `lean`, and their states after the merge."""
    part = F.when(F.col("bucket") == TEXTS, "texts").otherwise("work").alias("part")
    parsed = keep(shards(docs, window, n_buckets, chunk_bytes).select(*NAMES, part), "shards", partition_by="part")
    first = now = parsed.filter("part = 'work'").select(*NAMES)
    for _ in range(passes):
        before = now
        now = keep(merge_pass(before, length, n_buckets), "merge")
        if before is not first:
            drop_table(before)
        elif lean:
            drop_part(parsed, "part=work")
        if now.filter("bucket >= 0").isEmpty():
            break
    return parsed, now


def by_document(compared: DataFrame, texts: DataFrame, n_buckets: int, length: int, passage: int, with_text: bool) -> DataFrame:
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, longest_run long, common_bytes long, has_passage boolean" + ", kept binary" * with_text

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        data, ends, common, lo, hi = repeated_runs(pdf, length, n_buckets)
        numbers, missing = unpack(pdf.loc[pdf["bucket"] == TEXTS, "keys"].iloc[0], np.int64).reshape(2, -1)
        begins = np.concatenate(([0], ends[:-1]))
        first, last = np.searchsorted(lo, begins), np.searchsorted(lo, ends)
        whole = data.tobytes()
        rows = []
        for d, (begin, end, i, j) in enumerate(zip(begins.tolist(), ends.tolist(), first.tolist(), last.tolist())):
            kept, at = [], begin
            for x, y in zip(lo[i:j].tolist(), hi[i:j].tolist()):
                kept.append(whole[at:x])
                at = y
            kept.append(whole[at:end])
            rest = b"".join(kept)
            row = (None if missing[d] else int(numbers[d]), end - begin, end - begin - len(rest), j - i, hashlib.sha256(rest).hexdigest(), int((hi[i:j] - lo[i:j]).max(initial=0)))
            rows.append((*row, int(common[d]), bool(j > i or common[d] >= passage), *([rest] if with_text else [])))
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
        return out.assign(doc_id=pd.array([x[0] for x in rows], "Int64"))

    state = compared.filter(F.col("bucket") == STATE).select(*NAMES)
    return state.unionByName(texts).unionByName(replied(compared, False)).groupBy("chunk").applyInPandas(run, schema)


def remove_repeats(docs: DataFrame, length: int = 400, passage: int = 125, with_text: bool = False, chunk_bytes: int = 16 << 20) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, longest_run (bytes of
    the longest removed run), common_bytes (bytes of the longest run of whole phrases that occurs
    elsewhere), has_passage (whether that is `passage` or more, or anything was removed) and, if asked
    for, the kept bytes. A byte goes if a string of `length` bytes that covers it also starts elsewhere."""
    n_buckets = bucket_count(text_bytes(docs))
    # phrases so short that a string of twice the passage has some whole ones
    window = min(window_of(length), window_of(2 * passage))
    parsed, now = merged_shards(docs, length, window, n_buckets, chunk_bytes, lean=True)
    texts = parsed.filter("part = 'texts'").select(*NAMES)
    compared = keep(compare_windows(now, texts, length, window, n_buckets), "windows")
    drop_table(now)
    return by_document(compared, texts, n_buckets, length, passage, with_text)
