"""Prediction by partial matching over bytes, trained on the corpus.

The model is the trie of all byte contexts up to order 5, held as sorted (context, byte) keys with
counts. A byte's probability starts at the longest context; where the byte was never seen there, an
escape (half the distinct bytes over the total, method D) leads to the next shorter context, from
which the bytes seen so far are excluded. Six bytes fix all of that, so a chunk of documents asks
for the code length of each distinct six-byte string once: the requests meet in buckets that own the
contexts' last three bytes, where training counts are summed and the trie's branches are walked.
Orders up to 2 cross the buckets; their table has at most 2**24 entries whatever the corpus (of
text, far fewer) and is broadcast. Word counts for the base score go the same way.

A text is read as its words (A-Z lower-cased) with one space between and an end mark.

Defined cases: null text is empty, which is the end mark alone; rows without doc_id are scored as
held out, rows that repeat one are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinesieve.llm.exchange import REPLY, REQUEST, aligned, bucket_count, by_hash, pack, pack_sorted, requests, text_bytes, unpack, unpack_sorted
from kinesieve.llm.ids import identified, with_ids
from kinesieve.llm.kernels import U64, blocks, first_of_runs, mix, normalise, words_of
from kinesieve.llm.storage import drop_part, keep

ORDER = 5
END = b"\n"
#: Orders whose counts are broadcast.
SHORT = 2
PADDED = REQUEST + ", kind int"
MAX_DOCS = 1 << 16
#: Distinct strings whose positions are added up at a time.
SLICE = 1 << 16


def mask(n_bytes: int) -> np.uint64:
    return U64((1 << (8 * n_bytes)) - 1)


def by_context(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """Buckets of six-byte keys: by the last three bytes before the predicted one."""
    return (mix((keys >> U64(8)) & mask(3)) % U64(n_buckets)).astype(np.int64)


def grams(texts: list[bytes]) -> np.ndarray:
    """Sorted (context and byte, text number) of all bytes of the texts, packed into 64 bits."""
    size = sum(map(len, texts)) + len(texts)
    out = np.empty(size, U64)
    at = 0
    sizes = np.fromiter((len(x) + 1 + ORDER for x in texts), np.int64, len(texts))
    for i, j in blocks(sizes, 1 << 18):
        data = np.frombuffer(b"".join(END * ORDER + x + END for x in texts[i:j]), np.uint8).astype(U64)
        key = np.zeros(len(data) - ORDER, U64)
        for k in range(ORDER + 1):
            key <<= U64(8)
            key |= data[k : k + len(key)]
        own = sizes[i:j]
        number = np.repeat(np.arange(i, j, dtype=U64), own)
        inside = np.ones(len(data), bool)
        firsts = np.concatenate(([0], np.cumsum(own)[:-1]))
        for k in range(ORDER):
            inside[firsts + k] = False
        inside, number = inside[ORDER:], number[ORDER:]
        part = ((key << U64(16)) | number)[inside]
        out[at : at + len(part)] = part
        at += len(part)
    out.sort()
    return out


class Level:
    """Counts of one order: by (context, byte) and by context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = first_of_runs(keys)
        self.keys = keys[first]
        self.counts = np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)
        contexts = self.keys >> U64(8)
        self.first = first_of_runs(contexts)
        self.contexts = contexts[self.first]
        self.total = np.add.reduceat(self.counts, self.first) if len(self.first) else np.zeros(0, np.int64)
        self.distinct = np.diff(np.append(self.first, len(contexts)))

    @staticmethod
    def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def count_of(self, keys: np.ndarray) -> np.ndarray:
        at, there = self.find(self.keys, keys)
        return np.where(there, self.counts[at], 0) if len(self.keys) else np.zeros(len(keys), np.int64)


def levels_of(keys: np.ndarray, counts: np.ndarray, orders: range) -> dict[int, Level]:
    seen = counts > 0
    keys, counts = keys[seen], counts[seen]
    return {k: Level(keys & mask(k + 1), counts) for k in orders}


def log_probabilities(keys: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """log10 of the probability of the last byte of each key after the bytes before it."""
    out = np.zeros(len(keys))
    still = np.arange(len(keys))
    for order in range(ORDER, -1, -1):
        here = levels[order]
        own = keys[still] & mask(order + 1)
        at, there = here.find(here.contexts, own >> U64(8))
        total, kinds = (np.where(there, x[at], 0) if len(x) else np.zeros(len(own), np.int64) for x in (here.total, here.distinct))
        if order < ORDER:
            above = levels[order + 1]
            gone = here.count_of(above.keys & mask(order + 1))
            gone = np.add.reduceat(gone, above.first) if len(above.first) else gone
            up, there = above.find(above.contexts, (keys[still] >> U64(8)) & mask(order + 1))
            if len(above.contexts):
                total = total - np.where(there, gone[up], 0)
                kinds = kinds - np.where(there, above.distinct[up], 0)
        count = here.count_of(own)
        hit = count > 0
        usable = (total > 0) & (kinds > 0)
        p = np.where(hit, count - 0.5, 0.5 * kinds) / np.maximum(total, 1)
        out[still] += np.where(usable, np.log10(np.where(usable, p, 1.0)), 0.0)
        still = still[~hit]
    out[still] -= np.log10(max(1, 256 - len(levels[0].keys)))
    return out


def is_held_out(doc_id, modulus: int = 7, rest: int = 2) -> bool:
    return doc_id is None or zlib.crc32(str(int(doc_id)).encode()) % modulus == rest


def chunks(docs: DataFrame, n_buckets: int, chunk_bytes: int) -> DataFrame:
    """A row with the texts of each chunk (kind 0), its counts of short contexts (kind 1), and its
    requests for six-byte strings (kind 2) and words (kind 3)."""
    names = [x.split()[0] for x in PADDED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, ordinal = TaskContext.get().partitionId(), 0
        held: list[tuple[bool, int | None, bytes]] = []
        size = 0

        def close() -> Iterator[pd.DataFrame]:
            chunk = (pid << 24) + ordinal
            held.sort(key=lambda x: x[0])  # training documents come first
            texts = [x[2] for x in held]
            n_train = sum(not x[0] for x in held)
            ids = np.array([0 if x[1] is None else x[1] for x in held], np.int64)
            flags = np.array([x[0] + 2 * (x[1] is None) for x in held], np.int64)
            yield pd.DataFrame([(chunk, 0, len(held), pack(np.concatenate((ids, flags))), zstd(END.join(texts)), 0)], columns=names)
            both = grams(texts)
            learned = (both & U64(0xFFFF)) < U64(n_train)
            both >>= U64(16)
            first = first_of_runs(both)
            counts = np.add.reduceat(learned, first, dtype=np.int64)
            keys = both[first]
            del both, learned
            yield pd.DataFrame([(*r, 2) for r in requests(chunk, keys, counts, n_buckets, by_context)], columns=names)
            short = Level(keys[counts > 0] & mask(SHORT + 1), counts[counts > 0])
            yield pd.DataFrame([(chunk, 0, len(short.keys), pack_sorted(short.keys), pack(short.counts), 1)], columns=names)
            words, bounds = word_keys(texts)
            learned = np.arange(len(words)) < bounds[n_train]
            order = np.argsort(words, kind="stable")
            words = words[order]
            first = first_of_runs(words)
            if len(first):
                counts = np.add.reduceat(learned[order].astype(np.int64), first)
                yield pd.DataFrame([(*r, 3) for r in requests(chunk, words[first], counts, n_buckets)], columns=names)

        for pdf in batches:
            for doc, text in zip(identified(pdf), pdf["text"].tolist()):
                norm = normalise(text)
                held.append((is_held_out(doc), doc, norm))
                size += len(norm)
                if size >= chunk_bytes or len(held) == MAX_DOCS:
                    yield from close()
                    ordinal, held, size = ordinal + 1, [], 0
        if held:
            yield from close()

    return with_ids(docs).mapInPandas(run, PADDED)


def zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.compress(data, 5)


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts, bounds = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    for i, j in blocks(np.fromiter(map(len, texts), np.int64, len(texts)), 1 << 18):
        words, own = words_of(texts[i:j])
        parts.append(words)
        bounds.append(bounds[-1][-1] + own[1:])
    return np.concatenate(parts), np.concatenate(bounds)


def score(docs: DataFrame, chunk_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of doc_id modulo 7 is 2 are not learned from.
    """
    n_buckets = bucket_count(text_bytes(docs))
    table = keep(chunks(docs, n_buckets, chunk_bytes), "chunks", partition_by="kind")
    spark = docs.sparkSession

    def sum_short(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of a partition, so that what is shuffled next is bounded by the partitions."""
        keys, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        for pdf in pdfs:
            for k, v in zip(pdf["keys"], pdf["vals"]):
                both = Level(np.concatenate((keys, unpack_sorted(k))), np.concatenate((counts, unpack(v, np.int64))))
                keys, counts = both.keys, both.counts
        yield pd.DataFrame({"key": keys.astype(np.int64), "n": counts})

    short = table.filter("kind = 1").select("keys", "vals").mapInPandas(sum_short, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    shared = spark.sparkContext.broadcast((short["key"].to_numpy(np.int64).astype(U64), short["n"].to_numpy(np.int64)))

    def answer_grams(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpack_sorted(x) for x in pdf["keys"]])
        counts = np.concatenate([unpack(x, np.int64) for x in pdf["vals"]])
        distinct, which = np.unique(keys, return_inverse=True)
        total = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)
        levels = levels_of(distinct, total, range(SHORT + 1, ORDER + 1)) | levels_of(*shared.value, range(SHORT + 1))
        values = log_probabilities(distinct, levels)[which].astype(np.float32)
        parts = np.split(values, np.cumsum(pdf["n"].to_numpy())[:-1])
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "reply": [pack(x) for x in parts], "kind": 2, "words": 0, "distinct": 0})

    def answer_words(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpack_sorted(x) for x in pdf["keys"]])
        counts = np.concatenate([unpack(x, np.int64) for x in pdf["vals"]])
        distinct, which = np.unique(keys, return_inverse=True)
        total = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)
        parts = np.split(total[which], np.cumsum(pdf["n"].to_numpy())[:-1])
        out = pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "reply": [pack(x) for x in parts], "kind": 3, "words": 0, "distinct": 0})
        out.loc[out.index[0], ["words", "distinct"]] = int(total.sum()), int((total > 0).sum())
        return out

    reply = REPLY + ", kind int, words long, distinct long"
    asked = table.filter("kind >= 2").select("chunk", "bucket", "n", "keys", "vals", "kind")
    replies = keep(asked.groupBy("kind", "bucket").applyInPandas(lambda pdf: (answer_grams if pdf["kind"].iloc[0] == 2 else answer_words)(pdf), reply), "replies")
    for kind in (2, 3):
        drop_part(table, f"kind={kind}")
    ends = table.filter("kind = 0").select("keys").mapInPandas(count_trained, "n long").agg(F.sum("n")).first()[0] or 0
    sums = replies.agg(F.sum("words"), F.sum("distinct")).first()
    n_words, n_distinct = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)

    blank = F.lit(None).cast("binary")
    own = table.filter("kind = 0").select("chunk", F.lit(-1).alias("bucket"), "keys", "vals", blank.alias("reply"), "kind")
    back = replies.select("chunk", "bucket", blank.alias("keys"), blank.alias("vals"), "reply", "kind")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        mine = pdf[pdf["kind"] == 0].iloc[0]
        ids, flags = unpack(mine["keys"], np.int64).reshape(2, -1)
        texts = zstandard.decompress(mine["vals"]).split(END)
        n = len(texts)
        got = {k: {b: r for b, r in zip(x["bucket"], x["reply"])} for k, x in pdf.groupby("kind")}
        both = grams(texts)
        first = first_of_runs(both >> U64(16))
        values = aligned({b: unpack(r, np.float32) for b, r in got.get(2, {}).items()}, both[first] >> U64(16), n_buckets, by_context)
        model = np.zeros(n)
        for i in range(0, len(first), SLICE):
            begin, part = first[i], first[i : i + SLICE + 1]
            end = part[SLICE] if len(part) > SLICE else len(both)
            runs = np.diff(np.append(part[:SLICE], end))
            doc = (both[begin:end] & U64(0xFFFF)).astype(np.int64)
            model += np.bincount(doc, weights=np.repeat(values[i : i + SLICE], runs), minlength=n)
        del both
        words, bounds = word_keys(texts)
        number = np.repeat(np.arange(n), np.diff(bounds))
        order = np.argsort(words, kind="stable")
        first = first_of_runs(words[order])
        found = aligned({b: unpack(r, np.int64) for b, r in got.get(3, {}).items()}, words[order][first], n_buckets, by_hash, np.int64)
        count = np.zeros(len(words), np.int64)
        count[order] = np.repeat(found, np.diff(np.append(first, len(words))))
        scale = np.log10(n_words + n_distinct + 1)
        tokens = np.diff(bounds) + 1
        base = np.bincount(number, weights=np.log10(count + 1.0), minlength=n) + np.log10(ends + 1.0) - tokens * scale
        known = np.bincount(number, weights=count > 0, minlength=n).astype(np.int64) + (ends > 0)
        out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": (flags & 1) > 0, "n_tokens": tokens, "n_known": known})
        out.loc[(flags & 2) > 0, "doc_id"] = pd.NA
        return out.assign(train_tokens=n_words, base_score=base, score=model)

    return own.unionByName(back).groupBy("chunk").applyInPandas(finish, schema)


def count_trained(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        yield pd.DataFrame({"n": [int((unpack(x, np.int64).reshape(2, -1)[1] & 1 == 0).sum()) for x in pdf["keys"]]})
