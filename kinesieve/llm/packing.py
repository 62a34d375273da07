"""Best-fit packing of token pieces with certified bin counts.

Every document is cut into pieces of at most `capacity` tokens. Groups of pieces are packed by
best-fit decreasing, and a lower bound from dual feasible functions certifies each group's
number of sequences. Groups with a gap hand their underfull sequences, whole, to newly dealt
groups, which pack them again; a group keeps its old packing if the new one is not smaller, so
no round makes the result worse.

Defined cases: a null text is empty and gives the end token alone; rows without doc_id and rows
repeating one are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinesieve.llm.ids import identified, with_ids
from kinesieve.llm.storage import drop_table, keep

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
ASCII_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words in a worker's table of encoded words, beyond which it is emptied.
REMEMBERED = 1_500_000
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Encodes texts word by word through a table of words seen before.

    The tokenizer drops white space and never joins what stands on its two sides, so a text's ids
    are those of its words in order, and a word of letters and marks has the ids of both. Only words not seen before reach the tokenizer, many at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.limit = REMEMBERED

    def _blob(self, ids) -> bytes:
        return np.asarray(ids, "<u4").tobytes()

    def _learn_stems(self, stems: list[str]) -> None:
        """Each stem is letters only, so exactly one of its ids ends a word."""
        for i in range(0, len(stems), 1000):
            part = stems[i : i + 1000]
            ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(part):
                for x in part:
                    self.stems[x] = self._blob(self.tokenizer.encode(x, add_special_tokens=False).ids)
                continue
            raw, first = ids.tobytes(), 0
            for x, last in zip(part, (ends * 4).tolist()):
                self.stems[x] = raw[first:last]
                first = last

    def learn(self, words: set[str]) -> None:
        every = list(words)
        stems = [w.rstrip(ASCII_MARKS) for w in every]
        plain = [x.isalpha() for x in stems]
        self._learn_stems(list({x for x, p in zip(stems, plain) if p} - self.stems.keys()))
        known, ids = self.known, self.stems
        for w, stem, p in zip(every, stems, plain):
            if p:
                if len(w) == len(stem):
                    known[w] = ids[stem]
                    continue
                marks = w[len(stem) :]
                if marks not in self.marks:
                    self.marks[marks] = self._blob(self.tokenizer.encode(marks, add_special_tokens=False).ids)
                known[w] = ids[stem] + self.marks[marks]
        other = [w for w, p in zip(every, plain) if not p]
        for i in range(0, len(other), 1000):
            part = other[i : i + 1000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.known[w] = self._blob(e.ids)

    def forget(self, limit: int) -> None:
        """Empty the table if it has more than `limit` words."""
        if len(self.known) > limit:
            self.known.clear()
            self.stems.clear()
            self.marks.clear()

    def words(self, text: str) -> list[str]:
        """The words of a text. Texts in Latin-1 are lower-cased at once, which the tokenizer would do
        word by word; elsewhere combining marks could make a difference."""
        if any(c in text for c in SEPARATORS):
            return text.translate(SPACES).split(" ")
        if "<|" not in text:
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit values."""
        split = [self.words(x) for x in texts]
        look = self.known.get
        found = [list(map(look, words)) for words in split]
        missing = [i for i, x in enumerate(found) if None in x]
        if missing:
            self.forget(self.limit)
            self.learn({w for i in missing for w, x in zip(split[i], found[i]) if x is None or w not in self.known})
            for i in missing:
                found[i] = map(look, split[i])
        return [b"".join(x) for x in found]


#: ASCII separators that are white space to Python but not to the tokenizer; and the characters of
#: ASCII that are white space to both, as a table for translate() (fixed values).
SEPARATORS = "\x1c\x1d\x1e\x1f"
SPACES = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, block: int = 1 << 20, remembered: int = REMEMBERED) -> DataFrame:
    """Token pieces of every document: (doc_id, piece, start, length, ids_crc32). A worker's table of
    words, which it keeps from task to task, has `remembered` at most when a task ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        enc.limit = remembered
        tail = np.asarray([end_id], "<u4").tobytes()
        step = 4 * capacity
        for pdf in batches:
            texts, ids = ["" if x is None else x for x in pdf["text"]], identified(pdf)
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) <= block):
                    size += len(texts[last])
                    last += 1
                out = []
                for doc, blob in zip(ids[first:last], enc.encode(texts[first:last])):
                    blob += tail
                    for p, at in enumerate(range(0, len(blob), step)):
                        part = blob[at : at + step]
                        out.append((doc, p, at // 4, len(part) // 4, zlib.crc32(part)))
                rows = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield rows.assign(doc_id=pd.array([x[0] for x in out], "Int64"))
                first = last
        enc.forget(remembered)

    return with_ids(docs).mapInPandas(run, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Bin of each item, and the number of bins.

    Open bins are kept by their free space; the bits of `free` tell which spaces there are.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    open_bins: dict[int, list[int]] = {}
    free, count = 0, 0
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            held = open_bins[space]
            b = held.pop()
            if not held:
                free &= ~(1 << space)
        else:
            space, b = capacity, count
            count += 1
        bins[i] = b
        left = space - size
        if left:
            open_bins.setdefault(left, []).append(b)
            free |= 1 << left
    return bins, count


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound from three families of dual feasible functions.

    threshold(e): sizes over capacity - e count as full, sizes under e as nothing;
    rounding(k): a size x counts floor((k+1)x/capacity)/k unless (k+1)x is a multiple of the
    capacity, when it counts as itself; and rounding after threshold.
    """
    sizes = np.bincount(lengths, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    best = -(-int((sizes * x).sum()) // capacity)
    counts, totals = np.cumsum(sizes), np.cumsum(sizes * x)
    e = np.arange(1, capacity // 2 + 1)
    full = counts[capacity] - counts[capacity - e]
    middle = totals[capacity - e] - totals[e - 1]
    best = max(best, int((full + -(-middle // capacity)).max()) if len(e) else 0)
    thresholds = {0, *(e[np.argsort(-(full * capacity + middle), kind="stable")[:8]].tolist())}
    for k in range(1, 21):
        up = (k + 1) * x
        values = np.where(up % capacity == 0, x * k, up // capacity * capacity)  # times k * capacity
        for t in thresholds:
            kept = np.where(x > capacity - t, k * capacity, np.where(x < t, 0, values)) if t else values
            best = max(best, -(-int((sizes * kept).sum()) // (k * capacity)))
    return best


def pack(items: DataFrame, capacity: int = 2048, per_group: int = 20_000, rounds: int = 3) -> DataFrame:
    """Items (PIECES) with sequence_id and offset."""
    schema = "missing boolean, " + PACKED + ", grp long, bin long, gap int, fill long"
    own = ["missing", "doc_id", "piece", "start", "length", "ids_crc32"]
    # a number of its own for each row deals equal ones apart; without nulls, ids stay whole in pandas
    known = items.withColumn("missing", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))
    table = keep(known.withColumn("dealt", F.monotonically_increasing_id()), "pieces")
    n_groups = max(1, round(table.count() / per_group))

    def fresh(pdf: pd.DataFrame, stage: int, old: bool) -> pd.DataFrame:
        group = int(pdf["grp"].iloc[0])
        lengths = pdf["length"].to_numpy()
        bins, n = best_fit_decreasing(lengths, capacity)
        if old and n >= (before := pdf["bin"].nunique()):
            bins, n = pd.factorize(pdf["bin"])[0], before
        order = np.argsort(bins, kind="stable")
        sums = np.cumsum(lengths[order])
        firsts = np.concatenate(([0], sums))[np.searchsorted(bins[order], np.arange(n))]
        offset = np.empty(len(bins), np.int64)
        offset[order] = sums - lengths[order] - firsts[bins[order]]
        ids = (stage << 56) + (group << 24) + bins
        out = pdf[own].copy()
        out["sequence_id"], out["offset"], out["grp"], out["bin"] = ids, offset, group, ids
        out["gap"] = n - lower_bound(lengths, capacity)
        out["fill"] = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)[bins]
        return out

    def again(stage: int):
        return lambda pdf: fresh(pdf, stage, True)

    dealt = table.withColumn("grp", F.pmod(F.xxhash64("dealt"), F.lit(n_groups)))
    now = keep(dealt.groupBy("grp").applyInPandas(lambda pdf: fresh(pdf, 0, False), schema), "packed")
    drop_table(table)
    done = []
    for stage in range(1, rounds + 1):
        loose = (F.col("gap") > 0) & (F.col("fill") < capacity)
        left = now.filter(loose)
        n_left = left.count()
        done.append(now.filter(~loose))
        if not n_left:
            now = None
            break
        n_groups = max(1, round(n_left / per_group))
        dealt = left.withColumn("grp", F.pmod(F.xxhash64("bin", F.lit(stage)), F.lit(n_groups)))
        now = keep(dealt.groupBy("grp").applyInPandas(again(stage), schema), "packed")
    if now is not None:
        done.append(now)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    named = F.when(~F.col("missing"), F.col("doc_id")).alias("doc_id")
    return out.select(named, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, remembered: int = REMEMBERED) -> DataFrame:
    return pack(pieces(docs, tokenizer_path, capacity, remembered=remembered), capacity)
