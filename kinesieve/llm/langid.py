"""Language identification by interpolated Kneser-Ney character models.

A model holds, for all languages together, the sorted 64-bit keys of its n-grams (order 4: three
characters of context and one more, 16 bits each) and beside each key a row with every language's
log2 probability, and the same for its contexts with the weights by which to back off. A text is
read as its letters in lower case with one space for everything between; its cross-entropy is the
mean over its characters. The lowest one wins, and the margin to the others gives the score.

A classifier may learn from a bounded sample: about `sample_docs` training documents of each
language, chosen by a hash of doc_id, whole texts. A fifth of them is kept from the counts to
calibrate the score's temperature and, per language, the cross-entropy beyond which a text is
rejected: above all of that part by a margin that widens for short texts.

Defined cases: a null text or one without letters is `und` with score 0, and rejected; so is every
text if there is nothing to learn from; an empty table gives no rows; other columns pass through,
those named like a result are replaced; rows without doc_id are predicted and never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinesieve.llm.kernels import U64, blocks, first_of_runs
from kinesieve.llm.storage import drop, keep, made

ORDER = 4
#: Languages up to which their table is broadcast.
SMALL_TABLE = 100_000
SPACE = 32
BLOCK = 1 << 18
RESULT = "lang_pred string, score double, cross_entropy double, rejected boolean"
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Lower-case code of each letter of 16 bits, and a space for all else."""
    if not _letters:
        out = np.full(1 << 16, SPACE, np.uint64)
        for c in range(1 << 16):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
        _letters.append(out)
    return _letters[0]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts, one text after another; the text of each; and whether it has a letter.

    Letters beyond 16 bits keep their low 16. Runs of other characters are one space; each text
    begins with one and ends with one.
    """
    joined = "\n".join(["", *texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts)), lengths + 1)
    text = np.concatenate(([0], text)) if len(texts) else text
    out = letter_table()[np.minimum(codes, 0xFFFF)]
    wide = np.flatnonzero(codes > 0xFFFF)
    for i in wide.tolist():
        out[i] = U64(int(codes[i]) & 0xFFFF or 1) if chr(int(codes[i])).isalpha() else U64(SPACE)
    keep = out != SPACE
    some = np.bincount(text[keep], minlength=len(texts)) > 0
    keep[1:] |= out[:-1] != SPACE  # the first space after a letter
    out, text = out[keep], text[keep]
    return out, text, some


def keys_of(codes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each character; what precedes a text counts as spaces."""
    n = len(codes)
    key = codes.copy()
    for k in range(1, ORDER):
        before = np.full(n, SPACE, np.uint64)
        before[k:] = np.where(text[k:] == text[:-k], codes[:-k], U64(SPACE))
        key |= before << U64(16 * k)
    return key


def low(keys: np.ndarray, order: int) -> np.ndarray:
    return keys & U64((1 << (16 * order)) - 1) if order < 4 else keys


def group_sum(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = first_of_runs(keys)
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values[:0]


def find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class KneserNey:
    """One language: discounted counts, and continuation counts at the lower orders."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: int):
        self.levels = {}
        self.floor = 1.0 / (alphabet + 1)
        for order in range(ORDER, 0, -1):
            keys, n = grams, counts
            contexts, total = group_sum(keys >> U64(16), n)
            _, kinds = group_sum(keys >> U64(16), np.ones(len(keys), np.int64))
            once, twice = int((n == 1).sum()), int((n == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            self.levels[order] = (keys, n, contexts, total, kinds, discount)
            if order > 1:
                grams, counts = group_sum(low(grams, order - 1), np.ones(len(grams), np.int64))

    def backoff(self, contexts: np.ndarray, order: int) -> np.ndarray:
        """Weight of the lower order after each context (1 where it was never seen)."""
        _, _, table, total, kinds, discount = self.levels[order]
        at, there = find(table, contexts)
        return np.where(there, discount * kinds[at] / total[at], 1.0) if len(table) else np.ones(len(contexts))

    def probability(self, keys: np.ndarray, order: int) -> np.ndarray:
        if not order:
            return np.full(len(keys), self.floor)
        own = low(keys, order)
        table, n, contexts, total, _, discount = self.levels[order]
        at, there = find(table, own)
        c, seen = find(contexts, own >> U64(16))
        lower = self.probability(keys, order - 1)
        if not len(table):
            return lower
        return np.where(there & seen, np.maximum(n[at] - discount, 0) / total[c], 0) + self.backoff(own >> U64(16), order) * lower


@dataclass
class LanguageModel:
    """What a prediction needs; its size is bounded by the sample, so it can be broadcast."""

    languages: list[str]
    keys: dict[int, np.ndarray]
    values: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    weights: dict[int, np.ndarray]
    floor: np.ndarray
    temperature: float = 1.0
    typical: np.ndarray | None = None
    spread: np.ndarray | None = None

    @classmethod
    def build(cls, counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> "LanguageModel":
        languages = sorted(counted)
        alphabet = len(np.unique(np.concatenate([low(k, 1) for k, _ in counted.values()])))
        models = [KneserNey(*counted[x], alphabet) for x in languages]
        keys, values, contexts, weights = {}, {}, {}, {}
        for order in range(1, ORDER + 1):
            keys[order] = np.unique(np.concatenate([m.levels[order][0] for m in models]))
            values[order] = np.stack([np.log2(m.probability(keys[order], order)) for m in models], 1).astype(np.float32)
            contexts[order] = np.unique(np.concatenate([m.levels[order][2] for m in models]))
            weights[order] = np.stack([np.log2(m.backoff(contexts[order], order)) for m in models], 1).astype(np.float32)
        floor = np.log2([m.floor for m in models]).astype(np.float32)
        return cls(languages, keys, values, contexts, weights, floor)

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), len(self.languages)), np.float32)
        rest = np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            own = low(keys[rest], order)
            at, there = find(self.keys[order], own)
            out[rest[there]] += self.values[order][at[there]]
            rest, own = rest[~there], own[~there]
            if not len(rest):
                return out
            at, there = find(self.contexts[order], own >> U64(16))
            out[rest[there]] += self.weights[order][at[there]]
        out[rest] += self.floor
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text in each language, and the characters of each text."""
        bits = np.zeros((len(texts), len(self.languages)))
        n = np.zeros(len(texts), np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        for i, j in blocks(sizes, BLOCK):
            codes, text, some = characters(texts[i:j])
            if not len(codes):
                continue
            # a long text comes in stretches, each with the characters before it
            keys = keys_of(codes, text)
            for a in range(0, len(keys), BLOCK):
                p = self.log_probabilities(keys[a : a + BLOCK])
                for x in range(p.shape[1]):
                    bits[i:j, x] -= np.bincount(text[a : a + BLOCK], weights=p[:, x], minlength=j - i)
            n[i:j] = np.where(some, np.bincount(text, minlength=j - i), 0)
        return bits / np.maximum(n, 1)[:, None], n

    def scores(self, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A distribution over the languages: evidence grows with the square root of the length."""
        evidence = -entropy * np.sqrt(n)[:, None] / self.temperature
        evidence -= evidence.max(1, keepdims=True)
        p = np.exp(evidence)
        return p / p.sum(1, keepdims=True)

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        entropy, n = self.entropies(texts)
        use = n > 0
        entropy, n = entropy[use], n[use]
        truth = np.array([self.languages.index(x) for x in langs], int)[use]
        losses = []
        grid = 2.0 ** np.arange(-3, 6)
        for t in grid:
            self.temperature = t
            p = self.scores(entropy, n)[np.arange(len(truth)), truth] if len(truth) else np.ones(1)
            losses.append(-np.log(np.maximum(p, 1e-12)).mean())
        self.temperature = float(grid[int(np.argmin(losses))])
        own = entropy[np.arange(len(truth)), truth]
        k = len(self.languages)
        self.typical = np.array([np.median(own[truth == x]) if (truth == x).any() else 8.0 for x in range(k)])
        excess = (own - self.typical[truth]) * np.sqrt(n)
        self.spread = np.array([max(1.0, excess[truth == x].max()) if (truth == x).any() else 64.0 for x in range(k)])

    def predict(self, texts: list[str]) -> pd.DataFrame:
        entropy, n = self.entropies(texts)
        best = entropy.argmin(1)
        row = np.arange(len(texts))
        score = self.scores(entropy, n)[row, best]
        least = entropy[row, best]
        limit = self.typical[best] + 1.5 + 2 * self.spread[best] / np.sqrt(np.maximum(n, 1))
        lang = np.array(self.languages, object)[best]
        none = n == 0
        lang[none], score[none] = "und", 0.0
        return pd.DataFrame({"lang_pred": lang, "score": np.clip(score, 0, 1), "cross_entropy": np.where(none, np.nan, least), "rejected": none | (least > limit)})


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def training_sample(docs: DataFrame, sample_docs: int, modulus: int = 4, rest: int = 2) -> DataFrame:
    """(lang, text, calibration): about sample_docs documents of each language, by the hash of doc_id,
    of which a fifth is for calibration unless it is all that the language has."""
    able = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), modulus) != rest))
    able = able.select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"))
    shares = able.groupBy("lang").agg(F.count("*").alias("n"), F.bool_or(F.pmod(F.col("h"), F.lit(5)) != 0).alias("others")).withColumn("limit", (F.lit(1 << 30) * F.lit(float(sample_docs)) / F.col("n")).cast("long"))
    shares = keep(shares.select("lang", "limit", "others"), "languages")
    if shares.count() <= SMALL_TABLE:
        shares = F.broadcast(shares)  # or else every text would be shuffled; the rows are the same
    few = able.join(shares, "lang").filter("h < limit")
    return few.select("lang", "text", (F.col("others") & (F.pmod(F.col("h"), F.lit(5)) == 0)).alias("calibration"))


def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, part in pdf.groupby("lang"):
            texts = part["text"].tolist()
            for i, j in blocks(np.fromiter(map(len, texts), np.int64, len(texts)), BLOCK):
                codes, text, _ = characters(texts[i:j])
                keys, counts = np.unique(keys_of(codes, text), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "n": counts})


def learn(docs: DataFrame, sample_docs: int = 400) -> LanguageModel | None:
    """A model of the languages in docs(doc_id, text, lang), or None if there is nothing to learn."""
    with made() as tables:
        model = fitted(training_sample(docs, sample_docs))
    drop(docs.sparkSession, *tables)
    return model


def fitted(sample: DataFrame) -> LanguageModel | None:
    counts = sample.filter("NOT calibration").select("lang", "text").mapInPandas(count_grams, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if not len(counts):
        return None
    counted = {}
    for lang, part in counts.groupby("lang"):
        keys = part["gram"].to_numpy(np.int64).view(U64)
        order = np.argsort(keys)
        counted[lang] = (keys[order], part["n"].to_numpy(np.int64)[order])
    model = LanguageModel.build(counted)
    check = sample.filter("calibration").filter(F.col("lang").isin(model.languages)).select("lang", "text").toPandas()
    model.calibrate(check["text"].tolist(), check["lang"].tolist())
    return model


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """All columns of docs, with lang_pred, score, cross_entropy and rejected."""
    if model is None:
        nothing = {"lang_pred": F.lit("und"), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"), "rejected": F.lit(True)}
        return docs.withColumns(nothing)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield shared.value.predict(["" if x is None else x for x in part])

    out = docs.withColumn("__lang", predict(F.col("text")))
    return out.withColumns({x.split()[0]: F.col(f"__lang.{x.split()[0]}") for x in RESULT.split(", ")}).drop("__lang")
