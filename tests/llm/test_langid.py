import numpy as np
from pyspark.sql import functions as F

from kinesieve.llm import langid
from kinesieve.llm.queries import op4_language_id
from tests.conftest import SMALL


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    got = op4_language_id(spark, SMALL).join(docs, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(got) == docs.count() and (held["lang_pred"] == held["lang"]).mean() > 0.98
    assert not got["rejected"].any() and got["score"].between(0, 1).all()


def test_probabilities_sum_to_one():
    codes, text, _ = langid.characters(["abcab acb", "bca b"])
    keys, counts = np.unique(langid.keys_of(codes, text), return_counts=True)
    alphabet = np.unique(langid.low(keys, 1))
    model = langid.KneserNey(keys, counts, len(alphabet))
    for context in np.unique(keys >> np.uint64(16)):
        every = (context << np.uint64(16)) | alphabet
        total = model.probability(every, 4).sum() + sum(0 for _ in ())
        missing = model.floor * model.backoff(every[:1] >> np.uint64(16), 4)[0]
        assert 1 - missing - 1e-9 <= total <= 1 + 1e-9


def test_tables_give_the_models_probabilities():
    texts = {"x": ["abc abd", "ab"], "y": ["bbc cab", "bcb"]}
    counted = {}
    for lang, some in texts.items():
        codes, text, _ = langid.characters(some)
        counted[lang] = np.unique(langid.keys_of(codes, text), return_counts=True)
    model = langid.LanguageModel.build(counted)
    codes, text, _ = langid.characters(["abcbdz caé", "zz"])
    keys = langid.keys_of(codes, text)
    got = model.log_probabilities(keys)
    alphabet = len(np.unique(np.concatenate([langid.low(k, 1) for k, _ in counted.values()])))
    for i, lang in enumerate(model.languages):
        assert np.allclose(got[:, i], np.log2(langid.KneserNey(*counted[lang], alphabet).probability(keys, 4)), atol=1e-4)


def test_odd_texts(spark):
    train = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, None, "en"), (101, "", None), (102, "123 !! \n", "de"), (103, "𐐨𐐩 漢字", None), (None, "the dog and the cat", "en"), (105, "der hund " * 3000, None), (105, "the cat", None)]
    df = spark.createDataFrame(train + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("own"))
    model = langid.learn(df)
    got = {(r.doc_id, r.text): r for r in langid.identify(df, model).collect()}
    assert [got[100, None].lang_pred, got[101, ""].lang_pred, got[102, "123 !! \n"].lang_pred] == ["und"] * 3
    assert got[None, "the dog and the cat"].lang_pred == "en" and got[105, "der hund " * 3000].lang_pred == "de"
    assert got[102, "123 !! \n"].rejected and not got[105, "the cat"].rejected
    empty = df.limit(0)
    assert langid.learn(empty) is None and langid.identify(empty, None).collect() == []
    assert {r.lang_pred for r in langid.identify(df, None).collect()} == {"und"}


def brute_probability(texts, alphabet, order=langid.ORDER):
    """Interpolated Kneser-Ney with dictionaries, straight from its recursion."""
    from collections import Counter, defaultdict

    grams = Counter()
    for t in texts:
        padded = " " * (order - 1) + t
        grams.update(padded[i : i + order] for i in range(len(t)))
    levels = {}
    for k in range(order, 0, -1):
        levels[k] = grams
        grams = Counter(g[1:] for g in grams)  # in how many contexts each shorter one was seen

    def discount(k):
        once, twice = (sum(1 for n in levels[k].values() if n == x) for x in (1, 2))
        return once / (once + 2 * twice) if once and twice else 0.5

    tables = {}
    for k, counts in levels.items():
        after = defaultdict(Counter)
        for g, n in counts.items():
            after[g[:-1]][g[-1]] += n
        tables[k] = after

    def probability(gram, k):
        if not k:
            return 1 / (alphabet + 1)
        seen = tables[k].get(gram[:-1])
        lower = probability(gram[1:], k - 1)
        if not seen:
            return lower
        total = sum(seen.values())
        return max(seen[gram[-1]] - discount(k), 0) / total + discount(k) * len(seen) / total * lower

    return lambda gram: probability(gram, order)


def test_entropy_against_brute_force():
    """Texts of lower-case words, which are read as they are, with one space before and after."""
    rng = np.random.default_rng(6)
    letters = {"one": list("abcde"), "two": list("cdefg")}
    make = lambda some, n: " ".join("".join(rng.choice(some, int(rng.integers(1, 7)))) for _ in range(n))
    texts = {k: [make(v, 40) for _ in range(5)] for k, v in letters.items()}
    counted = {}
    for k, some in texts.items():
        codes, text, _ = langid.characters(some)
        counted[k] = np.unique(langid.keys_of(codes, text), return_counts=True)
    model = langid.LanguageModel.build(counted)
    tries = [make(list("abcdefgh"), int(n)) for n in rng.integers(1, 60, 25)]
    entropy, n = model.entropies(tries)
    alphabet = len(set("".join(sum(texts.values(), []))) | {" "})
    read = lambda t: "".join(map(chr, langid.characters([t])[0].tolist()))
    assert all(read(t).strip() == t for t in tries)
    for x, language in enumerate(model.languages):
        p = brute_probability([read(t) for t in texts[language]], alphabet)
        for t, found, size in zip(tries, entropy[:, x], n):
            t = read(t)
            bits = [-np.log2(p((" " * 3 + t)[i : i + 4])) for i in range(len(t))]
            assert size == len(t) and abs(np.mean(bits) - found) < 1e-3


def test_languages_of_one_document_and_very_many_are_learned(spark):
    """Whatever fifth its only document falls into; own columns of any name are no hindrance."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"l{i}", (letters[i % 26] + letters[i // 26] + " ") * 40, 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, limit int")
    model = langid.learn(docs)
    held_out = {r.doc_id for r in docs.select("doc_id", langid.remainder(docs["doc_id"], 4).alias("r")).collect() if r.r == 2}
    assert sorted(model.languages) == sorted(f"l{i}" for i in range(400) if i not in held_out)
