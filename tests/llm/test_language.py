"""Language centroids: many languages, frequencies over all texts, and cosines worked out by hand."""

import math
from collections import Counter

import numpy as np

from landroll.llm import language

M = 2**64 - 1


def mixed(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def grams_by_hand(text):
    """Bucket counts: letters in lower case, everything else one space, grams of 1 to 3 whose middle is a letter."""
    p = [ord(c) if c.isalpha() else 32 for c in ((text or "") + " ").lower()]
    salt = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    found = Counter()
    for n in (1, 2, 3):
        for k in range(len(p) - n + 1):
            if p[k + n // 2] != 32:
                found[mixed((sum(p[k + j] * salt[j] for j in range(n)) + n) & M) % language.BUCKETS] += 1
    return found


def rows_of(seed, n):
    rng = np.random.default_rng(seed)
    syllables = {"a": ["ba", "ké", "lo"], "b": ["sch", "un", "ßt"], "c": ["tion", "the", "ing"]}
    rows = []
    for i in range(n):
        lang = "abc"[i % 3]
        words = ["".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(rng.integers(1, 30))]
        rows.append((i, " ".join(words) + (", 12!" if i % 5 == 0 else ""), lang if i % 7 else None))
    return rows


def test_scores_equal_cosines_by_hand(spark):
    rows = rows_of(1, 150) + [(900, None, "a"), (901, "1 2", "b"), (902, "", None)]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id bigint, text string, lang string, rejected string, score double")
    model = language.fit_centroids(docs, sample=20, centroids=2)
    import zlib

    learn = [grams_by_hand(t) for i, t, lang in rows if lang and t is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    learn = [g for g in learn if g]
    held = Counter(b for g in learn for b in g)
    idf = [math.log((1 + len(learn)) / (1 + held[b])) + 1 for b in range(language.BUCKETS)]
    assert np.allclose(model.idf, idf, rtol=1e-5) and model.languages == ["a", "b", "c"]
    assert (np.bincount(model.owner) == 2).all() and np.allclose(np.linalg.norm(model.centres, axis=1), 1, atol=1e-5)
    found = {r["doc_id"]: r for r in language.identify_language(docs, model).collect()}
    for i, text, _ in rows:
        grams = grams_by_hand(text)
        vector = {b: math.log1p(n) * idf[b] for b, n in grams.items()}
        norm = math.sqrt(sum(x * x for x in vector.values())) or 1
        scores = [sum(x * float(centre[b]) for b, x in vector.items()) / norm for centre in model.centres]
        best = max(range(len(scores)), key=lambda k: scores[k])
        if grams:
            assert abs(found[i]["score"] - min(1, scores[best])) < 1e-4
            assert found[i]["lang_pred"] == model.languages[model.owner[best]] or sorted(scores)[-1] - sorted(scores)[-2] < 1e-5
            assert found[i]["rejected"] == (scores[best] < model.least[best]) or abs(scores[best] - model.least[best]) < 1e-5
        else:
            assert (found[i]["lang_pred"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)


def test_centroids_are_means_of_their_texts(spark):
    rows = rows_of(2, 60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit_centroids(docs, sample=1000, centroids=1)
    import zlib

    for k, name in enumerate(model.languages):
        total = np.zeros(language.BUCKETS)
        for i, text, lang in rows:
            if lang == name and zlib.crc32(str(i).encode()) % 4 != 2:
                own = np.zeros(language.BUCKETS)
                for b, n in grams_by_hand(text).items():
                    own[b] = math.log1p(n) * model.idf[b]
                total += own / np.linalg.norm(own)
        assert np.allclose(model.centres[model.owner == k][0], total / np.linalg.norm(total), atol=1e-4)


def test_a_thousand_languages(spark):
    rows = []
    for k in range(1000):
        rng = np.random.default_rng(k)
        letters = [chr(0x4E00 + 3 * k + j) for j in range(3)]
        for j in range(4):
            rows.append((4 * k + j, "".join(rng.choice(letters, 12)), f"l{k:04d}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit_centroids(docs)
    taught = {lang for i, _, lang in rows if __import__("zlib").crc32(str(i).encode()) % 4 != 2}
    assert set(model.languages) == taught and len(taught) > 980
    judged = {r["doc_id"]: r["lang_pred"] for r in language.identify_language(docs, model).collect()}
    right = [judged[i] == lang for i, _, lang in rows if lang in taught]
    assert sum(right) > 0.95 * len(right)


def test_a_repeated_id_is_one_row_of_the_sample(spark):
    rows = [(1, "once upon a time", "en")] * 500 + [(k, f"il était une fois {k}", "fr") for k in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    seen = []
    inner = language._language_centroids

    def watched(idf, centroids):
        run = inner(idf, centroids)
        return lambda pdf: run(pdf).assign(least=float(len(pdf)))

    language._language_centroids = watched
    try:
        model = language.fit_centroids(docs, sample=10)
    finally:
        language._language_centroids = inner
    seen = dict(zip((model.languages[k] for k in model.owner), model.least, strict=True))
    assert seen == {"en": 1.0, "fr": 10.0}
