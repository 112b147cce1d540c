"""Centroid clustering, spelling variants and voted quality against brute force, with odd rows, ties and empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from landroll.llm import centroids, quality_rules, spelling

# ---- centroid clustering ---------------------------------------------------------------------------


def whole(x, scale):
    return math.floor(scale * x) if abs(x) < 2**53 else int(x) * scale


def cluster_by_hand(rows, k, rounds, dims, scale):
    """rows: (vec_id, vector). Returns rows (vec_id, cluster, distance), centroids."""
    kept = [(i, [whole(x, scale) for x in v], v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    now = [v for _, v, _ in order[:k]]
    for step in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(now)) for _, v, _ in kept]
        if step < rounds:
            for j in range(len(now)):
                mine = [v for (_, v, _), (_, c) in zip(kept, found, strict=True) if c == j]
                if mine:
                    now[j] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    return [(i, c, d) for (i, _, _), (d, c) in zip(kept, found, strict=True)], now


def clustered(spark, rows, dims, **more):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, cluster string, distance int")
    return centroids.cluster_vectors(df, dims=dims, **more)


@pytest.mark.parametrize("case", ["plain", "ties", "wide", "few"])
def test_clusters_equal_brute_force(spark, case):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.normal(size=5) * rng.choice([0.01, 1, 30])]) for i in range(300)]
    if case == "ties":
        rows = [(i, [float(x) for x in rng.integers(0, 2, 5)]) for i in range(200)]
        rows += rows[:40] + [(None, [1.0] * 5), (None, [0.0] * 5)]
    if case == "wide":
        rows += [(1000, [3e8, 0.0, 0.0, 0.0, 0.0]), (1001, [3e8, 1.0, 0.0, 0.0, 2.0]), (1002, [-0.001] * 5)]
    if case == "few":
        rows = rows[:4] + [(None, [2.0] * 5)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 4), (2003, [1.0] * 6), (2004, [None] * 5), (2005, [float("nan")] * 5), (2006, [float("inf")] * 5)]
    out = clustered(spark, rows, 5, k=7).collect()
    wanted, last = cluster_by_hand(rows, 7, 3, 5, 64)
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in out) == Counter(wanted)
    sums = Counter()
    for _, c, d in wanted:
        sums[c] += d
    for r in out:
        assert r["cluster_inertia"] == sums[r["cluster"]] and r["inertia"] == sum(sums.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, last[r["cluster"]])).encode()).hexdigest()


def test_clusters_of_nothing(spark):
    assert clustered(spark, [(1, None), (2, [1.0])], 5).count() == clustered(spark, [], 5).count() == 0


def test_search_passes_over_centroids_without_changing_the_result():
    rng = np.random.default_rng(5)
    table = rng.integers(-40, 40, (64, 16))
    table[7] = table[3]
    vectors = rng.integers(-60, 60, (500, 16))
    number, distance = centroids.Centroids(table.tolist()).nearest(vectors.astype(np.int64))
    every = ((vectors[:, None, :] - table[None]) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()


# ---- spelling variants -----------------------------------------------------------------------------


def words_by_hand(docs):
    seen = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(docs):
    n = words_by_hand(docs)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


@pytest.mark.parametrize("chunk_pairs", [1, 5, spelling.CHUNK_PAIRS])
def test_variants_equal_brute_force(spark, chunk_pairs):
    rng = np.random.default_rng(3)
    stems = ["separate", "definité", "government", "necessàire", "aaaaaaaaa", "abababab", "ß×÷ÿÀllong"]
    docs = []
    for i in range(60):
        words = []
        for _ in range(40):
            w = stems[int(rng.integers(0, len(stems)))]
            if rng.random() < 0.25:
                k = int(rng.integers(0, len(w)))
                w = [w[:k] + w[k + 1 :], w[:k] + "e" + w[k:], w[:k] + "xzé"[int(rng.integers(0, 3))] + w[k + 1 :]][int(rng.integers(0, 3))]
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        docs.append((i, " ".join(words) + ". tiny words12here, don't"))
    docs += [(3, docs[3][1]), (None, docs[4][1]), (100, None), (101, ""), (102, "y" * 5000 + " " + "y" * 5000 + " " + "y" * 4999 + "z " + "y" * 4999 + "z"), (103, " \n\t")]
    docs += [(200 + i, " ".join(["chained"] * 200 + ["chaimed"] * (9 if i < 9 else 0) + ["chaimmd"] * (2 if i < 2 else 0))) for i in range(10)]
    table = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id bigint, text string, word string, n int, form int")
    out = spelling.spelling_variants(table, chunk_pairs=chunk_pairs).collect()
    wanted = variants_by_hand(docs)
    assert len(out) == len(wanted) and {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in out} == wanted
    assert any(r["form"] and r["root"] != r["form"] for r in out)


def test_common_chunks_are_halved_instead_of_compared(spark):
    """1,500 words with a common beginning: far fewer pairs meet than there are."""
    words = spark.range(1500).selectExpr("concat('commonbeginning', lpad(conv(id * 7919, 10, 26), 8, '0')) AS word", "2L AS n")
    met = []
    verified = spelling._verified

    def watched(rows):
        one, other = rows.where("chunks"), rows.where("NOT chunks").withColumnRenamed("word", "y")
        met.append(one.join(other, "key").count())
        return verified(rows)

    spelling._verified = watched
    try:
        found = spelling.near_pairs(words, chunk_pairs=64).count()
    finally:
        spelling._verified = verified
    text = sorted(r["word"] for r in words.collect())
    assert found == sum(one_edit(a, b) for i, a in enumerate(text) for b in text[i + 1 :] if a[:15] == b[:15])
    assert len(met) > 1 and sum(met) < 1500 * 1500 / 20


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


# ---- quality by votes ------------------------------------------------------------------------------


def counts_by_hand(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def odd_texts():
    prose = "the quiet river ran along the old road, and nobody saw it turn that year. so it went on; the end came late. "
    long_text = " ".join(f"word{i % 977}x{i // 977}" for i in range(60_000))
    return [
        (1, prose * 2), (2, prose * 2), (2, prose * 2), (3, None), (4, ""), (5, " \t\r\n\x0b\x0c "), (6, "a b c a b c a b c"), (7, "one\n\none\n one\none"),
        (8, "# | & <b> $5 %%"), (9, long_text), (10, (prose + "\n") * 3000), (None, "no id " * 30), (11, "été \U0001f600\U0001f600 naïve x"), (12, "a a a a"), (13, "x\ny\nx"),
        (14, "A" * 200_000),
    ]


def test_counts_equal_brute_force(spark):
    rows = odd_texts()
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id bigint, text string, votes string, n_words int")
    out = quality_rules.judge_quality(docs).collect()
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[c] for c in columns)) for r in out) == Counter((i, *counts_by_hand(t)) for i, t in rows)
    for r in out:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality_rules.judge_quality(docs.limit(0)).count() == 0
    kept = quality_rules.keep_quality(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in out if r["kept"])


def test_posteriors_equal_brute_force_and_labels(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = quality_rules.judge_quality(docs).collect()
    votes = [[int(v) for v in r["votes"].split(",")] for r in out]
    rules = len(quality_rules.RULES)
    good, bad, prior = [quality_rules.FIRST_GOOD] * rules, [quality_rules.FIRST_BAD] * rules, quality_rules.PRIOR

    def posterior(vote):
        logit = math.log(prior / (1 - prior))
        for i, v in enumerate(vote):
            gain = math.log(good[i][v + 1] / bad[i][v + 1])
            logit += min(gain, 0) if v < 0 else max(gain, 0) if v > 0 else gain
        return 1 / (1 + math.exp(-logit))

    for _ in range(quality_rules.MAX_ROUNDS):
        p = [posterior(v) for v in votes]
        sums = sum(p), len(p) - sum(p)
        good, bad = (
            [[(sum(w for w, v in zip(weights, votes, strict=True) if v[i] == k) + 1) / (total + 3) for k in (-1, 0, 1)] for i in range(rules)]
            for weights, total in ((p, sums[0]), ([1 - w for w in p], sums[1]))
        )
        prior = (sums[0] + 1) / (len(p) + 2)
    assert all(abs(r["good"] - posterior(v)) < 1e-2 for r, v in zip(out, votes, strict=True))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = [(labels[r["doc_id"]], r["kept"]) for r in out if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(k for q, k in judged if q == 1) >= 0.98 * sum(q == 1 for q, _ in judged)
    assert sum(not k for q, k in judged if q == 0) >= 0.95 * sum(q == 0 for q, _ in judged)


def test_votes_stay_in_the_jvm(spark, folder):
    plan = quality_rules.text_statistics(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
