"""Language identification by nearest centroids of character n-gram vectors.

A text is the bag of its letter n-grams of one to three characters (lower case, words padded by a space),
hashed into buckets, weighted by the log count times the inverse document frequency, at unit length. Document
frequencies are counted over all texts that may be learned from. Each language has several centroids, found by spherical
k-means on a bounded sample of its texts, one group of a grouped job per language, however many languages there are. The
language of the centroid with the largest cosine wins; a text whose best cosine is below what nearly all of
that centroid's own texts reach is marked as rejected, which changes no prediction.

Defined results: a null text and one without letters is `und` with score 0 and is rejected; null languages and
held-out documents teach nothing, nor do rows without an id; rows that repeat an id and language are one row of the sample, the smallest
text; with no usable row every text is `und`; ties go to the first language in order; a null id is never held out; a very long text
is added up in parts; rows are judged one by one, so repeats and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landroll.llm.common import held_out, saved
from landroll.llm.shingles import mix64

BUCKETS = 1 << 13
CENTROIDS = 4
SAMPLE = 500  # documents per language that the centroids are fitted on
STEPS = 8
REJECT_SHARE = 0.005  # share of a centroid's own texts that lie beyond its distance
BLOCK = 1 << 18  # characters hashed at once
LONG = 1 << 20  # a longer text is added up in parts


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    centres: np.ndarray
    owner: np.ndarray
    least: np.ndarray


def _grams(text: str) -> np.ndarray:
    """Bucket counts of the n-grams of one text part."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    return _bucket_counts(points, np.zeros(len(points), np.int64), 1)[0]


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _LETTER[0]


_LETTER: list[np.ndarray] = []


def _bucket_counts(points: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Counts (row, bucket) of n-grams in a run of texts; what is no letter counts as one space."""
    p = np.where(_letters()[points], points, 32).astype(np.uint64)
    counts = np.zeros(rows * BUCKETS, dtype=np.float32)
    salt = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    for n in (1, 2, 3):
        if len(p) < n:
            continue
        key = sum((p[k : len(p) - n + 1 + k] * salt[k] for k in range(n)), np.zeros(1, np.uint64))
        whole = (row[: len(p) - n + 1] == row[n - 1 :]) & (p[n // 2 : len(p) - n + 1 + n // 2] != 32)
        bucket = (mix64(key[whole] + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64)
        counts += np.bincount(row[: len(p) - n + 1][whole] * BUCKETS + bucket, minlength=len(counts)).astype(np.float32)
    return counts.reshape(rows, BUCKETS)


def _count_rows(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks (first row, counts (row, bucket)); null counts as empty. Long texts are summed over parts that overlap."""
    values = texts.to_pylist()
    row = 0
    while row < len(values):
        stop, size = row, 0
        while stop < len(values) and (stop == row or size + len(values[stop] or "") <= BLOCK) and stop - row < 400:
            size += len(values[stop] or "")
            stop += 1
        if size > LONG:
            text = (values[row] or "").lower()
            total = np.zeros((1, BUCKETS), dtype=np.float64)
            for at in range(0, len(text), LONG):
                total += _grams(text[max(0, at - 2) : at + LONG])
                if at:
                    total -= _grams(text[max(0, at - 2) : at])
            yield row, np.maximum(total, 0).astype(np.float32)
        else:
            parts = [np.frombuffer(((v or "") + " ").lower().encode("utf-32-le", "replace"), dtype=np.uint32) for v in values[row:stop]]
            yield row, _bucket_counts(np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), len(parts))
        row = stop


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


def _frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts with letters, and per bucket of those that hold it. A task sends one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = 0, np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, counts in _count_rows(batch.column(0)):
                total += int(counts.any(axis=1).sum())
                held += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.append(total, held))], names=["bucket", "n"])

    found = texts.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # buckets + 1 rows
    n = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in found:
        n[r["bucket"] + 1] = r["n"]
    return int(n[0]), n[1:]


def _language_centroids(idf: np.ndarray, centroids: int):
    """Spherical k-means on the sample of one language: a row per centroid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "text"])
        counts = np.concatenate([c for _, c in _count_rows(pa.array(pdf["text"], pa.string()))])
        own = _unit(np.log1p(counts[counts.any(axis=1)]) * idf)
        rows = []
        if len(own):
            centre = own[np.linspace(0, len(own) - 1, min(centroids, len(own))).astype(int)]
            for _ in range(STEPS):
                nearest = (own @ centre.T).argmax(axis=1)
                centre = _unit(np.array([own[nearest == c].mean(axis=0) if (nearest == c).any() else centre[c] for c in range(len(centre))]))
            best = own @ centre.T
            nearest = best.argmax(axis=1)
            for c in range(len(centre)):
                least = float(np.quantile(best[nearest == c, c], REJECT_SHARE)) if (nearest == c).any() else 0.0
                rows.append((pdf["l"].iloc[0], c, centre[c].astype(np.float32).tobytes(), least))
        return pd.DataFrame(rows, columns=["l", "place", "centre", "least"])

    return run


def fit_centroids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Centroids:
    """Fit on at most `sample` ids per language that aren't held out: those with the smallest id hashes.

    The driver holds the centroids, 32 KB each, and the document frequencies.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    usable = usable.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    total, held = _frequencies(usable.select("text"))
    idf = (np.log((1 + total) / (1 + held)) + 1).astype(np.float32)
    # the hash of the last id that belongs to a language's sample; ranks are cut on the map side
    keys = usable.where("i IS NOT NULL").select("l", "h").distinct()
    ranked = keys.withColumn("rank", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("rank") <= sample)
    last = saved(ranked.groupBy("l").agg(F.max("h").alias("last")), "last")
    chosen = usable.where("i IS NOT NULL").join(last, "l").where("h <= last").groupBy("l", "i").agg(F.min("text").alias("text"))
    table = chosen.groupBy("l").applyInPandas(_language_centroids(idf, centroids), "l string, place int, centre binary, least double")
    table = table.toArrow().sort_by([("l", "ascending"), ("place", "ascending")])
    names = sorted(set(table["l"].to_pylist()))
    number = {name: k for k, name in enumerate(names)}
    centres = np.frombuffer(b"".join(table["centre"].to_pylist()), dtype=np.float32).reshape(-1, BUCKETS)
    owner = np.array([number[x] for x in table["l"].to_pylist()], dtype=int)
    return Centroids(names, idf, centres, owner, np.array(table["least"].to_pylist(), dtype=float))


def identify_language(docs: DataFrame, model: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score (cosine to the nearest centroid), rejected. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, far = [], [], []
            for _, counts in _count_rows(batch.column(1)):
                if not model.languages:
                    names += ["und"] * len(counts)
                    scores += [0.0] * len(counts)
                    far += [True] * len(counts)
                    continue
                cosine = _unit(np.log1p(counts) * model.idf) @ model.centres.T
                best = cosine.argmax(axis=1)
                top = np.clip(cosine[np.arange(len(best)), best], 0, 1)
                some = counts.any(axis=1)
                names += [model.languages[model.owner[b]] if s else "und" for b, s in zip(best, some, strict=True)]
                scores += np.where(some, top, 0).astype(float).tolist()
                far += (~some | (top < model.least[best])).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    judged = plain.mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")
    return judged.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")
