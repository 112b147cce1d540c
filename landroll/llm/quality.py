"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: the log counts of its hashed words at unit length, statistics of its
characters, words and lines, and optional numeric columns. Its logit is
    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),
the sum-of-squares form of all pairwise interactions, so a score costs time linear in the text.

Defined results: null and empty texts have a zero word vector and are scored like any other; null labels
and labels of unknown documents teach nothing; of several labels of a document the largest counts; with no
usable label every score is 0.5, with one class only it is near that class; a null id is never held out;
rows are scored one by one, so repeats and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landroll.llm.common import held_out, text_slices
from landroll.llm.shingles import word_hashes

BUCKETS = 1 << 15
FACTORS = 8
SAMPLE = 2_000  # labelled documents per class that the model is fitted on
EPOCHS = 8
LEAST_STEPS = 400  # small samples are passed more often
BATCH = 128
THRESHOLD = 0.7
STATISTICS = 15

_BYTE = np.arange(256)
_CLASSES = {
    "symbol": np.isin(_BYTE, [ord(c) for c in "#$%&*@^~|<>{}[]\\/=+_"]),
    "mark": np.isin(_BYTE, [ord(c) for c in ".,;:!?'\"()-"]),
    "digit": (_BYTE >= 48) & (_BYTE <= 57),
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "high": _BYTE >= 128,
    "line": _BYTE == 10,
    "bar": _BYTE == ord("|"),
    "stop": np.isin(_BYTE, [ord(c) for c in ".!?"]),
}


@dataclass
class Model:
    """Weights of the machine; word buckets come first, then statistics and metadata."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    meta: int

    def score(self, rows: np.ndarray, index: np.ndarray, value: np.ndarray, count: int) -> np.ndarray:
        """Probability of label 1 for count rows given as (row, index, value) entries sorted by row."""
        linear = np.bincount(rows, self.weights[index] * value, count)
        parts = self.factors[index] * value[:, None]
        sums = np.zeros((count, self.factors.shape[1]))
        squares = np.zeros(count)
        if len(rows):
            at = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            sums[rows[at]] = np.add.reduceat(parts, at, axis=0)
            squares[rows[at]] = np.add.reduceat((parts * parts).sum(axis=1), at)
        logit = self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _vectors(texts: pa.Array, meta: Sequence[pa.Array]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (first row, rows, row of entry, index, value) of the documents' sparse vectors, sorted by row."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.zeros(0, np.uint8)
    columns = [np.nan_to_num(np.asarray(pa.array(c).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)), posinf=0, neginf=0) for c in meta]
    for first, words, bounds in word_hashes(texts):
        count = len(bounds) - 1
        per_row = np.diff(bounds)
        row = np.repeat(np.arange(count, dtype=np.int64), per_row)
        key, times = np.unique(row * BUCKETS + (words >> np.uint64(49)).astype(np.int64), return_counts=True)
        rows, index, value = key // BUCKETS, key % BUCKETS, np.log1p(times)
        value = value / np.sqrt(np.maximum(np.bincount(rows, value * value, count), 1e-12))[rows]
        at = offsets[first : first + count + 1]
        part = data[at[0] : at[-1]]
        size = np.maximum(np.diff(at), 1)
        shares = []
        for chosen in _CLASSES.values():
            total = np.concatenate([[0], np.cumsum(chosen[part])])[at - at[0]]
            shares.append(np.diff(total))
        names = dict(zip(_CLASSES, shares, strict=True))
        n_words = np.maximum(per_row, 1)
        distinct = np.bincount(rows, minlength=count)
        again = np.append(False, words[1:] == words[:-1]) if len(words) else np.zeros(0, bool)
        dense = [
            *(np.sqrt(names[k] / size) for k in ("symbol", "mark", "digit", "upper", "high")),
            np.minimum(names["symbol"] / n_words, 2), np.minimum(names["bar"] / n_words, 1), np.minimum(names["stop"] / n_words, 1),
            np.minimum(names["line"] / n_words, 1), np.minimum(names["mark"] / n_words, 2), distinct / n_words,
            np.minimum(size / n_words, 40) / 10, np.bincount(row, again, count) / n_words, np.log1p(per_row) / 8, (per_row == 0).astype(float),
        ]
        dense += [np.sign(c[first : first + count]) * np.log1p(np.abs(c[first : first + count])) / 8 for c in columns]
        wide = np.column_stack(dense)
        r, c = np.nonzero(wide)
        rows, index, value = np.concatenate([rows, r]), np.concatenate([index, BUCKETS + c]), np.concatenate([value, wide[r, c]])
        order = np.lexsort((index, rows))
        yield first, count, rows[order], index[order], value[order]


def _fit(starts: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray, weight: np.ndarray, meta: int) -> Model:
    """Adaptive gradient descent on the weighted log loss; the order of the rows is fixed by a seed."""
    size = BUCKETS + STATISTICS + meta
    rng = np.random.default_rng(7)
    w, v, bias = np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), 0.0
    gw, gv, gb = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    n, rate, decay = len(y), 0.08, 1e-5
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // n))):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            chosen = order[k : k + BATCH]
            spans = [np.arange(starts[i], starts[i + 1]) for i in chosen]
            rows = np.repeat(np.arange(len(chosen)), [len(s) for s in spans])
            at = np.concatenate(spans)
            i, x = index[at], value[at]
            parts = v[i] * x[:, None]
            begins = np.concatenate([[0], np.cumsum([len(s) for s in spans])[:-1]])  # no row is empty, see the last statistics
            sums = np.add.reduceat(parts, begins, axis=0)
            squares = np.bincount(rows, (parts * parts).sum(axis=1), len(chosen))
            logit = bias + np.bincount(rows, w[i] * x, len(chosen)) + 0.5 * ((sums * sums).sum(axis=1) - squares)
            slope = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[chosen]) * weight[chosen] / len(chosen)
            unique, place = np.unique(i, return_inverse=True)
            dw = np.bincount(place, slope[rows] * x) + decay * w[unique]
            each = (slope[rows] * x)[:, None] * (sums[rows] - parts)
            dv = np.column_stack([np.bincount(place, each[:, f]) for f in range(FACTORS)]) + decay * v[unique]
            gw[unique] += dw * dw
            gv[unique] += dv * dv
            w[unique] -= rate * dw / np.sqrt(gw[unique])
            v[unique] -= rate * dv / np.sqrt(gv[unique])
            db = slope.sum()
            gb += db * db
            bias -= rate * db / np.sqrt(gb)
    return Model(float(bias), w.astype(np.float32), v.astype(np.float32), meta)


def _sample_vectors(meta: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, count, rows, index, value in _vectors(batch.column(2), [batch.column(3 + k) for k in range(meta)]):
                ends = np.searchsorted(rows, np.arange(count + 1))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (index.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, count), batch.column(1).slice(first, count), *lists], names=["doc_id", "y", "i", "x"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: Sequence[str] = (), sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents per class that aren't held out, the ones with the smallest id hashes."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    sizes = dict(known.groupBy("y").count().collect())
    meta = len(meta_cols)
    if not sizes:
        return Model(0.0, np.zeros(BUCKETS + STATISTICS + meta, np.float32), np.zeros((BUCKETS + STATISTICS + meta, FACTORS), np.float32), meta)
    parts = [known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in sorted(sizes)]
    chosen = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).cast("double").alias(f"m{k}") for k, c in enumerate(meta_cols)))
    rows = plain.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text", *(f"m{k}" for k in range(meta)))  # 2 * sample rows
    vectors = rows.mapInArrow(_sample_vectors(meta), "doc_id bigint, y int, i array<int>, x array<float>").toArrow().combine_chunks()
    vectors = vectors.sort_by("doc_id")
    y = vectors["y"].to_numpy().astype(float)
    if not len(y):
        return Model(0.0, np.zeros(BUCKETS + STATISTICS + meta, np.float32), np.zeros((BUCKETS + STATISTICS + meta, FACTORS), np.float32), meta)
    index, value = (vectors[c].combine_chunks() for c in ("i", "x"))
    starts = np.concatenate([[0], np.cumsum(index.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    share = {k: n / sum(sizes.values()) for k, n in sizes.items()}
    weight = np.array([share[k] for k in y]) / np.array([max((y == k).mean(), 1e-9) for k in y])
    return _fit(starts, index.flatten().to_numpy(), value.flatten().to_numpy().astype(np.float64), y, weight, meta)


def _scorer(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for first, count, rows, index, value in _vectors(batch.column(1), [batch.column(2 + k) for k in range(model.meta)]):
                scores[first : first + count] = model.score(rows, index, value, count)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", meta_cols: Sequence[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. One pass over the texts, no shuffle."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).cast("double") for c in meta_cols))
    scored = plain.mapInArrow(_scorer(model), "doc_id bigint, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: Model, text_col: str = "text", meta_cols: Sequence[str] = (), threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least the threshold, with all their columns."""
    names = docs.columns
    text_at, meta_at = names.index(text_col), [names.index(c) for c in meta_cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in text_slices(whole, text_at)):
            stays = np.zeros(batch.num_rows, dtype=bool)
            for first, count, rows, index, value in _vectors(batch.column(text_at), [batch.column(k) for k in meta_at]):
                stays[first : first + count] = model.score(rows, index, value, count) >= threshold
            yield batch.filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)
