"""Best-fit packing by length patterns and non-negative least squares.

Texts become token pieces of at most one sequence. The histogram of piece lengths (at most `capacity`
rows) is all that reaches the driver. There, patterns of a few length classes that fill a sequence are
enumerated, repeat counts are fitted to the histogram by non-negative least squares and rounded down to
what exists, and what is left over is placed by best fit, longest first, also into the room that patterns
leave. The plan is a list of (lengths, repeats) whose size depends on the capacity, not on the data; the
pieces take their places in it by their rank among the pieces of their length.

Defined results: a null or empty text is the one end token; a null id is carried along; equal rows are
packed as rows of their own, numbered apart; no documents give no pieces; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landroll.llm.common import saved, text_slices
from landroll.llm.tokens import word_tokens

CAPACITY = 2048
CLASSES = 64  # length classes that patterns are made of
PATTERN_PIECES = 4
ROUNDS = 400  # steps of the least-squares fit
SALTS = 32  # parts that the pieces of one length are ranked in
BATCH_CHARS = 2_000_000


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only beyond the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(tokenizer_path)
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            ends = np.cumsum([len(t) for t in texts]) // BATCH_CHARS
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
                if not len(part):
                    continue
                rows: list[tuple[int, int, int, int, int]] = []
                for row, tokens in zip(part.tolist(), encoder.encode([texts[i] for i in part]), strict=True):
                    tokens = np.append(tokens, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(tokens), capacity)):
                        own = tokens[start : start + capacity]
                        rows.append((row, piece, start, len(own), zlib.crc32(own.tobytes())))
                cells = np.array(rows, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(cells[:, 0])), pa.array(cells[:, 1], pa.int32()), *(pa.array(cells[:, k]) for k in (2, 3, 4))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def _patterns(classes: int, most: int) -> list[tuple[int, ...]]:
    """Non-increasing class tuples that fill a sequence exactly, classes counted in units of the capacity's share."""
    found: list[tuple[int, ...]] = []

    def extend(chosen: tuple[int, ...], left: int, top: int) -> None:
        if left == 0:
            found.append(chosen)
        elif len(chosen) < most:
            least = -(-left // (most - len(chosen)))
            for size in range(min(top, left), least - 1, -1):
                extend((*chosen, size), left - size, size)

    extend((), classes, classes)
    return found


def _fit(patterns: list[tuple[int, ...]], counts: np.ndarray) -> np.ndarray:
    """Repeats of each pattern whose pieces fit the class counts: projected gradient with momentum, never negative."""
    usable = [k for k, p in enumerate(patterns) if all(counts[c] > 0 for c in p)]
    repeats = np.zeros(len(patterns))
    if not usable:
        return repeats
    matrix = np.zeros((len(counts), len(usable)))
    for column, k in enumerate(usable):
        for c in patterns[k]:
            matrix[c, column] += 1
    weight = 1 / np.sqrt(np.maximum(counts, 1))
    a, b = matrix * weight[:, None], counts * weight
    step = 1 / np.linalg.norm(a, 2) ** 2
    x = y = np.zeros(len(usable))
    pace = 1.0
    for _ in range(ROUNDS):
        new = np.maximum(0, y - step * (a.T @ (a @ y - b)))
        following = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        x, y, pace = new, new + (pace - 1) / following * (new - x), following
    repeats[usable] = x
    return repeats


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES, pattern_pieces: int = PATTERN_PIECES) -> list[tuple[tuple[int, ...], int]]:
    """Sequence kinds (lengths, repeats) that hold every piece of the histogram exactly once."""
    left = {n: c for n, c in histogram.items() if c > 0}
    kinds: dict[tuple[int, ...], int] = defaultdict(int)
    if capacity in left:
        kinds[(capacity,)] += left.pop(capacity)
    unit = -(-capacity // classes)
    counts = np.zeros(classes + 1)
    by_class: dict[int, list[int]] = defaultdict(list)
    for n in sorted(left):
        counts[-(-n // unit)] += left[n]
        by_class[-(-n // unit)].append(n)
    patterns = _patterns(classes, pattern_pieces)
    repeats = np.floor(_fit(patterns, counts)).astype(int)
    for k in np.argsort(-repeats, kind="stable").tolist():
        wanted = int(repeats[k])
        while wanted > 0:
            chosen: list[int] = []
            room = capacity
            for c in patterns[k]:
                last = len(chosen) == len(patterns[k]) - 1  # takes what the others leave of the room
                own = (n for d in range(-(-room // unit) if last else c, c - 1, -1) for n in reversed(by_class[d]))
                fits = next((n for n in own if n <= room and left.get(n, 0) > chosen.count(n)), None)
                if fits is None:
                    break
                chosen.append(fits)
                room -= fits
            if len(chosen) < len(patterns[k]):
                break
            times = min(wanted, *(left[n] // chosen.count(n) for n in set(chosen)))
            if times == 0:
                break
            kinds[tuple(chosen)] += times
            wanted -= times
            for n in chosen:
                left[n] -= times
    return _best_fit(kinds, left, capacity)


def _best_fit(kinds: dict[tuple[int, ...], int], left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Place what the patterns left, longest first, each into the fullest sequences that have room."""
    rooms: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for lengths, times in kinds.items():
        rooms[capacity - sum(lengths)][lengths] = times
    for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
        count = left[n]
        while count > 0:
            room = min((r for r, kept in rooms.items() if r >= n and kept), default=None)
            if room is None:
                each = min(capacity // n, count)
                times = count // each
                own = rooms[capacity - each * n]
                own[(n,) * each] = own.get((n,) * each, 0) + times
                count -= times * each
                continue
            lengths = next(iter(rooms[room]))
            each = min(room // n, count)
            times = min(rooms[room][lengths], count // each)
            rooms[room][lengths] -= times
            if not rooms[room][lengths]:
                del rooms[room][lengths]
            longer = lengths + (n,) * each
            own = rooms[capacity - sum(longer)]
            own[longer] = own.get(longer, 0) + times
            count -= times * each
    return sorted(((lengths, times) for kept in rooms.values() for lengths, times in kept.items()), reverse=True)


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), sorted by rank; a slot serves `repeats` ranks."""
    next_rank: dict[int, int] = defaultdict(int)
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for n in lengths:
            rows[n].append((next_rank[n], sequence, offset))
            next_rank[n] += times
            offset += n
        sequence += times
    return {n: np.array(r, dtype=np.int64) for n, r in rows.items()}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. Reads the pieces twice: pass a written table."""
    dealt = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.spark_partition_id()), F.lit(SALTS)))
    dealt = saved(dealt, "pieces")
    counts = sorted((r["length"], r["salt"], r["n"]) for r in dealt.groupBy("length", "salt").agg(F.count("*").alias("n")).collect())  # capacity * SALTS rows at most
    before: dict[tuple[int, int], int] = {}
    histogram: dict[int, int] = defaultdict(int)
    for length, salt, n in counts:
        before[length, salt] = histogram[length]
        histogram[length] += n
    slots = _slots(plan_sequences(dict(histogram), capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            length, salt = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.flatnonzero(np.append(True, (length[1:] != length[:-1]) | (salt[1:] != salt[:-1])))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for start, stop in zip(at.tolist(), [*at[1:].tolist(), len(length)], strict=True):
                key = (int(length[start]), int(salt[start]))
                seen = seen if key == run else 0
                run = key
                rank = before[key] + seen + np.arange(stop - start)
                seen += stop - start
                rows = slots[key[0]]
                slot = np.searchsorted(rows[:, 0], rank, side="right") - 1
                sequence[start:stop] = rows[slot, 1] + rank - rows[slot, 0]
                offset[start:stop] = rows[slot, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    rows = dealt.repartition("length", "salt").sortWithinPartitions("length", "salt", "doc_id", "piece")
    return rows.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts to token pieces to packed sequences."""
    return pack_pieces(pieces_of(docs, tokenizer_path, capacity, end_id, id_col, text_col), capacity)
