"""Hashes of words and word shingles of whole texts, in numpy over Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
BLOCK = 1 << 19  # bytes hashed at once
BASE = 0x9E3779B97F4A7C15 | 1
WIDTH = 5
MIX = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLES: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, made once per process."""
    if not _TABLES:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            table = np.full(BLOCK + 1, base & (2**64 - 1), dtype=np.uint64)
            table[0] = 1
            _TABLES.append(np.multiply.accumulate(table))
    return _TABLES


def _block_words(data: np.ndarray, starts_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a block; starts_at: byte positions where a text begins."""
    power, inverse = _powers()
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[starts_at] = True
    first |= solid & begins[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last |= solid & begins[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(MIX[0])), start


def _long_words(data: np.ndarray) -> np.ndarray:
    """Words of one text longer than a block: cut at white space; a word longer than a block is hashed whole."""
    found, at, size = [], 0, len(data)
    while at < size:
        stop = min(at + BLOCK, size)
        if stop < size and not SPACE[data[stop]]:
            gaps = np.flatnonzero(SPACE[data[at:stop]])
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
            else:
                while stop < size and not SPACE[data[stop]]:
                    more = np.flatnonzero(SPACE[data[stop : stop + BLOCK]])
                    stop = stop + int(more[0]) if len(more) else min(stop + BLOCK, size)
                found.append(np.array([xxhash.xxh64_intdigest(LOWER[data[at:stop]].tobytes())], dtype=np.uint64))
                at = stop
                continue
        found.append(_block_words(data[at:stop], np.array([0]))[0])
        at = stop
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def word_hashes(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks (first row, hashes of all words, offsets of the rows' words); null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    rows = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + rows + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.zeros(0, np.uint8)
    row = 0
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1)
        piece = data[offsets[row] : offsets[stop]]
        if len(piece) > BLOCK:
            words = _long_words(piece)
            yield row, words, np.array([0, len(words)])
        elif len(piece):
            at = offsets[row : stop + 1] - offsets[row]
            words, start = _block_words(piece, at)
            yield row, words, np.searchsorted(start, at, side="left")
        else:
            yield row, np.zeros(0, np.uint64), np.zeros(stop - row + 1, np.int64)
        row = stop


def shingle_sets(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Blocks (first row, sorted distinct shingle hashes of each row).

    A row with fewer words than a shingle has its whole word sequence as its one shingle, one without words none.
    """
    coefficients = [np.uint64(c) for c in MIX]
    for first, words, offsets in word_hashes(texts):
        count = max(0, len(words) - WIDTH + 1)
        hashes = np.zeros(count, np.uint64)
        for k, c in enumerate(coefficients):
            hashes += words[k : k + count] * c
        hashes = mix64(hashes)
        sets = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= WIDTH:
                own = np.sort(hashes[a : b - WIDTH + 1])
                sets.append(own[np.append(True, own[1:] != own[:-1])])
            elif b > a:
                whole = np.array([b - a], dtype=np.uint64)
                for k in range(a, b):
                    whole = mix64(whole * coefficients[1] + words[k])
                sets.append(whole)
            else:
                sets.append(np.zeros(0, np.uint64))
        yield first, sets
