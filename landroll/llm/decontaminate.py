"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit verification.

Items and documents are word sequences (letters, digits and non-ASCII characters, lower case). A window has
the size of an item. The CGK embedding walks a window with random single steps that depend on the word under
the walker, so that few edits become few differences. Each LSH table compares the words met at a few sampled
steps. How many walks an item size gets is measured: passages with exactly the largest allowed number of edits are
simulated until at most half of the misses that the target recall allows are left; a size for which no number of walks does
is compared with all its windows. Items that share a key with a window are verified by exact word edit distance in the region
around it. Two counting bounds that follow from the allowed edits say which windows can match at all: at most that many words
from outside the benchmark's vocabulary, and enough whole three-word runs of items of the size. Windows beyond these bounds
are not embedded.

Defined results: items without words and null items or ids match nothing; null and empty texts hold no
leak; equal items report each; a row with a null id is scanned like others; repeated rows report alike; no
items or no documents give no hits; extra columns pass through `drop_leaks` and are not read by `find_leaks`.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landroll.llm.common import text_slices
from landroll.llm.shingles import mix64

EDIT_SHARE = 0.15  # edits allowed per word of an item
TARGET_RECALL = 0.99
WALKS = 64  # most walks of a size
WALKS_MORE = 4  # walks added at once
TABLES = 4  # tables on one walk
SAMPLED = 3  # words compared by one table
SIMULATED = 600  # edited passages that the number of walks is measured on
SIMULATED_WORDS = 400  # longer items are compared with all windows that the bounds allow
TURNS = 4096  # classes of words that turn a walk alike
WORDS_AT_ONCE = 1_000_000  # a pass has a fixed cost for each item size
TEXT_AT_ONCE = 6_000_000  # bytes of texts that are Python strings, and of a batch of documents returned
STEPS_AT_ONCE = 1 << 19  # of all walks in all windows
SLICE_BYTES = 8_000_000  # benchmark text that one pass over the documents holds

_PLAIN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()


def edit_distance_within(item: np.ndarray, region: np.ndarray, most: int | None = None) -> tuple[int, int, int]:
    """Least word edits between the item and any stretch of the region: (edits, first word, end of the stretch).

    With `most`, the comparison ends once more edits are certain; the edits returned are then only known to be more.
    """
    width = len(region) + 1
    cost, begin = np.zeros(width, np.int64), np.arange(width)
    steps = np.arange(width)
    for i, word in enumerate(item, 1):
        kept = cost[:-1] + (region != word)
        down = cost[1:] + 1
        best = np.minimum(kept, down)
        source = np.where(kept <= down, begin[:-1], begin[1:])
        row = np.concatenate([[i], best])
        own = np.concatenate([[0], source])
        order = np.minimum.accumulate(row - steps)
        at = np.maximum.accumulate(np.where(row - steps == order, steps, 0))
        cost, begin = order + steps, own[at]
        if most is not None and cost.min() > most:  # the least of a row never falls from row to row
            break
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


def _turns(seed: int, steps: int) -> np.ndarray:
    """At each step, a bit per walk for each class of words; fewer steps are the first ones of more."""
    return np.random.default_rng(seed).integers(0, 2**64, (steps, TURNS), dtype=np.uint64)


def _sampled(seed: int, n: int, walks: int) -> np.ndarray:
    """Steps (walk, table, sample) that the tables of n-word windows compare; a walk leaves n words after 2n steps or so."""
    places = np.random.default_rng([seed, 1]).random((WALKS, TABLES, SAMPLED))[:walks]
    return (places * 2 * n).astype(int)


def _walked(words: np.ndarray, starts: np.ndarray, n: int, turns: np.ndarray, walks: np.ndarray, pad: int) -> np.ndarray:
    """Words (step, walk, window) that the walks meet in the n-word windows at the starts, then the pad."""
    padded = np.append(words, pad).astype(np.int32)
    ends = np.minimum(starts + n, len(words)).astype(np.int64)
    at = np.repeat(starts[None].astype(np.int64), len(walks), axis=0)
    bit = walks.astype(np.uint64)[:, None]
    met = np.empty((2 * n, len(walks), len(starts)), dtype=np.int32)
    for step in range(2 * n):
        seen = padded[at]
        if step >= n:  # a walk cannot be through earlier
            seen[at >= ends] = pad
        met[step] = seen
        at += ((turns[step][seen & (TURNS - 1)] >> bit) & np.uint64(1)).astype(np.int64)
        np.minimum(at, ends, out=at)
    return met


def _edited(n: int, edits: int, rng: np.random.Generator) -> np.ndarray:
    """The words 1 to n after edits at so many places, new words being 0."""
    words = [[w] for w in range(1, n + 1)]
    for place in rng.choice(n, edits, replace=False):
        words[place] = ([0], [0, place + 1], [])[rng.integers(0, 3)]
    return np.array([w for own in words for w in own], dtype=np.int64)


@lru_cache(maxsize=4096)
def walks_for(n: int, edits: int, recall: float, seed: int) -> int:
    """Walks after which at most half of the misses allowed are left among passages with so many edits; 0: none suffice."""
    if recall >= 1 or n > SIMULATED_WORDS or edits >= n:
        return 0
    rng = np.random.default_rng([seed, 2, n, edits])
    width = 3 * n + 2 * edits + 8
    text = np.zeros((SIMULATED, width), dtype=np.int64)
    for row in text:
        own = _edited(n, edits, rng)
        row[n : n + len(own)] = own
    flat = text.ravel()
    unknown = np.concatenate([[0], np.cumsum(flat == 0)])
    whole = (flat[:-2] > 0) & (flat[1:-1] == flat[:-2] + 1) & (flat[2:] == flat[:-2] + 2)
    shared = np.concatenate([[0], np.cumsum(whole), [whole.sum()] * 2])
    places = (np.arange(SIMULATED)[:, None] * width + n + np.arange(-3, 4)).ravel()  # starts further away would only add hits
    allowed = (unknown[places + n - edits] - unknown[places] <= edits) & (shared[places + n + edits - 2] - shared[places] >= n - 2 - 3 * edits)
    places = places[allowed]
    item, turns = np.arange(1, n + 1), _turns(seed, 2 * n)
    steps = _sampled(seed, n, WALKS)
    hit = np.zeros(SIMULATED, dtype=bool)
    for walk in range(0, WALKS, WALKS_MORE):
        some = np.arange(walk, walk + WALKS_MORE)
        own = _walked(item, np.zeros(1, np.int64), n, turns, some, n + 1)
        open_ = places[~hit[places // width]]
        for part in np.array_split(open_, 1 + 2 * n * WALKS_MORE * len(open_) // STEPS_AT_ONCE):
            same = _walked(flat, part, n, turns, some, n + 1) == own
            for k in range(WALKS_MORE):
                for table in steps[walk + k]:
                    hit[part[same[table, k].all(axis=0)] // width] = True
        if (~hit).sum() <= (1 - recall) * SIMULATED / 2:
            return walk + WALKS_MORE
    return 0


class LeakIndex:
    """LSH tables of a bounded slice of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], share: float = EDIT_SHARE, recall: float = TARGET_RECALL, seed: int = 5) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.share = share
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                self.items.append((item_id, np.array(ids, dtype=np.int64)))
        self.pad = len(self.vocabulary) + 1
        self.mixed = mix64(np.arange(self.pad + 1, dtype=np.uint64) + np.uint64(1))  # hash of each word
        self.triples = np.unique(np.concatenate([self._triples(words) for _, words in self.items] or [np.zeros(0, np.uint64)]))
        self.sizes = sorted({len(words) for _, words in self.items})
        self.members: dict[int, list[int]] = {n: [] for n in self.sizes}
        for k, (_, words) in enumerate(self.items):
            self.members[len(words)].append(k)
        self.own_triples = {n: np.searchsorted(self.triples, np.unique(np.concatenate([self._triples(self.items[k][1]) for k in own]))) for n, own in self.members.items()}
        self.walks = {n: self._walks(n, recall, seed) for n in self.sizes}
        self.turns = _turns(seed, 2 * max((n for n in self.sizes if self.walks[n]), default=0))
        self.salt = np.random.default_rng([seed, 3]).integers(1, 2**63, (WALKS * TABLES, SAMPLED), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.steps = {n: _sampled(seed, n, walks).reshape(walks * TABLES, SAMPLED) for n, walks in self.walks.items()}
        self.keys: dict[int, np.ndarray] = {}
        self.holders: dict[int, list[list[int]]] = {}  # items of each key
        for n, own in self.members.items():
            held: dict[int, set[int]] = defaultdict(set)
            for k in own if self.walks[n] else ():
                for key in self._keys(self.items[k][1], np.array([0]), n)[:, 0].tolist():
                    held[key].add(k)
            self.keys[n] = np.array(sorted(held), dtype=np.uint64)
            self.holders[n] = [sorted(held[key]) for key in sorted(held)]

    @staticmethod
    def _triples(words: np.ndarray) -> np.ndarray:
        """Key of each three words in a row."""
        w = words.astype(np.uint64)
        return mix64(mix64(mix64(w[:-2]) + w[1:-1]) + w[2:])

    def allowed(self, n: int) -> int:
        return int(self.share * n)

    def _walks(self, n: int, recall: float, seed: int) -> int:
        """Measured at the shortest item with as many edits, where they are densest; above ten edits in steps of a fifth."""
        edits, step = self.allowed(n), 10
        while step < edits:
            step += step // 5
        edits = edits if edits <= 10 else step
        least = max(1, int(edits / self.share)) if edits else 1
        while self.allowed(least) < edits:
            least += 1
        return walks_for(max(n, least) if n > SIMULATED_WORDS else min(least, SIMULATED_WORDS), edits, recall, seed)

    def _keys(self, words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """Keys (table, window) of the n-word windows at the starts."""
        walks = self.walks[n]
        met = _walked(words, starts, n, self.turns, np.arange(walks), self.pad)
        walk = np.repeat(np.arange(walks), TABLES)
        keys = np.zeros((len(walk), len(starts)), dtype=np.uint64)
        for k in range(SAMPLED):
            keys += self.mixed[met[self.steps[n][:, k], walk]] * self.salt[: len(walk), k, None]
        return keys

    def leaks(self, texts: Sequence[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item_id, edits, first word, end word) of each item found in each text."""
        found: list[tuple[int, int, int, int, int]] = []
        rows: list[int] = []
        held: list[np.ndarray] = []
        size = 0
        for row, text in enumerate(texts):
            words = words_of(text)
            if words:
                rows.append(row)
                held.append(np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words)))
                size += len(words)
            if size >= WORDS_AT_ONCE:
                found += self._scan(rows, held)
                rows, held, size = [], [], 0
        return found + self._scan(rows, held)

    def _scan(self, rows: list[int], held: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        if not rows or not self.items:
            return []
        gap = np.zeros(2 * self.sizes[-1] + 2, dtype=np.int64)  # no word of any item, so nothing matches across texts
        begins = np.cumsum([0, *(len(h) + len(gap) for h in held)])
        ids = np.concatenate([x for h in held for x in (h, gap)])
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        triple = self._known_triples(ids)
        shared = np.concatenate([[0], np.cumsum(triple >= 0)])
        near: dict[tuple[int, int], set[int]] = defaultdict(set)
        wanted = np.zeros(len(self.triples) + 1, dtype=bool)  # the last stands for none
        for n in self.sizes:
            edits = self.allowed(n)
            sure = n - edits  # the first words of any stretch within the allowed edits
            starts = np.flatnonzero(unknown[sure:] - unknown[:-sure] <= edits)
            least = n - 2 - 3 * edits  # three-word runs of an item that the allowed edits must leave whole
            if least > 0:
                last = np.minimum(starts + n + edits - 2, len(shared) - 1)
                starts = starts[shared[np.maximum(last, starts)] - shared[starts] >= least]
                wanted[self.own_triples[n]] = True
                spots = np.arange(n + edits - 2)
                parts = np.array_split(starts, 1 + len(starts) * len(spots) // STEPS_AT_ONCE)
                starts = np.concatenate([p[wanted[triple[np.minimum(p[:, None] + spots, len(triple) - 1)]].sum(axis=1) >= least] for p in parts])
                wanted[self.own_triples[n]] = False
            walks = self.walks[n]
            if not walks:
                for start in starts.tolist():
                    for k in self.members[n]:
                        near[k, int(np.searchsorted(begins, start, side="right")) - 1].add(start)
                continue
            for some in np.array_split(starts, 1 + 2 * n * walks * len(starts) // STEPS_AT_ONCE):
                keys, own = self._keys(ids, some, n), self.keys[n]
                spot = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                window = np.nonzero(own[spot] == keys)[1]
                for start, at in set(zip(some[window].tolist(), spot[own[spot] == keys].tolist(), strict=True)):
                    for k in self.holders[n][at]:
                        near[k, int(np.searchsorted(begins, start, side="right")) - 1].add(start)
        found = []
        for (k, place), starts in near.items():
            item_id, item = self.items[k]
            words, edits = held[place], self.allowed(len(item))
            best, done = None, -1
            for start in sorted(s - int(begins[place]) for s in starts):
                low, high = max(0, start - 2 * edits - 1), min(len(words), start + len(item) + 2 * edits + 1)
                if high <= done:
                    continue
                region = words[low:high]
                if np.isin(item, region).sum() < len(item) - edits:  # each word left whole is in the region
                    continue
                cost, first, end = edit_distance_within(item, region, edits)
                if cost <= edits:
                    done = high
                    if best is None or cost < best[0]:
                        best = (cost, low + first, low + end)
            if best:
                found.append((rows[place], item_id, *best))
        return sorted(found)

    def _known_triples(self, ids: np.ndarray) -> np.ndarray:
        """Number of the three words from each place on, -1 where they stand in a row in no item."""
        out = np.full(len(ids), -1, dtype=np.int64)
        whole = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0))
        if len(whole) and len(self.triples):
            w = ids.astype(np.uint64)
            keys = mix64(mix64(mix64(w[whole]) + w[whole + 1]) + w[whole + 2])
            spot = np.minimum(np.searchsorted(self.triples, keys), len(self.triples) - 1)
            out[whole] = np.where(self.triples[spot] == keys, spot, -1)
        return out


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, share: float, recall: float, slice_bytes: int) -> Iterator[LeakIndex]:
    """Indexes over slices of the benchmark, each of about slice_bytes of text at most."""
    rows = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("i"), F.col(text_col).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slices = max(1, math.ceil(total / slice_bytes))
    for k in range(slices):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k) if slices > 1 else rows
        yield LeakIndex(sorted((r["i"], r["t"]) for r in part.toLocalIterator()), share, recall)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    share: float = EDIT_SHARE, recall: float = TARGET_RECALL, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Rows (doc_id, item_id, edits, first_word, end_word), one per document and item found in it. No shuffle."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for index in _indexes(benchmark, item_col, item_text, share, recall, slice_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: LeakIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in text_slices(whole, 1, TEXT_AT_ONCE)):
                cells = np.array(index.leaks(batch.column(1).to_pylist()), dtype=np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cells[:, 0])), *(pa.array(cells[:, k]) for k in range(1, 5))],
                    names=["doc_id", "item_id", "edits", "first_word", "end_word"],
                )

        part = plain.mapInArrow(run, "doc_id bigint, item_id bigint, edits bigint, first_word bigint, end_word bigint")
        out = part if out is None else out.union(part)
    return out


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    share: float = EDIT_SHARE, recall: float = TARGET_RECALL, slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The documents that hold no item, with all their columns; filtered where they lie."""
    at = docs.columns.index(text_col)
    for index in _indexes(benchmark, item_col, item_text, share, recall, slice_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: LeakIndex = index) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in text_slices(whole, at, TEXT_AT_ONCE)):
                stays = np.ones(batch.num_rows, dtype=bool)
                stays[np.array([row for row, *_ in index.leaks(batch.column(at).to_pylist())], dtype=np.int64)] = False
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
