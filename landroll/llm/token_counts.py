"""Edit-aware token counts over pre-token segment trees.

A document's tree has leaves of a few dozen pre-tokens with their characters and tokens, and above them a
binary heap of subtree sums. An edit finds its leaves by descending the sums. The text from the first
touched leaf on is split again until a boundary falls on an old leaf end behind the edit, not after white space; from there
the old split goes on unchanged, because the pre-token pattern never looks back. Only that region is encoded
again; its leaves' sums are updated up to the root, and the heap is laid out anew only when their number changes.

Defined results: a null text counts as empty, with no leaf and 0 tokens; null edits are none; positions
are code points and are clipped to the text; edits are applied in order of start, then stop, and one that begins before the
end of an earlier one is skipped; a null replacement deletes; a null id is carried along; equal rows give equal rows;
no documents give no rows; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landroll.llm.common import text_slices

LEAF = 48  # pre-tokens of a leaf
CONTEXT = 3  # characters before an edit whose pre-tokens may look ahead into it
#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_OPEN: dict[str, tiktoken.Encoding] = {}
_SPLIT = regex.compile(PATTERN)


def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a .tiktoken file, read once per process."""
    if path not in _OPEN:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
        _OPEN[path] = tiktoken.Encoding("byte-pairs", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _OPEN[path]


class SegmentTree:
    """Leaves (characters, tokens) of one text and the heap of their subtree sums."""

    def __init__(self, sums: np.ndarray, leaves: int) -> None:
        self.sums, self.leaves = sums, leaves  # rows: characters, tokens; node k has children 2k and 2k + 1

    @classmethod
    def of(cls, widths: list[int], tokens: list[int]) -> SegmentTree:
        base = 1 << max(0, len(widths) - 1).bit_length()
        sums = np.zeros((2, 2 * base), dtype=np.int64)
        sums[0, base : base + len(widths)], sums[1, base : base + len(tokens)] = widths, tokens
        while base > 1:
            half = base // 2
            sums[:, half:base] = sums[:, base : 2 * base].reshape(2, half, 2).sum(axis=2)
            base = half
        return cls(sums, len(widths))

    @property
    def base(self) -> int:
        return self.sums.shape[1] // 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """Leaf that holds the character, and where it begins; the last leaf for a place at the end."""
        node, begin = 1, 0
        place = min(place, int(self.sums[0, 1]) - 1)
        while node < self.base:
            node *= 2
            if place - begin >= self.sums[0, node]:
                begin += int(self.sums[0, node])
                node += 1
        return node - self.base, begin

    def width(self, leaf: int) -> int:
        return int(self.sums[0, self.base + leaf])

    def replace(self, first: int, stop: int, widths: list[int], tokens: list[int]) -> SegmentTree:
        """Leaves first to stop become the given ones."""
        if stop - first == len(widths):
            for k, pair in enumerate(zip(widths, tokens, strict=True)):
                node = self.base + first + k
                change = np.array(pair) - self.sums[:, node]
                while node:
                    self.sums[:, node] += change
                    node //= 2
            return self
        own = self.sums[:, self.base : self.base + self.leaves]
        joined = [[*own[r, :first].tolist(), *new, *own[r, stop:].tolist()] for r, new in enumerate((widths, tokens))]
        return SegmentTree.of(*joined)


def _leaves(coder: tiktoken.Encoding, text: str, ends: list[int]) -> tuple[list[int], list[int]]:
    """Widths and tokens of leaves over a stretch that pre-tokens with the given ends fill.

    A leaf never ends in white space before the stretch does: there the pattern looks at what follows.
    """
    cuts, k = [0], LEAF - 1
    while k < len(ends) - 1:
        if text[ends[k] - 1].isspace():
            k += 1
        else:
            cuts.append(ends[k])
            k += LEAF
    cuts += ends[-1:]
    return [b - a for a, b in zip(cuts, cuts[1:])], [len(coder.encode_ordinary(text[a:b])) for a, b in zip(cuts, cuts[1:])]


def grow(coder: tiktoken.Encoding, text: str) -> SegmentTree:
    ends = np.cumsum([len(p) for p in _SPLIT.findall(text)]).tolist()
    return SegmentTree.of(*_leaves(coder, text, ends))


def in_order(edits: list[tuple[int, int, str]], size: int) -> list[tuple[int, int, str]]:
    """Edits clipped to the text, sorted, without those that begin inside an earlier one."""
    out: list[tuple[int, int, str]] = []
    clipped = sorted((min(max(a, 0), size), min(max(b, a, 0), size), new) for a, b, new in edits)
    for start, stop, new in clipped:
        if not out or start >= out[-1][1]:
            out.append((start, stop, new))
    return out


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, stop, new in edits:
        parts += [text[at:start], new]
        at = stop
    return "".join([*parts, text[at:]])


def update(coder: tiktoken.Encoding, tree: SegmentTree, text: str, edits: list[tuple[int, int, str]]) -> tuple[SegmentTree, str, int]:
    """The tree and text after edits in order, and how many characters were encoded again. The tree is used up."""
    new_text = edited(text, edits)
    if not tree.leaves:
        tree = grow(coder, new_text)
        return tree, new_text, len(new_text)
    again = 0
    shift = 0  # of the finished edits
    drift = 0  # leaves added so far
    k = 0
    plan = []  # in old leaves and places: found before the tree changes
    while k < len(edits):
        first, begin = tree.leaf_at(max(0, edits[k][0] - CONTEXT))
        grown = 0
        last, end = first, begin + tree.width(first)
        at = begin + shift
        ends: list[int] = []
        matches = _SPLIT.finditer(new_text, at)
        while True:
            while k < len(edits) and edits[k][0] - CONTEXT <= end:
                grown += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                while end < edits[k][1]:
                    last += 1
                    end += tree.width(last)
                k += 1
            goal = end + shift + grown
            while (ends[-1] + at if ends else at) < goal:
                ends.append(next(matches).end() - at)
            if (ends[-1] + at if ends else at) == goal and (goal == len(new_text) or (goal > at and not new_text[goal - 1].isspace())):
                break
            last += 1
            end += tree.width(last)
        plan.append((first, last + 1, at, ends))
        shift += grown
    for first, stop, at, ends in plan:
        widths, tokens = _leaves(coder, new_text[at : at + (ends[-1] if ends else 0)], ends)
        again += sum(widths)
        tree = tree.replace(first + drift, stop + drift, widths, tokens)
        drift += len(widths) - (stop - first)
    return tree, new_text, again


def build_trees(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """Documents with their trees: doc_id, text, sums (heap rows one after the other), leaves, and the edits if a column is named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            trees = [grow(coder, t or "") for t in batch.column(1).to_pylist()]
            added = [pa.array([t.sums.ravel() for t in trees], pa.list_(pa.int64())), pa.array([t.leaves for t in trees], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *added, *batch.columns[2:]], names=["doc_id", "text", "sums", "leaves", *batch.schema.names[2:]])

    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(edits_col).cast(EDITS).alias("edits")] if edits_col else []))
    return plain.mapInArrow(run, "doc_id bigint, text string, sums array<bigint>, leaves int" + (f", edits {EDITS}" if edits_col else ""))


EDITS = "array<struct<start:int,stop:int,replacement:string>>"


def recount(trees: DataFrame, vocabulary: str) -> DataFrame:
    """Trees with edits to: doc_id, tokens_before, tokens_after, n_edits, encoded_again and the new text, sums, leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(vocabulary)
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            rows = []
            at, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            own_sums = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            for text, sums, leaves, edits in zip(batch.column(1).to_pylist(), own_sums, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                tree = SegmentTree(np.array(sums, dtype=np.int64).reshape(2, -1), leaves)
                before, text = tree.tokens, text or ""
                own = [(e["start"], e["stop"], e["replacement"] or "") for e in edits or [] if e and e["start"] is not None and e["stop"] is not None]
                own = in_order(own, len(text))
                again = 0
                if own:
                    tree, text, again = update(coder, tree, text, own)
                rows.append((before, tree.tokens, len(own), again, text, tree.sums.ravel(), tree.leaves))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "tokens_before", "tokens_after", "n_edits", "encoded_again", "text", "sums", "leaves"])

    chosen = trees.select("doc_id", "text", "sums", "leaves", "edits")
    return chosen.mapInArrow(run, "doc_id bigint, tokens_before bigint, tokens_after bigint, n_edits bigint, encoded_again bigint, text string, sums array<bigint>, leaves int")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """Attach an edit table (doc_id, start, stop, replacement) to trees; documents without edits have none."""
    lists = edits.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("start", "stop", "replacement")).cast(EDITS).alias("edits"))
    return trees.drop("edits").join(lists, F.col("doc_id") == F.col("__id"), "left").drop("__id")
