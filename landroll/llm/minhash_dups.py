"""Near duplicates by a chosen-path set similarity join over minwise signatures.

A text's set is its distinct shingles of five words. Each distinct set gets a signature of minwise values. In every tree a document
follows the branches of a few coordinates, chosen by the tree or node, to the nodes named by its own minwise values
there. Documents of a node are compared exhaustively in blocks; a small node is one block. Every block of a larger node also
holds the node's pivot, and the node is branched again with all its members. A larger node of the last depth, or one that is
mostly tied to its pivot, is not left at that: as a whole it becomes part of one candidate group, whose members meet each other
on their full sets. The number of independent trees follows from the recall that is asked for. A document has
at most as many rows at a depth as there are trees x first branches x branches of the nodes above.

Links on signatures only make candidate groups: their full shingle sets are compared in blocks with a pivot, and only exact
links count. Members of a group of several blocks that this leaves apart from the pivot are compared once more, with full sets, in the
nodes where the trees put them beside members of the same group. Where these are members of whole larger nodes, which their trees compare in
blocks only, those apart are compared with all such members of their group: in runs of bounded size, and quadratic only in the number left apart.

Defined results: a null text and a text without words have an empty set and link with nothing; a null
id links with nothing, has no component and is kept; rows that repeat an id are one document with the
union of links; equal sets are always one group; ties of ids resolve to the smallest; a very long text is one set like any other;
an empty table gives no rows; columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landroll.llm.common import SMALL_ROWS, saved, small_or_not
from landroll.llm.components import connected_components
from landroll.llm.shingles import mix64, shingle_sets

COORDINATES = 96
SHARE = 0.75  # similarity for which the number of trees is reckoned
TARGET_RECALL = 0.9999  # chance that a pair of that similarity meets in some node of the last depth
FIRST_BRANCHES = 2  # coordinates a tree's root chooses
NODE_BRANCHES = 2  # coordinates a larger node chooses
DEPTHS = 3
NODE_ROWS = 512  # rows of a block of a node
CLUSTER_ROWS = 256  # rows of a block of a candidate group
REST_ROWS = 512  # rows of either side of a run of members apart and members of whole larger nodes
TIED_SHARE = 0.5  # part of a larger node tied to its pivot from which it goes whole to the full sets


def trees_for(recall: float, share: float = SHARE) -> int:
    """Trees needed for a pair that agrees in each coordinate with chance `share` to meet at the last depth with chance `recall`."""
    meets = 1.0
    for branches in [NODE_BRANCHES] * (DEPTHS - 1) + [FIRST_BRANCHES]:
        meets = 1 - (1 - share * meets) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


TREES = trees_for(TARGET_RECALL)
#: Four and a half standard errors of the signature estimate below the threshold.
MARGIN = 4.5

_RNG = np.random.default_rng(20240617)
_FACTORS = _RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROOT_COORDINATES = np.array([_RNG.choice(COORDINATES, FIRST_BRANCHES, replace=False) for _ in range(TREES)]).ravel()


_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.binary()), ("nodes", pa.list_(pa.int64()))])


def _set_key(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128-bit key of each set: two sums of mixed hashes."""
    mixed = mix64(flat)
    return np.column_stack([np.add.reduceat(mixed, at), np.add.reduceat(mix64(mixed ^ np.uint64(0x5851F42D4C957F2D)), at)])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, sets in shingle_sets(batch.column(1)):
            sizes = np.array([len(s) for s in sets])
            full = sizes > 0
            sig = np.zeros((len(sets), COORDINATES), dtype=np.uint16)
            nodes: list[list[int] | None] = [None] * len(sets)
            keys = np.zeros((len(sets), 2), dtype=np.uint64)
            if full.any():
                flat = np.concatenate([s for s in sets if len(s)])
                at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                values = np.empty((int(full.sum()), COORDINATES), dtype=np.uint32)
                for k, factor in enumerate(_FACTORS):
                    values[:, k] = np.minimum.reduceat(((flat * factor) >> np.uint64(32)).astype(np.uint32), at)
                wide = mix64(values.astype(np.uint64) + (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(40)))
                sig[full] = (wide & np.uint64(0xFFFF)).astype(np.uint16)
                tree = np.repeat(np.arange(TREES, dtype=np.uint64), FIRST_BRANCHES)
                own = mix64(wide[:, _ROOT_COORDINATES] ^ (tree << np.uint64(56))).astype(np.int64)
                for row, n in zip(np.flatnonzero(full).tolist(), own.tolist(), strict=True):
                    nodes[row] = n
                keys[full] = _set_key(flat, at)
            signed = keys.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, len(sets)), pa.array(sizes, pa.int64()), pa.array(signed[:, 0]), pa.array(signed[:, 1]), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
                schema=_FEATURES,
            )



def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: set size, 128-bit key of the set, signature and root branches. Whole texts, no shuffle."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(_features, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary, nodes array<bigint>")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole runs of rows with equal first columns; input is sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        moved = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
        if held and [held[-1].column(k)[-1].as_py() for k in range(keys)] != key[0].tolist():
            yield pa.Table.from_batches(held)
            held = []
        if len(moved):
            cut = int(moved[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row reached from each of n rows over the links a, b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


def _signature_links(group: np.ndarray, sig: np.ndarray, sizes: np.ndarray, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs inside runs of equal group whose signatures agree often enough and whose sizes allow a link."""
    left, right = [], []
    shift = 1
    rows = np.arange(len(group))
    while True:
        rows = rows[rows + shift < len(group)]
        rows = rows[group[rows] == group[rows + shift]]
        if not len(rows):
            break
        a, b = rows, rows + shift
        near = 100 * np.minimum(sizes[a], sizes[b]) >= percent * np.maximum(sizes[a], sizes[b])
        a, b = a[near], b[near]
        same = (sig[a] == sig[b]).sum(axis=1) >= least
        left.append(a[same])
        right.append(b[same])
        shift += 1
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _set_links(group: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of exact links inside runs of equal group. Rows already joined are not compared again."""
    left, right = [], []
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    for start, stop in zip(edges.tolist(), [*edges[1:].tolist(), len(group)], strict=True):
        root = np.arange(stop - start)
        own = sets[start:stop]
        sizes = np.array([len(s) for s in own])
        for i in range(1, stop - start):
            near = 100 * np.minimum(sizes[:i], sizes[i]) >= percent * np.maximum(sizes[:i], sizes[i])
            for j in np.flatnonzero(near).tolist():
                if root[i] == root[j]:
                    continue
                spot = np.searchsorted(own[j], own[i])
                spot[spot == len(own[j])] = 0
                both = int((own[j][spot] == own[i]).sum()) if len(own[j]) else 0
                if both and 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    low, high = sorted((root[i], root[j]))
                    root[root == high] = low
                    left.append(start + j)
                    right.append(start + i)
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


_SIGNED = pa.schema(
    [("grp", pa.int64()), ("block", pa.int64()), ("doc_id", pa.int64()), ("root", pa.int64()), ("near", pa.bool_()), ("tied", pa.bool_()), ("size", pa.int64()), ("payload", pa.binary())]
)
_SIGNED_SQL = "grp bigint, block bigint, doc_id bigint, root bigint, near boolean, tied boolean, size bigint, payload binary"


def _roots(group: np.ndarray, doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and smallest document of the component of each row over the links a, b."""
    label = _labels(len(doc), a, b)
    smallest = doc.copy()
    np.minimum.at(smallest, label, doc)
    return label, smallest[label]


def _compare_signatures(least: int, percent: int) -> Callable:
    """Rows of blocks (grp, block, blocks, doc_id, pivot, size, payload), sorted by (grp, block), to those that matter, with root, `near` and `tied`.

    near: the row has a candidate link in its block. tied: candidate links lead from it to the pivot. The payload comes back, once,
    for the rows of a larger node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 2):
            key = np.column_stack([table["grp"].to_numpy(), table["block"].to_numpy()])
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))])
            doc, sizes, blocks = (table[c].to_numpy() for c in ("doc_id", "size", "blocks"))
            payload = table["payload"].to_pylist()
            sig = np.frombuffer(b"".join(payload), dtype=np.uint16).reshape(len(doc), COORDINATES)
            a, b = _signature_links(group, sig, sizes, least, percent)
            label, root = _roots(group, doc, a, b)
            near = np.zeros(len(doc), dtype=bool)
            near[a] = near[b] = True
            pivot = (table["pivot"].fill_null(0).to_numpy() == doc) & (blocks > 1)
            goes_on = (blocks > 1) & (~pivot | (key[:, 1] == 0))
            at_pivot = np.full(int(group[-1]) + 1, -1)
            at_pivot[group[pivot]] = label[pivot]
            tied = label == at_pivot[group]
            kept = np.flatnonzero(near | goes_on)
            columns = [c[kept] for c in (key[:, 0], key[:, 1], doc, root, near, tied, sizes)]
            sent = [payload[i] if goes_on[i] else None for i in kept.tolist()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(sent, pa.binary())], schema=_SIGNED)

    return run


def _compare_sets(percent: int) -> Callable:
    """Rows (grp, block, doc_id, pivot, payload), sorted by (grp, block), to (grp, doc_id, root, tied): exact links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 2):
            key = np.column_stack([table["grp"].to_numpy(), table["block"].to_numpy()])
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]).any(axis=1))])
            doc, pivot = table["doc_id"].to_numpy(), table["pivot"].fill_null(0).to_numpy()
            a, b = _set_links(group, [np.frombuffer(x, dtype=np.uint64) for x in table["payload"].to_pylist()], percent)
            label, root = _roots(group, doc, a, b)
            at_pivot = np.full(int(group[-1]) + 1, -1)
            at_pivot[group[doc == pivot]] = label[doc == pivot]
            tied = (label == at_pivot[group]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[:, 0]), pa.array(doc, pa.int64()), pa.array(root, pa.int64()), pa.array(tied)], names=["grp", "doc_id", "root", "tied"]
            )

    return run


def _compare_rest(percent: int) -> Callable:
    """Rows (grp, block, doc_id, asks, payload), sorted by (grp, block), to (grp, doc_id, root): exact links of the rows that ask with all of their run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 2):
            key = np.column_stack([table["grp"].to_numpy(), table["block"].to_numpy()])
            edges = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            doc, asks = table["doc_id"].to_numpy(), table["asks"].to_numpy()
            payload = table["payload"]
            for start, stop in zip(edges.tolist(), [*edges[1:].tolist(), len(doc)], strict=True):
                sets = [np.frombuffer(x, dtype=np.uint64) for x in payload.slice(start, stop - start).to_pylist()]
                sizes = np.array([len(s) for s in sets])
                at = np.concatenate([[0], np.cumsum(sizes)])
                names, flat = np.unique(np.concatenate(sets), return_inverse=True)
                left, right = [], []
                mine = np.zeros(len(names), dtype=np.int64)
                for i in np.flatnonzero(asks[start:stop]).tolist():
                    own = flat[at[i] : at[i + 1]]
                    mine[own] = 1
                    both = np.add.reduceat(mine[flat], at[:-1])
                    mine[own] = 0
                    hit = np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both))
                    left.append(np.full(len(hit), i))
                    right.append(hit)
                none = [np.zeros(0, np.int64)]
                _, root = _roots(at, doc[start:stop], np.concatenate(left or none), np.concatenate(right or none))
                yield pa.RecordBatch.from_arrays([pa.array(key[start:stop, 0]), pa.array(doc[start:stop]), pa.array(root)], names=["grp", "doc_id", "root"])

    return run


def _blocks(members: DataFrame, rows: int) -> DataFrame:
    """Members (grp, doc_id, ...) with blocks, block and pivot: groups of more than `rows` in several blocks, the pivot in each."""
    least = F.min(F.struct(F.xxhash64("grp", "doc_id").alias("h"), "doc_id"))["doc_id"].alias("pivot")
    large = members.groupBy("grp").agg(F.count("*").alias("n"), least).where(F.col("n") > rows)
    large = saved(large.select("grp", F.ceil(F.col("n") / rows).cast("bigint").alias("blocks"), "pivot"), "large")
    placed = members.join(large, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("bigint")))
    own = F.array(F.pmod(F.xxhash64("doc_id", "grp", F.lit(7)), F.col("blocks")))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)
    return placed.withColumn("block", F.explode(F.when(F.col("doc_id") == F.col("pivot"), every).otherwise(own)))


def _in_blocks(rows: DataFrame, compare: Callable, schema: str, parts: int | None = None) -> DataFrame:
    """Compare within blocks. parts: number of tasks, where the work is large beside the bytes that the planner would go by."""
    dealt = rows.repartition(parts, "grp", "block") if parts else rows.repartition("grp", "block")
    return dealt.sortWithinPartitions("grp", "block", "doc_id").mapInArrow(compare, schema)


def _links(rows: DataFrame) -> DataFrame:
    return rows.where("doc_id <> root").select(F.col("doc_id").alias("a"), F.col("root").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept. See the module text for nulls and repeats."""
    feats = saved(features(docs, id_col, text_col), "features")
    usable = feats.where("doc_id IS NOT NULL AND n_shingles > 0")
    least_row = F.min(F.struct("doc_id", F.col("n_shingles").alias("size"), F.col("sig").alias("payload"), "nodes")).alias("r")
    reps = usable.groupBy("k1", "k2").agg(least_row, F.count("*").alias("copies"))
    reps = reps.select(F.xxhash64("k1", "k2").alias("doc_id"), "k1", "k2", F.col("r.doc_id").alias("id"), "r.size", "r.payload", "r.nodes", "copies")
    reps = saved(reps, "reps")
    firsts = small_or_not(reps.where("copies > 1").select("k1", "k2", F.col("id").alias("b")))
    equal = usable.select(F.col("doc_id").alias("a"), "k1", "k2").join(firsts, ["k1", "k2"]).where("a <> b").select("a", "b")

    share = percent / 100
    least = max(1, math.floor(COORDINATES * share - MARGIN * math.sqrt(COORDINATES * share * (1 - share))))
    by_signature = _compare_signatures(least, percent)
    level = reps.select(F.explode("nodes").alias("grp"), "doc_id", "size", "payload")
    met, whole = [], []
    for depth in range(1, DEPTHS + 1):
        blocks = _blocks(level, NODE_ROWS).select("grp", "block", "blocks", "doc_id", "pivot", "size", "payload")
        met.append(saved(_in_blocks(blocks, by_signature, _SIGNED_SQL), "nodes"))
        going = met[-1].where("payload IS NOT NULL")
        if going.isEmpty():
            break
        tied = F.sum(F.col("tied").cast("int")) >= F.lit(TIED_SHARE) * F.count("*")
        ends = going.groupBy("grp").agg(F.min("doc_id").alias("least"), (tied | F.lit(depth == DEPTHS)).alias("ends"))
        ends = small_or_not(saved(ends.where("ends").select("grp", "least"), "ends"))
        whole.append(going.join(ends, "grp").select("doc_id", F.col("least").alias("root")))
        if depth == DEPTHS:
            break
        branch = F.explode(F.sequence(F.lit(0), F.lit(NODE_BRANCHES - 1)))
        chosen = F.pmod(F.xxhash64("grp", "branch"), F.lit(COORDINATES)).cast("int")
        going = going.join(ends, "grp", "left_anti").select("grp", "doc_id", "size", "payload", branch.alias("branch"))
        child = F.xxhash64("grp", "branch", F.substring("payload", chosen * 2 + 1, F.lit(2)))
        level = going.select(child.alias("grp"), "doc_id", "size", "payload")
    places = reduce(DataFrame.union, [rows.select("grp", "block", "doc_id", "root", "near") for rows in met])
    whole = saved(reduce(DataFrame.union, whole), "whole") if whole else None
    links = _links(places) if whole is None else _links(places).union(_links(whole))
    groups = connected_components(links).select(F.col("component").alias("grp"), F.col("node").alias("doc_id"))
    groups = saved(groups, "groups")

    exact = _exact_links(docs, id_col, text_col, reps, groups, places, whole, percent)
    names = reps.select("doc_id", "id")
    links = small_or_not(saved(exact, "exact")).join(names.select(F.col("doc_id").alias("x"), F.col("id").alias("a")), "x").join(names.select(F.col("doc_id").alias("y"), F.col("id").alias("b")), "y")
    united = connected_components(equal.union(links.select("a", "b")))
    united = small_or_not(saved(united.withColumnRenamed("node", "doc_id"), "united"))
    out = feats.select("doc_id", "n_shingles").join(united, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, doc_id, grp, k1, k2), sorted by doc_id, to full sets, once per class; an id's other texts have other keys and go."""
    done = None
    for batch in batches:
        doc, grp, k1, k2 = (batch.column(k).to_numpy() for k in range(1, 5))
        for first, sets in shingle_sets(batch.column(0)):
            stays = []
            for i, own in enumerate(sets):
                row = first + i
                if len(own) and int(doc[row]) != done and (_set_key(own, np.array([0]))[0].astype(np.int64) == (k1[row], k2[row])).all():
                    done = int(doc[row])
                    stays.append(i)
            rows = first + np.array(stays, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[rows], pa.int64()), pa.array(grp[rows], pa.int64()), pa.array([sets[i].tobytes() for i in stays], pa.binary())], names=["doc_id", "grp", "payload"]
            )


def _exact_links(docs: DataFrame, id_col: str, text_col: str, reps: DataFrame, groups: DataFrame, places: DataFrame, whole: DataFrame | None, percent: int) -> DataFrame:
    """Links (x, y) between set classes of one candidate group, confirmed on the full sets. The texts stay where they are while candidates are few."""
    wanted = small_or_not(saved(reps.select("doc_id", "id", "k1", "k2").join(small_or_not(groups), "doc_id"), "wanted"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(wanted, "id").select("text", "doc_id", "grp", "k1", "k2").sortWithinPartitions("doc_id")
    members = saved(rows.mapInArrow(_sets, "doc_id bigint, grp bigint, payload binary"), "sets")
    by_set, schema = _compare_sets(percent), "grp bigint, doc_id bigint, root bigint, tied int"
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    dealt = _blocks(members, CLUSTER_ROWS).select("grp", "block", "doc_id", "pivot", "payload")
    found = saved(_in_blocks(dealt, by_set, schema, parts), "found")
    links = _links(found)
    apart = found.groupBy("grp", "doc_id").agg(F.max("tied").alias("tied"))
    wide = found.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > CLUSTER_ROWS).select("grp")
    apart = saved(apart.where("tied = 0").join(wide, "grp").select(F.col("grp").alias("own"), "doc_id"), "apart")
    if not apart.isEmpty():
        again = _beside(places, apart, members)
        links = links.union(_links(saved(_in_blocks(again, by_set, schema, parts), "beside")))
        if whole is not None:
            rest = _in_blocks(_rest(whole, apart, members), _compare_rest(percent), "grp bigint, doc_id bigint, root bigint", parts)
            links = links.union(_links(saved(rest, "rest")))
    return links.select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()


def _beside(places: DataFrame, apart: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (grp, block, doc_id, pivot, payload) of the blocks of nodes that hold members apart: those and the rest of their groups there.

    A block is told apart by its candidate group too, so it has at most as many rows as the block of the node.
    """
    near = places.where("near").select("grp", "block", "doc_id")
    asked = saved(near.join(small_or_not(apart), "doc_id").select("grp", "block", "own").distinct(), "asked")
    there = near.join(small_or_not(asked.select("grp", "block").distinct()), ["grp", "block"], "left_semi").distinct()
    own = members.select(F.col("grp").alias("own"), "doc_id", "payload")
    rows = there.join(own, "doc_id").join(small_or_not(asked), ["grp", "block", "own"], "left_semi")
    key = F.xxhash64("grp", "block", "own").alias("grp")
    return rows.select(key, F.lit(0).cast("bigint").alias("block"), "doc_id", F.col("doc_id").alias("pivot"), "payload")


def _rest(whole: DataFrame, apart: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (grp, block, doc_id, asks, payload): members apart of whole larger nodes beside all members of such nodes in their group.

    The members of a group are dealt into blocks, those apart into parts; each part meets each block in a run of its own.
    """
    asks = F.broadcast(apart) if apart.count() <= SMALL_ROWS else apart
    known = members.join(whole.select("doc_id").distinct(), "doc_id", "left_semi")
    known = saved(known.join(asks.select("doc_id", F.lit(True).alias("asks")), "doc_id", "left").select("grp", "doc_id", "payload", F.coalesce("asks", F.lit(False)).alias("asks")), "known")
    need = lambda n: F.ceil(n / F.lit(REST_ROWS)).cast("bigint")
    counts = known.groupBy("grp").agg(need(F.count("*")).alias("blocks"), need(F.sum(F.col("asks").cast("int"))).alias("parts"))
    counts = small_or_not(saved(counts.where("parts > 0"), "rest-groups"))
    rows = known.join(counts, "grp").withColumn("h", F.xxhash64("doc_id", "grp", F.lit(11)))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    key = F.xxhash64("grp", "part").alias("grp")
    others = rows.withColumn("part", each("parts")).withColumn("block", F.pmod("h", "blocks")).where("NOT (asks AND part = pmod(h, parts))")
    asking = rows.where("asks").withColumn("part", F.pmod("h", "parts")).withColumn("block", each("blocks"))
    return others.select(key, "block", "doc_id", F.lit(False).alias("asks"), "payload").union(asking.select(key, "block", "doc_id", "asks", "payload"))
