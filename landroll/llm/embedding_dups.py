"""Embedding near duplicates: a navigable small-world graph per shard, every shard queried, cosines verified, links united.

Vectors that are equal within a label become one class first, so copies cost a count. The classes of a label
are dealt into shards of bounded size with a graph each; all classes of the label then query every shard in chunks of bounded size. A chunk's
beam is widened until audited queries, and moved copies of nodes, miss nothing. A query with a link, found from either end, is then
compared with its whole shard, so it misses none; all queries are only where the beam has grown to an eighth of the graph (or
the shard is as small from the start). Cosines of links are taken again in double
precision. A task returns per query a number of links and one row into its local group, never its pairs.

Defined results: null labels, null and zero vectors, and vectors with null or non-finite components link with
nothing; vectors of different lengths don't link; a null id links with nothing, has no component and is kept; rows
that repeat an id are one vector for components, and each row counts as a copy; equal cosines are all links, so ties need no rule;
an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landroll.llm.common import saved
from landroll.llm.components import connected_components
from landroll.llm.hnsw import WIDEST, Graph

LEAST_COSINE = 0.98
SHARD_ROWS = 6_000
CHUNK_ROWS = 24_000  # queries that share one copy of a shard
BEAM = 48
SLACK = 1e-4  # single-precision candidates below the threshold that are still verified


def _matrix(column: pd.Series) -> np.ndarray:
    """Rows scaled by their largest component, so that squares neither overflow nor vanish."""
    rows = np.array(column.tolist(), dtype=np.float64)
    return rows / np.abs(rows).max(axis=1, keepdims=True)


def _unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))).astype(np.float32)


def _graph(beam: int) -> Callable:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        if WIDEST * beam >= len(pdf):  # compared exhaustively
            graph = Graph(np.zeros((0, 0)), [], np.zeros(0))
        else:
            graph = Graph.build(_unit(_matrix(pdf["v"])), seed=int(key[2]))
        blobs = [layer.tobytes() for layer in graph.layers]
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "ids": [pdf["id"].to_numpy()], "vectors": [np.array(pdf["v"].tolist(), dtype=np.float64).tobytes()], "levels": [graph.levels.astype(np.int32).tobytes()], "layers": [blobs]})

    return run


def _query(least: float, beam: int) -> Callable:
    def run(key: tuple, graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "root": pd.Series(dtype="int64")})
        if graphs.empty or queries.empty:
            return none
        g = graphs.iloc[0]
        node_id = np.asarray(g["ids"], dtype=np.int64)
        raw = np.frombuffer(g["vectors"], dtype=np.float64).reshape(len(node_id), -1)
        raw = raw / np.abs(raw).max(axis=1, keepdims=True)
        layers = [np.frombuffer(b, dtype=np.int32).reshape(len(node_id), -1) for b in g["layers"]]
        graph = Graph(_unit(raw), layers, np.frombuffer(g["levels"], dtype=np.int32))
        own = _matrix(queries["v"])
        query_id = queries["id"].to_numpy()
        place = pd.Series(np.arange(len(node_id)), index=node_id).reindex(query_id, fill_value=-1).to_numpy()
        q, n = graph.within(_unit(own), least - SLACK, beam, own=place)
        exact = np.zeros(len(q), dtype=bool)
        for part in range(0, len(q), 100_000):
            a, b = own[q[part : part + 100_000]], raw[n[part : part + 100_000]]
            exact[part : part + 100_000] = (a * b).sum(axis=1) / np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1)) >= least
        exact &= query_id[q] != node_id[n]
        q, n = q[exact], n[exact]
        if not len(q):
            return none
        count = np.bincount(q, queries_weight(graphs, n), len(query_id)).astype(np.int64)
        left, right = query_id.copy(), node_id.copy()
        while True:  # smallest id of each local group
            low = np.minimum(left[q], right[n])
            new_left, new_right = left.copy(), right.copy()
            np.minimum.at(new_left, q, low)
            np.minimum.at(new_right, n, low)
            if (new_left == left).all() and (new_right == right).all():
                break
            left, right = new_left, new_right
        hit_q, hit_n = np.unique(q), np.unique(n)
        return pd.DataFrame({"id": np.concatenate([query_id[hit_q], node_id[hit_n]]), "links": np.concatenate([count[hit_q], np.zeros(len(hit_n), np.int64)]), "root": np.concatenate([left[hit_q], right[hit_n]])})

    def queries_weight(graphs: pd.DataFrame, n: np.ndarray) -> np.ndarray:
        return np.asarray(graphs.iloc[0]["weights"], dtype=np.float64)[n]

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST_COSINE,
    shard_rows: int = SHARD_ROWS, chunk_rows: int = CHUNK_ROWS, beam: int = BEAM,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    finite = "label IS NOT NULL AND vec_id IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    rows = rows.withColumn("usable", F.coalesce(F.expr(finite), F.lit(False)))
    usable = rows.where("usable").select("vec_id", "label", F.size("v").alias("dim"), "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), F.reverse("v")).alias("k2"))
    keys = ["label", "dim", "k1", "k2"]
    classes = saved(usable.groupBy(*keys).agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")), "classes")
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    shards = sizes.select("label", "dim", F.ceil(F.col("n") / shard_rows).cast("bigint").alias("shards"), F.ceil(F.col("n") / chunk_rows).cast("bigint").alias("chunks"))
    dealt = classes.join(shards, ["label", "dim"]).select(*keys, "id", "weight", "shards", "chunks", F.xxhash64("id").alias("h"))
    reps = usable.select(*keys, F.col("vec_id").alias("id"), "v").join(dealt, [*keys, "id"])
    reps = reps.dropDuplicates([*keys, "id"])  # rows may repeat; partitioned so by the join
    reps = saved(reps.withColumn("shard", F.pmod("h", "shards")).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(3)), "chunks")), "reps")

    kind = dict(reps.dtypes)["label"]
    schema = f"label {kind}, dim int, shard bigint, ids array<bigint>, vectors binary, levels binary, layers array<binary>"
    graphs = reps.groupBy("label", "dim", "shard").applyInPandas(_graph(beam), schema)
    graphs = saved(graphs, "graphs")
    heavy = reps.groupBy("label", "dim", "shard").agg(F.collect_list(F.struct("h", "weight")).alias("w"))  # shard_rows of them or so
    graphs = graphs.join(heavy, ["label", "dim", "shard"]).withColumn("weights", F.transform(F.array_sort("w"), lambda w: w["weight"])).drop("w")
    graphs = graphs.join(shards.select("label", "dim", "chunks"), ["label", "dim"]).withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))).drop("chunks")
    queries = reps.select("label", "dim", "chunk", "id", "v", F.explode(F.expr("sequence(0L, shards - 1)")).alias("shard"))
    group = ["label", "dim", "shard", "chunk"]
    found = queries.groupBy(*group)
    found = graphs.groupBy(*group).cogroup(found).applyInPandas(_query(least, beam), "id bigint, links bigint, root bigint")
    found = saved(found, "found")

    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    united = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_class = classes.join(counts, "id", "left").join(united.withColumnRenamed("node", "id"), "id", "left")
    per_class = saved(per_class.select(*keys, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "per-class")
    members = usable.select("vec_id", *keys).join(per_class, keys).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = members.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
