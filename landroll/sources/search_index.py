"""An index for the ledger's free-text search: which claims hold which three letters.

    root/postings/part-*.parquet    (gram, id), in order of gram, so that a lookup reads the few row groups of its grams
    root/counts/part-*.parquet      (gram, n): how many claims hold a gram

A search looks up the rarest grams of its term, keeps the ids that have all of them, and applies the literal test of the plain
search to those claims only. Terms of fewer than three letters have no gram and are searched for in every claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landroll.operators.ledger import SEARCH_COLUMNS, search
from landroll.operators.sizes import ROW_OVERHEAD, is_small

GRAM = 3
LOOKED_UP = 3  # grams of a term that are intersected: more cost more than the literal test of what is left


def grams_of(text: Column) -> Column:
    """The distinct runs of three letters of a text, in lower case."""
    lower = F.lower(text)
    starts = F.when(F.length(lower) >= GRAM, F.sequence(F.lit(1), F.length(lower) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda at: F.substring(lower, at, F.lit(GRAM))))


def postings(claims: DataFrame, *, columns: tuple[str, ...] = SEARCH_COLUMNS, id_col: str = "id") -> DataFrame:
    """(gram, id) of every claim, each once; a gram does not reach from one column into the next."""
    held = F.array_distinct(F.flatten(F.array(*[F.coalesce(grams_of(F.col(c)), F.array().cast("array<string>")) for c in columns])))
    return claims.select(F.explode(held).alias("gram"), F.col(id_col).alias("id"))


def write_index(claims: DataFrame, root: str, *, columns: tuple[str, ...] = SEARCH_COLUMNS, id_col: str = "id") -> None:
    """Index all claims."""
    postings(claims, columns=columns, id_col=id_col).orderBy("gram", "id").write.parquet(f"{root}/postings")
    written = claims.sparkSession.read.parquet(f"{root}/postings")
    written.groupBy("gram").agg(F.count("*").alias("n")).orderBy("gram").write.parquet(f"{root}/counts")


def term_grams(spark: SparkSession, term: str) -> list[str]:
    """The grams of a search term, as the index holds them."""
    return spark.range(1).select(grams_of(F.lit(term)).alias("g")).first()["g"]


def find_ids(spark: SparkSession, root: str, term: str) -> DataFrame | None:
    """(id) of the claims that may hold the term: those with its rarest grams. None: the term has no gram, so all may."""
    grams = term_grams(spark, term)
    if not grams:
        return None
    counts = spark.read.schema("gram STRING, n BIGINT").parquet(f"{root}/counts")
    known = {r["gram"]: r["n"] for r in counts.where(F.col("gram").isin(*grams)).collect()}  # one row per gram of the term
    held = spark.read.parquet(f"{root}/postings")
    if len(known) < len(grams):
        return held.select("id").limit(0)
    rarest = sorted(grams, key=lambda g: (known[g], g))[:LOOKED_UP]
    ids = held.where(F.col("gram") == rarest[0]).select("id")
    for gram in rarest[1:]:
        ids = ids.join(held.where(F.col("gram") == gram).select("id"), "id", "left_semi")
    return F.broadcast(ids) if is_small(known[rarest[0]] * 2 * ROW_OVERHEAD) else ids


def indexed_search(claims: DataFrame, root: str, term: str, *, columns: tuple[str, ...] = SEARCH_COLUMNS, id_col: str = "id") -> DataFrame:
    """The rows that `ledger.search` finds, by way of the index at `root`."""
    ids = find_ids(claims.sparkSession, root, term)
    if ids is None:
        return search(claims, term, columns=columns)
    return search(claims.join(ids.withColumnRenamed("id", id_col), id_col, "left_semi"), term, columns=columns)
