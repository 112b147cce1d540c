"""Nested statistics JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landroll.operators.statistics import MEASURES, PERIODS_TYPE, ROW_TYPE, flatten_periods, nest_periods
from landroll.session import ensure_checkpoint_dir
from landroll.sources.single_file import one_task, save_as_file

PAYLOAD_TYPE = f"source STRING, periods {PERIODS_TYPE}"
PERIOD_TYPE = "id STRING, label STRING, asOf STRING, position INT"

# Lines of a document that are searched together for the period they belong to.
LINES_PER_RUN = 50_000


def read_statistics(spark: SparkSession, path: str, *, single_document: bool = False) -> DataFrame:
    """The long table from JSON lines, or from one pretty-printed document."""
    return flatten_periods(spark.read.schema(PAYLOAD_TYPE).json(path, multiLine=single_document))


def write_statistics(df: DataFrame, path: str, source: str, periods: DataFrame | None = None) -> None:
    """One payload record per period and line; null measures are left out.

    `periods` (sheet_id, label, as_of, period_order) lists the periods to write, those without rows with an empty list.
    """
    nest_periods(df, source, periods).write.json(path)


def document_lines(df: DataFrame, source: str, periods: DataFrame) -> DataFrame:
    """One JSON document with all periods, line by line: (period_order, place, row_pos, line), a line per row.

    `periods` (sheet_id, label, as_of, period_order) lists the periods of the document, also those without rows.
    """
    listed = periods.select("sheet_id", "label", "as_of", "period_order")
    ends = listed.agg(F.min("period_order").alias("first"), F.max("period_order").alias("last")).first()
    last_row = df.groupBy("sheet_id").agg(F.max("row_pos").alias("_last_row"))
    head = F.to_json(F.struct(F.col("sheet_id").alias("id"), "label", F.col("as_of").cast("string").alias("asOf")), {"ignoreNullFields": "false"})
    opening = F.when(F.col("period_order") == F.lit(ends["first"]), F.lit(f'{{"source": {json.dumps(source)}, "periods": [\n')).otherwise("")
    start = F.concat(opening, F.substring(head, F.lit(1), F.length(head) - 1), F.lit(', "rows": ['))
    stop = F.concat(F.lit("]}"), F.when(F.col("period_order") == F.lit(ends["last"]), "\n]}").otherwise(","))
    order = lambda place: (F.col("period_order"), F.lit(place).alias("place"), F.lit(0).cast("bigint").alias("row_pos"))
    row = F.to_json(F.struct("slNo", "state", *MEASURES))
    comma = F.when(F.col("row_pos") < F.col("_last_row"), ",").otherwise("")
    rows = df.drop("period_order", "label", "as_of").join(listed.select("sheet_id", "period_order"), "sheet_id").join(last_row, "sheet_id")
    lines = rows.select("period_order", F.lit(1).alias("place"), F.col("row_pos").cast("bigint").alias("row_pos"), F.concat(row, comma).alias("line"))
    return listed.select(*order(0), start.alias("line")).union(lines).union(listed.select(*order(2), stop.alias("line")))


def write_document(df: DataFrame, path: str, source: str, periods: DataFrame, *, single_file: bool = True) -> None:
    """One JSON document `{source, periods: [{id, label, asOf, rows}]}` with the listed periods in their order, those without rows too.

    Rows are sorted in tasks of their own. By default `path` is one file, written by a task that holds none of them. Otherwise it is a
    folder of part files, each written by the task that sorted it: in order by number, one after the other, they are the document.
    Without any period the list is empty.
    """
    lines = document_lines(df, source, periods).orderBy("period_order", "place", "row_pos").select("line")
    if periods.isEmpty():
        lines = df.sparkSession.createDataFrame([(f'{{"source": {json.dumps(source)}, "periods": []}}',)], "line STRING")
    if single_file:
        save_as_file(one_task(lines).write.format("text"), lines, path)
    else:
        lines.write.text(path)


def _parsed_lines(spark: SparkSession, path: str, lines_per_run: int) -> DataFrame:
    """(part, block, run, line, source, head, row) of each line; one of `source`, `head` and `row` is set, none where a list ends."""
    line, value = F.col("line"), F.col("value")
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("int")
    numbered = spark.read.text(path, lineSep="\n").select(
        F.coalesce(number, F.lit(0)).alias("part"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    empty = value.startswith('{"source": ') & value.endswith('"periods": []}')
    opening = value.startswith('{"source": ') & value.endswith('"periods": [')
    head = value.startswith('{"id":') & value.endswith(', "rows": [')
    row = value.startswith("{") & (value.endswith("}") | value.endswith("},")) & ~empty
    end = value.isin("]}", "]},")
    unknown = F.raise_error(F.concat(F.lit("no line of a statistics document: "), F.substring(value, 1, 80))).cast("boolean")
    strict = {"mode": "FAILFAST"}
    whole = F.concat(value, F.lit("]}"))
    return numbered.where(F.when(empty | opening | head | row | end, F.lit(True)).otherwise(unknown)).select(
        "part",
        "block",
        (line - line % lines_per_run).alias("run"),
        "line",
        F.from_json(F.when(empty, value).when(opening, whole), "source STRING", strict)["source"].alias("source"),
        F.from_json(F.when(head, whole), PERIOD_TYPE, strict).alias("head"),
        F.from_json(F.when(row, F.rtrim(value, F.lit(","))), ROW_TYPE, strict).alias("row"),
    )


def read_document(spark: SparkSession, path: str, *, lines_per_run: int = LINES_PER_RUN) -> DataFrame:
    """The long table from a document of `write_document`, one file or part files, read by lines in as many tasks as it has blocks.

    A row belongs to the last period named before it. Lines are taken in runs of one block; what a run is told by those before it
    (the source, its first line's number, periods so far, the last of them) comes from a summary of one row per run.
    Lines of any other layout are an error; `read_statistics` takes those documents.
    """
    ensure_checkpoint_dir(spark)
    lines = _parsed_lines(spark, path, lines_per_run).checkpoint()  # blocks and lines must not change between the two uses
    run = ("part", "block", "run")
    named = F.when(F.col("head").isNotNull(), F.struct("line", "head"))
    runs = lines.groupBy(*run).agg(
        F.min("line").alias("first"),
        F.count("*").alias("lines"),
        F.count("head").alias("heads"),
        F.get(F.collect_list("source"), F.lit(0)).alias("source"),  # one line of the document names it
        F.max(F.when(F.col("head").isNotNull(), F.col("line"))).alias("head_line"),
        F.max_by("head", F.when(F.col("head").isNotNull(), F.col("line"))).alias("last_head"),
    )
    until = Window.orderBy(*run).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy(*run).rowsBetween(Window.unboundedPreceding, -1)
    shifted = runs.select(
        *run,
        F.max("source").over(until).alias("source"),
        (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.coalesce(F.sum("heads").over(before), F.lit(0)).alias("heads_before"),
        "head_line",
        "last_head",
    )
    reached = F.when(F.col("head_line").isNotNull(), F.struct((F.col("head_line") + F.col("shift")).alias("line"), F.col("last_head").alias("head")))
    told = shifted.select(*run, "source", "shift", "heads_before", F.last(reached, ignorenulls=True).over(before).alias("carried"))

    inside = Window.partitionBy(*run).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.select(*run, "line", "row", F.last(named, ignorenulls=True).over(inside).alias("own"), F.count("head").over(inside).alias("heads"))
    rows = placed.where(F.col("row").isNotNull()).join(F.broadcast(told), list(run))
    own = F.when(F.col("own").isNotNull(), F.struct((F.col("own.line") + F.col("shift")).alias("line"), F.col("own.head").alias("head")))
    found = rows.withColumn("period", F.coalesce(own, "carried"))
    lost = F.raise_error(F.lit("a row before the first period")).cast("boolean")
    return found.where(F.when(F.col("period").isNull(), lost).otherwise(F.lit(True))).select(
        "source",
        F.coalesce("period.head.position", F.col("heads_before") + F.col("heads") - 1).cast("int").alias("period_order"),
        F.col("period.head.id").alias("sheet_id"),
        F.col("period.head.label").alias("label"),
        F.col("period.head.asOf").cast("date").alias("as_of"),
        (F.col("line") + F.col("shift") - F.col("period.line") - 1).alias("row_pos"),
        "row.*",
    )
