"""Statistics workbooks as files.

As CSV, one folder per sheet, `folder/sheet_id=NAME/*.csv`: each line is the row number in the sheet (header = 0) followed by
the cells, all of them text.

As typed rows, with a manifest of the sheets, in one of two layouts:

    root/manifest.json                    {"sheet_id": NAME, "position": place in the workbook}, one line per sheet
    root/sheets/sheet_id=NAME/*.json      {"row_pos": 0, "cells": ["State", 13000000.0, null]}, one line per row

    root/manifest.json                    {"sheet_id": NAME, "position": place, "folder": K}
    root/sheets/folder=K/*.json           {"sheet_id": NAME, "row_pos": 0, "cells": [...]}

There a number stays a number, and a row has the cells it has. The second one, which `write_workbook` writes, holds many sheets
in a folder, so that the number of files follows the size of the workbook and not its number of sheets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landroll.operators.statistics import KNOWN_PERIODS, with_period_meta, with_period_order

MANIFEST_TYPE = "sheet_id STRING, position INT"

# Folders of a written workbook: as many as sheets up to the first number, and more only where they would hold more sheets than the second.
LEAST_FOLDERS = 64
SHEETS_PER_FOLDER = 256


def cells_array(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("string") for c in columns])


def read_sheets(spark: SparkSession, folder: str, *, columns: int) -> DataFrame:
    """All sheets as `(sheet_id, row_pos, cells)`.

    Row numbers are data, so files may be read in any order. Every line has `columns` cells, narrow
    sheets padded; a line of another width fails the read instead of losing cells. Cells may hold
    line breaks, so a file is read by one task; a worksheet has at most 1,048,576 rows.
    """
    names = [f"c{i}" for i in range(columns)]
    fields = [T.StructField("row_pos", T.IntegerType())]
    fields += [T.StructField(c, T.StringType()) for c in [*names, "sheet_id"]]
    lines = spark.read.schema(T.StructType(fields)).csv(folder, multiLine=True, escape='"', mode="FAILFAST")
    return lines.select("sheet_id", "row_pos", cells_array(names).alias("cells"))


def missing_headers(sheets: DataFrame) -> DataFrame:
    """Sheets without a header row; a workbook with any of them is not fit for conversion."""
    has_header = F.bool_or(F.col("row_pos") == 0)
    return sheets.groupBy("sheet_id").agg(has_header.alias("has_header")).where(~F.col("has_header"))


def check_sheets(sheets: DataFrame) -> DataFrame:
    """The sheets, or an error naming one that has no header row."""
    bad = missing_headers(sheets).limit(1).collect()
    if bad:
        raise ValueError(f"sheet {bad[0]['sheet_id']} is empty")
    return sheets


# ---- typed rows and their manifest ---------------------------------------------------------------


def typed_cells(cells: Column | str) -> Column:
    """VARIANT cells as (text, number): numbers and truth values have a number, everything but null has a text."""
    def cell(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(value, "$", "double"))
        number = number.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
        return F.struct(F.variant_get(value, "$", "string").alias("text"), number.alias("number"))

    return F.transform(cells, cell)


def folders_for(sheets: int) -> int:
    return max(1, min(sheets, LEAST_FOLDERS), math.ceil(sheets / SHEETS_PER_FOLDER))


def write_workbook(sheets: DataFrame, manifest: DataFrame, root: str) -> None:
    """Write `(sheet_id, row_pos, cells ARRAY<VARIANT>)` and `(sheet_id, position)`, the latter one line per sheet.

    The rows of a folder are brought together before they are written; a large folder gets several files.
    """
    folder = F.pmod(F.xxhash64("sheet_id"), F.lit(folders_for(manifest.count()))).alias("folder")
    dealt = sheets.select("sheet_id", "row_pos", "cells", folder).hint("rebalance", "folder")
    dealt.write.partitionBy("folder").json(f"{root}/sheets")
    manifest.select("sheet_id", "position", folder).write.json(f"{root}/manifest.json")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(sheet_id, position) of every sheet of the workbook, also of those without rows."""
    return spark.read.schema(MANIFEST_TYPE).json(f"{root}/manifest.json")


def _folders_of(spark: SparkSession, root: str, sheets: tuple[str, ...]) -> list[str]:
    """Folders that hold the named sheets; a sheet has one of its own where the manifest gives none."""
    listed = spark.read.schema("sheet_id STRING, folder BIGINT").json(f"{root}/manifest.json")
    shared = listed.where(F.col("sheet_id").isin(*sheets) & F.col("folder").isNotNull()).distinct()
    known = {r["sheet_id"]: f"folder={r['folder']}" for r in shared.collect()}
    return [f"{root}/sheets/{f}" for f in dict.fromkeys(known.get(name, f"sheet_id={name}") for name in sheets)]


def read_workbook(spark: SparkSession, root: str, sheets: tuple[str, ...] | None = None) -> DataFrame:
    """Typed rows `(sheet_id, row_pos, cells ARRAY<STRUCT<text, number>>)` of all sheets, or only of those named.

    Only the folders of named sheets are listed and read.
    """
    folders = [f"{root}/sheets"] if sheets is None else _folders_of(spark, root, sheets)
    fields = "row_pos INT, cells ARRAY<VARIANT>, sheet_id STRING"
    lines = spark.read.schema(fields).option("basePath", f"{root}/sheets").json(folders, mode="FAILFAST")
    wanted = lines if sheets is None else lines.where(F.col("sheet_id").isin(*sheets))
    return wanted.select("sheet_id", "row_pos", typed_cells("cells").alias("cells"))


def check_workbook(manifest: DataFrame, sheets: DataFrame) -> DataFrame:
    """The sheets, or an error naming one of the manifest that has no header row, be it that it has no rows at all."""
    headed = sheets.where("row_pos = 0").select("sheet_id").distinct()
    bad = manifest.join(headed, "sheet_id", "left_anti").orderBy("position").limit(1).collect()
    if bad:
        raise ValueError(f"sheet {bad[0]['sheet_id']} is empty")
    return sheets


def workbook_periods(
    manifest: DataFrame, known: dict[str, tuple[str, str]] | None = None, preferred: tuple[str, ...] | None = None
) -> DataFrame:
    """The period list (sheet_id, label, as_of, period_order) of a workbook, whether or not a sheet has rows."""
    known = KNOWN_PERIODS if known is None else known
    listed = with_period_order(with_period_meta(manifest, known), "position", tuple(known) if preferred is None else preferred)
    return listed.select("sheet_id", "label", "as_of", "period_order")


def with_positions_of(sheets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Add the workbook `position` of each row's sheet."""
    return sheets.join(manifest.select("sheet_id", "position"), "sheet_id")
