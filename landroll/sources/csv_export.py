"""CSV export of the (filtered) ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landroll.operators.ledger import EXPORT_COLUMNS, export_columns, newest_first
from landroll.sources.single_file import one_task, save_as_file

CSV_OPTIONS = {"header": "true", "lineSep": "\r\n", "nullValue": "", "emptyValue": "", "quote": '"', "escape": '"'}


def write_export(df: DataFrame, path: str, *, single_file: bool = False) -> None:
    """Write the eight labelled columns, newest first, CRLF line ends, null and empty both empty.

    Values that hold a comma, a quote or a line break are quoted. By default `path` is a folder of files in order by name, each of
    them with the header, as CSV readers of folders expect it; `single_file` makes `path` one file with one header.
    """
    ordered = export_columns(df.orderBy(*newest_first()))
    labelled = ordered.select(*[F.col(c).alias(label) for c, label in EXPORT_COLUMNS.items()])
    if single_file:
        save_as_file(one_task(labelled).write.format("csv").options(**CSV_OPTIONS), labelled, path)
    else:
        labelled.write.options(**CSV_OPTIONS).csv(path)
