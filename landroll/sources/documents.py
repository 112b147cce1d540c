"""Document files and digitised forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from landroll.operators.documents import ALLOWED_EXTENSIONS, digitised_form, screen_files


def _files(spark: SparkSession) -> DataFrameReader:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true")


def any_case_glob(extensions: tuple[str, ...]) -> str:
    """A file glob for the extensions in any case: `.pdf` becomes `*.[pP][dD][fF]`."""
    def letters(extension: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)

    return "{" + ",".join(f"*{letters(e)}" for e in extensions) + "}"


def list_files(
    spark: SparkSession, folder: str, *, allowed: tuple[str, ...] = ALLOWED_EXTENSIONS
) -> DataFrame:
    """Files below a folder with `extension` and `reject_reason`; contents are not read."""
    files = _files(spark).load(folder)
    return screen_files(files.select("path", "length", "modificationTime"), allowed=allowed)


def read_contents(
    spark: SparkSession, folder: str, *, allowed: tuple[str, ...] = ALLOWED_EXTENSIONS
) -> DataFrame:
    """Path and content of the accepted files; others are left out when the folder is listed."""
    files = _files(spark).option("pathGlobFilter", any_case_glob(allowed)).load(folder)
    accepted = screen_files(files, allowed=allowed).where(F.col("reject_reason").isNull())
    return accepted.select("path", "content")


def write_forms(df: DataFrame, path: str, *, text: str = "raw_text") -> None:
    """Digitised forms as JSON lines, missing fields written as null."""
    digitised_form(df, text=text).write.option("ignoreNullFields", "false").json(path)
