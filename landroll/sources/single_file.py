"""One file from the ordered rows of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter


def one_task(ordered: DataFrame) -> DataFrame:
    """The partitions of a sorted table one after the other in one task.

    They were sorted in tasks of their own; this one reads them in turn and holds none of them.
    """
    return ordered.coalesce(1)


def save_as_file(writer: DataFrameWriter, df: DataFrame, path: str) -> None:
    """Save what one task writes as the file `path` itself; an existing file is an error."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    folder = f"{path}.parts"
    writer.mode("errorifexists").save(folder)
    (part,) = files.globStatus(hadoop.Path(f"{folder}/part-*"))
    if not files.rename(part.getPath(), target):
        raise OSError(f"{part.getPath()} could not become {path}")
    files.delete(hadoop.Path(folder), True)
