"""Reading texts, lines and selections; writing rendered text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import let


def partitions_of(df: DataFrame) -> int:
    """How many partitions a plan that isn't shuffled has."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for CPU-bound maps over few files that can't be split.

    A table of many splits, as on a cluster, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if partitions_of(df) < cores else df


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): a row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line), read file by file so that lines keep their numbers."""
    return explode_lines(read_documents(spark, path), "path", "text")


def explode_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no from 0, line); only line feeds end a line. Null texts have no lines."""
    return df.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))


def header_line(lines: DataFrame, id_col: str) -> DataFrame:
    """(id, header): line 0 of each file."""
    return lines.where(F.col("line_no") == 0).select(id_col, F.col("line").alias("header"))


def select_text(df: DataFrame, into: str = "selected") -> DataFrame:
    """df(text, start_line, start_char, end_line, end_char) with the selected text; an empty selection selects its line.

    Positions count from 0; past the last line nothing is selected.
    """
    within = (
        "array_join(transform(slice(ls, start_line + 1, end_line - start_line + 1), (l, i) -> substring(l, if(i = 0, start_char, 0) + 1, "
        "if(i = end_line - start_line, end_char, length(l)) - if(i = 0, start_char, 0))), chr(10))"
    )
    line = "coalesce(try_element_at(ls, start_line + 1), '')"
    empty = "start_line = end_line and start_char = end_char"
    return df.withColumn(into, F.expr(let("ls", "split(text, '\\\\n', -1)", f"if({empty}, {line}, {within})")))


def write_text(df: DataFrame, path: str, column: str = "output", order_by: str | None = None) -> None:
    """Write the column as text files; with order_by the files in name order hold the lines in order."""
    rows = df if order_by is None else df.orderBy(order_by)
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
