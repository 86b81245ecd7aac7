"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a line's number that are for the task that reads it.
TASK_BITS = 20


def new_path(spark: SparkSession) -> str:
    """A new name in the folder ``spark.checkpoint.dir``; only where that is unset and all tasks run in the driver's process, in a new folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="allelia-")
    return f"{folder.rstrip('/')}/staged-{uuid.uuid4().hex}"


def staged(df: DataFrame, *sort: str, **options: str) -> DataFrame:
    """The rows written once as Parquet and read again: later scans read only their columns, and a recomputed task gives the same rows.

    sort: columns to sort by within each file; options: of Spark's Parquet writer."""
    path = new_path(df.sparkSession)
    (df.sortWithinPartitions(*sort) if sort else df).write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, value) of the lines of a text file, or of all files of a folder or pattern; row_id grows along the files in order of their names
    (numbers in them by value) and along each file's lines.

    Spark deals large files to the first tasks, so its ids alone follow the sizes of the files; within one file they follow its lines. How many tasks
    there are is known only when they run (it follows the executors at hand), so their numbers have bits of their own, for up to 2 ** TASK_BITS."""
    text = spark.read.text(path)
    files = sorted(text.inputFiles(), key=lambda f: [int(x) if x.isdigit() else x for x in re.split(r"([0-9]+)", f)])
    if len(files) < 2:
        return text.select(F.monotonically_increasing_id().alias("row_id"), "value")
    low = 63 - TASK_BITS - (len(files) - 1).bit_length()  # bits that are left for the line of a task
    ranks = spark.createDataFrame(list(enumerate(files)), "_rank long, _file string")  # a row for each file
    rows = text.select(F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_id"), "value").join(F.broadcast(ranks), "_file", "left")
    task, line = "shiftright(_id, 33)", f"(_id & {(1 << 33) - 1})"
    known = f"_rank is not null and {task} < {1 << TASK_BITS} and {line} < {1 << low}"
    number = f"shiftleft(shiftleft(_rank, {TASK_BITS}) + {task}, {low}) + {line}"
    return rows.select(F.expr(f"if({known}, {number}, raise_error('Lines of ' || _file || ' cannot be numbered'))").cast("long").alias("row_id"), "value")
