"""Scheduled-task CSV exports, whose headers differ between system versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Output column and the header spellings that may carry it, in order of preference.
HEADERS = {
    "task_name": ["TaskName", "Task Name"],
    "task_to_run": ["Task To Run", "Task to Run"],
    "status": ["Status", "Scheduled Task State"],
    "author": ["Author"],
    "run_as_user": ["Run As User"],
    "next_run_time": ["Next Run Time"],
    "last_run_time": ["Last Run Time"],
}


def normalize_task_rows(df: DataFrame) -> DataFrame:
    """One spelling per column, trimmed; rows without a task name are dropped."""
    present = set(df.columns)

    def pick(options: list[str]) -> Column:
        found = [F.nullif(F.col(f"`{o}`"), F.lit("")) for o in options if o in present]
        return F.trim(F.coalesce(*found, F.lit("")))

    out = df.select(*[pick(options).alias(name) for name, options in HEADERS.items()])
    return out.where(F.col("task_name") != "")


def read_task_exports(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return normalize_task_rows(raw)
