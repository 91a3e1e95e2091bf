"""Telemetry reader: explicit schema, UTC timestamps, JSON properties kept as a map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatlake.schemas import EVENT_SCHEMA, conform_events


def normalize_events(df: DataFrame, id_column: str = "seq", props_column: str | None = None) -> DataFrame:
    """Rename the id, read timestamps as UTC instants, spread JSON properties into ``extra``."""
    if id_column != "seq":
        df = df.withColumnRenamed(id_column, "seq")
    if "ts" not in df.columns and "timestamp" in df.columns:
        df = df.withColumnRenamed("timestamp", "ts")
    kind = dict(df.dtypes)["ts"]
    ts = F.try_to_timestamp("ts") if kind == "string" else F.col("ts").cast("timestamp")
    df = df.withColumn("ts", ts)
    if props_column:
        df = df.withColumn("extra", F.from_json(props_column, "map<string,string>")).drop(props_column)
    return conform_events(df)


def read_events(
    spark: SparkSession, path: str, *, fmt: str = "parquet", stream: bool = False,
    id_column: str = "seq", props_column: str | None = None, schema=None,
) -> DataFrame:
    """Batch or streaming events. JSON and streams need a schema; Parquet brings its own in batch."""
    reader = spark.readStream if stream else spark.read
    if schema is None and (stream or fmt == "json"):
        schema = EVENT_SCHEMA
    if schema is not None:
        reader = reader.schema(schema)
    return normalize_events(reader.format(fmt).load(path), id_column, props_column)
