"""Session defaults and the shared checkpoint location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "threatlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on, UTC times and shuffle sizing left to AQE."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local session, whose tasks share the driver's disk, may go without:
    it gets a private folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.environ.get("THREATLAKE_CHECKPOINT_DIR")
        named = base or tempfile.mkdtemp(prefix="spark-threatlake-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def put_down(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder. For wide rows: a checkpoint holds them uncompressed and whole, this by column, and readers take only
    the columns they need. Its shuffle files go as soon as it is written."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}", spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a relation of known size. A frame made of a plain list counts as endless, so each join with it shuffles and sorts
    the other side before adaptive execution learns that it is small."""
    import pyarrow as pa

    names = [field.split()[0] for field in schema.split(", ")]
    return spark.createDataFrame(pa.table({n: pa.array([r[i] for r in rows]) for i, n in enumerate(names)}), schema)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer splits than cores, such as one file of one row group, to all cores before costly work on its rows. Tables of more splits,
    as all large ones are, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if 2 * splits <= cores else df
