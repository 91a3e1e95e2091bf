"""The event store as a table that is changed in place: live files by date and bucket, named by a manifest.

A version of the store is one manifest, written after its files: rows ``(event_date, bucket, path, n, first_seen, last_seen)``, one for each live folder. Adding
a batch rewrites only the folders that hold a row which the batch changes, or that get a new row; all others are carried over by name. Versions
are numbered by their batch, so a batch that is tried again builds on the version before it and replaces its own files: retries change nothing.

The manifest has a row per date and bucket, whatever the number of events, and is all that the driver reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from threatlake import fixed_values_endpoint as V
from threatlake.operators.store import STORE_COLUMNS, merge_into_store

BUCKETS = 16
_PLACE = ["event_date", "bucket"]


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, ascending."""
    files, place = _folder(spark, f"{path}/manifest")
    if not files.exists(place):
        return []
    found = [s.getPath() for s in files.listStatus(place)]
    done = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName()) for p in done)


def manifest(spark: SparkSession, path: str, version: int) -> list:
    return spark.read.parquet(f"{path}/manifest/{version}").collect()


def _rows(spark: SparkSession, schema, paths: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_live(spark: SparkSession, path: str, schema, version: int | None = None) -> DataFrame:
    """The rows of a version, the last one by default."""
    known = versions(spark, path)
    version = version if version is not None else (known[-1] if known else None)
    return _rows(spark, schema, [] if version is None else [m.path for m in manifest(spark, path, version)])


def _placed(df: DataFrame, buckets: int) -> DataFrame:
    bucket = F.pmod(F.xxhash64("host", "fingerprint"), F.lit(buckets)).cast("int")
    return df.withColumns({"event_date": F.to_date("first_seen"), "bucket": bucket})


def upsert(batch: DataFrame, path: str, version: int, gap: int = V.STORE_GAP_SECONDS, buckets: int = BUCKETS) -> None:
    """Add compacted store rows as version ``version``. ``batch`` is read several times: pass a table."""
    spark = batch.sparkSession
    schema = batch.select(*STORE_COLUMNS).schema
    before = [v for v in versions(spark, path) if v < version]
    live = manifest(spark, path, before[-1]) if before else []
    new = _placed(batch.select(*STORE_COLUMNS), buckets)
    spans = new.groupBy("bucket").agg(
        F.min(F.unix_micros("first_seen")).alias("lo"), F.max(F.unix_micros("last_seen")).alias("hi")
    ).collect()  # a row per bucket
    reach = {r.bucket: (r.lo - gap * 1_000_000, r.hi + gap * 1_000_000) for r in spans}
    near = [m for m in live if m.bucket in reach and m.last_us >= reach[m.bucket][0] and m.first_us <= reach[m.bucket][1]]
    old = _rows(spark, schema, [m.path for m in near])
    touched, merged = merge_into_store(old, batch, gap)
    staged = f"{path}/staged/{version}"
    _placed(touched, buckets).write.mode("overwrite").parquet(f"{staged}/touched")
    _placed(merged, buckets).write.mode("overwrite").parquet(f"{staged}/merged")
    touched, merged = spark.read.parquet(f"{staged}/touched"), spark.read.parquet(f"{staged}/merged")
    changed = {(r.event_date, r.bucket) for r in touched.select(*_PLACE).union(merged.select(*_PLACE)).distinct().collect()}
    kept = [m for m in live if (m.event_date, m.bucket) not in changed]
    rewritten = _placed(_rows(spark, schema, [m.path for m in live if (m.event_date, m.bucket) in changed]), buckets)
    rest = rewritten.join(touched.select("host", "fingerprint", "id"), ["host", "fingerprint", "id"], "left_anti")
    content = rest.select(*STORE_COLUMNS, *_PLACE).unionByName(merged.select(*STORE_COLUMNS, *_PLACE))
    data = f"{path}/data/{version}"
    content.repartition(*_PLACE).sortWithinPartitions(*_PLACE, F.desc("score")).write.mode("overwrite").partitionBy(*_PLACE).parquet(data)
    about = content.groupBy(*_PLACE).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("first_seen")).alias("first_us"), F.max(F.unix_micros("last_seen")).alias("last_us")
    )
    where = F.concat(F.lit(f"{data}/event_date="), F.col("event_date").cast("string"), F.lit("/bucket="), F.col("bucket").cast("string"))
    about = about.select(*_PLACE, where.alias("path"), "n", "first_us", "last_us")
    if kept:
        about = about.unionByName(spark.createDataFrame(kept, about.schema))
    about.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{version}")
    files, place = _folder(spark, staged)
    files.delete(place, True)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete versions older than the last ``keep`` and the data folders that none of those uses; returns the number of folders."""
    known = versions(spark, path)
    if not known:
        return 0
    last = known[-keep:]
    used = {m.path.split("/event_date=")[0] for v in last for m in manifest(spark, path, v)}
    files, data = _folder(spark, f"{path}/data")
    old = [f"{path}/manifest/{v}" for v in known if v not in last]
    written = sorted(int(s.getPath().getName()) for s in files.listStatus(data))
    old += [f"{path}/data/{v}" for v in written if v <= last[-1] and f"{path}/data/{v}" not in used]
    for name in old:
        files, place = _folder(spark, name)
        files.delete(place, True)
    return len(old)
