"""What the training-data operators share: shared folders, blocks of text as bytes, words and their hashes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from threatlake.session import ensure_checkpoint_dir

BLOCK_BYTES = (1 << 20) - 1
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_OPEN: ContextVar[list[str] | None] = ContextVar("open", default=None)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside are deleted at the end, but for the lasting ones, which a lazy result still reads."""
    paths: list[str] = []
    before = _OPEN.set(paths)
    try:
        yield
    finally:
        _OPEN.reset(before)
        for path in paths:
            _delete(spark, path)


#: Spark then deletes a query's shuffle files as soon as its result is written, and not when the driver collects garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_SHUFFLES) if before is None else spark.conf.set(CLEAN_SHUFFLES, before)


def stored(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, with a short lineage, and
    its size is known to the planner. ``lasting`` tables survive the ``scratch`` block they are made in."""
    path = shared_path(df.sparkSession, name)
    paths = _OPEN.get()
    if paths is not None and not lasting:
        paths.append(path)
    with short_shuffles(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table_ in tables:
        _delete(table_.sparkSession, table_.stored_path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number that names one row, and the name of its column: the ``doc_id`` where no other row has it, and
    for rows without an id or with a repeated one a number above all ids."""
    key = free_name(docs, "_row")
    ids = docs.groupBy(F.col("doc_id").alias("_odd")).agg(F.count("*").alias("_n")).where("_odd IS NULL OR _n > 1")
    odd = stored(ids.select("_odd"), "odd", lasting=True)
    if odd.isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    top = docs.agg(F.max("doc_id")).first()[0] or 0
    same = docs["doc_id"].eqNullSafe(odd["_odd"])
    rest = docs.join(odd, same, "left_semi").withColumn(key, F.lit(top + 1).cast("long") + F.monotonically_increasing_id())
    rest = stored(rest, "repeated", lasting=True)
    return docs.join(odd, same, "left_anti").withColumn(key, F.col("doc_id").cast("long")).unionByName(rest), key


def text_of(column: str = "text") -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def part_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive rows of a string column as (first row, bytes, offsets), about ``limit`` bytes at a time.
    Every text is whole, however long."""
    column = column.cast(pa.large_string()).fill_null("")
    raw = column.buffers()
    ends = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        yield first, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


# --- words ------------------------------------------------------------------------------------------------------

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of the runs without white space, and the index of the first word of each text (one more at
    the end). A word never crosses two texts."""
    solid = ~WHITE[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    after = np.concatenate([solid[1:], [False]]) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | fresh[:-1]))
    ends = np.flatnonzero(solid & (~after | fresh[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit number over all others."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_RANDOM = np.random.Generator(np.random.PCG64(20240))
BYTE_VALUE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(int(_RANDOM.integers(1 << 61, 1 << 63)) | 1)
PLACE = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


@lru_cache(maxsize=2)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = U64(pow(int(BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[U64(1)], np.full(length, BASE, np.uint64)]))
        down = np.cumprod(np.concatenate([[U64(1)], np.full(length, inverse, np.uint64)]))
    return up, down


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64; ``span_hash`` reads the hash of any span off them."""
    up, _ = _powers(1 << max(12, int(len(data)).bit_length()))
    with np.errstate(over="ignore"):
        return np.concatenate([[U64(0)], np.cumsum(BYTE_VALUE[data] * up[: len(data)])])


#: A sum modulo a power of two can't tell some long strings apart, whatever its base; spans from this length on get a digest.
LONG_SPAN = 256


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray | None = None) -> np.ndarray:
    """Hashes of spans; with ``data``, those of long spans are digests of their bytes."""
    _, down = _powers(1 << max(12, int(len(prefix) - 1).bit_length()))
    with np.errstate(over="ignore"):
        out = mixed((prefix[ends] - prefix[starts]) * down[starts])
    if data is not None:
        for i in np.flatnonzero(ends - starts >= LONG_SPAN).tolist():
            digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=b"span").digest()
            out[i] = U64(int.from_bytes(digest, "little"))
    return out


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + c)`` for all pairs."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(total)
