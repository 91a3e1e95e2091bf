"""Shards as runs of a Hilbert curve over several metadata columns.

Each dimension is quantised by the cumulative share of its values, so that a level holds about as many documents as
any other; the levels of all dimensions give a position on the Hilbert curve. Documents are sorted along it and the order
is cut where the bytes are equal. Documents near each other on the curve agree in all dimensions, so a shard has a
narrow range in each, and a reader that filters by any of them skips files.

Equal texts share the metadata of their first copy and so lie side by side; a cut that would fall inside such a group
moves to its nearer edge, unless the group is larger than ``GROUP_SHARE`` of a shard.

The order is made by range partitioning on position, text and id, so a group of copies or a frequent position spreads over
partitions; places follow from the partitions' totals. The driver sees one number per cut.

Defined cases: a null text has no bytes and counts 1; null metadata is a value of its own, below all others; rows that repeat a
``doc_id`` all get slots; other columns of the input are ignored; no documents give no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from threatlake.llm.common import stored, text_of

SHARDS = 16
LEVEL_BITS = 6
GROUP_SHARE = 1 / 64


def hilbert_index(levels: np.ndarray, bits: int) -> np.ndarray:
    """Position of points (one row each, one column per dimension) on the Hilbert curve, by the transposed form: the
    levels' bits are exchanged and inverted from the top down, Gray-coded, and interleaved."""
    x = levels.astype(np.int64).T.copy()
    dims = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[dims - 1] & q, q - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out


def levelled(rows: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_level``: the share of rows with smaller values, in 2 ** LEVEL_BITS steps."""
    counts = rows.groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    below = W.orderBy(F.col("_value").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    place = F.coalesce(F.sum("_n").over(below), F.lit(0)) / F.sum("_n").over(W.partitionBy())
    levels = stored(counts.select("_value", F.floor(place * (1 << LEVEL_BITS)).cast("int").alias(f"{column}_level")), "levels")
    return rows.join(levels, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


@F.pandas_udf(T.LongType())
def _curve(levels: pd.DataFrame) -> pd.Series:
    return pd.Series(hilbert_index(levels.to_numpy(), LEVEL_BITS))


def along_curve(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Add ``curve``, the position on the Hilbert curve over the dimensions."""
    for column in dimensions:
        rows = levelled(rows, column)
    return rows.withColumn("curve", _curve(F.struct(*[f"{c}_level" for c in dimensions])))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Sort rows globally and add ``place`` (rows before) and ``start`` (sizes before)."""
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    rows = stored(rows.withColumn("_id", number).withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND((1 << 33) - 1)}), "placed")
    parts = rows.groupBy("_part").agg(F.count("*").alias("_rows"), F.sum("size").alias("_bytes"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        F.col("_part").alias("_of"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_rows", "_bytes")],
    )
    inside = W.partitionBy("_part").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(parts, F.col("_part") == F.col("_of")).select(
        "doc_id", "size", "text_crc32", "digest",
        (F.col("_rows_before") + F.col("_row")).alias("place"), (F.col("_bytes_before") + F.col("_inside")).alias("start"),
    )


def _cuts(rows: DataFrame, shards: int) -> list[int]:
    """Starts of the shards but the first, in bytes: at most ``shards - 1`` numbers."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    wanted = [k * total // shards for k in range(1, shards)]
    hit = reduce(lambda a, b: a | b, [(F.col("start") <= c) & (F.col("start") + F.col("size") > c) for c in wanted], F.lit(False))
    at = rows.where(hit).select("digest").distinct()
    groups = rows.join(F.broadcast(at), "digest").groupBy("digest").agg(  # at most one group for each cut
        F.min("start").alias("low"), F.sum("size").alias("bytes"), F.max("size").alias("size")
    ).collect()
    cuts = []
    for c in wanted:
        group = next((g for g in groups if g.low <= c < g.low + g.bytes), None)
        if group is not None:
            # a copy is the unit inside a large group, the group itself otherwise
            unit = group.bytes if group.bytes <= GROUP_SHARE * total / shards else group.size
            c = group.low + (c - group.low + unit // 2) // unit * unit
        cuts.append(c)
    return cuts


def shard_documents(docs: DataFrame, dimensions: dict[str, Column], shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs``. ``dimensions`` name the
    metadata the curve runs over."""
    text = text_of()
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("digest"), F.struct(*[c.alias(n) for n, c in dimensions.items()]).alias("meta"),
    )
    heads = stored(rows.groupBy("digest").agg(F.min(F.struct("doc_id", "meta")).alias("head"), F.first("size").alias("size")), "heads")
    heads = heads.select("digest", "size", *[F.col(f"head.meta.{n}").alias(n) for n in dimensions])
    heads = stored(along_curve(heads, list(dimensions)).select("digest", "curve"), "curve")
    rows = rows.drop("meta").join(heads, "digest")
    rows = stored(placed(rows, ["curve", "digest", "doc_id"]), "places")
    cuts = _cuts(rows, shards)
    shard = reduce(lambda a, b: a + b, [(F.col("start") >= c).cast("int") for c in cuts], F.lit(0))
    rows = rows.withColumn("shard", shard)
    firsts = rows.groupBy("shard").agg(F.min("place").alias("_first"))  # one row for each shard
    return rows.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
