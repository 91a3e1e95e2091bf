"""Byte counts for people."""

from pyspark.sql import functions as F

from threatlake.functions.text import size_label


def test_sizes_round_ties_to_even(spark):
    got = spark.createDataFrame([(1280,), (1331,), (1792,), (1310720,), (None,)], "n long").select(size_label(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == ["1.2 KB", "1.3 KB", "1.8 KB", "1.2 MB", None]
