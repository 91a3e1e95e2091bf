"""From raw documents to token files: quality, near duplicates, benchmark items, mixing, encoding.

Each stage is a function of (spark, docs, sf_dir) that works on all rows its predecessor kept; the result is written as
Parquet in the shared folder and read again as the next one's input, so a lost executor costs tasks of one stage and not
of those before it. All stages but the last return the columns of ``docs``.

Defined cases: rows without text count as empty; quality and decontamination judge every row by itself; in near duplicates and mixing, rows that repeat an id and
rows without one have keys of their own, so none is dropped or repeated for the other; columns of any other name are carried along; no
documents give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from threatlake.llm import cube_mix, decontaminate, jaccard_join, subword_quality, token_files
from threatlake.llm.common import free_name, keyed, shared_path, short_shuffles, stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier, fitted on their labels, does not reject."""
    return subword_quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked documents. Rows are told apart by a key of their own, so different texts under one
    id are judged each, and so are texts without an id."""
    rows, key = keyed(docs)
    groups = jaccard_join.jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"))
    kept = stored(groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept")), "kept")
    return rows.join(kept, rows[key] == kept["kept"], "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the sources meet their shares of the words. Each row has its own number of copies."""
    rows, key = keyed(docs)
    copies = cube_mix.mix(rows.select(F.col(key).alias("doc_id"), "source", "text")).where("copies > 0")
    copies = stored(copies.select(F.col("doc_id").alias(free_name(docs, "_unit")), F.col("copies").cast("int").alias(free_name(docs, "_copies"))), "copies")
    unit, number = copies.columns
    copy = free_name(docs, "_copy")
    joined = rows.join(copies, rows[key] == copies[unit])
    return joined.select(*docs.columns, F.explode(F.sequence(F.lit(1), number)).alias(copy)).drop(copy)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the documents to ORC files and returns what is read back from them."""
    return token_files.encode_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing),
    ("token_output", token_output),
]

#: The trained classifier is beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with short_shuffles(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
