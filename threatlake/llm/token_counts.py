"""Token counts through a cache of digests.

The cache is a table of ``(tokenizer, digest, n_tokens)``: the SHA-256 of the tokenizer file and of the normalised
content, and the count. Counting joins the documents' digests to it; only distinct contents without an entry are
encoded, and their counts are appended. A second count of the same or mostly the same corpus encodes next to nothing, and another
version of the tokenizer never reads counts of this one.

Normalising means that null becomes the empty text; the tokenizer's own normalisation decides everything else, so a
cached count is exactly the count of the text.

Appends are Spark writes, committed as a whole, so a lost executor or a failed job leaves the cache as it was. One
writer at a time.

Defined cases: a null text has no bytes and no tokens; equal texts share one encoding; rows that repeat a ``doc_id`` are
all returned; other columns of the input are ignored; no documents give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from threatlake.llm.common import text_of

CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"
ENCODED_TOGETHER = 64


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from texts to their numbers of tokens, without added tokens."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda texts: [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count = counter(path)
    for batch in batches:
        texts, counts = batch.column("text"), []
        for at in range(0, batch.num_rows, ENCODED_TOGETHER):
            counts += count(texts.slice(at, ENCODED_TOGETHER).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Entries of one tokenizer version; empty where nothing has been cached yet."""
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    return cache.where(F.col("tokenizer") == version).select("digest", "n_tokens")


def fill_cache(docs: DataFrame, cache_path: str, tokenizer_path: str) -> None:
    """Encode each distinct content that the cache doesn't know and append the counts."""
    version = tokenizer_digest(tokenizer_path)
    texts = docs.select(text_of().alias("text")).withColumn("digest", content_digest(F.col("text")))
    cached = read_cache(docs.sparkSession, cache_path, version)
    distinct = texts.groupBy("digest").agg(F.first("text").alias("text"))  # before the join: copies meet in their own task first
    misses = distinct.join(cached, "digest", "left_anti")
    counted = misses.mapInArrow(partial(_count, path=tokenizer_path), "digest binary, n_tokens long")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``."""
    fill_cache(docs, cache_path, tokenizer_path)
    cached = read_cache(docs.sparkSession, cache_path, tokenizer_digest(tokenizer_path))
    text = text_of()
    keyed = docs.select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), content_digest(text).alias("digest")
    )
    return keyed.join(cached, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
