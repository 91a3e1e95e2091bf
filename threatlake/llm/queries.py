"""Registered queries of the training-data operators, each over its whole table, with check SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from threatlake.catalog.registry import Catalog
from threatlake.llm import (
    centroid_clusters, check_sql, cube_mix, decontaminate, hilbert_shards, html_density, jaccard_join, personal_data, pivot_search, repeats,
    subword_quality, token_alignment, token_counts, token_files,
)
from threatlake.llm.common import shared_path, table, text_of

catalog = Catalog()
query = catalog.query


@query("op1_token_counts")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Starts from an empty cache, so that each call counts every distinct text."""
    return token_counts.count_tokens(
        table(spark, sf, "documents"), shared_path(spark, "token-counts"), public_tokenizers.path("piece_bpe_32k.model")
    )


@query("op2_token_files")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.encode_round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_subword_quality")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return subword_quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op9_simhash_decontamination", check_sql.DECONTAMINATION)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that hold an item of the benchmark; all others are clean."""
    found = decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.where("contaminated")


@query("op10_jaccard_join", check_sql.JACCARD_COMPONENTS)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf, "documents"))


@query("op4_pivot_search", check_sql.INNER_PRODUCTS)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return pivot_search.search(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op5_bwt_repeats")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """``repeats`` says whether a document lost anything."""
    return repeats.remove_repeats(table(spark, sf, "documents")).withColumn("repeats", F.col("n_removed") > 0)


@query("op6_hilbert_shards")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Law: bytes. The curve runs over language, source and size."""
    dimensions = {
        "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string"),
        "magnitude": F.floor(8 * F.log2(F.octet_length(text_of()) + 1)).cast("int"),
    }
    return hilbert_shards.shard_documents(table(spark, sf, "documents"), dimensions)


@query("op7_cube_mix")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return cube_mix.mix(table(spark, sf, "documents")).drop("copies")


@query("op3_html_density")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return html_density.extract_main_text(table(spark, sf, "pages"))


@query("op11_centroid_clusters", check_sql.CENTROID_CLUSTERS)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    return centroid_clusters.cluster(table(spark, sf, "embeddings"))


@query("op12_personal_data")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data.personal_data(table(spark, sf, "documents"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment.align(table(spark, sf, "documents"), a, b)


@query("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)
