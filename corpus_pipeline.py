"""Documents to packed training sequences, in five stages.

Each stage takes all documents its predecessor kept, as a table, and returns documents with the
same columns; the last returns the pieces of the packed sequences.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordersight.llm.curriculum import mix_sources, training_order
from ordersight.llm.line_dedup import drop_common_lines
from ordersight.llm.ngram_join import keep_one_of_each
from ordersight.llm.packing import pack_pieces, token_pieces
from ordersight.llm.quality import keep_good
from ordersight.llm.queries import SCHEDULES
from ordersight.llm.store import stored

SEQUENCE = 2048


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from their texts."""
    dropped = drop_common_lines(docs)
    size = F.length("text").cast(docs.schema["n_chars"].dataType)
    return dropped.withColumn("n_chars", size).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time the mix takes a document, in training order."""
    return training_order(mix_sources(docs, schedules=SCHEDULES)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack_pieces(token_pieces(docs, tokenizer, SEQUENCE), SEQUENCE)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: The tokenizer's ids, and with them the packing, cannot be told in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
