"""Corpus preparation: filter, dedup, mix and encode documents, one operator of ``llm`` a stage.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame that a caller may write
as Parquet and give to the next. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaugewise.llm import bpe, graycopies, lines, mixing, quality, simhash
from gaugewise.llm.common import stored, stored_last, table

#: The stages hash texts and judge them by statistics of the corpus; SQL has no XXH64.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the form rules or fall below the n-gram threshold go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites stay in one document only; every document stays."""
    return lines.without_boilerplate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word Jaccard of 0.8 or more, by SimHash in the Gray-order index) stays."""
    return simhash.keep_first(docs, graycopies.grouped(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix uses it."""
    return mixing.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every row."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the stages wrote on the way is removed once they are stored."""

    def last() -> DataFrame:
        docs = table(spark, sf_dir, "documents")
        for number, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if number < len(STAGES) - 1:
                docs = stored(docs, f"stage-{number}")
        return docs

    return stored_last(last, spark, "pipeline")
