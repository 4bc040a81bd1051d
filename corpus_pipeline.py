"""From raw documents to packed training sequences: quality, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents. Null and empty texts go at the first stage, as nothing can be said for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import mixing, near, packing, quality
from tracewright.llm.common import materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies within their language's quantiles."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.where("qc_kept").select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate class (five words, 0.8); of rows with one id, one row."""
    return near.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; repeats are rows."""
    return mixing.repeat_documents(mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids."""
    return packing.digests(packing.pack(docs, packing.tokenizer_file()))


STAGES = [("quality classifier", keep_good), ("near duplicates", keep_one_of_each), ("mixing", mix_sources), ("packing", pack_sequences)]
#: The tokenizer and the classifier have no SQL form; test_pipeline in tests/llm/test_queries.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
