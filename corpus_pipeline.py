"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet in the shared folder and read again as the next stage's
``docs``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoframe.llm import exact_dedup, jaccard_join, langid, mixing, packing
from chronoframe.llm.common import stored_alone, table
from chronoframe.llm.queries import remainder
from chronoframe.session import ensure_checkpoint_dir, ship_package


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without an identifiable language (no text, or no
    letters); the automata learn from the labelled part of the stage's input."""
    model = langid.train(docs.where(remainder(5) != 0))
    return langid.identified(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text, the one with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group joined by word-shingle similarity."""
    return jaccard_join.drop_near_copies(docs, n=5, threshold=0.8, recall=0.99999)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until every source has its share."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of 1024 tokens: one row per piece."""
    return packing.pack_documents(docs, length=1024)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: suffix automata, min-hash runs and tokenisers are beyond SQL; tests/llm
#: holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        docs = stored_alone(lambda: stage(spark, before, sf_dir), name)  # noqa: B023
    return STAGES[-1][1](spark, docs, sf_dir)
