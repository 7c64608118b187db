"""A training corpus from raw documents: five stages, each an operator of tastegrid.llm.

Each stage takes (spark, docs, sf_dir), where docs are the rows that the stage before
kept, and gives the rows that it keeps with the columns of documents; the last gives
packed pieces. Between two stages the rows lie as Parquet in the shared folder.
"""

from pyspark.sql import DataFrame, SparkSession

from tastegrid.llm.exact_dedup import drop_exact_duplicates
from tastegrid.llm.minhash import drop_near_duplicates
from tastegrid.llm.mixing import mix_documents
from tastegrid.llm.packing import pack
from tastegrid.llm.stages import staged
from tastegrid.llm.tables import table
from tastegrid.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a model of the labelled ones doesn't take for toxic."""
    return drop_toxic(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id."""
    return drop_exact_duplicates(docs, keep="max")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix of sources takes them: not at all, once or twice, the
    last of a source up to the word where its target is met."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids and sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# The fuzzy lexicon and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
