"""The operators over their whole tables: ``(spark, sf_dir) -> DataFrame``."""

from pyspark.sql import DataFrame, SparkSession

from .centroids import cluster_vectors
from .chat import format_turns, read_back
from .embeddings import near_vectors
from .exact_dedup import exact_duplicates
from .hnsw import nearest_vectors
from .langid import identify_documents
from .licenses import scan_licenses
from .minhash import near_duplicates
from .mixing import mix_sizes
from .packing import pack
from .periods import periodic_runs, plant, summary
from .stages import staged
from .tables import table
from .toxicity import score_documents
from .warc import archived


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(staged(format_turns(rows.union(more)), "chat-segments"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(periodic_runs(plant(table(spark, sf_dir, "documents"))))


def op12_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_vectors(vectors, vectors.where("vec_id % 20 = 0"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    query.__name__: query
    for query in (op1_embeddings, op2_langid, op3_licenses, op4_mixing, op5_chat, op6_packing,
                  op7_minhash, op8_toxicity, op9_exact_dedup, op10_warc, op11_periods,
                  op12_hnsw, op13_centroids)
}
