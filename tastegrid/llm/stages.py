"""Steps of a job written to the shared folder and read back from there."""

from pyspark.sql import DataFrame

from ..session import fresh_path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as files of the shared folder: what follows survives a lost executor, and
    is planned by their measured size. Zstandard keeps no direct buffers, which many
    small files would otherwise leave behind in an executor's memory."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
