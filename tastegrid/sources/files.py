"""Folders of the shared store, by the file system that Spark itself uses for them."""

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, in order; hidden ones are left out."""
    store, place = _at(spark, path)
    if not store.exists(place):
        return []
    found = [s.getPath().getName() for s in store.listStatus(place) if s.isDirectory()]
    return sorted(name for name in found if name[0] not in "._")


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _at(spark, path)
    return store.exists(place)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    store, place = _at(spark, source)
    return store.rename(place, _at(spark, target)[1])


def make(spark: SparkSession, path: str) -> None:
    """The folder ``path`` and those above it, where they aren't there."""
    store, place = _at(spark, path)
    store.mkdirs(place)


def remove(spark: SparkSession, path: str) -> None:
    store, place = _at(spark, path)
    store.delete(place, True)


def put(df: DataFrame, path: str, **options) -> bool:
    """Write ``df`` as the Parquet folder ``path`` in one step: it is written under a hidden
    name beside it and then renamed, so that a reader finds all of it or nothing. A folder
    that is there stays as it is; the answer says whether this call has put it."""
    spark = df.sparkSession
    if exists(spark, path):
        return False
    above, name = path.rstrip("/").rsplit("/", 1)
    hidden = f"{above}/.{name}"
    df.write.mode("overwrite").options(**options).parquet(hidden)
    return rename(spark, hidden, path)
