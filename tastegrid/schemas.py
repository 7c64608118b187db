"""Table schemas shared by every job, and casts of a DataFrame to them."""

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    FloatType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

RATINGS = StructType([
    StructField("uid", IntegerType()),
    StructField("mid", IntegerType()),
    StructField("score", DoubleType()),
])

MOVIES = StructType([
    StructField("id", IntegerType()),
    StructField("movie_name", StringType()),
])

USERS = StructType([
    StructField("id", IntegerType()),
    StructField("username", StringType()),
])

FACTORS = StructType([
    StructField("id", IntegerType()),
    StructField("features", ArrayType(FloatType())),
])

RECOMMENDATION = StructType([
    StructField("mid", IntegerType()),
    StructField("score", DoubleType()),
])

USER_RECS = StructType([
    StructField("uid", IntegerType()),
    StructField("recs", ArrayType(RECOMMENDATION)),
])

# One row per item, or several for a very long list: ``start`` counts the entries
# of the list before this row.
MOVIE_RECS = StructType([
    StructField("mid", IntegerType()),
    StructField("start", IntegerType()),
    StructField("recs", ArrayType(RECOMMENDATION)),
])

# Ids joined with commas, best first.
SERVED_USER_RECS = StructType([
    StructField("uid", IntegerType()),
    StructField("midrecs", StringType()),
])

SERVED_REALTIME_RECS = StructType([
    StructField("uid", IntegerType()),
    StructField("mid", IntegerType()),
    StructField("recs", StringType()),
])

TUNING = StructType([
    StructField("rank", IntegerType()),
    StructField("reg", DoubleType()),
    StructField("rmse", DoubleType()),
])


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select the columns of ``schema`` by name, cast to its types."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
