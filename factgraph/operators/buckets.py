"""Tables on disk in buckets of their key's hash: an insert or upsert reads and writes the buckets of its keys and no others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from .tables import new_rows, upsert

#: Buckets of a new table; the number is kept with it.
BUCKETS = 256


def _bucket(keys: list[str], buckets: int) -> Column:
    """Rows with a null key meet no other; they lie in a bucket of their own, -1."""
    none = F.lit(False)
    for k in keys:
        none = none | F.col(k).isNull()
    return F.when(none, -1).otherwise(F.pmod(F.xxhash64(*keys), F.lit(buckets))).cast("int")


def create(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Write ``df`` as a new table in buckets; each is one task's, so that a bucket has one file."""
    df.sparkSession.createDataFrame([(buckets, keys)], "buckets int, keys array<string>").write.mode("overwrite").json(f"{path}/layout")
    dealt = df.withColumn("__bucket", _bucket(keys, buckets)).repartition("__bucket")
    dealt.write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/rows")


def _layout(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    row = spark.read.schema("buckets int, keys array<string>").json(f"{path}/layout").first()
    return row["buckets"], row["keys"]


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("__bucket")


def _met(spark: SparkSession, path: str, incoming: DataFrame) -> tuple[DataFrame, DataFrame, list[str], Column]:
    """(the table's rows in the buckets that ``incoming`` has keys of, ``incoming`` staged, keys, bucket): partition pruning leaves the other buckets alone."""
    buckets, keys = _layout(spark, path)
    fresh = staged(incoming, "incoming")
    touched = [r[0] for r in fresh.select(_bucket(keys, buckets)).distinct().collect()]  # the table's number of buckets at most
    old = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").where(F.col("__bucket").isin(touched)).drop("__bucket")
    return old, fresh, keys, _bucket(keys, buckets)


def upsert_into(spark: SparkSession, path: str, incoming: DataFrame, replace: list[str], keep: list[str], order: list[Column]) -> None:
    """As ``tables.upsert``, in place: the buckets of incoming keys are merged, written aside, and put in place of the old ones.

    A call that fails before the last step leaves the table as it was; one that is made again gives the same table, but
    for rows with a null key, which are new each time.
    """
    old, fresh, keys, bucket = _met(spark, path, incoming)
    merged = staged(upsert(old, fresh, keys, replace, keep, order).withColumn("__bucket", bucket), "merged")
    merged.repartition("__bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(f"{path}/rows")


def insert_into(spark: SparkSession, path: str, incoming: DataFrame, order: list[Column]) -> None:
    """As ``tables.insert_ignore``, in place: of the buckets of incoming keys only the keys are read, and new rows are added to them."""
    old, fresh, keys, bucket = _met(spark, path, incoming)
    added = new_rows(old.select(*keys), fresh, keys, order).select(*old.columns)
    staged(added.withColumn("__bucket", bucket), "added").repartition("__bucket").write.mode("append").partitionBy("__bucket").parquet(f"{path}/rows")
