"""The labelled rows that the two text classifiers learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import small_batches


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text is 1 modulo 3; false for a null id, whose row has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(order, label, text) of at most ``max_rows`` labelled rows that aren't held out, those of least id hash.

    Only the narrow ids are sorted for that.  At most ``max_rows`` of them reach the broadcast, which bounds
    it at 24 bytes a row; texts are read once and filtered in their scan.
    """
    small_batches(docs.sparkSession)
    ids = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("label").alias("label"))
        .withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(max_rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("order", "label", "text")


def scored_schema(base: DataFrame) -> T.StructType:
    """The columns of ``base`` with score and predicted after them."""
    return T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
