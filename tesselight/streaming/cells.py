"""Cell counts of a stream: counts add up, so each micro-batch adds its own cells to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cube import cells


def maintain(stream: DataFrame, features: list[str], path: str, checkpoint: str, widest: int = 2) -> StreamingQuery:
    """Write each batch's cells below ``path``, one folder a batch: a batch run twice replaces its own."""

    def add(batch: DataFrame, number: int) -> None:
        cells(batch, features, widest).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, path: str) -> DataFrame:
    """The cells over all batches so far."""
    found = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return found.groupBy("schema_id", "d", "features", "cell").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
