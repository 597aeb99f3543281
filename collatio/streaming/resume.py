"""New transcriptions as they arrive: each run takes the files that no run before has taken."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalize_udf


def normalize_new(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """JSON lines of (experiment, model, file, text) under source to normalised Parquet under target; ends when all that is there is done."""
    rows = spark.readStream.schema("experiment string, model string, file string, text string").json(source)
    out = rows.withColumn("text", normalize_udf(F.coalesce("text", F.lit(""))))
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).partitionBy("experiment", "model").trigger(availableNow=True).start()
