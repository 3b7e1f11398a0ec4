"""Token accounts of a request log that grows: the same functions over a stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import framed, token_count
from ..sources.records import from_records


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """(ingest_seq, source, record) of log lines that arrive in a folder."""
    raw = spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("source"))
    return raw.select(F.xxhash64("source", "value").alias("ingest_seq"), "source", F.col("value").alias("record"))


def accounts(stream: DataFrame) -> DataFrame:
    """Running (model, calls, input_tokens, output_tokens); use output mode complete or update."""
    r = from_records(stream)
    return r.groupBy("model").agg(F.sum("weight").alias("calls"), F.sum(framed(F.col("messages")) * F.col("weight")).alias("input_tokens"), F.sum(token_count("completion") * F.col("weight")).alias("output_tokens"))
