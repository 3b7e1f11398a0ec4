"""The `requests` schema, and adapters from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MESSAGES = "array<struct<pos:int,role:string,content:string>>"
TOOLS = "array<struct<pos:int,name:string,schema_json:string>>"
REQUESTS = f"request_id bigint, ingest_seq bigint, source string, model string, completion string, weight bigint, messages {MESSAGES}, tools {TOOLS}, tools_called array<string>"


def as_requests(df: DataFrame) -> DataFrame:
    """Completes a frame that has ingest_seq and messages to the requests schema."""
    given = set(df.columns)
    filled = {
        "request_id": F.col("ingest_seq"), "source": F.lit("<unknown>"), "model": F.lit(None), "completion": F.lit(None),
        "weight": F.lit(1), "tools": F.array(), "tools_called": F.array(),
    }
    cols = []
    for field in ("request_id bigint", "ingest_seq bigint", "source string", "model string", "completion string", "weight bigint"):
        name, kind = field.split()
        cols.append((F.col(name) if name in given else filled[name]).cast(kind).alias(name))
    for name, kind in (("messages", MESSAGES), ("tools", TOOLS), ("tools_called", "array<string>")):
        cols.append((F.col(name) if name in given else filled[name]).cast(kind).alias(name))
    return df.select(cols)


def from_conversations(conversations: DataFrame) -> DataFrame:
    """A request for each assistant turn that follows others: all earlier turns are sent again."""
    earlier = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.struct(F.col("turn").cast("int").alias("pos"), F.lower("role").alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    sent = conversations.withColumn("messages", F.filter(F.collect_list(turn).over(earlier), lambda m: m["content"] != ""))
    calls = sent.where((F.lower("role") == "assistant") & (F.size("messages") > 0))
    return as_requests(
        calls.select(
            (F.col("conv_id") * 100000 + F.col("turn")).alias("ingest_seq"),
            F.concat(F.lit("conversations:"), F.col("conv_id").cast("string")).alias("source"),
            F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("model"),
            F.col("text").alias("completion"),
            "messages",
        )
    )


def from_documents(docs: DataFrame, role: str = "system", blank: bool = False) -> DataFrame:
    """Each text that isn't blank is a template of one message, with `blank` each that isn't null; its
    source stands for the model."""
    message = F.array(F.struct(F.lit(0).alias("pos"), F.lit(role).alias("role"), F.col("text").alias("content")))
    rows = docs.where(F.col("text").isNotNull() if blank else F.col("text").rlike(r"[^\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"))
    return as_requests(rows.select(F.col("doc_id").alias("ingest_seq"), F.concat(F.lit("documents:"), F.col("doc_id").cast("string")).alias("source"), F.col("source").alias("model"), message.alias("messages")))
