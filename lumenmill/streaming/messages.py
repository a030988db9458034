"""The stateless steps on a stream: every message is cleaned, described and labelled alone, so
the batch functions run unchanged; reports are kept per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenmill.functions.text import normalise_native
from lumenmill.operators.rules import Scheme, classify
from lumenmill.operators.structural import structural_features
from lumenmill.operators.tokens import tokens

FIELDS = ["record_id", "from", "sender", "fromname", "url", "htmlurl", "attach", "domainrep", "subject", "content", "doccontent"]
SCHEMA = ", ".join(f"`{f}` string" for f in [*FIELDS, "timestamp"])


def read(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def labelled(messages: DataFrame, vocabulary: dict[str, list[str]], scheme: Scheme) -> DataFrame:
    """Messages (batch or stream) to record_id, timestamp, category, cluster_id, lang. No join
    and no shuffle: structural columns are computed beside the tokens."""
    joined = F.concat_ws(" ", "subject", "content", "doccontent")
    keep = {"tokens": tokens(normalise_native(joined)), "timestamp": F.col("timestamp")}
    features = structural_features(messages, keep)
    return classify(features, vocabulary, scheme).select("record_id", "timestamp", "category", "cluster_id", "lang")


def counts_by_window(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """category counts in event-time windows, with a watermark for late messages."""
    timed = stream.withColumn("ts", F.try_to_timestamp("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "category").agg(F.count(F.lit(1)).alias("count"))


def start(stream: DataFrame, sink: str, checkpoint: str, on_batch=None):
    """Append to JSON lines; with on_batch(df, id) also hand each batch to a report function."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    if on_batch is None:
        return writer.format("json").option("path", sink).outputMode("append").start()

    def both(df: DataFrame, batch_id: int) -> None:
        df.persist()
        df.write.mode("overwrite").json(f"{sink}/batch={batch_id}")
        on_batch(df, batch_id)
        df.unpersist()

    return writer.foreachBatch(both).start()
