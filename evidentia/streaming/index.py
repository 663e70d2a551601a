"""Incremental index maintenance as a stream: each micro-batch of cards updates the state table.

The state holds the latest hash of each (card, kind); a batch adds new keys, replaces changed ones and
leaves others alone. Deletions come as rows whose text is null. State versions are whole Parquet
folders numbered by batch, so a failed batch leaves the version before it in place and its retry
writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATE = "card_id long, kind string, hash string, batch long"


def upsert(state: DataFrame, batch: DataFrame, batch_id: int) -> DataFrame:
    """The state after one batch of (card_id, kind, text), the last row of a key winning."""
    new = batch.groupBy("card_id", "kind").agg(F.max(F.sha2("text", 256)).alias("hash"), F.count("text").alias("n")).select("card_id", "kind", F.when(F.col("n") > 0, F.col("hash")).alias("hash"), F.lit(batch_id).cast("long").alias("batch"), F.lit(1).alias("gen"))
    both = state.withColumn("gen", F.lit(0)).unionByName(new)
    w = Window.partitionBy("card_id", "kind").orderBy(F.desc("gen"))
    latest = both.withColumn("age", F.row_number().over(w)).withColumn("before", F.lead("hash").over(w)).withColumn("since", F.lead("batch").over(w)).where("age = 1 and hash is not null")
    return latest.select("card_id", "kind", "hash", F.when(F.col("hash") == F.col("before"), F.col("since")).otherwise(F.col("batch")).alias("batch"))


def maintain(cards: DataFrame, path: str) -> StreamingQuery:
    """Run over what is there and stop; ``cards`` streams (card_id, kind, text)."""
    spark = cards.sparkSession

    def each(batch: DataFrame, batch_id: int) -> None:
        upsert(current(spark, path, batch_id), batch, batch_id).write.mode("overwrite").parquet(f"{path}/state/{batch_id:09d}")

    return cards.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The newest state, or the newest one written before a batch."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    fs = root.getFileSystem(conf)
    found = sorted(s.getPath().getName() for s in fs.listStatus(root)) if fs.exists(root) else []
    done = [x for x in found if (before is None or int(x) < before) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/state/{x}/_SUCCESS"))]
    return spark.read.schema(STATE).parquet(f"{path}/state/{done[-1]}") if done else spark.createDataFrame([], STATE)
