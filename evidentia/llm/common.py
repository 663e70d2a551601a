"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset and everything runs on this machine (local tests) is a folder
    of our own made; on a cluster an unset folder is an error, since no machine's own folder is shared.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.evidentia.shared.dir", None)
    if not found:
        if not (sc.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.evidentia.shared.dir", found)
        sc.setCheckpointDir(found)
    return found


def stored_at(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it back, with its path: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    return stored_at(df, name, codec)[0]


def forget(spark: SparkSession, path: str) -> None:
    """Delete what ``stored_at`` wrote, once nothing reads it any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(taken: list[str], name: str) -> str:
    """``name``, with underscores appended while a column is called that (in any case)."""
    names = {c.lower() for c in taken}
    while name.lower() in names:
        name += "_"
    return name


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def hash_sample(df: DataFrame, key: str, want: int, n: int | None = None, seed: int = 17) -> DataFrame:
    """A deterministic sample of about ``want`` rows, chosen by a hash of ``key``; all rows if there are no more."""
    n = df.count() if n is None else n
    if n <= want:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * want / n))
