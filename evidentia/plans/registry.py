"""All registered queries of the engine with their equivalent SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidentia.functions.dialect import DUCK, SPARK, Pipe
from evidentia.plans import python_queries, sql_queries
from evidentia.session import materialise

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """Text work is heavy for its bytes: a table of fewer partitions than the cluster has cores is dealt out over them; larger ones stay as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df._jdf.queryExecution().toRdd().getNumPartitions() < n else df


def run_pipe(spark: SparkSession, sf_dir: str, pipe: Pipe, final: str) -> DataFrame:
    """Run a pipe's relations, each analysed once as a DataFrame; the views of this run go when it is built."""
    text, run = " ".join([*pipe.parts.values(), final]), uuid.uuid4().hex[:8]
    names = {t: f"{t}_{run}" for t in (*TABLES, *pipe.parts)}
    words = re.compile(r"\b(from|join)(\s+)(" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")\b")
    own = lambda sql: words.sub(lambda m: f"{m[1]}{m[2]}{names[m[3]]} as {m[3]}" if not re.match(r"\s+(?:as\s+)?(?!join\b|on\b|where\b|group\b|order\b|lateral\b|left\b|cross\b|union\b|window\b|inner\b)[a-z]\w*", sql[m.end() :]) else f"{m[1]}{m[2]}{names[m[3]]}", sql)
    made = []
    try:
        for t in TABLES:
            if t not in pipe.parts and re.search(rf"\b(?:from|join)\s+{t}\b", text):
                df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
                (spread(df) if t == "documents" else df).createOrReplaceTempView(names[t])
                made.append(names[t])
        for k, sql in pipe.parts.items():
            df = pipe.made[k](lambda n: spark.table(names[n])) if k in pipe.made else spark.sql(own(sql))
            if k in pipe.kept:
                df = materialise(df, k)
            df.createOrReplaceTempView(names[k])
            made.append(names[k])
        return spark.sql(own(final))
    finally:
        for v in made:
            spark.catalog.dropTempView(v)


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_pipe(spark, sf_dir, *sql_queries.QUERIES[name](SPARK))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search: full text and vectors, fused, reranked and gated."""
    return run(spark, sf_dir, "hybrid_search")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {k: (lambda spark, sf_dir, k=k: run(spark, sf_dir, k)) for k in sql_queries.QUERIES}
    return found | python_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    out = {}
    for k, build in sql_queries.QUERIES.items():
        pipe, final = build(DUCK)
        out[k] = pipe.sql(final)
    return out
