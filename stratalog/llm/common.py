"""Session helpers that the operators share: shared storage, checkpoints, worker paths, components.

Nothing here keeps state on one machine: what cuts lineage is a Parquet table under the folder that
``spark.checkpoint.dir`` names, which every executor can read again after a loss.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, shared_dir  # noqa: F401 - the operators take prepare from here


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stratalog/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there."""
    path = new_folder(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    # shuffle files of what was just written go when the driver's JVM drops its last reference to them
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that nothing will read any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc32_of_id(col="doc_id"):
    """crc32 of the id written as text, as a long column."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def components(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components by alternating large-star and small-star.

    ``edges`` holds undirected pairs of longs; the result has one row (node, component_id) for each node that
    occurs in an edge with another node, component_id being the smallest id reachable. Each round aggregates a
    minimum (combined on the map side, so a hub with very many neighbours sends few rows) and joins it back;
    the edges are written to the shared folder after each round. Null ends and loops are ignored.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").distinct()
    e = stored(spark, e, "edges")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()  # u > v in every row
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        last, e = e, stored(spark, small, "edges")
        discard(last)
        now = tuple(e.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(roots.select("node", F.col("node").alias("component_id")))
