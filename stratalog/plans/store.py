"""Relations as Parquet tables in the shared folder: one folder per increment, read together as one scan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import shared_dir


def local_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small literal frame, sent as Arrow, with no Python on the executors."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    table = pa.table({f.name: pa.array(list(c), kinds[f.dataType.simpleString()]) for f, c in zip(schema, columns)})
    return spark.createDataFrame(table, schema)


class Store:
    """A run's tables. Lineage ends at every table, so a lost executor costs at most the current round."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        base = root or shared_dir(spark)
        self.spark, self.root = spark, f"{base.rstrip('/')}/stratalog/run-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, name: str, parts: int | None = None) -> str:
        self.n += 1
        path = f"{self.root}/{name.replace('.', '_').strip()}-{self.n}"
        (df.coalesce(parts) if parts else df).write.parquet(path)
        return path

    def read(self, paths: list[str], schema: T.StructType) -> DataFrame:
        if not paths:
            return local_frame(self.spark, [], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop_all(self) -> None:
        self.delete(self.root)


class Table:
    """A set of tuples: paths of disjoint increments, and how many rows they hold."""

    COMPACT = 24

    def __init__(self, store: Store, name: str, schema: T.StructType):
        self.store, self.name, self.schema = store, name, schema
        self.paths: list[str] = []
        self.counts: list[int] = []
        self.view: DataFrame | None = None  # a plan that stands for the relation; it may repeat tuples
        self.is_set = True

    def lazily(self, view: DataFrame, is_set: bool) -> None:
        self.view, self.is_set = view, is_set

    @property
    def rows(self) -> int:
        """How many tuples; of a view an estimate from what Catalyst knows about its size."""
        if self.view is not None:
            size = int(str(self.view._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            return max(1, size // (16 * max(1, len(self.schema))))
        return sum(self.counts)

    def add(self, path: str, rows: int) -> None:
        if rows:
            self.paths.append(path)
            self.counts.append(rows)

    def df(self) -> DataFrame:
        return self.view if self.view is not None else self.store.read(self.paths, self.schema)

    def before_last(self, last: bool) -> DataFrame:
        """All but the newest increment."""
        return self.store.read(self.paths[:-1] if last else self.paths, self.schema)

    def newest(self) -> DataFrame:
        return self.store.read(self.paths[-1:], self.schema)

    def compact(self) -> None:
        """Older increments become one table, so that a scan lists few folders."""
        if len(self.paths) > self.COMPACT:
            old, kept = self.paths[:-1], self.paths[-1]
            path = self.store.write(self.store.read(old, self.schema), self.name)
            total = sum(self.counts[:-1])
            self.paths, self.counts = [path, kept], [total, self.counts[-1]]
            for p in old:
                self.store.delete(p)
