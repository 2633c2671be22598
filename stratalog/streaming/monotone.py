"""Monotone programs (no negation, aggregate or counter) over Structured Streaming.

More facts only add results of such a program, so what a micro-batch derives stays true. Each batch's facts go to a
folder named by its id, which makes a repeated batch harmless, and the outputs are evaluated over all facts so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine
from ..language import ast as A


class MonotoneProgram:
    def __init__(self, spark: SparkSession, text: str, relation: str, folder: str, outputs: list[str], **options):
        """``relation`` gets the stream's rows; ``folder`` keeps facts and, under the outputs' names, results."""
        self.spark, self.text, self.relation, self.folder, self.outputs, self.options = spark, text, relation, folder.rstrip("/"), outputs, options
        engine = Engine.from_source(text, spark, **options)
        for c in engine.program.clauses:
            for n in A.walk(c):
                if isinstance(n, (A.Negation, A.Aggregate, A.Counter)):
                    raise ValueError("only programs without negation, aggregates and counters are monotone")
        self.columns = [a.name for a in engine.relations[relation].attributes]

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        """For ``writeStream.foreachBatch``."""
        facts = f"{self.folder}/facts"
        batch.toDF(*self.columns).write.mode("overwrite").parquet(f"{facts}/batch={batch_id}")
        engine = Engine.from_source(self.text, self.spark, **self.options)
        engine.set_input(self.relation, self.spark.read.option("basePath", facts).parquet(facts).select(*self.columns))
        engine.run(self.outputs)
        for name in self.outputs:
            engine.df(name).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        engine.close()

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """A running query over ``stream``; ``trigger`` as for ``DataStreamWriter.trigger``."""
        writer = stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def result(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")
