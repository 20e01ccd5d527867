"""The daily worklist as a stream: candidates arrive in files, each day's budget is spent when the day is complete.

An extension beyond the batch run; under the same-day policy it picks exactly what `operators.worklist.select_alerts` picks. A day is complete
once a candidate of a later day has arrived, or on `close`. Work done so far is a table in the shared folder, so a restart goes on
where the last committed day ended; a batch that is replayed after a failure finds its days already there and adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgersift.operators.worklist import best
from ledgersift.scratch import Scratch

CANDIDATE = T.StructType([T.StructField("account", T.LongType()), T.StructField("day", T.TimestampType()), T.StructField("score", T.DoubleType()), T.StructField("is_mule", T.LongType()), T.StructField("exposure", T.DoubleType())])


class StreamingWorklist:
    """Spend ``capacity`` alerts a day on a stream of candidates."""

    def __init__(self, spark: SparkSession, capacity: int):
        self.spark, self.capacity = spark, capacity
        self.scratch = Scratch(spark, "stream")
        for name in ("waiting", "alerts"):
            spark.createDataFrame([], CANDIDATE).withColumn("batch", F.lit("none")).write.partitionBy("batch").mode("overwrite").parquet(self.scratch.path(name))

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(T.StructType([*CANDIDATE.fields, T.StructField("batch", T.StringType())])).parquet(self.scratch.path(name))

    def _append(self, rows: DataFrame, name: str, batch: int | str) -> None:
        rows.select(*CANDIDATE.fieldNames()).write.mode("overwrite").parquet(f"{self.scratch.path(name)}/batch={batch}")

    def _work(self, days: list, batch: int) -> None:
        for i, day in enumerate(days):
            opened = self._read("alerts").filter(F.col("day") < F.lit(day)).select("account")
            today = self._read("waiting").filter(F.col("day") == F.lit(day)).dropDuplicates(["account"]).join(opened, "account", "left_anti")
            picked = best(today, [], F.lit(self.capacity), self.capacity, self.scratch, f"ranked-{batch}-{i}")
            self._append(picked, "alerts", f"{batch}-{i}")

    def on_batch(self, rows: DataFrame, batch: int) -> None:
        self._append(rows, "waiting", batch)
        latest = rows.agg(F.max("day")).first()[0]
        if latest is not None:
            self._work(self._open_days(F.col("day") < F.lit(latest)), batch + 1)

    def _open_days(self, which) -> list:
        done = self._read("alerts").select("day").distinct()
        return sorted(r[0] for r in self._read("waiting").filter(which).select("day").distinct().join(done, "day", "left_anti").collect())

    def close(self) -> DataFrame:
        """Work the days that are left; returns all alerts."""
        self._work(self._open_days(F.lit(True)), 1_000_000)
        return self.alerts()

    def alerts(self) -> DataFrame:
        return self._read("alerts").drop("batch")

    def start(self, folder: str):
        """Watch a folder of Parquet files of candidates, oldest first."""
        stream = self.spark.readStream.schema(CANDIDATE).option("maxFilesPerTrigger", 1).parquet(folder)
        return stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", self.scratch.path("progress")).trigger(availableNow=True).start()
