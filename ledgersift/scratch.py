"""Tables that cut lineage: Parquet in the folder that all executors share.

``spark.checkpoint.dir`` names that folder on a cluster. Only where the session leaves it unset (tests,
a laptop) is a folder of our own made, and then everything runs on one machine.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_roots: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


@atexit.register
def _clean() -> None:
    """Delete this process's tables when it ends; a session that is gone leaves them to the folder's owner."""
    for spark, root in _roots:
        with suppress(Exception):
            _delete(spark, root)


def shared_folder(spark: SparkSession) -> str:
    """URI of the folder for intermediate tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir: on a cluster a local one would be seen by one machine alone")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="ledgersift-")
    return _own[app]


class Scratch:
    """A folder for the tables of one run."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/ledgersift/{label}-{uuid.uuid4().hex}"
        _roots.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        _delete(self.spark, self.path(name))
