"""Intermediate tables in the folder that every executor shares.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only where that
setting is absent and the master is local (tests, one machine) is a folder of this
process used; a cluster without the setting is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting: an execution's shuffle files go when the execution ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; also makes ``DataFrame.checkpoint`` usable."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="signweave-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


class Scratch:
    """Named Parquet tables of one run below the shared folder."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it again: lineage ends here, and with it the shuffle files."""
        schema, conf = df.schema, self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def bytes(self, name: str) -> int:
        """Written size of a table."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
