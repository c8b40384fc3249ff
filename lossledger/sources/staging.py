"""Tables written once and read by many later steps."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lossledger.sources.sinks import write_table


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session: ``spark.checkpoint.dir``, else (local master only) one beside the warehouse.

    On a cluster the default warehouse may be a local path that executors do not share, so an unset
    checkpoint folder is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging").rstrip("/")


class Staging:
    """Materialises named tables under the checkpoint folder, each at most once.

    A written table survives lost executors, unlike cached blocks on their disks.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        """``root``: a folder that all executors share; by default the session's."""
        self.spark = spark
        self.root = f"{(root or checkpoint_root(spark)).rstrip('/')}/stage-{uuid.uuid4().hex}"
        self._tables: dict[str, DataFrame] = {}

    def table(
        self, name: str, build: Callable[[], DataFrame], partition_by: list[str] | None = None
    ) -> DataFrame:
        if name not in self._tables:
            path = f"{self.root}/{name}"
            self._tables[name] = write_table(build(), path, partition_by)
        return self._tables[name]

    def clear(self) -> None:
        """Deletes this object's tables (its own folder, nothing else)."""
        self._tables.clear()
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
