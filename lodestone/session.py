"""Session settings, table access and shared scratch tables."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

#: Used only where spark.checkpoint.dir is unset, as on one machine in tests.
LOCAL_SCRATCH = "/tmp/checkpoints/lodestone"


def session(master: str = "local[*]", app: str = "lodestone", **conf: str) -> SparkSession:
    """A session with this library's settings; keyword names use __ for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under sf_dir; only Spark's reader opens it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; without a cluster, a local one will do."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return (named or LOCAL_SCRATCH).rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends this package to the workers, unless they find it where the driver does."""
    folder = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if folder in map(os.path.abspath, filter(None, found)) or getattr(spark.sparkContext, "_lodestone_sent", False):
        return
    zipped = os.path.join(tempfile.mkdtemp(), "lodestone.zip")
    with zipfile.ZipFile(zipped, "w") as z:
        for top, _, names in os.walk(os.path.join(folder, "lodestone")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    z.write(path, os.path.relpath(path, folder))
    spark.sparkContext.addPyFile(zipped)
    spark.sparkContext._lodestone_sent = True


class Scratch:
    """Tables in the shared folder that cut lineage and survive lost executors.

    A written table is whole once its job has ended, so tasks that run again
    read what the first run wrote, whatever partitioning they see.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
        self._count = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            conf = self.spark._jsparkSession.sessionState().newHadoopConf()
            path.getFileSystem(conf).delete(path, True)

    def clear(self) -> None:
        """Deletes all of its tables."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def settle(self) -> None:
        """Lets Spark remove the shuffle files of steps that are done: those whose plans nothing holds any more."""
        gc.collect()
        self.spark._jvm.System.gc()
