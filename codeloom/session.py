"""Session settings, table access and scratch tables that survive the loss of executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Settings that every operator relies on: results must not depend on the host's time zone, and plans are adapted at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int = 8, memory: str = "8g", app: str = "codeloom") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A stored table; only the columns that a plan uses are read."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineage: the cluster's ``spark.checkpoint.dir``; one of our own only where that is unset and all
    work is done by this machine. A cluster without it is an error, for its executors share no temporary folder."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        context.setCheckpointDir(named)
    return named


_ROOTS: list[str] = []


class Scratch:
    """Tables written to the shared folder, so that iterations neither recompute nor depend on one executor's disk.

    ``save`` writes a frame once and returns a frame that reads it; ``drop`` deletes what later rounds no longer read.
    """

    def __init__(self, spark: SparkSession, label: str = "work"):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)
        self._count = 0

    def save(self, frame: DataFrame) -> DataFrame:
        self._count += 1
        path = f"{self.root}/{self._count}"
        frame.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(frame.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def measured(self, frame: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
        """``save``, and figures over the rows that were gathered while they were written, without another job."""
        watch = Observation()
        kept = self.save(frame.observe(watch, *[value.alias(name) for name, value in figures.items()]))
        found = watch.get
        return kept, {name: found.get(name) or 0 for name in figures}

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path = getattr(frame, "_scratch_path", None)
            if path:
                jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def release(spark: SparkSession) -> None:
    """Deletes all scratch tables of this process. Results that were not written yet cannot be read after that."""
    while _ROOTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_ROOTS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
