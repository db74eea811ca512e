"""The index fed by a stream: items arrive as JSON lines, every batch makes a new version of all tables.

The caller names the folder of the tables and of the stream's checkpoint, so that a stream that is started again goes on
where it stopped. A batch that runs again finds its version finished and does nothing; one that broke off writes it anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import ingest
from codeloom.operators.logs import Log
from codeloom.operators.upkeep import SCHEMAS
from codeloom.sources import parsers
from codeloom.streaming.changes import Versions

#: One item a line: a file or asset as it is now, or the path of one that is gone. ``seq`` orders the items of one path.
ITEMS = (
    "kind string, path string, seq long, project string, module string, language string, mtime long, relative_path string, content string, "
    "name string, content_path string, folder string, extension string, asset_class string, parent_class string, _corrupt string"
)
ERRORS = "batch long, path string, kind string, error string"
TABLES = tuple(SCHEMAS)


def read_items(spark: SparkSession, folder: str, per_batch: int = 100) -> DataFrame:
    """A stream over the JSON-lines files of a folder, some files at a time. A line that is no JSON comes with ``_corrupt``."""
    return spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", per_batch).option("columnNameOfCorruptRecord", "_corrupt").json(folder)


def refused(items: DataFrame) -> DataFrame:
    """The items that cannot be processed, with the ``error``; the others are processed all the same."""
    kind, missing = F.col("kind"), lambda c: F.col(c).isNull()
    error = (
        F.when(F.col("_corrupt").isNotNull(), "no JSON object")
        .when(missing("kind") | ~kind.isin("file", "asset", "delete"), "unknown kind")
        .when(missing("path") | (F.trim("path") == ""), "path is missing")
        .when((kind == "file") & missing("project"), "project is missing")
        .when((kind == "file") & missing("language"), "language is missing")
        .when((kind == "asset") & missing("name"), "name is missing")
    )
    return items.withColumn("error", error)


class IndexStream:
    """The tables below ``root`` in versions, kept by a stream with its checkpoint in ``checkpoint``."""

    def __init__(self, spark: SparkSession, root: str, checkpoint: str, strict_mtime: bool = False):
        self.spark, self.root, self.checkpoint, self.strict_mtime = spark, root.rstrip("/"), checkpoint, strict_mtime
        self.versions = Versions(spark, self.root)

    def tables(self) -> dict[str, DataFrame]:
        """The tables of the last finished version; empty ones before the first."""
        now = self.versions.current()
        if now is None:
            return {n: self.spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
        return {n: self.spark.read.schema(s).parquet(f"{now[1]}/{n}") for n, s in SCHEMAS.items()}

    def errors(self) -> DataFrame:
        """What was refused so far: ``batch``, ``path``, ``kind``, ``error``; a batch that ran again is listed once."""
        return Log(self.spark, f"{self.root}/errors", ERRORS).read().distinct()

    def apply(self, items: DataFrame, batch: int) -> None:
        """One batch: the last item of each path counts, deletes go first. With ``strict_mtime`` a file whose time is older
        than the stored one is left alone; without it any other time replaces it."""
        now = self.versions.current()
        if now is not None and now[0] >= batch:
            return
        judged = refused(items)
        judged.where("error is not null").select(F.lit(batch).cast("long").alias("batch"), "path", "kind", "error").write.mode("append").parquet(f"{self.root}/errors")
        good = ingest.latest(judged.where("error is null").drop("error", "_corrupt").withColumn("seq", F.coalesce("seq", F.lit(0))), "path", ["seq"])
        tables = self.tables()
        files = good.where("kind = 'file'").select("path", "project", F.coalesce("module", "project").alias("module"), "mtime", "language", "relative_path", "content")
        if self.strict_mtime:
            stored = tables["files"].select("path", F.col("mtime").alias("_was"))
            files = files.join(stored, "path", "left").where(F.col("_was").isNull() | (F.col("mtime") >= F.col("_was"))).drop("_was")
        assets = good.where("kind = 'asset'").select("path", "name", "content_path", "folder", "project", "extension", "mtime", "asset_class", "parent_class")
        after = ingest.ingest(tables, files, assets, good.where("kind = 'delete'").select("path"), parsers.symbols)
        self.versions.write_all(batch, {n: after[n].select(*[f.split()[0] for f in SCHEMAS[n].split(", ")]) for n in TABLES})

    def run(self, stream: DataFrame) -> None:
        """Takes in what the stream has now."""
        query = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
