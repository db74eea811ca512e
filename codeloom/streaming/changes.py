"""Streams: file changes kept as a current state, running counts, and event-time windows."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import patches
from codeloom.session import Scratch, shared_folder


class Versions:
    """A table in versions: each batch writes a new one and then names it current, in one small file. A batch that runs
    again writes its version again; readers see the last version that was finished."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def current(self) -> tuple[int, str] | None:
        fs, p = self._fs(f"{self.root}/done")
        if not fs.exists(p):
            return None
        done = max(int(s.getPath().getName()) for s in fs.listStatus(p))
        return done, f"{self.root}/v{done}"

    def read(self) -> DataFrame | None:
        now = self.current()
        return self.spark.read.parquet(now[1]) if now else None

    def write(self, batch: int, frame: DataFrame) -> None:
        frame.write.mode("overwrite").parquet(f"{self.root}/v{batch}")
        self._finish(batch)

    def write_all(self, batch: int, frames: dict[str, DataFrame]) -> None:
        """Several tables that become current together."""
        for name, frame in frames.items():
            frame.write.mode("overwrite").parquet(f"{self.root}/v{batch}/{name}")
        self._finish(batch)

    def _finish(self, batch: int) -> None:
        fs, p = self._fs(f"{self.root}/done/{batch}")
        fs.create(p, True).close()
        old, q = self._fs(f"{self.root}/v{batch - 2}")
        if batch >= 2 and old.exists(q):
            old.delete(q, True)


class State(Versions):
    """Keyed state in versions: its rows are spread over buckets by the hash of their key, and a batch writes only the buckets
    that its keys fall into. The file that names a version current says in which version each bucket was last written."""

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...], buckets: int = 256):
        super().__init__(spark, root)
        self.keys, self.buckets = keys, buckets

    def places(self) -> dict[int, int]:
        """The version in which each bucket was last written, as of the last finished batch."""
        now = self.current()
        if now is None:
            return {}
        fs, p = self._fs(f"{self.root}/done/{now[0]}")
        stream = fs.open(p)
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return {int(b): v for b, v in json.loads(text).items()}

    def _read(self, places: dict[int, int]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.root}/v{v}/_bucket={b}" for b, v in sorted(places.items())]) if places else None

    def read(self) -> DataFrame | None:
        return self._read(self.places())

    def merge(self, batch: int, own: DataFrame, combine) -> None:
        """Brings a batch's rows into the state: ``combine`` makes one row per key of old and new rows."""
        own = own.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        own = Scratch(self.spark, "batch").save(own)
        touched = [r[0] for r in own.select("_bucket").distinct().collect()]  # at most one per bucket
        places = self.places()
        old = self._read({b: v for b, v in places.items() if b in set(touched)})
        new = own.drop("_bucket")
        merged = combine(new if old is None else old.unionByName(new))
        merged = merged.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        if touched:
            merged.repartition(F.col("_bucket")).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/v{batch}")
        after = places | dict.fromkeys(touched, batch)
        fs, p = self._fs(f"{self.root}/new-{batch}")
        out = fs.create(p, True)
        out.writeBytes(json.dumps(after))
        out.close()
        done_fs, done = self._fs(f"{self.root}/done/{batch}")
        done_fs.mkdirs(done.getParent())
        done_fs.delete(done, False)
        done_fs.rename(p, done)
        # What neither this version nor the one before it reads is deleted.
        before = set(places.items())
        for b, v in self._forgotten:
            if (b, v) not in before and after.get(b) != v:
                old_fs, gone = self._fs(f"{self.root}/v{v}/_bucket={b}")
                old_fs.delete(gone, True)
        self._forgotten = [(b, v) for b, v in places.items() if after[b] != v]

    _forgotten: list[tuple[int, int]] = []


def read_stream(spark: SparkSession, path: str, per_batch: int = 4) -> DataFrame:
    """A stream over the files of a stored table, a few files at a time."""
    schema = spark.read.parquet(path).schema
    folder, glob = (path, "*.parquet") if _is_folder(spark, path) else path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", glob).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _made(spark: SparkSession, folder: str) -> str:
    """The folder, made if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(p)
    return folder


def _run(stream: DataFrame, each, folder: str | None, mode: str = "append") -> None:
    place = f"{folder.rstrip('/')}/checkpoint" if folder else f"{shared_folder(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", place).trigger(availableNow=True).start()
    query.awaitTermination()


def _state(spark: SparkSession, folder: str | None, label: str, *keys: str) -> State:
    return State(spark, f"{folder.rstrip('/')}/state" if folder else Scratch(spark, label).root, keys)


def maintain_state(changes: DataFrame, folder: str | None = None) -> DataFrame:
    """The composed patch of each path after all of a stream of file changes. Each batch is composed in itself and then
    with the state so far: composition is associative, so batches may bring changes late, again or out of order.
    ``folder`` holds state and checkpoint: a stream that is started again with it goes on where it stopped. Without it the
    stream is read from its beginning."""
    spark = changes.sparkSession
    versions = _state(spark, folder, "state", "path_lower")

    def each(batch: DataFrame, number: int) -> None:
        now = versions.current()
        if now and now[0] >= number:
            return
        versions.merge(number, patches.composed(batch), lambda rows: patches.compose(rows, "path_lower"))

    _run(changes, each, folder)
    state = versions.read()
    return patches.composed(spark.createDataFrame([], changes.schema)) if state is None else state


def running_counts(stream: DataFrame, *keys: str, folder: str | None = None) -> DataFrame:
    """Counts per key, kept up to date by a stream; the latest of each key. ``folder`` as in ``maintain_state``."""
    spark = stream.sparkSession
    versions = _state(spark, folder, "counts", *keys)

    def each(batch: DataFrame, number: int) -> None:
        now = versions.current()
        if now and now[0] >= number:
            return
        versions.merge(number, batch.groupBy(*keys).agg(F.count("*").alias("n")), lambda rows: rows.groupBy(*keys).agg(F.sum("n").alias("n")))

    _run(stream, each, folder)
    counts = versions.read()
    return spark.createDataFrame([], stream.schema).groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 day") -> DataFrame:
    """Counts per window of event time and key, over all rows of a stream however late they come: the counts of each batch
    are added to those so far, as in ``running_counts``. Rows without a time are in no window."""
    return running_counts(stream.select(F.window(F.col(time).cast("timestamp"), width)["start"].alias("start"), key), "start", key)


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "60 days") -> DataFrame:
    """Sessions per key: runs of events less than a gap apart, with their first time, end and number of events. A session
    comes out when the watermark has passed its end; over a frame that is no stream, all come out."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark("_t", late)
    return timed.groupBy(F.session_window("_t", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def last_events(batch: DataFrame) -> DataFrame:
    """The last event of each path in a batch by arrival: ``path_lower``, ``op``."""
    order = F.struct("received_at", "delivery_id")
    return batch.where("path is not null").groupBy(patches.same_path(F.col("path")).alias("path_lower")).agg(F.max_by(F.lower("op"), order).alias("op"))
