"""Figures over the logs of queries and tool calls."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators.skew import range_scan
from codeloom.session import Scratch


def query_log(events: DataFrame) -> DataFrame:
    """Events as a query log: ``id``, ``timestamp``, ``method``, ``args``, ``duration_ms``, ``result_count``."""
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("method"), F.col("props").alias("args"),
        F.col("value").alias("duration_ms"), (F.get_json_object("props", "$.k").cast("int") % 5).alias("result_count"),
    )


def tool_log(events: DataFrame) -> DataFrame:
    """Events as a log of tool calls: ``id``, ``timestamp``, ``tool_name``, ``duration_ms``, ``result_size``, ``session_id``."""
    return events.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("tool_name"), F.col("value").alias("duration_ms"),
        F.length("props").alias("result_size"), F.col("user_id").cast("string").alias("session_id"),
    )


def by_method(log: DataFrame) -> DataFrame:
    return log.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.max("duration_ms").alias("max_ms"))


def slowest(log: DataFrame, n: int = 10) -> DataFrame:
    order = [F.col("duration_ms").desc(), F.col("id")]
    return log.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "id", "method", "args", "duration_ms", "result_count")


def without_result(log: DataFrame, n: int = 20) -> DataFrame:
    """The calls that found nothing, by method and arguments: how often and when last; the most frequent first."""
    groups = log.where("result_count = 0").groupBy("method", "args").agg(F.count("*").alias("n"), F.max("timestamp").alias("last"))
    order = [F.col("n").desc(), F.col("method"), F.col("args")]
    return groups.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def listing(log: DataFrame, limit: int = 100, min_ms: float = 0.0, since=None, **equal) -> DataFrame:
    """The latest calls that meet the filters, by time and id."""
    rows = log.where(F.col("duration_ms") >= min_ms)
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    if since is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(since).cast("timestamp"))
    order = [F.col("timestamp").desc(), F.col("id").desc()]
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def by_tool(log: DataFrame) -> DataFrame:
    return log.groupBy("tool_name").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.max("duration_ms").alias("max_ms"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


def by_session(log: DataFrame, n: int = 20) -> DataFrame:
    groups = log.where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("first_call"), F.max("timestamp").alias("last_call"))
    order = [F.col("last_call").desc(), F.col("session_id")]
    return groups.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def overall(log: DataFrame) -> DataFrame:
    """The mean over all methods, weighted by their calls, and the longest call."""
    return by_method(log).agg(F.round(F.sum(F.col("mean_ms") * F.col("n")) / F.sum("n"), 4).alias("mean_ms"), F.max("max_ms").alias("max_ms"))


def latencies(log: DataFrame) -> DataFrame:
    """Per method the smallest, largest and mean time and exact percentiles: the value at place floor(share * n) of the
    times in order. Equal times are counted first; the places come from a sorted scan that splits a method with very
    many different times over partitions."""
    counted = log.groupBy("method", "duration_ms").agg(F.count("*").alias("k"))
    scanned = range_scan(counted, ["method"], ["duration_ms"], Scratch(log.sparkSession, "latencies"), sums=["k"])
    placed = scanned.withColumn("upto", F.col("_sum_k") + F.col("k")).join(log.groupBy("method").agg(F.count("*").alias("total")), "method")
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("total") * share), F.col("duration_ms")))
    return placed.groupBy("method").agg(
        F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"), F.round(F.sum(F.col("duration_ms") * F.col("k")) / F.sum("k"), 6).alias("mean_ms"),
        at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), at(0.99).alias("p99_ms"),
    )


def retained(log: DataFrame, now, days: int = 7) -> DataFrame:
    """What a retention of so many days leaves at ``now`` (a timestamp as text)."""
    return log.where(F.col("timestamp") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def heartbeats(log: DataFrame, now, stale_s: int = 45, evict_s: int = 60) -> DataFrame:
    """The latest sign of life per session as of ``now``: ``state`` is live, or stale after ``stale_s``; sessions silent
    for longer than ``evict_s`` are gone."""
    last = log.where(F.col("timestamp") <= F.lit(now).cast("timestamp")).groupBy("session_id").agg(F.max("timestamp").alias("last_seen"))
    aged = last.withColumn("age_s", F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_seen"))
    return aged.where(F.col("age_s") <= evict_s).select("session_id", "last_seen", "age_s", F.when(F.col("age_s") > stale_s, "stale").otherwise("live").alias("state"))


# ---- writing the logs ----------------------------------------------------------------------------------------------

QUERY_LOG = "timestamp timestamp, method string, args string, duration_ms double, result_count int"
TOOL_LOG = "timestamp timestamp, tool_name string, args_summary string, duration_ms double, result_size int, session_id string"
# What is kept of an argument that is an object, and the length of a text in a summary of arguments.
KEPT_FLAGS = ("fuzzy", "project", "language", "kind", "containingType")
LONGEST_ARGUMENT = 50


def logged_argument(value):
    """An argument as the query log has it: texts, numbers and truth values as they are, a list by its length, an object by
    the flags in ``KEPT_FLAGS`` that it has."""
    if isinstance(value, (list, tuple)):
        return f"[{len(value)} items]"
    if isinstance(value, dict):
        kept = {k: value[k] for k in KEPT_FLAGS if value.get(k) is not None}
        return json.dumps(kept, separators=(",", ":")) if kept else "{...}"
    return value


def logged_arguments(arguments: list) -> str:
    return json.dumps([logged_argument(a) for a in arguments], separators=(",", ":"), ensure_ascii=False)


def summarised_arguments(arguments: Column) -> Column:
    """A JSON object of arguments (a column) as the log of tool calls has it: texts are cut at ``LONGEST_ARGUMENT`` characters
    with dots after them, all else stays. What is no JSON object gives null."""
    each = F.from_json(arguments, "map<string, string>")
    cut = lambda v: F.when(F.length(v) > LONGEST_ARGUMENT, F.concat(F.substring(v, 1, LONGEST_ARGUMENT), F.lit("..."))).otherwise(v)
    return F.to_json(F.transform_values(each, lambda k, v: cut(v)))


class Log:
    """A log that calls are appended to: rows are held until there are ``batch`` of them, then written as one file more.
    A log that cannot be written never breaks a call."""

    def __init__(self, spark: SparkSession, folder: str, schema: str = QUERY_LOG, batch: int = 100):
        self.spark, self.folder, self.schema, self.batch = spark, folder, schema, batch
        self.held: list[tuple] = []

    def append(self, *row) -> None:
        self.held.append(row)
        if len(self.held) >= self.batch:
            self.flush()

    def flush(self) -> None:
        rows, self.held = self.held, []
        try:
            if rows:
                self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)
        except Exception as e:  # noqa: BLE001
            print(f"log not written: {e}")

    def read(self) -> DataFrame:
        self.flush()
        try:
            return self.spark.read.schema(self.schema).parquet(self.folder)
        except Exception:  # noqa: BLE001
            return self.spark.createDataFrame([], self.schema)

    def timed(self, method: str, arguments: list, call: Callable[[], object], slow_ms: float = 0.0, clock: Callable[[], float] = time.perf_counter):
        """What a call returns; its time, and how many rows it gave if that is known, go to the log if it took ``slow_ms``."""
        began = clock()
        result = call()
        took = (clock() - began) * 1000
        if took >= slow_ms:
            size = len(result) if hasattr(result, "__len__") else None
            self.append(datetime.now(timezone.utc).replace(tzinfo=None), method, logged_arguments(arguments), float(took), size)
        return result
