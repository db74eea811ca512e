"""Jobs that keep an index whole: rebuilds, clean-up, schema checks, readiness, lazy figures and counters.

As in ``ingest``, tables come in and tables go out; a result becomes visible when it is written as a new version.
"""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import names
from codeloom.operators import closure, ingest
from codeloom.session import Scratch

#: The columns of each table with their types, in the order in which they are stored.
SCHEMAS = {
    "files": "id long, path string, project string, module string, language string, mtime long, relative_path string, path_lower string, basename_lower string",
    "types": "id long, file_id long, name string, kind string, parent string, line int, depth int",
    "members": "id long, type_id long, file_id long, name string, member_kind string, line int, is_static boolean, specifiers string",
    "assets": "id long, path string, name string, content_path string, folder string, project string, extension string, mtime long, asset_class string, parent_class string",
    "file_content": "file_id long, content string, content_hash long",
}
#: Columns that a table cannot do without: nothing else says what they held.
ESSENTIAL = {"files": ("id", "path"), "types": ("id", "file_id", "name"), "members": ("id", "name"), "assets": ("id", "path", "name"), "file_content": ("file_id", "content")}
#: Missing columns that follow from others.
BACKFILL = {
    ("files", "path_lower"): lambda: names.path_lower(F.col("path")),
    ("files", "basename_lower"): lambda: names.basename_lower(F.col("path")),
    ("assets", "content_path"): lambda: F.concat(F.lit("/Game/"), F.col("name")),
    ("file_content", "content_hash"): lambda: ingest.content_hash(F.col("content")),
}
#: Missing columns that only a new reading of all rows can fill.
READ_AGAIN = {("assets", "asset_class"), ("assets", "parent_class")}


def _fields(name: str) -> list[tuple[str, str]]:
    return [tuple(f.split()) for f in SCHEMAS[name].split(", ")]


def migrate(name: str, table: DataFrame) -> tuple[DataFrame, bool]:
    """A stored table in its present schema, and whether all of its rows must be read again.

    Columns that an older table lacks are added, filled from others where they follow from them, else null; types are cast;
    other columns stay behind the known ones. A table without an essential column is an error.
    """
    lacking = [c for c in ESSENTIAL[name] if c not in table.columns]
    if lacking:
        raise ValueError(f"{name} lacks {', '.join(lacking)}")
    missing = {c for c, _ in _fields(name)} - set(table.columns)
    known = []
    for column, kind in _fields(name):
        fill = BACKFILL.get((name, column), lambda: F.lit(None))
        known.append((F.col(column) if column not in missing else fill()).cast(kind).alias(column))
    extra = [c for c in table.columns if c not in {k for k, _ in _fields(name)}]
    return table.select(*known, *extra), any((name, c) in READ_AGAIN for c in missing)


# ---- rebuilds ------------------------------------------------------------------------------------------------------


def _replaced(tables: dict[str, DataFrame], old: DataFrame, scanned: DataFrame, parse) -> dict[str, DataFrame]:
    """The tables after the files ``old`` (``id``, ``path``) have been read again as ``scanned``, changed or not."""
    scratch = Scratch(scanned.sparkSession, "rebuild")
    scanned = scratch.save(scanned)
    gone = old.join(scanned.select("path"), "path", "left_anti").select("path")
    # A file that is known is read again whatever its time: it is given none.
    again = dict(tables)
    again["files"] = tables["files"].join(old.select("id").withColumn("_old", F.lit(True)), "id", "left").withColumn("mtime", F.when(F.col("_old").isNull(), F.col("mtime"))).select(*tables["files"].columns)
    return ingest.ingest(again, scanned, None, gone, parse)


def rebuild_language(tables: dict[str, DataFrame], language: str, scanned: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """The tables after all files of a language have been read again: ``scanned`` has them as ``ingest`` wants them. What is
    not among them any more goes, with its types, members and text; known paths keep their ids."""
    return _replaced(tables, tables["files"].where(F.col("language") == language).select("id", "path"), scanned, parse)


def rebuild_project(tables: dict[str, DataFrame], project: str, scanned: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """The tables after a project's files have been read again, and without rows whose file is gone."""
    return without_orphans(_replaced(tables, tables["files"].where(F.col("project") == project).select("id", "path"), scanned, parse))


def without_orphans(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without types, members and texts of files that are not there. Rows without a file stay out too."""
    out, known = dict(tables), tables["files"].select(F.col("id").alias("file_id"))
    for name in ("types", "members", "file_content"):
        out[name] = tables[name].join(known, "file_id", "left_semi").select(*tables[name].columns)
    return out


def orphan_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``name`` of each table that hangs on files, and how many of its rows (``n_rows``) have none (``n_orphans``)."""
    known, parts = tables["files"].select(F.col("id").alias("file_id"), F.lit(True).alias("_has")), []
    for name in ("types", "members", "file_content"):
        joined = tables[name].select("file_id").groupBy("file_id").agg(F.count("*").alias("n")).join(known, "file_id", "left")
        parts.append(joined.agg(F.lit(name).alias("name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("_has").isNull(), F.col("n"))), F.lit(0)).alias("n_orphans")))
    return parts[0].union(parts[1]).union(parts[2])


def without_assets(assets: DataFrame, paths: DataFrame | None = None, project: str | None = None) -> DataFrame:
    """The assets without those at ``paths`` (``path``), and without those of a project. Assets of no project stay."""
    if project is not None:
        assets = assets.where(~F.col("project").eqNullSafe(F.lit(project)))
    return assets if paths is None else assets.join(paths.select("path").where("path is not null"), "path", "left_anti").select(*assets.columns)


def without_language(tables: dict[str, DataFrame], language: str) -> dict[str, DataFrame]:
    """The tables without a language's files and all that belongs to them; those of the language ``content`` are the assets."""
    if language == "content":
        return tables | {"assets": tables["assets"].limit(0)}
    return ingest.delete_files(tables, tables["files"].where(F.col("language") == language).select(F.col("id").alias("file_id")))


def retried(job: Callable[[], object], times: int = 1, wait_s: float = 30.0, sleep: Callable[[float], None] = time.sleep):
    """What a job returns; if it fails it is tried so many times again, after a wait. The last failure is the caller's."""
    for left in range(times, -1, -1):
        try:
            return job()
        except Exception:
            if not left:
                raise
            sleep(wait_s)


# ---- what is to be done --------------------------------------------------------------------------------------------


def empty_languages(files: DataFrame, assets: DataFrame, languages: Iterable[str]) -> DataFrame:
    """The languages of a list that have no rows yet, and so need a full scan: ``language``. Assets are ``content``."""
    wanted = files.sparkSession.createDataFrame([(x,) for x in languages], "language string")
    have = files.select("language").union(assets.limit(1).select(F.lit("content"))).where("language is not null").distinct()
    return wanted.join(have, "language", "left_anti")


def full_scan(paths: DataFrame, per_batch: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """Paths to be read, in batches of about equal size: the columns of ``paths`` and ``batch`` (from 0), by path."""
    from codeloom.operators.skew import range_scan

    scratch = scratch or Scratch(paths.sparkSession, "scan")
    placed = range_scan(paths.withColumn("_all", F.lit(0).cast("long")), ["_all"], ["path"], scratch)
    return placed.withColumn("batch", F.floor(F.col("_pos") / per_batch)).drop("_all", "_pos")


def refreshed_depths(types: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """``types`` with ``depth`` as ``closure.depths`` finds it. With ``changed`` (rows that say which types changed since the
    last time) nothing is worked out if it is empty: the depths are refreshed only when they are stale."""
    if changed is not None and changed.isEmpty():
        return types
    found = closure.depths(types).withColumnRenamed("depth", "_depth")
    return types.join(found, "name", "left").withColumn("depth", F.col("_depth").cast("int")).select(*types.columns)


def changes_between(before: dict[str, DataFrame], after: dict[str, DataFrame], at) -> DataFrame:
    """Counters of one ingest: per table ``n_before``, ``n_after``, ``n_added`` and ``n_removed`` ids, and ``last_ingest``."""
    parts = []
    for name in before:
        key = "file_id" if name == "file_content" else "id"
        old, new = (t[name].select(F.col(key).alias("k")).distinct() for t in (before, after))
        both = old.withColumn("a", F.lit(1)).join(new.withColumn("b", F.lit(1)), "k", "full_outer")
        parts.append(both.agg(F.lit(name).alias("name"), F.count("a").alias("n_before"), F.count("b").alias("n_after"), F.count_if(F.col("a").isNull()).alias("n_added"), F.count_if(F.col("b").isNull()).alias("n_removed")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.withColumn("last_ingest", F.lit(at).cast("timestamp"))


# ---- readiness and caches ------------------------------------------------------------------------------------------


def readiness(values: DataFrame, flags: Iterable[str]) -> DataFrame:
    """``flag`` and ``ready`` for each flag of a list, from rows of ``key_values``: ready if its latest value is true."""
    wanted = values.sparkSession.createDataFrame([(f,) for f in flags], "flag string")
    last = values.groupBy(F.col("key").alias("flag")).agg(F.max_by("value", "at").alias("value"))
    return wanted.join(last, "flag", "left").select("flag", F.coalesce(F.lower(F.trim("value")) == "true", F.lit(False)).alias("ready"))


class ResultCache:
    """Answers that are asked for again: at most ``size`` of them, none older than ``ttl_s``, the longest unused go first.
    Frames are kept as the rows that were collected of them, so an answer should be a limited one."""

    def __init__(self, size: int, ttl_s: float, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl_s, self.clock = size, ttl_s, clock
        self._held: OrderedDict[str, tuple[float, object]] = OrderedDict()

    def get(self, question: tuple, answer: Callable[[], object]):
        key = json.dumps(question, sort_keys=True, default=str)
        if key in self._held and self.clock() - self._held[key][0] <= self.ttl_s:
            self._held.move_to_end(key)
            return self._held[key][1]
        found = answer()
        if isinstance(found, DataFrame):
            found = found.collect()
        self._held[key] = (self.clock(), found)
        self._held.move_to_end(key)
        while len(self._held) > self.size:
            self._held.popitem(last=False)
        return found

    def clear(self) -> None:
        self._held.clear()

    def __len__(self) -> int:
        return len(self._held)
