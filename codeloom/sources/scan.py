"""Files on disk as tables: sources, assets and the settings that name them."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import names
from codeloom.functions.text import content_hash
from codeloom.sources import parsers
from codeloom.sources.asset_header import header_classes

LANGUAGES = ("angelscript", "cpp", "content", "config")


def load_settings(text: str) -> dict:
    """Settings from JSON text, with or without a byte order mark. There must be projects, each with a name, paths and a
    language; anything else is an error that says what is missing."""
    settings = json.loads(text.lstrip("\ufeff"))
    projects = settings.get("projects")
    if not isinstance(projects, list) or not projects:
        raise ValueError("settings need at least one project")
    for project in projects:
        for key in ("name", "paths", "language"):
            if not project.get(key):
                raise ValueError(f"project {project.get('name', '?')} needs {key}")
    return settings


def exclude_pattern(glob: str) -> str:
    """A glob as a regular expression that may match anywhere in a path: ``**`` is any run, then every ``*`` that is left
    (also the one in such a run) any run without a slash. A glob without ``**`` is plain text that the path contains."""
    if "**" not in glob:
        return re.escape(glob)
    parts = [p.replace("*", "[^/]*") for p in re.escape(glob).replace(r"\*", "*").split("**")]
    return ".[^/]*".join(parts)


def wanted(path: Column, extensions: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """Whether a path ends in one of the extensions and meets no exclusion."""
    keep = reduce(lambda a, b: a | b, [path.endswith(e) for e in extensions]) if extensions else F.lit(True)
    plain = names.slashes(path)
    return reduce(lambda a, g: a & ~plain.rlike(exclude_pattern(g)), exclude, keep)


def project_of(path: Column, settings: dict) -> tuple[Column, Column]:
    """(project, base path) of a path: the first project that has a base path it begins with, letter case aside."""
    low, project, base = names.path_lower(path), F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for p in settings["projects"]:
        for root in p["paths"]:
            root = root.replace("\\", "/").rstrip("/")
            inside = low.startswith(root.lower() + "/")
            project, base = project.when(inside, p["name"]), base.when(inside, root)
    return project, base


def scan_files(spark: SparkSession, root: str, project: str, language: str, extensions: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """The files below a folder: ``path``, ``project``, ``module``, ``language``, ``mtime`` (ms), ``relative_path``,
    ``path_lower``, ``basename_lower``. Only names and times are read. An empty folder gives no rows."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "modificationTime")
    path = F.regexp_replace("path", "^file:/*", "/")
    relative = F.substr(path, F.lit(len(base) + 2))
    return found.where(wanted(path, extensions, exclude)).select(
        path.alias("path"), F.lit(project).alias("project"), names.derive_module(relative, F.lit(project)).alias("module"), F.lit(language).alias("language"),
        F.unix_millis("modificationTime").alias("mtime"), relative.alias("relative_path"), names.path_lower(path).alias("path_lower"), names.basename_lower(path).alias("basename_lower"),
    )


def read_texts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """The whole text of each file below a folder: ``path``, ``content``, ``content_hash``, ``mtime``."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    return read.select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"), F.col("value").alias("content"), content_hash(F.col("value")).alias("content_hash"),
        F.unix_millis("_metadata.file_modification_time").alias("mtime"),
    )


def read_source(spark: SparkSession, root: str, project: str, extensions: Sequence[str] = (".as", ".h", ".hpp", ".cpp", ".inl", ".ini"), exclude: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The source files below a folder in one reading: ``(items, symbols)``. ``items`` are as ``ingest`` wants them, the language
    by the extension; ``symbols`` come from the parser of each file's language, by ``path``. Settings have a text only."""
    base = root.rstrip("/")
    texts = read_texts(spark, root).where(wanted(F.col("path"), extensions, exclude))
    relative = F.substr("path", F.lit(len(base) + 2))
    items = texts.select("path", F.lit(project).alias("project"), names.derive_module(relative, F.lit(project)).alias("module"), "mtime", names.language_of(F.col("path")).alias("language"), relative.alias("relative_path"), "content")
    numbered = items.select(F.xxhash64("path").alias("file_id"), "path", "language", "content")
    found = parsers.symbols(numbered).join(numbered.select("file_id", "path"), "file_id").drop("file_id")
    return items, found


def read_assets(spark: SparkSession, root: str, project: str) -> DataFrame:
    """The assets below a content folder, with the classes from their headers: the columns of ``assets`` without ``id``."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    found = found.where(path.rlike(r"(?i)\.(uasset|umap)$")).withColumn("p", path)
    inner = F.regexp_replace(F.substr("p", F.lit(len(base) + 2)), r"\.[^.]*$", "")
    content_path = F.concat(F.lit("/Game/"), inner)
    classes = F.when(F.lower("p").endswith(".uasset"), header_classes(F.col("content")))
    rows = found.select("p", "modificationTime", content_path.alias("content_path"), classes.alias("c"))
    return rows.select(
        F.col("p").alias("path"), F.element_at(F.split("content_path", "/"), -1).alias("name"), "content_path", F.regexp_replace("content_path", "/[^/]*$", "").alias("folder"),
        F.lit(project).alias("project"), F.regexp_extract("p", r"(\.[^.]*)$", 1).alias("extension"), F.unix_millis("modificationTime").alias("mtime"),
        F.col("c.asset_class").alias("asset_class"), F.col("c.parent_class").alias("parent_class"),
    )


def write_mirror(content: DataFrame, files: DataFrame, target: str) -> None:
    """Writes all texts with their paths in the mirror, one folder per project."""
    joined = content.join(files.select(F.col("id").alias("file_id"), "project", "relative_path", "path"), "file_id")
    joined.select("project", F.coalesce("relative_path", "path").alias("path"), "content").write.mode("overwrite").partitionBy("project").parquet(target)
