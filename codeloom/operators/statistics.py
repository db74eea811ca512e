"""Figures over the index: totals, roll-ups, freshness and folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text, trigrams


def index_stats(files: DataFrame, types: DataFrame, members: DataFrame) -> DataFrame:
    """Totals in long form: ``measure``, ``a``, ``b`` (what is counted apart), ``n``. Repeated member rows count once."""
    members = members.dropDuplicates(["id"])
    none = F.lit(None).cast("string")
    owned = types.join(files.select(F.col("id").alias("file_id"), "project", "language"), "file_id")
    parts = [
        files.groupBy().agg(F.count("*").alias("n")).select(F.lit("files").alias("measure"), none.alias("a"), none.alias("b"), "n"),
        types.groupBy().agg(F.count("*").alias("n")).select(F.lit("types"), none, none, "n"),
        members.groupBy().agg(F.count("*").alias("n")).select(F.lit("members"), none, none, "n"),
        types.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("types by kind"), "kind", none, "n"),
        members.groupBy("member_kind").agg(F.count("*").alias("n")).select(F.lit("members by kind"), "member_kind", none, "n"),
        files.groupBy("project", "language").agg(F.count("*").alias("n")).select(F.lit("files by project"), "project", "language", "n"),
        owned.groupBy("project", "language").agg(F.count("*").alias("n")).select(F.lit("types by project"), "project", "language", "n"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def project_stats(files: DataFrame, types: DataFrame) -> DataFrame:
    """Per project its files and types and its language (the first by name where a project has several)."""
    by_file = files.groupBy("project").agg(F.count("*").alias("n_files"), F.min("language").alias("language"))
    counts = types.groupBy("file_id").agg(F.count("*").alias("n")).join(files.select(F.col("id").alias("file_id"), "project"), "file_id")
    by_type = counts.groupBy("project").agg(F.sum("n").alias("n_types"))
    return by_file.join(by_type, "project", "left").select("project", "language", "n_files", F.coalesce("n_types", F.lit(0)).alias("n_types"))


def asset_stats(assets: DataFrame) -> DataFrame:
    """Totals of assets in long form: ``measure``, ``a``, ``n``; a missing class counts as Unknown."""
    none = F.lit(None).cast("string")
    parts = [
        assets.groupBy().agg(F.count("*").alias("n")).select(F.lit("assets").alias("measure"), none.alias("a"), "n"),
        assets.groupBy().agg(F.count("parent_class").alias("n")).select(F.lit("with parent"), none, "n"),
        assets.groupBy("project").agg(F.count("*").alias("n")).select(F.lit("by project"), "project", "n"),
        assets.groupBy("extension").agg(F.count("*").alias("n")).select(F.lit("by extension"), "extension", "n"),
        assets.groupBy(F.coalesce("asset_class", F.lit("Unknown")).alias("c")).agg(F.count("*").alias("n")).select(F.lit("by class"), "c", "n"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def projects(files: DataFrame, assets: DataFrame) -> DataFrame:
    return files.select("project").union(assets.select("project")).where("project is not null").distinct()


def language_status(files: DataFrame, assets: DataFrame) -> DataFrame:
    """Per language the number of files, with the assets as the language ``content``, and whether it is empty."""
    own = files.where("language not in ('content', 'asset')").groupBy("language").agg(F.count("*").alias("n"))
    content = assets.groupBy().agg(F.count("*").alias("n")).select(F.lit("content").alias("language"), "n")
    return own.union(content).select("language", "n", (F.col("n") == 0).alias("is_empty"))


def freshness(files: DataFrame) -> DataFrame:
    return files.groupBy("project").agg(F.max("mtime").alias("newest"))


def project_folders(files: DataFrame) -> DataFrame:
    """Per project the longest folder all its paths share; it follows from the smallest and the largest path."""
    ends = files.where("path is not null").groupBy("project").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    return ends.select("project", text.common_folder(F.col("low"), F.col("high")).alias("folder"))


def sample_paths(files: DataFrame, n: int = 5) -> DataFrame:
    """The first paths of each project by id."""
    w = Window.partitionBy("project").orderBy("id")
    return files.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("project", "rank", "path")


def module_contents(files: DataFrame, types: DataFrame) -> DataFrame:
    """Per module the number of files, of declarations and of distinct type names."""
    own = files.groupBy("module").agg(F.count("*").alias("n_files"))
    named = types.join(files.select(F.col("id").alias("file_id"), "module"), "file_id").groupBy("module", "name").agg(F.count("*").alias("k"))
    per = named.groupBy("module").agg(F.sum("k").alias("n_types"), F.count("*").alias("n_names"))
    return own.join(per, "module", "left").select("module", "n_files", F.coalesce("n_types", F.lit(0)).alias("n_types"), F.coalesce("n_names", F.lit(0)).alias("n_names"))


def kinds_by_project(files: DataFrame, types: DataFrame) -> DataFrame:
    """Per project the number of types of each kind, a column each; counted per file before the files are joined."""
    kinds = ("class", "struct", "enum", "interface", "delegate", "event")
    per_file = types.groupBy("file_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds])
    joined = per_file.join(files.select(F.col("id").alias("file_id"), "project"), "file_id")
    return joined.groupBy("project").agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in kinds])


def declaring_files(types: DataFrame, files: DataFrame) -> DataFrame:
    """The files that declare each type name: ``name``, ``path``, each pair once (a name may stand in very many files, so
    they are rows and no array)."""
    return types.select("name", "file_id").distinct().join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("name", "path").distinct()


def top_modules(files: DataFrame) -> DataFrame:
    return files.select(F.element_at(F.split("module", r"\."), 1).alias("top")).distinct()


def posting_stats(types: DataFrame, members: DataFrame) -> DataFrame:
    """Rows and distinct trigrams of the postings, per kind of symbol."""
    return trigrams.postings(types, members).groupBy("entity_type").agg(F.count("*").alias("n_rows"), F.count_distinct("trigram").alias("n_trigrams"))


def content_drift(files: DataFrame, content: DataFrame, limit: float = 0.05) -> DataFrame:
    """Whether the stored texts and the files that should have one differ by more than a share of these."""
    have = content.where("content is not null").join(files.select(F.col("id").alias("file_id")), "file_id", "left_semi").agg(F.count("*").alias("n_content"))
    want = files.agg(F.count("*").alias("n_files"))
    return want.join(F.broadcast(have)).select("n_files", "n_content", (F.abs(F.col("n_files") - F.col("n_content")) > F.col("n_files") * limit).alias("rebuild"))
