"""References that find no record."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.skew import heavy_light_join
from codeloom.session import Scratch

#: A reference value on more rows than this share is joined by broadcast; there can be at most its inverse of them.
HEAVY_SHARE = 0.002


def orphan_values(references: DataFrame, columns: Sequence[str], targets: DataFrame, match: str = "simple") -> DataFrame:
    """The distinct reference values that find no target, with the rows that carry them: ``columns`` and ``n``.

    ``targets`` has the same column names. Values are grouped by which of their columns are null, and each such mask is
    anti-joined on its non-null columns only. ``match`` states what a partly null reference means: ``simple``: it refers
    to nothing and is never an orphan; ``partial``: its non-null columns must be found together in some target;
    ``full``: it is always an orphan. A wholly null reference is never one. An empty target table makes every
    reference that is to be looked up an orphan; null columns in targets match nothing. Values that many rows share are
    looked up once, so the join never sees how often a value is used.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"match must be simple, partial or full, not {match}")
    columns = list(columns)
    values = references.groupBy(*columns).agg(F.count("*").alias("n"))
    found: DataFrame | None = None
    for mask in product((False, True), repeat=len(columns)):
        if all(mask):
            continue
        if any(mask) and match == "simple":
            continue
        there = [c for c, null in zip(columns, mask) if not null]
        group = values
        for c, null in zip(columns, mask):
            group = group.where(F.col(c).isNull() if null else F.col(c).isNotNull())
        if not (any(mask) and match == "full"):
            group = group.join(targets.select(*there).dropna().distinct(), there, "left_anti").select(*columns, "n")
        found = group if found is None else found.unionByName(group)
    return found


def orphan_rows(references: DataFrame, column: str, targets: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """The rows of ``references`` whose ``column`` is not null and is no value of ``targets[column]``.

    The missing values are worked out once per value and kept; the rows are then picked by a semi-join in which values
    that stand on a large share of all rows are broadcast (their number is bounded) and the rest are shuffled.
    """
    missing = scratch.save(orphan_values(references, [column], targets))
    limit = max(1, int(total * HEAVY_SHARE))
    heavy = [r[0] for r in missing.where(F.col("n") > limit).select(column).collect()]  # at most 1 / HEAVY_SHARE rows
    return heavy_light_join(references, missing.select(column), column, heavy, "left_semi")


def lookup_period(rows: DataFrame, owners: DataFrame, key: str, scratch: Scratch, total: int) -> DataFrame:
    """Adds ``mtime`` of the row's owner; owners on a large share of the rows are broadcast. No owner gives null."""
    limit = max(1, int(total * HEAVY_SHARE))
    heavy = [r[0] for r in rows.groupBy(key).count().where(f"count > {limit}").select(key).dropna().collect()]
    return heavy_light_join(rows, owners, key, heavy, "left")


def month_of(mtime) -> F.Column:
    """The UTC month of an epoch-ms time as YYYY-MM; null stays null."""
    return F.date_format(F.timestamp_millis(mtime), "yyyy-MM")


def asset_class_names(types: DataFrame, assets: DataFrame) -> DataFrame:
    """Every spelling under which an ``assets.parent_class`` finds something: columns ``key`` and ``name`` (what it finds)."""
    declared = types.select("name").where("name is not null").distinct()
    known = assets.select("name").where("name is not null").distinct()
    return (
        declared.select(F.col("name").alias("key"), "name")
        .unionByName(declared.where(F.col("name").rlike("^[UAFESI][A-Z]")).select(F.expr("substring(name, 2)").alias("key"), "name"))
        .unionByName(known.select(F.col("name").alias("key"), "name"))
        .unionByName(known.select(F.concat("name", F.lit("_C")).alias("key"), "name"))
    )


def find_orphans(types: DataFrame, members: DataFrame, assets: DataFrame, files: DataFrame) -> DataFrame:
    """All orphan references: ``ref_table``, ``period``, ``row_id``, ``reference`` (the value that finds nothing, as text).

    A null or empty reference is none. Letter case and blanks count. A repeated row is one case. A row whose file is
    unknown has a null period. Empty tables give no rows of their own; if they are referred to, all references to them
    are orphans. Extra columns are not read.
    """
    spark = types.sparkSession
    scratch = Scratch(spark, "orphans")
    owners = files.select(F.col("id").alias("file_id"), "mtime")
    total = {n: f.count() for n, f in (("types", types), ("members", members), ("assets", assets))}
    type_rows = types.select("id", "file_id", F.when(F.col("parent") != "", F.col("parent")).alias("ref"))
    member_rows = members.select("id", "file_id", F.col("type_id").alias("ref"))
    asset_rows = assets.select("id", "mtime", F.when(F.col("parent_class") != "", F.col("parent_class")).alias("ref"))
    parts = []
    for name, rows, targets in (
        ("types", type_rows, types.select(F.col("name").alias("ref"))),
        ("members", member_rows, types.select(F.col("id").alias("ref"))),
        ("assets", asset_rows, asset_class_names(types, assets).select(F.col("key").alias("ref"))),
    ):
        lost = orphan_rows(rows, "ref", targets, total[name], scratch)
        if name == "members":
            lost = lost.dropDuplicates(["id"])
        if name != "assets":
            lost = scratch.save(lost)
            lost = lookup_period(lost, owners, "file_id", scratch, total[name])
        parts.append(lost.select(F.lit(name).alias("ref_table"), month_of(F.col("mtime")).alias("period"), F.col("id").alias("row_id"), F.col("ref").cast("string").alias("reference")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
