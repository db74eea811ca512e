"""Tables laid out for lookups at scale.

A lookup by name reads a few row groups only if equal names lie together. Each table is written sorted by the key it is
asked by, in range partitions of about equal size (a name on very many rows spreads over several), with Bloom filters on
what is looked up exactly and lower-case forms of what is looked up by prefix, so that filters reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: By table: the column it is sorted by, those with a Bloom filter, and the columns that get a lower-case twin.
LAYOUTS = {
    "files": ("path_lower", ("id", "path"), ()),
    "types": ("name", ("name", "parent", "id"), ("name",)),
    "members": ("name", ("name", "type_id"), ("name",)),
    "assets": ("name", ("name", "parent_class"), ("name",)),
    "file_content": ("file_id", ("file_id",), ()),
}
#: Rows after which a further partition is worth having.
ROWS_PER_PARTITION = 2_000_000


def publish(name: str, table: DataFrame, target: str) -> None:
    """Writes a table (one of ``LAYOUTS``) to ``target``, replacing what is there. Columns that end in ``_lower`` are added
    for prefix lookups; the others stay as they are. Rows that are equal in all columns are written once."""
    order, exact, lowered = LAYOUTS[name]
    for column in lowered:
        table = table.withColumn(f"{column}_lower", F.lower(column))
    table = table.distinct() if name == "members" else table
    parts = max(1, -(-table.count() // ROWS_PER_PARTITION))
    keys = [order, "id"] if "id" in table.columns and order != "id" else [order]
    writer = table.repartitionByRange(int(parts), *keys).sortWithinPartitions(*keys).write.mode("overwrite").option("compression", "zstd")
    for column in exact:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(target)


def by_prefix(table: DataFrame, prefix: str) -> DataFrame:
    """The rows of a published table whose name begins with a prefix, letter case aside; the filter reaches the files."""
    return table.where(F.col("name_lower").startswith(prefix.lower()))
