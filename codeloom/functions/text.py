"""Column functions over texts and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """The first eight bytes of the text's MD5, read as a signed little-endian number. The top byte is read apart, so
    that the number is built within 64 bits."""
    digest = F.md5(F.encode(text, "UTF-8"))
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("long")
    low = sum((F.shiftleft(byte(i), 8 * i) for i in range(1, 7)), byte(0))
    top = byte(7)
    return low + F.shiftleft(F.when(top >= 128, top - 256).otherwise(top), 56)


def shorten(line: Column, width: int = 200) -> Column:
    """A line for display: white space at both ends is taken off, and what is longer than a width is cut, with dots after it."""
    line = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width), F.lit("..."))).otherwise(line)


def lines(content: DataFrame) -> DataFrame:
    """The lines of each text: ``file_id``, ``line`` (from 1), ``text``. A null text has none, an empty one a single
    empty line; a carriage return stays at its line's end."""
    split = F.posexplode(F.split("content", "\n"))
    return content.where("content is not null").select("file_id", split.alias("at", "text")).select("file_id", (F.col("at") + 1).alias("line"), "text")


def common_folder(low: Column, high: Column) -> Column:
    """The longest leading path that two paths share, up to and with its last slash."""
    folders = lambda p: F.slice(F.split(p, "/"), 1, F.size(F.split(p, "/")) - 1)
    parts = F.arrays_zip(folders(low).alias("a"), folders(high).alias("b"))
    same = F.aggregate(parts, F.struct(F.lit("").alias("path"), F.lit(True).alias("on")), lambda acc, p: F.struct(
        F.when(acc["on"] & (p["a"] == p["b"]), F.concat(acc["path"], p["a"], F.lit("/"))).otherwise(acc["path"]).alias("path"),
        F.coalesce(acc["on"] & (p["a"] == p["b"]), F.lit(False)).alias("on"),
    ))
    return same["path"]
