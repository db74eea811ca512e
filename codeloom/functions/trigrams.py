"""Trigrams of names, their postings and the candidates they give."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """The distinct lower-case three-character pieces of a text, none with a line end or a null character. A text of
    fewer than three characters has none; null stays null."""
    low = F.lower(text)
    pieces = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3)))
    clean = F.array_distinct(F.filter(pieces, lambda p: ~p.rlike("[\n\r\x00]")))
    return F.when(F.length(low) >= 3, clean).when(text.isNotNull(), F.array().cast("array<string>"))


def trigram_list(text: str) -> list[str]:
    low = text.lower()
    return list(dict.fromkeys(p for p in (low[i : i + 3] for i in range(len(low) - 2)) if not set(p) & set("\n\r\x00")))


def shared(name: Column, grams: list[str]) -> Column:
    """How many of some trigrams a text has, letter case aside. Plain text search, so no array is built for each row."""
    low = F.lower(name)
    return sum((low.contains(g).cast("int") for g in grams), F.lit(0))


def needed(query: str) -> int:
    """How many of a query's trigrams a candidate must share; a shorter query may miss more of them."""
    share = 0.60 if len(query) <= 5 else 0.75 if len(query) <= 15 else 0.80
    return max(2, math.ceil(len(trigram_list(query)) * share))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements of two arrays; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def postings(types: DataFrame, members: DataFrame) -> DataFrame:
    """One row per trigram and symbol: ``trigram``, ``entity_type`` (type or member), ``entity_id``. Each pair once."""
    parts = [t.select(F.explode(trigrams(F.col("name"))).alias("trigram"), F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id")) for t, kind in ((types, "type"), (members.dropDuplicates(["id"]), "member"))]
    return parts[0].unionByName(parts[1])


def updated(posted: DataFrame, gone: DataFrame, types: DataFrame, members: DataFrame) -> DataFrame:
    """Postings after a change: without the symbols of ``gone`` (``entity_type``, ``entity_id``), with those of the new ``types``
    and ``members``. Symbols that were posted already are posted once."""
    new = postings(types, members)
    old = posted.join(gone.select("entity_type", "entity_id").distinct(), ["entity_type", "entity_id"], "left_anti")
    again = new.select("entity_type", "entity_id").distinct()
    return old.join(again, ["entity_type", "entity_id"], "left_anti").select(*new.columns).unionByName(new)


def candidates(posted: DataFrame, query: str, entity_type: str) -> DataFrame:
    """``entity_id`` and ``matched`` of the symbols that share enough trigrams with the query."""
    hit = posted.where((F.col("entity_type") == entity_type) & F.col("trigram").isin(trigram_list(query)))
    return hit.groupBy("entity_id").agg(F.count_distinct("trigram").alias("matched")).where(F.col("matched") >= needed(query))
