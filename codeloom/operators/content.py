"""Search in the text of files: lines that match, their context, symbols near them, and their ranking."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import scoring, text, trigrams

META = set(".+*?^${}()|[]")


def is_regex(pattern: str) -> bool:
    """Whether a pattern has a character with a meaning of its own that no backslash takes away."""
    bare = re.sub(r"\\.", "", pattern)
    return any(c in META for c in bare)


def literals(pattern: str) -> list[str]:
    """Runs of three or more plain characters that every match of the pattern must have; none if it has alternatives,
    groups or classes, or a run is optional."""
    if re.search(r"[|()\[\]\\]", pattern):
        return []
    runs = re.split(r".(?:[*?]|\{[^}]*\})|[.^$]|\+", pattern)
    return [r for r in runs if len(r) >= 3]


def grep(content: DataFrame, files: DataFrame, pattern: str, regex: bool = True, case_sensitive: bool = True, context: int = 0, language: str | None = None, project: str | None = None) -> DataFrame:
    """The lines that match: ``file_id``, ``path``, ``project``, ``language``, ``mtime``, ``line`` and ``column`` (both
    from 1, of the first match), ``match``, ``context`` (the lines around it, empty without). One row per line.

    Texts that lack a literal run of the pattern are dropped before they are split; the lines of a text are an array
    that is cut for the context, so no shuffle or self-join is needed for it, and only matching lines become rows. A pattern that is no regular expression
    is an error. Null texts have no lines.
    """
    body = pattern if regex else re.escape(pattern)
    re.compile(body)
    body = body if case_sensitive else "(?i)" + body
    rows = content.where("content is not null")
    needed = (literals(pattern) if regex else [pattern]) if pattern else []
    if needed:
        hay = F.col("content") if case_sensitive else F.lower("content")
        rows = rows.where(reduce(lambda a, b: a & b, [hay.contains(n if case_sensitive else n.lower()) for n in needed]))
    lines = rows.select("file_id", F.split("content", "\n").alias("lines"))
    text_at = lambda i: F.get(F.col("lines"), i - 1)
    each = lines.select("file_id", "lines", F.explode(F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: text_at(i).rlike(body))).alias("line"))
    begin = F.greatest(F.col("line") - context, F.lit(1))
    around = F.slice("lines", begin, F.col("line") + context - begin + 1) if context else F.array().cast("array<string>")
    hits = each.select("file_id", "line", F.regexp_instr(text_at(F.col("line")), F.lit(body)).alias("column"), text_at(F.col("line")).alias("match"), around.alias("context"))
    owners = files.select(F.col("id").alias("file_id"), "path", "project", "language", "mtime")
    if language not in (None, "all"):
        owners = owners.where(F.col("language") == language)
    if project is not None:
        owners = owners.where(F.col("project") == project)
    return hits.join(owners, "file_id")


def all_words(hits: DataFrame, words: list[str]) -> DataFrame:
    """Of hits for several words: those with all words in the line, else with all in line and context (``near`` true)."""
    low, wide = F.lower("match"), F.lower(F.concat_ws("\n", "context"))
    inside = reduce(lambda a, b: a & b, [low.contains(w.lower()) for w in words])
    around = reduce(lambda a, b: a & b, [wide.contains(w.lower()) for w in words])
    return hits.withColumn("near", ~inside).where(inside | around)


def symbols_near(hits: DataFrame, types: DataFrame, members: DataFrame, distance: int = 3) -> DataFrame:
    """The symbol that stands within some lines of a hit: a member before a type, the latest by id. Columns ``file_id``,
    ``line``, ``symbol``, ``symbol_kind``, ``entity``. Joined by the file and the block of lines, so that a file with
    very many symbols meets only those nearby."""
    width = 2 * distance + 1
    block = lambda c: F.floor(F.col(c) / width)
    known = types.select("file_id", F.col("line").alias("at"), F.col("name").alias("symbol"), F.col("kind").alias("symbol_kind"), F.lit("type").alias("entity"), F.lit(0).alias("rank"), "id")
    inner = members.dropDuplicates(["id"]).select("file_id", F.col("line").alias("at"), F.col("name").alias("symbol"), F.col("member_kind").alias("symbol_kind"), F.lit("member").alias("entity"), F.lit(1).alias("rank"), "id")
    every = known.unionByName(inner).where("at is not null").withColumn("block", block("at"))
    asked = hits.select("file_id", "line").distinct().withColumn("block", F.explode(F.array_distinct(F.array(F.floor((F.col("line") - distance) / width), F.floor((F.col("line") + distance) / width)))))
    met = asked.join(every, ["file_id", "block"]).where(F.abs(F.col("line") - F.col("at")) <= distance)
    best = met.groupBy("file_id", "line").agg(F.max_by(F.struct("symbol", "symbol_kind", "entity"), F.struct("rank", "id")).alias("s"))
    return best.select("file_id", "line", "s.*")


def rank(hits: DataFrame, now_ms: int, symbols: DataFrame | None = None) -> DataFrame:
    """Hits with ``score``: the number of hits in the file, points for headers, public folders and recent files, for lines
    that define something, for symbols near, less points for hits whose words are only near each other."""
    density = hits.groupBy("file_id").agg(F.count("*").alias("density"))
    out = hits.join(density, "file_id")
    path = F.col("path")
    score = (
        F.col("density")
        + F.when(path.endswith(".h") | path.endswith(".hpp"), 5).otherwise(0)
        + F.when(path.contains("/Public/"), 3).otherwise(0)
        + scoring.recency(F.col("mtime"), now_ms)
        + F.when(scoring.is_definition(F.col("match")), 8).otherwise(0)
    )
    if symbols is not None:
        out = out.join(symbols, ["file_id", "line"], "left")
        score = score + F.when(F.col("symbol").isNotNull(), 6).otherwise(0)
    if "near" in hits.columns:
        score = score - F.when(F.col("near"), 3).otherwise(0)
    return out.withColumn("score", score)


def best_hits(ranked: DataFrame, limit: int = 20) -> DataFrame:
    """The best hits by score, then line, then file, with ``rank``, the ``total`` of hits and ``truncated``."""
    order = [F.col("score").desc(), F.col("line"), F.col("file_id")]
    total = ranked.agg(F.count("*").alias("total"))
    first = ranked.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return first.join(F.broadcast(total)).withColumn("truncated", F.col("total") > limit)


def search_symbols(types: DataFrame, members: DataFrame, files: DataFrame, name: str, case_sensitive: bool = True, language: str | None = None, project: str | None = None, limit: int = 20) -> DataFrame:
    """The places where a symbol of this name is declared, types before members, then by path and line: ``rank``, ``path``,
    ``project``, ``line``, ``symbol``, ``symbol_kind``, ``total``."""
    named = lambda t: t.where(F.col("name") == name if case_sensitive else F.lower("name") == name.lower())
    own = named(types).select("id", "file_id", "line", F.col("name").alias("symbol"), F.col("kind").alias("symbol_kind"), F.lit(0).alias("is_member"))
    inner = named(members).dropDuplicates(["id"]).select("id", "file_id", "line", F.col("name").alias("symbol"), F.col("member_kind").alias("symbol_kind"), F.lit(1).alias("is_member"))
    owners = files.select(F.col("id").alias("file_id"), "path", "project", "language")
    if language not in (None, "all"):
        owners = owners.where(F.col("language") == language)
    if project is not None:
        owners = owners.where(F.col("project") == project)
    found = own.unionByName(inner).join(owners, "file_id")
    order = [F.col("is_member"), F.col("path"), F.col("line"), F.col("id")]
    first = found.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return first.join(F.broadcast(found.agg(F.count("*").alias("total")))).select("rank", "path", "project", "line", "symbol", "symbol_kind", "total")


def by_file(hits: DataFrame) -> DataFrame:
    """Hits grouped by file: ``path``, ``project``, ``n``, ``matches`` (line, match) in line order; files with most hits first.
    Give it a limited result (``best_hits``): the hits of a file stand in one row."""
    grouped = hits.groupBy("path", "project").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("line", "match"))).alias("matches"))
    return grouped.orderBy(F.col("n").desc(), "path")


def asset_texts(assets: DataFrame) -> DataFrame:
    """A text for each asset, so that a search finds its name, place, class and parent: ``id``, ``path``, ``content``."""
    empty = F.lit("")
    return assets.select("id", "path", "project", F.concat_ws("\n", "name", "content_path", F.coalesce("asset_class", empty), F.coalesce("parent_class", empty)).alias("content"))


def search_assets(assets: DataFrame, pattern: str) -> DataFrame:
    """Assets with a matching line: ``path``, ``matched_fields`` and the distinct matching lines in order, joined by `` | ``."""
    lines = asset_texts(assets).select("id", "path", F.posexplode(F.split("content", "\n")).alias("at", "text")).where(F.col("text").rlike(pattern) & (F.col("text") != ""))
    first = lines.groupBy("id", "path", "text").agg(F.min("at").alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "text")))
    return first.groupBy("id", "path").agg(F.count("*").alias("matched_fields"), F.array_join(F.transform(listed, lambda x: x["text"]), " | ").alias("match")).drop("id")


def context_of(symbols: DataFrame, content: DataFrame, lines: int = 2) -> DataFrame:
    """Symbols (``file_id``, ``line``) with the line they stand on (``signature``, trimmed) and the lines around it
    (``context``); nulls where there is no such line. Repeated rows of symbols come once. Joined by file and line, so
    that the text of a file with very many symbols is not copied for each of them."""
    columns = symbols.columns
    asked = symbols.select("*", F.explode(F.sequence(F.col("line") - lines, F.col("line") + lines)).alias("_at"))
    asked = asked.unionByName(symbols.where("line is null").withColumn("_at", F.lit(None).cast("int")))
    there = text.lines(content.select("file_id", "content")).select(F.col("file_id").alias("_file"), F.col("line").alias("_line"), F.col("text").alias("_text"))
    met = asked.join(there, (F.col("file_id") == F.col("_file")) & (F.col("_at") == F.col("_line")), "left")
    own = F.max(F.when(F.col("_line") == F.col("line"), F.col("_text")))
    near = F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct("_line", "_text"))))
    found = met.groupBy(*columns).agg(own.alias("_own"), near.alias("_near"))
    return found.select(*columns, F.trim("_own").alias("signature"), F.when(F.col("_own").isNotNull(), F.transform("_near", lambda x: x["_text"])).alias("context"))


def trigram_files(content: DataFrame, pattern: str) -> DataFrame:
    """The files that have all trigrams of the pattern's literal runs (``file_id``); all files if it has none."""
    wanted = sorted({g for r in literals(pattern) for g in trigrams.trigram_list(r)})
    rows = content.where("content is not null")
    return rows.where(reduce(lambda a, b: a & b, [F.lower("content").contains(g) for g in wanted])).select("file_id") if wanted else rows.select("file_id")


def shape(hits: DataFrame, mode: str) -> DataFrame:
    """Hits as a search client asks for them: ``files``, ``count`` per file, or ``content`` (path, line, shortened match)."""
    if mode == "files":
        return hits.select("path").distinct()
    if mode == "count":
        return hits.groupBy("path").agg(F.count("*").alias("n"))
    return hits.select("path", "line", text.shorten(F.col("match")).alias("match"))
