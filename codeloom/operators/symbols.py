"""Lookups of types, members, files and assets.

Each lookup is one plan over the tables: filters and column choices reach the scans, the ranking is a top-k, and a
fallback that applies only if a stage found nothing is decided inside the plan by the best stage that has rows.
Ties are broken by id, so results do not depend on how rows are spread.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import names, scoring, trigrams
from codeloom.functions.names import PREFIXES
from codeloom.operators.skew import range_scan
from codeloom.session import Scratch

SOURCE_LANGUAGES = (None, "all", "angelscript", "cpp")
ASSET_LANGUAGES = (None, "all", "blueprint")


@dataclass(frozen=True)
class Options:
    """Filters and limits of a lookup; None or "all" does not filter."""

    project: str | None = None
    language: str | None = None
    kind: str | None = None
    max_results: int = 10
    include_assets: bool | None = None

    def source_types(self) -> bool:
        return self.language in SOURCE_LANGUAGES

    def assets(self, fuzzy: bool) -> bool:
        wanted = self.include_assets if self.include_assets is not None else (self.language == "blueprint" or not fuzzy)
        return wanted and self.language in ASSET_LANGUAGES


def chosen(frame: DataFrame, **equal) -> DataFrame:
    """The rows that meet all given equalities; None and "all" ask nothing."""
    wanted = [F.col(c) == v for c, v in equal.items() if v not in (None, "all")]
    return frame.where(reduce(lambda a, b: a & b, wanted)) if wanted else frame


def lowered(table: DataFrame) -> Column:
    """A table's names in lower case: the stored column of a published table, so that prefix filters reach the files."""
    return F.col("name_lower") if "name_lower" in table.columns else F.lower("name")


def typed_files(types: DataFrame, files: DataFrame, options: Options) -> DataFrame:
    """Types with the path, project and language of their files, filtered; a type without a file is left out."""
    near = [c for c in ("near",) if c in types.columns]
    own = chosen(types.select("id", "file_id", "name", "kind", "parent", "line", "depth", *near), kind=options.kind)
    where = chosen(files.select(F.col("id").alias("file_id"), "path", "project", "language"), project=options.project, language=None if options.language == "blueprint" else options.language)
    return own.join(where, "file_id")


def best_stage(frame: DataFrame, stage: str = "stage") -> DataFrame:
    """The rows of the first stage that has any."""
    return frame.join(F.broadcast(frame.agg(F.min(stage).alias(stage))), stage)


def top(frame: DataFrame, order: list[Column], limit: int, rank: str = "ord") -> DataFrame:
    """The first rows in an order, numbered from 1. Only these few are ever brought together."""
    first = frame.orderBy(*order).limit(limit)
    return first.withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def deduplicate(frame: DataFrame) -> DataFrame:
    """One row per name and kind of a ranked result (column ``ord``): the best by ``structure``, the first in rank among
    equals. ``implementation_path``: the last ``.cpp`` path among the later losers, else the path of the row that was
    best until the kept one came, if that ends in ``.cpp``."""
    w = Window.partitionBy("name", "kind").orderBy(F.col("structure").desc(), "ord")
    ranked = frame.withColumn("_best", F.row_number().over(w)).withColumn("_kept", F.first("ord").over(w))
    source = F.col("path").endswith(".cpp")
    fields = [c for c in frame.columns if c not in ("name", "kind")]
    groups = ranked.groupBy("name", "kind").agg(
        F.min_by(F.struct(*fields), "_best").alias("row"),
        F.max_by(F.when((F.col("ord") > F.col("_kept")) & source, F.col("path")), F.when((F.col("ord") > F.col("_kept")) & source, F.col("ord"))).alias("later"),
        F.min_by(F.when(F.col("ord") < F.col("_kept"), F.struct("path")), F.when(F.col("ord") < F.col("_kept"), F.col("_best"))).alias("before"),
    )
    earlier = F.when(F.col("before.path").endswith(".cpp"), F.col("before.path"))
    return groups.select("name", "kind", *[F.col(f"row.{c}").alias(c) for c in fields], F.coalesce("later", earlier).alias("implementation_path"))


TYPE_COLUMNS = ["name", "kind", "parent", "line", "path", "project", "match_reason", "implementation_path", "structure", "rank"]


def _ranked(frame: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    if limit is not None:
        frame = frame.orderBy(*order).limit(limit)
    return frame.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _asset_rows(assets: DataFrame, names_wanted: list[str], options: Options) -> DataFrame:
    rows = chosen(assets.where(F.col("name").isin(names_wanted) & F.col("asset_class").isNotNull()), project=options.project)
    return rows.select("id", "name", F.lit("class").alias("kind"), F.col("parent_class").alias("parent"), F.lit(0).alias("line"), F.col("content_path").alias("path"), "project")


def find_type(types: DataFrame, files: DataFrame, assets: DataFrame, name: str, options: Options = Options()) -> DataFrame:
    """Types of exactly this name, headers first; if there are none, of its prefix variants; then assets of the name
    while there is room, and if nothing at all was found and the name ends in ``_C``, assets of the name without it.
    Duplicates of a name and kind are merged; the result is ordered by ``structure``. An empty table finds nothing."""
    parts = []
    if options.source_types():
        variants = names.prefix_variants(name)
        found = typed_files(types.where(F.col("name").isin([name, *variants])), files, options)
        found = found.withColumn("stage", F.when(F.col("name") == name, 0).otherwise(1))
        parts.append(found.select("id", "name", "kind", "parent", "line", "path", "project", "stage"))
    if options.assets(fuzzy=False):
        wanted = [name, name[:-2]] if name.endswith("_C") else [name]
        rows = _asset_rows(assets, wanted, options)
        parts.append(rows.withColumn("stage", F.when(F.col("name") == name, 2).otherwise(3)))
    if not parts:
        return types.sparkSession.createDataFrame([], "name string, kind string, parent string, line int, path string, project string, match_reason string, implementation_path string, structure double, rank int")
    every = reduce(DataFrame.unionByName, parts)
    seen = every.agg(F.min("stage").alias("first"))
    kept = every.join(F.broadcast(seen)).where(
        (F.col("stage") == F.col("first")) | ((F.col("stage") == 2) & (F.col("first") < 2))
    )
    header = F.when(F.col("path").rlike(scoring.HEADER), 0).otherwise(1)
    order = [F.col("is_asset"), F.col("header"), F.col("id")]
    kept = kept.withColumn("is_asset", (F.col("stage") >= 2).cast("int")).withColumn("header", F.when(F.col("stage") >= 2, 0).otherwise(header))
    kept = top(kept, order, options.max_results)
    kept = kept.withColumn("structure", scoring.structural_score(F.col("parent"), F.col("path"))).withColumn("match_reason", F.when(F.col("stage") == 1, "prefix-variant").otherwise("exact"))
    return _ranked(deduplicate(kept), [F.col("structure").desc(), F.col("ord")]).select(*TYPE_COLUMNS)


def near_or_deep(symbols: DataFrame, query: str, starts: list[str], long: bool, posted: DataFrame | None, entity: str) -> DataFrame:
    """The symbols whose lower-case name begins with one of ``starts`` (``near``), or has enough trigrams of the query (of one
    with few trigrams: contains it). The filter stands right on the scan. With stored postings (``posted``) the second kind
    is looked up there, and only ids and names of the first kind are searched for."""
    low, grams = lowered(symbols), trigrams.trigram_list(query)
    prefix = reduce(lambda a, b: a | b, [low.startswith(s) for s in starts])  # as it is in filters, so that it is pushed down
    by_grams = long and len(grams) >= 3
    deep = trigrams.shared(F.col("name"), grams) >= trigrams.needed(query) if by_grams else low.contains(query)
    if posted is None or not by_grams:
        return symbols.where(prefix | deep).withColumn("near", F.coalesce(prefix, F.lit(False)))
    ids = trigrams.candidates(posted, query, entity).select(F.col("entity_id").alias("id"))
    near = symbols.where(prefix).withColumn("near", F.lit(True))
    return near.unionByName(symbols.join(ids, "id", "left_semi").where(~prefix).withColumn("near", F.lit(False)))


def gated(candidates: DataFrame, limit: int, label: str) -> DataFrame:
    """The candidates that are ``near``, and the others only while those are fewer than the limit. The candidates, few of
    all symbols, are saved once; the number that decides is counted meanwhile."""
    kept, found = Scratch(candidates.sparkSession, label).measured(candidates, near=F.count_if("near"))
    return kept if found["near"] < limit else kept.where("near")


def find_type_fuzzy(types: DataFrame, files: DataFrame, assets: DataFrame, query: str, options: Options = Options(), posted: DataFrame | None = None) -> DataFrame:
    """Types whose names resemble the query. Names that begin with it, or with a prefix variant of it, are candidates;
    if these are fewer than the limit, so are names that share enough trigrams (for a short query: that contain it).
    Candidates are scored, those below 0.4 dropped, duplicates merged, the best by score kept, ordered by ``structure``.
    ``posted``: stored postings of the names, if there are any."""
    q = query.lower()
    qs = (query[1:] if query[:1] in PREFIXES else query).lower()
    starts = sorted({q} | {p.lower() + x for p in PREFIXES for x in {q, qs}})
    parts = []
    if options.source_types():
        found = near_or_deep(types, q, starts, len(q) >= 3, posted, "type")
        rows = gated(typed_files(found, files, options), options.max_results, "types")
        parts.append(rows.select("id", "name", "kind", "parent", "line", "path", "project", "depth", F.lit(0).alias("is_asset")))
    if options.assets(fuzzy=True):
        rows = chosen(assets.where(F.col("asset_class").isNotNull() & lowered(assets).contains(q)), project=options.project)
        parts.append(rows.select("id", "name", F.lit("class").alias("kind"), F.col("parent_class").alias("parent"), F.lit(0).alias("line"), F.col("content_path").alias("path"), "project", F.lit(None).cast("int").alias("depth"), F.lit(1).alias("is_asset")))
    every = reduce(DataFrame.unionByName, parts)
    scored = scoring.score_types(every, query).where("score >= 0.4")
    scored = scored.withColumn("structure", scoring.structural_score(F.col("parent"), F.col("path")))
    # Merging duplicates before the cut needs an order within a name and kind only.
    within = Window.partitionBy("name", "kind").orderBy(F.col("score").desc(), "is_asset", "id")
    merged = deduplicate(scored.withColumn("ord", F.row_number().over(within)))
    order = [F.col("structure").desc(), F.col("score").desc(), F.col("is_asset"), F.col("id")]
    return _ranked(merged, order, options.max_results).select(*TYPE_COLUMNS, "score")


def member_rows(members: DataFrame, types: DataFrame, files: DataFrame, options: Options) -> DataFrame:
    """Members with the name of their type (null for free functions) and their file, filtered. Repeated rows count once;
    filter ``members`` before, so that only the rows asked for are shuffled."""
    own = chosen(members, member_kind=options.kind).dropDuplicates(["id"])
    where = chosen(files.select(F.col("id").alias("file_id"), "path", "project", "language"), project=options.project, language=options.language)
    owner = types.select(F.col("id").alias("type_id"), F.col("name").alias("type_name"))
    return own.join(where, "file_id").join(owner, "type_id", "left")


MEMBER_COLUMNS = ["name", "type_name", "member_kind", "line", "is_static", "specifiers", "path", "project"]


def find_member(members: DataFrame, types: DataFrame, files: DataFrame, name: str, options: Options = Options(max_results=20), containing: str | None = None, hierarchy: DataFrame | None = None) -> DataFrame:
    """Members of exactly this name by id. ``containing`` keeps those of that type or of its mixin libraries (names that
    begin with ``<type>MixinLibrary``); with ``hierarchy`` (column ``name``) those of any of its types as well."""
    rows = member_rows(members.where(F.col("name") == name), types, files, options)
    if containing is not None:
        inside = (F.col("type_name") == containing) | F.col("type_name").startswith(containing + "MixinLibrary")
        if hierarchy is not None:
            family = hierarchy.select(F.col("name").alias("type_name"), F.lit(True).alias("_in")).distinct()
            rows = rows.join(family, "type_name", "left").where(inside | F.col("_in"))
        else:
            rows = rows.where(inside)
    return _ranked(rows, [F.col("id")], options.max_results).select("rank", *MEMBER_COLUMNS)


def find_member_fuzzy(members: DataFrame, types: DataFrame, files: DataFrame, query: str, options: Options = Options(max_results=20), posted: DataFrame | None = None) -> DataFrame:
    """Members whose names resemble the query: that begin with it, or share enough of its trigrams if those are fewer
    than the limit. Scored with their specifiers, those below 0.15 dropped, the best kept; ties by id.
    ``posted``: stored postings of the names, if there are any."""
    q = query.lower()
    found = near_or_deep(members, q, [q], True, posted, "member")
    rows = gated(member_rows(found, types, files, options), options.max_results, "members")
    scored = scoring.score_members(rows, query).where("score >= 0.15")
    return _ranked(scored, [F.col("score").desc(), F.col("id")], options.max_results).select("rank", *MEMBER_COLUMNS, "score", "match_reason")


def synthetic_members(found: DataFrame, ancestors: DataFrame, containing: str, query: str, fuzzy: bool, limit: int, base: str = "UActorComponent") -> DataFrame:
    """``found`` with the two static accessors ``Get`` and ``GetOrCreate`` that every component type has without
    declaring them, if ``containing`` descends from ``base`` (is one of ``ancestors.name``'s descendants), the name
    fits and there is room."""
    spark = found.sparkSession
    wanted = [m for m in ("Get", "GetOrCreate") if (m.lower().startswith(query.lower()) if fuzzy else m == query)]
    rows = spark.createDataFrame([(m, containing, "function", 0, True, i) for i, m in enumerate(wanted, 1)], "name string, type_name string, member_kind string, line int, is_static boolean, n int")
    is_component = ancestors.where(F.col("name") == base).limit(1).select(F.lit(1).alias("_yes"))
    room = found.agg(F.count("*").alias("_n"))
    rows = rows.join(F.broadcast(is_component)).join(F.broadcast(room)).where(F.col("_n") + F.col("n") <= limit)
    rows = rows.withColumn("rank", (F.col("_n") + F.col("n")).cast("int"))
    return found.unionByName(rows.select("rank", "name", "type_name", "member_kind", "line", "is_static"), allowMissingColumns=True)


def members_of(members: DataFrame, types: DataFrame, type_name: str, max_functions: int = 30, max_properties: int = 30) -> DataFrame:
    """The members of all declarations of a type, in three buckets: the first functions, the first properties and all
    enum values by id; ``n_in_bucket`` is the bucket's whole size, so a larger one was cut."""
    scratch = Scratch(members.sparkSession, "members")
    bucket = F.when(F.col("member_kind").isin("function", "method"), "function").when(F.col("member_kind") == "enum_value", "enum_value").otherwise("property")
    own = members.dropDuplicates(["id"]).join(types.where(F.col("name") == type_name).select(F.col("id").alias("type_id")), "type_id", "left_semi")
    own = scratch.save(own.select(bucket.alias("bucket"), "id", "name", "member_kind", "line", "is_static", "specifiers"))
    sizes = own.groupBy("bucket").agg(F.count("*").alias("n_in_bucket"))
    parts = [top(own.where(F.col("bucket") == b), [F.col("id")], limit, "n") for b, limit in (("function", max_functions), ("property", max_properties))]
    values = range_scan(own.where("bucket = 'enum_value'"), ["bucket"], ["id"], scratch)
    parts.append(values.withColumn("n", (F.col("_pos") + 1).cast("int")).drop("_pos"))
    numbered = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return numbered.join(F.broadcast(sizes), "bucket").select("bucket", "n", "id", "name", "member_kind", "line", "is_static", "specifiers", "n_in_bucket")


def find_file(files: DataFrame, types: DataFrame, query: str, options: Options = Options(max_results=20), max_types: int = 10) -> DataFrame:
    """Files whose base name is, begins with or contains the query (its extension aside), best first, then by the length
    of the path, each with its first types as an array of (name, kind, line)."""
    stem = query.rsplit(".", 1)[0] if "." in query.lstrip(".") else query
    rows = chosen(files.where(F.col("basename_lower").contains(stem.lower())), project=options.project, language=options.language)
    rows = rows.withColumn("score", scoring.file_match(F.col("path"), F.col("basename_lower"), stem)).where(F.col("score").isNotNull())
    best = _ranked(rows, [F.col("score").desc(), F.length("path"), F.col("id")], options.max_results).select("rank", "id", "path", "project", "module", "language", "score")
    return best.join(first_types(types.join(F.broadcast(best.select(F.col("id").alias("file_id"))), "file_id", "left_semi"), max_types), best["id"] == F.col("file_id"), "left").drop("file_id", "id")


def first_types(types: DataFrame, limit: int = 10) -> DataFrame:
    """The first types of each file by id, nested: ``file_id``, ``types``."""
    w = Window.partitionBy("file_id").orderBy("id")
    kept = types.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    nested = F.array_sort(F.collect_list(F.struct("_n", "name", "kind", "line")))
    return kept.groupBy("file_id").agg(F.transform(nested, lambda t: F.struct(t["name"].alias("name"), t["kind"].alias("kind"), t["line"].alias("line"))).alias("types"))


def find_asset(assets: DataFrame, name: str, fuzzy: bool = True, project: str | None = None, folder: str | None = None, limit: int = 20) -> DataFrame:
    """Assets by name. Not fuzzy: of exactly this name, and only if there is none, of the name in any letter case.
    Fuzzy: whose name is, begins with or contains it. ``folder`` keeps paths that begin with it, as text."""
    rows = chosen(assets, project=project)
    if folder is not None:
        rows = rows.where(F.col("folder").startswith(folder))
    if fuzzy:
        rows = rows.withColumn("score", scoring.asset_match(F.col("name"), name)).where(F.col("score").isNotNull())
    else:
        rows = rows.where(F.lower("name") == name.lower()).withColumn("stage", F.when(F.col("name") == name, 0).otherwise(1))
        rows = best_stage(rows).withColumn("score", F.lit(1.0))
    return _ranked(rows, [F.col("score").desc(), F.col("id")], limit).select("rank", "name", "content_path", "folder", "project", "asset_class", "parent_class", "score")


def browse_module(types: DataFrame, files: DataFrame, module: str, options: Options = Options(max_results=100), max_files: int = 50) -> DataFrame:
    """The types of a module and the modules below it by id, and its files: ``entry`` (type or file), ``name``, ``kind``,
    ``path``, ``rank``, ``truncated`` (there were more), ``total_files`` (of the subtree, with or without types)."""
    inside = chosen(files.where(names.under(F.col("module"), module)), project=options.project, language=options.language)
    total = inside.agg(F.count("*").alias("total_files"))
    typed = types.join(inside.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.lit("type").alias("entry"), "id", "name", "kind", "path")
    plain = inside.select(F.lit("file").alias("entry"), "id", F.col("basename_lower").alias("name"), F.col("language").alias("kind"), "path")
    parts = []
    for rows, limit in ((typed, options.max_results), (plain, max_files)):
        more = _ranked(rows, [F.col("id")], limit + 1)
        many = more.agg((F.count("*") > limit).alias("truncated"))
        parts.append(more.where(F.col("rank") <= limit).join(F.broadcast(many)))
    return parts[0].unionByName(parts[1]).join(F.broadcast(total)).select("entry", "rank", "name", "kind", "path", "truncated", "total_files")


def list_below(paths: DataFrame, column: str, parent: str, separator: str, depth: int, out: str) -> DataFrame:
    """Counts of rows per path cut to ``depth`` parts below ``parent``; the parent itself and what is not below it are
    left out. ``out`` names the result's path column."""
    base = len([p for p in parent.split(separator) if p])
    inside = paths.where(names.under(F.col(column), parent.rstrip(separator), separator)) if parent.strip(separator) else paths
    parts = F.filter(F.split(F.col(column), r"\." if separator == "." else separator), lambda p: p != "")
    deep = inside.where(F.size(parts) > base)
    return deep.groupBy(names.path_depth_prefix(F.col(column), separator, base + depth).alias(out)).agg(F.count("*").alias("n"))


def list_modules(files: DataFrame, parent: str = "", project: str | None = None, depth: int = 1) -> DataFrame:
    """Modules below a parent with their numbers of files; rows of content and asset texts do not count."""
    rows = chosen(files.where(~F.coalesce(F.col("language").isin("content", "asset"), F.lit(False))), project=project)
    return list_below(rows, "module", parent, ".", depth, "module")


def list_asset_folders(assets: DataFrame, parent: str = "/Game", project: str | None = None, depth: int = 1) -> DataFrame:
    return list_below(chosen(assets, project=project), "folder", parent, "/", depth, "folder")


def browse_assets(assets: DataFrame, folder: str, project: str | None = None, limit: int = 100) -> DataFrame:
    """The assets of exactly this folder by name, with ``truncated`` (there were more)."""
    rows = chosen(assets.where(F.col("folder") == folder), project=project)
    more = _ranked(rows, [F.col("name"), F.col("id")], limit + 1)
    many = more.agg((F.count("*") > limit).alias("truncated"))
    return more.where(F.col("rank") <= limit).join(F.broadcast(many)).select("rank", "name", "content_path", "asset_class", "truncated")


def find_types_batch(types: DataFrame, files: DataFrame, wanted: DataFrame, limit: int = 10) -> DataFrame:
    """Exact lookups of many names in one job: for each row of ``wanted`` (``query``) its types, or if it has none those
    of its prefix variants; headers first, at most ``limit`` each. A name asked for twice is answered once."""
    asked = wanted.select("query").where("query is not null").distinct()
    letters = F.array(*[F.lit(p) for p in PREFIXES])
    bare = names.strip_loose(F.col("query"))
    spellings = F.array_union(F.transform(letters, lambda p: F.concat(p, "query")), F.when(bare != F.col("query"), F.array_union(F.transform(letters, lambda p: F.concat(p, bare)), F.array(bare))).otherwise(F.array().cast("array<string>")))
    keys = asked.select("query", F.explode(F.array_union(F.array("query"), spellings)).alias("name"))
    keys = keys.withColumn("stage", F.when(F.col("name") == F.col("query"), 0).otherwise(1))
    found = typed_files(types, files, Options()).join(keys, "name")
    # The stage leads the order, so the first rows of a name hold those of its best stage. A limit on a row number is applied
    # where the rows are read too (partial window group limit), so a name on very many rows does not gather in one task.
    first = Window.partitionBy("query").orderBy("stage", F.when(F.col("path").rlike(scoring.HEADER), 0).otherwise(1), "id")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= limit)
    ranked = ranked.withColumn("best", F.min("stage").over(Window.partitionBy("query"))).where("stage = best")
    return ranked.select("query", "rank", "name", "kind", "parent", "line", "path", "project", F.when(F.col("stage") == 1, "prefix-variant").otherwise("exact").alias("match_reason"))
