"""Keeping the tables of the index up to date: differences, upserts, replacements and deletions.

Every function takes frames and returns frames; a batch becomes visible when its result is written as a new version
(see ``codeloom.streaming``), so a batch that is run again gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import names
from codeloom.functions.text import content_hash
from codeloom.operators.skew import range_scan
from codeloom.session import Scratch

#: Languages whose files must have a stored text.
TEXT_LANGUAGES = ("angelscript", "cpp", "config")


def mtimes(files: DataFrame, content: DataFrame) -> DataFrame:
    """``path`` and ``mtime`` of the files; the time is null where a text should be stored and is not, so that the file
    is read again."""
    stored = content.where("content is not null").select(F.col("file_id").alias("id"), F.lit(True).alias("_has"))
    lacks = F.col("language").isin(*TEXT_LANGUAGES) & F.col("_has").isNull()
    return files.join(stored, "id", "left").select("path", F.when(~F.coalesce(lacks, F.lit(False)), F.col("mtime")).alias("mtime"))


def without_content(files: DataFrame, content: DataFrame) -> DataFrame:
    """The files that have no stored text: ``id``, ``path``."""
    return files.join(content.where("content is not null").select(F.col("file_id").alias("id")), "id", "left_anti").select("id", "path")


def difference(disk: DataFrame, stored: DataFrame) -> DataFrame:
    """What to do so that the stored files (``path``, ``mtime``) agree with the disk: ``path``, ``status`` (new, changed
    or deleted). A different time counts as changed, also an older one; a null stored time as well."""
    a = disk.select("path", F.col("mtime").alias("now"), F.lit(True).alias("_disk"))
    b = stored.select("path", F.col("mtime").alias("was"), F.lit(True).alias("_stored"))
    both = a.join(b, "path", "full_outer")
    status = F.when(F.col("_stored").isNull(), "new").when(F.col("_disk").isNull(), "deleted").when(~F.col("now").eqNullSafe(F.col("was")), "changed")
    return both.select("path", status.alias("status")).where("status is not null")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; of rows equal in it, the largest."""
    fields = [c for c in rows.columns if c not in (key, *order)]
    best = rows.groupBy(key).agg(F.max(F.struct(*order, *fields)).alias("r"))
    return best.select(key, *[F.col(f"r.{c}").alias(c) for c in (*order, *fields)])


def numbered(rows: DataFrame, order: list[str], after, scratch: Scratch, out: str = "id") -> DataFrame:
    """Adds ids that go on after the largest of a frame (``after``: its one-row maximum), in an order, over any number of
    rows: the places come from a sorted scan over all partitions."""
    placed = range_scan(rows.withColumn("_all", F.lit(0).cast("long")), ["_all"], order, scratch).drop("_all")
    top = F.broadcast(after.select(F.coalesce(F.col(after.columns[0]), F.lit(0)).alias("_top")))
    return placed.join(top).withColumn(out, F.col("_top") + F.col("_pos") + 1).drop("_top", "_pos")


def upsert_files(files: DataFrame, incoming: DataFrame, scratch: Scratch) -> DataFrame:
    """The files after an upsert by path. A known path keeps its id, and its relative path if the new one is null."""
    old = files.select("path", "id", F.col("relative_path").alias("_old"))
    joined = scratch.save(incoming.dropDuplicates(["path"]).join(old, "path", "left").withColumn("relative_path", F.coalesce("relative_path", "_old")).drop("_old"))
    fresh = numbered(joined.where("id is null").drop("id"), ["path"], files.agg(F.max("id")), scratch)
    rows = joined.where("id is not null").unionByName(fresh)
    rows = rows.withColumn("path_lower", names.path_lower(F.col("path"))).withColumn("basename_lower", names.basename_lower(F.col("path")))
    kept = files.join(rows.select("path"), "path", "left_anti")
    return kept.select(*files.columns).unionByName(rows.select(*files.columns))


def upsert_assets(assets: DataFrame, incoming: DataFrame, scratch: Scratch) -> DataFrame:
    """The assets after an upsert by path; a known path keeps its id."""
    joined = scratch.save(incoming.dropDuplicates(["path"]).join(assets.select("path", "id"), "path", "left"))
    fresh = numbered(joined.where("id is null").drop("id"), ["path"], assets.agg(F.max("id")), scratch)
    rows = joined.where("id is not null").unionByName(fresh).select(*assets.columns)
    return assets.join(rows.select("path"), "path", "left_anti").select(*assets.columns).unionByName(rows)


def delete_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the files of ``gone`` (``file_id``) and all that belongs to them."""
    out = dict(tables)
    out["files"] = tables["files"].join(gone.select(F.col("file_id").alias("id")), "id", "left_anti")
    for name in ("types", "members", "file_content"):
        if name in tables:
            out[name] = tables[name].join(gone.select("file_id"), "file_id", "left_anti")
    return out


def resolve_owners(members: DataFrame, types: DataFrame) -> DataFrame:
    """``members`` (``file_id``, ``owner``) with ``type_id``: the last type of that name in the same file, or null."""
    known = types.groupBy("file_id", F.col("name").alias("owner")).agg(F.max("id").alias("type_id"))
    return members.join(known, ["file_id", "owner"], "left")


def replace_symbols(types: DataFrame, members: DataFrame, symbols: DataFrame, changed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Types and members after the files of ``changed`` (``file_id``) have been parsed again into ``symbols``."""
    new_types = numbered(symbols.where("entity = 'type'").select("file_id", "name", "kind", "parent", "line"), ["file_id", "line", "name"], types.agg(F.max("id")), scratch)
    new_types = scratch.save(new_types.withColumn("depth", F.lit(None).cast("int")).select(*types.columns))
    new_members = symbols.where("entity = 'member'").select("file_id", "name", F.col("kind").alias("member_kind"), "line", "is_static", "specifiers", "owner")
    new_members = numbered(resolve_owners(new_members, new_types).drop("owner"), ["file_id", "line", "name"], members.agg(F.max("id")), scratch)
    drop = changed.select("file_id").distinct()
    return (
        types.join(drop, "file_id", "left_anti").select(*types.columns).unionByName(new_types),
        members.join(drop, "file_id", "left_anti").select(*members.columns).unionByName(new_members.select(*members.columns)),
    )


def changed_only(incoming: DataFrame, files: DataFrame, content: DataFrame) -> DataFrame:
    """The incoming files that are to be processed: all but those with the stored time whose text is stored already."""
    stored = files.join(content.where("content is not null").select(F.col("file_id").alias("id"), F.lit(True).alias("_has")), "id", "left").select("path", F.col("mtime").alias("_was"), "_has")
    same = F.col("_was").eqNullSafe(F.col("mtime")) & F.col("_was").isNotNull() & (F.col("content").isNull() | F.coalesce("_has", F.lit(False)))
    return incoming.join(stored, "path", "left").where(~same).drop("_was", "_has")


def ingest(tables: dict[str, DataFrame], incoming: DataFrame, assets: DataFrame | None, deletes: DataFrame, parse) -> dict[str, DataFrame]:
    """The tables after one batch: first ``deletes`` (``path``, of files, else of assets), then files (``path``,
    ``project``, ``module``, ``mtime``, ``language``, ``relative_path``, ``content``), then ``assets``. ``parse`` makes
    symbols of texts. Applying the same batch again changes nothing."""
    scratch = Scratch(incoming.sparkSession, "ingest")
    gone = tables["files"].join(deletes.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("file_id"))
    after = delete_files(tables, gone)
    rest = deletes.join(tables["files"].select("path"), "path", "left_anti").select("path").distinct()
    after["assets"] = after["assets"].join(rest, "path", "left_anti")
    todo = scratch.save(changed_only(incoming.dropDuplicates(["path"]), after["files"], after["file_content"]))
    files = scratch.save(upsert_files(after["files"], todo.drop("content"), scratch))
    ids = files.select(F.col("id").alias("file_id"), "path").join(todo.select("path", "language", "content"), "path")
    ids = scratch.save(ids)
    types, members = replace_symbols(after["types"], after["members"], scratch.save(parse(ids)), ids, scratch)
    texts = ids.where(F.col("content").isNotNull()).select("file_id", "content", content_hash(F.col("content")).alias("content_hash"))
    stored = after["file_content"].join(texts.select("file_id"), "file_id", "left_anti").unionByName(texts)
    out = after | {"files": files, "types": types, "members": members, "file_content": stored}
    if assets is not None:
        out["assets"] = upsert_assets(after["assets"], assets, scratch)
    return out


def upsert_content(content: DataFrame, incoming: DataFrame) -> DataFrame:
    """The stored texts after those of ``incoming`` (``file_id``, ``content``) came: the hash is worked out, a text of any
    length replaces the old one, and a null text takes it away. Of several for one file the largest counts."""
    new = incoming.where("file_id is not null").groupBy("file_id").agg(F.max("content").alias("content"))
    kept = content.join(new.select("file_id"), "file_id", "left_anti")
    return kept.select("file_id", "content", "content_hash").unionByName(new.where("content is not null").withColumn("content_hash", content_hash(F.col("content"))))


def index_status(rows: DataFrame, languages: list[str]) -> DataFrame:
    """The latest status of each language (``language``, ``status``, ``at``); one never reported is pending."""
    known = rows.sparkSession.createDataFrame([(x,) for x in languages], "language string")
    last = rows.groupBy("language").agg(F.max_by("status", "at").alias("status"))
    return known.join(last, "language", "left").select("language", F.coalesce("status", F.lit("pending")).alias("status"))


def key_values(rows: DataFrame) -> DataFrame:
    """The latest JSON value of each key (``key``, ``value``, ``at``), as a variant's text."""
    last = rows.groupBy("key").agg(F.max_by("value", "at").alias("value"))
    return last.select("key", F.to_json(F.parse_json("value")).alias("value"))


def affected_projects(changes: DataFrame) -> DataFrame:
    """The projects a batch of changes touches, with the delay in ms after which they are indexed again: two seconds and
    200 ms for each change, 30 s at the most."""
    return changes.groupBy("project").agg(F.count("*").alias("pending")).select("project", "pending", F.least(F.lit(30_000), 2_000 + 200 * F.col("pending")).alias("delay_ms"))
