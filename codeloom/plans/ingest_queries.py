"""Queries over the upkeep of the tables, and over streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import trigrams
from codeloom.operators import ingest as I
from codeloom.operators import logs as L
from codeloom.operators import upkeep as U
from codeloom.operators import patches
from codeloom.plans.core_problems import ORACLE as CORE
from codeloom.plans.search_queries import _t, trigram_sql
from codeloom.session import Scratch, table
from codeloom.sources import parsers
from codeloom.streaming import changes as C


def _disk(s, d):
    """What the disk holds by the change feed: the present paths in their lower-case form."""
    state = patches.apply_patches(patches.composed(table(s, d, "file_changes")))
    return state.where("present").select(F.col("path_lower").alias("path"), "mtime")


def _diff(s, d):
    return I.difference(_disk(s, d), _t(s, d, "files")[0].select(F.col("path_lower").alias("path"), "mtime"))


def _incoming(s, d):
    """The paths of the feed whose project is known, each with its last change, as files to be stored."""
    feed = _t(s, d, "file_changes")[0].where("lower(op) <> 'unlink' and project is not null and path not like '%\\\\\\\\%'")
    last = I.latest(feed.select("path", "session_no", "event_seq", "mtime", "project"), "path", ["session_no", "event_seq"])
    return last.select("path", "project", F.col("project").alias("module"), F.lit("cpp").alias("language"), "mtime", F.lit(None).cast("string").alias("relative_path"))


def _upsert(s, d):
    files = _t(s, d, "files")[0]
    after = I.upsert_files(files, _incoming(s, d), Scratch(s, "upsert"))
    return after.select("id", "path", "project", "mtime", "relative_path", "path_lower", "basename_lower")


def _upsert_assets(s, d):
    assets = _t(s, d, "assets")[0]
    moved = assets.where("asset_class = 'Material'").withColumn("mtime", F.col("mtime") + 1).drop("id")
    new = assets.where("asset_class = 'SoundWave'").withColumn("path", F.concat("path", F.lit(".copy"))).drop("id")
    return I.upsert_assets(assets, moved.unionByName(new), Scratch(s, "assets")).select("id", "path", "name", "mtime", "asset_class")


def _cascade(s, d):
    tables = {n: table(s, d, n) for n in ("files", "types", "members", "file_content")}
    tables["members"] = tables["members"].dropDuplicates(["id"])
    after = I.delete_files(tables, tables["files"].where("project = 'Tidegate'").select(F.col("id").alias("file_id")))
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, t in after.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


def _owners(s, d):
    members, types = _t(s, d, "members", "types")
    own = members.dropDuplicates(["id"]).select("id", "type_id").join(types.select(F.col("id").alias("type_id"), "file_id", F.col("name").alias("owner")), "type_id").drop("type_id")
    return I.resolve_owners(own, types).select("id", "type_id")


def _symbols(s, d):
    content, files = _t(s, d, "file_content", "files")
    return parsers.symbols(content.join(files.select(F.col("id").alias("file_id"), "language"), "file_id"))


def _mtimes_of(s, d):
    files, feed = _t(s, d, "files", "file_changes")
    return files.join(feed.select("path").distinct(), "path", "left_semi").select("path", "mtime")


def _after_ingest(s, d):
    """The tables after a batch: one project's texts come again with a later time, another's files go."""
    tables = {n: table(s, d, n) for n in ("files", "types", "members", "file_content", "assets")}
    tables["members"] = tables["members"].dropDuplicates(["id"])
    files = tables["files"].where("project = 'Tidegate'")
    texts = files.join(tables["file_content"].select(F.col("file_id").alias("id"), "content"), "id")
    incoming = texts.select("path", "project", "module", (F.col("mtime") + 1).alias("mtime"), "language", "relative_path", "content")
    deletes = tables["files"].where("project = 'Tidegate-Cpp'").select("path")
    return I.ingest(tables, incoming, None, deletes, parsers.symbols), "Tidegate"


def _ingest(s, d):
    after, _ = _after_ingest(s, d)
    kept = after["files"].select(F.lit("files").alias("name"), "id").union(after["file_content"].select(F.lit("file_content"), "file_id"))
    return kept.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


def _feed(s, d):
    return C.read_stream(s, f"{d}/file_changes.parquet")


def _stream_state(s, d):
    return patches.apply_patches(C.maintain_state(_feed(s, d))).where("present").select("path_lower", "session_no", "event_seq")


def _args(s, d):
    """Titles and counts as the arguments of calls, as a log of tool calls keeps them."""
    given = F.to_json(F.struct(F.col("text").alias("query"), F.col("n_chars").alias("limit")))
    return _t(s, d, "documents")[0].select("doc_id", F.get_json_object(L.summarised_arguments(given), "$.query").alias("query"), F.get_json_object(L.summarised_arguments(given), "$.limit").alias("limit"))


def _tables(s, d):
    tables = {n: table(s, d, n) for n in ("files", "types", "members", "file_content", "assets")}
    return tables | {"members": tables["members"].dropDuplicates(["id"])}


def _scanned(s, d, where):
    files, texts = _t(s, d, "files", "file_content")
    return files.where(where).join(texts.select(F.col("file_id").alias("id"), "content"), "id", "left").select("path", "project", "module", "mtime", "language", "relative_path", "content")


def _symbols_of(tables, *ids):
    """Types and members, each with the path of its file, as rows that can be compared."""
    files = tables["files"].select(F.col("id").alias("file_id"), "path", *ids)
    types = tables["types"].join(files, "file_id").select("path", F.lit("type").alias("entity"), "name", "kind", "line")
    members = tables["members"].join(files, "file_id").select("path", F.lit("member").alias("entity"), "name", F.col("member_kind").alias("kind"), "line")
    return types.unionByName(members)


def _rebuilt(s, d):
    """The files left after a rebuild of a language from which a project is gone, each with whether its text is stored."""
    tables = _tables(s, d)
    after = U.rebuild_language(tables, "angelscript", _scanned(s, d, "language = 'angelscript' and project <> 'Tidegate'"), parsers.symbols)
    stored = after["file_content"].select(F.col("file_id").alias("id"), F.col("content_hash"))
    return after["files"].join(stored, "id", "left").select("id", "path", "mtime", "content_hash")


def _reindexed(s, d):
    tables = _tables(s, d)
    tables["files"] = tables["files"].where("module <> 'Tidegate'")
    after = U.rebuild_project(tables, "Tidegate-Cpp", _scanned(s, d, "project = 'Tidegate-Cpp'"), parsers.symbols)
    return U.orphan_counts(after).select("name", "n_orphans").union(after["files"].agg(F.lit("files"), F.count("*")))


def _migrated(s, d):
    old = _t(s, d, "files")[0].drop("path_lower", "basename_lower").withColumn("mtime", F.col("mtime").cast("string"))
    files, _ = U.migrate("files", old)
    return files


def _ingested_rows(s, d):
    """Every type of the files that no parser touched, and the stored texts, after the batch of ``t2_ingest``."""
    after, project = _after_ingest(s, d)
    texts = after["file_content"].select(F.lit("text").alias("entity"), "file_id", F.col("content_hash").alias("value"))
    kept = after["files"].where(F.col("project") != project).select(F.col("id").alias("file_id"))
    types = after["types"].join(kept, "file_id", "left_semi").select(F.lit("type").alias("entity"), "file_id", F.col("id").alias("value"))
    members = after["members"].join(kept, "file_id", "left_semi").select(F.lit("member").alias("entity"), "file_id", F.col("id").alias("value"))
    return texts.unionByName(types).unionByName(members)


def _changes(s, d):
    tables = _tables(s, d)
    after = tables | {"files": tables["files"].where("project <> 'Tidegate'"), "assets": tables["assets"].withColumn("id", F.when(F.col("id") % 2 == 0, -F.col("id")).otherwise(F.col("id")))}
    return U.changes_between(tables, after, "2026-01-01 00:00:00")


def _ready(s, d):
    rows = _t(s, d, "events")[0].select(F.col("event_type").alias("key"), (F.col("value") > 50).cast("string").alias("value"), F.struct("ts", "event_id").alias("at"))
    return U.readiness(rows, ["click", "view", "nameTrigram"])


def _upserted_texts(s, d):
    texts = _t(s, d, "file_content")[0]
    new = texts.where("file_id % 3 = 0").select("file_id", F.when(F.col("file_id") % 2 == 0, F.upper("content")).alias("content"))
    return I.upsert_content(texts, new).select("file_id", "content_hash", F.length("content").alias("n"))


def _postings_kept(s, d):
    """Postings after the types of one kind went and came again under other ids."""
    types, members = _t(s, d, "types", "members")
    posted = trigrams.postings(types, members)
    gone = types.where("kind = 'enum'").select(F.lit("type").alias("entity_type"), F.col("id").alias("entity_id"))
    new = types.where("kind = 'enum'").withColumn("id", -F.col("id"))
    return trigrams.updated(posted, gone, new, members.limit(0)).groupBy("entity_type", "trigram").agg(F.count("*").alias("n"), F.sum("entity_id").alias("ids"))


def _batches(s, d):
    return U.full_scan(_t(s, d, "files")[0].where("language = 'cpp'").select("path")).select("path", "batch")


def _status(s, d):
    rows = _t(s, d, "events")[0].select(F.col("event_type").alias("language"), F.when(F.col("value") > 50, "ready").otherwise("indexing").alias("status"), F.struct("ts", "event_id").alias("at"))
    return I.index_status(rows, ["click", "view", "config", "content"])


QUERIES = {
    "j4_mtimes": lambda s, d: I.mtimes(*_t(s, d, "files", "file_content")),
    "j6_without_content": lambda s, d: I.without_content(*_t(s, d, "files", "file_content")),
    "j11_difference": _diff,
    "s7_mtimes_of_paths": _mtimes_of,
    "s2_symbols": _symbols,
    "k1_upsert_files": _upsert,
    "k5_owners": _owners,
    "k7_cascade": _cascade,
    "k8_upsert_assets": _upsert_assets,
    "k12_key_values": lambda s, d: I.key_values(_t(s, d, "events")[0].select(F.col("event_type").alias("key"), F.col("props").alias("value"), F.struct("ts", "event_id").alias("at"))),
    "k13_index_status": _status,
    "k10_without_project": lambda s, d: U.without_assets(_t(s, d, "assets")[0], project="Tidegate-Content").select("id"),
    "k10_without_paths": lambda s, d: U.without_assets(_t(s, d, "assets")[0], paths=_t(s, d, "assets")[0].where("asset_class = 'Material'")).select("id"),
    "k10_without_language": lambda s, d: _symbols_of(U.without_language(_tables(s, d), "angelscript")),
    "k3_postings_kept": _postings_kept,
    "k11_upserted_texts": _upserted_texts,
    "k15_argument_summary": _args,
    "n3_rebuild_language": _rebuilt,
    "n5_rebuild_project": _reindexed,
    "n5_orphan_counts": lambda s, d: U.orphan_counts(_tables(s, d) | {"files": table(s, d, "files").where("language = 'cpp'")}),
    "x2_migrated_files": _migrated,
    "x3_readiness": _ready,
    "t1_last_events": lambda s, d: C.last_events(_t(s, d, "file_changes")[0]),
    "t2_ingest": _ingest,
    "t2_ingested_rows": _ingested_rows,
    "t5_empty_languages": lambda s, d: U.empty_languages(*_t(s, d, "files", "assets"), ["cpp", "angelscript", "python", "content"]),
    "t5_full_scan": _batches,
    "t8_refreshed_depths": lambda s, d: U.refreshed_depths(_t(s, d, "types")[0]).select("id", "name", "depth"),
    "t9_ingest_counters": _changes,
    "t2_stream_state": _stream_state,
    "stream_running_counts": lambda s, d: C.running_counts(_feed(s, d).withColumn("op", F.lower("op")), "op"),
    "t7_affected_projects": lambda s, d: I.affected_projects(_t(s, d, "file_changes")[0]),
    "stream_event_windows": lambda s, d: C.windowed_counts(C.read_stream(s, f"{d}/events.parquet"), "ts", "event_type"),
    "event_sessions": lambda s, d: C.sessions(_t(s, d, "events")[0], "ts", "user_id"),
}

_FEED = "(select replace(lower(path), chr(92), '/') as path_lower, * from file_changes where path is not null)"
ORACLE = {
    "j4_mtimes": "select path, case when language in ('angelscript', 'cpp', 'config') and not exists (select 1 from file_content c where c.file_id = f.id and content is not null) then null else mtime end as mtime from files f",
    "j6_without_content": "select id, path from files f where not exists (select 1 from file_content c where c.file_id = f.id and content is not null)",
    "j11_difference": f"""
        with disk as (
            with state as ({CORE['p4_state'].replace('from files where path is not null group by 1', "from files where false group by 1")})
            select path_lower as path, mtime from state where present and session_no is not null),
        joined as (select coalesce(k.path, f.path_lower) as path, k.mtime as now, f.mtime as was, k.path as on_disk, f.path_lower as stored from disk k full join files f on f.path_lower = k.path)
        select path, case when stored is null then 'new' when on_disk is null then 'deleted' else 'changed' end as status
        from joined where stored is null or on_disk is null or now is distinct from was""",
    "s7_mtimes_of_paths": "select path, mtime from files where path in (select path from file_changes)",
    "k1_upsert_files": """
        with fresh as (
            select path, arg_max_null(mtime, (session_no, event_seq)) as mtime, arg_max_null(project, (session_no, event_seq)) as project from (
                select distinct path, session_no, event_seq, first_value(mtime) over w as mtime, first_value(project) over w as project from file_changes
                where lower(op) <> 'unlink' and project is not null and not contains(path, chr(92))
                window w as (partition by path, session_no, event_seq order by mtime desc nulls last, project desc)) group by path),
        every as (
            select f.id, f.path, coalesce(n.project, f.project) as project, case when n.path is not null then n.mtime else f.mtime end as mtime, f.relative_path from files f left join fresh n on n.path = f.path
            union all
            select (select max(id) from files) + row_number() over (order by path), path, project, mtime, null from fresh where path not in (select path from files))
        select *, replace(lower(path), chr(92), '/') as path_lower, lower(regexp_replace(string_split(replace(path, chr(92), '/'), '/')[-1], '^(.+)\\.[^.]*$', '\\1')) as basename_lower from every""",
    "k5_owners": "select distinct m.id, (select max(x.id) from types x where x.file_id = t.file_id and x.name = t.name) as type_id from members m join types t on t.id = m.type_id",
    "k7_cascade": """
        with gone as (select id from files where project = 'Tidegate')
        select 'files' as name, count(*) as n from files where id not in (select id from gone)
        union all select 'types', count(*) from types where file_id not in (select id from gone)
        union all select 'members', count(distinct id) from members where file_id not in (select id from gone)
        union all select 'file_content', count(*) from file_content where file_id not in (select id from gone)""",
    "k8_upsert_assets": """
        select id, path, name, case when asset_class = 'Material' then mtime + 1 else mtime end as mtime, asset_class from assets
        union all select (select max(id) from assets) + row_number() over (order by path), path || '.copy', name, mtime, asset_class from assets where asset_class = 'SoundWave'""",
    "k12_key_values": "select event_type as key, replace(max_by(props, (ts, event_id)), ' ', '') as value from events group by event_type",
    "k13_index_status": """
        select x.language, coalesce(max_by(case when value > 50 then 'ready' when value is not null then 'indexing' end, (ts, event_id)), 'pending') as status
        from (values ('click'), ('view'), ('config'), ('content')) as x(language) left join events e on e.event_type = x.language group by x.language""",
    "k10_without_project": "select id from assets where project is distinct from 'Tidegate-Content'",
    "k10_without_paths": "select id from assets a where not exists (select 1 from assets b where b.path = a.path and asset_class = 'Material')",
    "k10_without_language": """
        select path, 'type' as entity, t.name, kind, line from types t join files f on f.id = t.file_id where language <> 'angelscript'
        union all select path, 'member', m.name, member_kind, line from (select distinct * from members) m join files f on f.id = m.file_id where language <> 'angelscript'""",
    "k15_argument_summary": "select doc_id, case when length(text) > 50 then substr(text, 1, 50) || '...' else text end as query, cast(n_chars as varchar) as limit from documents",
    "k3_postings_kept": f"""
        with named as (
            select 'type' as entity_type, case when kind = 'enum' then -id else id end as id, name from types union all select 'member', id, name from (select distinct * from members)),
        posted as (select distinct entity_type, id, unnest({trigram_sql('name')}) as trigram from named)
        select entity_type, trigram, count(*) as n, sum(id) as ids from posted group by all""",
    "k11_upserted_texts": """
        select file_id, content_hash, length(content) as n from file_content where file_id % 3 <> 0
        union all
        select file_id, cast(case when h >= 9223372036854775808 then h - 18446744073709551616 else h end as bigint), n from (
            select file_id, n, cast(cast('0x' || array_to_string(list_transform([8, 7, 6, 5, 4, 3, 2, 1], lambda i: substr(digest, 2 * i - 1, 2)), '') as ubigint) as hugeint) as h
            from (select file_id, md5(upper(content)) as digest, length(upper(content)) as n from file_content where file_id % 6 = 0 and content is not null))""",
    "n3_rebuild_language": """
        select f.id, f.path, f.mtime, c.content_hash from files f left join file_content c on c.file_id = f.id and content is not null
        where not (language = 'angelscript' and project = 'Tidegate')""",
    "n5_rebuild_project": """
        select name, 0 as n_orphans from (values ('types'), ('members'), ('file_content')) as x(name)
        union all select 'files', count(*) from files where module <> 'Tidegate' or project = 'Tidegate-Cpp'""",
    "n5_orphan_counts": """
        with cpp as (select id from files where language = 'cpp'),
        rows as (select 'types' as name, file_id from types union all select 'members', file_id from (select distinct * from members) union all select 'file_content', file_id from file_content)
        select name, count(*) as n_rows, count(*) filter (where file_id is null or file_id not in (select id from cpp)) as n_orphans from rows group by name""",
    "x2_migrated_files": "select * from files",
    "x3_readiness": """
        select x.flag, coalesce(max_by(value > 50, (ts, event_id)), false) as ready from (values ('click'), ('view'), ('nameTrigram')) as x(flag)
        left join events e on e.event_type = x.flag and value is not null group by x.flag""",
    "t1_last_events": f"select path_lower, max_by(lower(op), (received_at, delivery_id)) as op from {_FEED} group by 1",
    "t2_ingest": """
        select 'files' as name, count(*) as n, count(distinct id) as n_ids from files where project <> 'Tidegate-Cpp'
        union all select 'file_content', count(*), count(distinct file_id) from file_content where file_id not in (select id from files where project = 'Tidegate-Cpp')""",
    "t2_ingested_rows": """
        with gone as (select id from files where project = 'Tidegate-Cpp'), kept as (select id from files where project not in ('Tidegate-Cpp', 'Tidegate'))
        select 'text' as entity, file_id, content_hash as value from file_content where file_id not in (select id from gone)
        union all select 'type', file_id, id from types where file_id in (select id from kept)
        union all select 'member', file_id, id from (select distinct * from members) where file_id in (select id from kept)""",
    "t2_stream_state": CORE["p4_found"],
    "t5_empty_languages": """
        select language from (values ('cpp'), ('angelscript'), ('python'), ('content')) as x(language)
        where language not in (select language from files) and not (language = 'content' and exists (select 1 from assets))""",
    "t5_full_scan": "select path, (row_number() over (order by path) - 1) // 50 as batch from files where language = 'cpp'",
    "t8_refreshed_depths": """
        with recursive links as (
            select distinct name as child, parent from types where name is not null and parent <> '' and parent in (select name from types)),
        walk as (
            select distinct name, 0 as depth, [name] as path from types where name is not null and name not in (select child from links)
            union all
            select l.child, w.depth + 1, list_append(w.path, l.child) from walk w join links l on l.parent = w.name where not list_contains(w.path, l.child)),
        best as (select name, min(depth) as depth from walk group by name)
        select t.id, t.name, cast(b.depth as integer) as depth from types t left join best b on b.name = t.name""",
    "t9_ingest_counters": """
        with counts as (
            select 'files' as name, count(*) as n_before, count(*) filter (where project <> 'Tidegate') as n_after, 0 as n_added, count(*) filter (where project = 'Tidegate') as n_removed from files
            union all select 'types', count(*), count(*), 0, 0 from types union all select 'members', count(distinct id), count(distinct id), 0, 0 from members
            union all select 'file_content', count(*), count(*), 0, 0 from file_content
            union all select 'assets', count(*), count(*), count(*) filter (where id % 2 = 0 and id <> 0), count(*) filter (where id % 2 = 0 and id <> 0) from assets)
        select *, timestamp '2026-01-01 00:00:00' as last_ingest from counts""",
    "stream_running_counts": "select lower(op) as op, count(*) as n from file_changes group by 1",
    "t7_affected_projects": "select project, count(*) as pending, least(30000, 2000 + 200 * count(*)) as delay_ms from file_changes group by project",
    "stream_event_windows": "select date_trunc('day', ts) as start, event_type, count(*) as n from events group by 1, 2",
    "event_sessions": """
        with steps as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end as opens from events),
        runs as (select *, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as run from steps)
        select user_id, min(ts) as start, max(ts) + interval 30 minutes as "end", count(*) as n from runs group by user_id, run""",
}
