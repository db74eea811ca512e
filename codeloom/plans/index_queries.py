"""Queries over the index's figures, logs and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import names as N
from codeloom.functions import scoring, text, trigrams
from codeloom.operators import content as G
from codeloom.operators import logs as L
from codeloom.operators import statistics as A
from codeloom.operators.symbols import first_types
from codeloom.plans import expected as E
from codeloom.plans.search_queries import STRUCTURE, _quoted, _t, camel_sql, trigram_sql

NOW_MS = 1_780_000_000_000
NOW = "2024-01-30 12:00:00"


def _names(s, d):
    c = F.col
    return _t(s, d, "files")[0].select(
        "id", N.path_lower(c("path")).alias("path_lower"), N.basename_lower(c("path")).alias("basename_lower"), N.derive_module(c("relative_path"), c("project")).alias("module"),
        N.language_of(c("path")).alias("language"), scoring.recency(c("mtime"), NOW_MS).alias("recency"),
    )


def _type_names(s, d):
    c = F.col("name")
    return _t(s, d, "types")[0].select("id", N.strip_loose(c).alias("loose"), N.strip_strict(c).alias("strict"), N.split_camel(c).alias("words"), F.array_sort(trigrams.trigrams(c)).alias("grams"), N.accessor_core(F.lower(c)).alias("core"), scoring.kind_weight(F.col("kind")).alias("weight"))


def _structure(s, d):
    types, files = _t(s, d, "types", "files")
    joined = types.select("id", "file_id", "parent").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return joined.select("id", scoring.structural_score(F.col("parent"), F.col("path")).alias("structure"))


def _levenshtein(s, d):
    return _t(s, d, "types")[0].select("id", F.levenshtein(F.lower("name"), F.lit("ucoreobject")).alias("distance"))


def _hits(s, d, pattern="Anchor", **kw):
    content, files = _t(s, d, "file_content", "files")
    return G.grep(content, files, pattern, **kw)


def _grep_rank(s, d):
    types, members = _t(s, d, "types", "members")
    hits = _hits(s, d, "SyncToken")
    ranked = G.rank(hits, NOW_MS, G.symbols_near(hits, types, members))
    return G.best_hits(ranked, 50).select("rank", "path", "line", "column", "match", "symbol", "score", "total", "truncated")


def _multi(s, d):
    hits = _hits(s, d, "(?i)tide|clock", context=3)
    return G.all_words(hits, ["tide", "clock"]).select("path", "line", "match", "near")


def _context(s, d):
    types, content = _t(s, d, "types", "file_content")
    return G.context_of(types.select("id", "file_id", "line"), content, 2).select("id", "signature", "context")


QUERIES = {
    "a1_index_stats": lambda s, d: A.index_stats(*_t(s, d, "files", "types", "members")),
    "a1_project_stats": lambda s, d: A.project_stats(*_t(s, d, "files", "types")),
    "a2_asset_stats": lambda s, d: A.asset_stats(*_t(s, d, "assets")),
    "a5_type_names": lambda s, d: _t(s, d, "types")[0].select("name").distinct(),
    "a6_by_method": lambda s, d: L.by_method(L.query_log(*_t(s, d, "events"))),
    "a6_slowest": lambda s, d: L.slowest(L.query_log(*_t(s, d, "events"))),
    "a6_without_result": lambda s, d: L.without_result(L.query_log(*_t(s, d, "events"))),
    "a7_by_tool": lambda s, d: L.by_tool(L.tool_log(*_t(s, d, "events"))),
    "a7_by_session": lambda s, d: L.by_session(L.tool_log(*_t(s, d, "events"))),
    "a8_query_listing": lambda s, d: L.listing(L.query_log(*_t(s, d, "events")), 50, 100.0, "2024-01-10 00:00:00", method="error").select("rank", "id", "method", "duration_ms"),
    "a9_weighted_mean": lambda s, d: L.overall(L.query_log(*_t(s, d, "events"))),
    "a10_trigram_candidates": lambda s, d: trigrams.candidates(trigrams.postings(*_t(s, d, "types", "members")), "NightKayak", "type"),
    "a11_language_status": lambda s, d: A.language_status(*_t(s, d, "files", "assets")),
    "a12_freshness": lambda s, d: A.freshness(*_t(s, d, "files")),
    "a13_project_folders": lambda s, d: A.project_folders(*_t(s, d, "files")),
    "a15_hits_by_file": lambda s, d: G.by_file(_hits(s, d, "DrainSocket")),
    "a17_asset_hits": lambda s, d: G.search_assets(*_t(s, d, "assets"), "Crane"),
    "a18_latencies": lambda s, d: L.latencies(L.query_log(*_t(s, d, "events"))),
    "a19_module_contents": lambda s, d: A.module_contents(*_t(s, d, "files", "types")),
    "a20_kinds_by_project": lambda s, d: A.kinds_by_project(*_t(s, d, "files", "types")),
    "a21_posting_stats": lambda s, d: A.posting_stats(*_t(s, d, "types", "members")),
    "o1_projects": lambda s, d: A.projects(*_t(s, d, "files", "assets")),
    "x15_declaring_files": lambda s, d: A.declaring_files(*_t(s, d, "types", "files")),
    "x15_top_modules": lambda s, d: A.top_modules(*_t(s, d, "files")),
    "n1_postings": lambda s, d: trigrams.postings(*_t(s, d, "types", "members")),
    "n4_content_drift": lambda s, d: A.content_drift(*_t(s, d, "files", "file_content")),
    "w1_sample_paths": lambda s, d: A.sample_paths(*_t(s, d, "files")),
    "w2_types_per_file": lambda s, d: first_types(*_t(s, d, "types")),
    "t6_heartbeats": lambda s, d: L.heartbeats(L.tool_log(*_t(s, d, "events")), NOW, 6 * 3600, 12 * 3600),
    "k16_retained": lambda s, d: L.retained(L.query_log(*_t(s, d, "events")), NOW).select("id", "timestamp", "method"),
    "c1_path_functions": _names,
    "c4_name_functions": _type_names,
    "c9_content_hash": lambda s, d: _t(s, d, "file_content")[0].select("file_id", text.content_hash(F.col("content")).alias("content_hash")),
    "c11_specifier_boost": lambda s, d: _t(s, d, "members")[0].select("id", F.round(scoring.specifier_boost(F.col("specifiers")), 6).alias("boost")).distinct(),
    "c13_structural_score": _structure,
    "c15_definition_lines": lambda s, d: text.lines(_t(s, d, "file_content")[0]).where(scoring.is_definition(F.col("text"))).groupBy("file_id").agg(F.count("*").alias("n_definitions"), F.min("line").alias("first_line")),
    "c18_levenshtein": _levenshtein,
    "c24_shortened_lines": lambda s, d: text.lines(_t(s, d, "file_content")[0]).where(F.length("text") > 200).select("file_id", "line", text.shorten(F.col("text")).alias("text")),
    "c24_display_lines": lambda s, d: text.lines(_t(s, d, "file_content")[0]).groupBy(text.shorten(F.col("text"), 20).alias("text")).agg(F.count("*").alias("n")),
    "c32_mirror_paths": lambda s, d: _t(s, d, "assets")[0].select("id", N.asset_mirror_path(F.col("content_path")).alias("mirror"), N.mirror_content_path(N.asset_mirror_path(F.col("content_path"))).alias("back")),
    "g1_grep": lambda s, d: _hits(s, d, r"Sync(Token|Anchor)\(", context=1).select("path", "project", "language", "line", "column", "match", "context"),
    "g1_grep_literal": lambda s, d: _hits(s, d, "socket", regex=False, case_sensitive=False, language="cpp").select("path", "line", "column", "match"),
    "g2_grep_ranked": _grep_rank,
    "g2_grep_words": _multi,
    "g4_asset_search": lambda s, d: G.search_assets(*_t(s, d, "assets"), "(?i)blueprint.*class"),
    "g7_trigram_files": lambda s, d: G.trigram_files(*_t(s, d, "file_content"), "DrainSocket"),
    "j7_symbols_near": lambda s, d: G.symbols_near(_hits(s, d, "Anchor"), *_t(s, d, "types", "members")),
    "f17_context": _context,
    "k9_asset_texts": lambda s, d: G.asset_texts(*_t(s, d, "assets")),
    "k20_files_with_matches": lambda s, d: G.shape(_hits(s, d, "Anchor"), "files"),
    "g5_symbol_search": lambda s, d: G.search_symbols(*_t(s, d, "types", "members", "files"), "applyanchor", case_sensitive=False, project="Engine", limit=40),
    "k20_counts": lambda s, d: G.shape(_hits(s, d, "Anchor"), "count"),
}

_LOG = "(select event_id as id, ts as timestamp, event_type as method, props as args, value as duration_ms, cast(json_extract_string(props, '$.k') as integer) % 5 as result_count from events)"
_TOOL = "(select event_id as id, ts as timestamp, event_type as tool_name, value as duration_ms, length(props) as result_size, cast(user_id as varchar) as session_id from events)"
_M = "(select distinct * from members)"
_LINES = "(select file_id, unnest(string_split(content, chr(10))) as text, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line from file_content where content is not null)"
_POSTINGS = f"(select distinct 'type' as entity_type, id as entity_id, unnest({trigram_sql('name')}) as trigram from types union all select distinct 'member', id, unnest({trigram_sql('name')}) from {_M})"


def grep_sql(pattern: str, context: int = 0, extra: str = "", flags: str = "c") -> str:
    """``hits``: file_id, path, project, language, mtime, line, "column", match, context."""
    cut = f"list_slice(all_lines, greatest(l.line - {context}, 1), l.line + {context})" if context else "[]::varchar[]"
    return f"""
    hits as (
        select l.file_id, f.path, f.project, f.language, f.mtime, cast(l.line as integer) as line, l.text as match, {cut} as context,
               cast(length(regexp_extract(l.text, '^(.*?)(?:{pattern})', 1, '{flags}')) + 1 as integer) as column
        from {_LINES} l join files f on f.id = l.file_id join (select file_id, string_split(content, chr(10)) as all_lines from file_content) a on a.file_id = l.file_id
        where regexp_matches(l.text, '{pattern}', '{flags}') {extra})"""


_DEFINES = f"not regexp_matches(text, '^\\s*(//|/\\*|\\*)') and regexp_matches(text, '{E.DEFINES}')"
_NEAR = f"""
    symbols as (
        select file_id, line as at, name as symbol, kind as symbol_kind, 'type' as entity, 0 as rank, id from types
        union all select file_id, line, name, member_kind, 'member', 1, id from {_M}),
    near as (
        select h.file_id, h.line, symbol, symbol_kind, entity, row_number() over (partition by h.file_id, h.line order by s.rank desc, s.id desc) as best
        from (select distinct file_id, line from hits) h join symbols s on s.file_id = h.file_id and abs(h.line - s.at) <= 3)"""
_RECENCY = f"case when mtime is null or mtime = 0 then 0 when ({NOW_MS} - mtime) / 86400000.0 < 1 then 10 when ({NOW_MS} - mtime) / 86400000.0 < 7 then 8 when ({NOW_MS} - mtime) / 86400000.0 < 30 then 5 when ({NOW_MS} - mtime) / 86400000.0 < 90 then 3 else 1 end"


def _asset_hits_sql(pattern: str, flags: str = "c") -> str:
    return f"""
    with lines as (
        select id, path, unnest([name, content_path, coalesce(asset_class, ''), coalesce(parent_class, '')]) as text, unnest([1, 2, 3, 4]) as pos from assets),
    first as (select id, path, text, min(pos) as pos from lines where text <> '' and regexp_matches(text, '{pattern}', '{flags}') group by 1, 2, 3)
    select path, count(*) as matched_fields, string_agg(text, ' | ' order by pos) as match from first group by id, path"""


ORACLE = {
    "a1_index_stats": f"""
        select 'files' as measure, null as a, null as b, count(*) as n from files union all select 'types', null, null, count(*) from types
        union all select 'members', null, null, count(*) from {_M}
        union all select 'types by kind', kind, null, count(*) from types group by kind
        union all select 'members by kind', member_kind, null, count(*) from {_M} group by member_kind
        union all select 'files by project', project, language, count(*) from files group by project, language
        union all select 'types by project', f.project, f.language, count(*) from types t join files f on f.id = t.file_id group by f.project, f.language""",
    "a1_project_stats": """
        select project, min(language) as language, count(*) as n_files,
               (select count(*) from types t join files x on x.id = t.file_id where x.project = f.project) as n_types from files f group by project""",
    "a2_asset_stats": """
        select 'assets' as measure, null as a, count(*) as n from assets union all select 'with parent', null, count(parent_class) from assets
        union all select 'by project', project, count(*) from assets group by project union all select 'by extension', extension, count(*) from assets group by extension
        union all select 'by class', coalesce(asset_class, 'Unknown'), count(*) from assets group by coalesce(asset_class, 'Unknown')""",
    "a5_type_names": "select distinct name from types",
    "a6_by_method": f"select method, count(*) as n, round(avg(duration_ms), 6) as mean_ms, max(duration_ms) as max_ms from {_LOG} group by method",
    "a6_slowest": f"select cast(row_number() over (order by duration_ms desc, id) as integer) as rank, id, method, args, duration_ms, result_count from {_LOG} order by rank limit 10",
    "a6_without_result": f"select cast(row_number() over (order by count(*) desc, method, args) as integer) as rank, method, args, count(*) as n, max(timestamp) as last from {_LOG} where result_count = 0 group by method, args order by rank limit 20",
    "a7_by_tool": f"select tool_name, count(*) as n, round(avg(duration_ms), 6) as mean_ms, max(duration_ms) as max_ms, min(timestamp) as first, max(timestamp) as last from {_TOOL} group by tool_name",
    "a7_by_session": f"select cast(row_number() over (order by max(timestamp) desc, session_id) as integer) as rank, session_id, count(*) as n, min(timestamp) as first_call, max(timestamp) as last_call from {_TOOL} group by session_id order by rank limit 20",
    "a8_query_listing": f"select cast(row_number() over (order by timestamp desc, id desc) as integer) as rank, id, method, duration_ms from {_LOG} where duration_ms >= 100 and timestamp >= timestamp '2024-01-10 00:00:00' and method = 'error' order by rank limit 50",
    "a9_weighted_mean": f"select round(avg(duration_ms), 4) as mean_ms, max(duration_ms) as max_ms from {_LOG}",
    "a10_trigram_candidates": f"select entity_id, count(distinct trigram) as matched from {_POSTINGS} where entity_type = 'type' and trigram in ({_quoted(E.pieces('NightKayak'))}) group by entity_id having count(distinct trigram) >= {E.least_shared('NightKayak')}",
    "a11_language_status": "select language, count(*) as n, false as is_empty from files where language not in ('content', 'asset') group by language union all select 'content', count(*), count(*) = 0 from assets",
    "a12_freshness": "select project, max(mtime) as newest from files group by project",
    "a13_project_folders": """
        with ends as (select project, string_split(min(path), '/')[:-2] as a, string_split(max(path), '/')[:-2] as b from files group by project),
        same as (select project, a, b, (select coalesce(min(i), least(len(a), len(b)) + 1) from range(1, least(len(a), len(b)) + 1) t(i) where a[i] <> b[i]) as cut from ends)
        select project, array_to_string(list_slice(a, 1, cut - 1), '/') || case when cut > 1 then '/' else '' end as folder from same""",
    "a15_hits_by_file": f"with {grep_sql('DrainSocket')} select path, project, count(*) as n, list({{'line': line, 'match': match}} order by line) as matches from hits group by path, project",
    "a17_asset_hits": _asset_hits_sql("Crane"),
    "a18_latencies": f"""
        with n as (select method, duration_ms, row_number() over (partition by method order by duration_ms) - 1 as pos, count(*) over (partition by method) as total from {_LOG})
        select method, min(duration_ms) as min_ms, max(duration_ms) as max_ms, round(avg(duration_ms), 6) as mean_ms,
            max(case when pos = floor(total * 0.5) then duration_ms end) as p50_ms, max(case when pos = floor(total * 0.95) then duration_ms end) as p95_ms, max(case when pos = floor(total * 0.99) then duration_ms end) as p99_ms
        from n group by method""",
    "a19_module_contents": "select f.module, count(distinct f.id) as n_files, count(t.id) as n_types, count(distinct t.name) as n_names from files f left join types t on t.file_id = f.id group by f.module",
    "a20_kinds_by_project": "select f.project, " + ", ".join(f"sum(case when kind = '{k}' then 1 else 0 end)::bigint as n_{k}" for k in ("class", "struct", "enum", "interface", "delegate", "event")) + " from types t join files f on f.id = t.file_id group by f.project",
    "a21_posting_stats": f"select entity_type, count(*) as n_rows, count(distinct trigram) as n_trigrams from {_POSTINGS} group by entity_type",
    "o1_projects": "select project from files where project is not null union select project from assets where project is not null",
    "x15_declaring_files": "select distinct name, path from types t join files f on f.id = t.file_id",
    "x15_top_modules": "select distinct string_split(module, '.')[1] as top from files",
    "n1_postings": f"select trigram, entity_type, entity_id from {_POSTINGS}",
    "n4_content_drift": """
        select (select count(*) from files) as n_files, (select count(*) from file_content where content is not null and file_id in (select id from files)) as n_content,
               abs((select count(*) from files) - (select count(*) from file_content where content is not null and file_id in (select id from files))) > 0.05 * (select count(*) from files) as rebuild""",
    "w1_sample_paths": "select project, cast(rank as integer) as rank, path from (select *, row_number() over (partition by project order by id) as rank from files) where rank <= 5",
    "w2_types_per_file": "select file_id, list({'name': name, 'kind': kind, 'line': line} order by id) as types from (select *, row_number() over (partition by file_id order by id) as n from types) where n <= 10 group by file_id",
    "t6_heartbeats": f"""
        select session_id, last_seen, age_s, case when age_s > 21600 then 'stale' else 'live' end as state from (
            select session_id, last_seen, cast(epoch(timestamp '{NOW}') - floor(epoch(last_seen)) as bigint) as age_s from (
                select session_id, max(timestamp) as last_seen from {_TOOL} where timestamp <= timestamp '{NOW}' group by session_id)) where age_s <= 43200""",
    "k16_retained": f"select id, timestamp, method from {_LOG} where timestamp >= timestamp '{NOW}' - interval 7 days",
    "c1_path_functions": f"""
        select id, replace(lower(path), chr(92), '/') as path_lower, lower(regexp_replace(string_split(replace(path, chr(92), '/'), '/')[-1], '^(.+)\\.[^.]*$', '\\1')) as basename_lower,
               concat_ws('.', project, nullif(array_to_string(list_slice(string_split(replace(relative_path, chr(92), '/'), '/'), 1, -2), '.'), '')) as module,
               case when lower(path) like '%.as' then 'angelscript' when regexp_matches(lower(path), '\\.(h|hpp|hxx|c|cc|cpp|cxx|inl)$') then 'cpp'
                    when regexp_matches(lower(path), '\\.(ini|cfg|conf)$') then 'config' when regexp_matches(lower(path), '\\.(uasset|umap)$') then 'content' end as language,
               {_RECENCY} as recency from files""",
    "c4_name_functions": f"""
        select id, regexp_replace(name, '^[UAFESI]', '') as loose, regexp_replace(name, '^[UAFESI]([A-Z])', '\\1') as strict, {camel_sql('name')} as words,
               list_sort({trigram_sql('name')}) as grams, regexp_replace(lower(name), '^(get|set|is|has|can|should)', '') as core,
               case kind when 'class' then 0.04::double when 'struct' then 0.03::double when 'interface' then 0.03::double when 'enum' then 0.02::double when 'delegate' then 0.01::double when 'event' then 0.01::double else 0::double end as weight from types""",
    "c9_content_hash": "select file_id, content_hash from file_content",
    "c11_specifier_boost": "select distinct id, round(least(0.08::double, coalesce(" + E.SPECIFIER_SQL + ", 0)), 6) as boost from members",
    "c13_structural_score": f"select t.id, {STRUCTURE} as structure from (select t.id, t.parent, f.path from types t join files f on f.id = t.file_id) t",
    "c15_definition_lines": f"select file_id, count(*) as n_definitions, cast(min(line) as integer) as first_line from {_LINES} where {_DEFINES} group by file_id",
    "c18_levenshtein": "select id, cast(levenshtein(lower(name), 'ucoreobject') as integer) as distance from types",
    "c24_shortened_lines": f"select file_id, cast(line as integer) as line, case when length(x) > 200 then substr(x, 1, 200) || '...' else x end as text from (select *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as x from {_LINES}) where length(text) > 200",
    "c24_display_lines": f"select case when length(x) > 20 then substr(x, 1, 20) || '...' else x end as text, count(*) as n from (select regexp_replace(text, '^\\s+|\\s+$', '', 'g') as x from {_LINES}) group by 1",
    "c32_mirror_paths": "select id, regexp_replace(content_path, '^/Game/', '_assets/') || '.uasset' as mirror, content_path as back from assets",
    "g1_grep": f"with {grep_sql('Sync(?:Token|Anchor)[(]', 1)} select path, project, language, line, \"column\", match, context from hits",
    "g1_grep_literal": f"with {grep_sql('socket', 0, 'and f.language = chr(99) || chr(112) || chr(112)', 'i')} select path, line, \"column\", match from hits",
    "g2_grep_ranked": f"""
        with {grep_sql('SyncToken')}, {_NEAR},
        scored as (
            select h.*, n.symbol, count(*) over (partition by h.file_id) + case when path like '%.h' or path like '%.hpp' then 5 else 0 end + case when path like '%/Public/%' then 3 else 0 end
                + {_RECENCY} + case when {_DEFINES.replace('text', 'match')} then 8 else 0 end + case when n.symbol is not null then 6 else 0 end as score
            from hits h left join near n on n.file_id = h.file_id and n.line = h.line and n.best = 1)
        select cast(row_number() over (order by score desc, line, file_id) as integer) as rank, path, line, "column", match, symbol, score, count(*) over () as total, count(*) over () > 50 as truncated
        from scored order by rank limit 50""",
    "g2_grep_words": f"""
        with {grep_sql('tide|clock', 3, '', 'i')},
        flagged as (select *, contains(lower(match), 'tide') and contains(lower(match), 'clock') as inside, lower(array_to_string(context, chr(10))) as wide from hits)
        select path, line, match, not inside as near from flagged where inside or (contains(wide, 'tide') and contains(wide, 'clock'))""",
    "g4_asset_search": _asset_hits_sql("blueprint.*class", "i"),
    "g7_trigram_files": "select file_id from file_content where " + " and ".join(f"contains(lower(content), '{g}')" for g in E.pieces("DrainSocket")),
    "j7_symbols_near": f"with {grep_sql('Anchor')}, {_NEAR} select file_id, line, symbol, symbol_kind, entity from near where best = 1",
    "f17_context": """
        select t.id, case when line between 1 and len(ls) then trim(ls[line], ' ') end as signature, case when line between 1 and len(ls) then list_slice(ls, greatest(line - 2, 1), line + 2) end as context
        from types t left join (select file_id, string_split(content, chr(10)) as ls from file_content) c on c.file_id = t.file_id""",
    "k9_asset_texts": "select id, path, project, concat_ws(chr(10), name, content_path, coalesce(asset_class, ''), coalesce(parent_class, '')) as content from assets",
    "k20_files_with_matches": f"with {grep_sql('Anchor')} select distinct path from hits",
    "k20_counts": f"with {grep_sql('Anchor')} select path, count(*) as n from hits group by path",
    "g5_symbol_search": f"""
        with named as (
            select id, file_id, line, name as symbol, kind as symbol_kind, 0 as is_member from types where lower(name) = 'applyanchor'
            union all select id, file_id, line, name, member_kind, 1 from {_M} where lower(name) = 'applyanchor'),
        found as (select n.*, f.path, f.project from named n join files f on f.id = n.file_id where f.project = 'Engine'),
        ranked as (select *, row_number() over (order by is_member, path, line, id) as rank, count(*) over () as total from found)
        select cast(rank as integer) as rank, path, project, line, symbol, symbol_kind, total from ranked where rank <= 40""",
}
