"""Queries over single predicates, sources and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import names as N
from codeloom.functions import scoring, text, trigrams
from codeloom.operators import statistics as A
from codeloom.operators import symbols as S
from codeloom.operators.content import context_of
from codeloom.plans import expected as E
from codeloom.plans.search_queries import _quoted, _t, camel_sql, share_sql, trigram_sql
from codeloom.sources import scan

QUERY, GRAMS = "NightKayak", trigrams.trigram_list("NightKayak")


def _one(s, d, name):
    return _t(s, d, name)[0]


def _content_of(s, d):
    content, files = _t(s, d, "file_content", "files")
    return content.join(files.where("project = 'Tidegate'").select(F.col("id").alias("file_id")), "file_id", "left_semi").select("file_id", F.length("content").alias("n_chars"))


def _clean(s, d):
    files = _one(s, d, "files")
    return files.join(A.project_folders(files), "project").select("id", N.clean_path(F.col("path"), F.col("project"), F.col("folder")).alias("path"))


def _words(s, d):
    own = N.split_camel(F.col("name"))
    words = ["night", "kay"]
    return _one(s, d, "types").select("id", F.round(N.compound_share(own, words), 6).alias("compound"), F.round(N.equal_share(own, words), 6).alias("equal"))


def _jaccard(s, d):
    score = trigrams.jaccard(trigrams.trigrams(F.col("name")), F.array(*[F.lit(g) for g in GRAMS]))
    return _one(s, d, "types").select("id", F.round(score, 6).alias("score")).where("score > 0")


def _near_jaccard(s, d):
    hit = trigrams.postings(*_t(s, d, "types", "members")).where((F.col("entity_type") == "type") & F.col("trigram").isin(GRAMS)).groupBy("entity_id").agg(F.count("*").alias("m"))
    return hit.join(_one(s, d, "types").select(F.col("id").alias("entity_id"), "name"), "entity_id").select("entity_id", scoring.near_jaccard(F.col("m"), F.length("name"), len(GRAMS)).alias("score"))


def _projects_of(s, d):
    settings = {"projects": [{"name": "Game", "paths": ["D:/harbor/Game"]}, {"name": "All", "paths": ["d:\\harbor", "D:/tide"]}]}
    project, base = scan.project_of(F.col("path"), settings)
    return _one(s, d, "files").select("id", project.alias("owner"), base.alias("base"))


def _exists(s, d):
    types = _one(s, d, "types")
    return types.where("name = 'UCoreObject'").limit(1).agg((F.count("*") > 0).alias("known"))


def _rewritten(s, d):
    """Lines for a query with file, project and language conditions, as predicates on columns."""
    content, files = _t(s, d, "file_content", "files")
    own = files.where("project = 'Engine' and language = 'cpp'").where(F.col("path_lower").contains("/kernel/") & ~F.col("path_lower").contains("generated")).select(F.col("id").alias("file_id"))
    return text.lines(content.join(own, "file_id", "left_semi")).where(F.col("text").contains("Anchor")).groupBy("file_id").agg(F.count("*").alias("n_lines"))


QUERIES = {
    "s6_files_of_language": lambda s, d: _one(s, d, "files").where("language = 'angelscript'").select("id", "path", "project"),
    "s6_file_by_path": lambda s, d: S.chosen(_one(s, d, "files"), path="D:/harbor/Engine/Source/Runtime/Kernel/BaseFlameGhostKnoll.h").select("id", "path"),
    "s8_content_of_files": _content_of,
    "pred_optional_filters": lambda s, d: S.chosen(_one(s, d, "files"), project="Engine", language="all", module=None).select("id"),
    "pred_name_prefix": lambda s, d: _one(s, d, "files").where(F.col("basename_lower").startswith("night")).select("id", "basename_lower"),
    "pred_name_part": lambda s, d: _one(s, d, "files").where(F.col("basename_lower").contains("night")).select("id", "basename_lower"),
    "pred_module_subtree": lambda s, d: _one(s, d, "files").where(N.under(F.col("module"), "Engine.Runtime")).select("id", "module"),
    "pred_folder_prefix": lambda s, d: _one(s, d, "assets").where(F.col("folder").startswith("/Game/A")).select("id", "folder"),
    "pred_known": _exists,
    "pred_wanted_paths": lambda s, d: _one(s, d, "files").where(scan.wanted(F.col("path"), [".h", ".cpp"], ["**/Private/**", "Generated"])).select("id", "path"),
    "pred_definition_lines": lambda s, d: text.lines(_one(s, d, "file_content")).groupBy(scoring.is_definition(F.col("text")).alias("defines")).agg(F.count("*").alias("n_lines")),
    "pred_projects_of_paths": _projects_of,
    "o4_jaccard": _jaccard,
    "c17_near_jaccard": _near_jaccard,
    "c19_plain_match": lambda s, d: _one(s, d, "types").select("id", scoring.plain_match(F.col("name"), QUERY).alias("score")).where("score is not null"),
    "c21_compound_words": _words,
    "c22_clean_paths": _clean,
    "c30_json": lambda s, d: _one(s, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("t"), F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("json")),
    "c34_rewritten_query": _rewritten,
    "j5_types_by_language": lambda s, d: _one(s, d, "types").join(_one(s, d, "files").select(F.col("id").alias("file_id"), "language"), "file_id").groupBy("language", "kind").agg(F.count("*").alias("n")),
    "j13_hit_context": lambda s, d: context_of(_one(s, d, "members").dropDuplicates(["id"]).select("id", "file_id", "line"), _one(s, d, "file_content"), 1).select("id", "signature"),
}

_LINES = "(select file_id, unnest(string_split(content, chr(10))) as text from file_content where content is not null)"
_DEFINES = f"coalesce(not regexp_matches(text, '^\\s*(//|/\\*|\\*)') and regexp_matches(text, '{E.DEFINES}'), false)"
_GRAMS = f"[{_quoted(E.pieces(QUERY))}]"
_Q = QUERY.lower()
_RUNGS = f"""
    select id, round(case when c = '{_Q}' then 1::double when cs = '{_Q}' then 0.98::double when starts_with(c, '{_Q}') then 0.95::double when starts_with(cs, '{_Q}') then 0.93::double
        when contains(c, '{_Q}') then 0.85::double - (instr(c, '{_Q}') - 1)::double / length(c) * 0.15::double
        when contains(cs, '{_Q}') then 0.80::double - (instr(cs, '{_Q}') - 1)::double / length(cs) * 0.15::double
        when 1 - levenshtein(cs, '{_Q}')::double / greatest(length(cs), {len(_Q)}) > 0.35::double then (1 - levenshtein(cs, '{_Q}')::double / greatest(length(cs), {len(_Q)})) * 0.5::double end, 6) as score
    from (select id, lower(name) as c, lower(regexp_replace(name, '^[UAFES]', '')) as cs from types)"""

ORACLE = {
    "s6_files_of_language": "select id, path, project from files where language = 'angelscript'",
    "s6_file_by_path": "select id, path from files where path = 'D:/harbor/Engine/Source/Runtime/Kernel/BaseFlameGhostKnoll.h'",
    "s8_content_of_files": "select file_id, cast(length(content) as integer) as n_chars from file_content where file_id in (select id from files where project = 'Tidegate')",
    "pred_optional_filters": "select id from files where project = 'Engine'",
    "pred_name_prefix": "select id, basename_lower from files where basename_lower like 'night%'",
    "pred_name_part": "select id, basename_lower from files where basename_lower like '%night%'",
    "pred_module_subtree": "select id, module from files where module = 'Engine.Runtime' or module like 'Engine.Runtime.%'",
    "pred_folder_prefix": "select id, folder from assets where folder like '/Game/A%'",
    "pred_known": "select count(*) > 0 as known from types where name = 'UCoreObject'",
    "pred_wanted_paths": "select id, path from files where (path like '%.h' or path like '%.cpp') and not path like '%/Private/%' and not path like '%Generated%'",
    "pred_definition_lines": f"select {_DEFINES} as defines, count(*) as n_lines from {_LINES} group by 1",
    "pred_projects_of_paths": """
        select id, case when lower(path) like 'd:/harbor/game/%' then 'Game' when lower(path) like 'd:/harbor/%' or lower(path) like 'd:/tide/%' then 'All' end as owner,
               case when lower(path) like 'd:/harbor/game/%' then 'D:/harbor/Game' when lower(path) like 'd:/harbor/%' then 'd:/harbor' when lower(path) like 'd:/tide/%' then 'D:/tide' end as base from files""",
    "o4_jaccard": f"""
        select * from (select id, round(len(list_intersect(g, {_GRAMS}))::double / len(list_distinct(list_concat(g, {_GRAMS}))), 6) as score from (select id, {trigram_sql('name')} as g from types)) where score > 0""",
    "c17_near_jaccard": f"select id as entity_id, round(m::double / greatest({len(GRAMS)}, 1, length(name) - 2) * 0.7::double, 6) as score from (select id, name, len(list_intersect({trigram_sql('name')}, {_GRAMS})) as m from types) where m > 0",
    "c19_plain_match": f"select * from ({_RUNGS}) where score is not null",
    "c21_compound_words": f"select id, round({share_sql('own', ['night', 'kay'], False)}::double, 6) as compound, round({share_sql('own', ['night', 'kay'], True)}::double, 6) as equal from (select id, {camel_sql('name')} as own from types)",
    "c22_clean_paths": """
        with ends as (select project, string_split(min(path), '/')[:-2] as a, string_split(max(path), '/')[:-2] as b from files group by project),
        same as (select project, a, (select coalesce(min(i), least(len(a), len(b)) + 1) from range(1, least(len(a), len(b)) + 1) t(i) where a[i] <> b[i]) as cut from ends),
        folders as (select project, array_to_string(list_slice(a, 1, cut - 1), '/') || case when cut > 1 then '/' else '' end as folder from same)
        select id, f.project || '/' || substr(path, length(folder) + 1) as path from files f join folders g on g.project = f.project""",
    "c30_json": "select event_id, '{\"t\":\"' || event_type || '\",\"k\":' || json_extract_string(props, '$.k') || '}' as json from events",
    "c34_rewritten_query": f"""
        select file_id, count(*) as n_lines from {_LINES} where contains(text, 'Anchor')
        and file_id in (select id from files where project = 'Engine' and language = 'cpp' and path_lower like '%/kernel/%' and not path_lower like '%generated%') group by file_id""",
    "j5_types_by_language": "select language, kind, count(*) as n from types t join files f on f.id = t.file_id group by all",
    "j13_hit_context": """
        select m.id, case when line between 1 and len(ls) then trim(ls[line], ' ') end as signature
        from (select distinct id, file_id, line from members) m left join (select file_id, string_split(content, chr(10)) as ls from file_content) c on c.file_id = m.file_id""",
}
