"""Queries over the symbol lookups, with SQL that says the same independently."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import symbols as S
from codeloom.plans import expected as E
from codeloom.session import table


def _t(spark, d, *tables):
    return [table(spark, d, t) for t in tables]


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# ---- SQL fragments -------------------------------------------------------------------------------------------------

STRUCTURE = """round(cast(case when coalesce(parent, '') <> '' then 10 else 0 end
    + case when path like '%.h' then 5 else 0 end
    + case when path like '%/Runtime/%' then 2 when path like '%/Developer/%' then 1 else 0 end as double)
    + case when path like '%/Public/%' or path like '%/Classes/%' then 1.5::double when path like '%/Private/%' then 0.5::double else 0 end
    + case when coalesce(path, '') <> '' then greatest(0::double, 0.5::double - length(path) * 0.004::double) else 0 end, 6)"""

#: Merges the rows of ``ranked`` (ord, name, kind, path, structure and more) by name and kind.
DEDUP = """
    numbered as (select *, row_number() over (partition by name, kind order by structure desc, ord) as best from ranked),
    kept as (select * from numbered where best = 1),
    merged as (
        select k.*, coalesce(
            (select max_by(l.path, l.ord) from numbered l where l.name = k.name and l.kind = k.kind and l.ord > k.ord and l.path like '%.cpp'),
            (select case when min_by(b.path, b.best) like '%.cpp' then min_by(b.path, b.best) end from numbered b where b.name = k.name and b.kind = k.kind and b.ord < k.ord)
        ) as implementation_path from kept k)"""


def camel_sql(x: str) -> str:
    bare = f"regexp_replace({x}, '^[UAFESI]([A-Z])', '\\1')"
    return f"list_filter(string_split_regex(lower(regexp_replace(regexp_replace({bare}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g')), '\\s+'), lambda w: w <> '')"


def trigram_sql(x: str) -> str:
    return f"case when length({x}) >= 3 then list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr(lower({x}), i, 3))) else [] end"


def share_sql(own: str, words: list[str], equal: bool) -> str:
    hit = f"list_contains({own}, q)" if equal else f"len(list_filter({own}, lambda c: starts_with(c, q) or starts_with(q, c))) > 0"
    return f"(len(list_filter([{_quoted(words)}], lambda q: {hit})) / {len(words)}.0)"


def type_rungs_sql(query: str) -> str:
    """Selects name, ..., score and match_reason from ``found``."""
    q, qs = query.lower(), (query[1:] if query[:1] in E.LETTERS else query).lower()
    words = E.WORDS[query]
    rungs = [
        (f"c = '{q}'", 1.0, "exact"), (f"cs = '{qs}'", 0.98, "exact-stripped"), (f"cs = '{q}'", 0.97, "exact-stripped"),
        (f"starts_with(c, '{q}')", 0.95, "prefix"), (f"starts_with(cs, '{qs}')", 0.93, "prefix-stripped"), (f"starts_with(cs, '{q}')", 0.92, "prefix-stripped"),
        (f"contains(c, '{q}')", 0.85, "substring"), (f"contains(cs, '{qs}')", 0.80, "substring-stripped"),
    ]
    if len(words) >= 2:
        share = f"greatest({share_sql('own', words, True)}, {share_sql('own', words, False)})"
        rungs += [(f"{share} >= 1", 0.70, "word-match-all"), (f"{share} >= 0.66", 0.50, "word-match-most"), (f"{share} >= 0.5", 0.40, "word-match-some"), (f"{share} > 0", 0.30, "word-match-few")]
    import re

    qc = re.sub("^(get|set|is|has|can|should)", "", q)
    score = "case " + " ".join(f"when {c} then {s}::double" for c, s, _ in rungs) + " else 0.3::double end"
    reason = "case " + " ".join(f"when {c} then '{r}'" for c, _, r in rungs) + " else 'trigram' end"
    base = f"select *, lower(name) as c, lower(regexp_replace(name, '^[UAFESI]', '')) as cs, {camel_sql('name')} as own from found"
    first = f"select *, {score} as s0, {reason} as r0, regexp_replace(c, '^(get|set|is|has|can|should)', '') as cc from ({base})"
    if qc and qc != q:
        second = f"""select *, case when s0 < 0.85 and cc = '{qc}' then greatest(s0, 0.88::double) when s0 < 0.85 and contains(cc, '{qc}') then greatest(s0, 0.75::double) else s0 end as s1,
            case when s0 < 0.85 and cc = '{qc}' then 'getter-setter' when s0 < 0.85 and contains(cc, '{qc}') and r0 = 'trigram' then 'getter-setter-partial' else r0 end as match_reason from ({first})"""
    else:
        second = f"select *, s0 as s1, r0 as match_reason from ({first})"
    return f"select *, round(s1 + {E.KIND_SQL} + case when depth is not null then greatest(0::double, 0.03::double - depth * 0.005::double) else 0 end, 6) as score from ({second})"


def find_type_sql(name: str, kind: str | None = None, project: str | None = None, limit: int = 10) -> str:
    only = (f" and t.kind = '{kind}'" if kind else "") + (f" and f.project = '{project}'" if project else "")
    own = f" and project = '{project}'" if project else ""
    base = f"'{name[:-2]}'" if name.endswith("_C") else "null"
    return f"""
    with found as (
        select t.id, t.name, t.kind, t.parent, t.line, f.path, f.project, case when t.name = '{name}' then 0 else 1 end as stage
        from types t join files f on f.id = t.file_id where t.name in ({_quoted([name, *E.variants(name)])}){only}
        union all
        select id, name, 'class', parent_class, 0, content_path, project, case when name = '{name}' then 2 else 3 end
        from assets where asset_class is not null and name in ('{name}', {base}){own}),
    usable as (select * from found where stage = (select min(stage) from found) or (stage = 2 and (select min(stage) from found) < 2)),
    listed as (
        select *, row_number() over (order by stage >= 2, case when stage < 2 and not regexp_matches(lower(path), '\\.(h|hpp|hxx)$') then 1 else 0 end, id) as ord from usable),
    ranked as (select *, {STRUCTURE} as structure, case when stage = 1 then 'prefix-variant' else 'exact' end as match_reason from listed where ord <= {limit}),
    {DEDUP}
    select name, kind, parent, line, path, project, match_reason, implementation_path, structure,
           cast(row_number() over (order by structure desc, ord) as integer) as rank from merged"""


def fuzzy_type_sql(query: str, limit: int = 10, assets: bool = False) -> str:
    q, qs = query.lower(), (query[1:] if query[:1] in E.LETTERS else query).lower()
    starts = sorted({q} | {p.lower() + x for p in E.LETTERS for x in {q, qs}})
    near = " or ".join(f"starts_with(lower(t.name), '{s}')" for s in starts)
    grams = E.pieces(q)
    deep = f"len(list_intersect({trigram_sql('t.name')}, [{_quoted(grams)}])) >= {E.least_shared(q)}" if len(q) >= 3 and len(grams) >= 3 else f"contains(lower(t.name), '{q}')"
    extra = f"union all select id, name, 'class', parent_class, 0, content_path, project, null, 1 from assets where asset_class is not null and contains(lower(name), '{q}')" if assets else ""
    return f"""
    with flagged as (
        select t.id, t.name, t.kind, t.parent, t.line, f.path, f.project, t.depth, ({near}) as near
        from types t join files f on f.id = t.file_id where ({near}) or {deep}),
    found as (
        select id, name, kind, parent, line, path, project, depth, 0 as is_asset from flagged
        where near or (select count(*) from flagged where near) < {limit} {extra}),
    scored as ({type_rungs_sql(query)}),
    ranked as (select *, {STRUCTURE} as structure, row_number() over (partition by name, kind order by score desc, is_asset, id) as ord from scored where score >= 0.4),
    {DEDUP}
    select name, kind, parent, line, path, project, match_reason, implementation_path, structure,
           cast(row_number() over (order by structure desc, score desc, is_asset, id) as integer) as rank, score
    from merged order by rank limit {limit}"""


_MEMBERS = """
    select m.*, t.name as type_name, f.path, f.project from (select distinct * from members) m
    join files f on f.id = m.file_id left join types t on t.id = m.type_id"""


def member_sql(name: str, containing: str | None = None, kind: str | None = None, limit: int = 20, family: str | None = None) -> str:
    where = f"name = '{name}'" + (f" and member_kind = '{kind}'" if kind else "")
    if containing:
        where += f" and (type_name = '{containing}' or starts_with(type_name, '{containing}MixinLibrary')" + (f" or type_name in ({family})" if family else "") + ")"
    return f"""select cast(row_number() over (order by id) as integer) as rank, name, type_name, member_kind, line, is_static, specifiers, path, project
        from ({_MEMBERS}) where {where} order by rank limit {limit}"""


def fuzzy_member_sql(query: str, limit: int = 20) -> str:
    q, grams, words = query.lower(), E.pieces(query), E.WORDS[query]
    deep = f"len(list_intersect({trigram_sql('name')}, [{_quoted(grams)}])) >= {E.least_shared(q)}"
    union = f"len(list_distinct(list_concat({trigram_sql('name')}, [{_quoted(grams)}])))"
    tail = f"round(len(list_intersect({trigram_sql('name')}, [{_quoted(grams)}]))::double / {union} * 0.7::double, 9)"
    rung = f"c = '{q}' then {{}} when starts_with(c, '{q}') then {{}} when contains(c, '{q}') then {{}} when contains('{q}', c) and c <> '' then {{}} else {{}}"
    score = "case when " + rung.format("1::double", "0.95::double", "0.85::double", "0.8::double", tail) + " end"
    reason = "case when " + rung.format("'exact'", "'prefix'", "'substring'", "'reverse-substring'", "'trigram'") + " end"
    share = share_sql("own", words, False) if len(words) >= 2 else "0"
    return f"""
    with flagged as (select *, starts_with(lower(name), '{q}') as near from ({_MEMBERS}) where starts_with(lower(name), '{q}') or {deep}),
    found as (select *, lower(name) as c, {camel_sql('name')} as own from flagged where near or (select count(*) from flagged where near) < {limit}),
    first as (select *, {score} as s0, {reason} as r0, {share} as share from found),
    scored as (
        select *, case when s0 < 0.7 and share >= 1 then 0.7::double when s0 < 0.5 and share >= 0.66 then 0.5::double else s0 end as s1,
               case when s0 < 0.7 and share >= 1 then 'word-match-all' when s0 < 0.5 and share >= 0.66 then 'word-match-most' else r0 end as match_reason from first),
    final as (select *, round(s1 + least(0.08::double, coalesce({E.SPECIFIER_SQL}, 0)), 6) as score from scored)
    select cast(row_number() over (order by score desc, id) as integer) as rank, name, type_name, member_kind, line, is_static, specifiers, path, project, score, match_reason
    from final where score >= 0.15 order by rank limit {limit}"""


def file_sql(stem: str, limit: int = 20) -> str:
    s = stem.lower()
    return f"""
    with scored as (
        select *, round(case when basename_lower = '{s}' then 1::double when starts_with(basename_lower, '{s}') then 0.85::double else 0.7::double end
            + case when path_lower like '%.h' then 0.01::double else 0 end
            + case when path_lower like '%/runtime/%' then 0.004::double when path_lower like '%/developer/%' then 0.002::double else 0 end
            + case when path_lower like '%/public/%' or path_lower like '%/classes/%' then 0.003::double when path_lower like '%/private/%' then 0.001::double else 0 end, 6) as score
        from files where contains(basename_lower, '{s}')),
    best as (select *, cast(row_number() over (order by score desc, length(path), id) as integer) as rank from scored),
    own as (select *, row_number() over (partition by file_id order by id) as n from types)
    select rank, path, project, module, language, score,
           (select list({{'name': o.name, 'kind': o.kind, 'line': o.line}} order by o.n) from own o where o.file_id = b.id and o.n <= 10) as types
    from best b where rank <= {limit}"""


def asset_sql(name: str, fuzzy: bool, folder: str | None = None, limit: int = 20) -> str:
    where = f"starts_with(folder, '{folder}')" if folder else "true"
    n = name.lower()
    if fuzzy:
        body = f"select *, case when lower(name) = '{n}' then 1::double when starts_with(lower(name), '{n}') then 0.95::double else 0.85::double end as score from assets where contains(lower(name), '{n}') and {where}"
    else:
        body = f"select *, 1::double as score from assets where {where} and (name = '{name}' or (lower(name) = '{n}' and not exists (select 1 from assets x where x.name = '{name}' and {where})))"
    return f"""select cast(row_number() over (order by score desc, id) as integer) as rank, name, content_path, folder, project, asset_class, parent_class, score
        from ({body}) order by rank limit {limit}"""


def below_sql(rows: str, column: str, parent: str, sep: str, depth: int, out: str) -> str:
    base = len([p for p in parent.split(sep) if p])
    lead = "" if sep == "." else sep
    bare = parent.rstrip(sep)
    inside = f"({column} = '{bare}' or starts_with({column}, '{bare}{sep}'))" if parent.strip(sep) else "true"
    parts = f"list_filter(string_split({column}, '{sep}'), lambda p: p <> '')"
    return f"""select '{lead}' || array_to_string(list_slice({parts}, 1, {base + depth}), '{sep}') as {out}, count(*) as n
        from ({rows}) where {inside} and len({parts}) > {base} group by 1"""


def browse_sql(module: str, limit: int, max_files: int) -> str:
    return f"""
    with inside as (select * from files where module = '{module}' or starts_with(module, '{module}.')),
    typed as (select t.id, t.name, t.kind, i.path, row_number() over (order by t.id) as rank, count(*) over () as n from types t join inside i on i.id = t.file_id),
    plain as (select id, basename_lower as name, language as kind, path, row_number() over (order by id) as rank, count(*) over () as n from inside)
    select 'type' as entry, cast(rank as integer) as rank, name, kind, path, n > {limit} as truncated, (select count(*) from inside) as total_files from typed where rank <= {limit}
    union all select 'file', cast(rank as integer), name, kind, path, n > {max_files}, (select count(*) from inside) from plain where rank <= {max_files}"""


_LETTERS = ", ".join(f"'{p}'" for p in E.LETTERS)
BATCH_SQL = f"""
    with asked as (select distinct regexp_replace(parent, '^[UAFESI]', '') as query from types where parent <> ''),
    keys as (
        select distinct query, name, case when name = query then 0 else 1 end as stage from (
            select query, query as name from asked
            union all select query, p || query from asked, unnest([{_LETTERS}]) as x(p)
            union all select query, p || regexp_replace(query, '^[UAFESI]', '') from asked, unnest([{_LETTERS}, '']) as x(p) where regexp_matches(query, '^[UAFESI]'))),
    found as (
        select k.query, k.stage, t.id, t.name, t.kind, t.parent, t.line, f.path, f.project, min(k.stage) over (partition by k.query) as best
        from types t join files f on f.id = t.file_id join keys k on k.name = t.name),
    ranked as (
        select *, row_number() over (partition by query order by case when regexp_matches(lower(path), '\\.(h|hpp|hxx)$') then 0 else 1 end, id) as rank from found where stage = best)
    select query, cast(rank as integer) as rank, name, kind, parent, line, path, project, case when stage = 1 then 'prefix-variant' else 'exact' end as match_reason from ranked where rank <= 10"""


def _batch(s, d):
    types, files = _t(s, d, "types", "files")
    asked = types.where("parent <> ''").select(F.regexp_replace("parent", "^[UAFESI]", "").alias("query"))
    return S.find_types_batch(types, files, asked)


TFA = ("types", "files", "assets")
MTF = ("members", "types", "files")
QUERIES = {
    "f1_find_type_exact": lambda s, d: S.find_type(*_t(s, d, *TFA), "UCoreObject"),
    "f1_find_type_variant": lambda s, d: S.find_type(*_t(s, d, *TFA), "StageActor"),
    "f1_find_type_kind": lambda s, d: S.find_type(*_t(s, d, *TFA), "AStageActor", S.Options(kind="class", project="Engine", max_results=5)),
    "f1_find_type_batch": _batch,
    "f2_find_type_fuzzy": lambda s, d: S.find_type_fuzzy(*_t(s, d, *TFA), "NightKayak"),
    "f2_find_type_fuzzy_prefix": lambda s, d: S.find_type_fuzzy(*_t(s, d, *TFA), "UKayak"),
    "f2_find_type_fuzzy_assets": lambda s, d: S.find_type_fuzzy(*_t(s, d, *TFA), "FrostLance", S.Options(include_assets=True, max_results=15)),
    "f3_find_member": lambda s, d: S.find_member(*_t(s, d, *MTF), "ApplyAnchor"),
    "f3_find_member_kind": lambda s, d: S.find_member(*_t(s, d, *MTF), "StepFrame", S.Options(kind="function", max_results=50)),
    "f4_find_member_fuzzy": lambda s, d: S.find_member_fuzzy(*_t(s, d, *MTF), "AnchorHealth"),
    "f4_find_member_fuzzy_prefix": lambda s, d: S.find_member_fuzzy(*_t(s, d, *MTF), "ApplyA"),
    "f6_members_of_type": lambda s, d: S.members_of(*_t(s, d, "members", "types"), "UCoreObject", 5, 5),
    "f8_find_file": lambda s, d: S.find_file(*_t(s, d, "files", "types"), "Night.h"),
    "f9_find_asset": lambda s, d: S.find_asset(*_t(s, d, "assets"), "crane"),
    "f9_find_asset_exact": lambda s, d: S.find_asset(*_t(s, d, "assets"), "abp_craneamberlever", fuzzy=False),
    "f9_find_asset_folder": lambda s, d: S.find_asset(*_t(s, d, "assets"), "Frost", folder="/Game/A"),
    "f10_browse_module": lambda s, d: S.browse_module(*_t(s, d, "types", "files"), "Engine.Runtime.Paint", S.Options(max_results=100)),
    "f11_list_modules": lambda s, d: S.list_modules(*_t(s, d, "files"), "Engine", depth=2),
    "f11_list_modules_top": lambda s, d: S.list_modules(*_t(s, d, "files")),
    "f12_browse_assets": lambda s, d: S.browse_assets(*_t(s, d, "assets"), "/Game/Actors", limit=20),
    "f13_list_asset_folders": lambda s, d: S.list_asset_folders(*_t(s, d, "assets"), "/Game"),
}

_F6 = """
    with own as (
        select *, case when member_kind in ('function', 'method') then 'function' when member_kind = 'enum_value' then 'enum_value' else 'property' end as bucket
        from (select distinct * from members) where type_id in (select id from types where name = 'UCoreObject')),
    numbered as (select *, row_number() over (partition by bucket order by id) as n, count(*) over (partition by bucket) as n_in_bucket from own)
    select bucket, cast(n as integer) as n, id, name, member_kind, line, is_static, specifiers, n_in_bucket from numbered where bucket = 'enum_value' or n <= 5"""

ORACLE = {
    "f1_find_type_exact": find_type_sql("UCoreObject"),
    "f1_find_type_variant": find_type_sql("StageActor"),
    "f1_find_type_kind": find_type_sql("AStageActor", "class", "Engine", 5),
    "f1_find_type_batch": BATCH_SQL,
    "f2_find_type_fuzzy": fuzzy_type_sql("NightKayak"),
    "f2_find_type_fuzzy_prefix": fuzzy_type_sql("UKayak"),
    "f2_find_type_fuzzy_assets": fuzzy_type_sql("FrostLance", 15, True),
    "f3_find_member": member_sql("ApplyAnchor"),
    "f3_find_member_kind": member_sql("StepFrame", kind="function", limit=50),
    "f4_find_member_fuzzy": fuzzy_member_sql("AnchorHealth"),
    "f4_find_member_fuzzy_prefix": fuzzy_member_sql("ApplyA"),
    "f6_members_of_type": _F6,
    "f8_find_file": file_sql("Night"),
    "f9_find_asset": asset_sql("crane", True),
    "f9_find_asset_exact": asset_sql("abp_craneamberlever", False),
    "f9_find_asset_folder": asset_sql("Frost", True, "/Game/A"),
    "f10_browse_module": browse_sql("Engine.Runtime.Paint", 100, 50),
    "f11_list_modules": below_sql("select * from files where coalesce(language, '') not in ('content', 'asset')", "module", "Engine", ".", 2, "module"),
    "f11_list_modules_top": below_sql("select * from files where coalesce(language, '') not in ('content', 'asset')", "module", "", ".", 1, "module"),
    "f12_browse_assets": """select cast(rank as integer) as rank, name, content_path, asset_class, n > 20 as truncated from (
        select *, row_number() over (order by name, id) as rank, count(*) over () as n from assets where folder = '/Game/Actors') where rank <= 20""",
    "f13_list_asset_folders": below_sql("select * from assets", "folder", "/Game", "/", 1, "folder"),
}
