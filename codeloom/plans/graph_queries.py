"""Queries over the inheritance graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import closure as C
from codeloom.operators import symbols as S
from codeloom.plans.search_queries import _t, member_sql

_LINKS = """
    links as (
        select name as child, parent from types where kind in ('class', 'struct', 'interface') and name is not null and parent <> ''
        union
        select name, parent_class from assets where asset_class is not null and parent_class <> ''
        union
        select a.name, t.name from assets a join types t on substr(t.name, 2) = a.parent_class
        where asset_class is not null and t.kind in ('class', 'struct', 'interface') and regexp_matches(t.name, '^[UAFESI][A-Z]'))"""


def _below(parent: str) -> str:
    return f"""{_LINKS},
    below as (select child as name from links where parent = '{parent}' union select l.child from below b join links l on l.parent = b.name)"""


def _children_sql(parent: str, limit: int, project: str | None = None, language: str | None = None) -> str:
    f_own = (f" and f.project = '{project}'" if project else "") + (f" and f.language = '{language}'" if language and language != "blueprint" else "")
    a_own = f" and project = '{project}'" if project else ""
    types = f"""select 0 as is_asset, t.id, t.name, t.kind, t.parent, f.path, f.project from types t join files f on f.id = t.file_id
        where t.kind in ('class', 'struct', 'interface') and t.name in (select name from below){f_own}"""
    assets = f"""select 1 as is_asset, id, name, 'class' as kind, parent_class as parent, content_path as path, project from assets
        where asset_class is not null and name in (select name from below){a_own}"""
    parts = [x for x, on in ((types, language != "blueprint"), (assets, language in (None, "blueprint"))) if on]
    return f"""with recursive {_below(parent)}, found as ({' union all '.join(parts)}),
        ranked as (select *, row_number() over (order by is_asset, id) as rank, count(*) over () as total from found)
        select cast(rank as integer) as rank, name, kind, parent, path, project, total >= {limit} as truncated, total,
               exists (select 1 from types where name = '{parent}') or exists (select 1 from assets where name = '{parent}') as parent_found
        from ranked where rank <= {limit}"""


def _start(s, name):
    return s.createDataFrame([(name,)], "name string")


def _hierarchy_members(s, d):
    members, types, files, assets = _t(s, d, "members", "types", "files", "assets")
    family = C.descendants(C.inheritance(types, assets), _start(s, "UStageComponent"))
    return S.find_member(members, types, files, "StepFrame", S.Options(max_results=100), "UStageComponent", family)


def _synthetic(s, d):
    members, types, files = _t(s, d, "members", "types", "files")
    name = "UHullComponent"
    found = S.find_member(members, types, files, "Get", containing=name)
    above = C.ancestors(C.inheritance(types, None), name)
    return S.synthetic_members(found, above, name, "Get", True, 20, base="UStageComponent")


def _explain(s, d):
    """One row about a type: its declaration, its members in buckets and its first children."""
    types, files, assets, members = _t(s, d, "types", "files", "assets", "members")
    name = "ACrewPawn"
    declared = S.find_type(types, files, assets, name, S.Options(max_results=1)).select("name", "kind", "parent", "path", "project")
    inside = S.members_of(members, types, name).groupBy().agg(F.array_sort(F.collect_list(F.struct("bucket", "n", F.col("name").alias("member")))).alias("members"))
    below = C.children(types, files, assets, name, limit=20).groupBy().agg(F.array_sort(F.collect_list(F.struct("rank", F.col("name").alias("child")))).alias("children"))
    return declared.join(F.broadcast(inside)).join(F.broadcast(below))


QUERIES = {
    "h1_descendants": lambda s, d: C.descendants(C.inheritance(*_t(s, d, "types", "assets")), _start(s, "AStageActor")),
    "h2_subtypes": lambda s, d: C.descendants(C.inheritance(*_t(s, d, "types", "assets")), _start(s, "UFlowTask")),
    "h3_is_descendant": lambda s, d: C.is_descendant(C.inheritance(*_t(s, d, "types", "assets")), "UHullComponent", "UCoreObject"),
    "h4_depth": lambda s, d: C.depths(*_t(s, d, "types")),
    "h5_adjacency": lambda s, d: C.inheritance(*_t(s, d, "types", "assets")),
    "f3_member_in_hierarchy": _hierarchy_members,
    "f5_synthetic_members": _synthetic,
    "f7_children_direct": lambda s, d: C.children(*_t(s, d, "types", "files", "assets"), "UCoreObject", recursive=False),
    "f7_children_recursive": lambda s, d: C.children(*_t(s, d, "types", "files", "assets"), "AStageActor", limit=100),
    "f7_children_filtered": lambda s, d: C.children(*_t(s, d, "types", "files", "assets"), "AStageActor", project="Harborfall", language="angelscript"),
    "f7_children_blueprint": lambda s, d: C.children(*_t(s, d, "types", "files", "assets"), "UPanelWidget", language="blueprint"),
    "f14_explain_type": _explain,
}

_EXPLAIN = f"""
    with recursive {_below('ACrewPawn')},
    found as (
        select 0 as is_asset, t.id, t.name from types t join files f on f.id = t.file_id where t.kind in ('class', 'struct', 'interface') and t.name in (select name from below)
        union all select 1, id, name from assets where asset_class is not null and name in (select name from below)),
    kids as (select row_number() over (order by is_asset, id) as rank, name from found),
    own as (
        select *, case when member_kind in ('function', 'method') then 'function' when member_kind = 'enum_value' then 'enum_value' else 'property' end as bucket
        from (select distinct * from members) where type_id in (select id from types where name = 'ACrewPawn')),
    numbered as (select *, row_number() over (partition by bucket order by id) as n from own)
    select t.name, t.kind, t.parent, f.path, f.project,
        coalesce((select list({{'bucket': bucket, 'n': cast(n as integer), 'member': name}} order by bucket, n) from numbered where bucket = 'enum_value' or n <= 30), []) as members,
        coalesce((select list({{'rank': cast(rank as integer), 'child': name}} order by rank) from kids where rank <= 20), []) as children
    from types t join files f on f.id = t.file_id where t.name = 'ACrewPawn'
    order by not regexp_matches(lower(f.path), '\\.(h|hpp|hxx)$'), t.id limit 1"""

ORACLE = {
    "h1_descendants": f"with recursive {_below('AStageActor')} select distinct name from below",
    "h2_subtypes": f"with recursive {_below('UFlowTask')} select distinct name from below",
    "h3_is_descendant": f"with recursive {_below('UCoreObject')} select count(*) > 0 as answer from below where name = 'UHullComponent'",
    "h4_depth": """
        with recursive links as (
            select distinct name as child, parent from types where name is not null and parent <> '' and parent in (select name from types)),
        walk as (
            select distinct name, 0 as depth, [name] as path from types where name is not null and name not in (select child from links)
            union all
            select l.child, w.depth + 1, list_append(w.path, l.child) from walk w join links l on l.parent = w.name where not list_contains(w.path, l.child))
        select n.name, cast(min(depth) as bigint) as depth from (select distinct name from types where name is not null) n left join walk w on w.name = n.name group by n.name""",
    "h5_adjacency": f"with {_LINKS} select child, parent from links",
    "f3_member_in_hierarchy": f"with recursive {_below('UStageComponent')} {member_sql('StepFrame', 'UStageComponent', limit=100, family='select name from below')}",
    "f5_synthetic_members": """
        select cast(row_number() over () as integer) as rank, m as name, 'UHullComponent' as type_name, 'function' as member_kind, 0 as line, true as is_static,
               cast(null as varchar) as specifiers, cast(null as varchar) as path, cast(null as varchar) as project
        from (values ('Get'), ('GetOrCreate')) as x(m)""",
    "f7_children_direct": """
        with found as (
            select 0 as is_asset, t.id, t.name, t.kind, t.parent, f.path, f.project from types t join files f on f.id = t.file_id where t.parent = 'UCoreObject'
            union all select 1, id, name, 'class', parent_class, content_path, project from assets where asset_class is not null and parent_class in ('UCoreObject', 'CoreObject')),
        ranked as (select *, row_number() over (order by is_asset, id) as rank, count(*) over () as total from found)
        select cast(rank as integer) as rank, name, kind, parent, path, project, total >= 50 as truncated, total, true as parent_found from ranked where rank <= 50""",
    "f7_children_recursive": _children_sql("AStageActor", 100),
    "f7_children_filtered": _children_sql("AStageActor", 50, "Harborfall", "angelscript"),
    "f7_children_blueprint": _children_sql("UPanelWidget", 50, language="blueprint"),
    "f14_explain_type": _EXPLAIN,
}
