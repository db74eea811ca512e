"""Queries over the operators for skewed keys, orphan references, change feeds and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import hierarchy as H
from codeloom.operators import orphans, patches
from codeloom.operators.skew import heavy_keys, heavy_light_join, summarise_by_key
from codeloom.session import Scratch, table

#: A value on at least this share of a table's rows is heavy.
HEAVY = 0.05


def _keyed_rows(spark: SparkSession, d: str) -> DataFrame:
    files, types = table(spark, d, "files"), table(spark, d, "types")
    pick = lambda t, c, name: t.select(F.lit(name).alias("field_name"), F.col(c).alias("key_value"), "id")
    return pick(types, "parent", "types.parent").unionByName(pick(files, "project", "files.project")).unionByName(pick(files, "module", "files.module"))


def _summary(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "skew")
    return scratch.save(summarise_by_key(_keyed_rows(spark, d), ["field_name", "key_value"], "id", scratch))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    summary = _summary(spark, d)
    total = summary.groupBy("field_name").agg(F.sum("n").alias("total"))
    return heavy_keys(summary.where("key_value <> ''"), total, ["field_name", "key_value"], HEAVY).select("field_name", "key_value")


def p2_key_figures(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d).select("field_name", "key_value", F.col("n").alias("n_rows"), F.col("low").alias("first_id"), F.col("high").alias("last_id"))


def _owned(rows: DataFrame, owners: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """``rows`` with the columns of their owner; rows without one are left out. Owners of very many rows are broadcast."""
    rows, found = scratch.measured(rows, rows=F.count(F.lit(1)))
    limit = max(1, int(found["rows"] * orphans.HEAVY_SHARE))
    heavy = [r[0] for r in rows.groupBy(key).count().where(f"count > {limit}").select(key).dropna().collect()]  # at most 1 / HEAVY_SHARE
    return scratch.save(heavy_light_join(rows, owners, key, heavy))


def p2_measures(spark: SparkSession, d: str) -> DataFrame:
    """For every parent, project and module: the distinct names of types that name a parent (``n_children``), files, types
    and members, each member once. Types belong to the project and module of their file, members too; to a parent belong
    the types that name it, their files and their members. What has no such file or type counts nowhere there."""
    scratch = Scratch(spark, "measures")
    homes = table(spark, d, "files").select(F.col("id").alias("file_id"), "project", "module")
    types = table(spark, d, "types").select("id", "file_id", "name", "parent")
    members = scratch.save(table(spark, d, "members").select("id", "type_id", "file_id").distinct())
    placed = _owned(types, homes, "file_id", scratch)
    in_files = _owned(members.select("id", "file_id"), homes, "file_id", scratch)
    in_types = _owned(members.select("id", "type_id"), types.select(F.col("id").alias("type_id"), "parent"), "type_id", scratch)
    rows = None
    for measure, field, frame, column, order in (
        *((m, f, t, f.split(".")[1], "id") for f in ("files.project", "files.module") for m, t in (("files", homes.withColumnRenamed("file_id", "id")), ("types", placed), ("members", in_files))),
        ("types", "types.parent", types, "parent", "id"),
        ("members", "types.parent", in_types, "parent", "id"),
        ("files", "types.parent", types.where("file_id is not null").select("parent", "file_id").distinct(), "parent", "file_id"),
        *(("children", f, t.where("parent <> '' and name is not null").select(F.col(f.split(".")[1]).alias("value"), "name").distinct(), "value", "name") for f, t in (("files.project", placed), ("files.module", placed), ("types.parent", types))),
    ):
        place = F.xxhash64(order) if order == "name" else F.col(order)
        part = frame.select(F.lit(field).alias("field_name"), F.col(column).alias("key_value"), F.lit(measure).alias("measure"), place.alias("id"))
        rows = part if rows is None else rows.unionByName(part)
    summary = scratch.save(summarise_by_key(rows, ["field_name", "key_value", "measure"], "id", scratch))
    counts = [F.coalesce(F.sum(F.when(F.col("measure") == m, F.col("n"))), F.lit(0)).alias(f"n_{m}") for m in ("children", "files", "types", "members")]
    return summary.groupBy("field_name", "key_value").agg(*counts)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "period", "row_id")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.find_orphans(*(table(spark, d, t) for t in ("types", "members", "assets", "files")))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).groupBy("ref_table", "period").agg(F.count("*").alias("n_orphans"), F.count_distinct("reference").alias("n_references"))


def _owners(spark: SparkSession, d: str):
    """The reference of each member to its owner, by type and file together, either of which may be null."""
    members = table(spark, d, "members").dropDuplicates(["id"]).select("id", "type_id", "file_id")
    return members, table(spark, d, "types").select(F.col("id").alias("type_id"), "file_id")


def p3_owner_references(spark: SparkSession, d: str) -> DataFrame:
    """Composite references with partial nulls: (``type_id``, ``file_id``) of members, and (``name``, ``parent``) of assets'
    and types' declarations read as a reference to a declaration of that name and parent. How many values and rows find
    nothing under each semantics."""
    members, types = _owners(spark, d)
    declared = table(spark, d, "types").select("name", "parent")
    assets = table(spark, d, "assets").select("name", F.col("parent_class").alias("parent"))
    parts = None
    for name, rows, columns, targets in (("members", members, ["type_id", "file_id"], types), ("assets", assets, ["name", "parent"], declared)):
        for match in ("simple", "partial", "full"):
            lost = orphans.orphan_values(rows, columns, targets, match).agg(F.lit(name).alias("ref_table"), F.lit(match).alias("match"), F.count("*").alias("n_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))
            parts = lost if parts is None else parts.unionByName(lost)
    return parts


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return patches.present_paths(table(spark, d, "file_changes"))


def p4_state(spark: SparkSession, d: str) -> DataFrame:
    state = patches.apply_patches(patches.composed(table(spark, d, "file_changes")), table(spark, d, "files").select("path", "mtime", "project"))
    return state.select("path_lower", "present", "mtime", "session_no", "event_seq")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return H.names_on_cycles(table(spark, d, "types"), table(spark, d, "assets"))


def p5_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = H.hierarchy(table(spark, d, "types"), table(spark, d, "assets"))
    return tree.select("node_name", "parent_name", "root_name", "depth", "path", "n_descendants", "on_cycle")


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    return H.all_paths(table(spark, d, "types"), table(spark, d, "assets"))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return H.descendant_counts(table(spark, d, "types"), table(spark, d, "assets"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.all_descendants(table(spark, d, "types"), table(spark, d, "assets"))


QUERIES = {f.__name__: f for f in (p2_found, p2_key_figures, p2_measures, p3_found, p3_report, p3_owner_references, p4_found, p4_state, p5_found, p5_hierarchy, p5_paths, p5_counts, p5_descendants)}

_KEYED = """
    select 'types.parent' as field_name, parent as key_value, id from types
    union all select 'files.project', project, id from files
    union all select 'files.module', module, id from files"""

_CLASS_KEYS = """
    select distinct name as k, name from types where name is not null
    union select substr(name, 2), name from types where regexp_matches(name, '^[UAFESI][A-Z]')
    union select name, name from assets where name is not null
    union select name || '_C', name from assets where name is not null"""

_ORPHANS = f"""
    with class_keys as ({_CLASS_KEYS}),
    lost as (
        select distinct 'types' as ref_table, t.id as row_id, t.file_id, cast(null as bigint) as own, parent as reference from types t
        where parent <> '' and not exists (select 1 from types x where x.name = t.parent)
        union all
        select distinct 'members', m.id, m.file_id, null, cast(type_id as varchar) from members m
        where type_id is not null and not exists (select 1 from types x where x.id = m.type_id)
        union all
        select distinct 'assets', a.id, null, a.mtime, parent_class from assets a
        where parent_class <> '' and not exists (select 1 from class_keys c where c.k = a.parent_class)),
    dated as (
        select ref_table, row_id, reference, strftime(make_timestamp(coalesce(own, f.mtime) * 1000), '%Y-%m') as period
        from lost left join files f on f.id = lost.file_id)"""

_CHANGES = """
    with feed as (
        select replace(lower(path), chr(92), '/') as path_lower, session_no, event_seq, lower(op) as op, mtime, project
        from file_changes where path is not null),
    last as (
        select path_lower, max_by(op, (session_no, event_seq)) as op, max((session_no, event_seq)) as mark from feed group by 1)"""

_LINKS = f"""
    class_keys as ({_CLASS_KEYS}),
    links as (
        select distinct t.name as child, t.parent from types t
        where t.name is not null and t.parent <> '' and exists (select 1 from types x where x.name = t.parent)
        union
        select distinct a.name, c.name from assets a join class_keys c on c.k = a.parent_class
        where a.name is not null and a.parent_class <> ''),
    reach as (
        select child as a, parent as b from links
        union
        select r.a, l.parent from reach r join links l on l.child = r.b),
    cyclic as (select distinct a as node_name from reach where a = b)"""

ORACLE = {
    "p2_found": f"""
        with keyed as ({_KEYED}), total as (select field_name, count(*) as total from keyed group by 1)
        select k.field_name, key_value from keyed k join total t on t.field_name = k.field_name
        where key_value <> '' group by k.field_name, key_value, total having count(*) >= 0.05 * total""",
    "p2_key_figures": f"select field_name, key_value, count(*) as n_rows, min(id) as first_id, max(id) as last_id from ({_KEYED}) group by 1, 2",
    "p2_measures": """
        with m as (select distinct id, type_id, file_id from members),
        ft as (select f.project, f.module, t.name, t.parent from types t join files f on f.id = t.file_id),
        fm as (select f.project, f.module from m join files f on f.id = m.file_id),
        fields as (
            select 'files.project' as field_name, project as key_value, 0 as c, 1 as f, 0 as t, 0 as m from files
            union all select 'files.module', module, 0, 1, 0, 0 from files
            union all select 'files.project', project, 0, 0, 1, 0 from ft
            union all select 'files.module', module, 0, 0, 1, 0 from ft
            union all select 'files.project', project, 0, 0, 0, 1 from fm
            union all select 'files.module', module, 0, 0, 0, 1 from fm
            union all select 'files.project', project, count(distinct name), 0, 0, 0 from ft where parent <> '' group by project
            union all select 'files.module', module, count(distinct name), 0, 0, 0 from ft where parent <> '' group by module
            union all select 'types.parent', parent, count(distinct case when parent <> '' then name end), count(distinct file_id), count(*), 0 from types group by parent
            union all select 'types.parent', t.parent, 0, 0, 0, 1 from m join types t on t.id = m.type_id)
        select field_name, key_value, cast(sum(c) as bigint) as n_children, cast(sum(f) as bigint) as n_files, cast(sum(t) as bigint) as n_types, cast(sum(m) as bigint) as n_members
        from fields group by 1, 2""",
    "p3_found": f"{_ORPHANS} select ref_table, period, row_id from dated",
    "p3_report": f"{_ORPHANS} select ref_table, period, count(*) as n_orphans, count(distinct reference) as n_references from dated group by 1, 2",
    "p3_owner_references": " union all ".join(
        f"""select '{name}' as ref_table, '{match}' as match, count(*) as n_values, cast(coalesce(sum(n), 0) as bigint) as n_rows
            from (select {a}, {b}, count(*) as n from {rows} group by all) r where {lost}"""
        for name, a, b, rows, targets in (
            ("members", "type_id", "file_id", "(select distinct id, type_id, file_id from members)", "(select id as type_id, file_id from types)"),
            ("assets", "name", "parent", "(select name, parent_class as parent from assets)", "(select name, parent from types)"),
        )
        for match, lost in (
            ("simple", f"{a} is not null and {b} is not null and not exists (select 1 from {targets} t where t.{a} = r.{a} and t.{b} = r.{b})"),
            ("partial", f"""({a} is not null or {b} is not null) and not (
                case when {a} is null then exists (select 1 from {targets} t where t.{b} = r.{b})
                     when {b} is null then exists (select 1 from {targets} t where t.{a} = r.{a})
                     else exists (select 1 from {targets} t where t.{a} = r.{a} and t.{b} = r.{b}) end)"""),
            ("full", f"""({a} is not null or {b} is not null) and ({a} is null or {b} is null
                or not exists (select 1 from {targets} t where t.{a} = r.{a} and t.{b} = r.{b}))"""),
        )
    ),
    "p4_found": f"{_CHANGES} select path_lower, mark[1] as session_no, mark[2] as event_seq from last where op <> 'unlink'",
    "p4_state": f"""{_CHANGES},
        cleared as (select path_lower, max((session_no, event_seq)) as cut from feed where op = 'unlink' group by 1),
        wrote as (
            select f.path_lower, max_by(mtime, (session_no, event_seq)) as mtime from feed f left join cleared c on c.path_lower = f.path_lower
            where op <> 'unlink' and mtime is not null and (cut is null or (session_no, event_seq) > cut) group by 1),
        base as (select replace(lower(path), chr(92), '/') as path_lower, max(mtime) as mtime from files where path is not null group by 1)
        select coalesce(l.path_lower, b.path_lower) as path_lower, coalesce(op <> 'unlink', true) as present,
               coalesce(w.mtime, case when cut is null then b.mtime end) as mtime, mark[1] as session_no, mark[2] as event_seq
        from last l full join base b on b.path_lower = l.path_lower
        left join wrote w on w.path_lower = l.path_lower left join cleared c on c.path_lower = l.path_lower""",
    "p5_found": f"with recursive {_LINKS} select node_name from cyclic",
    "p5_hierarchy": f"""
        with recursive {_LINKS},
        names as (select name from types where name is not null union select name from assets where name is not null),
        tree as (
            select n.name, case when c.node_name is null then min(l.parent) end as parent, c.node_name is not null as on_cycle
            from names n left join links l on l.child = n.name left join cyclic c on c.node_name = n.name group by n.name, c.node_name),
        walk as (
            select name, parent, name as root, cast(0 as bigint) as depth, name as path, on_cycle from tree where parent is null
            union all
            select t.name, t.parent, w.root, w.depth + 1, w.path || ' > ' || t.name, t.on_cycle from tree t join walk w on w.name = t.parent),
        above as (
            select name, parent as top from tree where parent is not null
            union all
            select a.name, t.parent from above a join tree t on t.name = a.top where t.parent is not null)
        select w.name as node_name, parent as parent_name, root as root_name, depth, path,
               (select count(*) from above a where a.top = w.name) as n_descendants, on_cycle from walk w""",
    "p5_paths": f"""
        with recursive {_LINKS},
        names as (select name from types where name is not null union select name from assets where name is not null),
        walk as (
            select name, name as top, [name] as way from names
            union all
            select w.name, l.parent, list_prepend(l.parent, w.way) from walk w join links l on l.child = w.top where not list_contains(w.way, l.parent))
        select name as node_name, top as root_name, cast(len(way) - 1 as bigint) as depth, array_to_string(way, ' > ') as path from walk w
        where not exists (select 1 from links l where l.child = w.top and not list_contains(w.way, l.parent))""",
    "p5_counts": f"""
        with recursive {_LINKS},
        names as (select name from types where name is not null union select name from assets where name is not null)
        select n.name as node_name, count(r.a) as n_descendants from names n left join reach r on r.b = n.name group by n.name""",
    "p5_descendants": f"with recursive {_LINKS} select b as ancestor, a as node_name from reach",
}
