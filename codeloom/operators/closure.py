"""Descendants, ancestors and depths in the inheritance graph of names.

A walk that goes one level per job takes as many jobs as the longest line of descent has steps. Here lines of nodes
with a single parent are contracted by pointer jumping first (a logarithmic number of rounds), and only the few nodes
with several parents that are left are walked level by level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import strip_strict
from codeloom.operators.hierarchy import _jump, hash_seed
from codeloom.session import Scratch

INHERITING = ("class", "struct", "interface")


def inheritance(types: DataFrame, assets: DataFrame | None) -> DataFrame:
    """The distinct links (child, parent) by name: classes, structs and interfaces, and assets with a class. An asset's
    parent class is also found under the name that has a prefix letter before it."""
    own = types.where(F.col("kind").isin(*INHERITING)).select(F.col("name").alias("child"), "parent").where("child is not null and parent <> ''")
    if assets is None:
        return own.distinct()
    below = assets.where("asset_class is not null").select(F.col("name").alias("child"), F.col("parent_class").alias("parent")).where("child is not null and parent <> ''").distinct()
    prefixed = types.where(F.col("kind").isin(*INHERITING) & F.col("name").rlike("^[UAFESI][A-Z]")).select("name", strip_strict(F.col("name")).alias("parent")).distinct()
    return own.union(below).union(below.join(prefixed, "parent").select("child", F.col("name").alias("parent"))).distinct()


def _contract(links: DataFrame, scratch: Scratch) -> DataFrame:
    """For each node with one parent the first node up from it that has none or several: ``n``, ``to``, ``hops``.
    Nodes that lead into a cycle of such nodes have no row. ``links``: (c, p), distinct."""
    single = scratch.save(links.groupBy(F.col("c").alias("n")).agg(F.count("*").alias("k"), F.min("p").alias("to")).where("k = 1").select("n", "to"))
    known = single.select(F.col("n").alias("to"), F.lit(True).alias("goes"))
    still = {"open": F.count_if(~F.col("done"))}
    state, now = scratch.measured(single.join(known, "to", "left").select("n", "to", F.lit(1).cast("long").alias("hops"), F.col("goes").isNull().alias("done")), **still)
    before = None
    while now["open"] and now != before:
        before = now
        moved, now = scratch.measured(_jump(state, {"to": F.col("o_to"), "hops": F.col("hops") + F.col("o_hops"), "done": F.col("o_done")}, ~F.col("done")), **still)
        scratch.drop(state)
        state = moved
    return state.where("done").drop("done")


def _several(links: DataFrame, ends: DataFrame, scratch: Scratch) -> DataFrame:
    """The links of nodes with several parents, each to where its chain ends: ``c``, ``q``, ``hops``."""
    many = links.groupBy("c").agg(F.count("*").alias("k")).where("k > 1").select("c")
    up = links.join(many, "c", "left_semi").join(ends.select(F.col("n").alias("p"), "to", "hops"), "p", "left")
    return scratch.save(up.select("c", F.coalesce("to", "p").alias("q"), (F.coalesce("hops", F.lit(0)) + 1).alias("hops")))


def descendants(links: DataFrame, starts: DataFrame) -> DataFrame:
    """The names (``name``) below any of ``starts`` (``name``), over one or more links (child, parent). A start is among
    them only if it lies below a start itself, as on a cycle. An unknown start has none."""
    scratch = Scratch(links.sparkSession, "descendants")
    links = scratch.save(links)
    both = links.select(F.col("child").alias("name")).union(links.select("parent")).union(starts.select("name"))
    seed = hash_seed(both)
    h = lambda c: F.xxhash64(c, F.lit(seed))
    ids = scratch.save(links.select(h("child").alias("c"), h("parent").alias("p")))
    begin = scratch.save(starts.where("name is not null").select(h("name").alias("q")).distinct())
    # A start is the end of the chains below it: its own links up are set aside until the end.
    open_links = scratch.save(ids.join(begin.select(F.col("q").alias("c")), "c", "left_anti"))
    ends = scratch.save(_contract(open_links, scratch))
    up = _several(open_links, ends, scratch)
    reached, front = begin, begin
    while True:
        new, found = scratch.measured(up.join(front, "q", "left_semi").select(F.col("c").alias("q")).distinct().join(reached, "q", "left_anti"), rows=F.count(F.lit(1)))
        if not found["rows"]:
            break
        reached, front = reached.union(new), new
    reached = scratch.save(reached)
    below = ends.join(reached.select(F.col("q").alias("to")), "to", "left_semi").select("n")
    below = scratch.save(below.union(reached.join(begin, "q", "left_anti")).distinct())
    own = ids.join(begin.select(F.col("q").alias("c")), "c", "left_semi")
    above = below.select(F.col("n").alias("p")).union(begin)
    found = below.union(own.join(above, "p", "left_semi").select("c")).distinct()
    return links.select(F.col("child").alias("name")).distinct().join(found, h("name") == F.col("n"), "left_semi")


def ancestors(links: DataFrame, name: str) -> DataFrame:
    """The names above a name, over one or more links: the descendants in the graph turned round."""
    start = links.sparkSession.createDataFrame([(name,)], "name string")
    return descendants(links.select(F.col("parent").alias("child"), F.col("child").alias("parent")), start)


def is_descendant(links: DataFrame, name: str, base: str) -> DataFrame:
    """One row, ``answer``: whether ``name`` lies below ``base``."""
    return ancestors(links, name).agg((F.count_if(F.col("name") == base) > 0).alias("answer"))


def depths(types: DataFrame) -> DataFrame:
    """``name`` and ``depth`` of every type name: the least number of links to a name none of whose declarations has a
    known parent. Names that only cycles lead to have a null depth. Null names are left out."""
    scratch = Scratch(types.sparkSession, "depths")
    names = types.select("name").where("name is not null").distinct()
    pairs = types.select(F.col("name").alias("child"), "parent").where("child is not null and parent <> ''").distinct()
    links = scratch.save(pairs.join(names.select(F.col("name").alias("parent")), "parent", "left_semi").select("child", "parent"))
    seed = hash_seed(names)
    h = lambda c: F.xxhash64(c, F.lit(seed))
    ids = scratch.save(links.select(h("child").alias("c"), h("parent").alias("p")))
    ends = scratch.save(_contract(ids, scratch))
    up = _several(ids, ends, scratch)
    nodes = scratch.save(names.select("name", h("name").alias("n")))
    roots = nodes.join(ids.select(F.col("c").alias("n")), "n", "left_anti").select("n", F.lit(0).cast("long").alias("d"))
    known = scratch.save(roots)
    while True:
        offers = up.join(known.select(F.col("n").alias("q"), "d"), "q").groupBy(F.col("c").alias("n")).agg(F.min(F.col("hops") + F.col("d")).alias("e"))
        both, found = scratch.measured(known.join(offers, "n", "full_outer").select("n", F.least("d", "e").alias("d"), (F.col("d").isNull() | (F.col("e") < F.col("d"))).alias("up")), better=F.count_if("up"))
        known = both.select("n", "d")
        if not found["better"]:
            break
    chain = ends.join(known.select(F.col("n").alias("to"), "d"), "to").select("n", (F.col("hops") + F.col("d")).alias("d"))
    return nodes.join(known.union(chain), "n", "left").select("name", F.col("d").alias("depth"))


def children(types: DataFrame, files: DataFrame, assets: DataFrame, parent: str, recursive: bool = True, project: str | None = None, language: str | None = None, limit: int = 50) -> DataFrame:
    """Types and assets below a parent: ``rank``, ``name``, ``kind``, ``parent``, ``path``, ``project``, ``truncated``,
    ``total`` and ``parent_found``. ``truncated`` is true as soon as the limit is reached. The filters choose among what
    was found; the search itself passes over every project and language. Types come before assets, each by id."""
    from codeloom.operators.symbols import chosen

    spark = types.sparkSession
    start = spark.createDataFrame([(parent,)], "name string")
    if recursive:
        family = descendants(inheritance(types, assets), start)
        own = types.where(F.col("kind").isin(*INHERITING)).join(family, "name", "left_semi")
        made = assets.where("asset_class is not null").join(family, "name", "left_semi")
    else:
        own = types.where(F.col("parent") == parent)
        bare = parent[1:] if len(parent) > 1 and parent[0] in "UAFESI" and parent[1].isascii() and parent[1].isupper() else parent
        made = assets.where(F.col("asset_class").isNotNull() & F.col("parent_class").isin(parent, bare))
    where = chosen(files.select(F.col("id").alias("file_id"), "path", "project", "language"), project=project, language=None if language == "blueprint" else language)
    parts = []
    if language in (None, "all") or language != "blueprint":
        parts.append(own.join(where, "file_id").select(F.lit(0).alias("is_asset"), "id", "name", "kind", "parent", "path", "project"))
    if language in (None, "all", "blueprint"):
        parts.append(chosen(made, project=project).select(F.lit(1).alias("is_asset"), "id", "name", F.lit("class").alias("kind"), F.col("parent_class").alias("parent"), F.col("content_path").alias("path"), "project"))
    rows = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    from pyspark.sql import Window

    rows = Scratch(spark, "children").save(rows)
    total = rows.agg(F.count("*").alias("total"))
    known = types.where(F.col("name") == parent).select(F.lit(1).alias("k")).union(assets.where(F.col("name") == parent).select(F.lit(1))).agg((F.count("*") > 0).alias("parent_found"))
    first = rows.orderBy("is_asset", "id").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy("is_asset", "id")))
    return first.join(F.broadcast(total)).join(F.broadcast(known)).select("rank", "name", "kind", "parent", "path", "project", (F.col("total") >= limit).alias("truncated"), "total", "parent_found")
