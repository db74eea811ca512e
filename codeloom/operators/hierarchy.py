"""Hierarchies from child-parent links: cycles, Euler tours, paths, depths, roots and descendants.

Names are nodes. Work is done on 64-bit hashes of the names, after a check that no two names share one (else another
seed is taken). Every loop below runs a number of rounds that grows with the logarithm of the depth, except the search
for strong components, which only sees the nodes with several parents that are left when all else is peeled or
contracted, and takes as many rounds as those lie apart.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.orphans import HEAVY_SHARE, asset_class_names
from codeloom.operators.skew import heavy_light_join, range_scan
from codeloom.session import Scratch

#: A round of peeling that removes less than this share of the links is the last: what then remains is mostly cycles
#: and long chains, which pointer jumping contracts in a logarithmic number of rounds.
PEEL_SHARE = 0.1

#: Links between nodes with several parents that one task may search for strong components. More are searched by all
#: tasks together, round by round, until no more than that are left; the components are the same either way.
TASK_LINKS = 500_000


def _resolve(pairs: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (child, parent) of distinct (child, ref) pairs, where ``keys`` (key, name) says what a ref finds."""
    pairs = scratch.save(pairs)
    limit = max(1, int(pairs.count() * HEAVY_SHARE))
    used = pairs.groupBy("ref").agg(F.count("*").alias("n"))
    found = scratch.save(used.join(keys.withColumnRenamed("key", "ref"), "ref"))
    heavy = [r[0] for r in found.where(F.col("n") > limit).select("ref").distinct().collect()]  # at most 1 / HEAVY_SHARE
    return heavy_light_join(pairs, found.select("ref", "name"), "ref", heavy).select("child", F.col("name").alias("parent"))


def name_links(types: DataFrame, assets: DataFrame, scratch: Scratch) -> DataFrame:
    """The distinct links between names, as ``child`` and ``parent``: each row of either table links its name to every
    name that its parent finds (see ``asset_class_names``). Null and empty references and null names link nothing."""
    pairs = types.select(F.col("name").alias("child"), F.col("parent").alias("ref")).where("child is not null and ref <> ''").distinct()
    declared = types.select("name").where("name is not null").distinct()
    own = _resolve(pairs, declared.select(F.col("name").alias("key"), "name"), scratch)
    pairs = assets.select(F.col("name").alias("child"), F.col("parent_class").alias("ref")).where("child is not null and ref <> ''").distinct()
    other = _resolve(pairs, asset_class_names(types, assets).distinct(), scratch)
    return scratch.save(own.unionByName(other).distinct())


def hash_seed(names: DataFrame) -> int:
    """The first seed under which no two distinct names (column ``name``) have the same 64-bit hash."""
    seed = 0
    while not names.groupBy(F.xxhash64("name", F.lit(seed)).alias("h")).agg(F.min("name").alias("a"), F.max("name").alias("b")).where("a <> b").isEmpty():
        seed += 1
    return seed


def _heavy(links: DataFrame, column: str, rows: int) -> list[int]:
    """The values of a column of links that stand on more than ``HEAVY_SHARE`` of them: at most its inverse."""
    limit = max(1, int(rows * HEAVY_SHARE))
    return [r[0] for r in links.groupBy(column).count().where(F.col("count") > limit).select(column).collect()]


def _peel(links: DataFrame, scratch: Scratch, share: float = PEEL_SHARE) -> DataFrame:
    """Takes away links from leaves and links to roots, round by round, while that removes at least a share of them. A round
    is one job: a link stays if its child has children and its parent has parents. Parents with very many children are
    looked for once; they are joined without a shuffle of their links."""
    links, found = scratch.measured(links, rows=F.count(F.lit(1)))
    heavy = _heavy(links, "p", found["rows"]) if found["rows"] else []
    while found["rows"]:
        inner = links.join(links.select(F.col("p").alias("c")).distinct(), "c", "left_semi")
        core, left = scratch.measured(heavy_light_join(inner, links.select(F.col("c").alias("p")).distinct(), "p", heavy, "left_semi"), rows=F.count(F.lit(1)))
        scratch.drop(links)
        links, before, found = core, found["rows"], left
        if before - found["rows"] < max(1, share * before):
            break
    return links


def _spread(edges: DataFrame, label: DataFrame, scratch: Scratch) -> DataFrame:
    """The largest label (n, l) that reaches each node along the edges (a, b): that of b is the largest of its own and of its
    sources'. A round passes on only the labels that changed in the one before."""
    state = label.withColumn("up", F.lit(True))
    while True:
        came = edges.join(state.where("up").select(F.col("n").alias("a"), "l"), "a").groupBy(F.col("b").alias("n")).agg(F.max("l").alias("m"))
        grown, found = scratch.measured(state.join(came, "n", "left").select("n", F.greatest("l", "m").alias("l"), F.coalesce(F.col("m") > F.col("l"), F.lit(False)).alias("up")), changed=F.count_if("up"))
        scratch.drop(state)
        state = grown
        if not found["changed"]:
            return state


def _reached(edges: DataFrame, start: int, scratch: Scratch) -> DataFrame:
    """The nodes ``n`` that can be reached from a node along the edges (a, b), itself included; only the newest are searched
    from in a round."""
    front = scratch.save(edges.sparkSession.createDataFrame([(start,)], "n long"))
    known = front
    while True:
        new, found = scratch.measured(edges.join(front.select(F.col("n").alias("a")), "a", "left_semi").select(F.col("b").alias("n")).distinct().join(known, "n", "left_anti"), rows=F.count(F.lit(1)))
        if not found["rows"]:
            return known
        known, front = scratch.save(known.unionByName(new)), new


def _components(batches: Iterable[pd.DataFrame]):
    """The strong components of two or more nodes among all links of a partition, by one depth-first search."""
    above: dict[int, list[int]] = {}
    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            above.setdefault(a, []).append(b)
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    open_nodes: list[int] = []
    is_open: set[int] = set()
    found: list[tuple[int, int]] = []
    for start in above:
        if start in number:
            continue
        path = [(start, iter(above[start]))]
        number[start] = low[start] = len(number)
        open_nodes.append(start)
        is_open.add(start)
        while path:
            node, rest = path[-1]
            for other in rest:
                if other not in number:
                    number[other] = low[other] = len(number)
                    open_nodes.append(other)
                    is_open.add(other)
                    path.append((other, iter(above.get(other, ()))))
                    break
                if other in is_open:
                    low[node] = min(low[node], number[other])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == number[node]:
                    members = []
                    while True:
                        members.append(open_nodes.pop())
                        is_open.discard(members[-1])
                        if members[-1] == node:
                            break
                    if len(members) > 1:
                        found.extend((m, node) for m in members)
    yield pd.DataFrame(found, columns=["n", "component"], dtype="int64")


def _around(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The strong component of the node with most ways through it (``n``, ``component``), and the links left between other
    nodes: those within what it reaches, within what reaches it, or within the rest, as no component lies across."""
    ways = edges.groupBy(F.col("a").alias("n")).agg(F.count("*").alias("o")).join(edges.groupBy(F.col("b").alias("n")).agg(F.count("*").alias("i")), "n")
    pivot = ways.orderBy((F.col("o") * F.col("i")).desc(), "n").limit(1).first()
    if pivot is None:
        return edges.sparkSession.createDataFrame([], "n long, component long"), edges.limit(0)
    down = _reached(edges, pivot["n"], scratch)
    up = _reached(edges.select(F.col("b").alias("a"), F.col("a").alias("b")), pivot["n"], scratch)
    side = down.withColumn("s", F.lit(1)).unionByName(up.withColumn("s", F.lit(2))).groupBy("n").agg(F.sum("s").alias("s"))
    side = scratch.save(side)
    part = side.where("s = 3").select("n", F.lit(pivot["n"]).alias("component"))
    both = edges.join(side.select(F.col("n").alias("a"), F.col("s").alias("sa")), "a", "left").join(side.select(F.col("n").alias("b"), F.col("s").alias("sb")), "b", "left")
    return part, both.where("coalesce(sa, 0) = coalesce(sb, 0) and coalesce(sa, 0) <> 3").select("a", "b")


def strong_components(edges: DataFrame, scratch: Scratch, task_links: int = TASK_LINKS) -> DataFrame:
    """Nodes of the strong components of two or more nodes: ``n`` and ``component``; ``edges`` (a, b) without loops.
    Up to ``task_links`` links are searched in one task, more as follows.

    Leaves and roots are peeled. The component of the node with most ways through it, mostly the largest, is what it
    reaches and is reached from. Of the rest each node takes the largest node that reaches it as colour; the nodes of a
    colour that reach back to its name are one component. What is found is taken out, links between colours (which lie on
    no cycle) too, and the rest goes again.
    """
    (edges, size), found = scratch.measured(edges.distinct(), rows=F.count(F.lit(1))), None
    while size["rows"] > task_links:
        edges = _peel(edges.select(F.col("a").alias("c"), F.col("b").alias("p")), scratch, share=0.0)
        part, rest = _around(edges.select(F.col("c").alias("a"), F.col("p").alias("b")), scratch)
        found = part if found is None else found.unionByName(part)
        edges = _peel(rest.select(F.col("a").alias("c"), F.col("b").alias("p")), scratch, share=0.0)
        edges, size = scratch.measured(edges.select(F.col("c").alias("a"), F.col("p").alias("b")), rows=F.count(F.lit(1)))
        if size["rows"] <= task_links:
            break
        nodes = edges.select(F.col("a").alias("n")).union(edges.select("b")).distinct()
        colour = _spread(edges, scratch.save(nodes.select("n", F.col("n").alias("l"))), scratch).select("n", "l")
        within = edges.join(colour.select(F.col("n").alias("a"), F.col("l").alias("ca")), "a").join(colour.select(F.col("n").alias("b"), F.col("l").alias("cb")), "b")
        within = scratch.save(within.where("ca = cb").select("a", "b"))
        start = scratch.save(colour.select("n", F.when(F.col("n") == F.col("l"), 1).otherwise(0).alias("l")))
        back = _spread(within.select(F.col("b").alias("a"), F.col("a").alias("b")), start, scratch)
        part = scratch.save(back.where("l = 1").join(colour.withColumnRenamed("l", "component"), "n").select("n", "component"))
        rest, size = scratch.measured(within.join(part.select(F.col("n").alias("a")), "a", "left_anti").join(part.select(F.col("n").alias("b")), "b", "left_anti"), rows=F.count(F.lit(1)))
        found = found.unionByName(part)
        edges = rest
    last = edges.repartition(1).mapInPandas(_components, "n long, component long")
    found = last if found is None else found.unionByName(last)
    # A colour's name that no other node reaches back to is alone and on no cycle.
    several = found.groupBy("component").agg(F.count("*").alias("k")).where("k > 1").select("component")
    return found.join(several, "component").select("n", "component")


def _jump(state: DataFrame, fields: dict[str, F.Column], active: F.Column) -> DataFrame:
    """One step of pointer jumping: each active row takes on what stands at its pointer. ``fields`` tells how, from its
    own columns and those of the row pointed to (prefix ``o_``); inactive rows stay."""
    names = state.columns
    other = state.select(*[F.col(c).alias(f"o_{c}") for c in names])
    moved = state.where(active).join(other, F.col("to") == F.col("o_n")).select(*[fields.get(c, F.col(c)).alias(c) for c in names])
    return state.where(~active).unionByName(moved)


def contract_chains(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pointer jumping over the nodes with one parent: ``(ends, loops)``.

    ``ends``: ``n``, ``to`` (the first node up from it that has no or several parents). ``loops``: the nodes ``n`` of
    cycles in which every node has one parent. ``links``: (c, p), distinct, without loops. After k rounds all nodes
    within 2^k of their end are done; a round that ends no node shows that the rest lead into cycles, and as soon as the
    set of nodes they point to no longer shrinks, the jump permutes that set: it is the cycles.
    """
    single = links.groupBy(F.col("c").alias("n")).agg(F.count("*").alias("k"), F.min("p").alias("to")).where("k = 1").select("n", "to")
    single = scratch.save(single)
    still = {"open": F.count_if(~F.col("done"))}
    state, now = scratch.measured(single.join(single.select(F.col("n").alias("to"), F.lit(True).alias("goes")), "to", "left").select("n", "to", F.col("goes").isNull().alias("done")), **still)
    scratch.drop(single)
    before, targets = None, None
    while now["open"]:
        if now == before:  # from here on only what leads into cycles is left
            seen = state.where("not done").agg(F.count_distinct("to")).first()[0]
            if seen == targets:
                break
            targets = seen
        before = now
        moved, now = scratch.measured(_jump(state, {"to": F.col("o_to"), "done": F.col("o_done")}, ~F.col("done")), **still)
        scratch.drop(state)
        state = moved
    return state.where("done").select("n", "to"), state.where("not done").select(F.col("to").alias("n")).distinct()


def euler_tour(forest: DataFrame, scratch: Scratch, names: bool = False) -> DataFrame:
    """Numbers the nodes of a forest in the order in which an Euler tour enters them.

    ``forest``: ``n`` (unique), ``p`` (parent, null for roots; must be some row's ``n``; no cycles), and ``name`` if
    ``names``. Returns ``n``, ``p``, ``root``, ``depth``, ``entry`` (0, 1, ...), ``leave`` (largest entry below it, so a
    is above b exactly if ``a.entry < b.entry <= a.leave``), and with names ``path`` (list of names from the root).

    The tour is a linked list; it is ranked by pointer jumping, in two passes of log2(depth) rounds each. The first
    gives depth, root and subtree sizes (a node passes on what it holds to its 2^k-th ancestor). A node is entered one
    step after its parent plus the sizes of the siblings before it: those weights come from an ordered scan that
    splits the children of a parent with very many, and the second pass ranks the list of weights up to the root.
    """
    state = scratch.save(forest.select("n", F.coalesce("p", "n").alias("to"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.lit(1).cast("long").alias("size"), F.col("p").isNull().alias("done")))
    step, far = 1, not forest.where("p is not null").isEmpty()
    while far:
        given = state.where(F.col("depth") == step).groupBy(F.col("to").alias("n")).agg(F.sum("size").alias("more"))
        moved = _jump(state, {"to": F.col("o_to"), "depth": F.col("depth") + F.col("o_depth"), "done": F.col("o_done"), "size": F.col("size")}, ~F.col("done"))
        moved = moved.join(given, "n", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).select("n", "to", "depth", "size", "done")
        moved, found = scratch.measured(moved, far=F.count_if(F.col("depth") == 2 * step))
        scratch.drop(state)
        state, step, far = moved, 2 * step, found["far"]
    kept = forest.select("n", "p", *(["name"] if names else []))
    sized = state.select("n", F.col("to").alias("root"), "depth", "size").join(kept, "n")
    scanned = scratch.save(range_scan(sized, ["p"], ["n"], scratch, sums=["size"]))
    weight = F.col("_sum_size") + F.when(F.col("p").isNull(), 0).otherwise(1)
    path = [F.array("name").alias("path")] if names else []
    still = {"open": F.count_if(~F.col("done"))}
    ranks, now = scratch.measured(scanned.select("n", F.coalesce("p", "n").alias("to"), weight.alias("entry"), F.col("p").isNull().alias("done"), *path), **still)
    fields = {"to": F.col("o_to"), "entry": F.col("entry") + F.col("o_entry"), "done": F.col("o_done")}
    if names:
        fields["path"] = F.concat("o_path", "path")
    while now["open"]:
        moved, now = scratch.measured(_jump(ranks, fields, ~F.col("done")), **still)
        scratch.drop(ranks)
        ranks = moved
    return scanned.select("n", "p", "root", "depth", "size").join(ranks.select("n", "entry", *(["path"] if names else [])), "n").select(
        "n", "p", "root", "depth", "entry", (F.col("entry") + F.col("size") - 1).alias("leave"), *(["path"] if names else [])
    )


def cycle_nodes(links: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes ``n`` that lie on a cycle of ``links`` (c, p: longs), each once.

    Leaves and roots are peeled; chains of nodes with one parent are contracted, which shows the cycles made of such
    nodes only; the others pass through nodes with several parents, and among these the strong components are found.
    A contracted link within a component stands for a chain: its nodes are the ancestors of the chain's lower end in the
    forest of chains, found by comparing the entry and exit numbers of an Euler tour with the lower ends' entries.
    """
    links = links.where("c is not null and p is not null")
    loops = scratch.save(links.where("c = p").select(F.col("c").alias("n")).distinct())
    core = _peel(scratch.save(links.where("c <> p").distinct()), scratch)
    ends, pure = contract_chains(core, scratch)
    ends, pure = scratch.save(ends), scratch.save(pure)
    found = loops.unionByName(pure)
    several = scratch.save(core.groupBy("c").agg(F.count("*").alias("k")).where("k > 1").select(F.col("c").alias("n")))
    up = core.join(several.select(F.col("n").alias("c")), "c", "left_semi").join(ends.select(F.col("n").alias("p"), "to"), "p", "left")
    up = scratch.save(up.select("c", "p", F.coalesce("to", "p").alias("q")).join(several.select(F.col("n").alias("q")), "q", "left_semi"))
    if up.isEmpty():
        return found.distinct()
    # A chain that ends in the node it began from is a cycle through one node with several parents.
    circles = scratch.save(up.where("c = q"))
    parts = scratch.save(strong_components(up.where("c <> q").select(F.col("c").alias("a"), F.col("q").alias("b")), scratch))
    both = up.join(parts.select(F.col("n").alias("c"), F.col("component").alias("k1")), "c").join(parts.select(F.col("n").alias("q"), F.col("component").alias("k2")), "q").where("k1 = k2")
    kept = scratch.save(both.select("c", "p", "q").unionByName(circles.select("c", "p", "q")).distinct())
    found = found.unionByName(kept.select(F.col("c").alias("n"))).unionByName(kept.select(F.col("q").alias("n")))
    seeds = scratch.save(kept.where("p <> q").select(F.col("p").alias("n")).distinct())
    if seeds.isEmpty():
        return found.distinct()
    single = core.join(ends.select(F.col("n").alias("c"), "to"), "c").join(kept.select(F.col("q").alias("to")).distinct(), "to", "left_semi")
    tops = single.select("to").distinct().select(F.col("to").alias("n"), F.lit(None).cast("long").alias("p"))
    tour = scratch.save(euler_tour(scratch.save(single.select(F.col("c").alias("n"), "p").unionByName(tops)), scratch))
    marked = tour.join(seeds.withColumn("seed", F.lit(1).cast("long")), "n", "left").select("n", "p", "entry", "leave", F.coalesce("seed", F.lit(0)).cast("long").alias("seed"))
    counted = scratch.save(range_scan(marked.withColumn("all", F.lit(0).cast("long")), ["all"], ["entry"], scratch, sums=["seed"]))
    upto = counted.select(F.col("entry").alias("leave"), (F.col("_sum_seed") + F.col("seed")).alias("upto"))
    chain = counted.where("p is not null").join(upto, "leave").where(F.col("upto") > F.col("_sum_seed")).select("n")
    return found.unionByName(chain).distinct()


def _ids(links: DataFrame, seed: int) -> DataFrame:
    return links.select(F.xxhash64("child", F.lit(seed)).alias("c"), F.xxhash64("parent", F.lit(seed)).alias("p"))


def names_on_cycles(types: DataFrame, assets: DataFrame) -> DataFrame:
    """The names that can be reached from themselves over one or more links, as ``node_name``, each once.

    Names that only lead to a cycle or lie between two are not among them. Null and empty references link nothing;
    empty tables give an empty result; repeated rows and extra columns change nothing.
    """
    scratch = Scratch(types.sparkSession, "cycles")
    links = name_links(types, assets, scratch)
    seed = hash_seed(links.select(F.col("child").alias("name")).union(links.select("parent")))
    found = cycle_nodes(_ids(links, seed), scratch)
    names = links.select("child", F.xxhash64("child", F.lit(seed)).alias("n")).distinct()
    return names.join(found, "n", "left_semi").select(F.col("child").alias("node_name"))


def hierarchy(types: DataFrame, assets: DataFrame) -> DataFrame:
    """Every name of ``types`` and ``assets`` with its place in the hierarchy.

    Columns: ``node_name``, ``parent_name``, ``root_name``, ``depth`` (links to the root), ``path`` (names from the root,
    joined by `` > ``), ``entry`` and ``leave`` (Euler tour: the descendants of a name are the names with
    ``entry < x <= leave``), ``n_descendants``, ``on_cycle``. A name with several parents hangs under the smallest of
    them (by bytes); the others are still links for ``on_cycle``. The tree is cut above a name on a cycle, which is the
    root of what hangs below it. ``entry``, ``leave`` and ``n_descendants`` are those of this tree; over all links, see
    ``all_descendants`` and ``all_paths``. A name without links is a root. Null names are left out; empty tables give no rows.
    """
    scratch = Scratch(types.sparkSession, "hierarchy")
    links = name_links(types, assets, scratch)
    every = types.select("name").union(assets.select("name")).where("name is not null").distinct()
    seed = hash_seed(every)
    every = scratch.save(every.select(F.xxhash64("name", F.lit(seed)).alias("n"), "name"))
    cycle = scratch.save(cycle_nodes(_ids(links, seed), scratch))
    first = links.groupBy(F.xxhash64("child", F.lit(seed)).alias("n")).agg(F.min("parent").alias("parent"))
    tree = first.join(cycle, "n", "left_anti").select("n", F.xxhash64("parent", F.lit(seed)).alias("p"), "parent")
    forest = scratch.save(every.join(tree, "n", "left"))
    tour = euler_tour(forest, scratch, names=True)
    out = tour.join(cycle.withColumn("on_cycle", F.lit(True)), "n", "left")
    return out.select(
        F.element_at("path", -1).alias("node_name"),
        F.when(F.size("path") > 1, F.element_at("path", -2)).alias("parent_name"),
        F.element_at("path", 1).alias("root_name"),
        "depth",
        F.array_join("path", " > ").alias("path"),
        "entry",
        "leave",
        (F.col("leave") - F.col("entry")).alias("n_descendants"),
        F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"),
    )


def descendants(tour: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs (``ancestor``, ``node_name``) for the given ``names`` (column ``ancestor``) from a ``hierarchy`` result.

    An interval is cut into blocks of equal length so that the search is an equality join on the block with the
    interval test as residue; a long interval meets each node of it once.
    """
    width = 4096
    spans = tour.join(names.select(F.col("ancestor").alias("node_name")).distinct(), "node_name").where("leave > entry")
    spans = spans.select(F.col("node_name").alias("ancestor"), F.col("entry").alias("lo"), F.col("leave").alias("hi"))
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    nodes = tour.select("node_name", "entry", F.floor(F.col("entry") / width).alias("block"))
    return nodes.join(spans, "block").where("entry > lo and entry <= hi").select("ancestor", "node_name")


def _segments(links: DataFrame, every: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(segments, hops)`` of the links (c, p), distinct, without loops, over the nodes ``every`` (n, name).

    The links above names with several parents and above names on a cycle without such names are taken out; what is left
    is a forest in which every link is a name's only one. ``segments``: ``n``, ``home`` (its root there), ``path`` (names
    from the home). ``hops``: the links taken out, (c, p): each leads from a home to some node. A walk up visits a tree
    of the forest down from its home only, so that trees are met as a whole or not at all.
    """
    _, rings = contract_chains(links, scratch)
    several = links.groupBy(F.col("c").alias("n")).agg(F.count("*").alias("k")).where("k > 1").select("n")
    cut = scratch.save(several.unionByName(rings).distinct())
    hops = scratch.save(links.join(cut.select(F.col("n").alias("c")), "c", "left_semi"))
    kept = links.join(cut.select(F.col("n").alias("c")), "c", "left_anti").select(F.col("c").alias("n"), "p")
    begun = every.join(kept, "n", "left").select("n", F.coalesce("p", "n").alias("to"), F.col("p").isNull().alias("done"), F.array("name").alias("path"))
    still = {"open": F.count_if(~F.col("done"))}
    state, now = scratch.measured(begun, **still)
    while now["open"]:
        moved, now = scratch.measured(_jump(state, {"to": F.col("o_to"), "done": F.col("o_done"), "path": F.concat("o_path", "path")}, ~F.col("done")), **still)
        scratch.drop(state)
        state = moved
    return state.select("n", F.col("to").alias("home"), "path"), hops


def _all_links(types: DataFrame, assets: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All names (n, name), the links between different names (c, p), and the nodes ``n`` linked to themselves."""
    links = name_links(types, assets, scratch)
    every = types.select("name").union(assets.select("name")).where("name is not null").distinct()
    seed = hash_seed(every)
    ids = _ids(links, seed)
    every = scratch.save(every.select(F.xxhash64("name", F.lit(seed)).alias("n"), "name"))
    return every, scratch.save(ids.where("c <> p")), scratch.save(ids.where("c = p").select(F.col("c").alias("n")))


def all_descendants(types: DataFrame, assets: DataFrame) -> DataFrame:
    """The pairs (``ancestor``, ``node_name``), each once, of names where the first can be reached from the second over one
    or more links. All links count, those to second parents and those on cycles too; a name on a cycle is its own
    descendant. Null names are left out; empty tables give no rows.

    A name's ancestors are those on its segment and all that can be reached from its home. The latter are gathered per
    home that has links: the closure over homes doubles its reach in each round, and every pair in it is one of the result.
    """
    scratch = Scratch(types.sparkSession, "descendants")
    every, links, loops = _all_links(types, assets, scratch)
    segments, hops = _segments(links, every, scratch)
    first = scratch.save(hops.join(segments.select(F.col("n").alias("p"), "home", "path"), "p"))
    up = first.select(F.col("c").alias("a"), F.col("home").alias("b")).union(hops.select("c", "c")).distinct()
    up, size = scratch.measured(up, rows=F.count(F.lit(1)))
    while True:
        twice = up.join(up.select(F.col("a").alias("b"), F.col("b").alias("to")), "b").select("a", F.col("to").alias("b")).distinct()
        grown, found = scratch.measured(up.union(twice).distinct(), rows=F.count(F.lit(1)))
        scratch.drop(up)
        up, before, size = grown, size, found
        if size == before:
            break
    above = first.select(F.col("c").alias("b"), F.explode("path").alias("ancestor")).distinct()
    over = scratch.save(up.join(above, "b").select(F.col("a").alias("home"), "ancestor").distinct())
    own = segments.select(F.explode(F.expr("slice(path, 1, size(path) - 1)")).alias("ancestor"), F.element_at("path", -1).alias("node_name"))
    far = segments.select("home", F.element_at("path", -1).alias("node_name")).join(over, "home").select("ancestor", "node_name")
    itself = every.join(loops, "n", "left_semi").select(F.col("name").alias("ancestor"), F.col("name").alias("node_name"))
    return own.unionByName(far).unionByName(itself).distinct()


def descendant_counts(types: DataFrame, assets: DataFrame) -> DataFrame:
    """``n_descendants`` of every name (``node_name``) over all links, by ``all_descendants``; 0 where there is none."""
    every = types.select("name").union(assets.select("name")).where("name is not null").distinct()
    below = all_descendants(types, assets).groupBy(F.col("ancestor").alias("name")).agg(F.count("*").alias("n"))
    return every.join(below, "name", "left").select(F.col("name").alias("node_name"), F.coalesce("n", F.lit(0)).alias("n_descendants"))


def all_paths(types: DataFrame, assets: DataFrame) -> DataFrame:
    """Every way up from every name, over all links: ``node_name``, ``root_name``, ``depth`` (links of the way) and ``path``
    (names from the root, joined by `` > ``).

    A way meets no name twice and goes on as long as a link leads to a name that is not on it; so its root is a name
    without links, or one whose links all lead back to the way. Names with several parents have a row for each way,
    whose number may grow with the product of the choices on it. Null names are left out; empty tables give no rows.

    All ways grow by a whole segment in a round, so there are as many rounds as links to second parents or on cycles
    lie on one way. Where a segment meets the way, the way takes what is below and ends there.
    """
    scratch = Scratch(types.sparkSession, "paths")
    every, links, _ = _all_links(types, assets, scratch)
    segments, hops = _segments(links, every, scratch)
    homes = hops.select(F.col("c").alias("home"), F.lit(True).alias("goes")).distinct()
    segments = scratch.save(segments.join(homes, "home", "left").withColumn("goes", F.coalesce("goes", F.lit(False))))
    over = hops.join(segments.select(F.col("n").alias("p"), F.col("home").alias("next"), F.col("path").alias("more"), F.col("goes").alias("on")), "p")
    over = scratch.save(over.select(F.col("c").alias("home"), "next", "more", "on"))
    done = segments.where("not goes").select("path")
    way, found = scratch.measured(segments.where("goes").select("home", "path"), rows=F.count(F.lit(1)))
    while found["rows"]:
        tried = way.join(over, "home").withColumn("new", F.array_except("more", "path")).where("size(new) > 0")
        grown = scratch.save(tried.select(F.col("path").alias("old"), F.concat("new", "path").alias("path"), F.col("next").alias("home"), (F.col("on") & (F.size("new") == F.size("more"))).alias("goes")))
        ended = scratch.save(way.join(grown.select(F.col("old").alias("path")).distinct(), "path", "left_anti").select("path"))
        done = done.unionByName(ended).unionByName(grown.where("not goes").select("path"))
        way, found = scratch.measured(grown.where("goes").select("home", "path"), rows=F.count(F.lit(1)))
    return done.select(
        F.element_at("path", -1).alias("node_name"),
        F.element_at("path", 1).alias("root_name"),
        (F.size("path") - 1).cast("long").alias("depth"),
        F.array_join("path", " > ").alias("path"),
    )
