import random

import pytest

from codeloom.operators import closure as C
from codeloom.operators import hierarchy as H
from codeloom.plans.core_problems import QUERIES
from codeloom.session import Scratch
from tests.conftest import ASSETS, TYPES, make_assets, make_types


def reach(links):
    below = {}
    for a, b in links:
        below.setdefault(a, set()).add(b)
    out = {}
    for n in {x for l in links for x in l}:
        seen, todo = set(), list(below.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo.extend(below.get(x, ()))
        out[n] = seen
    return out


def random_links(seed):
    rng = random.Random(seed)
    n = rng.randint(5, 60)
    links = {(i, rng.randint(max(0, i - 6), i - 1)) for i in range(1, n) if rng.random() < 0.85}
    links |= {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 12))}
    links |= {(1000 + i, 1001 + i) for i in range(40)} | {(1040, 1000 + rng.randint(0, 39))}  # a long way into a cycle
    return sorted(links)


@pytest.mark.parametrize("seed", range(4))
def test_cycles_agree_with_brute_force(spark, seed):
    links = random_links(seed)
    want = sorted(n for n, r in reach(links).items() if n in r)
    got = sorted(r.n for r in H.cycle_nodes(spark.createDataFrame(links, "c long, p long"), Scratch(spark)).collect())
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_components_are_the_same_in_one_task_and_in_all(spark, seed):
    rng = random.Random(seed)
    links = sorted({(a, b) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(34)) if a != b})
    up = reach(links)
    want = {frozenset(m for m in up[n] if n in up[m]) for n in up if n in up[n]}
    for at_once in (0, 10, 1000):
        groups = {}
        for r in H.strong_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark), at_once).collect():
            groups.setdefault(r.component, set()).add(r.n)
        assert {frozenset(g) for g in groups.values()} == want


def test_between_two_cycles_is_not_on_one(spark):
    links = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7), (7, 3), (5, 8), (9, 10), (9, 11), (10, 12), (11, 12), (12, 9)]
    got = sorted(r.n for r in H.cycle_nodes(spark.createDataFrame(links, "c long, p long"), Scratch(spark)).collect())
    assert got == [1, 2, 4, 5, 7, 9, 10, 11, 12]


def test_euler_tour(spark):
    rng = random.Random(5)
    parent = {0: None, 100: None} | {i: rng.choice([0, 0, 0, i - 1]) for i in range(1, 60)}
    tour = {r.n: r for r in H.euler_tour(spark.createDataFrame(list(parent.items()), "n long, p long"), Scratch(spark)).collect()}
    assert sorted(r.entry for r in tour.values()) == list(range(len(parent)))

    def line(n):
        return [] if parent[n] is None else [parent[n], *line(parent[n])]

    for n in parent:
        assert tour[n].depth == len(line(n)) and tour[n].root == (line(n) or [n])[-1]
        inside = {m for m in parent if tour[n].entry < tour[m].entry <= tour[n].leave}
        assert inside == {m for m in parent if n in line(m)}


def test_hierarchy(spark):
    types = make_types(
        spark, (1, 1, "UBase", "class", None, 1), (2, 1, "UChild", "class", "UBase", 1), (3, 1, "UChild", "class", "UBase", 9), (4, 1, "UDeep", "class", "UChild", 1),
        (5, 1, "UX", "class", "UY", 1), (6, 1, "UY", "class", "UX", 1), (7, 1, "UBelow", "class", "UX", 1), (8, 1, "ULost", "class", "UNone", 1), (9, 1, "UTwo", "class", "UDeep", 1), (10, 1, "UTwo", "struct", "UBase", 1), (11, 1, None, "class", "UBase", 1),
    )
    assets = make_assets(spark, (1, "BP_A", "X", "Deep"), (2, "BP_B", None, "BP_A_C"))
    rows = {r.node_name: r for r in H.hierarchy(types, assets).collect()}
    assert rows["BP_B"].path == "UBase > UChild > UDeep > BP_A > BP_B" and rows["BP_B"].depth == 4 and rows["BP_B"].root_name == "UBase"
    assert rows["UTwo"].parent_name == "UBase" and rows["UBase"].n_descendants == 5
    assert rows["UX"].on_cycle and rows["UX"].parent_name is None and rows["UBelow"].root_name == "UX" and not rows["UBelow"].on_cycle
    assert rows["ULost"].depth == 0 and None not in rows
    tour = H.hierarchy(types, assets)
    pairs = {tuple(r) for r in H.descendants(tour, spark.createDataFrame([("UDeep",), ("UX",), ("nobody",)], "ancestor string")).collect()}
    assert pairs == {("UDeep", "BP_A"), ("UDeep", "BP_B"), ("UX", "UBelow")}
    assert sorted(r.node_name for r in H.names_on_cycles(types, assets).collect()) == ["UX", "UY"]


def ways(up, way):
    more = [w for p in up.get(way[0], ()) if p not in way for w in ways(up, (p, *way))]
    return more or [way]


@pytest.mark.parametrize("seed", range(2))
def test_second_parents_and_links_on_cycles_count(spark, seed):
    rng = random.Random(seed)
    links = {(i, rng.randint(max(0, i - 4), i - 1)) for i in range(1, 25)} | {(rng.randrange(25), rng.randrange(25)) for _ in range(6)}
    links |= {(30, 31), (31, 32), (32, 30), (33, 31), (34, 34), (40, 41), (41, 42), (42, 40), (40, 43), (44, 41)}  # rings alone and with a second parent
    names = {x for link in links for x in link}
    types = make_types(spark, *[(i, 1, f"N{c}", "class", None if p is None else f"N{p}", 1) for i, (c, p) in enumerate([*sorted(links), *((n, None) for n in sorted(names))])])
    assets = spark.createDataFrame([], ASSETS)
    above, up = reach(sorted(links)), {}
    for c, p in links:
        up.setdefault(c, set()).add(p)
    want = {(f"N{a}", f"N{n}") for n, found in above.items() for a in found}
    counts = {r.node_name: r.n_descendants for r in H.descendant_counts(types, assets).collect()}
    assert counts == {f"N{n}": sum(a == f"N{n}" for a, _ in want) for n in names}
    got = sorted(r.path for r in H.all_paths(types, assets).collect())
    assert got == sorted(" > ".join(f"N{x}" for x in w) for n in names for w in ways(up, (n,)))


def test_query_names_the_descendants(spark, tmp_path):
    make_types(spark, (1, 1, "UA", "class", None, 1), (2, 1, "UB", "class", "UA", 1), (3, 1, "UC", "class", "UB", 1), (4, 1, "UC", "class", "UZ", 1), (5, 1, "UZ", "class", "UZ", 1)).write.parquet(f"{tmp_path}/types.parquet")
    make_assets(spark, (1, "BP_A", "X", "C")).write.parquet(f"{tmp_path}/assets.parquet")
    got = sorted(map(tuple, QUERIES["p5_descendants"](spark, str(tmp_path)).collect()))
    assert got == [("UA", "BP_A"), ("UA", "UB"), ("UA", "UC"), ("UB", "BP_A"), ("UB", "UC"), ("UC", "BP_A"), ("UZ", "BP_A"), ("UZ", "UC"), ("UZ", "UZ")]


def test_empty(spark):
    types, assets = spark.createDataFrame([], TYPES), spark.createDataFrame([], ASSETS)
    assert H.names_on_cycles(types, assets).collect() == []
    assert H.hierarchy(types, assets).collect() == []
    assert C.depths(types).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_closure_agrees_with_brute_force(spark, seed):
    links = random_links(seed)
    up = reach(links)
    start = {links[3][1], links[-1][1]}
    frame = spark.createDataFrame([(str(a), str(b)) for a, b in links], "child string, parent string")
    got = {r.name for r in C.descendants(frame, spark.createDataFrame([(str(s),) for s in start], "name string")).collect()}
    assert got == {str(n) for n, above in up.items() if above & start}
    one = links[len(links) // 2][0]
    assert {r.name for r in C.ancestors(frame, str(one)).collect()} == {str(x) for x in up[one]}


def test_depths(spark):
    types = make_types(spark, (1, 1, "UA", "class", None, 1), (2, 1, "UB", "class", "UA", 1), (3, 1, "UC", "class", "UB", 1), (4, 1, "UD", "class", "UC", 1), (5, 1, "UD", "class", "UA", 1), (6, 1, "UE", "class", "UD", 1), (7, 1, "UF", "class", "UG", 1), (8, 1, "UG", "class", "UF", 1))
    assert {r.name: r.depth for r in C.depths(types).collect()} == {"UA": 0, "UB": 1, "UC": 2, "UD": 1, "UE": 2, "UF": None, "UG": None}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_by_rounds_only(spark, seed):
    """With no link left to one task: several components of different sizes, chains between them, and links to nowhere."""
    rng = random.Random(seed)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(55)} | {(100, 101), (101, 102), (102, 100), (102, 110), (110, 111), (111, 110), (111, 120)}
    edges = sorted((a, b) for a, b in edges if a != b)
    reached = reach(edges)
    want = {frozenset(b for b in reached[a] if a in reached[b]) for a in reached if a in reached[a]}
    got = {}
    for r in H.strong_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), 0).collect():
        got.setdefault(r.component, set()).add(r.n)
    assert {frozenset(v) for v in got.values()} == want
