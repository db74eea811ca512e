import math
import random
from collections import Counter, defaultdict

import pytest

from codeloom.llm.packing import best_fit, fill, pack, plan_containers
from codeloom.session import Scratch


def loads(plan, counts):
    by_size = defaultdict(list)
    for row in plan:
        by_size[row[0]].append(row)
    load, placed = Counter(), Counter()
    for size, rows in by_size.items():
        rows.sort(key=lambda r: r[1])
        for (_, begin, each, first), end in zip(rows, [r[1] for r in rows[1:]] + [counts[size]]):
            for rank in range(begin, end):
                load[first + (rank - begin) // each] += size
                placed[size] += 1
    return load, placed


def one_by_one(capacity, sizes):
    """Best-fit decreasing, an item at a time."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 256])
    sizes = [rng.randint(1, capacity if rng.random() < 0.3 else max(1, capacity // 3)) for _ in range(rng.randint(1, 400))]
    counts = Counter(sizes)
    load, placed = loads(best_fit(capacity, list(counts.items())), counts)
    assert placed == counts and max(load.values()) <= capacity
    assert len(load) == one_by_one(capacity, sizes)


def test_sizes_of_zero():
    assert best_fit(10, [(0, 5)]) == [(0, 0, 5, 0)]
    load, placed = loads(best_fit(10, [(0, 5), (10, 2)]), Counter({0: 5, 10: 2}))
    assert placed == {0: 5, 10: 2} and len(load) == 2


@pytest.mark.parametrize("runs", [1, 5, 1000])
def test_plan_in_rounds(spark, runs):
    """However many ranges sweep: every text is placed once, no container overflows, and few are more than by one sweep."""
    rng = random.Random(runs)
    counts = {b: Counter(rng.randint(0, c if rng.random() < 0.2 else max(1, c // 4)) for _ in range(3000)) for b, c in ((1, 12), (2, 40))}
    rows = [(b, {1: 12, 2: 40}[b], s, n) for b, sizes in counts.items() for s, n in sizes.items()]
    frame = spark.createDataFrame(rows, "budget_id int, capacity long, size long, n long")
    got = defaultdict(list)
    for r in plan_containers(frame, Scratch(spark, "test"), runs).collect():
        got[r.budget_id].append((r.size, r.rank_from, r.per_container, r.container_from))
    for b, c in ((1, 12), (2, 40)):
        load, placed = loads(got[b], counts[b])
        assert placed == counts[b] and max(load.values()) <= c
        assert len(load) <= 1.01 * one_by_one(c, [s for s, n in counts[b].items() for _ in range(n) if s]) + 1
        assert sorted(load) == list(range(len(load)))


@pytest.mark.parametrize("runs", [2, 1000])
def test_pack(spark, runs):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 30, 100, 101, 350, None, 100])) for i in range(300)] + [(7, 42), (7, 42), (None, 5)]
    budgets = spark.createDataFrame([(1, "a", 100), (2, "b", 1000), (3, "c", None), (4, "d", 0)], "budget_id int, budget_name string, capacity int")
    frame = spark.createDataFrame(rows, "doc_id long, n_tokens long").selectExpr("*", "9 as size", "8 as capacity")
    packed = pack(frame, budgets, runs)
    got = packed.collect()
    want = Counter()
    for b, c in ((1, 100), (2, 1000)):
        for i, n in rows:
            n = n or 0
            for piece in range(max(1, math.ceil(n / c))):
                want[b, i, piece, min(c, n - piece * c)] += 1
    assert Counter((r.budget_id, r.doc_id, r.piece_no, r.n_tokens) for r in got) == want
    load = Counter()
    for r in got:
        load[r.budget_id, r.container_id] += r.n_tokens
        assert r.token_from == r.piece_no * {1: 100, 2: 1000}[r.budget_id]
    assert all(v <= {1: 100, 2: 1000}[b] for (b, _), v in load.items())
    for r in fill(packed, budgets).collect():
        own = [v for (b, _), v in load.items() if b == r.budget_id]
        assert (r.n_containers, r.n_tokens, r.fullest) == (len(own), sum(own), max(own)) and r.least_containers <= r.n_containers


def test_many_budgets(spark):
    budgets = spark.createDataFrame([(i, 10 + i) for i in range(1200)], "budget_id int, capacity int")
    assert pack(spark.createDataFrame([(1, 5), (2, 3)], "doc_id long, n_tokens long"), budgets).count() == 2400


def test_nothing(spark):
    budgets = spark.createDataFrame([(1, 100)], "budget_id int, capacity int")
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long"), budgets).collect() == []
    assert pack(spark.createDataFrame([(1, 5)], "doc_id long, n_tokens long"), budgets.limit(0)).collect() == []
