import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from codeloom.operators.skew import heavy_keys, heavy_light_join, range_scan, summarise_by_key
from codeloom.plans.core_problems import QUERIES
from codeloom.session import Scratch
from tests.conftest import make_files, make_members, make_types


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "k string, o long, v long")


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, ""]), i // 2, rng.choice([None, 1, 5])) for i in range(3000)]
    rng.shuffle(rows)
    return rows


def test_summary_agrees_with_brute_force(spark, skewed):
    want = defaultdict(list)
    for k, o, _ in skewed:
        want[k].append(o)
    got = {r.k: (r.n, r.low, r.high) for r in summarise_by_key(rows_of(spark, skewed), ["k"], "o", Scratch(spark), parts=7).collect()}
    assert got == {k: (len(v), min(v), max(v)) for k, v in want.items()}


def test_summary_of_nothing_and_of_null_order(spark):
    assert summarise_by_key(rows_of(spark, []), ["k"], "o", Scratch(spark)).collect() == []
    got = summarise_by_key(rows_of(spark, [("a", None, 1), ("a", 4, 1), ("b", None, 1)]), ["k"], "o", Scratch(spark)).collect()
    assert {tuple(r) for r in got} == {("a", 2, 4, 4), ("b", 1, None, None)}


def test_summary_ignores_extra_columns(spark):
    frame = rows_of(spark, [("a", 1, 1)]).withColumn("n", F.lit("x")).withColumn("edge", F.lit(1)).withColumn("low", F.lit(2))
    assert [tuple(r) for r in summarise_by_key(frame, ["k"], "o", Scratch(spark)).collect()] == [("a", 1, 1, 1)]


def test_scan_agrees_with_brute_force(spark, skewed):
    rows = [(k, i, v) for i, (k, _, v) in enumerate(skewed)]
    got = {r.o: (r._pos, r._sum_v, r._last_v) for r in range_scan(rows_of(spark, rows), ["k"], ["o"], Scratch(spark), sums=["v"], fills=["v"], parts=9).collect()}
    state = defaultdict(lambda: [0, 0, None])
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        s = state[k]
        if v is not None:
            s[2] = v
        assert got[o] == (s[0], s[1], s[2])
        s[0] += 1
        s[1] += v or 0


def test_scan_of_one_key_only_and_of_nothing(spark):
    rows = [("x", i, 1) for i in range(500)]
    got = sorted((r.o, r._pos, r._sum_v) for r in range_scan(rows_of(spark, rows), ["k"], ["o"], Scratch(spark), sums=["v"], parts=8).collect())
    assert got == [(i, i, i) for i in range(500)]
    assert range_scan(rows_of(spark, []), ["k"], ["o"], Scratch(spark), sums=["v"]).collect() == []


def test_scan_keeps_large_longs_beside_nulls(spark):
    big = 2**62 + 1
    got = range_scan(spark.createDataFrame([(big, None), (None, 3)], "k long, o long"), ["k"], ["o"], Scratch(spark)).collect()
    assert {r.k for r in got} == {big, None}


def test_heavy_keys(spark, skewed):
    summary = summarise_by_key(rows_of(spark, skewed), ["k"], "o", Scratch(spark))
    total = spark.createDataFrame([(len(skewed),)], "total long")
    assert [r.k for r in heavy_keys(summary, total, ["k"], 0.3).collect()] == ["hot"]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_heavy_light_join_is_a_join(spark, how):
    left = spark.createDataFrame([("h", 1), ("h", 2), ("a", 3), (None, 4), ("z", 5), ("q", 6)], "k string, x int")
    right = spark.createDataFrame([("h", "H"), ("a", "A"), (None, "N")], "k string, y string")
    want = sorted(map(str, left.join(right, "k", how).collect()))
    assert sorted(map(str, heavy_light_join(left, right, "k", ["h", "q"], how).collect())) == want


def test_types_and_members_come_out_for_every_value(spark, tmp_path):
    make_files(spark, (1, "a.h", "P", "M", "cpp", 0), (2, "b.h", "P", "N", "cpp", 0), (3, "c.h", "Q", "N", "cpp", 0)).write.parquet(f"{tmp_path}/files.parquet")
    make_types(spark, (1, 1, "UA", "class", None, 1), (2, 1, "UB", "class", "UA", 1), (3, 2, "UB", "class", "UA", 1), (4, 9, "UC", "class", "UA", 1)).write.parquet(f"{tmp_path}/types.parquet")
    members = [(i, t, f, "x", "function", 1, False, None) for i, t, f in ((1, 1, 1), (2, 2, 1), (2, 2, 1), (3, None, 2), (4, 77, 2), (5, 4, 9))]
    make_members(spark, *members).write.parquet(f"{tmp_path}/members.parquet")
    got = {tuple(r)[:2]: tuple(r)[2:] for r in QUERIES["p2_measures"](spark, str(tmp_path)).collect()}
    assert got == {  # children, files, types, members
        ("files.project", "P"): (1, 2, 3, 4), ("files.project", "Q"): (0, 1, 0, 0), ("files.module", "M"): (1, 1, 2, 2), ("files.module", "N"): (1, 2, 1, 2),
        ("types.parent", None): (0, 1, 1, 1), ("types.parent", "UA"): (2, 3, 3, 2),
    }
