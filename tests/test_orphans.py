import pytest

from codeloom.operators.orphans import find_orphans, orphan_values
from tests.conftest import ASSETS, FILES, MEMBERS, TYPES, make_assets, make_files, make_members, make_types


@pytest.fixture()
def composite(spark):
    refs = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (9, None), (None, "a"), (None, "z"), (None, None), (1, "b")], "x int, y string")
    targets = spark.createDataFrame([(1, "a"), (2, "c"), (None, "q")], "x int, y string")
    return refs, targets


def values(frame):
    return {(r.x, r.y): r.n for r in frame.collect()}


def test_simple_match_leaves_partly_null_references_alone(composite):
    assert values(orphan_values(*composite[:1], ["x", "y"], composite[1])) == {(1, "b"): 2}


def test_partial_match_looks_up_the_columns_that_are_there(composite):
    assert values(orphan_values(composite[0], ["x", "y"], composite[1], "partial")) == {(1, "b"): 2, (9, None): 1, (None, "z"): 1}


def test_full_match_takes_every_partly_null_reference(composite):
    assert values(orphan_values(composite[0], ["x", "y"], composite[1], "full")) == {(1, "b"): 2, (2, None): 1, (9, None): 1, (None, "a"): 1, (None, "z"): 1}


def test_unknown_match_is_an_error(composite):
    with pytest.raises(ValueError):
        orphan_values(composite[0], ["x"], composite[1], "other")


def test_all_tables(spark):
    files = make_files(spark, (1, "/a.h", "P", "P", "cpp", 0), (2, "/b.h", "P", "P", "cpp", 1_700_000_000_000))
    types = make_types(spark, (1, 1, "UBase", "class", None, 1), (2, 2, "UChild", "class", "UBase", 1), (3, 1, "ULost", "class", "UGone", 1), (4, 9, "UNo", "class", "ubase", 1), (5, 2, "FX", "class", "", 1))
    members = make_members(spark, (1, 1, 1, "a", "function", 1, False, None), (2, 77, 2, "b", "function", 1, False, None), (2, 77, 2, "b", "function", 1, False, None), (3, None, 1, "c", "function", 1, False, None))
    assets = make_assets(spark, (1, "BP_A", "X", "Base"), (2, "BP_B", "X", "UBase"), (3, "BP_C", "X", "BP_A_C"), (4, "BP_D", "X", "BP_B"), (5, "BP_E", "X", "X"), (6, "BP_F", "X", "BP_A_C_C"), (7, "BP_G", "X", None))
    got = {tuple(r) for r in find_orphans(types, members, assets, files).collect()}
    assert got == {("types", "1970-01", 3, "UGone"), ("types", None, 4, "ubase"), ("members", "2023-11", 2, "77"), ("assets", "1970-01", 6, "BP_A_C_C")}


def test_empty_tables(spark):
    empty = [spark.createDataFrame([], s) for s in (TYPES, MEMBERS, ASSETS, FILES)]
    assert find_orphans(*empty).collect() == []
    lone = make_types(spark, (1, 1, "UA", "class", "UB", 1))
    assert [r.row_id for r in find_orphans(lone, empty[1], empty[2], empty[3]).collect()] == [1]
