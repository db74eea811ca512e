import random

from codeloom.operators import patches as P

FEED = "delivery_id long, session_no int, event_seq long, op string, path string, project string, mtime long"


def feed(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], FEED)


def replay(rows):
    state = {}
    for s, q, op, path, project, mtime in sorted(rows, key=lambda r: (r[0], r[1])):
        p = path.replace("\\", "/").lower()
        old = state.get(p, (False, None))
        gone = op.lower() == "unlink"
        state[p] = (not gone, None if gone else (mtime if mtime is not None else old[1]), s, q)
    return state


def random_feed(seed, n=400):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 3), q, rng.choice(["add", "Change", "UNLINK"]), rng.choice(["C:/a/X.h", "c:\\A\\x.h", "/b", "/hot", "/hot", "/hot"]), "P", rng.choice([None, rng.randint(1, 99)])) for q in range(n)]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows += rng.sample(rows, len(rows) // 4)
    rng.shuffle(rows)
    return rows


def test_state_agrees_with_replay(spark):
    rows = random_feed(1)
    got = {r.path_lower: (r.present, r.mtime, r.session_no, r.event_seq) for r in P.apply_patches(P.composed(feed(spark, rows))).collect()}
    assert got == replay(rows)


def test_composition_is_associative(spark):
    rows = random_feed(2)
    frame = feed(spark, rows)
    whole = {tuple(r) for r in P.composed(frame).collect()}
    a, b = P.composed(frame.where("delivery_id % 3 = 0")), P.composed(frame.where("delivery_id % 3 <> 0"))
    assert {tuple(r) for r in P.compose(b.unionByName(a), "path_lower").collect()} == whole


def test_base_table(spark):
    base = spark.createDataFrame([("/B", 5, "P"), ("/keep", 7, "Q"), ("/gone", 9, "Q"), (None, 1, "Z")], "path string, mtime long, project string")
    rows = [(1, 1, "change", "/b", "P", None), (1, 2, "unlink", "/gone", None, None), (1, 3, "add", "/gone", "Q", None)]
    got = {r.path_lower: (r.present, r.mtime, r.event_seq) for r in P.apply_patches(P.composed(feed(spark, rows)), base).collect()}
    assert got == {"/b": (True, 5, 1), "/keep": (True, 7, None), "/gone": (True, None, 3)}


def test_nulls_and_nothing(spark):
    rows = [(None, None, "add", "/a", None, 1), (1, 1, None, "/a", None, None), (1, 1, "add", None, None, None), (1, None, "unlink", "/c", None, None)]
    got = {r.path_lower: r.present for r in P.apply_patches(P.composed(feed(spark, rows))).collect()}
    assert got == {"/a": True, "/c": False}
    assert P.present_paths(feed(spark, [])).collect() == []


def test_extra_columns_change_nothing(spark):
    frame = feed(spark, random_feed(4, 50))
    wide = frame.selectExpr("*", "1 as path_lower", "2 as last", "3 as chunk_hi")
    assert {tuple(r) for r in P.present_paths(wide).collect()} == {tuple(r) for r in P.present_paths(frame).collect()}
