import pytest

from codeloom.operators import ingest as I
from codeloom.session import Scratch
from codeloom.sources import parsers
from tests.conftest import ASSETS, FILES, MEMBERS, TYPES

SCRIPT = "class UAim : UObject\n{\n    void Aim()\n    {\n    }\n};\n"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, project string, module string, mtime long, language string, relative_path string, content string")


def empty(spark):
    return {"files": spark.createDataFrame([], FILES), "types": spark.createDataFrame([], TYPES), "members": spark.createDataFrame([], MEMBERS), "assets": spark.createDataFrame([], ASSETS), "file_content": spark.createDataFrame([], "file_id long, content string, content_hash long")}


def cut(spark, tables):
    keep = Scratch(spark)
    return {n: keep.save(t) for n, t in tables.items()}


def none(spark):
    return spark.createDataFrame([], "path string")


def names(tables, name):
    return sorted(r.name for r in tables[name].select("name").collect())


def test_ingest_update_and_delete(spark):
    first = batch(spark, ("/s/Aim.as", "P", "P", 1, "angelscript", "Aim.as", SCRIPT), ("/s/Base.h", "P", "P", 1, "cpp", "Base.h", "class UBase : public UObject\n{\n    void Tick();\n};\n"), ("/s/D.ini", "P", "P", 1, "config", None, "a=1"))
    one = cut(spark, I.ingest(empty(spark), first, None, none(spark), parsers.symbols))
    assert names(one, "types") == ["UAim", "UBase"] and names(one, "members") == ["Aim", "Tick"] and one["file_content"].count() == 3
    owners = {r.name: r.type_id for r in one["members"].collect()}
    assert owners == {"Aim": one["types"].where("name = 'UAim'").first().id, "Tick": one["types"].where("name = 'UBase'").first().id}

    again = cut(spark, I.ingest(one, first, None, none(spark), parsers.symbols))
    for name in one:
        assert sorted(map(str, again[name].select(*one[name].columns).collect())) == sorted(map(str, one[name].collect()))

    second = batch(spark, ("/s/Aim.as", "P", "P", 0, "angelscript", None, SCRIPT.replace("Aim()", "Shoot()")))
    deletes = spark.createDataFrame([("/s/Base.h",), ("/nowhere",)], "path string")
    two = cut(spark, I.ingest(one, second, None, deletes, parsers.symbols))
    assert names(two, "types") == ["UAim"] and names(two, "members") == ["Shoot"] and two["file_content"].count() == 2
    kept = two["files"].where("path = '/s/Aim.as'").first()
    assert kept.relative_path == "Aim.as" and kept.mtime == 0 and kept.id == one["files"].where("path = '/s/Aim.as'").first().id


def test_upsert_keeps_ids_and_numbers_the_new(spark):
    files = spark.createDataFrame([(5, "/A.h", "P", "P", "cpp", 1, "A.h", "/a.h", "a")], FILES)
    rows = spark.createDataFrame([("/A.h", "Q", "Q", "cpp", 2, None), ("/C.h", "P", "P", "cpp", 1, None), ("/B.h", "P", "P", "cpp", 1, None), ("/B.h", "P", "P", "cpp", 1, None)], "path string, project string, module string, language string, mtime long, relative_path string")
    got = {r.path: (r.id, r.project, r.relative_path, r.basename_lower) for r in I.upsert_files(files, rows, Scratch(spark)).collect()}
    assert got == {"/A.h": (5, "Q", "A.h", "a"), "/B.h": (6, "P", None, "b"), "/C.h": (7, "P", None, "c")}


def test_difference(spark):
    schema = "path string, mtime long"
    disk, stored = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", None)], schema), spark.createDataFrame([("a", 1), ("b", 5), ("x", 1), ("d", 2), ("c", None)], schema)
    assert {tuple(r) for r in I.difference(disk, stored).collect()} == {("b", "changed"), ("c", "changed"), ("d", "changed"), ("x", "deleted")}


def test_status_and_values(spark):
    rows = spark.createDataFrame([("cpp", "indexing", 1), ("cpp", "ready", 2)], "language string, status string, at int")
    assert {tuple(r) for r in I.index_status(rows, ["cpp", "config"]).collect()} == {("cpp", "ready"), ("config", "pending")}
    values = spark.createDataFrame([("k", '{"a": 1}', 1), ("k", '{"a": [2, 3]}', 2)], "key string, value string, at int")
    assert [tuple(r) for r in I.key_values(values).collect()] == [("k", '{"a":[2,3]}')]


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def test_streams_agree_with_batches(spark, folder):
    from codeloom.operators import patches
    from codeloom.streaming import changes as C
    from tests.test_patches import feed, random_feed

    rows = feed(spark, random_feed(8, 200))
    rows.repartition(5).write.parquet(f"{folder}/feed.parquet")
    stream = lambda: C.read_stream(spark, f"{folder}/feed.parquet", 1)
    want = {tuple(r) for r in patches.composed(rows).collect()}
    assert {tuple(r) for r in C.maintain_state(stream()).collect()} == want
    assert {tuple(r) for r in C.running_counts(stream(), "op").collect()} == {tuple(r) for r in rows.groupBy("op").count().collect()}


def test_mtimes(spark):
    files = spark.createDataFrame([(1, "/a.h", "P", "P", "cpp", 7, None, "", ""), (2, "/b.h", "P", "P", "cpp", 8, None, "", ""), (3, "/c.uasset", "P", "P", "content", 9, None, "", "")], FILES)
    content = spark.createDataFrame([(1, "x", 1), (2, None, 1)], "file_id long, content string, content_hash long")
    assert {tuple(r) for r in I.mtimes(files, content).collect()} == {("/a.h", 7), ("/b.h", None), ("/c.uasset", 9)}
    assert [r.id for r in I.without_content(files, content).orderBy("id").collect()] == [2, 3]


def test_streams_of_nothing(spark, folder):
    import os

    from codeloom.streaming import changes as C
    from tests.test_patches import FEED

    os.makedirs(f"{folder}/none")
    stream = lambda: spark.readStream.schema(FEED + ", received_at timestamp").parquet(f"{folder}/none")
    assert C.maintain_state(stream()).collect() == [] and C.running_counts(stream(), "op").collect() == []
    assert C.windowed_counts(stream(), "received_at", "op").collect() == []


def test_windows_count_rows_that_come_late(spark, tmp_path):
    import os
    from collections import Counter
    from datetime import datetime, timedelta

    from codeloom.streaming import changes as C

    days = [30, 28, 29, 27, 20, 3, 2, 1, 30, 1]  # a file each, read in this order, four a batch
    for k, day in enumerate(days):
        frame = spark.createDataFrame([(datetime(2026, 6, day, 12), "a"), (datetime(2026, 6, day, 13), "b")], "ts timestamp, kind string")
        frame.coalesce(1).write.parquet(f"{tmp_path}/w{k}")
        part = next(f for f in os.listdir(f"{tmp_path}/w{k}") if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/events.parquet", exist_ok=True)
        os.rename(f"{tmp_path}/w{k}/{part}", f"{tmp_path}/events.parquet/{k:02d}.parquet")
        os.utime(f"{tmp_path}/events.parquet/{k:02d}.parquet", (1_000_000_000 + k, 1_000_000_000 + k))
    got = C.windowed_counts(C.read_stream(spark, f"{tmp_path}/events.parquet"), "ts", "kind").selectExpr("day(start) as day", "kind", "n").collect()
    assert {(r.day, r.kind): r.n for r in got} == {(day, kind): n for day, n in Counter(days).items() for kind in "ab"}
