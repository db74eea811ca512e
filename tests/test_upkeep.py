import json

import pytest

from codeloom.operators import logs as L
from codeloom.operators import upkeep as U
from codeloom.sources import parsers
from codeloom.streaming import changes as C
from codeloom.streaming.index import IndexStream, read_items
from tests.test_ingest import SCRIPT, batch, cut, empty, names, none


@pytest.fixture()
def tables(spark):
    from codeloom.operators import ingest as I

    rows = batch(spark, ("/s/Aim.as", "P", "P", 1, "angelscript", "Aim.as", SCRIPT), ("/s/Old.as", "P", "P", 1, "angelscript", None, SCRIPT.replace("UAim", "UOld")), ("/s/Base.h", "Q", "Q", 1, "cpp", "Base.h", "class UBase : public UObject\n{\n};\n"))
    return cut(spark, I.ingest(empty(spark), rows, None, none(spark), parsers.symbols))


def test_rebuilds(spark, tables):
    again = batch(spark, ("/s/Aim.as", "P", "P", 1, "angelscript", None, SCRIPT.replace("Aim()", "Shoot()")))  # the same time, another text
    after = cut(spark, U.rebuild_language(tables, "angelscript", again, parsers.symbols))
    assert names(after, "types") == ["UAim", "UBase"] and names(after, "members") == ["Shoot"] and after["file_content"].count() == 2
    ids = lambda t: {r.path: r.id for r in t["files"].collect()}
    assert ids(after) == {k: v for k, v in ids(tables).items() if k != "/s/Old.as"}
    broken = tables | {"files": tables["files"].where("path <> '/s/Old.as'")}
    assert {r.name: (r.n_rows, r.n_orphans) for r in U.orphan_counts(broken).collect()} == {"types": (3, 1), "members": (2, 1), "file_content": (3, 1)}
    whole = cut(spark, U.rebuild_project(broken, "Q", again.limit(0), parsers.symbols))
    assert names(whole, "types") == ["UAim"] and whole["files"].count() == 1 and whole["file_content"].count() == 1
    gone = U.without_language(tables, "angelscript")
    assert names(gone, "types") == ["UBase"] and U.without_language(tables, "content")["files"].count() == 3


def test_retries():
    tried = []

    def job():
        tried.append(1)
        if len(tried) < 2:
            raise OSError("not yet")
        return "done"

    assert U.retried(job, sleep=lambda s: tried.append(s)) == "done" and tried == [1, 30.0, 1]
    with pytest.raises(OSError):
        U.retried(lambda: (_ for _ in ()).throw(OSError()), times=2, sleep=lambda s: None)


def test_migration(spark, tables):
    old = tables["files"].drop("path_lower", "basename_lower", "relative_path").withColumnRenamed("language", "language").selectExpr("*", "1 as more")
    files, again = U.migrate("files", old)
    assert files.columns == [f.split()[0] for f in U.SCHEMAS["files"].split(", ")] + ["more"] and not again
    assert {(r.path_lower, r.basename_lower, r.relative_path) for r in files.collect()} == {("/s/aim.as", "aim", None), ("/s/old.as", "old", None), ("/s/base.h", "base", None)}
    hashes = {r.file_id: r.content_hash for r in tables["file_content"].collect()}
    assert {r.file_id: r.content_hash for r in U.migrate("file_content", tables["file_content"].drop("content_hash"))[0].collect()} == hashes
    assert U.migrate("assets", tables["assets"].drop("asset_class"))[1] and not U.migrate("assets", tables["assets"])[1]
    with pytest.raises(ValueError, match="path"):
        U.migrate("files", tables["files"].drop("path"))


def test_what_is_to_be_done(spark, tables):
    assert {r.language for r in U.empty_languages(tables["files"], tables["assets"], ["cpp", "config", "content"]).collect()} == {"config", "content"}
    paths = spark.createDataFrame([(f"/p{i:03d}",) for i in range(25)], "path string")
    assert {r.path: r.batch for r in U.full_scan(paths, 10).collect()} == {f"/p{i:03d}": i // 10 for i in range(25)}
    assert U.full_scan(paths.limit(0), 10).collect() == []
    types = U.refreshed_depths(tables["types"])
    assert {r.depth for r in types.collect()} == {0} and U.refreshed_depths(tables["types"], tables["files"].limit(0)) is tables["types"]


def test_readiness(spark):
    rows = spark.createDataFrame([("a", "true", 1), ("b", "true", 1), ("b", "false", 2), ("d", None, 1)], "key string, value string, at int")
    assert {tuple(r) for r in U.readiness(rows, ["a", "b", "c", "d"]).collect()} == {("a", True), ("b", False), ("c", False), ("d", False)}


def test_result_cache(spark):
    now, asked = [0.0], []
    cache = U.ResultCache(2, 60, lambda: now[0])
    ask = lambda *q: cache.get(q, lambda: asked.append(q) or list(q))
    assert ask("a") == ask("a") == ["a"] and asked == [("a",)]
    ask("b"), ask("a"), ask("c")  # b is the longest unused and goes
    ask("a")
    assert len(cache) == 2 and asked == [("a",), ("b",), ("c",)]
    now[0] = 61
    ask("a")
    assert asked[-1] == ("a",) and len(asked) == 4
    cache.clear()
    assert len(cache) == 0 and [tuple(r) for r in cache.get(("f", {"x": 1}), lambda: spark.range(2))] == [(0,), (1,)]


def test_logged_arguments():
    assert L.logged_arguments(["name", [1, 2, 3], {"fuzzy": True, "secret": 1, "kind": None}, {"x": 1}, 5, None]) == '["name","[3 items]","{\\"fuzzy\\":true}","{...}",5,null]'


def test_summaries_of_arguments(spark):
    rows = spark.createDataFrame([(json.dumps({"a": "x" * 51, "b": "y" * 50, "c": 7}),), ("no json",), (None,)], "j string")
    got = [r.s for r in rows.select(L.summarised_arguments(rows.j).alias("s")).collect()]
    assert json.loads(got[0]) == {"a": "x" * 50 + "...", "b": "y" * 50, "c": "7"} and got[2] is None


def test_log_of_calls(spark, tmp_path):
    log = L.Log(spark, f"{tmp_path}/log", batch=2)
    assert log.read().collect() == []
    ticks = iter([0.0, 0.25, 1.0, 1.05])
    assert log.timed("find_type", ["UX", {"fuzzy": True}], lambda: [1, 2], clock=lambda: next(ticks)) == [1, 2]
    assert log.timed("stats", [], lambda: 5, slow_ms=100, clock=lambda: next(ticks)) == 5  # fast: not logged
    assert [(r.method, r.args, r.duration_ms, r.result_count) for r in log.read().collect()] == [("find_type", '["UX","{\\"fuzzy\\":true}"]', 250.0, 2)]
    L.Log(spark, "/proc/none/log", batch=1).append(None, "x", "[]", 1.0, None)  # never breaks a call


def items(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_index_stream_goes_on_where_it_stopped(spark, tmp_path):
    file = lambda path, text, seq, **more: {"kind": "file", "path": path, "project": "P", "language": "angelscript", "mtime": seq, "content": text, "seq": seq} | more
    inbox = tmp_path / "in"
    items(inbox, "1.json", file("/s/Aim.as", SCRIPT, 2), file("/s/Aim.as", "class UOlder\n{\n}\n", 1), file("/s/Base.as", SCRIPT.replace("UAim", "UBase"), 1), {"kind": "asset", "path": "/c/A.uasset", "name": "A", "asset_class": "Blueprint"}, "{broken", {"kind": "file", "path": "/s/x.as"}, {"kind": "odd", "path": "/p"})
    start = lambda: IndexStream(spark, f"{tmp_path}/index", f"{tmp_path}/checkpoint")
    first = start()
    assert first.tables()["files"].count() == 0
    first.run(read_items(spark, str(inbox)))
    assert names(first.tables(), "types") == ["UAim", "UBase"] and names(first.tables(), "assets") == ["A"] and first.tables()["file_content"].count() == 2
    assert sorted(r.error for r in first.errors().collect()) == ["no JSON object", "project is missing", "unknown kind"]
    items(inbox, "2.json", {"kind": "delete", "path": "/s/Base.as", "seq": 5}, {"kind": "delete", "path": "/c/A.uasset"}, file("/s/Aim.as", SCRIPT.replace("Aim()", "Shoot()"), 9))
    second = start()  # another object over the same folders takes only what is new
    second.run(read_items(spark, str(inbox)))
    after = second.tables()
    assert names(after, "types") == ["UAim"] and names(after, "members") == ["Shoot"] and after["assets"].count() == 0 and after["file_content"].count() == 1
    number, _ = second.versions.current()
    second.apply(spark.read.schema("kind string, path string").json(str(inbox)).limit(0), number)  # a batch that runs again does nothing
    assert second.versions.current()[0] == number


def test_strict_times(spark, tmp_path):
    row = lambda text, mtime: {"kind": "file", "path": "/s/Aim.as", "project": "P", "language": "angelscript", "mtime": mtime, "content": text}
    for strict, want in ((True, ["UAim"]), (False, ["ULate"])):
        inbox = tmp_path / f"in{strict}"
        stream = IndexStream(spark, f"{tmp_path}/i{strict}", f"{tmp_path}/c{strict}", strict)
        items(inbox, "1.json", row(SCRIPT, 10))
        stream.run(read_items(spark, str(inbox)))
        items(inbox, "2.json", row(SCRIPT.replace("UAim", "ULate"), 5))
        stream.run(read_items(spark, str(inbox)))
        assert names(stream.tables(), "types") == want


def test_a_batch_writes_only_the_buckets_it_touches(spark, tmp_path):
    from pyspark.sql import functions as F

    state = C.State(spark, f"{tmp_path}/s", ("k",), 16)
    rows = lambda *ks: spark.createDataFrame([(k, 1) for k in ks], "k string, n long")
    add = lambda t: t.groupBy("k").agg(F.sum("n").alias("n"))
    assert state.read() is None
    state.merge(0, rows(*"abcdefgh"), add)
    first = state.places()
    for batch in range(1, 5):
        state.merge(batch, rows("a", "a", None), add)
    got = {r.k: r.n for r in state.read().collect()}
    assert got["a"] == 9 and got["b"] == 1 and got[None] == 4 and len(got) == 9
    last = state.places()
    assert sum(last[b] != first.get(b) for b in last) <= 2 and set(first) <= set(last)
    import os

    assert len([d for _, ds, _ in os.walk(f"{tmp_path}/s") for d in ds if d.startswith("_bucket")]) <= len(last) + 4
    state.merge(5, rows(), add)  # an empty batch
    assert {r.k: r.n for r in state.read().collect()} == got


def test_state_is_kept_between_runs(spark, tmp_path):
    from codeloom.operators import patches
    from tests.test_patches import feed, random_feed

    rows = feed(spark, random_feed(3, 100)).repartition(4)
    rows.write.parquet(f"{tmp_path}/feed.parquet")
    stream = lambda: C.read_stream(spark, f"{tmp_path}/feed.parquet", 1)
    first = {tuple(r) for r in C.maintain_state(stream(), f"{tmp_path}/kept").collect()}
    more = feed(spark, random_feed(4, 50))
    more.write.mode("append").parquet(f"{tmp_path}/feed.parquet")
    version = C.Versions(spark, f"{tmp_path}/kept/state").current()[0]
    second = {tuple(r) for r in C.maintain_state(stream(), f"{tmp_path}/kept").collect()}
    assert first != second == {tuple(r) for r in patches.composed(spark.read.parquet(f"{tmp_path}/feed.parquet")).collect()}
    assert C.Versions(spark, f"{tmp_path}/kept/state").current()[0] > version
    assert {tuple(r) for r in C.running_counts(stream(), "op", folder=f"{tmp_path}/counts").collect()} == {tuple(r) for r in C.running_counts(stream(), "op", folder=f"{tmp_path}/counts").collect()}
