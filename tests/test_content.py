import pytest

from codeloom.operators import content as G
from tests.conftest import make_assets, make_files, make_members, make_types

BODIES = {
    1: "class APlayer : AActor\n{\n    void Hurt()\n    {\n        DestroyActor();\n    }\n}",
    2: "class AEnemy : APawn\n{\n    float Speed;\n}",
    3: "// game mode\nclass AGameMode\n{\n}\n",
}


@pytest.fixture(scope="module")
def texts(spark):
    files = make_files(spark, (1, "/s/Public/Player.h", "P", "P", "cpp", 0), (2, "/s/Enemy.as", "P", "P", "angelscript", 0), (3, "/s/Mode.as", "Q", "Q", "angelscript", 0), (4, "/s/None.as", "Q", "Q", "angelscript", 0))
    content = spark.createDataFrame([*BODIES.items(), (4, None)], "file_id long, content string")
    return content, files


def lines(hits):
    return sorted((r.file_id, r.line, r.column) for r in hits.collect())


def test_grep(texts):
    assert lines(G.grep(*texts, "DestroyActor")) == [(1, 5, 9)]
    assert lines(G.grep(*texts, "destroyactor")) == [] and lines(G.grep(*texts, "destroyactor", case_sensitive=False)) == [(1, 5, 9)]
    assert lines(G.grep(*texts, "APlayer|AEnemy")) == [(1, 1, 7), (2, 1, 7)]
    assert lines(G.grep(*texts, "Hurt()", regex=False)) == [(1, 3, 10)]
    assert lines(G.grep(*texts, "^class", project="Q")) == [(3, 2, 1)]
    assert lines(G.grep(*texts, "class", language="cpp")) == [(1, 1, 1)]
    assert lines(G.grep(*texts, r"\Aclass")) == [(1, 1, 1), (2, 1, 1), (3, 2, 1)]
    assert lines(G.grep(*texts, r"class A\w+(?!\s*\{)$", project="Q")) == [(3, 2, 1)]
    with pytest.raises(Exception):
        G.grep(*texts, "(")


def test_context_stops_at_the_ends(texts):
    rows = {r.line: r.context for r in G.grep(*texts, r"class|\}$", context=1, language="cpp").collect()}
    assert rows[1] == ["class APlayer : AActor", "{"] and rows[7] == ["    }", "}"]


def test_words_and_literals():
    assert G.literals("Foo.*Barbar") == ["Foo", "Barbar"] and G.literals("a|b") == [] and G.literals("abcd?") == ["abc"] and G.literals("abc{2}d") == []
    assert G.is_regex("a.b") and not G.is_regex(r"a\.b")


def test_several_words(texts):
    hits = G.grep(*texts, "(?i)hurt|destroyactor", context=3)
    assert [(r.line, r.near) for r in sorted(G.all_words(hits, ["hurt", "destroyactor"]).collect(), key=lambda r: r.line)] == [(3, True), (5, True)]


def test_symbols_and_rank(spark, texts):
    types = make_types(spark, (1, 1, "APlayer", "class", "AActor", 1), (2, 2, "AEnemy", "class", "APawn", 1))
    members = make_members(spark, (9, 1, 1, "Hurt", "function", 3, False, None), (10, 1, 1, "Later", "function", 6, False, None))
    hits = G.grep(*texts, "class|DestroyActor")
    near = G.symbols_near(hits, types, members)
    assert {(r.file_id, r.line, r.symbol) for r in near.collect()} == {(1, 1, "Hurt"), (1, 5, "Later"), (2, 1, "AEnemy")}
    best = sorted(G.best_hits(G.rank(hits, 0, near), 2).collect(), key=lambda r: r.rank)
    assert [(r.file_id, r.line, r.score) for r in best] == [(1, 1, 2 + 5 + 3 + 8 + 6), (1, 5, 2 + 5 + 3 + 6)] or best[0].line == 1
    assert best[0].total == 4 and best[0].truncated
    groups = {r.path: [m.line for m in r.matches] for r in G.by_file(hits).collect()}
    assert groups["/s/Public/Player.h"] == [1, 5]


def test_asset_texts(spark):
    assets = make_assets(spark, (1, "BP_A", "BlueprintGeneratedClass", "Actor"), (2, "BP_B", None, None))
    rows = {r.path: (r.matched_fields, r.match) for r in G.search_assets(assets, "BP_|Blueprint").collect()}
    assert rows == {"/c/BP_A.uasset": (3, "BP_A | /Game/A/BP_A | BlueprintGeneratedClass"), "/c/BP_B.uasset": (2, "BP_B | /Game/A/BP_B")}


def test_trigram_files(texts):
    assert [r.file_id for r in G.trigram_files(texts[0], "DestroyActor").collect()] == [1]
    assert len(G.trigram_files(texts[0], "a|b").collect()) == 3


def test_shapes(texts):
    hits = G.grep(*texts, "class")
    assert G.shape(hits, "files").count() == 3 and G.shape(hits, "count").count() == 3 and set(G.shape(hits, "content").columns) == {"path", "line", "match"}
