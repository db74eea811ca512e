import pytest

from codeloom.llm import provenance as P
from codeloom.llm.provenance import canonical, provenance
from tests.conftest import make_files

HAND = "// keep in step with the seat table, generated lists come later\nclass Boat\n{\n    int Crew = 3;\n    void Sail()\n    {\n        Crew = 4;\n    }\n};\n"
LIBRARY = "static int zed_open(const zed_ctx *c) {\n  return zed_ok(c);\n}\nstatic int zed_close(const zed_ctx *c) {\n  return zed_ok(c);\n}\n"


def layout(text):
    return P.layout([text], P.Tokens()).to_pylist()[0]


@pytest.mark.parametrize(
    "text, flag",
    [
        ("// Code generated by maker; DO NOT EDIT.\nint a;\n", "tool"),
        ("int a;\n// @generated by maker\n", "tool"),
        ("// Exported by maker for each build, see data/x.csv\nint a;\n", "tool"),
        ("// Output of maker 2.18 for the sheet\nint a;\n", "tool"),
        ("/* This file was produced by maker 3 from x.csv.\n Manual edits will be lost. */\nint a;\n", "tool"),
        ("/*\n * Copyright (c) the zed authors.\n * Redistribution in source and binary forms is permitted */\nint a;\n", "licence"),
        ("function a(b){return b}" * 60, "minified"),
        ("unsigned char x[] = {\n" + "    0x12, 0x34, 0x56, 0x78,\n" * 40 + "};\n", "blob"),
        ('static const char* x =\n' + '    "mNbvCxZlKjHgFdSaPoIuYtReWq"\n' * 30 + ";\n", "blob"),
    ],
)
def test_evidence(text, flag):
    found = layout(text)
    assert [k for k in ("tool", "licence", "minified", "blob") if found[k]] == [flag]


@pytest.mark.parametrize(
    "comment",
    ["// do not edit while the night build is running", "// code generated from blueprints calls this, so keep the name", "// @generated tags are stripped by the cooker before this runs", "// licence checks happen upstream, in the lobby", "// Copyright the studio team. All rights reserved.", "// output of the pump, in litres", "// created by hand after a long night", '// see "x'],
)
def test_hand_written_comments_are_no_evidence(comment):
    found = layout(comment + "\n" + HAND)
    assert not any(found[k] for k in ("tool", "licence", "minified", "blob"))


def test_a_long_list_among_code_is_no_blob():
    text = "function f(a) {\n  return a;\n}\n" * 20 + "const names = [" + ", ".join(f'"Name{i}"' for i in range(60)) + "];\n"
    assert not any(layout(text)[k] for k in ("minified", "blob"))


def test_canonical_layout():
    code = "class Boat\n{\n    int Crew = 3;\n    void Sail()\n    {\n        Crew = 4;\n    }\n};"
    assert canonical("// a\n" + code + "  // b\n") == code
    assert canonical("function a(b){for(let i=0;i<b;i++)c(i)}var d=1;e()").split("\n") == ["function a(b){", "    for(let i=0;i<b;i++)c(i)", "}", "var d=1;", "e()"]
    assert canonical("#define A 1\n#define B 2\nint a;") == "#define A 1\n#define B 2\nint a;" and canonical("") == "" and canonical("// only") == ""
    uneven = code.replace("Crew = 4", "Crew=4").replace("    int", "  int")
    assert canonical(uneven) != uneven


def test_uniformity_compares_with_the_canonical_layout():
    even = "".join(f"int Crew{i} = {i};\n" for i in range(60))
    assert layout(even)["uniform"] == 1 and layout(even)["gaps"] == 359
    uneven = even.replace("Crew7 = 7", "Crew7=7").replace("int Crew9 ", "  int  Crew9 ")
    assert 0.97 < layout(uneven)["uniform"] < 1
    texts = [even, uneven, "", "x = 1;\n", HAND, LIBRARY]
    assert P.layout(texts, P.Tokens()).to_pylist() == [layout(t) for t in texts]


def test_perfection_names_a_tool_only_where_it_is_unusual(spark):
    even = lambda k: "".join(f"int Crew{i} = {k};\n" for i in range(60))
    uneven = lambda k: even(k).replace("Crew7 = ", "Crew7=").replace("int Crew9", "  int Crew9")
    notice = "// Code generated by maker; DO NOT EDIT.\n"
    rows = [(i, f"/g/Src/f{i}.cpp", "Loose" if i < 40 else "Neat", "m", "cpp", 1) for i in range(80)]
    texts = [(i, uneven(i) if 1 < i < 40 else even(i)) for i in range(80)]
    texts[0] = (0, notice + even(0))
    files, content = make_files(spark, *rows), spark.createDataFrame(texts, "file_id long, content string")
    got = {r.file_id: (r.origin, r.evidence) for r in provenance(files, content).collect() if r.origin != "hand"}
    assert got == {0: ("tool", "notice"), 1: ("tool", "layout")}
    texts[0] = (0, even(0))  # no file is known to be a tool's: nothing says that perfection tells one
    assert provenance(files, spark.createDataFrame(texts, "file_id long, content string")).where("origin <> 'hand'").collect() == []


def test_a_prefix_needs_support(spark):
    own = LIBRARY.replace("zed", "own")
    rows = [(1, "/g/ThirdParty/own/a.c", "Game", "m", "cpp", 1), (2, "/g/Src/b.c", "Game", "m", "cpp", 1), *((i, f"/g/ThirdParty/zed/{i}.c", "Game", "m", "cpp", 1) for i in range(10, 20)), (20, "/g/Src/z.c", "Game", "m", "cpp", 1), *((i, f"/g/Src/{i}.cpp", "Game", "m", "cpp", 1) for i in range(40, 80))]
    texts = [*((i, HAND + f"int a{i};") for i in range(40, 80)), (1, own), (2, own + "int own_more;"), *((i, LIBRARY + f"int zed_{i};") for i in range(10, 21))]
    got = {r.file_id: r.origin for r in provenance(make_files(spark, *rows), spark.createDataFrame(texts, "file_id long, content string")).collect()}
    assert got[2] == "hand" and got[20] == "third_party"


def test_odd_texts():
    for text in ("", " \n\n", "\x00\x01", "/* never closed", '"never closed', "{" * 5000, "a" * 300_000, "日本語" * 1000):
        assert layout(text)["tool"] is False


def test_origins(spark):
    files = make_files(
        spark, (1, "/g/Src/Boat.cpp", "Game", "m", "cpp", 1), (2, "/g/Src/Generated/Boat.h", "Game", "m", "cpp", 1), (3, "/g/ThirdParty/zed/z.c", "Game", "m", "cpp", 1), (4, "/g/Src/copied.c", "Game", "m", "cpp", 1),
        (5, "/w/dist/a.min.js", "Web", "m", "javascript", 1), (6, "/g/Src/Vendors/Shop.cpp", "Game", "m", "cpp", 1), (7, "/g/Src/embedded_x.inl", "Game", "m", "cpp", 1), (8, "/e/z.c", "Extlibs", "m", "cpp", 1),
        (9, "/g/Src/other.c", "Game", "m", "cpp", 1), *((i, f"/g/ThirdParty/zed/{i}.c", "Game", "m", "cpp", 1) for i in range(20, 30)), *((i, f"/g/Src/{i}.cpp", "Game", "m", "cpp", 1) for i in range(40, 60)), (10, "/g/Src/Blob.cpp", "Game", "m", "cpp", 1), (11, "/g/Src/empty.cpp", "Game", "m", "cpp", 1),
    )
    content = spark.createDataFrame([(1, HAND), (2, HAND), (3, LIBRARY), (4, LIBRARY), (6, HAND), (8, LIBRARY + "int zed_more;"), (9, LIBRARY.replace("open", "shut")), *((i, LIBRARY + f"int zed_{i};") for i in range(20, 30)), *((i, HAND + f"int a{i};") for i in range(40, 60)), (10, HAND), (11, ""), (99, "x"), (None, "y")], "file_id long, content string")
    got = {r.file_id: r.origin for r in provenance(files.selectExpr("*", "1 as file_id", "2 as h"), content.selectExpr("*", "5 as id")).collect()}
    assert got == {1: "hand", 2: "tool", 3: "third_party", 4: "third_party", 5: "minified", 6: "hand", 7: "data", 8: "third_party", 9: "third_party", 10: "hand", 11: "hand"} | {i: "third_party" for i in range(20, 30)} | {i: "hand" for i in range(40, 60)}


def test_nulls_and_nothing(spark):
    files = make_files(spark).select("*")
    content = spark.createDataFrame([], "file_id long, content string")
    assert provenance(files, content).collect() == []
    lone = spark.createDataFrame([(1, None, None)], "id long, path string, project string")
    assert [r.origin for r in provenance(lone, spark.createDataFrame([(1, None)], "file_id long, content string")).collect()] == ["hand"]
