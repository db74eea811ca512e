import struct

import pytest

from codeloom.sources import parsers as P
from codeloom.sources import scan
from codeloom.sources.asset_header import asset_classes

CPP = """class FForward;
UCLASS(Blueprintable, Config=Game)
class GAME_API AMyActor final : public AActor
{
    GENERATED_BODY()
public:
    UPROPERTY(EditAnywhere, BlueprintReadWrite)
    float Health = 1.0f;
    UFUNCTION()
    static void DoIt(int X);
    virtual void BeginPlay() override;
    AMyActor();
    const char* Brace() { return "}"; }
};
DECLARE_DYNAMIC_MULTICAST_DELEGATE_OneParam(FOnX, int, Y);
DECLARE_DELEGATE_RetVal(bool, FGetIt)
DECLARE_EVENT(AMyActor, FChanged)
UENUM()
enum class EState : uint8
{
    Idle,
    Run UMETA(DisplayName="x"),
    Walk = 3,
};
using FVector = Math::TVector<double>;
struct FPlain : public FBase
{
    int A;
};
class Helper {
};
"""
SCRIPT = """UCLASS()
class UThing : UObject
{
    UPROPERTY()
    int Count = 3;
    private float Rate;
    default Rate = 2;
    UFUNCTION()
    void Go(int X)
    {
        int y = 3;
        if (y > 2) { Stop(); }
    }
    static int Make() { return 1; }
};
enum EKind
{
    One,
    Two = 3
}
event void FOnDone(int a);
delegate int FGet();
namespace Util { }
namespace Util { }
struct FData : FBase
{
    float X;
}
"""


def shown(rows):
    return [(r[0], r[1], r[2], r[3], r[4]) if r[0] == "type" else (r[0], r[1], r[2], r[4], r[5], r[6], r[7]) for r in rows]


def test_cpp():
    assert shown(P.Cpp().parse(CPP)) == [
        ("type", "AMyActor", "class", "AActor", 3), ("member", "Health", "property", 8, False, "EditAnywhere, BlueprintReadWrite", "AMyActor"), ("member", "DoIt", "function", 10, True, "UFUNCTION", "AMyActor"),
        ("member", "BeginPlay", "function", 11, False, "virtual", "AMyActor"), ("member", "Brace", "function", 13, False, "", "AMyActor"), ("type", "FOnX", "delegate", None, 15), ("type", "FGetIt", "delegate", None, 16), ("type", "FChanged", "delegate", None, 17),
        ("type", "EState", "enum", None, 19), ("member", "Idle", "enum_value", 21, False, None, "EState"), ("member", "Walk", "enum_value", 23, False, None, "EState"),
        ("type", "FVector", "struct", "TVector", 25), ("type", "FPlain", "struct", "FBase", 26),
    ]


def test_script():
    assert shown(P.Script().parse(SCRIPT)) == [
        ("type", "UThing", "class", "UObject", 2), ("member", "Count", "property", 5, False, "UPROPERTY", "UThing"), ("member", "Rate", "property", 6, False, None, "UThing"), ("member", "Go", "function", 9, False, "UFUNCTION", "UThing"),
        ("member", "Make", "function", 14, True, None, "UThing"), ("type", "EKind", "enum", None, 16), ("member", "One", "enum_value", 18, False, None, "EKind"), ("member", "Two", "enum_value", 19, False, None, "EKind"),
        ("type", "FOnDone", "event", None, 21), ("type", "FGet", "delegate", None, 22), ("type", "Util", "namespace", None, 23), ("type", "FData", "struct", "FBase", 25), ("member", "X", "property", 27, False, None, "FData"),
    ]


def test_symbols_frame(spark):
    rows = spark.createDataFrame([(1, "cpp", CPP), (2, "angelscript", SCRIPT), (3, "config", "class UX"), (4, "cpp", None), (5, "cpp", "class UX\n{\n};\n" + " " * 600_000), (6, "cpp", "")], "file_id long, language string, content string")
    got = P.symbols(rows)
    assert {r.file_id for r in got.collect()} == {1, 2, 5} and got.where("entity = 'member' and is_static").count() == 2
    assert {r.file_id for r in P.symbols(rows, longest=500_000).collect()} == {1, 2}
    assert P.symbols(rows.limit(0)).collect() == []


def text(s):
    data = s.encode() + b"\0"
    return struct.pack("<i", len(data)) + data


def asset(version=-8, exports=((-2, -3),), names=("Class", "BlueprintGeneratedClass", "Actor", "CoreUObject")):
    """A header with the imports (Class BlueprintGeneratedClass), (Class BlueprintGeneratedClass), (Class Actor)."""
    name_table = b"".join(text(n) + b"\0\0\0\0" for n in names)
    imports = b"".join(struct.pack("<iiiiiii", 3, 0, 0, 0, 0, n, 0) for n in (3, 1, 2))
    export_table = b"".join(struct.pack("<ii", *e) + b"\0" * 56 for e in exports)
    head = lambda n, e, i, d: struct.pack("<Iii", 0x9E2A83C1, version, 0) + struct.pack("<i", 522) + (struct.pack("<i", 1) if version <= -8 else b"") + struct.pack("<iii", 0, 0, 0) + text("None") + struct.pack("<iii", 0, len(names), n) + (struct.pack("<ii", 0, 0) if version <= -8 else b"") + text("id") + struct.pack("<ii", 0, 0) + struct.pack("<iiiii", len(exports), e, 3, i, d)
    size = len(head(0, 0, 0, 0))
    n = size
    i = n + len(name_table)
    e = i + len(imports)
    return head(n, e, i, e + len(export_table)) + name_table + imports + export_table


def test_asset_header():
    for version in (-6, -7, -8):
        assert asset_classes(asset(version)) == ("BlueprintGeneratedClass", "Actor")
    assert asset_classes(asset(exports=((-3, 0), (-2, 0)))) == ("BlueprintGeneratedClass", None)
    assert asset_classes(asset(exports=((-3, 0),))) == ("Actor", None)


def test_broken_asset_headers():
    good = asset()
    for data in (None, b"", b"not an asset at all, not at all, no", b"\xc1\x83\x2a\x9e12345", b"\0" * 64, good[:4] + struct.pack("<i", -5) + good[8:], *(good[:k] for k in range(0, len(good) - 130, 7))):
        assert asset_classes(data) == (None, None)


def test_scan(spark, tmp_path):
    (tmp_path / "A" / "B").mkdir(parents=True)
    (tmp_path / "A" / "B" / "X.as").write_text(SCRIPT)
    (tmp_path / "Top.h").write_text("class UX\n{\n};\n")
    (tmp_path / "A" / "skip.txt").write_text("no")
    (tmp_path / "A" / "BP_A.uasset").write_bytes(asset())
    rows = {r.relative_path: r for r in scan.scan_files(spark, str(tmp_path), "P", "cpp", [".as", ".h"]).collect()}
    assert {k: v.module for k, v in rows.items()} == {"A/B/X.as": "P.A.B", "Top.h": "P"} and rows["Top.h"].mtime > 0 and rows["Top.h"].path == str(tmp_path / "Top.h")
    assert scan.scan_files(spark, str(tmp_path), "P", "cpp", [".as", ".h"], ["**/B/**"]).count() == 1
    assert {r.path.rsplit("/", 1)[-1]: r.content for r in scan.read_texts(spark, str(tmp_path), "*.h").collect()} == {"Top.h": "class UX\n{\n};\n"}
    a = scan.read_assets(spark, str(tmp_path), "P").collect()[0]
    assert (a.name, a.content_path, a.folder, a.extension, a.asset_class, a.parent_class) == ("BP_A", "/Game/A/BP_A", "/Game/A", ".uasset", "BlueprintGeneratedClass", "Actor")


def test_settings():
    good = '\ufeff{"projects": [{"name": "P", "paths": ["D:\\\\p"], "language": "cpp"}]}'
    assert scan.load_settings(good)["projects"][0]["name"] == "P"
    for bad in ('{"projects": []}', "{}", '{"projects": [{"name": "P", "paths": []}]}'):
        with pytest.raises(ValueError):
            scan.load_settings(bad)


def test_project_of(spark):
    settings = {"projects": [{"name": "A", "paths": ["D:/a"]}, {"name": "B", "paths": ["D:/a/b", "E:\\b"]}]}
    rows = spark.createDataFrame([("d:\\A\\x.h",), ("e:/b/y.h",), ("D:/ab/z.h",)], "p string")
    project, base = scan.project_of(rows.p, settings)
    assert [tuple(r) for r in rows.select(project, base).collect()] == [("A", "D:/a"), ("B", "E:/b"), (None, None)]


def test_exclusions():
    import re

    deep = scan.exclude_pattern("**/Intermediate/**")
    assert re.search(deep, "/a/Intermediate/b.h") and not re.search(deep, "/a/Inter/b.h")
    assert re.search(scan.exclude_pattern("node_modules"), "/a/node_modules/b")


def test_published_tables_are_read_by_their_filters(spark, tmp_path):
    import contextlib
    import io

    from codeloom.sources.publish import LAYOUTS, by_prefix, publish
    from tests.conftest import make_members

    rows = make_members(spark, *[(i, 1, 1, f"Name{i % 50}", "function", 1, False, None) for i in range(500)], (1, 1, 1, "Name1", "function", 1, False, None))
    publish("members", rows, str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    assert stored.count() == 500 and [r.name for r in stored.select("name").collect()] == sorted(f"Name{i % 50}" for i in range(500))
    found = by_prefix(stored, "NAME4")
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        found.explain("formatted")
    assert found.count() == 110 and "StringStartsWith(name_lower,name4)" in shown.getvalue()
    assert set(LAYOUTS) == {"files", "types", "members", "assets", "file_content"}


def test_read_source_goes_to_the_parser_of_each_language(spark, tmp_path):
    from codeloom.sources import scan

    (tmp_path / "Sub").mkdir()
    (tmp_path / "Sub" / "Boat.h").write_text("class UBoat : public UObject\n{\n};\n")
    (tmp_path / "Aim.as").write_text("class UAim : UObject\n{\n}\n")
    (tmp_path / "D.ini").write_text("class=UNone\n")
    (tmp_path / "x.txt").write_text("class UText\n{\n}\n")
    items, found = scan.read_source(spark, str(tmp_path), "P")
    assert {(r.relative_path, r.language, r.module) for r in items.collect()} == {("Sub/Boat.h", "cpp", "P.Sub"), ("Aim.as", "angelscript", "P"), ("D.ini", "config", "P")}
    assert {(r.name, r.parent, r.path.rsplit("/", 1)[-1]) for r in found.collect()} == {("UBoat", "UObject", "Boat.h"), ("UAim", "UObject", "Aim.as")}
