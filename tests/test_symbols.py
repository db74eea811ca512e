import pytest

from codeloom.api import BadRequest, Index, file_lookup, route, route_command, routes
from codeloom.operators import closure as C
from codeloom.operators import symbols as S
from codeloom.sources.publish import publish
from tests.conftest import ASSETS, make_assets, make_files, make_members, make_types


@pytest.fixture(scope="module")
def base(spark):
    files = make_files(spark, (1, "/test/Widget.as", "Discovery", "Discovery.UI", "angelscript", 1), (2, "/e/Runtime/Public/Widget.h", "Engine", "Engine.Runtime", "cpp", 1), (3, "/e/Runtime/Private/Widget.cpp", "Engine", "Engine.Runtime", "cpp", 1))
    types = make_types(
        spark, (1, 1, "UMyWidget", "class", "UWidget", 10), (2, 1, "FMyData", "struct", None, 50), (3, 1, "EMyState", "enum", None, 80), (4, 3, "UButton", "class", "UWidget", 3), (5, 2, "UButton", "class", "UWidget", 7),
        (6, 2, "UWidget", "class", "UObject", 1), (7, 3, "UBigButton", "class", "UButton", 9), (8, 2, "IClickable", "interface", None, 2),
    )
    assets = make_assets(spark, (1, "BP_Button", "WidgetBlueprintGeneratedClass", "Button"), (2, "BP_Child", "BlueprintGeneratedClass", "BP_Button"), (3, "M_Button", None, "Button"))
    return types, files, assets


def names(frame):
    return [r.name for r in sorted(frame.collect(), key=lambda r: r.rank)]


def test_exact_variant_and_filters(base):
    assert names(S.find_type(*base, "UMyWidget")) == ["UMyWidget"]
    row = S.find_type(*base, "MyWidget").collect()[0]
    assert (row.name, row.match_reason) == ("UMyWidget", "prefix-variant")
    assert names(S.find_type(*base, "UMyWidget", S.Options(language="cpp"))) == []
    assert names(S.find_type(*base, "UMyWidget", S.Options(project="Engine"))) == []
    assert names(S.find_type(*base, "IClickable", S.Options(kind="class"))) == []
    assert names(S.find_type(*base, "nothing")) == []


def test_duplicates_keep_the_header_and_name_the_source(base):
    rows = S.find_type(*base, "UButton").collect()
    assert [(r.path, r.implementation_path) for r in rows] == [("/e/Runtime/Public/Widget.h", "/e/Runtime/Private/Widget.cpp")]


def test_assets_fill_up_and_lose_their_suffix(base):
    assert names(S.find_type(*base, "BP_Button")) == ["BP_Button"]
    assert names(S.find_type(*base, "BP_Button_C")) == ["BP_Button"]
    assert names(S.find_type(*base, "M_Button")) == []


def test_fuzzy(base):
    assert set(names(S.find_type_fuzzy(*base, "Widget"))) == {"UWidget", "UMyWidget"}  # the second by its trigrams
    assert names(S.find_type_fuzzy(*base, "Widget", S.Options(max_results=1))) == ["UWidget"]  # enough begin with it
    assert names(S.find_type_fuzzy(*base, "Button", S.Options(include_assets=True)))[0] == "UButton"
    assert {"BP_Button"} <= set(names(S.find_type_fuzzy(*base, "Button", S.Options(include_assets=True))))
    assert names(S.find_type_fuzzy(*base, "zzzz")) == []


def test_members(spark, base):
    types, files, _ = base
    members = make_members(spark, (1, 1, 1, "BeginPlay", "function", 10, False, "UFUNCTION"), (2, 1, 1, "MaxHealth", "property", 5, False, "UPROPERTY"), (3, 1, 1, "TakeDamage", "function", 20, False, None), (3, 1, 1, "TakeDamage", "function", 20, False, None), (4, None, 2, "Free", "function", 1, True, None))
    assert names(S.find_member(members, types, files, "TakeDamage")) == ["TakeDamage"]
    assert names(S.find_member(members, types, files, "TakeDamage", containing="UButton")) == []
    assert names(S.find_member(members, types, files, "TakeDamage", containing="UMyWidget")) == ["TakeDamage"]
    assert names(S.find_member(members, types, files, "Free")) == ["Free"]
    assert names(S.find_member_fuzzy(members, types, files, "MaxHealt")) == ["MaxHealth"]
    assert {(r.bucket, r.n, r.n_in_bucket) for r in S.members_of(members, types, "UMyWidget", 1, 5).collect()} == {("function", 1, 2), ("property", 1, 1)}


def test_children_pass_over_to_assets(spark, base):
    rows = C.children(*base, "UWidget").collect()
    assert {r.name for r in rows} == {"UMyWidget", "UButton", "UBigButton", "BP_Button", "BP_Child"}
    assert [r.name for r in C.children(*base, "UWidget", language="blueprint").collect()] == ["BP_Button", "BP_Child"]
    direct = C.children(*base, "UWidget", recursive=False, limit=2).collect()
    assert len(direct) == 2 and direct[0].truncated and direct[0].total == 3 and direct[0].parent_found


def test_component_accessors(spark, base):
    types, files, _ = base
    found = S.find_member(make_members(spark), types, files, "Get", containing="UButton")
    yes, no = (spark.createDataFrame([(n,)], "name string") for n in ("UActorComponent", "UObject"))
    assert [r.name for r in S.synthetic_members(found, yes, "UButton", "Get", True, 20).collect()] == ["Get", "GetOrCreate"]
    assert [r.name for r in S.synthetic_members(found, yes, "UButton", "Get", False, 20).collect()] == ["Get"]
    assert S.synthetic_members(found, no, "UButton", "Get", True, 20).collect() == []
    assert len(S.synthetic_members(found, yes, "UButton", "Get", True, 1).collect()) == 1


def test_batch_lookup(spark, base):
    types, files, _ = base
    asked = spark.createDataFrame([("UMyWidget",), ("Button",), ("none",), (None,), ("Button",)], "query string")
    assert {(r.query, r.name, r.match_reason, r.rank) for r in S.find_types_batch(types, files, asked).collect()} == {("UMyWidget", "UMyWidget", "exact", 1), ("Button", "UButton", "prefix-variant", 1), ("Button", "UButton", "prefix-variant", 2)}


def test_empty_tables(spark, base):
    types, files, _ = base
    none = spark.createDataFrame([], ASSETS)
    assert S.find_type(types.limit(0), files.limit(0), none, "UX").collect() == []
    assert S.find_asset(none, "x").collect() == [] and S.list_asset_folders(none).collect() == []


def test_routing():
    assert route("class AActor") == ("find_type", {"name": "AActor"})
    assert route("class Foo : Bar") == ("find_type", {"name": "Foo"})
    assert route("UWidget") == ("find_type", {"name": "UWidget"})
    assert route("IWidget") == ("grep", {"pattern": "IWidget"}) and route("UWidget->") == ("grep", {"pattern": "UWidget->"})
    assert route("float Health") == ("find_member", {"name": "Health"}) and route("UFUNCTION Go(") == ("find_member", {"name": "Go"})
    assert route("tide clock") == ("grep", {"pattern": "tide clock"})
    assert route("foo.*bar") == ("grep", {"pattern": "foo.*bar"})
    assert [m for m, _ in routes("struct FBoat")] == ["find_type", "grep"] and routes("x") == []
    for command in ("rg -n 'class AActor' src", "grep -rn 'class AActor' src", "Select-String -Path x -Pattern 'class AActor'"):
        assert route_command(command) == ("grep", {"pattern": "class AActor"})
    for command in ("find . -name '*Widget*.h'", "Get-ChildItem -Recurse -Filter '*Widget*.h'", "gci -Filter Widget.cpp"):
        assert route_command(command) == ("find_file", {"name": "Widget"})
    assert file_lookup("**/Public/My?Widget*.h") == ("find_file", {"name": "MyWidget"}) and file_lookup("**/*.h") is None
    assert route_command("find /src -type f") is None and route_command("find . -name '*.h'") is None
    assert route_command("echo hi") is None and route_command("grep 'x") is None and route_command("grep x") is None


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_filters_stand_on_the_scan(spark, tmp_path):
    """Lookups filter before they put repeated rows together, and prefixes reach the files of a published table."""
    members = make_members(spark, *[(i, 1, 1, f"ApplyAnchor{i}", "function", 1, False, None) for i in range(50)] * 2)
    members.write.parquet(f"{tmp_path}/members")
    publish("members", spark.read.parquet(f"{tmp_path}/members"), f"{tmp_path}/published")
    stored = spark.read.parquet(f"{tmp_path}/published")
    found = S.near_or_deep(stored, "appl", ["appl"], True, spark.createDataFrame([], "trigram string, entity_type string, entity_id long"), "member")
    assert found.count() == 50 and "StringStartsWith(name_lower,appl)" in plan(found)
    near = S.near_or_deep(spark.read.parquet(f"{tmp_path}/members"), "applyanchor1", ["applyanchor1"], True, None, "member")
    rows = S.member_rows(near, make_types(spark, (1, 1, "UX", "class", None, 1)), make_files(spark, (1, "/a.h", "P", "P", "cpp", 0)), S.Options())
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Aggregate [id") < text.rindex("Filter (StartsWith")  # the root comes first: the filter is below


def test_stored_postings_find_the_same(spark, tmp_path):
    import os

    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    index = Index(spark, "/root/testdata/sf0.001")
    stored = index.publish(str(tmp_path))
    for ask in (lambda i: i.find_type("NightKayak", fuzzy=True), lambda i: i.find_type("UKayak", fuzzy=True), lambda i: i.find_member("AnchorHealth", fuzzy=True), lambda i: i.find_member("ApplyA", fuzzy=True), lambda i: i.find_type("UCoreObject")):
        columns = sorted(ask(index).columns)
        assert sorted(map(str, ask(index).select(*columns).collect())) == sorted(map(str, ask(stored).select(*columns).collect()))


def test_facade(spark):
    import os

    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    index = Index(spark, "/root/testdata/sf0.001")
    assert index.find_type("UCoreObject").count() == 1 and index.stats().count() > 5
    answers = index.batch([("find_type", {"name": "UCoreObject"}), ("no_such", {}), ("find_file", {"name": ""}), ("stats", {"wrong": 1})])
    assert answers[0].count() == 1 and all(isinstance(a, str) and a.startswith("error") for a in answers[1:])
    for bad in ([], [("stats", {})] * 11):
        with pytest.raises(BadRequest):
            index.batch(bad)
    for call in (lambda: index.grep("(", 0), lambda: index.grep("x", 0, language="blueprint"), lambda: index.find_type("X", project="Nope"), lambda: index.find_type(" ")):
        with pytest.raises(BadRequest):
            call()
    assert index.grep("Anchor Socket", 1_780_000_000_000).count() >= 0
    told = index.explain_type("UCoreObject", 3, 3, context_lines=1)
    assert {"signature", "context"} <= set(told["members"].columns) and {"signature", "context"} <= set(told["type"].columns) and told["members"].count() >= 0
    assert index.search_symbols("UCoreObject").count() >= 1
    assert len(Index.grep_hints("a\\nb\\|c", "P")) == 3 and Index.grep_hints("abc") == []
    assert Index.hints("find_type", project="P") == ["look for similar names (fuzzy)", "leave out the filter on project (P)"]


def test_sql_functions(spark):
    import os

    from codeloom.api import register

    if not os.path.exists("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    register(spark, "/root/testdata/sf0.001")
    row = spark.sql("select trigrams('ABCd') as g, strip_prefix('UWidget') as s, camel_words('AHTTPServerActor') as w, (select count(*) from types) as n").collect()[0]
    direct = spark.sql("select * from children_of('UCoreObject')").count()
    assert direct == spark.sql("select * from types where parent = 'UCoreObject'").count() + spark.sql("select * from assets where asset_class is not null and parent_class in ('UCoreObject', 'CoreObject')").count() > 0
    first = spark.table("file_content").first()
    assert [r.text for r in spark.sql(f"select * from lines_of({first.file_id}) order by line").collect()] == first.content.split("\n")
    assert (row.g, row.s, row.w) == (["abc", "bcd"], "Widget", ["http", "server", "actor"]) and row.n > 0
