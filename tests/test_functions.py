import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from codeloom.functions import names as N
from codeloom.functions import scoring as S
from codeloom.functions import text as X
from codeloom.functions import trigrams as G


def each(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", column(F.col("v")).alias("o"))
    return [r.o for r in sorted(rows.collect())]


def test_paths(spark):
    paths = ["C:\\A\\Widget.as", "/a/x.tar.gz", ".gitignore", "/a/.gitignore", "noext", "", None]
    assert each(spark, paths, N.basename_lower) == ["widget", "x.tar", ".gitignore", ".gitignore", "noext", "", None]
    assert each(spark, paths[:2], N.path_lower) == ["c:/a/widget.as", "/a/x.tar.gz"]
    assert each(spark, ["A/B/c.as", "c.h", "A\\B\\C.cpp"], lambda c: N.derive_module(c, F.lit("P"))) == ["P.A.B", "P", "P.A.B"]
    assert each(spark, ["/Game/A/B"], lambda c: N.mirror_content_path(N.asset_mirror_path(c))) == ["/Game/A/B"]
    assert each(spark, ["/r/p/a.h", "/q/a.h"], lambda c: N.clean_path(c, F.lit("P"), F.lit("/r/p/"))) == ["P/a.h", "/q/a.h"]


def test_names(spark):
    names = ["AHTTPServerActor", "Actor", "UMyWidget", "getHealth2", "", None]
    assert each(spark, names, N.split_camel) == [["http", "server", "actor"], ["actor"], ["my", "widget"], ["get", "health2"], [], None]
    assert each(spark, names, N.strip_loose)[:3] == ["HTTPServerActor", "ctor", "MyWidget"]
    assert each(spark, names, N.strip_strict)[:3] == ["HTTPServerActor", "Actor", "MyWidget"]
    assert [N.camel_words(n) for n in names[:4]] == each(spark, names, N.split_camel)[:4]
    assert "UActor" in N.prefix_variants("Actor") and "ctor" in N.prefix_variants("Actor") and "Actor" not in N.prefix_variants("Actor")


def test_trigrams(spark):
    assert each(spark, ["ABC", "abc", "ab\ncd", "abcde", "ab", "", None], lambda c: F.size(G.trigrams(c))) == [1, 1, 0, 3, 0, 0, None]
    assert G.trigram_list("aaaa") == ["aaa"] and [G.needed(q) for q in ("abcde", "abcdefgh", "x" * 20)] == [2, 5, 2]


def test_content_hash(spark):
    texts = ["hello", "", "ü日", "x" * 100_000]
    assert each(spark, texts, X.content_hash) == [struct.unpack("<q", hashlib.md5(t.encode()).digest()[:8])[0] for t in texts]
    assert each(spark, ["hello"], X.content_hash) == [8514701317032132957]


@pytest.mark.parametrize(
    "line, yes",
    [("class Foo : public Bar", 1), ("  UCLASS(Blueprintable)", 1), ("UFUNCTION()", 1), ("void AFoo::Tick(float D)", 1), ("float GetX()", 1), ("#define X 1", 1), ("mixin class Foo", 1), ("event void FOnX(int a)", 1), ("struct FData", 1), ("enum class EState", 1),
     ("// class Foo", 0), ("* class Foo", 0), ("x = y;", 0), ("", 0), (None, 0)],
)
def test_definition_lines(spark, line, yes):
    assert each(spark, [line], S.is_definition) == [bool(yes)]


def test_recency(spark):
    day, now = S.DAY_MS, 10_000 * S.DAY_MS
    ages = [now - 1000, now - 3 * day, now - 15 * day, now - 60 * day, now - 365 * day, 0, None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(ages)], "i int, v long").select("i", S.recency(F.col("v"), now).alias("o"))
    assert [r.o for r in sorted(rows.collect())] == [10, 8, 5, 3, 1, 0, 0]


def test_specifiers(spark):
    got = each(spark, ["BlueprintCallable", "EditAnywhere,Replicated", "BlueprintCallable, EditAnywhere, BlueprintPure", "", None], lambda c: F.round(S.specifier_boost(c), 6))
    assert got == [0.05, 0.05, 0.08, 0.0, 0.0]


def test_common_folder(spark):
    rows = spark.createDataFrame([("/a/b/c.h", "/a/b/d/e.h"), ("/a/b.h", "/a/b.h"), ("/x/a", "/y/a")], "a string, b string")
    assert [r.o for r in rows.select(X.common_folder(F.col("a"), F.col("b")).alias("o")).collect()] == ["/a/b/", "/a/", "/"]
