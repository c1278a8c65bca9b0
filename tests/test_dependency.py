import pytest
from pyspark.sql import functions as F

from runloom.operators import dependency as D
from tests.conftest import rows


@pytest.fixture(scope="module")
def changed(spark):
    return lambda paths: spark.createDataFrame([("r", "s", p) for p in paths], "repo string, commit_sha string, file_path string")


@pytest.fixture(scope="module")
def tests_(spark):
    return spark.createDataFrame([("r", "s", "com.example.FooTest")], "repo string, commit_sha string, test_id string")


TEST = "module-a/src/test/java/com/example/FooTest.java"


def one(df):
    r = df.first()
    return tuple(r[c] for c in D.COLUMNS)


def test_unknown_source(changed, tests_):
    assert one(D.dependency_features(tests_, changed(["README.md"]))) == (0, 0, 0, 0, 1)


def test_touched_package_and_module(changed, tests_):
    files = changed([TEST, "module-a/src/main/java/com/example/Bar.java", "module-b/src/main/java/com/other/Baz.java"])
    assert one(D.dependency_features(tests_, files)) == (1, 0, 1, 2, 0)


def test_imports(spark, changed, tests_):
    files = changed([TEST, "x/src/main/java/com/example/Foo.java", "x/src/main/java/com/example/Bar.java", "Foo.txt"])
    imports = spark.createDataFrame([("r", "com.example.FooTest", n) for n in ("com.example.Foo", "com.example.Bar", "com.example.Bar")], "repo string, test_id string, name string")
    assert one(D.dependency_features(tests_, files, imports))[1] == 2


def test_nearest_build_file(spark, changed):
    files = changed(["a/b/c/X.java", "a/Y.java", "z/Q.java", "top.txt"])
    poms = spark.createDataFrame([("r", ""), ("r", "a"), ("r", "a/b"), ("other", "z")], "repo string, dir string")
    assert rows(D.modules(files, poms), "file_path", "module") == [("a/Y.java", "a"), ("a/b/c/X.java", "a/b"), ("top.txt", ""), ("z/Q.java", "")]
    assert rows(D.modules(files), "file_path", "module") == [("a/Y.java", "a"), ("a/b/c/X.java", "a"), ("top.txt", "."), ("z/Q.java", "z")]


def test_paths(spark):
    df = spark.createDataFrame([(p,) for p in ("m/src/main/java/com/a/B.java", "src/test/java/C.java", "docs/x.md", "B")], "p string")
    assert [tuple(r) for r in df.select(D.package_of(F.col("p")), D.class_name(F.col("p"))).collect()] == [("com.a", "B"), ("", "C"), ("", "x"), ("", "B")]


def test_header(spark):
    good = '/* import no.No; */ package com.a;\nimport b.C;\nimport static d.E.f;\nimport g.*;\n// import h.I;\nclass X { String s = "}"; }'
    got = spark.createDataFrame([(good,), ("class X {",), (None,)], "t string").select(*D.java_header(F.col("t"))).collect()
    assert tuple(got[0]) == ("com.a", ["b.C", "d.E.f", "g"], True)
    assert got[1][2] is False and got[2][2] is not True


def test_sources_by_name(spark, changed):
    tests = spark.createDataFrame([("r", "s", t) for t in ("p.A", "p.B", "p.C", "p.D", "p.E")], "repo string, commit_sha string, test_id string")
    paths = ["src/test/java/p/A.java", "m/src/test/java/p/A.java", "long/er/src/test/java/p/B.java", "m/src/test/java/p/B.java", "m/src/test/java/q/C.java", "src/main/java/p/D.java"]
    sources = spark.createDataFrame([("r", p) for p in paths] + [("other", "src/test/java/p/E.java")], "repo string, path string")
    assert rows(D.located_sources(tests, sources), "test_id", "file_path") == [("p.A", paths[0]), ("p.B", paths[3]), ("p.C", paths[4])]
    got = D.dependency_features(tests, changed(["m/src/main/java/q/X.java"]), sources=sources)
    assert rows(got, "test_id", "same_package", "changed_files_in_module", "dependency_parse_failed") == [("p.A", 0, 0, 0), ("p.B", 0, 1, 0), ("p.C", 1, 1, 0), ("p.D", 0, 0, 1), ("p.E", 0, 0, 1)]
