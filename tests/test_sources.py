import pytest

from runloom.operators import ingest
from runloom.sources import projects as P
from tests.conftest import rows

MAIN = "﻿travisJobId,testName,index,duration,count,failures,errors,skipped,more\n1,a.T,0,0.5,2,0,0,0,x\n1,a.T,1,9,2,1,0,0,x\n2,b.T,3.7,x,,,,,\n3,c.T,0,1,2,0,0,2,x\n"


@pytest.fixture
def root(tmp_path):
    d = tmp_path / "own@proj"
    d.mkdir()
    (d / "own@proj.csv").write_text(MAIN, encoding="utf-8")
    (d / "own@proj-patches.csv").write_text("sha,name\ns1,a.java\ns1,a.java\n,b\ns2,\n")
    other = tmp_path / "x@y"
    other.mkdir()
    (other / "a-offenders.csv").write_text(MAIN)
    (other / "z.csv").write_text(MAIN)
    (tmp_path / "no@main").mkdir()
    return tmp_path


def test_discovery(spark, root):
    assert [p.rsplit("/", 1)[1] for p in P.project_folders(spark, str(root))] == ["own@proj", "x@y"]
    assert P.find_main_csv(spark, str(root / "x@y")).endswith("z.csv")
    assert P.find_patches_csv(spark, str(root / "own@proj")).endswith("own@proj-patches.csv")
    assert P.find_patches_csv(spark, str(root / "x@y")) is None


def test_results_to_runs(spark, root):
    df = P.read_results(spark, str(root / "own@proj/own@proj.csv"), "own@proj")
    got = rows(df, "job_id", "test_id", "test_index", "duration_ms", "run_count")
    assert got == [("1", "a.T", 0, 500.0, 2), ("1", "a.T", 1, 9000.0, 2), ("2", "b.T", 3, None, 0), ("3", "c.T", 0, 1000.0, 2)]
    (root / "m.csv").write_text("tr_job_id,git_commit_id\n1,old\n1,new\n2,\n")
    mapping = P.read_mapping(spark, str(root / "m.csv"))
    assert rows(mapping) == [("1", "new")]
    assert tuple(P.dry_run(df, mapping).first()) == (4, 2, 1, 0, 0.5, 0.25, True)
    patches = P.read_patches(spark, str(root / "own@proj/own@proj-patches.csv"), "r")
    assert tuple(P.dry_run(df.limit(0), mapping, patches).first()) == (0, 0, 0, 1, 0.0, 0.0, False)
    outcome = rows(df.withColumn("outcome", ingest.derived_outcome()), "line_id", "outcome")
    assert [o for _, o in outcome] == ["PASS", "FAIL", "PASS", "SKIPPED"]
    whole = P.load_totals(P.dry_run(df, mapping, patches).unionByName(P.dry_run(df.limit(0), mapping)))
    assert tuple(whole.first()) == (4, 2, 1, 1, 0.5, 0.25, True)
    (root / "bad.csv").write_text("testName\nx\n")
    with pytest.raises(ValueError, match="missing columns"):
        P.read_results(spark, str(root / "bad.csv"), "r")


def test_patches_offenders_and_git(spark, root):
    assert rows(P.read_patches(spark, str(root / "own@proj/own@proj-patches.csv"), "r")) == [("r", "s1", "a.java")]
    (root / "off.csv").write_text("tr_job_id\n007\n7\nx\n")
    assert rows(P.read_offenders(spark, str(root / "off.csv"))) == [("7",)]
    (root / "log.txt").write_text("abc 12\nbad\nabc 12\n")
    assert rows(P.read_git_log(spark, str(root / "log.txt"), "r")) == [("r", "abc", 12)]
    (root / "later.txt").write_text("abc 99\ndef 5\nghi 6\n")
    needed = spark.createDataFrame([("abc",), ("def",)], "commit_sha string")
    assert rows(P.read_git_log(spark, str(root / "log.txt"), "r", needed, str(root / "later.txt"))) == [("r", "abc", 12), ("r", "def", 5)]
    (root / "num.txt").write_text("abc\t1\t-\tp/x.java\nbad\nabc\t7\t0\tp/x.java\t2\n")
    assert rows(P.read_numstat(spark, str(root / "num.txt"), "r")) == [("r", "abc", 1, "1", "-", "p/x.java"), ("r", "abc", 2, "7", "0", "p/x.java")]
    (root / "src").mkdir()
    (root / "src/X.java").write_text("class X {}")
    now = P.read_sources(spark, str(root / "src"), "r")
    assert rows(now) == [("r", None, "X.java", "class X {}")]
    (root / "old").mkdir()
    (root / "old/X.java").write_text("class X0 {}")
    both = now.unionByName(P.read_sources(spark, str(root / "old"), "r", "s1"))
    wanted = spark.createDataFrame([("r", "s1", "X.java"), ("r", "s2", "X.java"), ("r", "s1", "Y.java")], "repo string, commit_sha string, path string")
    assert rows(P.sources_at(both, wanted), "commit_sha", "text") == [("s1", "class X0 {}"), ("s2", "class X {}")]


def test_reports(spark, root):
    df = spark.createDataFrame([("own@proj", 1.5), ("x", None)], "project string, rate double")
    assert P.markdown_table(df) == "| project | rate |\n|---|---|\n| own@proj | 1.5 |\n| x |  |"
    summary = "# x\n| Project | Builds | Tests | Failure Rate | Status |\n|---|---|---|---|---|\n| own@proj | 10 | 1,020 | 2.0% | SELECTED |\n| q | 10 | 20 | 0.2% | NOT SELECTED (rate) |\n| r | 1 | 2 | SELECTED |\n"
    (root / "s.md").write_text(summary)
    assert rows(P.read_selected(spark, str(root / "s.md"))) == [("own@proj",)]
    with pytest.raises(ValueError):
        P.markdown_table(spark.range(5), most=3)


def test_names_and_formats(spark):
    assert P.wanted_projects(["b,a", "c b"], ["z"]) == ["b", "a", "c"] and P.wanted_projects([], ["z", "z"]) == ["z"] and P.wanted_projects([]) == []
    df = spark.createDataFrame([("0123456789abc", 0.125, 1234567)], "sha string, share double, n bigint")
    assert tuple(df.select(P.short_sha("sha"), P.percent("share"), P.thousands("n")).first()) == ("01234567", "12.5%", "1,234,567")
    got = P.report_rows(spark.createDataFrame([("b", None), (None, 1), ("b", 2), ("a", 3)], "repo string, n int"), "repo").collect()
    assert [tuple(r) for r in got] == [("a", 3), ("b", 2), ("b", None), (None, 1)]


def test_write_once(spark, root):
    out = str(root / "out")
    assert P.write_once(spark.range(3), out) and not P.write_once(spark.range(5), out)
    assert spark.read.parquet(out).count() == 3 and P.write_once(spark.range(5), out, force=True)
    assert spark.read.parquet(out).count() == 5


def test_insert_new(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, "z"), (2, "w")], "k int, v string")
    assert [r.k for r in ingest.insert_new(a, b, ["k"]).collect()] == [2]


def test_append_new_counts(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "x")], "k int, v string").write.parquet(path)
    b = spark.createDataFrame([(1, "y"), (2, "z"), (2, "w"), (3, "u")], "k int, v string")
    assert ingest.append_new(b, path, ["k"]) == 2 and ingest.append_new(b, path, ["k"]) == 0
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_reports_in_xml(spark, tmp_path):
    (tmp_path / "TEST-a.xml").write_text(
        '<?xml version="1.0"?><testsuite name="s"><testcase classname="p.A" name="x" time="0.5"/><testcase classname="p.A" name="y" time="0.25"><failure message="m">trace</failure></testcase>'
        '<testcase classname="p.B" name="z" time="1"><skipped/></testcase><testcase classname="p.C" name="z" time="1"/></testsuite>'
    )
    got = rows(P.read_test_reports(spark, str(tmp_path / "*.xml"), "r", 7), "test_id", "job_id", "outcome", "duration_ms", "run_count")
    assert got == [("p.A", 7, "FAIL", 750.0, 2), ("p.B", 7, "SKIPPED", 1000.0, 1), ("p.C", 7, "PASS", 1000.0, 1)]
