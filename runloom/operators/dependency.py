"""How the files of a commit touch a test: its own file, its package, its module, its imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.session import stored

COLUMNS = ("test_file_touched", "import_overlap", "same_package", "changed_files_in_module", "dependency_parse_failed")
TEST_ROOT = "src/test/java/"


def package_of(path: Column) -> Column:
    """The Java package after the first source root, empty without one (and for the default package)."""
    inside = F.when(path.contains("src/main/java/"), F.regexp_extract(path, r"src/main/java/(.*)$", 1)).otherwise(F.regexp_extract(path, r"src/test/java/(.*)$", 1))
    return F.regexp_replace(F.regexp_extract(inside, r"^(.*)/[^/]*$", 1), "/", ".")


def class_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def java_class(path: Column) -> Column:
    """``class_name`` of a path that ends in ``.java``, without a pattern."""
    name = F.substring_index(path, "/", -1)
    return F.when(F.length(name) > 5, F.left(name, F.length(name) - 5)).otherwise(name)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def top_module(path: Column) -> Column:
    """The first directory, ``.`` for a file at the root."""
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(F.lit("."))


def modules(files: DataFrame, poms: DataFrame | None = None) -> DataFrame:
    """``files`` (repo, file_path, ...) with ``module``: the nearest directory above with a build file, else the top directory.

    poms: (repo, dir). Each path meets the build files through its ancestors, an equi-join.
    """
    if poms is None:
        return files.withColumn("module", top_module(F.col("file_path")))
    parts = F.split(directory(F.col("file_path")), "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    paths = files.select("repo", "file_path").distinct()
    found = paths.select("repo", "file_path", F.explode(F.array_distinct(ancestors)).alias("dir")).join(poms.distinct(), ["repo", "dir"])
    nearest = found.groupBy("repo", "file_path").agg(F.max_by("dir", F.length("dir")).alias("nearest"))
    return files.join(nearest, ["repo", "file_path"], "left").withColumn("module", F.coalesce("nearest", top_module(F.col("file_path")))).drop("nearest")


def test_sources(files: DataFrame, poms: DataFrame | None = None, located: DataFrame | None = None) -> DataFrame:
    """(repo, test_id, test_path, test_package, test_module): where each test was seen among the changed files, the shortest path first;
    ``located`` (repo, test_id, file_path) serves the tests that were not."""
    seen = files.where(F.col("file_path").contains(TEST_ROOT) & F.lower("file_path").endswith(".java")).select("repo", "file_path").distinct()
    test_id = F.regexp_replace(F.regexp_replace(F.regexp_extract("file_path", r"src/test/java/(.*)$", 1), r"\.[^./]*$", ""), "/", ".")
    first = seen.withColumn("test_id", test_id).groupBy("repo", "test_id").agg(F.min(F.struct(F.length("file_path").alias("n"), "file_path")).alias("s"))
    first = first.select("repo", "test_id", F.col("s.file_path").alias("file_path"))
    if located is not None:
        first = first.unionByName(located.join(first, ["repo", "test_id"], "left_anti"))
    paths = modules(first, poms)
    return paths.select("repo", "test_id", F.col("file_path").alias("test_path"), package_of(F.col("file_path")).alias("test_package"), F.col("module").alias("test_module"))


def path_of(test_id: Column) -> Column:
    """Where the source of a test stands by its name."""
    return F.concat(F.lit(TEST_ROOT), F.regexp_replace(test_id, r"\.", "/"), F.lit(".java"))


def located_sources(tests: DataFrame, sources: DataFrame) -> DataFrame:
    """(repo, test_id, file_path) of tests found among ``sources`` (repo, path): at the path of their name; else below a directory at
    that path; else a file of the same name under a test root; of several the shortest path.

    All candidates share the file's name, so this is an equi-join on it.
    """
    name = lambda c: F.substring_index(c, "/", -1)
    of = tests.select("repo", "test_id").distinct().withColumn("exact", path_of(F.col("test_id"))).withColumn("_file", name(F.col("exact")))
    at = sources.select("repo", F.col("path").alias("file_path"), name(F.col("path")).alias("_file")).distinct()
    path = F.col("file_path")
    rank = F.when(path == F.col("exact"), 0).when(path.endswith(F.concat(F.lit("/"), F.col("exact"))), 1).when(F.concat(F.lit("/"), path).contains("/" + TEST_ROOT), 2)
    found = of.join(at, ["repo", "_file"]).withColumn("_rank", rank).where(F.col("_rank").isNotNull())
    best = found.groupBy("repo", "test_id").agg(F.min(F.struct("_rank", F.length(path).alias("n"), "file_path")).alias("s"))
    return best.select("repo", "test_id", F.col("s.file_path").alias("file_path"))


def java_header(text: Column) -> tuple[Column, Column, Column]:
    """(package, imported names, whether it can be read) of a Java source: comments and strings are removed first; braces must balance."""
    bare = F.regexp_replace(text, r'(?s)/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"', " ")
    package = F.regexp_extract(bare, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    imports = F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"), F.lit(1)), lambda x: F.regexp_replace(x, r"\.\*$", "")))
    balanced = F.length(F.regexp_replace(bare, r"[^{]", "")) == F.length(F.regexp_replace(bare, r"[^}]", ""))
    return package, imports, text.isNotNull() & balanced & bare.contains("{")


def import_overlap(tests: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, commit_sha, test_id, import_overlap): how many changed Java files of the commit the test imports.

    imports: (repo, test_id, name). A name ending in ``.Class`` can only match the file Class.java, so this is an equi-join on
    the simple name.
    """
    simple = imports.select("repo", "test_id", F.element_at(F.split("name", r"\."), -1).alias("cls")).distinct()
    java = files.where(F.lower("file_path").endswith(".java")).select("repo", "commit_sha", "file_path", class_name(F.col("file_path")).alias("cls"))
    pairs = tests.join(simple, ["repo", "test_id"]).join(java, ["repo", "commit_sha", "cls"])
    return pairs.groupBy("repo", "commit_sha", "test_id").agg(F.count_distinct("file_path").alias("import_overlap"))


def dependency_features(tests: DataFrame, files: DataFrame, imports: DataFrame | None = None, poms: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """The five columns for each distinct (repo, commit_sha, test_id) of ``tests``; sources: (repo, path) of files that exist.

    A test whose source was never seen has zeros and dependency_parse_failed = 1. Files are counted per package
    and module of a commit before they meet the tests: no join of all tests with all files.
    """
    key = ["repo", "commit_sha"]
    tests = tests.select(*key, "test_id").distinct()
    placed = modules(files, poms).withColumn("package", package_of(F.col("file_path")))
    located = located_sources(tests, sources) if sources is not None else None
    out = tests.join(test_sources(files, poms, located), ["repo", "test_id"], "left")
    touched = files.select(*key, F.col("file_path").alias("test_path"), F.lit(1).alias("touched"))
    packages = placed.select(*key, F.col("package").alias("test_package"), F.lit(1).alias("same")).distinct()
    in_module = placed.groupBy(*key, F.col("module").alias("test_module")).agg(F.count("*").alias("in_module"))
    out = out.join(touched, [*key, "test_path"], "left").join(packages, [*key, "test_package"], "left").join(in_module, [*key, "test_module"], "left")
    if imports is not None:
        out = out.join(import_overlap(tests, imports, files), [*key, "test_id"], "left")
    else:
        out = out.withColumn("import_overlap", F.lit(0))
    seen = F.col("test_path").isNotNull()
    n = lambda c: F.when(seen, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("int")
    return out.select(
        *key,
        "test_id",
        n("touched").alias("test_file_touched"),
        n("import_overlap").alias("import_overlap"),
        n("same").alias("same_package"),
        n("in_module").alias("changed_files_in_module"),
        F.when(seen, 0).otherwise(1).alias("dependency_parse_failed"),
    )


SMALL = 1_000_000  # rows of up to five numbers that may be broadcast


def dependency_counts(runs: DataFrame, files: DataFrame, imports: DataFrame | None = None, poms: DataFrame | None = None, sources: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """(feature, value, n, failed): how many of the ``runs`` whose test has a known source, and of the failed ones, have each value of the columns of
    ``dependency_features``; all others have the columns' defaults. runs: repo, commit_sha, test_id, failed; they and files are stored.

    Runs and files meet in one aggregate by commit and path, package, module or importing test, each told by a hash: what the files say of a
    key is the value of its runs, so no row of the features is made. Tables of up to ``small`` rows of two to five numbers are broadcast, larger ones joined by a shuffle.
    """
    key, test, h = ["repo", "commit_sha"], ["repo", "test_id"], F.xxhash64
    runs = runs.where(F.col("commit_sha").isNotNull()).select(*key, "test_id", "failed")
    located = located_sources(runs, sources) if sources is not None else None
    at_hand = lambda df: F.broadcast(df) if df.count() <= small else df
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    of_file = lambda df: df.select("commit", "kind", "key", one.alias("files"), zero.alias("n"), zero.alias("failed"))
    keys = lambda *c: F.posexplode(F.array(*c)).alias("kind", "key")
    sums = lambda *c: [F.sum(x).alias(x) for x in c]

    known = test_sources(files, poms, located).select(h(*test).alias("test"), *[h(c).alias(c) for c in ("test_path", "test_package", "test_module")])
    placed = modules(files, poms).select(h(*key).alias("commit"), keys(h("file_path"), h(package_of(F.col("file_path"))), h("module")))
    said = of_file(placed)
    if imports is None:
        known = known.withColumn("importing", F.lit(None).cast("bigint"))
    else:
        of_class = h("repo", F.element_at(F.split("name", r"\."), -1))
        links = stored(imports.select(of_class.alias("class"), h(*test).alias("importing")).distinct(), "imports")
        known = known.join(links.select("importing").distinct(), F.col("test") == F.col("importing"), "left")
        java = files.where(F.lower("file_path").endswith(".java")).select(h(*key).alias("commit"), h("repo", java_class(F.col("file_path"))).alias("class"))
        said = said.unionByName(of_file(java.join(at_hand(links), "class").select("commit", F.lit(3).alias("kind"), F.col("importing").alias("key"))))
    known = stored(known, "sources")
    seen = runs.withColumn("test", h(*test)).join(at_hand(known), "test")
    of_runs = seen.select(h(*key).alias("commit"), keys("test_path", "test_package", "test_module", "importing"), zero.alias("files"), one.alias("n"), F.col("failed").cast("bigint").alias("failed"))
    met = of_runs.where(F.col("key").isNotNull()).unionByName(said).groupBy("commit", "kind", "key").agg(*sums("files", "n", "failed")).where("n > 0")
    value = F.when(F.col("kind").isin(2, 3), F.col("files")).otherwise(F.least("files", one)).cast("double")
    found = stored(met.groupBy("kind", value.alias("value")).agg(*sums("n", "failed")), "dependencies", tidy=True)
    names = F.array(*map(F.lit, ("test_file_touched", "same_package", "changed_files_in_module", "import_overlap")))
    out = found.select(F.get(names, F.col("kind")).alias("feature"), "value", "n", "failed")
    in_modules = found.where("kind = 2").agg(*sums("n", "failed")).where("n > 0")  # every run that is seen has one module
    return out.unionByName(in_modules.select(F.lit("dependency_parse_failed").alias("feature"), F.lit(0.0).alias("value"), "n", "failed"))
