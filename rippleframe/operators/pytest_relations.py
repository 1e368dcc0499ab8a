"""Test-framework relations: conftest visibility, fixtures, plugins. All joins are equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.functions.paths import directory, file_name

_NO_IMPORT = "cast(null as struct<kind:string,module:string,name:string,level:int,api:string,package:string,fromlist:array<string>,reason:string>) as import"


def _ancestor_conftests(path: Column) -> Column:
    """conftest.py of the own directory first, then of each directory above."""
    parts = F.when(directory(path) == "", F.array().cast("array<string>")).otherwise(F.split(directory(path), "/"))
    dirs = F.transform(parts, lambda p, i: F.array_join(F.slice(parts, 1, F.size(parts) - i), "/"))
    return F.concat(F.transform(dirs, lambda d: F.concat(d, F.lit("/conftest.py"))), F.array(F.lit("conftest.py")))


def visible_files(paths: DataFrame, files: DataFrame) -> DataFrame:
    """(path, provider, distance): the file itself (-1), then its conftests, nearest first."""
    conftests = files.filter(file_name(F.col("path")) == "conftest.py").select(F.col("path").alias("provider"))
    above = paths.select("path", F.posexplode(_ancestor_conftests(F.col("path"))).alias("distance", "provider")).join(conftests, "provider")
    return paths.select("path", F.col("path").alias("provider"), F.lit(-1).alias("distance")).unionByName(above.select("path", "provider", "distance"))


def conftest_visibility(files: DataFrame) -> DataFrame:
    """(path, provider, distance) of tests and the conftests above them."""
    return visible_files(files.filter("is_test").select("path"), files).filter("distance >= 0 and path <> provider")


def _first(fixtures: DataFrame) -> DataFrame:
    """The first fixture of each file, name and scope: no later one is the nearest to any request."""
    first = F.min(F.struct("ordinal", "line", "col")).alias("x")
    return fixtures.groupBy("path", "name", "scope").agg(first).select("path", "name", "scope", "x.ordinal", "x.line", "x.col")


def requested_fixtures(files: DataFrame, requests: DataFrame, fixtures: DataFrame, visible: DataFrame) -> DataFrame:
    """(path, name, kind, scope, line, col): the last request of a name in a test, else an autouse fixture."""
    tests = files.filter("is_test").select("path")
    rank = F.when(F.col("kind") == "usefixtures", 1).otherwise(0)
    last = Window.partitionBy("path", "name").orderBy(rank.desc(), F.col("ordinal").desc())
    own = requests.join(tests, "path", "left_semi").withColumn("r", F.row_number().over(last)).filter("r = 1")
    kind = F.when(F.col("kind") == "usefixtures", "pytest_usefixtures").otherwise("pytest_fixture")
    own = own.select("path", "name", kind.alias("kind"), "scope", "line", "col")
    automatic = _first(fixtures.filter("autouse")).select(F.col("path").alias("provider"), "ordinal", "name", "scope", "line", "col")
    offered = visible.join(tests, "path", "left_semi").join(automatic, "provider")
    scopes = requests.filter("kind = 'fixture' and scope is not null").select("path", "scope").distinct().withColumn("used", F.lit(True))
    offered = offered.join(scopes, ["path", "scope"], "left").filter("scope is null or used")
    nearest = F.min(F.struct("distance", "ordinal", "scope", "line", "col")).alias("x")
    offered = offered.groupBy("path", "name").agg(nearest).select("path", "name", "x.scope", "x.line", "x.col").join(own.select("path", "name"), ["path", "name"], "left_anti")
    return own.unionByName(offered.select("path", "name", F.lit("pytest_fixture").alias("kind"), "scope", "line", "col"))


def visible_fixture(requests: DataFrame, visible: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Each request with the nearest fixture of its name: `provider`, `distance`, `f_line`, `f_col`.

    `requests` has path, rid (unique in a path), name, scope; a scoped fixture serves its own scope only."""
    named = _first(fixtures).select(F.col("path").alias("provider"), "name", F.col("ordinal").alias("f_ordinal"), F.col("scope").alias("f_scope"), F.col("line").alias("f_line"), F.col("col").alias("f_col"))
    pairs = requests.join(visible, "path").join(named, ["provider", "name"])
    pairs = pairs.filter(F.col("f_scope").isNull() | (F.col("f_scope") == F.col("scope")))
    nearest = Window.partitionBy("path", "rid").orderBy("distance", "f_ordinal")
    return pairs.withColumn("r", F.row_number().over(nearest)).filter("r = 1").drop("r", "f_scope", "f_ordinal")


def _evidence(rows: DataFrame, stage: int, kind: Column, line: Column, col: Column, name: Column, seq: Column) -> DataFrame:
    out = rows.filter("path <> provider")
    return out.select(F.col("path").alias("dependent"), F.col("provider").alias("dependency"), F.lit(stage).alias("stage"), seq.cast("long").alias("seq"), kind.alias("kind"), line.alias("line"), col.alias("col"), F.expr(_NO_IMPORT), name.alias("name"))


def fixture_edges(files: DataFrame, requests: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Tests to the files whose fixtures serve them; the location is the later of request and fixture."""
    visible = visible_files(files.select("path"), files)
    wanted = requested_fixtures(files, requests, fixtures, visible).withColumn("rid", F.col("name"))
    found = visible_fixture(wanted, visible, fixtures)
    place = F.greatest(F.struct(F.col("line"), F.col("col")), F.struct(F.col("f_line").alias("line"), F.col("f_col").alias("col")))
    return _evidence(found.withColumn("place", place), 3, F.col("kind"), F.col("place.line"), F.col("place.col"), F.col("name"), F.lit(0))


def fixture_dependencies(files: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Fixture parameters to the nearest fixture of that name, seen from the fixture's own file."""
    asked = fixtures.select("path", "scope", "ordinal", F.posexplode("params").alias("at", "name")).withColumn("rid", F.struct("ordinal", "at"))
    found = visible_fixture(asked, visible_files(fixtures.select("path").distinct(), files), fixtures)
    return _evidence(found, 5, F.lit("pytest_fixture"), F.col("f_line"), F.col("f_col"), F.col("name"), F.lit(0)).distinct()


def plugin_edges(files: DataFrame, plugins: DataFrame) -> DataFrame:
    local = files.select(F.col("module").alias("name"), F.col("path").alias("provider"))
    return _evidence(plugins.join(local, "name"), 4, F.lit("pytest_plugin"), F.col("line"), F.col("col"), F.col("name"), F.col("ordinal"))


def pytest_evidence(files: DataFrame, requests: DataFrame, fixtures: DataFrame, plugins: DataFrame) -> DataFrame:
    seen = _evidence(conftest_visibility(files), 2, F.lit("pytest_configuration"), F.lit(1), F.lit(1), F.lit("conftest visibility"), F.col("distance"))
    out = seen.unionByName(fixture_edges(files, requests, fixtures)).unionByName(plugin_edges(files, plugins))
    return out.unionByName(fixture_dependencies(files, fixtures))
