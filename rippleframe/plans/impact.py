"""Impact, affected tests, full-validation reasons and validation plans over the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.operators.graph import direct_dependents, reverse_closure


def impact(edges: DataFrame, files: DataFrame, changed: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(path, class, is_test, caused_by): class is direct, transitive or changed (changed tests only
    appear among the affected as their own cause). `changed` has column `node`; a test is what the
    current `files` say is one."""
    pairs = reverse_closure(edges, changed) if closure is None else closure
    tests = files.filter("is_test").select(F.col("path").alias("node"), F.lit(True).alias("is_test"))
    own = changed.select("node").distinct()
    causes = pairs.select("node", F.col("seed").alias("cause"))
    causes = causes.unionByName(own.join(tests, "node", "left_semi").select("node", F.col("node").alias("cause")))
    listed = causes.groupBy("node").agg(F.array_sort(F.collect_set("cause")).alias("caused_by"))
    near = direct_dependents(edges, own).withColumn("near", F.lit(True))
    kept = listed.join(near, "node", "left").join(own.withColumn("own", F.lit(True)), "node", "left").join(tests, "node", "left")
    kept = kept.withColumns({"is_test": F.coalesce("is_test", F.lit(False)), "own": F.coalesce("own", F.lit(False))}).filter("not own or is_test")
    cls = F.when(F.col("own"), "changed").when(F.col("near"), "direct").otherwise("transitive")
    return kept.select(F.col("node").alias("path"), cls.alias("class"), "is_test", "caused_by")


def affected_tests(impacted: DataFrame) -> DataFrame:
    return impacted.filter("is_test").select("path")


def file_reasons(uncertainty: DataFrame, imports: DataFrame) -> DataFrame:
    """(path, reason): why a file's relations cannot be known, the weightiest of each file."""
    rank = F.when(F.col("kind") == "exports", F.struct(F.lit(1).alias("r"), F.lit("unsupported_exports").alias("reason"))).otherwise(F.struct(F.lit(0).alias("r"), F.lit("unsupported_pytest_relationship").alias("reason")))
    dynamic = imports.filter("kind = 'dynamic' and module is null").select("path", F.struct(F.lit(2).alias("r"), F.lit("unresolved_dynamic_import").alias("reason")).alias("w"))
    rows = uncertainty.select("path", rank.alias("w")).unionByName(dynamic)
    return rows.groupBy("path").agg(F.min("w").alias("w")).select("path", F.col("w.reason").alias("reason"))


def full_validation(changed: DataFrame, closure: DataFrame, reasons: DataFrame) -> DataFrame:
    """At most one row (reason, path): the first uncertain file, changed ones first, then by path."""
    own = changed.select(F.col("node").alias("path")).distinct().withColumn("later", F.lit(0))
    rest = closure.select(F.col("node").alias("path")).distinct().withColumn("later", F.lit(1))
    found = own.unionByName(rest).join(reasons, "path")
    first = found.agg(F.min_by(F.struct("reason", "path"), F.struct("later", "path")).alias("f"))
    return first.filter("f is not null").select("f.*")


def plan(impacted: DataFrame, full: DataFrame) -> DataFrame:
    """One row (mode, program, targets): full runs everything, none nothing, selective the tests."""
    listed = affected_tests(impacted).agg(F.array_sort(F.collect_set("path")).alias("selected"))
    both = listed.join(F.broadcast(full.agg(F.count("*").alias("uncertain"))))  # one row each
    mode = F.when(F.col("uncertain") > 0, "full").when(F.size("selected") == 0, "none").otherwise("selective")
    return both.select(mode.alias("mode"), F.when(mode != "none", F.lit("pytest")).alias("program"), F.when(mode == "selective", F.col("selected")).otherwise(F.array().cast("array<string>")).alias("targets"), F.col("selected").alias("selected_test_targets"))


def graph_summary(files: DataFrame, resolutions: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row: files, modules, import edges, tests, unresolved imports."""
    a = files.agg(F.count("*").alias("files"), F.count_distinct("module").alias("modules"), F.count_if("is_test").alias("tests"))
    edges = evidence.filter(F.col("kind").isin("import", "dynamic_import", "re_export")).select("dependent", "dependency").distinct().agg(F.count("*").alias("import_edges"))
    lost = resolutions.agg(F.count_if(F.size("resolved") == 0).alias("unresolved_imports"))
    return a.join(F.broadcast(edges)).join(F.broadcast(lost)).select("files", "modules", "import_edges", "tests", "unresolved_imports")  # one row each


def summary_delta(previous: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Counters of `previous` less those of the removed rows plus those of the added, never below 0."""
    cols = previous.columns
    both = previous.select(*[F.col(c).alias(f"p_{c}") for c in cols])
    both = both.join(F.broadcast(removed.select(*[F.col(c).alias(f"r_{c}") for c in cols]))).join(F.broadcast(added.select(*[F.col(c).alias(f"a_{c}") for c in cols])))  # one row each
    return both.select(*[(F.greatest(F.col(f"p_{c}") - F.col(f"r_{c}"), F.lit(0)) + F.col(f"a_{c}")).alias(c) for c in cols])


def truncated(listing: DataFrame, column: str, limit: int = 25) -> DataFrame:
    """The first rows in order and how many there are: the human listing's cut."""
    total = listing.agg(F.count("*").alias("total"))
    first = listing.select(column).orderBy(column).limit(limit).join(F.broadcast(total))  # a broadcast of one row
    return first.select(column, "total", F.greatest(F.col("total") - limit, F.lit(0)).alias("more")).orderBy(column)


def benchmark_statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, min, max, median, p25, p75, p95 with linear interpolation."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.95)]))
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), p.alias("p"))
    return out.select(*keys, "n", "min", "max", *[F.col("p")[i].alias(n) for i, n in enumerate(("p25", "median", "p75", "p95"))])
