"""Deterministic views of the star-schema tables as the engine's inputs.

files from part, edges from consecutive lineitems, imports from edges, a test tree from nation,
customer and supplier, changes from orders; and the import and fixture facts as Python source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from rippleframe import schemas
from rippleframe.operators.changes import virtual_paths

FACT_FILE = "path string, module string, is_package boolean, is_test boolean"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _named(key: Column, test: Column) -> tuple[Column, Column]:
    group, k = (key % 20).cast("string"), key.cast("string")
    path = F.when(test, F.concat(F.lit("tests/g"), group, F.lit("/test_m"), k, F.lit(".py"))).otherwise(F.concat(F.lit("src/g"), group, F.lit("/m"), k, F.lit(".py")))
    module = F.when(test, F.concat(F.lit("tests.g"), group, F.lit(".test_m"), k)).otherwise(F.concat(F.lit("g"), group, F.lit(".m"), k))
    return path, module


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, path, module, is_package, is_test): one for each part, and ten package initializers."""
    path, module = _named(F.col("p_partkey"), F.col("p_size") <= 5)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), path.alias("path"), module.alias("module"), F.lit(False).alias("is_package"), (F.col("p_size") <= 5).alias("is_test"))
    g = spark.range(0, 20, 2).select(F.col("id").cast("string").alias("g"))
    heads = g.select(F.lit(None).cast("long").alias("k"), F.concat(F.lit("src/g"), "g", F.lit("/__init__.py")).alias("path"), F.concat(F.lit("g"), "g").alias("module"), F.lit(True).alias("is_package"), F.lit(False).alias("is_test"))
    return rows.unionByName(heads)


def key_edges(spark: SparkSession, sf_dir: str, layered: bool = True, keep: Column | None = None) -> DataFrame:
    """(dependent, dependency) part keys of consecutive lines of an order; `keep` is a condition on the
    first line. Layered edges run from a key with the higher remainder by 8 to the lower, so they hold
    no cycle; the others run as the lines do."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    a = (lines if keep is None else lines.filter(keep)).select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("a"))
    pairs = a.join(lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("b")), ["l_orderkey", "l_linenumber"])
    if layered:
        pairs = pairs.filter(F.col("a") % 8 != F.col("b") % 8)
        up = F.col("a") % 8 > F.col("b") % 8
        pairs = pairs.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("dependent"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("dependency"))
    else:
        pairs = pairs.filter("a <> b").select(F.col("a").alias("dependent"), F.col("b").alias("dependency"))
    return pairs.distinct()


def path_edges(spark: SparkSession, sf_dir: str, layered: bool = True) -> DataFrame:
    names = files(spark, sf_dir).select("k", "path")
    e = key_edges(spark, sf_dir, layered)
    e = e.join(names.select(F.col("k").alias("dependent"), F.col("path").alias("from")), "dependent").join(names.select(F.col("k").alias("dependency"), F.col("path").alias("to")), "dependency")
    return e.select(F.col("from").alias("dependent"), F.col("to").alias("dependency"))


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part depends on the one before: a chain as long as the table."""
    return table(spark, sf_dir, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("dependent"), (F.col("p_partkey") - 1).alias("dependency"))


CHANGED_BRAND = "Brand#13"  # the changed files are the parts of one brand, about a 25th of the table


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_brand") == CHANGED_BRAND).select(F.col("p_partkey").alias("node"))


def path_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, _ = _named(F.col("p_partkey"), F.col("p_size") <= 5)
    return table(spark, sf_dir, "part").filter(F.col("p_brand") == CHANGED_BRAND).select(path.alias("node"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import rows of the layered edges: plain, from, relative and external forms."""
    names = files(spark, sf_dir).filter("k is not null")
    e = key_edges(spark, sf_dir)
    me, it = (names.select(F.col("k").alias(c), F.col("path").alias(f"{p}_path"), F.col("module").alias(f"{p}_module"), F.col("is_test").alias(f"{p}_test")) for c, p in (("dependent", "a"), ("dependency", "b")))
    e = e.join(me, "dependent").join(it, "dependency")
    f = (F.col("dependent") + F.col("dependency")) % 4
    near = (f == 2) & (F.col("dependent") % 20 == F.col("dependency") % 20) & (F.col("a_test") == F.col("b_test"))
    leaf, package = F.substring_index("b_module", ".", -1), F.regexp_replace("b_module", r"\.[^.]*$", "")
    kind = F.when((f == 1) | near, "from").otherwise("import")
    module = F.when(f == 3, F.concat(F.lit("ext"), (F.col("dependency") % 10).cast("string"), F.lit(".mod"))).when(f == 1, package).when(near, F.lit(None)).otherwise(F.col("b_module"))
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("a_path").orderBy("dependency"))
    return e.select(
        F.col("a_path").alias("path"), order.alias("ordinal"), kind.alias("kind"), module.alias("module"), F.when(kind == "from", leaf).alias("name"), F.when(near, 1).otherwise(0).alias("level"),
        F.lit(None).cast("string").alias("api"), F.lit(None).cast("string").alias("package"), F.lit(None).cast("array<string>").alias("fromlist"), F.lit(None).cast("string").alias("reason"), order.alias("line"), F.lit(1).alias("col"),
    )


def facts(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """schemas.FACTS of every file: its import rows (all of `imports`, or `rows`), and nothing else."""
    shape = {f.name: f.dataType.simpleString() for f in _parse_datatype_string(schemas.FACTS)}
    fields = [f.name for f in _parse_datatype_string(schemas.FACTS)["imports"].dataType.elementType]
    rows = (imports(spark, sf_dir) if rows is None else rows).groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("imports"))
    empty = {k: F.array().cast(v) for k, v in shape.items() if v.startswith("array")}
    out = files(spark, sf_dir).select("path").join(rows, "path", "left")
    return out.select("path", F.coalesce(F.col("imports").cast(shape["imports"]), empty["imports"]).alias("imports"), *[v.alias(k) for k, v in empty.items() if k != "imports"], F.lit(None).cast("string").alias("error"))


def import_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, source): the import rows as statements, one a line."""
    dots = F.repeat(F.lit("."), F.col("level"))
    text = F.when(F.col("kind") == "import", F.concat(F.lit("import "), "module")).otherwise(F.concat(F.lit("from "), dots, F.coalesce("module", F.lit("")), F.lit(" import "), "name"))
    rows = imports(spark, sf_dir).select("path", F.struct("ordinal", text.alias("t")).alias("x")).groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select("path", F.concat(F.array_join(F.transform("x", lambda x: x["t"]), "\n"), F.lit("\n")).alias("source"))


def test_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, fixtures, requests): tests of customers in nation folders below region folders, with
    conftests at every level; suppliers' fixtures in their nation's conftest, some in the region's."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = nation.select("n_nationkey", F.concat(F.lit("tests/"), "r_name").alias("rdir"), F.concat(F.lit("tests/"), "r_name", F.lit("/"), "n_name").alias("ndir"))
    tests = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat("ndir", F.lit("/test_c"), F.col("c_custkey").cast("string"), F.lit(".py")).alias("path"))
    conf = nation.select(F.explode(F.array(F.lit("tests"), "rdir", "ndir")).alias("d")).distinct().select(F.concat("d", F.lit("/conftest.py")).alias("path"))
    dotted = F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit("."))
    every = tests.select("path").withColumn("is_test", F.lit(True)).unionByName(conf.withColumn("is_test", F.lit(False)))
    every = every.select("path", dotted.alias("module"), F.lit(False).alias("is_package"), "is_test")
    supplier = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    fx = supplier.select("s_suppkey", F.concat("ndir", F.lit("/conftest.py")).alias("near"), F.when(F.col("s_suppkey") % 7 == 0, F.concat("rdir", F.lit("/conftest.py"))).alias("far"))
    fx = fx.select("s_suppkey", F.explode(F.array("near", "far")).alias("path")).filter("path is not null")
    fixtures = fx.select(
        "path", F.col("s_suppkey").cast("int").alias("ordinal"), F.concat(F.lit("fx"), (F.col("s_suppkey") % 10).cast("string")).alias("name"), (F.col("s_suppkey") % 11 == 0).alias("autouse"),
        F.lit(None).cast("string").alias("scope"), F.col("s_suppkey").cast("int").alias("line"), F.lit(1).alias("col"), F.array(F.concat(F.lit("fx"), ((F.col("s_suppkey") + 3) % 10).cast("string"))).alias("params"),
    )
    requests = tests.select("path", F.lit(0).alias("ordinal"), F.lit("fixture").alias("kind"), F.concat(F.lit("fx"), (F.col("c_custkey") % 10).cast("string")).alias("name"), F.lit(None).cast("string").alias("scope"), F.lit(1).alias("line"), F.lit(1).alias("col"))
    return every, fixtures, requests


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, kind, path, previous_path) of each order: the cheapest orders delete or rename, open
    ones add, all others modify."""
    names = files(spark, sf_dir).filter("k is not null").select("k", "path")
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    kind = F.when(F.col("o_totalprice") < 3000, "Deleted").when(F.col("o_totalprice") < 6000, "Renamed").when(F.col("o_orderstatus") == "O", "Added").otherwise("Modified")
    o = table(spark, sf_dir, "orders").join(F.broadcast(n)).select("o_orderkey", kind.alias("kind"), (F.col("o_custkey") % F.col("n")).alias("at"), ((F.col("o_custkey") + 1) % F.col("n")).alias("before"))  # a broadcast of one row
    o = o.join(names.select(F.col("k").alias("at"), "path"), "at").join(names.select(F.col("k").alias("before"), F.col("path").alias("previous_path")), "before")
    return o.select("o_orderkey", "kind", "path", F.when(F.col("kind") == "Renamed", F.col("previous_path")).alias("previous_path"))


def gone_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that some change deleted or renamed away."""
    return virtual_paths(changes(spark, sf_dir).withColumn("is_config", F.lit(False)))
