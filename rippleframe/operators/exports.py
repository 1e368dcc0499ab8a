"""Re-exports: a monotone fixed point over wildcard chains, then equi joins with the imports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.operators.loops import cut, cut_counted
from rippleframe.operators.resolve import base_module, import_struct, resolve


def export_index(declarations: DataFrame, files: DataFrame) -> DataFrame:
    """(module, name, target): the local modules that a name imported from a module may come from."""
    forms = declarations.select(
        "path", "ordinal", F.col("name").alias("exported"), "wildcard", F.lit("from").alias("kind"), "module", F.lit("*").alias("name"), "level",
        F.lit(None).cast("string").alias("package"), F.lit(None).cast("array<string>").alias("fromlist"),
    )
    rows = resolve(forms, files)
    rows = rows.withColumn("target", F.when(F.col("module").isNotNull(), base_module(rows)))
    wild = rows.filter("wildcard and target is not null").select(F.col("importer_module").alias("module"), "target").filter("module <> target").distinct()
    own = rows.filter(~F.col("wildcard") & F.col("exported").isNotNull())
    sub = files.select(F.col("module").alias("submodule"))
    own = own.withColumn("submodule", F.concat_ws(".", "importer_module", "exported")).join(sub.withColumn("is_module", F.lit(True)), "submodule", "left")
    fallback = F.when(F.col("module").isNull(), F.when(F.col("is_module"), F.col("submodule")).otherwise(F.col("importer_module")))
    known = own.select(F.col("importer_module").alias("module"), F.col("exported").alias("name"), F.coalesce("target", fallback).alias("target")).filter("target is not null").distinct()
    through = wildcard_closure(wild)
    if through is None:
        return known
    known = cut(known)
    passed = through.select(F.col("module").alias("to"), F.col("target").alias("module")).join(known, "module").select(F.col("to").alias("module"), "name", "target")
    return known.unionByName(passed).distinct()


def wildcard_closure(wild: DataFrame) -> DataFrame | None:
    """(module, target): all modules that a module's `*` imports reach, by doubling: every round doubles
    the length of the chains that are known. None without any."""
    reach, count = cut_counted(wild)
    if not count:
        return None
    while True:
        ahead = reach.select(F.col("module").alias("target"), F.col("target").alias("far"))
        longer = reach.join(ahead, "target").select("module", F.col("far").alias("target")).filter("module <> target")
        reach, now = cut_counted(reach.unionByName(longer).distinct())
        if now == count:
            return reach
        count = now


def reexport_evidence(resolutions: DataFrame, exports: DataFrame, files: DataFrame) -> DataFrame:
    """Evidence from an importer to the modules behind the names it takes from a package."""
    rows = resolutions.filter("kind = 'from'").select("path", "ordinal", "line", "col", import_struct(), F.col("name").alias("taken"), base_module(resolutions).alias("module")).filter("module is not null")
    named = rows.filter("taken <> '*'").join(exports.withColumnRenamed("name", "taken"), ["module", "taken"])
    starred = rows.filter("taken = '*'").join(exports.select("module", "target").distinct(), "module")
    both = named.unionByName(starred.select(*named.columns))
    targets = files.select(F.col("module").alias("target"), F.col("path").alias("dependency"))
    both = both.join(targets, "target").filter("path <> dependency")
    return both.select(
        F.col("path").alias("dependent"), "dependency", F.lit(1).alias("stage"), F.col("ordinal").cast("long").alias("seq"),
        F.lit("re_export").alias("kind"), "line", "col", "import", F.col("taken").alias("name"),
    ).distinct()
