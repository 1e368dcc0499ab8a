"""Imports to local modules: candidate expansion, equi join, statuses and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.functions.paths import dotted_prefixes

IMPORT_FIELDS = ("kind", "module", "name", "level", "api", "package", "fromlist", "reason")


def import_struct() -> Column:
    return F.struct(*IMPORT_FIELDS).alias("import")


def _with_base(rows: DataFrame) -> DataFrame:
    """Adds `base`: the absolute module a `from` form starts at, null beyond the top level.

    A relative dynamic import is a `from` of its dots, anchored at its package or the importer."""
    dots = F.length("module") - F.length(F.regexp_replace("module", r"^\.+", ""))
    relative = (F.col("kind") == "dynamic") & F.col("module").startswith(".")
    anchored = relative & (F.coalesce("package", F.lit("")) != "")
    level = F.when(relative, F.greatest(dots, F.coalesce("level", F.lit(0)))).otherwise(F.coalesce("level", F.lit(0)))
    target = F.when(relative, F.nullif(F.regexp_replace("module", r"^\.+", ""), F.lit(""))).otherwise(F.col("module"))
    home = F.split(F.when(anchored, F.col("package")).otherwise(F.col("importer_module")), r"\.")
    home = F.when(anchored | F.col("importer_is_package"), home).otherwise(F.slice(home, 1, F.greatest(F.size(home) - 1, F.lit(0))))
    rows = rows.withColumns({"relative": F.coalesce(relative, F.lit(False)), "eff_level": level, "eff_module": target, "home": home})
    up = F.col("eff_level") - 1
    climbed = F.slice("home", 1, F.greatest(F.size("home") - up, F.lit(0)))
    joined = F.array_join(F.when(F.col("eff_module").isNotNull(), F.concat(climbed, F.split("eff_module", r"\."))).otherwise(climbed), ".")
    base = F.when(F.col("eff_level") <= 0, F.coalesce("eff_module", F.lit(""))).when(up <= F.size("home"), joined)
    return rows.withColumn("base", base).drop("home", "eff_module", "eff_level")


def candidates(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Every import row with `base`, sorted `candidates` and `failure`."""
    importers = files.select("path", F.col("module").alias("importer_module"), F.col("is_package").alias("importer_is_package"))
    rows = _with_base(imports.join(importers, "path"))
    base, name, module = F.col("base"), F.col("name"), F.col("module")
    leaf = F.when(name == "*", F.array().cast("array<string>")).otherwise(dotted_prefixes(F.when(base == "", name).otherwise(F.concat_ws(".", base, name))))
    nested = F.flatten(F.transform(F.filter(F.coalesce("fromlist", F.array().cast("array<string>")), lambda x: x != "*"), lambda x: dotted_prefixes(F.concat_ws(".", module, x))))
    found = (
        F.when(F.col("kind") == "import", dotted_prefixes(module))
        .when(F.col("relative"), dotted_prefixes(base))
        .when(F.col("kind") == "from", F.array_union(dotted_prefixes(base), leaf))
        .otherwise(F.array_union(dotted_prefixes(module), nested))
    )
    failure = (
        F.when((F.col("kind") == "dynamic") & module.isNull(), "unresolved_dynamic_import")
        .when(((F.col("kind") == "from") | F.col("relative")) & base.isNull(), "relative_beyond_top_level")
    )
    rows = rows.withColumn("failure", failure)
    return rows.withColumn("candidates", F.when(F.col("failure").isNull(), F.array_sort(F.array_distinct(found))).otherwise(F.array().cast("array<string>"))).drop("relative")


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Import rows with `candidates`, sorted `resolved` modules, `failure` and `status`.

    The row travels with each of its candidates, so the expansion is evaluated once; (path, ordinal)
    tell the rows apart."""
    rows = candidates(imports, files)
    local = files.select(F.col("module").alias("candidate"), F.lit(True).alias("hit")).distinct()
    carried = [c for c in rows.columns if c not in ("path", "ordinal", "candidates")]
    pairs = rows.select("path", "ordinal", F.struct(*carried).alias("row"), F.explode_outer("candidates").alias("candidate")).join(local, "candidate", "left")
    out = pairs.groupBy("path", "ordinal").agg(F.first("row").alias("row"), F.array_sort(F.collect_set("candidate")).alias("candidates"), F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("candidate")))).alias("resolved"))
    out = out.select("path", "ordinal", "row.*", "candidates", "resolved")
    status = (
        F.when(F.size("resolved") > 0, "resolved")
        .when(F.col("failure") == "relative_beyond_top_level", "invalid_relative_import")
        .when(F.col("failure") == "unresolved_dynamic_import", "unresolved_dynamic_import")
        .otherwise("unresolved")
    )
    return out.withColumn("status", status)


def unresolved(resolutions: DataFrame) -> DataFrame:
    """Imports without a local module, external ones included."""
    return resolutions.filter(F.size("resolved") == 0)


def base_module(resolutions: DataFrame) -> Column:
    """The deepest resolved prefix of the base of a `from` import."""
    inside = F.filter("resolved", lambda m: F.array_contains(dotted_prefixes(F.col("base")), m))
    deepest = F.array_max(F.transform(inside, lambda m: F.struct(F.size(F.split(m, r"\.")).alias("n"), m.alias("m"))))
    return F.when(F.col("base").isNotNull(), deepest["m"])


def import_evidence(resolutions: DataFrame, files: DataFrame) -> DataFrame:
    """One evidence row for each import and local module it executes, the importer itself excepted."""
    targets = files.select(F.col("module").alias("target"), F.col("path").alias("dependency"))
    rows = resolutions.select("path", "importer_module", "ordinal", "line", "col", import_struct(), "kind", F.explode("resolved").alias("target"))
    rows = rows.filter(F.col("target") != F.col("importer_module")).join(targets, "target")
    return rows.select(
        F.col("path").alias("dependent"), "dependency", F.lit(0).alias("stage"), F.col("ordinal").cast("long").alias("seq"),
        F.when(F.col("kind") == "dynamic", "dynamic_import").otherwise("import").alias("kind"), "line", "col", "import", F.lit(None).cast("string").alias("name"),
    )


def candidate_index(resolutions: DataFrame) -> DataFrame:
    """(module, importer): whom to resolve again when a module appears or goes."""
    return resolutions.select(F.explode("candidates").alias("module"), F.col("path").alias("importer")).distinct()


def importers_to_resolve(index: DataFrame, changed_modules: DataFrame) -> DataFrame:
    return index.join(changed_modules.select("module").distinct(), "module", "left_semi").select("importer").distinct()


def duplicate_modules(files: DataFrame) -> DataFrame:
    return files.groupBy("module").agg(F.array_sort(F.collect_list("path")).alias("paths")).filter(F.size("paths") > 1)
