"""Change rows (kind, path, previous_path, is_config): decoding, relevance, exclusion, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.functions.paths import discoverable

CONFIG = "pyproject.toml"  # fixed value: the configuration file at the root


def relevant(path: Column) -> Column:
    return path.endswith(".py") | (path == CONFIG)


def _rows(kind: str, path: Column, previous: Column | None = None) -> Column:
    return F.array(F.struct(F.lit(kind).alias("kind"), path.alias("path"), (previous if previous is not None else F.lit(None).cast("string")).alias("previous_path")))


def _explode(changes: DataFrame, rows: Column) -> DataFrame:
    return changes.select(F.explode(rows).alias("c")).select("c.*")


def relevant_changes(changes: DataFrame) -> DataFrame:
    """Python files and the root configuration only; a rename between the two kinds, or from or to
    anything else, becomes a removal and an addition."""
    path, before = F.col("path"), F.col("previous_path")
    none = F.array().cast("array<struct<kind:string,path:string,previous_path:string>>")
    config = lambda p: p == CONFIG
    same = relevant(path) & relevant(before) & (config(path) == config(before))
    halves = F.concat(F.when(relevant(before), _rows("Deleted", before)).otherwise(none), F.when(relevant(path), _rows("Added", path)).otherwise(none))
    plain = F.array(F.struct("kind", "path", F.lit(None).cast("string").alias("previous_path")))
    rows = F.when(F.col("kind") == "Renamed", F.when(same, _rows("Renamed", path, before)).otherwise(halves)).when(relevant(path), plain).otherwise(none)
    return _explode(changes, rows).withColumn("is_config", (F.col("path") == CONFIG) | (F.coalesce("previous_path", F.lit("")) == CONFIG)).distinct()


def exclude_changes(changes: DataFrame, patterns: list[str]) -> DataFrame:
    """Renames out of the exclusions become Added, into them Deleted; excluded changes vanish."""
    path, before = F.col("path"), F.col("previous_path")
    none = F.array().cast("array<struct<kind:string,path:string,previous_path:string>>")
    inside = lambda p: (p == CONFIG) | discoverable(p, patterns)
    renamed = F.when(inside(path) & inside(before), _rows("Renamed", path, before)).when(inside(path), _rows("Added", path)).when(inside(before), _rows("Deleted", before)).otherwise(none)
    plain = F.array(F.struct("kind", "path", F.lit(None).cast("string").alias("previous_path")))
    rows = F.when(F.col("kind") == "Renamed", renamed).when(inside(path), plain).otherwise(none)
    return _explode(changes, rows).withColumn("is_config", (F.col("path") == CONFIG) | (F.coalesce("previous_path", F.lit("")) == CONFIG)).distinct()


def analysis_paths(changes: DataFrame) -> DataFrame:
    """All Python identities that a change touches, former names included."""
    both = changes.filter("not is_config").select(F.explode(F.array("path", "previous_path")).alias("path"))
    return both.filter("path is not null").distinct()


def virtual_paths(changes: DataFrame) -> DataFrame:
    """Identities that no longer exist: deleted files and former names."""
    gone = F.when(F.col("kind") == "Deleted", F.col("path")).when(F.col("kind") == "Renamed", F.col("previous_path"))
    return changes.filter("not is_config").select(gone.alias("path")).filter("path is not null").distinct()


def configuration_paths(changes: DataFrame) -> DataFrame:
    both = changes.filter("is_config").select(F.explode(F.array("path", "previous_path")).alias("path"))
    return both.filter(F.col("path") == CONFIG).distinct()


def ordered(changes: DataFrame) -> DataFrame:
    return changes.distinct().orderBy(F.coalesce("previous_path", F.lit("")), "path")
