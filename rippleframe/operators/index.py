"""Persistent index: tables in segments, made current by replacing one manifest.

A table is a first segment with all its rows and later segments that replace the rows of some
owners (`keys`); reading leaves out the rows whose owner a later segment names. So a commit
writes what changed, and a table with too many segments is written whole again. The store is
on a file system that driver and executors share. Reading never sees half a commit: segments
are written first, then the manifest is replaced; folders that neither the current nor the
previous manifest names are removed."""

from __future__ import annotations

import json
import os
import shutil
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.operators.loops import cut_counted

VERSION = 2
SEGMENTS = 8  # of a table, then it is written whole
LOCK_SECONDS = 3600  # an older lock was left by a process that died
OWNER = {"evidence": "dependent", "edges": "dependent", "candidates": "importer"}  # column of the owning path, else `path`


class IndexStore:
    def __init__(self, folder: str):
        self.folder = folder
        self.path, self.lock = os.path.join(folder, "manifest.json"), os.path.join(folder, "lock")

    def manifest(self) -> dict | None:
        """None where there is none; {} where it can't be read."""
        try:
            with open(self.path, encoding="utf-8") as f:
                found = json.load(f)
            return found if isinstance(found, dict) else {}
        except FileNotFoundError:
            return None
        except (OSError, ValueError):
            return {}

    def why_not(self, config: str, roots: list[str], repository: str) -> str | None:
        """The reason a full build is needed, or None."""
        m = self.manifest()
        if self.locked():
            return "locked"
        if m is None:
            return "missing"
        if not m:
            return "corrupt"
        if m.get("version") != VERSION:
            return "incompatible"
        if m.get("repository") != repository:
            return "repository_changed"
        if m.get("config") != config:
            return "configuration_changed"
        if m.get("roots") != roots:
            return "source_roots_remapped"
        if not m.get("baseline"):
            return "no_baseline"
        if not all(os.path.isdir(os.path.join(self.folder, x)) for s in m.get("tables", {"": [{"rows": "?"}]}).values() for part in s for x in part.values() if x):
            return "corrupt"
        return None

    def locked(self) -> bool:
        try:
            return time.time() - os.stat(self.lock).st_mtime < LOCK_SECONDS
        except FileNotFoundError:
            return False

    def _hold(self) -> None:
        os.makedirs(self.folder, exist_ok=True)
        if not self.locked() and os.path.exists(self.lock):
            os.remove(self.lock)
        os.close(os.open(self.lock, os.O_CREAT | os.O_EXCL))

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        load = lambda x: spark.read.parquet(os.path.join(self.folder, x))
        segments, owner, out = self.manifest()["tables"][name], OWNER.get(name, "path"), []
        for i, part in enumerate(segments):
            rows, later = load(part["rows"]), [load(x["keys"]) for x in segments[i + 1 :]]
            if later:
                later = reduce(lambda a, b: a.union(b), later).distinct()
                rows = rows.join(later.select(F.col("path").alias(owner)), owner, "left_anti").select(*rows.columns)
            out.append(rows)
        return reduce(lambda a, b: a.unionByName(b), out)

    def commit(self, whole: dict[str, DataFrame], parts: dict[str, tuple[DataFrame, DataFrame]] | None = None, full: dict | None = None, **facts) -> tuple[int, int]:
        """Write a generation and make it current: tables as a `whole`, or (rows, keys of the owners that they
        replace) in `parts`; of a table with SEGMENTS segments the frame in `full` is written instead.
        Returns its number and the rows written."""
        self._hold()
        try:
            before = self.manifest() or {}
            generation, written, tables = int(before.get("generation", 0)) + 1, 0, {}
            folder = f"generation-{generation}"
            shutil.rmtree(os.path.join(self.folder, folder), ignore_errors=True)

            def write(df: DataFrame, name: str) -> str:
                df.write.mode("overwrite").parquet(os.path.join(self.folder, folder, name))
                return f"{folder}/{name}"

            for name, df in whole.items():
                tables[name] = [{"rows": write(df, name)}]
            for name, (rows, keys) in (parts or {}).items():
                kept = before["tables"][name]
                if len(kept) >= SEGMENTS:
                    tables[name] = [{"rows": write(full[name], name)}]
                else:
                    rows, n = cut_counted(rows)
                    written += n
                    tables[name] = [*kept, {"rows": write(rows, name), "keys": write(keys.select("path"), f"{name}-keys")}]
            facts = {"version": VERSION, "generation": generation, "tables": {**(before.get("tables", {}) if parts is not None else {}), **tables}, **facts}
            self._replace({**facts, "previous": sorted({x.split("/")[0] for s in before.get("tables", {}).values() for part in s for x in part.values()})})
            self._prune()
            return generation, written
        finally:
            os.remove(self.lock)

    def _replace(self, manifest: dict) -> None:
        with open(self.path + ".new", "w", encoding="utf-8") as f:
            json.dump(manifest, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(self.path + ".new", self.path)

    def note(self, **facts) -> None:
        """Change the manifest only: no table is written."""
        self._replace({**self.manifest(), **facts})

    def _prune(self) -> None:
        m = self.manifest()
        named = {x.split("/")[0] for s in m["tables"].values() for part in s for x in part.values()} | set(m.get("previous", ()))
        for name in os.listdir(self.folder):
            if name.startswith("generation-") and name not in named:
                shutil.rmtree(os.path.join(self.folder, name))


def replace_rows(old: DataFrame, keys: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """`old` without the rows of the keys (path), and the new rows."""
    return old.join(keys.select(F.col("path").alias(key)).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def needs_relations(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Paths whose coming or going can change test relations of other files: tests, conftests, and files
    with fixtures, requests or plugins."""
    any_fact = (F.size("fixtures") + F.size("requests") + F.size("plugins")) > 0
    conftest = F.substring_index("path", "/", -1) == "conftest.py"
    return files.join(facts.select("path", any_fact.alias("any_fact")), "path", "left").filter(F.col("is_test") | conftest | F.coalesce("any_fact", F.lit(False))).select("path")
