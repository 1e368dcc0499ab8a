"""Scans of source trees as a Python data source, configuration, and path checks."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rippleframe import schemas
from rippleframe.errors import AnalysisError, ConfigError, DiscoveryError
from rippleframe.functions.paths import IGNORED_DIRECTORIES, glob_to_regex

TABLE = "rippleframe"  # [tool.rippleframe]
_KEYS = {"source-roots", "test-roots", "exclude"}


def list_python_files(root: str, patterns: list[str] = ()) -> list[str]:
    """Sorted repository-relative paths of regular `.py` files; ignored and excluded directories are
    not entered, links are not followed."""
    import re

    if not os.path.isdir(root):
        raise DiscoveryError(f"not a directory: {root}")
    out_of = re.compile("^(?:" + "|".join(map(glob_to_regex, patterns)) + ")$") if patterns else None
    hidden = lambda rel: bool(out_of and out_of.match(rel))
    found = []
    for at, dirs, names in os.walk(root, followlinks=False):
        base = os.path.relpath(at, root).replace(os.sep, "/")
        rel = lambda n: n if base == "." else f"{base}/{n}"  # noqa: E731,B023
        dirs[:] = [d for d in dirs if d not in IGNORED_DIRECTORIES and not hidden(rel(d)) and not os.path.islink(os.path.join(at, d))]
        for n in names:
            full = os.path.join(at, n)
            if n.endswith(".py") and n != ".py" and not os.path.islink(full) and os.path.isfile(full) and not hidden(rel(n)):
                found.append(rel(n))
    return sorted(found)


class _Chunk(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["root"]
        self.paths = json.loads(options["paths"]) if options.get("paths") else list_python_files(self.root, json.loads(options.get("exclude") or "[]"))
        self.size = int(options.get("filesperpartition", "2000"))

    def partitions(self):
        return [_Chunk(self.paths[i : i + self.size]) for i in range(0, len(self.paths), self.size)] or [_Chunk([])]

    def read(self, partition):
        for rel in partition.paths:
            with open(os.path.join(self.root, rel), "rb") as f:
                raw, stat = f.read(), os.fstat(f.fileno())
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                text = None
            yield rel, len(raw), stat.st_mtime_ns, text, hashlib.sha256(raw).hexdigest()


class SourceTree(DataSource):
    """format("source_tree"): schemas.INVENTORY of the tree under option `root`, which all executors
    must see; the listing is on the driver, reading is by chunks of files on the executors."""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return schemas.INVENTORY

    def reader(self, schema):
        return _TreeReader(self.options)


def scan(spark: SparkSession, root: str, patterns: list[str] = (), paths: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("root", root).option("exclude", json.dumps(list(patterns)))
    return (reader if paths is None else reader.option("paths", json.dumps(paths))).load()


@dataclass(frozen=True)
class Config:
    """Roots and exclusions; None means inferred source roots."""

    source_roots: tuple[str, ...] | None = None
    test_roots: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def roots(self, paths: list[str]) -> list[str]:
        """Configured source roots, else `src` where some path lies under it, else the repository."""
        if self.source_roots is not None:
            return list(self.source_roots)
        return ["src"] if any(p.startswith("src/") for p in paths) else ["."]

    def fingerprint(self) -> str:
        parts = [*("s:" + x for x in self.source_roots or ("?",)), *("t:" + x for x in self.test_roots), *("e:" + x for x in self.exclude)]
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def _clean(value: str, what: str) -> str:
    if not value.strip():
        raise ConfigError(f"{what} is empty")
    if value.startswith("/") or (len(value) > 1 and value[1] == ":"):
        raise ConfigError(f"{what} must be relative: {value}")
    if "\\" in value:
        raise ConfigError(f"{what} must use '/': {value}")
    parts = [p for p in value.split("/") if p not in ("", ".")]
    if ".." in parts:
        raise ConfigError(f"{what} must not leave the repository: {value}")
    return "/".join(parts) or "."


def normalize_roots(values: list[str], what: str) -> tuple[str, ...]:
    out = [_clean(v, what) for v in values]
    if len(set(out)) < len(out):
        raise ConfigError(f"{what} is listed twice")
    return tuple(out)


def normalize_excludes(values: list[str]) -> tuple[str, ...]:
    out = normalize_roots(values, "exclude pattern")
    for p in out:
        glob_to_regex(p)
    return out


def load_config(root: str) -> Config:
    path = os.path.join(root, "pyproject.toml")
    if not os.path.isfile(path):
        return Config()
    try:
        with open(path, "rb") as f:
            table = tomllib.load(f).get("tool", {}).get(TABLE, {})
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"pyproject.toml: {e}") from e
    if unknown := set(table) - _KEYS:
        raise ConfigError(f"unknown keys: {', '.join(sorted(unknown))}")
    for key, value in table.items():
        if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
            raise ConfigError(f"{key} must be a list of strings")
    sources = table.get("source-roots")
    return Config(None if sources is None else normalize_roots(sources, "source root"), normalize_roots(table.get("test-roots", []), "test root"), normalize_excludes(table.get("exclude", [])))


def check_roots(config: Config, root: str, paths: list[str]) -> None:
    """Every configured root is a directory or holds a known path."""
    for r in (*(config.source_roots or ()), *config.test_roots):
        if r != "." and not os.path.isdir(os.path.join(root, r)) and not any(p.startswith(r + "/") for p in paths):
            raise ConfigError(f"root does not exist: {r}")


def input_path(root: str, path: str) -> str:
    """Repository-relative form of a path given by a user; it must lie inside the root."""
    full = os.path.realpath(path if os.path.isabs(path) else os.path.join(root, path))
    rel = os.path.relpath(full, os.path.realpath(root)).replace(os.sep, "/")
    if rel == ".." or rel.startswith("../"):
        raise AnalysisError(f"outside the repository: {path}")
    return rel
