"""Column expressions over repository paths and dotted names (no UDFs)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from rippleframe.errors import ConfigError

# Directory names that a scan never enters.
IGNORED_DIRECTORIES = (".git", ".venv", "venv", ".tox", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache")
TEST_NAME = r"(^|/)(test_[^/]*|[^/]*_test)\.py$"


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """Parent directory, '' at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def dotted_prefixes(name: Column) -> Column:
    """['a', 'a.b', 'a.b.c'] of 'a.b.c'; empty components do not count."""
    parts = F.filter(F.split(name, r"\."), lambda p: p != "")
    return F.transform(parts, lambda p, i: F.array_join(F.slice(parts, 1, i + 1), "."))


def path_prefixes(path: Column) -> Column:
    """Every ancestor and the path itself, shortest first."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda p, i: F.array_join(F.slice(parts, 1, i + 1), "/"))


def path_to_module(path: Column, source_roots: list[str]) -> Column:
    """Dotted module of a `.py` path; the most specific source root that holds it is stripped."""
    rest = path
    for root in sorted((r for r in source_roots if r not in ("", ".")), key=lambda r: r.count("/")):  # the deepest is tested first
        rest = F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 30)).otherwise(rest)
    return F.regexp_replace(F.replace(F.regexp_replace(rest, r"\.py$", ""), F.lit("/"), F.lit(".")), r"(^|\.)__init__$", "")


def is_package(path: Column) -> Column:
    return file_name(path) == "__init__.py"


def is_test(path: Column, test_roots: list[str] = ()) -> Column:
    out = path.rlike(TEST_NAME)
    for root in test_roots:
        out = out | F.lit(root in ("", ".")) | path.startswith(root + "/")
    return out


def glob_to_regex(pattern: str) -> str:
    """Path glob as a regular expression over one whole path: `*` and `?` stay in a component, `**`
    crosses, `[...]` is a class (`!` negates), braces list alternatives, a backslash is ordinary."""
    out, i, depth = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[":
            end = pattern.find("]", i + 2)
            if end < 0:
                raise ConfigError(f"invalid exclude pattern {pattern!r}: unclosed class")
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "(?!/)[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
            continue
        if c in "{}":
            depth += 1 if c == "{" else -1
            if depth < 0:
                raise ConfigError(f"invalid exclude pattern {pattern!r}: unopened group")
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")"}.get(c) or ("|" if c == "," and depth else re.escape(c))
        i += 1
    if depth:
        raise ConfigError(f"invalid exclude pattern {pattern!r}: unclosed group")
    return out


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether the path or any directory above it matches a pattern."""
    if not patterns:
        return F.lit(False)
    regex = "^(?:" + "|".join(glob_to_regex(p) for p in patterns) + ")$"
    return F.exists(path_prefixes(path), lambda p: p.rlike(regex))


def discoverable(path: Column, patterns: list[str] = ()) -> Column:
    """A `.py` path outside the ignored directories and the exclusions."""
    parts = F.split(path, "/")
    ignored = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.isin(*IGNORED_DIRECTORIES))
    return path.endswith(".py") & (F.element_at(parts, -1) != ".py") & ~ignored & ~excluded(path, list(patterns))


def display_import(kind: Column, module: Column, name: Column, level: Column, api: Column, package: Column) -> Column:
    """Source form of an import."""
    quoted = F.concat(F.lit('"'), F.coalesce(module, F.lit("<dynamic>")), F.lit('"'))
    anchor = F.when(package.isNotNull(), F.concat(F.lit(', package="'), package, F.lit('"'))).otherwise("")
    return (
        F.when(kind == "import", F.concat(F.lit("import "), module))
        .when(kind == "from", F.concat(F.lit("from "), F.repeat(F.lit("."), F.coalesce(level, F.lit(0))), F.coalesce(module, F.lit("")), F.lit(" import "), name))
        .otherwise(F.concat(F.when(api == "import_module", "importlib.import_module").otherwise("__import__"), F.lit("("), quoted, anchor, F.lit(")")))
    )


def normalized_path(path: Column) -> Column:
    """Repository-relative form: `/` separators, no `./`."""
    return F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"(^|/)(\./)+", "$1"), "/+", "/")
