"""Version-control changes and baselines, read by `git` on the driver."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession

from rippleframe import schemas
from rippleframe.errors import GitError
from rippleframe.functions.paths import IGNORED_DIRECTORIES


def git(root: str, *args: str, ok: tuple = (0,)) -> bytes:
    try:
        run = subprocess.run(["git", "-C", root, *args], capture_output=True)
    except OSError as e:
        raise GitError(f"git cannot be run: {e}") from e
    if run.returncode not in ok:
        raise GitError(f"git {args[0]} failed: {run.stderr.decode(errors='replace').strip()}")
    return run.stdout


def safe_path(raw: bytes) -> str:
    try:
        path = raw.decode()
    except UnicodeDecodeError as e:
        raise GitError("a path is not UTF-8") from e
    if not path or path.startswith("/") or any(p in ("", ".", "..") for p in path.split("/")):
        raise GitError(f"unsafe path: {path!r}")
    return path


# Status letters of `diff --name-status`.
_PLAIN = {"A": "Added", "D": "Deleted", "M": "Modified", "T": "Modified", "U": "Modified", "X": "Modified", "B": "Modified"}


def decode_status(raw: bytes) -> list[tuple[str, str, str | None]]:
    """(kind, path, previous path) of NUL-separated name-status output."""
    parts, out = raw.split(b"\0"), []
    if parts and parts[-1] == b"":
        parts.pop()
    queue = iter(parts)
    try:
        for status in queue:
            letter = status[:1].decode("ascii", "replace")
            if letter in ("R", "C"):
                before, after = safe_path(next(queue)), safe_path(next(queue))
                out.append(("Renamed", after, before) if letter == "R" else ("Added", after, None))
            elif letter in _PLAIN:
                out.append((_PLAIN[letter], safe_path(next(queue)), None))
            else:
                raise GitError(f"unknown status {status!r}")
    except StopIteration as e:
        raise GitError("the status output ends early") from e
    return out


def decode_untracked(raw: bytes) -> list[tuple[str, str, str | None]]:
    return [("Added", safe_path(p), None) for p in raw.split(b"\0") if p]


def top_level(start: str) -> str:
    return git(start, "rev-parse", "--show-toplevel").decode().rstrip("\n")


def discover_changes(root: str, base: str = "HEAD") -> list[tuple[str, str, str | None]]:
    """Changes of the working tree against the merge base of `base` and HEAD, untracked files included."""
    if os.path.realpath(top_level(root)) != os.path.realpath(root):
        raise GitError(f"{root} is not the top of its repository")
    if not base.strip():
        raise GitError("the base is empty")
    commit = git(root, "rev-parse", "--verify", "--end-of-options", f"{base}^{{commit}}").decode().strip()
    start = git(root, "merge-base", commit, "HEAD").decode().strip()
    diff = decode_status(git(root, "diff", "--name-status", "-z", "--find-renames", start, "--"))
    return diff + decode_untracked(git(root, "ls-files", "--others", "--exclude-standard", "-z"))


def git_changes(spark: SparkSession, root: str, base: str = "HEAD") -> DataFrame:
    rows = [(k, p, q, "pyproject.toml" in (p, q)) for k, p, q in discover_changes(root, base)]
    return spark.createDataFrame(sorted(set(rows), key=lambda r: (r[2] or "", r[1])), schemas.CHANGES)


def baseline(root: str) -> dict | None:
    """HEAD and the Python paths that differ from it, or None where no safe delta can be had: submodules,
    repositories inside this one (git does not list their files), or files hidden from git's eyes."""
    try:
        if os.path.realpath(top_level(root)) != os.path.realpath(root) or os.path.exists(os.path.join(root, ".gitmodules")):
            return None
        head = git(root, "rev-parse", "--verify", "HEAD").decode().strip()
        flags = git(root, "ls-files", "-v", "-z", "--", "*.py").split(b"\0")
        stages = git(root, "ls-files", "--stage", "-z").split(b"\0")
        if any(f[:1].islower() or f[:1] == b"S" for f in flags if f) or any(s.startswith(b"160000") for s in stages):
            return None
        dirty = {x for _, p, q in decode_status(git(root, "diff", "--name-status", "-z", "--find-renames", "HEAD", "--")) for x in (p, q) if x}
        others = [p for p in git(root, "ls-files", "--others", "-z").split(b"\0") if p]
        if any(p.endswith(b"/") and not ignored(p.decode(errors="replace")) for p in others):
            return None
        other = {p for _, p, _ in decode_untracked(b"\0".join(p for p in others if p.endswith(b".py")))}
    except GitError:
        return None
    return {"head": head, "dirty": sorted(p for p in dirty | other if p.endswith(".py"))}


def ignored(folder: str) -> bool:
    """Whether the walk would not enter this folder or one above it."""
    return any(part in IGNORED_DIRECTORIES for part in folder.split("/"))


def delta_paths(root: str, before: dict, now: dict) -> list[str]:
    """Paths that may differ between two baselines."""
    moved = set()
    if before["head"] != now["head"]:
        moved = {x for _, p, q in decode_status(git(root, "diff", "--name-status", "-z", "--find-renames", before["head"], now["head"], "--")) for x in (p, q) if x}
    return sorted(p for p in moved | set(before["dirty"]) | set(now["dirty"]) if p.endswith(".py"))
