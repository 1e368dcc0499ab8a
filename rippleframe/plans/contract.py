"""The plan as others consume it: checking a plan document, publishing it once, and result records.

A document is checked against shapes (tables of fields) first, then against the rules that tie
its parts together."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path, PurePosixPath

from rippleframe.errors import AnalysisError

# Fixed values of the contract: modes, reasons, the one program that a step may run.
MODES = ("selective", "none", "full")
REASONS = ("configuration_changed", "unresolved_dynamic_import", "unsupported_pytest_relationship", "unsupported_exports")
STEP = {"kind": "pytest", "program": "pytest"}


class PlanError(AnalysisError):
    """A plan document that must not be run."""


def _is_path(x) -> bool:
    return isinstance(x, str) and bool(x) and not x.startswith("/") and "\\" not in x and str(PurePosixPath(x)) == x and ".." not in PurePosixPath(x).parts


def _are_paths(x) -> bool:
    return isinstance(x, list) and all(map(_is_path, x)) and len(set(x)) == len(x)


def _shaped(shape: dict, optional: tuple = ()):
    """A check that an object has exactly these fields, each passing its own check."""

    def check(x) -> bool:
        return isinstance(x, dict) and set(shape) - set(optional) <= set(x) <= set(shape) and all(test(x[k]) for k, test in shape.items() if k in x)

    return check


def _each(test):
    return lambda x: isinstance(x, list) and all(map(test, x))


_STEP = _shaped({"kind": STEP["kind"].__eq__, "program": STEP["program"].__eq__, "args": _are_paths})
_PLAN = {
    "schema_version": lambda x: type(x) is int and x == 1, "changed": _are_paths, "directly_affected": _are_paths, "transitively_affected": _are_paths, "affected_tests": _are_paths,
    "validation": _shaped({"mode": MODES.__contains__, "steps": _each(_STEP)}),
    "full_validation": _shaped({"required": lambda x: x is True, "reason": REASONS.__contains__, "configuration_paths": lambda x: _are_paths(x) and bool(x)}),
    "attributions": _each(_shaped({"affected": _is_path, "caused_by": _are_paths})),
}
# What each mode asks of the steps' arguments, the affected tests, and whether a reason is given.
_RULES = {
    "full": lambda args, tests, why: args == [[]] and why,
    "none": lambda args, tests, why: not args and not tests and not why,
    "selective": lambda args, tests, why: bool(args) and all(args) and sum(args, []) == tests and not why,
}


def check_plan(plan: dict, root: str | None = None) -> dict:
    """The plan, if it is one of version 1, consistent, and (with `root`) all its tests are files there."""
    if not isinstance(plan, dict) or not set(plan) <= set(_PLAN):
        raise PlanError("a plan is an object of known fields")
    for name, test in _PLAN.items():
        if name not in plan and name != "full_validation":
            raise PlanError(f"the plan lacks {name}")
        if name in plan and not test(plan[name]):
            raise PlanError(f"the plan's {name} is not valid")
    mode = plan["validation"]["mode"]
    if not _RULES[mode]([s["args"] for s in plan["validation"]["steps"]], plan["affected_tests"], "full_validation" in plan):
        raise PlanError(f"the parts of a plan of mode {mode} do not fit together")
    if root is not None:
        top = Path(root).resolve(strict=True)
        for test in plan["affected_tests"]:
            at = (top / test).resolve()
            if not (at.is_file() and at.suffix == ".py" and at.is_relative_to(top)):
                raise PlanError(f"not a Python file of the repository: {test}")
    return plan


def load_plan(path: str, root: str | None = None) -> dict:
    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise PlanError("a field is given twice")
        return dict(pairs)

    with open(path, encoding="utf-8") as f:
        try:
            plan = json.load(f, object_pairs_hook=once)
        except ValueError as e:
            raise PlanError(f"not a JSON document: {e}") from e
    return check_plan(plan, root)


def publish_plan(plan: dict, path: str, root: str) -> str:
    """Write a checked plan to a new file outside the repository, whole or not at all; returns its
    summary. An existing file is never replaced."""
    target, top = Path(path), Path(root).resolve(strict=True)
    if not target.is_absolute() or target.parent.resolve(strict=True).is_relative_to(top):
        raise PlanError("the plan goes to an absolute path outside the repository")
    check_plan(plan, root)
    handle, draft = tempfile.mkstemp(dir=target.parent, prefix=".plan-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(plan, f, indent=2, ensure_ascii=False)
            f.write("\n")
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(draft, target)
        except FileExistsError as e:
            raise PlanError(f"{target} exists already") from e
    finally:
        os.unlink(draft)
    counts = affected_counts(plan)
    lines = [f"Mode: {plan['validation']['mode']}", f"Changed files: {len(plan['changed'])}", f"Affected modules: {counts['affected_modules']}, tests: {counts['affected_tests']}"]
    if "full_validation" in plan:
        lines.append(f"Reason: {plan['full_validation']['reason']}")
    return "\n".join([*lines, f"Plan: {target}"]) + "\n"


def affected_counts(result: dict) -> dict[str, int]:
    """How many modules and tests a result names; a test is not counted as a module."""
    tests = set(result["affected_tests"])
    direct, far = (set(result[k]) - tests for k in ("directly_affected", "transitively_affected"))
    return {"directly_affected_modules": len(direct), "transitively_affected_modules": len(far), "affected_modules": len(direct | far), "affected_tests": len(tests)}


def append_record(path: str, record: dict) -> None:
    """One more line of a results file, on disk when this returns."""
    with open(path, "ab") as f:
        f.write(json.dumps(record, sort_keys=True, separators=(",", ":")).encode() + b"\n")
        f.flush()
        os.fsync(f.fileno())


def read_records(path: str) -> list[dict]:
    """The lines of a results file; a torn last line or anything but objects is an error."""
    raw = Path(path).read_bytes()
    if raw and raw[-1:] != b"\n":
        raise AnalysisError(f"{path} ends within a record")
    try:
        out = [json.loads(line) for line in raw.splitlines()]
    except ValueError as e:
        raise AnalysisError(f"{path} holds a broken record: {e}") from e
    if not all(isinstance(x, dict) for x in out):
        raise AnalysisError(f"{path} holds a record that is no object")
    return out
