"""JSON contracts and human text, built on the driver from final results."""

from __future__ import annotations

import json

LIMIT = 25  # fixed value: rows of a human listing unless all are asked for
SCHEMA_VERSION = 1


def _pretty(value: dict) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False) + "\n"


def impact_dict(impact: dict) -> dict:
    out = {"schema_version": SCHEMA_VERSION, "changed": impact["changed"], "directly_affected": impact["direct"], "transitively_affected": impact["transitive"], "affected_tests": impact["tests"]}
    if impact["full"]:
        out["full_validation"] = {"required": True, "reason": impact["full"][0], "configuration_paths": impact["full"][1]}
    out["attributions"] = [{"affected": p, "caused_by": c} for p, c in impact["causes"]]
    return out


def impact_json(impact: dict) -> str:
    return _pretty(impact_dict(impact))


def tests_json(impact: dict) -> str:
    full = impact_dict(impact)
    keep = [] if impact["full"] else [a for a in full["attributions"] if a["affected"] in set(impact["tests"])]
    out = {k: full[k] for k in ("schema_version", "changed", "affected_tests", "full_validation") if k in full}
    return _pretty(out | {"attributions": keep})


def plan_dict(impact: dict) -> dict:
    mode = "full" if impact["full"] else "selective" if impact["tests"] else "none"
    steps = [] if mode == "none" else [{"kind": "pytest", "program": "pytest", "args": impact["tests"] if mode == "selective" else []}]
    out = impact_dict(impact)
    causes = out.pop("attributions")
    full = out.pop("full_validation", None)
    out["validation"] = {"mode": mode, "steps": steps}
    if full:
        out["full_validation"] = full
    return out | {"attributions": causes}


def plan_json(impact: dict) -> str:
    return _pretty(plan_dict(impact))


def import_dict(i: dict) -> dict:
    """Fields of each form; those that may be absent in the source stay as null."""
    if i["kind"] == "import":
        return {"kind": "import", "module": i["module"]}
    if i["kind"] == "from":
        return {"kind": "from", "module": i["module"], "name": i["name"], "level": i["level"]}
    return {k: i[k] for k in ("kind", "api", "module", "package", "level", "fromlist", "reason")}


def why_dict(changed: str, affected: str, path: list[str], steps: list[dict]) -> dict:
    out = []
    for s in steps:
        step = {"dependent": s["dependent"], "dependency": s["dependency"], "imports": [{"line": e["line"], "column": e["col"], "import": import_dict(e["import"])} for e in s["evidence"] if e["import"]]}
        other = [{"kind": e["kind"], "line": e["line"], "column": e["col"]} | ({"name": e["name"]} if e["name"] is not None else {}) | ({"import": import_dict(e["import"])} if e["import"] else {}) for e in s["evidence"] if e["kind"] != "import"]
        out.append(step | ({"evidence": other} if other else {}))
    return {"schema_version": SCHEMA_VERSION, "changed": changed, "affected": affected, "path": path, "steps": out}


def why_json(*args) -> str:
    return _pretty(why_dict(*args))


def graph_json(summary: dict, unresolved: list[dict]) -> str:
    return _pretty({"schema_version": SCHEMA_VERSION, "summary": summary, "unresolved_imports": unresolved})


def listing(title: str, rows: list[str], all_rows: bool = False) -> str:
    shown = rows if all_rows else rows[:LIMIT]
    more = len(rows) - len(shown)
    return "\n".join([f"{title} ({len(rows)})", *("  " + r for r in shown), *([f"  … {more} more"] if more else [])])


def impact_text(impact: dict, all_rows: bool = False) -> str:
    parts = [listing("Changed", impact["changed"], all_rows), listing("Directly affected", impact["direct"], all_rows), listing("Transitively affected", impact["transitive"], all_rows), listing("Affected tests", impact["tests"], all_rows)]
    if impact["full"]:
        parts.append(f"Full validation is required: {impact['full'][0]} ({', '.join(impact['full'][1])})")
    return "\n\n".join(parts) + "\n"


def why_text(found: dict) -> str:
    """The path, and below each step where the dependency is stated."""
    lines = [found["path"][0]] if found["path"] else []
    for step in found["steps"]:
        lines.append(f"  -> {step['dependency']}")
        lines += [f"       {step['dependent']}:{i['line']}:{i['column']} {statement(i['import'])}" for i in step["imports"]]
        lines += [f"       {step['dependent']}:{e['line']}:{e['column']} {e['kind']}" + (f" {e['name']}" if e.get("name") else "") for e in step.get("evidence", ())]
    return "\n".join(lines)


def statement(i: dict) -> str:
    if i["kind"] == "import":
        return f"import {i['module']}"
    if i["kind"] == "from":
        return f"from {'.' * (i['level'] or 0)}{i['module'] or ''} import {i['name']}"
    return f"{i['api']}({i['module']!r})"


def inspection_json(summary: dict, parts: dict[str, list[dict]]) -> str:
    return _pretty({"schema_version": SCHEMA_VERSION, "summary": summary, **parts})


def inspection_text(summary: dict, parts: dict[str, list[dict]], all_rows: bool = False) -> str:
    edges = [f"{e['dependent']} -> {e['dependency']} ({', '.join(sorted({x['kind'] for x in e['evidence']}))})" for e in parts["edges"]]
    modules = [f"{m['module']} ({m['path']}): {len(m['dependencies'])} dependencies, {len(m['dependents'])} dependents" for m in parts["modules"]]
    traces = [f"{t['path']}:{t['line']}:{t['col']} {t['status']}: {', '.join(t['resolved']) or '-'} of {', '.join(t['candidates']) or '-'}" for t in parts["traces"]]
    listed = [listing(n, rows, all_rows) for n, rows in (("Modules", modules), ("Edges", edges), ("Imports", traces))]
    return json.dumps(summary) + "\n\n" + "\n\n".join(listed) + "\n"
