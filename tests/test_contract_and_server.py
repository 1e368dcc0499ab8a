"""Plan documents, result records, the tool server, and the synthetic tree."""

import io
import json
import os

import pytest

from rippleframe.engine import Engine
from rippleframe.errors import AnalysisError, UsageError
from rippleframe.plans import contract, report
from rippleframe.selection import Selection
from rippleframe.server import LINE_LIMIT, Server
from rippleframe.sources.synthetic import FIRST, chain_sources, write_tree

IMPACT = {"changed": ["a.py"], "direct": ["b.py", "test_b.py"], "transitive": ["c.py", "test_a.py"], "tests": ["test_a.py", "test_b.py"], "causes": [("b.py", ["a.py"])], "full": None}
PLAN = report.plan_dict(IMPACT)
FULL = report.plan_dict(IMPACT | {"full": ("unsupported_exports", ["a.py"])})
NONE = report.plan_dict(IMPACT | {"tests": []})


def test_plans_that_hold():
    for plan in (PLAN, FULL, NONE):
        assert contract.check_plan(plan) is plan
    assert contract.affected_counts(PLAN) == {"directly_affected_modules": 1, "transitively_affected_modules": 1, "affected_modules": 2, "affected_tests": 2}


@pytest.mark.parametrize("change", [
    {"schema_version": True}, {"schema_version": 2}, {"extra": 1}, {"changed": ["/a.py"]}, {"changed": ["a/../b.py"]}, {"changed": ["a.py", "a.py"]}, {"changed": "a.py"}, {"affected_tests": ["test_a.py"]},
    {"validation": {"mode": "some", "steps": []}}, {"validation": {"mode": "none", "steps": []}}, {"validation": {"mode": "selective", "steps": []}}, {"validation": {"mode": "full", "steps": [{"kind": "pytest", "program": "pytest", "args": []}]}},
    {"validation": {"mode": "selective", "steps": [{"kind": "pytest", "program": "sh", "args": ["test_a.py", "test_b.py"]}]}}, {"attributions": [{"affected": "b.py"}]}, {"full_validation": FULL["full_validation"]},
    {"full_validation": {"required": True, "reason": "other", "configuration_paths": ["a.py"]}},
])
def test_plans_that_do_not_hold(change):
    with pytest.raises(contract.PlanError):
        contract.check_plan(PLAN | change)
    with pytest.raises(contract.PlanError):
        contract.check_plan({k: v for k, v in PLAN.items() if k not in change} | ({} if set(change) & set(PLAN) else change))


def test_publication(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    out = str(tmp_path / "plan.json")
    with pytest.raises(contract.PlanError, match="not a Python file"):
        contract.publish_plan(PLAN, out, str(root))
    for name in PLAN["affected_tests"]:
        (root / name).write_text("")
    assert "Mode: selective" in contract.publish_plan(PLAN, out, str(root))
    assert contract.load_plan(out, str(root)) == PLAN
    with pytest.raises(contract.PlanError, match="exists"):
        contract.publish_plan(PLAN, out, str(root))
    with pytest.raises(contract.PlanError, match="outside"):
        contract.publish_plan(PLAN, str(root / "plan.json"), str(root))
    assert sorted(os.listdir(tmp_path)) == ["plan.json", "repo"]
    (tmp_path / "twice.json").write_text('{"changed": [], "changed": []}')
    (tmp_path / "broken.json").write_text("{")
    for name in ("twice", "broken"):
        with pytest.raises(contract.PlanError):
            contract.load_plan(str(tmp_path / f"{name}.json"))


def test_records(tmp_path):
    path = str(tmp_path / "raw.jsonl")
    for i in range(3):
        contract.append_record(path, {"run": i})
    assert contract.read_records(path) == [{"run": 0}, {"run": 1}, {"run": 2}]
    for bad in (b'{"run":', b"[1]\n", b"{\n"):
        with open(path, "wb") as f:
            f.write(bad)
        with pytest.raises(AnalysisError):
            contract.read_records(path)


class Answers:
    """Stands for the application."""

    def plan(self, what):
        if what.paths == ("lost.py",):
            raise AnalysisError("not indexed: lost.py")
        if what.base == "boom":
            raise RuntimeError("x")
        return PLAN | {"changed": [*what.paths, what.base or ""]}

    def explain(self, changed, affected, what):
        return {"path": [affected, changed], "base": what.base}


def talk(*messages):
    lines = b"".join(m if isinstance(m, bytes) else json.dumps({"jsonrpc": "2.0"} | m).encode() + b"\n" for m in messages)
    out = io.BytesIO()
    Server(Answers()).run(io.BytesIO(lines), out)
    return [json.loads(x) for x in out.getvalue().splitlines()]


def call(name, arguments, number=1):
    return {"id": number, "method": "tools/call", "params": {"name": name, "arguments": arguments}}


def test_server_protocol():
    got = talk({"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "nothing"}, b"{\n", b"[]\n", b"\n", b"x" * (LINE_LIMIT + 5) + b"\n", {"id": "p", "method": "ping"})
    assert [(g["id"], g.get("error", {}).get("code")) for g in got] == [(1, None), (2, None), (3, -32601), (None, -32700), (None, -32600), (None, -32700), ("p", None)]
    assert [t["name"] for t in got[1]["result"]["tools"]] == ["validation_plan", "explain_impact"] and all(t["annotations"]["readOnlyHint"] for t in got[1]["result"]["tools"])


def test_server_tools():
    source = lambda **x: {"source": x}
    got = talk(
        call("validation_plan", source(type="files", files=["a.py"])), call("validation_plan", source(type="changed")), call("validation_plan", source(type="git_diff", base="main")), call("validation_plan", source(type="files", files=["lost.py"])),
        call("validation_plan", source(type="files", files=[])), call("validation_plan", source(type="git_diff", base=" ")), call("validation_plan", source(type="git_diff", base="boom")), call("validation_plan", {}), call("other", {}),
        call("explain_impact", {"changed_file": "a", "affected_file": "b", "context": {"type": "current"}}), call("explain_impact", {"changed_file": "a", "affected_file": "b", "context": {"type": "git_diff", "base": "m"}, "more": 1}),
    )
    assert [g["result"]["structuredContent"]["changed"] for g in got[:3]] == [["a.py", ""], ["HEAD"], ["main"]]
    assert got[3]["result"]["isError"] and "lost.py" in got[3]["result"]["content"][0]["text"]
    assert [g["error"]["code"] for g in got[4:9]] == [-32602, -32602, -32603, -32602, -32601]
    assert got[9]["result"]["structuredContent"] == {"path": ["b", "a"], "base": None} and got[10]["error"]["code"] == -32602


def test_selections():
    for bad in ({"paths": ("a",), "base": "m"}, {"base": " "}):
        with pytest.raises(UsageError):
            Selection(**bad)


def test_synthetic_chain(spark, tmp_path):
    rows = {r["path"]: r["source"] for r in chain_sources(spark, 60).collect()}
    assert len(rows) == 60 and sum(p.startswith("tests/") for p in rows) == 6
    write_tree(chain_sources(spark, 60), str(tmp_path))
    engine = Engine.build(spark, str(tmp_path))
    got = engine.impact([FIRST])
    assert len(got["tests"]) == 6 and len(got["direct"]) == 2 and len(got["transitive"]) == 56
    why = engine.why(FIRST, got["tests"][-1])
    assert why["path"][-1] == FIRST and report.why_text(why).count("->") == len(why["steps"])
    with pytest.raises(ValueError):
        chain_sources(spark, 2)
