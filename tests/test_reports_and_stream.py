import json

from rippleframe.__main__ import main
from rippleframe.plans import report
from rippleframe.streaming.changes import stream_impact
from tests.trees import SHOP, write

IMPACT = {"changed": ["a.py"], "direct": ["b.py"], "transitive": [], "tests": ["test_a.py"], "causes": [("b.py", ["a.py"]), ("test_a.py", ["a.py"])], "full": None}


def test_json_contracts():
    plan = json.loads(report.plan_json(IMPACT))
    assert list(plan) == ["schema_version", "changed", "directly_affected", "transitively_affected", "affected_tests", "validation", "attributions"]
    assert [a["affected"] for a in json.loads(report.tests_json(IMPACT))["attributions"]] == ["test_a.py"]
    full = IMPACT | {"full": ("unsupported_exports", ["a.py"])}
    assert json.loads(report.plan_json(full))["validation"] == {"mode": "full", "steps": [{"kind": "pytest", "program": "pytest", "args": []}]}
    assert json.loads(report.tests_json(full))["attributions"] == []
    assert report.import_dict({"kind": "from", "module": None, "name": "x", "level": 1}) == {"kind": "from", "module": None, "name": "x", "level": 1}


def test_listing_is_cut():
    text = report.listing("Files", [str(i) for i in range(30)])
    assert text.count("\n") == 26 and "… 5 more" in text
    assert "more" not in report.listing("Files", [str(i) for i in range(30)], True)


def test_stream_of_changes(spark, tmp_path):
    edges = spark.createDataFrame([("b.py", "a.py"), ("test_b.py", "b.py")], "dependent string, dependency string")
    files = spark.createDataFrame([("a.py", False), ("b.py", False), ("test_b.py", True)], "path string, is_test boolean")
    source = str(tmp_path / "in")
    spark.createDataFrame([("Modified", "a.py", None), ("Modified", "x.md", None)], "kind string, path string, previous_path string").coalesce(1).write.json(source)
    events = spark.readStream.schema("kind string, path string, previous_path string").json(source)
    query = stream_impact(events, edges, files, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out" / "batch=0")).collect()
    assert sorted((r["path"], r["class"], r["is_test"]) for r in got) == [("b.py", "direct", False), ("test_b.py", "transitive", True)]


def test_command_line(spark, tmp_path, capsys):
    root = write(tmp_path / "shop", SHOP)
    assert main(["plan", "src/cycles/a.py", "--root", root, "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["validation"]["mode"] == "none"
    assert main(["impact", "--root", root]) == 2
    assert main(["impact", "none.py", "--root", root]) == 3
