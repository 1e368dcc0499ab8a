import os
import shutil
import subprocess

import pytest

from rippleframe.engine import Engine
from rippleframe.errors import AnalysisError, ConfigError, ImportParseError
from rippleframe.operators import index as I
from rippleframe.operators.graph import edges_of
from rippleframe.sources import git
from tests.trees import SHOP, write


def shell(root, *args):
    subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    return Engine.build(spark, write(tmp_path_factory.mktemp("shop"), SHOP))


def test_summary_and_unresolved(shop):
    assert shop.graph() == {"files": 14, "modules": 14, "import_edges": 14, "tests": 4, "unresolved_imports": 3}
    assert [(r["importer"], r["line"], r["col"], r["import"]) for r in shop.unresolved().collect()] == [
        ("src/payments/stripe.py", 1, 8, "import requests"), ("tests/analytics/test_reporting.py", 1, 8, "import analytics.reporting"), ("tests/helpers_test.py", 1, 8, "import pytest")]


def test_impact_attribution_and_plan(shop):
    got = shop.impact(["src/payments/stripe.py", "src/cycles/a.py"])
    assert got["direct"] == ["src/cycles/b.py", "src/payments/formatters/card.py", "src/payments/service.py", "tests/payments/test_stripe.py"]
    assert got["transitive"] == ["src/api/checkout.py", "tests/api/test_checkout.py"]
    assert dict(got["causes"])["src/cycles/b.py"] == ["src/cycles/a.py"]
    plan = shop.plan(["src/payments/stripe.py"])
    assert plan["validation"] == {"mode": "selective", "steps": [{"kind": "pytest", "program": "pytest", "args": ["tests/api/test_checkout.py", "tests/payments/test_stripe.py"]}]}
    assert shop.plan(["src/cycles/a.py"])["validation"] == {"mode": "none", "steps": []}


def test_why(shop):
    got = shop.why("src/payments/stripe.py", "tests/api/test_checkout.py")
    assert got["path"] == ["tests/api/test_checkout.py", "src/api/checkout.py", "src/payments/service.py", "src/payments/stripe.py"]
    assert got["steps"][2]["imports"] == [{"line": 1, "column": 21, "import": {"kind": "from", "module": "stripe", "name": "pay", "level": 1}}]
    with pytest.raises(AnalysisError):
        shop.why("src/cycles/a.py", "tests/helpers_test.py")


def test_focus(shop):
    got = shop.inspect("src/cycles/a.py")
    assert [tuple(r) for r in got["edges"].select("dependent", "dependency").collect()] == [("src/cycles/a.py", "src/cycles/__init__.py"), ("src/cycles/a.py", "src/cycles/b.py"), ("src/cycles/b.py", "src/cycles/a.py")]


def test_errors(spark, tmp_path, shop):
    with pytest.raises(AnalysisError, match="not indexed"):
        shop.impact(["src/none.py"])
    with pytest.raises(AnalysisError, match="outside"):
        shop.impact(["../x.py"])
    with pytest.raises(AnalysisError, match="no Python"):
        Engine.build(spark, write(tmp_path / "empty", {"a.txt": ""}))
    with pytest.raises(ImportParseError):
        Engine.build(spark, write(tmp_path / "bad", {"a.py": "def (:\n"}))
    with pytest.raises(AnalysisError, match="module a is defined by"):
        Engine.build(spark, write(tmp_path / "twice", {"src/a.py": "", "src/a/__init__.py": ""}))
    with pytest.raises(ConfigError, match="unknown"):
        Engine.build(spark, write(tmp_path / "config", {"a.py": "", "pyproject.toml": "[tool.rippleframe]\nother = []\n"}))


def test_reexports_fixtures_plugins_and_uncertainty(spark, tmp_path):
    tree = {
        "src/pkg/__init__.py": "from .impl import Thing as Public\n", "src/pkg/impl.py": "class Thing: pass\n", "src/use.py": "from pkg import Public\n", "src/plug.py": "",
        "src/loose.py": "import importlib\nimportlib.import_module(NAME)\n", "src/leaf.py": "import loose\n",
        "conftest.py": "import pytest\npytest_plugins = ['plug']\n@pytest.fixture(autouse=True)\ndef db():\n    pass\n", "tests/test_use.py": "import use\ndef test_a(db): pass\n",
    }
    engine = Engine.build(spark, write(tmp_path, tree))
    kinds = {(r["dependent"], r["dependency"], r["kind"]) for r in engine.tables.evidence.collect()}
    assert {("src/use.py", "src/pkg/impl.py", "re_export"), ("tests/test_use.py", "conftest.py", "pytest_configuration"), ("tests/test_use.py", "conftest.py", "pytest_fixture"), ("conftest.py", "src/plug.py", "pytest_plugin")} <= kinds
    assert engine.affected_tests(["src/pkg/impl.py"]) == ["tests/test_use.py"]
    assert engine.affected_tests(["src/plug.py"]) == ["tests/test_use.py"]
    got = engine.impact(["src/loose.py"])
    assert got["full"] == ("unresolved_dynamic_import", ["src/loose.py"]) and got["direct"] == ["src/leaf.py"]


def same(a, b):
    edges = lambda e: sorted(map(tuple, edges_of(e.tables.evidence).collect()))
    assert edges(a) == edges(b)
    assert a.graph() == b.graph()
    assert a.unresolved().collect() == b.unresolved().collect()


def test_incremental_equals_fresh(spark, tmp_path):
    root, index = write(tmp_path / "repo", SHOP), str(tmp_path / "index")
    shell(root, "init", "-q")
    shell(root, "add", "-A")
    shell(root, "commit", "-qm", "one")
    first = Engine.build(spark, root, index)
    assert (first.work.kind, first.work.parsed, first.work.generation) == ("full", 14, 1)
    again = Engine.build(spark, root, index)
    assert (again.work.kind, again.work.parsed, again.work.written) == ("unchanged", 0, False)
    steps = [  # files written, files removed, (parsed, importers resolved again, edges added, edges removed)
        ({"src/payments/service.py": "from .stripe import pay  # note\n"}, [], (1, 0, 0, 0)),
        ({"src/payments/service.py": "import cycles.a\n"}, [], (1, 1, 2, 2)),
        ({"src/analytics/reporting.py": "import payments.stripe\n"}, ["src/cycles/b.py"], (1, None, None, None)),
        ({"conftest.py": "import pytest\n@pytest.fixture\ndef pay():\n    pass\n", "tests/api/test_checkout.py": "def test_a(pay): pass\n", "src/cycles/__init__.py": "from .a import thing\n", "src/late.py": "from cycles import thing\n"}, [], (4, None, None, None)),
        ({"src/cycles/__init__.py": "from payments.stripe import thing\n", "src/cycles/b.py": ""}, [], (2, None, None, None)),
    ]
    for i, (tree, gone, counts) in enumerate(steps):
        write(root, tree)
        for p in gone:
            os.remove(os.path.join(root, p))
        engine = Engine.build(spark, root, index)
        work = engine.work
        got = (work.parsed, work.resolved, work.edges_added, work.edges_removed)
        assert work.kind == "incremental" and all(w is None or g == w for g, w in zip(got, counts)), (tree, got)
        if i > 1:
            same(engine, Engine.build(spark, root))
    again = Engine.build(spark, root, index)
    assert again.work.kind == "unchanged"
    same(again, engine)
    with open(os.path.join(index, "manifest.json"), "w") as f:
        f.write("{")
    assert Engine.build(spark, root, index).work.reason == "corrupt"


def test_git_changes(spark, tmp_path):
    root = write(tmp_path / "repo", SHOP)
    shell(root, "init", "-q")
    shell(root, "add", "-A")
    shell(root, "commit", "-qm", "one")
    assert Engine.build(spark, root).git().plan()["validation"]["mode"] == "none"
    os.remove(os.path.join(root, "src/payments/stripe.py"))
    write(root, {"tests/test_new.py": "import api.checkout\n"})
    got = Engine.build(spark, root).git().impact()
    assert got["changed"] == ["src/payments/stripe.py", "tests/test_new.py"]
    assert got["tests"] == ["tests/api/test_checkout.py", "tests/payments/test_stripe.py", "tests/test_new.py"]
    write(root, {"pyproject.toml": "[tool.rippleframe]\nexclude = ['src/cycles']\n"})
    got = Engine.build(spark, root).git().impact()
    assert got["full"] == ("configuration_changed", ["pyproject.toml"]) and len(got["tests"]) == 5


def committed(root):
    shell(root, "init", "-q")
    shell(root, "add", "-A")
    shell(root, "commit", "-qm", "one")
    return root


def test_an_import_edit_writes_the_rows_of_its_importer(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "SEGMENTS", 2)
    tree = {"src/a.py": "import b\n", "src/b.py": "", "src/c.py": "", **{f"src/m{i}.py": "import b\n" for i in range(20)}}
    root, index = committed(write(tmp_path / "repo", tree)), str(tmp_path / "index")
    Engine.build(spark, root, index)
    write(root, {"src/a.py": "import c\n"})
    work = Engine.build(spark, root, index).work
    assert (work.parsed, work.resolved, work.edges_added, work.edges_removed) == (1, 1, 1, 1)
    assert work.records == 6  # file, facts, resolution, candidate, evidence, edge
    for i in range(I.SEGMENTS + 1):  # segments become one table again
        write(root, {"src/a.py": f"import {'cb'[i % 2]}  # {i}\n"})
        engine = Engine.build(spark, root, index)
        assert engine.work.kind == "incremental" and engine.work.generation == i + 3
    same(engine, Engine.build(spark, root))
    assert engine.work.seconds["graph"] > 0
    assert len([x for x in os.listdir(index) if x.startswith("generation-")]) <= I.SEGMENTS + 2


def test_reasons_for_a_full_build(tmp_path):
    store, facts = I.IndexStore(str(tmp_path / "index")), {"config": "c", "roots": ["src"], "repository": "r"}
    assert store.why_not(**facts) == "missing"
    assert store.commit({}, baseline={"head": "h"}, **facts) == (1, 0) and store.why_not(**facts) is None
    for change, reason in (({"config": "d"}, "configuration_changed"), ({"roots": ["."]}, "source_roots_remapped"), ({"repository": "q"}, "repository_changed")):
        assert store.why_not(**facts | change) == reason
    open(store.lock, "w").close()
    assert store.why_not(**facts) == "locked"
    os.utime(store.lock, (0, 0))
    assert store.why_not(**facts) is None
    for change, reason in (({"baseline": None}, "no_baseline"), ({"baseline": {"head": "h"}, "tables": {"files": [{"rows": "generation-9/files"}]}}, "corrupt"), ({"version": 0}, "incompatible")):
        store.note(**change)
        assert store.why_not(**facts) == reason
    assert store.commit({}, baseline={"head": "h"}, **facts)[0] == 2 and not os.path.exists(store.lock)
    with open(store.path, "w") as f:
        f.write("[")
    assert store.why_not(**facts) == "corrupt"


def test_stored_tables_that_go_away(spark, tmp_path):
    root, index = committed(write(tmp_path / "repo", {"src/a.py": "import b\n", "src/b.py": ""})), str(tmp_path / "index")
    Engine.build(spark, root, index)
    engine = Engine.build(spark, root, index)
    shutil.rmtree(os.path.join(index, "generation-1"))
    assert engine.impact(["src/b.py"])["direct"] == ["src/a.py"] and engine.work.reason == "storage_failure"


def test_nested_repositories_have_no_safe_delta(tmp_path):
    root = committed(write(tmp_path / "repo", {"src/a.py": "import b\n", "src/b.py": ""}))
    assert git.baseline(root)["dirty"] == []
    write(root, {"src/c.py": ""})
    assert git.baseline(root)["dirty"] == ["src/c.py"]
    committed(write(os.path.join(root, ".venv/inner"), {"c.py": ""}))
    assert git.baseline(root) is not None  # the walk does not enter it
    committed(write(os.path.join(root, "src/inner"), {"c.py": "import a\n"}))
    assert git.baseline(root) is None
    shutil.rmtree(os.path.join(root, "src/inner"))
    assert git.baseline(root) is not None
    write(root, {".gitmodules": ""})
    assert git.baseline(root) is None
