from rippleframe.sources.parser import parse_source


def imports(source, path="src/a.py"):
    facts = parse_source(path, source)
    assert facts["error"] is None, facts["error"]
    return [(i["kind"], i["module"], i["name"], i["level"], i["line"], i["col"]) for i in facts["imports"]]


def dynamic(source):
    return [(i["api"], i["module"], i["package"], i["level"], i["fromlist"], i["reason"] is not None) for i in parse_source("a.py", source)["imports"] if i["kind"] == "dynamic"]


def test_every_scope_and_alias_location():
    got = imports("import a.b, c as d\ndef f():\n    if x:\n        from ..p import (q as r, é, z)\n")
    assert got == [("import", "a.b", None, 0, 1, 8), ("import", "c", None, 0, 1, 13), ("from", "p", "q", 2, 4, 26), ("from", "p", "é", 2, 4, 34), ("from", "p", "z", 2, 4, 37)]


def test_columns_count_characters():
    assert imports("s = 'éé'; import x\n") == [("import", "x", None, 0, 1, 18)]


def test_relative_without_module():
    assert imports("from . import x\n") == [("from", None, "x", 1, 1, 15)]


def test_dynamic_forms():
    assert dynamic("import importlib\nimportlib.import_module('a.b', package='p')\n") == [("import_module", "a.b", "p", 0, [], False)]
    assert dynamic("from importlib import import_module as load\nload(NAME)\n") == [("import_module", None, None, 0, [], True)]
    assert dynamic("__import__('m', None, None, ['x', 'y'], 2)\n") == [("__import__", "..m", None, 2, ["x", "y"], False)]


def test_hidden_names_are_not_the_api():
    assert dynamic("from importlib import import_module\ndef f(import_module):\n    import_module('a')\nimport_module('b')\n") == [("import_module", "b", None, 0, [], False)]
    assert dynamic("def __import__(x):\n    pass\n__import__('a')\n") == []
    assert dynamic("import importlib\nimportlib = 3\nimportlib.import_module('a')\n") == []


def test_exports_outside_packages_need_all():
    source = "from x import y as z\n"
    assert parse_source("a.py", source)["exports"] == []
    assert [e["name"] for e in parse_source("p/__init__.py", source)["exports"]] == ["z"]
    assert [e["name"] for e in parse_source("a.py", source + "__all__ = ['z', 'w']\n")["exports"]] == ["z", "z", "w"]


def test_fixtures_and_requests():
    facts = parse_source("tests/conftest.py", "import pytest as pt\n\n\n@pt.fixture(name='db', autouse=True)\ndef make(url, *rest):\n    pass\n\n\nclass TestA:\n    @pt.mark.usefixtures('db', OTHER)\n    def test_x(self, request):\n        request.getfixturevalue('late')\n        request.getfixturevalue(name)\n")
    assert [(f["name"], f["autouse"], f["scope"], f["line"], f["col"], f["params"]) for f in facts["fixtures"]] == [("db", True, None, 4, 1, ["url", "rest"])]
    assert [(r["kind"], r["name"], r["scope"]) for r in facts["requests"]] == [("fixture", "url", None), ("fixture", "rest", None), ("fixture", "self", "TestA"), ("fixture", "request", "TestA"), ("fixture", "late", "TestA"), ("usefixtures", "db", "TestA")]
    assert sorted(u["kind"] for u in facts["uncertainty"]) == ["fixture_lookup", "fixtures"]


def test_uncertain_exports_and_plugins():
    kinds = lambda s: [u["kind"] for u in parse_source("a.py", s)["uncertainty"]]
    assert kinds("__all__ = names()\n") == ["exports"]
    assert kinds("__all__ += ['a']\n") == ["exports"]
    assert kinds("__all__: list\n") == ["exports"]
    assert kinds("__all__: list = ['a']\n") == []
    assert kinds("__all__.append('a')\n") == ["exports"]
    assert kinds("def __getattr__(n):\n    pass\n") == ["exports"]
    assert kinds("pytest_plugins = load()\n") == ["plugins"]
    assert [p["name"] for p in parse_source("a.py", "pytest_plugins = ('p', 'q')\n")["plugins"]] == ["p", "q"]


def test_syntax_errors_are_rows():
    facts = parse_source("a.py", "def (:\n")
    assert facts["error"].startswith("SyntaxError") and facts["imports"] == []
