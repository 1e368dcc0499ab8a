"""Facts of one Python source, by the standard library's `ast`. No Spark here.

Two passes: the first collects aliases of the import API and of the test framework, and names
that hide them; the second collects imports, exports, fixtures, requests and what can't be known.
Locations are 1-indexed characters; a decorated definition starts at its first decorator."""

from __future__ import annotations

import ast
import re

_LINES = re.compile("\r\n|\r|\n")


def _dotted(node, through_calls: bool = False) -> str | None:
    parts = []
    while True:
        if isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        elif through_calls and isinstance(node, ast.Call):
            if parts and not isinstance(node.func, (ast.Name, ast.Attribute, ast.Call)):
                return None
            node = node.func
        elif isinstance(node, ast.Name):
            return ".".join([node.id, *reversed(parts)])
        else:
            return None


def _text(node) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _texts(node) -> list[str] | None:
    if isinstance(node, (ast.List, ast.Tuple)):
        found = [_text(x) for x in node.elts]
        return None if None in found else found
    return None if _text(node) is None else [_text(node)]


def _argument(call: ast.Call, name: str, position: int):
    for k in call.keywords:
        if k.arg == name:
            return k.value
    plain = call.args[: position + 1]
    return plain[position] if len(plain) > position and not any(isinstance(a, ast.Starred) for a in plain) else None


def _parameters(node) -> list[str]:
    a = node.args
    return [p.arg for p in [*a.posonlyargs, *a.args, *filter(None, [a.vararg]), *a.kwonlyargs, *filter(None, [a.kwarg])]]


def _start(node) -> tuple[int, int]:
    first = getattr(node, "decorator_list", None)
    return (first[0].lineno, node.col_offset) if first else (node.lineno, node.col_offset)


_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _walk(node):
    """Children in source order, decorators before the rest."""
    decorators = getattr(node, "decorator_list", [])
    yield from decorators
    for child in ast.iter_child_nodes(node):
        if child not in decorators:
            yield child


class _Bindings:
    """Aliases and hidden names; a hidden name holds everywhere or inside one definition."""

    def __init__(self, tree: ast.Module):
        self.importlib, self.import_module, self.pytest, self.mark, self.fixture = set(), set(), set(), set(), set()
        self.hidden: set[str] = set()
        self.inside: list[tuple[str, tuple, tuple]] = []
        self._visit(tree, None)

    def hides(self, name: str, node) -> bool:
        at, end = (node.lineno, node.col_offset), (node.end_lineno, node.end_col_offset)
        return name in self.hidden or any(n == name and a <= at and end <= b for n, a, b in self.inside)

    def _hide(self, name: str, scope) -> None:
        if scope is None:
            self.hidden.add(name)
        else:
            self.inside.append((name, _start(scope), (scope.end_lineno, scope.end_col_offset)))

    def _api(self, names: set[str], bound: str, scope) -> None:
        names.add(bound)
        if scope is None:
            self.hidden.discard(bound)

    def _bound(self, bound: str, scope) -> None:
        if bound in ("importlib", "import_module") or bound in self.importlib or bound in self.import_module:
            self._hide(bound, scope)

    def _visit(self, node, scope) -> None:
        if isinstance(node, ast.Import):
            for alias in node.names:
                bound = alias.asname or alias.name.split(".")[0]
                if alias.name == "importlib":
                    self._api(self.importlib, bound, scope)
                elif alias.name == "pytest":
                    self.pytest.add(bound)
                else:
                    self._bound(bound, scope)
        elif isinstance(node, ast.ImportFrom):
            for alias in node.names:
                bound = alias.asname or alias.name
                if node.module == "importlib" and alias.name == "import_module":
                    self._api(self.import_module, bound, scope)
                elif node.module == "pytest":
                    {"fixture": self.fixture, "mark": self.mark}.get(alias.name, set()).add(bound)
                else:
                    self._bound(bound, scope)
        elif isinstance(node, (*_DEFS, ast.ClassDef)):
            self._hide(node.name, scope)
            scope = node
            if isinstance(node, _DEFS):
                for name in _parameters(node):
                    self._hide(name, node)
        elif isinstance(node, ast.Assign):
            for target in node.targets:
                if isinstance(target, ast.Name):
                    self._hide(target.id, scope)
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            self._hide(node.target.id, scope)
        elif isinstance(node, ast.AugAssign) and isinstance(node.target, ast.Name) and node.target.id == "__all__":
            self._hide("__all__", scope)
        for child in _walk(node):
            self._visit(child, scope)


class _Facts:
    def __init__(self, source: str, tree: ast.Module):
        self.lines = [x.encode() for x in _LINES.split(source)]
        self.known = _Bindings(tree)
        self.imports, self.exports, self.fixtures, self.requests, self.uses, self.plugins, self.uncertain = [], [], [], [], [], [], []
        self.classes: list[str] = []
        for child in tree.body:
            self._visit(child)

    def _place(self, at: tuple[int, int]) -> dict:
        line = self.lines[at[0] - 1] if at[0] <= len(self.lines) else b""
        return {"line": at[0], "col": len(line[: at[1]].decode("utf-8", "ignore")) + 1}

    def _scope(self) -> str | None:
        return self.classes[-1] if self.classes else None

    def _unsure(self, kind: str, place: dict) -> None:
        self.uncertain.append({"kind": kind, **place})

    def _import(self, place: dict, **fields) -> None:
        row = dict.fromkeys(("module", "name", "api", "package", "reason")) | {"level": 0, "fromlist": [], **fields}
        self.imports.append(row | place)

    def _is_usefixtures(self, name: str | None) -> bool:
        if not name:
            return False
        prefix = name.removesuffix(".usefixtures") if name.endswith(".usefixtures") else None
        return name == "pytest.mark.usefixtures" or prefix in self.known.mark or name.endswith(".mark.usefixtures") and name.split(".")[0] in self.known.pytest

    def _use(self, call: ast.Call, place: dict, scope: str | None) -> None:
        for argument in call.args:
            if (name := _text(argument)) is not None:
                self.uses.append({"kind": "usefixtures", "name": name, "scope": scope, **place})
            else:
                self._unsure("fixtures", place)

    def _function(self, node) -> None:
        place, scope, params = self._place(_start(node)), self._scope(), _parameters(node)
        if node.name == "__getattr__":
            self._unsure("exports", place)
        self.requests += [{"kind": "fixture", "name": p, "scope": scope, **place} for p in params]
        for decorator in node.decorator_list:
            call = decorator if isinstance(decorator, ast.Call) else None
            name = _dotted(decorator, True)
            base = _dotted(call.func, True) if call else name
            if name is None or base is None:
                continue
            fixture = base in self.known.fixture or base == "fixture" or base.endswith(".fixture") and base.split(".")[0] in self.known.pytest
            if not fixture and name.endswith("fixture"):
                self._unsure("fixtures", place)
            if fixture:
                row = {"name": node.name, "autouse": False, "scope": scope, **place, "params": params}
                for k in call.keywords if call else ():
                    if k.arg == "name":
                        if (value := _text(k.value)) is not None:
                            row["name"] = value
                        else:
                            self._unsure("fixtures", self._place((k.lineno, k.col_offset)))
                    elif k.arg == "autouse":
                        if isinstance(k.value, ast.Constant) and isinstance(k.value.value, bool):
                            row["autouse"] = k.value.value
                        else:
                            self._unsure("fixtures", self._place((k.lineno, k.col_offset)))
                self.fixtures.append(row)
            if call and self._is_usefixtures(base):
                self._use(call, place, scope)

    def _assign(self, node: ast.Assign) -> None:
        place = self._place((node.lineno, node.col_offset))
        for target in node.targets:
            if not isinstance(target, ast.Name):
                continue
            if target.id == "pytest_plugins":
                if (values := _texts(node.value)) is None:
                    self._unsure("plugins", place)
                else:
                    self.plugins += [{"name": v, **place} for v in values]
            elif target.id == "__all__":
                if (values := _texts(node.value)) is None:
                    self._unsure("exports", place)
                else:
                    self.exports += [{"name": v, "module": None, "imported_name": None, "level": 0, "wildcard": False, **place} for v in values]
            elif target.id == "pytestmark" and isinstance(node.value, ast.Call) and self._is_usefixtures(_dotted(node.value.func, True)):
                self._use(node.value, place, self._scope())

    def _call(self, node: ast.Call) -> None:
        name, place = _dotted(node.func), self._place((node.lineno, node.col_offset))
        if name is None:
            return
        if name in ("__all__.append", "__all__.extend"):
            self._unsure("exports", place)
        if name == "request.getfixturevalue":
            if node.args and (value := _text(node.args[0])) is not None:
                self.requests.append({"kind": "fixture", "name": value, "scope": self._scope(), **place})
            else:
                self._unsure("fixture_lookup", place)
        head = name.split(".")[0]
        if head in self.known.importlib and name.endswith(".import_module") and not self.known.hides(head, node) or name in self.known.import_module and not self.known.hides(name, node):
            api = "import_module"
        elif name == "__import__" and not self.known.hides(name, node):
            api = "__import__"
        else:
            return
        level = _argument(node, "level", 4) if api == "__import__" else None
        level = level.value if isinstance(level, ast.Constant) and type(level.value) is int and level.value >= 0 else 0
        module = _text(_argument(node, "name", 0))
        if module is not None and level > 0 and not module.startswith("."):
            module = "." * level + module
        reason = None if module is not None else "dynamic import target is not a literal string"
        self._import(place, kind="dynamic", api=api, module=module, package=_text(_argument(node, "package", 1)), level=level, fromlist=_texts(_argument(node, "fromlist", 3)) or [], reason=reason)

    def _visit(self, node) -> None:
        if isinstance(node, ast.Import):
            for alias in node.names:
                self._import(self._place((alias.lineno, alias.col_offset)), kind="import", module=alias.name)
        elif isinstance(node, ast.ImportFrom):
            for alias in node.names:
                place = self._place((alias.lineno, alias.col_offset))
                if node.module != "importlib":
                    self.exports.append({"name": alias.asname or alias.name, "module": node.module, "imported_name": alias.name, "level": node.level, "wildcard": alias.name == "*", **place})
                self._import(place, kind="from", module=node.module, name=alias.name, level=node.level)
        elif isinstance(node, _DEFS):
            self._function(node)
        elif isinstance(node, ast.ClassDef):
            for decorator in node.decorator_list:
                if isinstance(decorator, ast.Call) and self._is_usefixtures(_dotted(decorator.func, True)):
                    self._use(decorator, self._place(_start(node)), node.name)
            self.classes.append(node.name)
        elif isinstance(node, ast.Assign):
            self._assign(node)
        elif isinstance(node, (ast.AnnAssign, ast.AugAssign)) and isinstance(node.target, ast.Name) and node.target.id == "__all__":
            if isinstance(node, ast.AugAssign) or node.value is None:
                self._unsure("exports", self._place((node.lineno, node.col_offset)))
        elif isinstance(node, ast.Call):
            self._call(node)
        for child in _walk(node):
            self._visit(child)
        if isinstance(node, ast.ClassDef):
            self.classes.pop()


def parse_source(path: str, source: str) -> dict:
    """A row of schemas.FACTS; `error` is set where the source can't be parsed."""
    empty = {k: [] for k in ("imports", "exports", "fixtures", "requests", "plugins", "uncertainty")}
    try:
        tree = ast.parse(source)
        facts = _Facts(source, tree)
    except (SyntaxError, ValueError, RecursionError) as e:
        return {"path": path, **empty, "error": f"{type(e).__name__}: {e}"}
    exports = facts.exports
    if path.rsplit("/", 1)[-1] != "__init__.py" and not any(e["module"] is None and e["imported_name"] is None for e in exports):
        exports = [e for e in exports if e["module"] is None]
    number = lambda rows: [{"ordinal": i, **r} for i, r in enumerate(rows)]
    return {
        "path": path, "imports": number(facts.imports), "exports": number(exports), "fixtures": number(facts.fixtures),
        "requests": number([*facts.requests, *facts.uses]), "plugins": number(facts.plugins), "uncertainty": facts.uncertain, "error": None,
    }
