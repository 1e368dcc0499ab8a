import collections
import random
import re
from collections import deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rippleframe.errors import ConfigError, GitError
from rippleframe.functions.paths import glob_to_regex
from rippleframe.operators import changes as C
from rippleframe.operators import loops
from rippleframe.operators import pytest_relations as T
from rippleframe.operators.graph import closure_paths, closure_summary, reverse_closure, shortest_paths
from rippleframe.operators.resolve import resolve
from rippleframe.queries import QUERIES
from rippleframe.sources.git import decode_status
from rippleframe.sources.inventory import normalize_excludes, normalize_roots


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=25))
def test_closure_and_shortest_paths_against_bfs(spark, pairs):
    compare_traversals(spark, pairs)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 9), min_size=3, max_size=14))
def test_traversals_of_chains_against_bfs(spark, walk):
    """Few edges, so that many nodes have one dependency and one dependent."""
    compare_traversals(spark, set(zip(walk, walk[1:])))


def compare_traversals(spark, pairs):
    edges = {(a, b) for a, b in pairs if a != b}
    frame = spark.createDataFrame(sorted(edges), "dependent int, dependency int")
    back, ahead = {}, {}
    for a, b in sorted(edges):
        back.setdefault(b, []).append(a)
        ahead.setdefault(a, []).append(b)
    want = set()
    for s in (0, 3):
        seen, queue = {s}, deque([s])
        while queue:
            for x in back.get(queue.popleft(), ()):
                if x not in seen:
                    seen.add(x)
                    queue.append(x)
        want |= {(s, x) for x in seen - {s}}
    got = {tuple(r) for r in reverse_closure(frame, spark.createDataFrame([(0,), (3,)], "node int")).collect()}
    assert got == want
    parents, queue = {7: None}, deque([7])
    while queue:
        at = queue.popleft()
        for x in ahead.get(at, ()):
            if x not in parents:
                parents[x] = at
                queue.append(x)
    path, at = [], 0 if 0 in parents else None
    while at is not None:
        path.append(at)
        at = parents[at]
    found = shortest_paths(frame, spark.createDataFrame([(0, 7)], "changed int, affected int")).collect()
    assert [list(r["path"]) for r in found] == ([path[::-1]] if path else [])


def test_empty_graph(spark):
    edges = spark.createDataFrame([], "dependent string, dependency string")
    assert reverse_closure(edges, spark.createDataFrame([("a",)], "node string")).collect() == []


@pytest.mark.parametrize("glob,path,hit", [("src/*.py", "src/a.py", True), ("src/*.py", "src/b/a.py", False), ("**/x", "x", True), ("**/x", "a/b/x", True), ("a/**", "a/b/c", True), ("t?", "t/", False), ("[!a]b", "cb", True), ("{x,y}z", "yz", True)])
def test_globs(glob, path, hit):
    assert bool(re.fullmatch(glob_to_regex(glob), path)) is hit


def test_configuration_rejections():
    for bad in ("/a", "a/../b", "", "c:\\x", "a\\b"):
        with pytest.raises(ConfigError):
            normalize_roots([bad], "root")
    with pytest.raises(ConfigError):
        normalize_excludes(["./a/", "a"])
    with pytest.raises(ConfigError):
        normalize_excludes(["a["])
    assert normalize_roots(["./src/", "."], "root") == ("src", ".")


def test_status_decoder():
    assert decode_status(b"R090\0a.py\0b.py\0C100\0c\0d\0M\0e\0T\0f\0") == [("Renamed", "b.py", "a.py"), ("Added", "d", None), ("Modified", "e", None), ("Modified", "f", None)]
    for bad in (b"R1\0a\0", b"Q\0a\0", b"M\0../a\0", b"M\0/a\0", b"M\0\xff\0"):
        with pytest.raises(GitError):
            decode_status(bad)


def test_changes_cross_kinds_and_exclusions(spark):
    rows = [("Modified", "gen/a.py", None), ("Renamed", "src/b.py", "gen/b.py"), ("Renamed", "gen/c.py", "src/c.py"), ("Renamed", "x.txt", "src/d.py"), ("Renamed", "pyproject.toml", "old.py"), ("Modified", "a.md", None)]
    kept = C.relevant_changes(spark.createDataFrame(rows, "kind string, path string, previous_path string"))
    got = {(r["kind"], r["path"], r["previous_path"]) for r in C.exclude_changes(kept, ["gen"]).collect()}
    assert got == {("Added", "src/b.py", None), ("Deleted", "src/c.py", None), ("Deleted", "src/d.py", None), ("Added", "pyproject.toml", None), ("Deleted", "old.py", None)}


def test_resolution_rules(spark):
    files = spark.createDataFrame([("p/__init__.py", "p", True, False), ("p/a.py", "p.a", False, False), ("p/q/b.py", "p.q.b", False, False)], "path string, module string, is_package boolean, is_test boolean")
    shape = "path string, ordinal int, kind string, module string, name string, level int, api string, package string, fromlist array<string>, reason string, line int, col int"
    row = lambda i, path, kind, module, name=None, level=0, package=None, fromlist=None: (path, i, kind, module, name, level, None, package, fromlist, None, 1, 1)
    rows = [
        row(0, "p/q/b.py", "import", "p.a.c"), row(1, "p/q/b.py", "from", None, "a", 2), row(2, "p/q/b.py", "from", None, "x", 4), row(3, "p/q/b.py", "from", None, "x", 5), row(4, "p/a.py", "dynamic", None),
        row(5, "p/q/b.py", "dynamic", "..a"), row(6, "p/a.py", "dynamic", ".b", package="p.q"), row(7, "p/a.py", "dynamic", "p", fromlist=["a", "*"]), row(8, "p/__init__.py", "from", None, "a", 1), row(9, "p/a.py", "from", "p", "*"),
    ]
    got = {r["ordinal"]: (list(r["resolved"]), r["status"]) for r in resolve(spark.createDataFrame(rows, shape), files).collect()}
    assert got == {
        0: (["p", "p.a"], "resolved"), 1: (["p", "p.a"], "resolved"), 2: ([], "invalid_relative_import"), 3: ([], "invalid_relative_import"), 4: ([], "unresolved_dynamic_import"), 5: (["p", "p.a"], "resolved"),
        6: (["p", "p.q.b"], "resolved"), 7: (["p", "p.a"], "resolved"), 8: (["p", "p.a"], "resolved"), 9: (["p"], "resolved"),
    }


def test_null_ends_are_no_nodes(spark):
    edges = spark.createDataFrame([(1, 0), (None, 1), (2, None), (3, 1), (3, 3), (None, None)], "dependent int, dependency int")
    seeds, asked = spark.createDataFrame([(0,), (None,), (77,)], "node int"), spark.createDataFrame([(0, 2), (0, 3), (0, None), (None, 3), (5, 5)], "changed int, affected int")
    assert sorted(tuple(r) for r in reverse_closure(edges, seeds).collect()) == [(0, 1), (0, 3)]
    assert sorted((r["affected"], r["path"]) for r in shortest_paths(edges, asked).collect()) == [(3, [3, 1, 0]), (5, [5])]


def test_a_long_chain_with_a_ring(spark):
    """10,000 nodes in a row, the last of which depends on a ring; a second, shorter way over part of it."""
    n = 10_000
    edges = [(i + 1, i) for i in range(n)] + [(n + 6, 4000), (n + 7, n + 6), (4005, n + 7)] + [(n + 20 + i, n + 20 + (i + 1) % 5) for i in range(5)] + [(n, n + 20)]
    frame = spark.createDataFrame(edges, "dependent int, dependency int")
    reached = reverse_closure(frame, spark.createDataFrame([(0,), (9_990,), (n + 22,)], "node int")).groupBy("seed").count().collect()
    assert {r["seed"]: r["count"] for r in reached} == {0: n + 2, 9_990: 10, n + 22: 5}
    (found,) = shortest_paths(frame, spark.createDataFrame([(0, n)], "changed int, affected int")).collect()
    assert list(found["path"]) == [*range(n, 4004, -1), n + 7, n + 6, *range(4000, -1, -1)]


def test_many_seeds(spark):
    """More seeds than a word of bits has, each at its own place of a chain with side branches."""
    edges = [(i + 1, i) for i in range(200)] + [(1000 + i, i) for i in range(0, 200, 3)]
    frame = spark.createDataFrame(edges, "dependent long, dependency long")
    got = collections.Counter(r["seed"] for r in reverse_closure(frame, frame.selectExpr("dependency as node").distinct()).collect())
    assert got == {i: 200 - i + sum(1 for j in range(0, 200, 3) if j >= i) for i in range(200)}


def many_graphs():
    """(edges, seeds, causes of each node): 60 small graphs side by side, half of them little more than chains and rings."""
    rand, edges, seeds, causes = random.Random(7), [], [], {}
    for g in range(60):
        nodes = [100 * g + i for i in range(rand.choice((3, 8, 12, 30)))]
        if g % 2:
            walk = rand.sample(nodes, len(nodes)) + rand.choices(nodes, k=rand.choice((0, 1, 2)))
            pairs = set(zip(walk, walk[1:])) | ({(walk[-1], walk[0])} if g % 4 == 1 else set())
        else:
            pairs = {(rand.choice(nodes), rand.choice(nodes)) for _ in range(rand.choice((1, 2)) * len(nodes))}
        own = rand.sample(nodes, rand.choice((1, 3, len(nodes) // 2, len(nodes))))
        edges, seeds, ahead = edges + sorted(pairs), seeds + own, {}
        for a, b in pairs:
            ahead.setdefault(a, set()).add(b)
        for v in nodes:
            seen, queue = set(), [v]
            while queue:
                new = ahead.get(queue.pop(), set()) - seen
                seen |= new
                queue += new
            causes[v] = sorted((seen & set(own)) - {v})
    return edges, seeds, causes


def test_summary_against_search(spark):
    edges, seeds, causes = many_graphs()
    got = closure_summary(spark.createDataFrame(edges + [(None, 1), (5, None)], "dependent int, dependency int"), spark.createDataFrame([(s,) for s in seeds + [None, -5]], "node int")).collect()
    assert sorted(tuple(r) for r in got) == sorted((v, len(c), c[0], c[-1]) for v, c in causes.items() if c)


def test_chain_with_many_seeds_takes_few_rounds(spark, tmp_path):
    """Every third part of 400 is a seed: rounds go by the logarithm of the chain's length, not by its seeds."""
    n = 400
    spark.createDataFrame([(i, "Brand#13" if i % 3 == 0 else "") for i in range(n)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    mine = loops._written.setdefault(spark.sparkContext.applicationId, [])
    before = set(mine)
    got = QUERIES["chain_impact"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(i, (i + 2) // 3, 0, (i - 1) // 3 * 3) for i in range(1, n)]
    assert len(set(loops._written[spark.sparkContext.applicationId]) - before) < 30


def test_closure_paths_equal_shortest_paths(spark):
    """Two layers over 70 seeds, with ties, a ring and an edge past a layer; and pairs are not written one by one."""
    mid, top = range(100, 103), range(200, 300)
    edges = [(m, s) for m in mid for s in range(70) if (m + s) % 3] + [(t, m) for t in top for m in mid if (t + m) % 2 or m == 101] + [(200, 0), (0, 299)]
    frame, seeds = spark.createDataFrame(edges, "dependent long, dependency long"), spark.createDataFrame([(s,) for s in [*range(70), None]], "node long")
    mine = loops._written.setdefault(spark.sparkContext.applicationId, [])
    before = set(mine)
    found = closure_paths(frame, seeds)
    written = sum(spark.read.parquet(p).count() for p in set(mine) - before)
    got = sorted((r["changed"], r["affected"], list(r["path"])) for r in found.collect())
    pairs = reverse_closure(frame, seeds).selectExpr("seed as changed", "node as affected")
    assert got == sorted((r["changed"], r["affected"], list(r["path"])) for r in shortest_paths(frame, pairs).collect())
    assert written < len(got) / 2


def join_rows(df):
    """The most rows that a join of the plan made, once it has run."""
    df.collect()
    most, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        name = p.getClass().getSimpleName()
        if "Join" in name:
            most = max(most, p.longMetric("numOutputRows").value())
        inner = [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else []
        plans += inner + [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_cyclic_query_makes_no_pairs(spark, tmp_path):
    """60 parts that all reach each other, every one a seed: no join makes a row for each pair."""
    n = 60
    spark.createDataFrame([(i, "Brand#13") for i in range(n)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(o, k, part, "N") for o in range(n) for k, part in enumerate((o, (o + 1) % n, (7 * o + 3) % n))]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["impact_closure_cyclic"](spark, str(tmp_path))
    assert join_rows(found) <= 10 * n
    assert sorted((r["node"], r["n_causes"], r["first_cause"], r["last_cause"]) for r in found.collect()) == [(i, n - 1, int(i == 0), n - 1 - (i == n - 1)) for i in range(n)]


def test_repeated_fixture_names_do_not_multiply(spark):
    """300 fixtures of one name, every third automatic, offered to 300 tests: each takes the first."""
    n = 300
    tests = [f"t/test_{i}.py" for i in range(n)]
    files = spark.createDataFrame([(p, p, False, p != "t/conftest.py") for p in [*tests, "t/conftest.py"]], "path string, module string, is_package boolean, is_test boolean")
    fixtures = spark.createDataFrame([("t/conftest.py", i, f"fx{i % 2}", i % 3 == 2, None, n - i, 1, []) for i in range(n)], "path string, ordinal int, name string, autouse boolean, scope string, line int, col int, params array<string>")
    requests = spark.createDataFrame([(p, 0, "fixture", "fx0", None, 1, 1) for p in tests], "path string, ordinal int, kind string, name string, scope string, line int, col int")
    found = T.fixture_edges(files, requests, fixtures)
    assert sorted((r["dependent"], r["name"], r["line"]) for r in found.collect()) == sorted((p, name, line) for p in tests for name, line in (("fx0", n), ("fx1", n - 1)))
    assert join_rows(found) <= 10 * n
