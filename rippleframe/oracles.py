"""SQL twins of the registered queries, built from shared common table expressions."""

from __future__ import annotations

FILES = """files AS (
  SELECT p_partkey AS k,
    CASE WHEN p_size <= 5 THEN 'tests/g' || (p_partkey % 20) || '/test_m' || p_partkey || '.py' ELSE 'src/g' || (p_partkey % 20) || '/m' || p_partkey || '.py' END AS path,
    CASE WHEN p_size <= 5 THEN 'tests.g' || (p_partkey % 20) || '.test_m' || p_partkey ELSE 'g' || (p_partkey % 20) || '.m' || p_partkey END AS module,
    false AS is_package, p_size <= 5 AS is_test
  FROM part
  UNION ALL SELECT NULL, 'src/g' || g || '/__init__.py', 'g' || g, true, false FROM range(0, 20, 2) t(g))"""


def edges(keep: str = "true", layered: bool = True, name: str = "edges") -> str:
    pick = "CASE WHEN a.l_partkey % 8 > b.l_partkey % 8 THEN {} ELSE {} END"
    one, two = (pick.format("a.l_partkey", "b.l_partkey"), pick.format("b.l_partkey", "a.l_partkey")) if layered else ("a.l_partkey", "b.l_partkey")
    differ = "a.l_partkey % 8 <> b.l_partkey % 8" if layered else "a.l_partkey <> b.l_partkey"
    return f"""{name} AS (SELECT DISTINCT {one} AS dependent, {two} AS dependency
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE {keep} AND {differ})"""


SEEDS = "seeds AS (SELECT p_partkey AS node FROM part WHERE p_brand = 'Brand#13')"
REACH = "reach(seed, node) AS (SELECT node, node FROM seeds UNION SELECT r.seed, e.dependent FROM reach r JOIN edges e ON e.dependency = r.node)"
PATH_EDGES = "edges AS (SELECT a.path AS dependent, b.path AS dependency FROM key_edges e JOIN files a ON a.k = e.dependent JOIN files b ON b.k = e.dependency)"
PATH_SEEDS = "seeds AS (SELECT path AS node FROM files JOIN part ON p_partkey = k WHERE p_brand = 'Brand#13')"
IMPACT = """causes AS (SELECT node, seed AS cause FROM reach WHERE node <> seed
    UNION ALL SELECT s.node, s.node FROM seeds s JOIN tests t ON t.path = s.node),
  impact AS (SELECT c.node AS path, CASE WHEN c.node IN (SELECT node FROM seeds) THEN 'changed'
      WHEN c.node IN (SELECT e.dependent FROM edges e JOIN seeds s ON s.node = e.dependency) THEN 'direct' ELSE 'transitive' END AS cls,
    c.node IN (SELECT path FROM tests) AS is_test, string_agg(DISTINCT c.cause, ',' ORDER BY c.cause) AS caused_by, count(DISTINCT c.cause) AS n_causes
  FROM causes c GROUP BY c.node
  HAVING c.node NOT IN (SELECT node FROM seeds) OR c.node IN (SELECT path FROM tests))"""
TESTS = "tests AS (SELECT path FROM files WHERE is_test)"
PATHS = f"{FILES}, {edges(name='key_edges')}, {PATH_EDGES}, {PATH_SEEDS}, {TESTS}, {REACH}, {IMPACT}"

IMPORTS = f"""{FILES}, {edges(name='key_edges')},
  raw AS (SELECT e.*, a.path, a.k, a.module AS importer, b.module AS target, (e.dependent + e.dependency) % 4 AS f,
      (e.dependent + e.dependency) % 4 = 2 AND e.dependent % 20 = e.dependency % 20 AND a.is_test = b.is_test AS near
    FROM key_edges e JOIN files a ON a.k = e.dependent JOIN files b ON b.k = e.dependency),
  imports AS (SELECT path, k, importer, CAST(row_number() OVER (PARTITION BY path ORDER BY dependency) AS INTEGER) AS ordinal,
      CASE WHEN f = 1 OR near THEN 'from' ELSE 'import' END AS kind,
      CASE WHEN f = 3 THEN 'ext' || (dependency % 10) || '.mod' WHEN f = 1 THEN regexp_replace(target, '\\.[^.]*$', '') WHEN near THEN NULL ELSE target END AS module,
      CASE WHEN f = 1 OR near THEN regexp_extract(target, '[^.]*$') END AS name, CAST(CASE WHEN near THEN 1 ELSE 0 END AS INTEGER) AS level
    FROM raw),
  whole AS (SELECT *, CASE WHEN kind = 'import' THEN module WHEN level = 0 THEN module || '.' || name ELSE regexp_replace(importer, '\\.[^.]*$', '') || '.' || name END AS full_name FROM imports),
  candidates AS (SELECT path, k, importer, ordinal, array_to_string(list_slice(string_split(full_name, '.'), 1, i), '.') AS candidate
    FROM (SELECT *, unnest(range(1, len(string_split(full_name, '.')) + 1)) AS i FROM whole)),
  hits AS (SELECT c.*, f.path AS target_path FROM candidates c JOIN files f ON f.module = c.candidate),
  import_rows AS (SELECT DISTINCT path AS dependent, k, target_path AS dependency, ordinal FROM hits WHERE candidate <> importer)"""

TREE = """dirs AS (SELECT n_nationkey, 'tests/' || r_name AS rdir, 'tests/' || r_name || '/' || n_name AS ndir FROM nation JOIN region ON n_regionkey = r_regionkey),
  tests AS (SELECT c_custkey, ndir || '/test_c' || c_custkey || '.py' AS path, ndir, rdir FROM customer JOIN dirs ON c_nationkey = n_nationkey),
  sees AS (SELECT path, unnest([ndir, rdir, 'tests']) || '/conftest.py' AS conftest, unnest([0, 1, 2]) AS distance FROM tests),
  fixtures AS (SELECT s_suppkey, ndir || '/conftest.py' AS conftest, rdir, true AS near FROM supplier JOIN dirs ON s_nationkey = n_nationkey
    UNION ALL SELECT s_suppkey, rdir || '/conftest.py', rdir, false FROM supplier JOIN dirs ON s_nationkey = n_nationkey WHERE s_suppkey % 7 = 0),
  offered AS (SELECT s.path, s.conftest, s.distance, f.s_suppkey, 'fx' || (f.s_suppkey % 10) AS name, row_number() OVER (PARTITION BY s.path, f.s_suppkey % 10 ORDER BY s.distance, f.s_suppkey) AS r
    FROM sees s JOIN fixtures f ON f.conftest = s.conftest)"""

CHANGES = f"""{FILES}, parts AS (SELECT count(*) AS n FROM part),
  changes AS (SELECT o_orderkey, CASE WHEN o_totalprice < 3000 THEN 'Deleted' WHEN o_totalprice < 6000 THEN 'Renamed' WHEN o_orderstatus = 'O' THEN 'Added' ELSE 'Modified' END AS kind, a.path,
      CASE WHEN o_totalprice >= 3000 AND o_totalprice < 6000 THEN b.path END AS previous_path
    FROM orders CROSS JOIN parts JOIN files a ON a.k = o_custkey % n JOIN files b ON b.k = (o_custkey + 1) % n)"""


GONE = "gone AS (SELECT DISTINCT CASE WHEN kind = 'Deleted' THEN path ELSE previous_path END AS path FROM changes WHERE kind IN ('Deleted', 'Renamed'))"
CLOSURE = "SELECT node, count(*) AS n_causes, min(seed) AS first_cause, max(seed) AS last_cause FROM reach WHERE seed <> node GROUP BY node"
_IN = "(path LIKE 'src/g1/%' OR path LIKE 'src/g5/%')"
_PIN = "(previous_path LIKE 'src/g1/%' OR previous_path LIKE 'src/g5/%')"

SQL = {
    "impact_closure": f"WITH RECURSIVE {edges()}, {SEEDS}, {REACH} {CLOSURE}",
    "impact_closure_cyclic": f"WITH RECURSIVE {edges(layered=False)}, {SEEDS}, {REACH} {CLOSURE}",
    "impact_partition": f"WITH RECURSIVE {PATHS} SELECT path, cls, is_test, caused_by FROM impact",
    "affected_tests": f"WITH RECURSIVE {PATHS} SELECT path FROM impact WHERE is_test ORDER BY path",
    "plan_targets": f"WITH RECURSIVE {PATHS} SELECT 'selective' AS mode, path AS target FROM impact WHERE is_test UNION ALL SELECT 'none', NULL WHERE NOT EXISTS (SELECT 1 FROM impact WHERE is_test)",
    "why_path": f"""WITH RECURSIVE {edges()}, {SEEDS},
  reach(seed, node, d) AS (SELECT node, node, 0 FROM seeds UNION SELECT r.seed, e.dependent, r.d + 1 FROM reach r JOIN edges e ON e.dependency = r.node),
  dist AS (SELECT seed, node, min(d) AS d FROM reach GROUP BY seed, node),
  hop AS (SELECT a.seed, a.node, min(e.dependency) AS next FROM dist a JOIN edges e ON e.dependent = a.node JOIN dist b ON b.seed = a.seed AND b.node = e.dependency AND b.d = a.d - 1 GROUP BY a.seed, a.node),
  walk(seed, affected, node, path) AS (SELECT seed, node, node, [node] FROM dist WHERE d > 0 UNION ALL
    SELECT w.seed, w.affected, h.next, list_append(w.path, h.next) FROM walk w JOIN hop h ON h.seed = w.seed AND h.node = w.node)
SELECT seed AS changed, affected, array_to_string(list_transform(path, lambda x: CAST(x AS VARCHAR)), '>') AS path, len(path) - 1 AS n_steps FROM walk WHERE node = seed""",
    "neighbours": f"""WITH {edges()}, nodes AS (SELECT dependent AS node FROM edges UNION SELECT dependency FROM edges),
  d AS (SELECT dependent AS node, count(*) AS n, min(dependency) AS m FROM edges GROUP BY 1), r AS (SELECT dependency AS node, count(*) AS n, min(dependent) AS m FROM edges GROUP BY 1)
SELECT node, coalesce(d.n, 0) AS n_dependencies, coalesce(r.n, 0) AS n_dependents, d.m AS first_dependency, r.m AS first_dependent FROM nodes LEFT JOIN d USING (node) LEFT JOIN r USING (node)""",
    "edge_mutations": f"""WITH {edges("a.l_returnflag <> 'R'", name='old')}, {edges("a.l_returnflag <> 'A'", name='new')}
SELECT *, 'added' AS change FROM (SELECT * FROM new EXCEPT SELECT * FROM old) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM old EXCEPT SELECT * FROM new)""",
    "path_to_module": f"WITH {FILES} SELECT path, module, is_package FROM files",
    "is_test_flag": f"WITH {FILES} SELECT path, is_test AS by_name, is_test OR path LIKE 'src/g3/%' AS with_root FROM files",
    "exclude_glob": f"""WITH {FILES}, marked AS (SELECT path, path LIKE 'src/g1/%' OR regexp_full_match(path, '(.*/)?m[^/]*7\\.py') OR regexp_matches(path, '^tests/g[^/]/') AS excluded FROM files)
SELECT path, excluded, NOT excluded AS discoverable FROM marked""",
    "import_candidates": f"WITH {IMPORTS} SELECT path, ordinal, candidate FROM candidates",
    "import_resolution": f"""WITH {IMPORTS}, found AS (SELECT path, ordinal, string_agg(candidate, ',' ORDER BY candidate) AS resolved FROM hits GROUP BY 1, 2)
SELECT i.path, i.ordinal, CASE WHEN resolved IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, coalesce(resolved, '') AS resolved FROM imports i LEFT JOIN found USING (path, ordinal)""",
    "import_edges": f"WITH {IMPORTS} SELECT dependent, dependency, count(*) AS n_evidence FROM import_rows GROUP BY 1, 2",
    "unresolved_imports": f"""WITH {IMPORTS} SELECT path AS importer, ordinal AS line, CAST(1 AS INTEGER) AS col,
  CASE WHEN kind = 'import' THEN 'import ' || module ELSE 'from ' || repeat('.', level) || coalesce(module, '') || ' import ' || name END AS shown
FROM imports i WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.path = i.path AND h.ordinal = i.ordinal) ORDER BY importer, line, col""",
    "graph_summary": f"""WITH {IMPORTS} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(DISTINCT module) FROM files) AS modules, (SELECT count(*) FROM (SELECT DISTINCT dependent, dependency FROM import_rows)) AS import_edges,
  (SELECT count(*) FROM files WHERE is_test) AS tests, (SELECT count(*) FROM imports i WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.path = i.path AND h.ordinal = i.ordinal)) AS unresolved_imports""",
    "export_index": f"""WITH RECURSIVE {FILES}, exported(module, name, target) AS (SELECT 'g' || (k % 20), 'N' || k, module FROM files WHERE k IS NOT NULL AND NOT is_test AND k % 2 = 0
  UNION SELECT 'g' || (CAST(substr(module, 2) AS INTEGER) - 2), name, target FROM exported WHERE module <> 'g0') SELECT * FROM exported""",
    "reexport_edges": f"""WITH {FILES} SELECT t.path AS dependent, m.path AS dependency, 'N' || m.k AS name FROM files t JOIN files m ON m.k = t.k - t.k % 2 AND NOT m.is_test WHERE t.is_test""",
    "reresolve_set": f"WITH {IMPORTS}, {CHANGES.removeprefix(FILES + ', ')}, {GONE} SELECT DISTINCT c.path AS importer FROM candidates c JOIN files f ON f.module = c.candidate JOIN gone g ON g.path = f.path",
    "conftest_visibility": f"WITH {TREE} SELECT path, conftest, CAST(distance AS BIGINT) AS distance FROM sees",
    "fixture_visibility": f"WITH {TREE} SELECT o.path, o.name, conftest, CAST(distance AS BIGINT) AS distance, CAST(s_suppkey AS INTEGER) AS f_line FROM offered o JOIN tests t ON t.path = o.path AND o.name = 'fx' || (c_custkey % 10) WHERE r = 1",
    "fixture_edges": f"""WITH {TREE},
  automatic AS (SELECT path, name, s_suppkey, row_number() OVER (PARTITION BY path, name ORDER BY distance, s_suppkey) AS q FROM offered WHERE s_suppkey % 11 = 0),
  wanted AS (SELECT path, 'fx' || (c_custkey % 10) AS name, 1 AS line FROM tests UNION ALL
    SELECT a.path, a.name, a.s_suppkey FROM automatic a JOIN tests t ON t.path = a.path WHERE q = 1 AND a.name <> 'fx' || (c_custkey % 10))
SELECT w.path AS dependent, o.conftest AS dependency, 'pytest_fixture' AS kind, w.name, CAST(greatest(w.line, o.s_suppkey) AS INTEGER) AS line FROM wanted w JOIN offered o ON o.path = w.path AND o.name = w.name AND o.r = 1""",
    "fixture_dependencies": f"""WITH {TREE}, asked AS (SELECT DISTINCT conftest, rdir, 'fx' || ((s_suppkey + 3) % 10) AS name FROM fixtures WHERE near),
  above AS (SELECT conftest, 'fx' || (s_suppkey % 10) AS name, min(s_suppkey) AS s FROM fixtures GROUP BY 1, 2)
SELECT a.conftest AS dependent, b.conftest AS dependency, a.name, CAST(b.s AS INTEGER) AS line FROM asked a JOIN above b ON b.conftest = a.rdir || '/conftest.py' AND b.name = a.name
WHERE NOT EXISTS (SELECT 1 FROM above o WHERE o.conftest = a.conftest AND o.name = a.name)""",
    "plugin_edges": f"""WITH {TREE}, confs AS (SELECT DISTINCT unnest(['tests', rdir, ndir]) || '/conftest.py' AS path FROM dirs) SELECT path AS dependent, 'src/g' || g || '/__init__.py' AS dependency, 'g' || g AS name FROM confs, range(0, 20, 2) t(g)""",
    "parsed_imports": f"""WITH {IMPORTS} SELECT path, CAST(ordinal AS BIGINT) AS ordinal, kind, module, name, level, ordinal AS line,
  CAST(CASE WHEN kind = 'import' THEN 8 ELSE len('from ' || repeat('.', level) || coalesce(module, '') || ' import ') + 1 END AS INTEGER) AS col FROM imports""",
    "parsed_dynamic_imports": f"""WITH {FILES} SELECT path, CASE WHEN k % 3 = 2 THEN '__import__' ELSE 'import_module' END AS api, CASE k % 3 WHEN 1 THEN module WHEN 2 THEN 'pkg' END AS module,
  CASE WHEN k % 3 = 2 THEN CAST(k AS VARCHAR) ELSE '' END AS fromlist, k % 3 = 0 AS unknown, CAST(2 AS INTEGER) AS line, CAST(5 AS INTEGER) AS col FROM files WHERE k IS NOT NULL""",
    "parsed_fixtures": f"""WITH {TREE}, numbered AS (SELECT *, row_number() OVER (PARTITION BY conftest ORDER BY s_suppkey) - 1 AS ordinal FROM fixtures)
SELECT conftest AS path, ordinal, 'fx' || (s_suppkey % 10) AS name, s_suppkey % 11 = 0 AS autouse, 'fx' || ((s_suppkey + 3) % 10) AS param, CAST(2 + 3 * ordinal AS INTEGER) AS line FROM numbered""",
    "parsed_exports": f"""WITH {FILES}, kept AS (SELECT *, coalesce(k, 0) % 2 = 0 AS listed FROM files)
SELECT path, 'beta' AS name, 'g1' AS module, 'alpha' AS imported_name, CAST(1 AS INTEGER) AS line FROM kept WHERE listed
UNION ALL SELECT path, 'a', NULL, NULL, 2 FROM kept WHERE listed UNION ALL SELECT path, 'n' || coalesce(CAST(k AS VARCHAR), 'x'), NULL, NULL, 2 FROM kept WHERE listed""",
    "uncertainty_reason": f"""WITH {FILES} SELECT path, CASE k % 5 WHEN 0 THEN 'unsupported_exports' WHEN 1 THEN 'unresolved_dynamic_import' ELSE 'unsupported_pytest_relationship' END AS reason FROM files WHERE k % 5 < 3""",
    "relevant_changes": f"""WITH {CHANGES}, named AS (SELECT kind, CASE WHEN o_orderkey % 7 = 0 THEN regexp_replace(path, '\\.py$', '.txt') ELSE path END AS path, previous_path FROM changes)
SELECT DISTINCT CASE WHEN path LIKE '%.py' THEN kind ELSE 'Deleted' END AS kind, CASE WHEN path LIKE '%.py' THEN path ELSE previous_path END AS path, CASE WHEN path LIKE '%.py' THEN previous_path END AS previous_path, false AS is_config
FROM named WHERE path LIKE '%.py' OR kind = 'Renamed'""",
    "change_exclusion": f"""WITH {CHANGES} SELECT DISTINCT CASE WHEN kind <> 'Renamed' OR NOT {_IN} AND NOT {_PIN} THEN kind WHEN {_IN} THEN 'Deleted' ELSE 'Added' END AS kind,
  CASE WHEN kind = 'Renamed' AND {_IN} THEN previous_path ELSE path END AS path, CASE WHEN kind = 'Renamed' AND NOT {_IN} AND NOT {_PIN} THEN previous_path END AS previous_path
FROM changes WHERE NOT {_IN} OR kind = 'Renamed' AND NOT {_PIN}""",
    "overlay_impact": f"""WITH RECURSIVE {IMPORTS}, {CHANGES.removeprefix(FILES + ', ')}, {GONE}, seeds AS (SELECT path AS node FROM gone),
  edges AS (SELECT DISTINCT dependent, dependency FROM import_rows WHERE dependent NOT IN (SELECT path FROM gone)),
  tests AS (SELECT path FROM files WHERE is_test AND path NOT IN (SELECT path FROM gone)), {REACH}, {IMPACT} SELECT path, cls, is_test, n_causes FROM impact""",
    "summary_delta": f"""WITH {IMPORTS}, kept AS (SELECT * FROM files WHERE coalesce(k % 10, 0) <> 2) SELECT (SELECT count(*) FROM kept) AS files, (SELECT count(DISTINCT module) FROM kept) AS modules,
  (SELECT count(*) FROM (SELECT DISTINCT dependent, dependency FROM import_rows WHERE k % 10 <> 2)) AS import_edges, (SELECT count(*) FROM kept WHERE is_test) AS tests,
  (SELECT count(*) FROM imports i WHERE k % 10 <> 2 AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.path = i.path AND h.ordinal = i.ordinal)) AS unresolved_imports""",
    "incremental_equals_full": f"""WITH {IMPORTS}, {CHANGES.removeprefix(FILES + ', ')}, {GONE} SELECT DISTINCT dependent, dependency FROM import_rows JOIN part ON p_partkey = k
WHERE (p_brand <> 'Brand#13' OR ordinal % 2 = 1) AND dependent NOT IN (SELECT path FROM gone) AND dependency NOT IN (SELECT path FROM gone)""",
    "chain_impact": f"WITH {SEEDS} SELECT p_partkey AS node, count(*) AS n_causes, min(seeds.node) AS first_cause, max(seeds.node) AS last_cause FROM part JOIN seeds ON seeds.node < p_partkey GROUP BY p_partkey",
    "scan_inventory": f"""WITH {IMPORTS}, lines AS (SELECT path, ordinal, CASE WHEN kind = 'import' THEN 'import ' || module ELSE 'from ' || repeat('.', level) || coalesce(module, '') || ' import ' || name END AS line FROM imports),
  sources AS (SELECT path, string_agg(line, chr(10) ORDER BY ordinal) || chr(10) AS source FROM lines GROUP BY path),
  tree AS (SELECT path, coalesce(source, '') AS source FROM files LEFT JOIN sources USING (path)) SELECT path, strlen(source) AS size, sha256(source) AS content_hash FROM tree""",
    "bench_statistics": "SELECT event_type, count(value) AS n, min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type",
    "truncated_listing": f"WITH {FILES} SELECT path, (SELECT count(*) FROM files) AS total, greatest((SELECT count(*) FROM files) - 25, 0) AS more FROM files ORDER BY path LIMIT 25",
}
