"""The application: build a view of a repository, then ask it.

    engine = Engine.build(spark, root, index_dir=None)
    engine.graph(); engine.impact(["src/a.py"]); engine.plan(paths=[...]); engine.why("src/a.py", "tests/test_a.py")

Results equal those of a fresh full build whatever the index held. Only files whose content hash is
new are parsed, only importers that may mean something else are resolved again (plans.build.refresh),
and only the rows of their owners are written."""

from __future__ import annotations

import functools
import hashlib
import os
import time
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe import schemas
from rippleframe.errors import AnalysisError, ImportParseError, ModuleResolutionError, UsageError
from rippleframe.functions.paths import display_import
from rippleframe.operators import changes as C
from rippleframe.operators import graph as G
from rippleframe.operators import index as I
from rippleframe.operators.loops import cut
from rippleframe.operators.resolve import duplicate_modules, unresolved
from rippleframe.plans import build as B
from rippleframe.plans import impact as M
from rippleframe.plans import report
from rippleframe.sources import git, inventory
from rippleframe.sources.facts import fact_rows, parse_files


# How Spark names files that are gone or cannot be read.
_UNREADABLE = ("PATH_NOT_FOUND", "FAILED_READ_FILE", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "FileNotFoundException", "is not a Parquet file")


def _unreadable(e: Exception) -> bool:
    """Whether an error says that a stored table cannot be read; any other is a defect."""
    return isinstance(e, OSError) or isinstance(e, (PySparkException, Py4JJavaError)) and any(x in str(e) for x in _UNREADABLE)


def _recovering(question):
    """A question whose stored tables can't be read any more is asked again of a full build. Its seconds are kept."""

    @functools.wraps(question)
    def ask(self, *args, **options):
        began = time.time()
        try:
            return question(self, *args, **options)
        except (OSError, PySparkException, Py4JJavaError) as e:
            if self.work.kind == "full" or not _unreadable(e):
                raise
            names = inventory.list_python_files(self.root, list(self.config.exclude))
            self.tables = self._whole(self.spark, self.root, self.config, names, self.config.roots(names))
            self.work = Work(reason="storage_failure", cause=str(e).split("\n")[0], parsed=len(names))
            return question(self, *args, **options)
        finally:
            self.work.seconds[question.__name__] = time.time() - began

    return ask


@dataclass
class Work:
    """What a build did."""

    kind: str = "full"
    reason: str | None = None
    cause: str | None = None
    hashed: int = 0
    parsed: int = 0
    reused: int = 0
    resolved: int = 0
    records: int = 0
    edges_added: int = 0
    edges_removed: int = 0
    generation: int = 0
    written: bool = False
    seconds: dict = field(default_factory=dict)


def _check(files: DataFrame, facts: DataFrame, undecoded: DataFrame) -> None:
    """Data-dependent failures, from small aggregates, before any result is given."""
    if bad := undecoded.select("path").limit(1).collect():
        raise AnalysisError(f"cannot read {bad[0][0]} as UTF-8")
    if bad := facts.filter("error is not null").orderBy("path").select("path", "error").limit(1).collect():
        raise ImportParseError(f"{bad[0][0]}: {bad[0][1]}")
    if bad := files.filter("module = ''").select("path").limit(1).collect():
        raise ModuleResolutionError(f"no module name: {bad[0][0]}")
    if bad := duplicate_modules(files).orderBy("module").limit(1).collect():
        raise AnalysisError(f"module {bad[0]['module']} is defined by {' and '.join(bad[0]['paths'][:2])}")


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: inventory.Config, tables: B.Tables, work: Work):
        self.spark, self.root, self.config, self.tables, self.work = spark, root, config, tables, work

    # -- building ---------------------------------------------------------------------------

    @classmethod
    def build(cls, spark: SparkSession, root: str, index_dir: str | None = None) -> "Engine":
        root, began = os.path.realpath(root), time.time()
        config = inventory.load_config(root)
        names = inventory.list_python_files(root, list(config.exclude))
        if not names:
            raise AnalysisError("no Python files")
        inventory.check_roots(config, root, names)
        roots = config.roots(names)
        store = I.IndexStore(index_dir) if index_dir else None
        facts_of = {"config": config.fingerprint(), "roots": roots, "repository": hashlib.sha256(root.encode()).hexdigest()}
        work = Work(reason=store.why_not(**facts_of) if store else "disabled")
        now = git.baseline(root) if store else None
        if store and work.reason is None and now is None:
            work.reason = "no_baseline"
        if work.reason is None:
            try:
                return cls._refresh(spark, root, config, store, names, roots, now, work, began)
            except (OSError, PySparkException, Py4JJavaError) as e:  # stored tables that can't be read: the answer comes from a full build
                if not _unreadable(e):
                    raise
                work = Work(reason="read_failure", cause=str(e).split("\n")[0])
        tables = cls._whole(spark, root, config, names, roots)
        work.parsed = work.hashed = work.resolved = len(names)
        if store and work.reason != "locked":
            work.generation, _ = store.commit({n: getattr(tables, n) for n in B.Tables.NAMES}, baseline=now, **facts_of)
            work.written = True
        work.seconds["build"] = time.time() - began
        return cls(spark, root, config, tables, work)

    @classmethod
    def _whole(cls, spark, root, config, names, roots) -> B.Tables:
        found = cut(inventory.scan(spark, root, paths=names))
        facts = cut(parse_files(found.filter("source is not null")))
        files = B.file_table(found, roots, list(config.test_roots))
        _check(files, facts, found.filter("source is null"))
        return B.written(B.relate(cut(files), facts))

    @classmethod
    def _refresh(cls, spark, root, config, store, names, roots, now, work, began) -> "Engine":
        old = B.Tables(*(store.read(spark, n) for n in B.Tables.NAMES))
        manifest = store.manifest()
        before = manifest["baseline"]
        known = set(r[0] for r in old.files.select("path").toLocalIterator())
        present = set(names)
        gone, fresh = sorted(known - present), present - known
        look = sorted((set(git.delta_paths(root, before, now)) & present) | fresh)
        read = cut(inventory.scan(spark, root, paths=look)) if look else spark.createDataFrame([], schemas.INVENTORY)
        changed = cut(read.join(old.files.select("path", "content_hash"), ["path", "content_hash"], "left_anti"))
        touched = [r[0] for r in changed.select("path").collect()]
        work.hashed, work.parsed, work.reused = len(look), len(touched), len(present) - len(touched)
        if not touched and not gone:
            work.kind, work.generation = "unchanged", manifest["generation"]
            if before != now:
                store.note(baseline=now)
            work.seconds["build"] = time.time() - began
            return cls(spark, root, config, old, work)
        work.kind = "incremental"
        keys = spark.createDataFrame([(p,) for p in [*touched, *gone]], "path string")
        new_facts = cut(parse_files(changed.filter("source is not null")))
        new_files = cut(B.file_table(changed, roots, list(config.test_roots)))
        _check(I.replace_rows(old.files, keys, new_files), new_facts, changed.filter("source is null"))
        done = B.refresh(old, keys, new_files, new_facts)
        work.resolved, work.edges_added, work.edges_removed = done.resolved, done.edges_added, done.edges_removed
        kept = {k: manifest[k] for k in ("config", "roots", "repository")}
        full = {n: getattr(done.tables, n) for n in B.Tables.NAMES}
        work.generation, work.records = store.commit(done.whole, done.parts, full, baseline=now, **kept)
        work.written = True
        work.seconds["build"] = time.time() - began
        return cls(spark, root, config, done.tables, work)

    # -- questions --------------------------------------------------------------------------

    @_recovering
    def graph(self) -> dict:
        return M.graph_summary(self.tables.files, self.tables.resolutions, self.tables.evidence).first().asDict()

    def unresolved(self) -> DataFrame:
        """importer, line, col, import in that order."""
        shown = display_import(*(F.col(c) for c in ("kind", "module", "name", "level", "api", "package")))
        return unresolved(self.tables.resolutions).select(F.col("path").alias("importer"), "line", "col", shown.alias("import"), "status").orderBy("importer", "line", "col")

    def inspect(self, focus: str | None = None) -> dict[str, DataFrame]:
        """Modules with their neighbours, edges with evidence, and resolution traces; of one file only with `focus`."""
        t = self.tables
        near = G.neighbours(t.edges).withColumnRenamed("node", "path")
        modules = t.files.join(near, "path", "left").select("path", "module", "is_package", "is_test", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("dependencies", "dependents")])
        edges, traces = G.grouped_evidence(t.evidence), t.resolutions.select("path", "ordinal", "line", "col", "candidates", "resolved", "status")
        if focus is not None:
            focus = self._known([focus])[0]
            modules, traces = modules.filter(F.col("path") == focus), traces.filter(F.col("path") == focus)
            edges = edges.filter((F.col("dependent") == focus) | (F.col("dependency") == focus))
        return {"modules": modules.orderBy("path"), "edges": edges.orderBy("dependent", "dependency"), "traces": traces.orderBy("path", "ordinal")}

    def _known(self, paths: list[str], tables: B.Tables | None = None) -> list[str]:
        if not paths:
            raise UsageError("no path is given")
        wanted = sorted({inventory.input_path(self.root, p) for p in paths})
        asked = self.spark.createDataFrame([(p,) for p in wanted], "path string")
        lost = [r[0] for r in asked.join((tables or self.tables).files, "path", "left_anti").orderBy("path").collect()]
        if lost:
            raise AnalysisError(f"not indexed: {', '.join(lost)}")
        return wanted

    def impact_frames(self, paths: list[str], tables: B.Tables | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(impact rows, closure pairs, 0 or 1 row of full validation) as DataFrames."""
        t = tables or self.tables
        seeds = self.spark.createDataFrame([(p,) for p in paths], "node string")
        pairs = cut(G.reverse_closure(t.edges, seeds))
        reasons = M.file_reasons(fact_rows(t.facts, "uncertainty"), fact_rows(t.facts, "imports"))
        changed = seeds.join(t.files, F.col("node") == F.col("path"), "left_semi")
        return M.impact(t.edges, self.tables.files, seeds, pairs), pairs, M.full_validation(changed, pairs, reasons)

    @_recovering
    def impact(self, paths: list[str], tables: B.Tables | None = None, known: bool = False) -> dict:
        paths = sorted(set(paths)) if known else self._known(paths)
        rows, _, full = self.impact_frames(paths, tables)
        got, why = rows.orderBy("path").collect(), full.collect()
        return {
            "changed": paths, "direct": [r["path"] for r in got if r["class"] == "direct"], "transitive": [r["path"] for r in got if r["class"] == "transitive"],
            "tests": [r["path"] for r in got if r["is_test"]], "causes": [(r["path"], list(r["caused_by"])) for r in got], "full": (why[0]["reason"], [why[0]["path"]]) if why else None,
        }

    def affected_tests(self, paths: list[str]) -> list[str]:
        return self.impact(paths)["tests"]

    def causes_for(self, paths: list[str], affected: str) -> list[str]:
        return dict(self.impact(paths)["causes"]).get(affected, [])

    def plan(self, paths: list[str]) -> dict:
        return report.plan_dict(self.impact(paths))

    @_recovering
    def why(self, changed: str, affected: str, tables: B.Tables | None = None, known: bool = False) -> dict:
        t = tables or self.tables
        if not known:
            (changed,), (affected,) = self._known([changed], t), self._known([affected], t)
        pair = self.spark.createDataFrame([(changed, affected)], "changed string, affected string")
        found = cut(G.shortest_paths(t.edges, pair))
        path = found.collect()
        if not path:
            raise AnalysisError(f"no dependency path from {affected} to {changed}")
        steps = G.path_steps(found, G.grouped_evidence(t.evidence)).orderBy("ordinal").collect()
        return report.why_dict(changed, affected, list(path[0]["path"]), [s.asDict(True) for s in steps])

    def git(self, base: str = "HEAD") -> "GitAnalysis":
        return GitAnalysis(self, base)


def overlay(engine: Engine, virtual: DataFrame) -> B.Tables:
    """Tables in which paths that are gone still stand as modules: importers resolve to them."""
    t = engine.tables
    gone = virtual.join(t.files, "path", "left_anti").select("path", F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("modified_ns"), F.lit(None).cast("string").alias("content_hash"))
    names = [r[0] for r in t.files.select("path").union(gone.select("path")).filter("path like 'src/%'").limit(1).collect()]
    ghosts = B.file_table(gone, engine.config.roots(names), list(engine.config.test_roots))
    ghosts = ghosts.join(t.files.select("module"), "module", "left_anti").select(*t.files.columns)
    return B.written(B.relate(cut(t.files.unionByName(ghosts)), t.facts))


class GitAnalysis:
    """Questions about what version control says has changed."""

    def __init__(self, engine: Engine, base: str):
        self.engine, spark = engine, engine.spark
        changes = git.git_changes(spark, engine.root, base)
        self.changes = cut(C.ordered(C.exclude_changes(C.relevant_changes(changes), list(engine.config.exclude))))
        self.configuration = sorted(r[0] for r in C.configuration_paths(self.changes).collect())
        self.paths = sorted(r[0] for r in C.analysis_paths(self.changes).collect())
        virtual = C.virtual_paths(self.changes)
        self.tables = overlay(engine, virtual) if virtual.limit(1).count() else engine.tables

    def impact(self) -> dict:
        if self.configuration:
            tests = sorted(r[0] for r in self.engine.tables.files.filter("is_test").select("path").collect())
            return {"changed": self.paths, "direct": [], "transitive": [], "tests": tests, "causes": [], "full": ("configuration_changed", self.configuration)}
        if not self.paths:
            return {"changed": [], "direct": [], "transitive": [], "tests": [], "causes": [], "full": None}
        return self.engine.impact(self.paths, self.tables, known=True)

    def affected_tests(self) -> list[str]:
        return self.impact()["tests"]

    def plan(self) -> dict:
        return report.plan_dict(self.impact())

    def why(self, changed: str, affected: str) -> dict:
        if self.configuration:
            raise AnalysisError("the configuration changed: no single path explains it")
        if changed not in self.paths:
            raise AnalysisError(f"not among the changes: {changed}")
        return self.engine.why(changed, affected, self.tables, known=True)
