"""The batch plan: facts of all files to files, resolutions, exports, evidence and edges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.functions import paths as P
from rippleframe.operators import exports as X
from rippleframe.operators import graph, pytest_relations, resolve
from rippleframe.operators.index import needs_relations, replace_rows
from rippleframe.operators.loops import cut, cut_counted
from rippleframe.sources.facts import fact_rows


@dataclass
class Tables:
    """The engine's tables; all are plain DataFrames."""

    files: DataFrame
    facts: DataFrame
    resolutions: DataFrame
    exports: DataFrame
    evidence: DataFrame
    edges: DataFrame
    candidates: DataFrame

    NAMES = ("files", "facts", "resolutions", "exports", "evidence", "edges", "candidates")


def file_table(inventory: DataFrame, source_roots: list[str], test_roots: list[str]) -> DataFrame:
    path = F.col("path")
    return inventory.select("path", P.path_to_module(path, source_roots).alias("module"), P.is_package(path).alias("is_package"), P.is_test(path, test_roots).alias("is_test"), "size", "modified_ns", "content_hash")


def relate(files: DataFrame, facts: DataFrame) -> Tables:
    """All relations of these files; `facts` may hold rows of other paths. What several relations read
    (facts, resolutions, exports) is cut, so that each is evaluated once."""
    facts = cut(facts.join(files.select("path"), "path", "left_semi"))
    resolutions = cut(resolve.resolve(fact_rows(facts, "imports"), files))
    exports = cut(X.export_index(fact_rows(facts, "exports"), files))
    evidence = (
        resolve.import_evidence(resolutions, files)
        .unionByName(X.reexport_evidence(resolutions, exports, files))
        .unionByName(pytest_relations.pytest_evidence(files, fact_rows(facts, "requests"), fact_rows(facts, "fixtures"), fact_rows(facts, "plugins")))
    )
    return Tables(files, facts, resolutions, exports, evidence, graph.edges_of(evidence), resolve.candidate_index(resolutions))


def written(t: Tables) -> Tables:
    """The same tables, the computed ones cut."""
    evidence = cut(t.evidence)
    return Tables(t.files, t.facts, t.resolutions, t.exports, evidence, cut(graph.edges_of(evidence)), cut(t.candidates))


@dataclass
class Refresh:
    """Tables after a change, and what of them is new: whole tables, or (rows, their owners' paths)."""

    tables: Tables
    whole: dict[str, DataFrame] = field(default_factory=dict)
    parts: dict[str, tuple[DataFrame, DataFrame]] = field(default_factory=dict)
    resolved: int = 0
    edges_added: int = 0
    edges_removed: int = 0


_KINDS = {"imports": ("imports",), "exports": ("exports",), "relations": ("fixtures", "requests", "plugins")}


def _moved_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, imports, exports, relations): which facts of a path differ; a missing path has none."""
    side = lambda df, p: df.select("path", *[F.xxhash64(*cols).alias(f"{p}_{k}") for k, cols in _KINDS.items()])
    both = side(old, "old").join(side(new, "new"), "path", "full")
    return both.select("path", *[(~F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}"))).alias(k) for k in _KINDS])


def refresh(old: Tables, keys: DataFrame, new_files: DataFrame, new_facts: DataFrame) -> Refresh:
    """The tables after the files of `keys` (path) were changed, added or removed: `new_files` and
    `new_facts` are the rows of those that are there now.

    Only importers with other imports are resolved again, and those that may mean a module that came,
    went, or passes on other names. Test relations are computed again, for all files, only where a
    changed file takes part in them. What is not named in the result is as before."""
    keys, new_files, new_facts = cut(keys.select("path").distinct()), cut(new_files), cut(new_facts)
    mine = lambda df, col="path": df.join(keys.withColumnRenamed("path", col), col, "left_semi")
    old_files, old_facts = cut(mine(old.files)), cut(mine(old.facts))
    files, facts = replace_rows(old.files, keys, new_files), replace_rows(old.facts, keys, new_facts)
    gone, fresh = old_files.join(new_files, "path", "left_anti"), new_files.join(old_files, "path", "left_anti")
    modules, n_moved = cut_counted(gone.select("module").union(fresh.select("module")).distinct())
    moved, _ = cut_counted(_moved_facts(old_facts, new_facts))
    told = moved.agg(F.count_if(F.expr("imports or exports or relations")).alias("any"), F.count_if("exports").alias("exports"), F.count_if("relations").alias("relations")).first()
    out = Refresh(Tables(files, facts, old.resolutions, old.exports, old.evidence, old.edges, old.candidates), parts={"files": (new_files, keys)})
    if told["any"]:
        out.parts["facts"] = (new_facts, keys)
    if not told["any"] and not n_moved:
        return out

    exports = old.exports
    if told["exports"] or n_moved:
        exports = cut(X.export_index(fact_rows(facts, "exports"), files))
        differ = exports.exceptAll(old.exports).union(old.exports.exceptAll(exports)).select("module").distinct()
        differ, n_names = cut_counted(differ)
        if n_names:
            modules = modules.union(differ)
            out.whole["exports"] = exports
    again = moved.filter("imports").select("path").join(new_files, "path", "left_semi").union(fresh.select("path"))
    if n_moved or "exports" in out.whole:
        again = again.union(resolve.importers_to_resolve(old.candidates, modules).join(gone.select(F.col("path").alias("importer")), "importer", "left_anti"))
    again, out.resolved = cut_counted(again.distinct())
    owners = cut(again.union(gone.select("path")).distinct())
    resolutions = cut(resolve.resolve(fact_rows(facts.join(again, "path", "left_semi"), "imports"), files))
    evidence = resolve.import_evidence(resolutions, files).unionByName(X.reexport_evidence(resolutions, exports, files))

    relations = told["relations"] > 0
    if not relations and n_moved:
        took_part = needs_relations(gone, old_facts).union(needs_relations(fresh, new_facts))
        named = fact_rows(facts, "plugins").select(F.col("name").alias("module")).join(modules, "module", "left_semi")
        relations = took_part.limit(1).count() > 0 or named.limit(1).count() > 0
    of = lambda df, col: df.join(owners.select(F.col("path").alias(col)), col, "left_semi")
    if relations:
        tests = pytest_relations.pytest_evidence(files, fact_rows(facts, "requests"), fact_rows(facts, "fixtures"), fact_rows(facts, "plugins"))
        kept = old.evidence.filter("stage < 2")
        evidence = cut(replace_rows(kept, owners, evidence, "dependent").unionByName(tests))
        edges = cut(graph.edges_of(evidence))
        out.whole |= {"evidence": evidence, "edges": edges}
        before, after = old.edges, edges
    else:
        evidence = cut(evidence.unionByName(of(old.evidence, "dependent").filter("stage >= 2").join(gone.select(F.col("path").alias("dependent")), "dependent", "left_anti")))
        before, after = cut(of(old.edges, "dependent")), cut(graph.edges_of(evidence))
        out.parts |= {"evidence": (evidence, owners), "edges": (after, owners)}
        edges, evidence = replace_rows(old.edges, owners, after, "dependent"), replace_rows(old.evidence, owners, evidence, "dependent")
    candidates = cut(resolve.candidate_index(resolutions))
    out.parts |= {"resolutions": (resolutions, owners), "candidates": (candidates, owners)}
    count = {r["change"]: r["n"] for r in graph.edge_mutations(before, after).groupBy("change").agg(F.count("*").alias("n")).collect()}
    out.edges_added, out.edges_removed = count.get("added", 0), count.get("removed", 0)
    out.tables = Tables(files, facts, replace_rows(old.resolutions, owners, resolutions), exports, evidence, edges, replace_rows(old.candidates, owners, candidates, "importer"))
    return out
