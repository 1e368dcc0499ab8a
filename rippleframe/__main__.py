"""python -m rippleframe {graph,impact,tests,plan,why,serve} [paths] [--root R] [--changed | --git-diff BASE] [--json] [--all]

graph --debug [--focus PATH] adds modules, edges with evidence, and how each import was resolved;
plan --publish FILE writes the checked plan to a new file outside the repository; serve answers
tool calls over stdio."""

from __future__ import annotations

import argparse
import json
import os
import sys

from rippleframe.errors import AnalysisError, UsageError


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rippleframe", description=__doc__)
    parser.add_argument("command", choices=("graph", "impact", "tests", "plan", "why", "serve"))
    parser.add_argument("paths", nargs="*")
    parser.add_argument("--root", default=".")
    parser.add_argument("--index", default=None, help="folder of the persistent index")
    parser.add_argument("--changed", action="store_true")
    parser.add_argument("--git-diff", metavar="BASE")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--all", action="store_true")
    parser.add_argument("--debug", action="store_true")
    parser.add_argument("--focus", metavar="PATH")
    parser.add_argument("--publish", metavar="FILE")
    args = parser.parse_args(argv)
    try:
        from pyspark.sql import SparkSession

        from rippleframe.engine import Engine
        from rippleframe.plans import contract, report

        base = args.git_diff if args.git_diff is not None else "HEAD" if args.changed else None
        if args.changed and args.git_diff is not None:
            raise UsageError("--changed and --git-diff exclude each other")
        if args.command in ("impact", "tests", "plan") and bool(args.paths) == (base is not None):
            raise UsageError("give either paths or a change source")
        if args.command == "why" and len(args.paths) != 2:
            raise UsageError("why takes the changed and the affected path")
        if (args.debug or args.focus) and args.command != "graph" or args.focus and not args.debug:
            raise UsageError("--debug and --focus belong to graph, --focus to --debug")
        if args.publish and args.command != "plan":
            raise UsageError("--publish belongs to plan")
        spark = SparkSession.builder.master(os.environ.get("SPARK_MASTER", "local[*]")).config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
        if args.command == "serve":
            from rippleframe.server import serve

            serve(spark, args.root, args.index)
            return 0
        engine = Engine.build(spark, args.root, args.index)
        if args.command == "graph":
            lost = [r.asDict() for r in engine.unresolved().collect()]
            summary = engine.graph()
            if args.debug:
                parts = {k: [r.asDict(True) for r in df.collect()] for k, df in engine.inspect(args.focus).items()}
                print(report.inspection_json(summary, parts) if args.json else report.inspection_text(summary, parts, args.all), end="")
                return 0
            print(report.graph_json(summary, lost) if args.json else json.dumps(summary) + "\n" + report.listing("Unresolved imports", [f"{r['importer']}:{r['line']}:{r['col']} {r['import']}" for r in lost], args.all), end="" if args.json else "\n")
            return 0
        if args.command == "why":
            found = engine.git(base).why(*args.paths) if base is not None else engine.why(*args.paths)
            print(json.dumps(found, indent=2, ensure_ascii=False) if args.json else report.why_text(found))
            return 0
        impact = engine.git(base).impact() if base is not None else engine.impact(args.paths)
        if args.publish:
            print(contract.publish_plan(report.plan_dict(impact), args.publish, args.root), end="")
            return 0
        if args.json:
            print({"impact": report.impact_json, "tests": report.tests_json, "plan": report.plan_json}[args.command](impact), end="")
        elif args.command == "impact":
            print(report.impact_text(impact, args.all), end="")
        elif args.command == "tests":
            print(report.listing("Affected tests", impact["tests"], args.all))
        else:
            plan = report.plan_dict(impact)
            print(f"Mode: {plan['validation']['mode']}")
            print("\n".join(" ".join(["pytest", *s["args"]]) for s in plan["validation"]["steps"]))
        return 0
    except AnalysisError as e:
        print(f"error: {e}", file=sys.stderr)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
