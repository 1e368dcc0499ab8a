"""A synthetic repository of any size: one package whose modules import each the one before, and a
tenth of tests spread over them. The first module's change reaches all others."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = "src/generated/module_00000.py"


def chain_sources(spark: SparkSession, n: int) -> DataFrame:
    """(path, source) of `n` files, from 3 on."""
    if n < 3:
        raise ValueError("a synthetic repository has 3 files at least")
    tests = max(1, n // 10)
    modules = n - tests - 1
    name = lambda k: F.format_string("module_%05d", k)
    rows = spark.range(modules).withColumnRenamed("id", "k")
    before = name(F.col("k") - 1)
    body = F.when(F.col("k") == 0, "def value():\n    return 0\n").otherwise(F.concat(F.lit("from generated import "), before, F.lit("\n\n\ndef value():\n    return "), before, F.lit(".value() + 1\n")))
    code = rows.select(F.concat(F.lit("src/generated/"), name(F.col("k")), F.lit(".py")).alias("path"), body.alias("source"))
    used = name(F.floor(F.col("id") * modules / tests))
    checks = spark.range(tests).select(F.concat(F.lit("tests/generated/test_"), used, F.lit(".py")).alias("path"), F.concat(F.lit("from generated import "), used, F.lit("\n\n\ndef test_value():\n    assert "), used, F.lit(".value() >= 0\n")).alias("source"))
    head = spark.range(1).select(F.lit("src/generated/__init__.py").alias("path"), F.lit('"""A chain of modules."""\n').alias("source"))
    return code.unionByName(checks).unionByName(head)


def write_tree(sources: DataFrame, root: str) -> None:
    """Write files (path, source) below `root`, a folder that all executors share."""

    def run(batches):
        for batch in batches:
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = os.path.join(root, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "w", encoding="utf-8", newline="") as f:
                    f.write(source)
            yield batch.slice(0, 0)

    sources.select("path", "source").mapInArrow(run, "path string, source string").write.format("noop").mode("overwrite").save()
