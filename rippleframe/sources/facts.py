"""The one table-generating Python function: (path, source) to facts, in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from rippleframe import schemas
from rippleframe.sources.parser import parse_source


def parse_files(sources: DataFrame) -> DataFrame:
    """One row a file (schemas.FACTS) from columns path, source."""
    arrow = to_arrow_schema(_parse_datatype_string(schemas.FACTS))

    def run(batches):
        for batch in batches:
            rows = [parse_source(p, s or "") for p, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield from pa.Table.from_pylist(rows, arrow).to_batches()

    return sources.select("path", "source").mapInArrow(run, schemas.FACTS)


def fact_rows(facts: DataFrame, name: str) -> DataFrame:
    """One list of the facts as rows with their path."""
    return facts.select("path", F.explode(name).alias("x")).select("path", "x.*")
