"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.operators.loops import cut as materialize  # noqa: F401  a written table in the shared folder ends the lineage

# Fixed values of the contracts: ASCII letters are lower-cased, and a word is a run of
# ASCII letters, digits and non-ASCII bytes. Every other byte separates.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
LOWER_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fold_words(raw: bytes) -> list[bytes]:
    """Lower-cased words of UTF-8 bytes."""
    return raw.translate(WORD_TABLE).split()


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(sizes: list[int], most: int):
    """Index ranges of consecutive items of at most `most` bytes together (one item at least)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
