"""A training corpus from raw documents: five stages, each a DataFrame in and out.

Toxic documents go, one document of each near-duplicate class stays, documents that hold
benchmark passages go, sources are mixed to target weights (documents repeated or left out),
and the rows are placed in shards of near equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.llm import decontamination, mixing, near_dedup, queries, resharding, toxicity
from rippleframe.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by the classifier of the labelled rows.

    Null and empty texts get the score of a text without n-grams; repeated rows are scored each;
    texts of any length are read whole; an empty table gives no rows; other columns pass unread."""
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the smallest id, nulls last; of repeated rows one.

    Null texts are empty, and all empty ones are one class; texts of any length are compared whole;
    an empty table gives no rows; other columns, whatever their names, pass unread."""
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item (nor a whole shorter item).

    Null and empty texts have no words and stay; items without words match nothing; repeated rows
    are scanned each, texts of any length whole; empty tables give no rows or no hits."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: 0, 1 or 2 times.

    Null and empty texts have no words and are taken by chance like the others of their source; a
    null source is one of its own; rows equal in every column share what they take together; ties
    are settled by hashes; an empty table gives no rows; other columns pass unread."""
    return mixing.apply_mix(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with all their columns, and size, text_crc32, law, shard and slot of their place.

    Null texts have no bytes; repeated rows each get a slot; ties are settled by id, checksum and
    size; an empty table gives no rows. Columns of the documents that are named like those of the
    place give way to them."""
    out = resharding.reshard(docs, queries.old_shard(), queries.SHARDS, carry=True)
    place = {"size": F.col("size"), "text_crc32": F.col("text_crc32"), "law": F.lit("bytes"), "shard": F.col("shard"), "slot": F.col("slot")}
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in place], *[v.alias(c) for c, v in place.items()])


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

ORACLE_SQL = None  # the stages are not expressible in SQL; tests/llm compares them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
