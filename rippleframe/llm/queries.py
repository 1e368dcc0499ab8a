"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.llm import decontamination, license_scan, lm_scoring, mixing, near_dedup, nearest, resharding, suffix_dedup, toxicity
from rippleframe.llm.common import table
from rippleframe.llm.token_counts import count_tokens


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


SHARDS = 40


def old_shard() -> Column:
    """The layout that the documents come from: 40 shards, all in use, of sizes from two thirds of the
    mean to over three times it (the table names no layout, so a row's hash does)."""
    share = F.pmod(F.xxhash64("doc_id", "source", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))), F.lit(1_000_003)) / 1_000_003
    return F.floor(F.pow(share, F.lit(1.5)) * SHARDS).cast("int")


def shard(docs: DataFrame) -> DataFrame:
    out = resharding.reshard(docs, old_shard(), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.find_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "kept")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    out = suffix_dedup.find_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def remainder(mod: int, col: str = "doc_id") -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(col).cast("string"), F.lit("")), "UTF-8")) % mod


def toxicity_model(spark: SparkSession, sf_dir: str):
    labels = table(spark, sf_dir, "labels").filter(remainder(5) != 0)
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    base, more = F.transform("phrase_hits", lambda x: x["label"]), F.transform("notice_hits", lambda x: x["label"])
    start = F.transform("phrase_hits", lambda x: x["start"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.greatest(F.coalesce(F.array_max(F.transform("notice_hits", lambda x: x["share"])), F.lit(0.0)), F.when(F.size("phrase_hits") > 0, 0.5).otherwise(0.0))
    return out.select("doc_id", "n_words", F.size("phrase_hits").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), joined(base).alias("base_labels"), joined(F.concat(base, more)).alias("labels"), score.alias("score"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"), remainder(7) == 2)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest.search(rows, rows.filter(F.col("vec_id") % 100 == 0))


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_sharding": op2_sharding,
        "op3_near_dedup": op3_near_dedup,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_license_scan": op6_license_scan,
        "op7_decontamination": op7_decontamination,
        "op8_mixing": op8_mixing,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_nearest": op10_nearest,
    }


_WORDS = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _license_sql() -> str:
    shapes = [(label, p.split(" "), p.split(" "), True) for p, label in license_scan.PHRASES.items()] + [(label, n.split(" "), k.split(" "), False) for label, n, k in license_scan.NOTICES]
    words = []
    for t, (label, notice, key, base) in enumerate(shapes):
        at = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
        words += [f"({t}, '{label}', {base}, {len(notice)}, {len(key)}, '{w}', {i}, {int(at <= i < at + len(key))})" for i, w in enumerate(notice)]
    return f"""WITH shape(t, label, base, n, n_key, w, j, in_key) AS (VALUES {", ".join(words)}),
  docs AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
  words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
  hits AS (SELECT doc_id, t, label, base, i - j AS start, count(*) / n AS share FROM words JOIN shape USING (w) GROUP BY doc_id, t, label, base, i - j, n, n_key
    HAVING sum(in_key) = n_key AND count(*) >= {license_scan.MIN_MATCH} * n)
SELECT d.doc_id, len(any_value(ws)) AS n_words, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  CAST(greatest(coalesce(max(share) FILTER (NOT base), 0), CASE WHEN count(*) FILTER (base) > 0 THEN 0.5 ELSE 0 END) AS DOUBLE) AS score
FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id GROUP BY d.doc_id"""


_CONTAMINATION_SQL = f"""WITH docs AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
  items AS (SELECT item_id, ws, least({decontamination.WINDOW}, len(ws)) AS n FROM (SELECT item_id, {_WORDS.format("text")} AS ws FROM benchmark) WHERE len(ws) > 0),
  wanted AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM items)),
  spots AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT n FROM items) WHERE len(ws) >= n),
  hits AS (SELECT doc_id, s.i, s.n, item_id FROM (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win FROM spots) s JOIN wanted w ON w.win = s.win AND w.n = s.n),
  covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
  found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": _license_sql(), "op7_decontamination": _CONTAMINATION_SQL}
