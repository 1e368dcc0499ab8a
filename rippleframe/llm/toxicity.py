"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Features are the presence of hashed character n-grams (4 to 6 code points of
the lower-cased words, each with a space before and after). A
bounded sample of labelled rows gives document counts of every feature by class, from them
the log-count ratios, and the FEATURES n-grams that separate the classes most; the linear
weights over the ratio-scaled features are fitted by logistic regression, whose penalty acts
on the weights before scaling, so that the ratios decide how cheaply a feature takes effect. Scoring reads every row
once, without a shuffle, against one table of weights whose size is fixed.

Defined results: null texts are empty, and empty texts get the score of the intercept;
null labels are not learned from; several labels of an id count as toxic if one is, and its
smallest text stands for it in the sample; without labels of both classes all rows get the
share of toxic labels (0.5 without any); repeated rows are scored each; texts of
any length are read whole, in pieces of at most CHUNK characters of whole texts (one text at
least); ties between features go to the smaller bucket; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.common import materialize, slices

SIZES = (4, 5, 6)
BITS = 20
SAMPLE_ROWS = 20_000  # labelled rows fitted on, the first by a hash of their id
FEATURES = 1024
SMOOTH, PENALTY, NEWTON = 1.0, 1e-4, 30
CHUNK = 400_000  # characters at a time
_MIX = np.uint64(0x9E3779B97F4A7C15)
_GAP = re.compile(r"[\W_]+")


def _grams(texts: list[str]):
    """For each n: (text number, bucket) of every n-gram."""
    code = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    run = code.copy()
    whole = code != 0
    for n in range(2, max(SIZES) + 1):
        if len(run) < 2:
            return
        run = run[:-1] * _MIX + code[n - 1 :]
        whole = whole[:-1] & (code[n - 1 :] != 0)
        if n in SIZES:
            yield owner[: len(run)], ((run ^ (run >> np.uint64(29))) * _MIX + np.uint64(n)) >> np.uint64(64 - BITS), whole


def present(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, bucket) pairs, of the wanted buckets only if they are given."""
    keys = []
    for owner, bucket, whole in _grams(texts):
        take = whole if wanted is None else whole & wanted[bucket]
        keys.append(owner[take].astype(np.int64) << BITS | bucket[take].astype(np.int64))
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


def _fold(column: pa.Array) -> list[str]:
    """Lower-cased words with one space around each, so that word starts and ends are in the n-grams."""
    return [f" {_GAP.sub(' ', (t or '').lower())} " for t in column.to_pylist()]


def _count(batches):
    count, rows = np.zeros((2, 1 << BITS), np.int64), [0, 0]
    for batch in batches:
        texts, toxic = _fold(batch.column(0)), np.array(batch.column(1).to_pylist())
        for y in (0, 1):
            rows[y] += int((toxic == y).sum())
        for a, b in slices([len(t) for t in texts], CHUNK):
            doc, bucket = present(texts[a:b])
            for y in (0, 1):
                count[y] += np.bincount(bucket[toxic[a:b][doc] == y], minlength=1 << BITS)
    seen = np.flatnonzero(count.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1), pa.int32())] + [pa.array(np.append(count[y][seen], rows[y]), pa.int64()) for y in (1, 0)], ["bucket", "toxic", "clean"])


def fit_weights(doc: np.ndarray, feature: np.ndarray, label: np.ndarray, ratio: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled presence (doc, feature): what each feature adds to the logit, and the intercept.

    All ratios are divided by one common scale, their root mean square, and the squared penalty
    is on the weights of the scaled features: a feature of a small ratio has to pay more for the
    same effect. Newton steps with conjugate gradients and halving, to the minimum."""
    n, k = len(label), len(ratio)
    ratio = ratio / max(float(np.sqrt((ratio**2).mean())), 1e-12)
    w, b = np.zeros(k), float(np.log(label.mean() / (1 - label.mean())))

    def logits(w, b):
        return np.bincount(doc, (ratio * w)[feature], n) + b

    def loss(w, b):
        z = logits(w, b)
        return np.logaddexp(0, np.where(label > 0, -z, z)).mean() + penalty / 2 * (w @ w)

    for _ in range(NEWTON):
        p = 1 / (1 + np.exp(-np.clip(logits(w, b), -40, 40)))
        bend = p * (1 - p) / n + 1e-12

        def curved(x, bend=bend):
            q = bend * logits(x[:-1], x[-1])
            return np.append(ratio * np.bincount(feature, q[doc], k) + penalty * x[:-1], q.sum())

        left = -np.append(ratio * np.bincount(feature, (p - label)[doc], k) / n + penalty * w, (p - label).mean())
        step, go, size = np.zeros(k + 1), left, left @ left
        for _ in range(k + 1):
            if size < 1e-24:
                break
            bent = curved(go)
            far = size / (go @ bent)
            step, left = step + far * go, left - far * bent
            size, before = left @ left, size
            go = left + size / before * go
        now, far = loss(w, b), 1.0
        while far > 1e-6 and loss(w + far * step[:-1], b + far * step[-1]) > now:
            far /= 2
        w, b = w + far * step[:-1], b + far * step[-1]
        if far * np.abs(step).max() < 1e-8:
            break
    return ratio * w, float(b)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    """(weights by bucket, intercept) learned from the labelled rows."""
    picked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(sample_rows)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialize(rows.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("text", "y"))
    counts = rows.mapInArrow(_count, "bucket int, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = materialize(counts)
    n1, n0 = counts.filter("bucket = -1").agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("clean"), F.lit(0))).first()
    weights = np.zeros(1 << BITS, np.float32)
    if not n1 or not n0:
        share = 0.5 if not n1 + n0 else min(max(n1 / (n1 + n0), 1e-6), 1 - 1e-6)
        return weights, float(np.log(share / (1 - share)))
    counts = counts.filter("bucket >= 0")
    s1, s0 = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    pool = (F.col("toxic") + F.col("clean")) / (n1 + n0)
    gap = F.abs(F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(pool * (1 - pool) + 1e-9)
    best = counts.orderBy(gap.desc(), "bucket").limit(FEATURES).collect()
    bucket = np.array([r["bucket"] for r in best], np.int64)
    mass = SMOOTH * (1 << BITS)
    ratio = np.log((np.array([r["toxic"] for r in best]) + SMOOTH) / (s1 + mass)) - np.log((np.array([r["clean"] for r in best]) + SMOOTH) / (s0 + mass))
    place = np.full(1 << BITS, -1, np.int16)
    place[bucket] = np.arange(len(bucket))

    def design(batches):
        for batch in batches:
            texts, out = _fold(batch.column(0)), []
            for a, b in slices([len(t) for t in texts], CHUNK):
                doc, at = present(texts[a:b], place >= 0)
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                out += [place[at[i:j]].tobytes() for i, j in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], ["y", "features"])

    got = rows.mapInArrow(design, "y int, features binary").toArrow()  # at most sample_rows rows of FEATURES numbers
    features = [np.frombuffer(x, np.int16) for x in got["features"].to_pylist()]
    doc = np.repeat(np.arange(len(features)), [len(x) for x in features])
    w, b = fit_weights(doc, np.concatenate(features).astype(np.int64), got["y"].to_numpy().astype(float), ratio)
    weights[bucket] = w
    return weights, b


def scores(texts: list[str], weights: np.ndarray, bias: float) -> np.ndarray:
    out = []
    wanted = weights != 0
    for a, b in slices([len(t) for t in texts], CHUNK):
        doc, bucket = present(texts[a:b], wanted)
        out.append(np.bincount(doc, weights[bucket], b - a))
    z = np.concatenate(out) + bias if out else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(df: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, score (0 to 1) and predicted (score >= 0.5) for each row."""
    packed, bias = df.sparkSession.sparkContext.broadcast(model[0]), model[1]  # 2 ** BITS numbers

    def run(batches):
        for batch in batches:
            p = scores(_fold(batch.column(1)), packed.value, bias)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_clean(df: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """Rows of `df` scored below 0.5, all columns kept."""
    packed, bias = df.sparkSession.sparkContext.broadcast(model[0]), model[1]

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(_fold(batch.column(text_col)), packed.value, bias) < 0.5))

    return df.mapInArrow(run, df.schema)
