"""Approximate nearest neighbours by multi-index hashing.

A PCA projection with an iteratively learned rotation turns vectors into binary codes; it is
fitted on a bounded sample, which also sets the Hamming radius that holds the wanted share of
true neighbours, and into how many substrings the codes are split (the split with the least
expected work at that radius). `build_index` writes every valid row once, in segments: ids,
vectors, codes, and one bucket directory for each substring. A search sends the queries in
blocks of bounded bytes over the segments. By the pigeonhole principle a code within the
radius is near in one substring at least: a directory's buckets are probed by listing the
values near the query's substring, or, where there are fewer buckets than such values, by
comparing the bucket values. That retrieves every code within the radius; their originals
are reranked in double precision. The radius is the same everywhere, so the answers do not
depend on how rows are dealt into batches, segments or partitions. Queries with fewer than
`k` codes within the radius are searched again over the whole index without a radius.

Defined results: vectors that are null, zero, of another length than the sample's most
common one, or that hold null or non-finite components take no part, as candidates or as
queries, nor do rows with a null id; rows of the query's own id are not its candidates;
repeated query ids count once (the smallest valid vector), repeated candidate rows each; no
result is short unless there are fewer candidates; ties go to the smaller id; empty tables
give no rows; other columns, whatever their names, are not read; vectors of any length are
read whole, and segments are bounded by bytes.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.llm.common import materialize

SAMPLE_ROWS = 20_000  # vectors fitted on, the first by a hash of their id
QUERY_BYTES = 16_000_000  # of query vectors in a block
SEGMENT_BYTES = 16_000_000  # of vectors in a segment
BITS, ROUNDS = 64, 30
SPLITS = (2, 3, 4, 6, 8, 12)
KEPT_SHARE = 0.95  # share of the sample's true neighbours within the radius
_INDEX = "ids binary, vectors binary, code binary, parts array<struct<rows:binary,value:binary,start:binary>>"
_PARTS = pa.list_(pa.struct([("rows", pa.binary()), ("value", pa.binary()), ("start", pa.binary())]))


def _matrix(column, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, vectors) of the valid rows of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.array(column.value_lengths().fill_null(0))
    if dim is None:
        dim = max(Counter(size[size > 0].tolist()).items(), key=lambda x: (x[1], -x[0]), default=(0,))[0]
    rows = np.flatnonzero(size == dim) if dim else np.zeros(0, int)
    if not len(rows):
        return rows, np.zeros((0, dim))
    v = np.asarray(column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, dim)
    good = np.isfinite(v).all(1) & (v != 0).any(1)
    return rows[good], v[good]


class Codes:
    """Learned rotation: vectors to packed binary codes; their radius and split."""

    def __init__(self, sample: np.ndarray, k: int, split: int | None = None):
        self.dim = sample.shape[1]
        self.bits = min(BITS, self.dim)
        self.mean = sample.mean(0)
        centred = sample - self.mean
        axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, : self.bits]
        flat = centred @ axes
        turn = np.linalg.qr(np.random.default_rng(7).normal(size=(self.bits, self.bits)))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ vt).T
        self.project = axes @ turn
        code = self(sample)
        self.radius = self._radius(sample, code, k)
        self.split = split or min((s for s in SPLITS if s <= self.bits), key=lambda s: self._work(code, s), default=1)

    def __call__(self, v: np.ndarray) -> np.ndarray:
        on = (v - self.mean) @ self.project > 0
        return (on.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def _radius(self, sample: np.ndarray, code: np.ndarray, k: int) -> int:
        norm, seen = (sample**2).sum(1), []
        for i in range(0, len(sample), max(1, len(sample) // 256)):
            gap = norm - 2 * sample @ sample[i]
            gap[i] = np.inf
            near = np.argsort(gap, kind="stable")[: min(k, len(sample) - 1)]
            seen.append(np.bitwise_count(code[near] ^ code[i]))
        return int(np.quantile(np.concatenate(seen), KEPT_SHARE)) if seen and len(seen[0]) else self.bits

    def _work(self, code: np.ndarray, split: int) -> float:
        """Bucket lookups and codes reached by a query, over some of the sample's rows."""
        work, some = 0, range(0, len(code), max(1, len(code) // 64))
        reached = {i: np.zeros(len(code), bool) for i in some}
        for shift, width, near in self.limits(self.radius, split):
            if near >= 0:
                sub = substring(code, shift, width)
                work += len(some) * min(ball_size(width, near), len(np.unique(sub)))
                for i in some:
                    reached[i] |= np.bitwise_count(sub ^ sub[i]) <= near
        return work + 8 * sum(int(r.sum()) for r in reached.values())  # a code reached costs more than a lookup

    def limits(self, radius: int, split: int | None = None) -> list[tuple[int, int, int]]:
        """(shift, width, radius) of each substring: a code within `radius` is within one of these."""
        n = split or self.split
        edge = [self.bits * j // n for j in range(n + 1)]
        a, b = divmod(radius, n)
        return [(edge[j], edge[j + 1] - edge[j], a if j <= b else a - 1) for j in range(n)]


def substring(code, shift: int, width: int):
    return (code >> np.uint64(shift)) & np.uint64((1 << width) - 1)


def ball_size(width: int, near: int) -> int:
    return sum(math.comb(width, i) for i in range(min(near, width) + 1))


def ball(width: int, near: int) -> np.ndarray:
    """All values of `width` bits with at most `near` set."""
    shell = seen = np.zeros(1, np.uint64)
    for _ in range(min(near, width)):
        shell = np.unique((shell[:, None] | (np.uint64(1) << np.arange(width, dtype=np.uint64))).ravel())
        seen = np.unique(np.concatenate([seen, shell]))
        shell = seen
    return seen


class Segment:
    """Codes, vectors and bucket directories of some rows."""

    def __init__(self, codes: Codes, ids: np.ndarray, vectors: np.ndarray, code: np.ndarray, parts: list[tuple]):
        self.codes, self.ids, self.vectors, self.code, self.parts = codes, ids, vectors, code, parts
        self.near = {j: ball(w, r) if 0 <= r and ball_size(w, r) < len(parts[j][1]) else None for j, (_, w, r) in enumerate(codes.limits(codes.radius))}

    @classmethod
    def of(cls, codes: Codes, ids: np.ndarray, vectors: np.ndarray) -> "Segment":
        code, parts = codes(vectors), []
        for shift, width, _ in codes.limits(0):
            sub = substring(code, shift, width)
            rows = np.argsort(sub, kind="stable").astype(np.int32)
            value, start = np.unique(sub[rows], return_index=True)
            parts.append((rows, value, np.append(start, len(sub)).astype(np.int32)))
        return cls(codes, ids, vectors, code, parts)

    def packed(self) -> dict:
        names = ("rows", "value", "start")
        return {"ids": self.ids.tobytes(), "vectors": self.vectors.tobytes(), "code": self.code.tobytes(), "parts": [dict(zip(names, (x.tobytes() for x in p))) for p in self.parts]}

    @classmethod
    def unpacked(cls, codes: Codes, row: dict) -> "Segment":
        parts = [(np.frombuffer(p["rows"], np.int32), np.frombuffer(p["value"], np.uint64), np.frombuffer(p["start"], np.int32)) for p in row["parts"]]
        return cls(codes, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(-1, codes.dim), np.frombuffer(row["code"], np.uint64), parts)

    def probed(self, code: np.uint64) -> np.ndarray:
        """Rows in the buckets that the pigeonhole principle allows."""
        found = np.zeros(len(self.code), bool)
        for j, (shift, width, near) in enumerate(self.codes.limits(self.codes.radius)):
            if near < 0:
                continue
            rows, value, start = self.parts[j]
            own = substring(code, shift, width)
            if self.near[j] is None:
                at = np.flatnonzero(np.bitwise_count(value ^ own) <= near)
            else:
                want = self.near[j] ^ own
                at = np.minimum(np.searchsorted(value, want), len(value) - 1)
                at = at[value[at] == want]
            size = start[at + 1] - start[at]
            first = np.cumsum(size) - size
            found[rows[np.repeat(start[at] - first, size) + np.arange(size.sum())]] = True
        return np.flatnonzero(found)

    def within(self, code: np.uint64) -> np.ndarray:
        """Rows of all codes within the radius of `code`."""
        rows = self.probed(code)
        return rows[np.bitwise_count(self.code[rows] ^ code) <= self.codes.radius]

    def nearest(self, code: np.uint64, vector: np.ndarray, own, k: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(self.ids)) if whole else self.within(code)
        rows = rows[self.ids[rows] != own]
        score = np.sqrt(((self.vectors[rows] - vector) ** 2).sum(1))
        best = np.lexsort((self.ids[rows], score))[:k]
        return self.ids[rows][best], score[best]


def fit(df: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = SAMPLE_ROWS) -> Codes | None:
    """Codes learned from at most `sample_rows` rows; None without a valid vector among them."""
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    _, sample = _matrix(rows.select("v").toArrow()["v"], None)
    return Codes(sample, k) if len(sample) else None


def build_index(df: DataFrame, codes: Codes, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Every valid row of `df` in segments; a written table that any number of searches may read."""
    most = max(1, SEGMENT_BYTES // (8 * codes.dim))

    def run(batches):
        ids, vectors, held = [], [], 0

        def out():
            segment = Segment.of(codes, np.concatenate(ids), np.concatenate(vectors)).packed()
            return pa.RecordBatch.from_arrays([*(pa.array([segment[c]], pa.binary()) for c in ("ids", "vectors", "code")), pa.array([segment["parts"]], _PARTS)], ["ids", "vectors", "code", "parts"])

        for batch in batches:
            at, v = _matrix(batch.column(1), codes.dim)
            own = batch.column(0).to_numpy(zero_copy_only=False)[at].astype(np.int64)
            for a in range(0, len(at), most):
                ids.append(own[a : a + most])
                vectors.append(v[a : a + most])
                held += len(ids[-1])
                if held >= most:
                    yield out()
                    ids, vectors, held = [], [], 0
        if held:
            yield out()

    rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    return materialize(rows.mapInArrow(run, _INDEX))


def _valid(df: DataFrame, codes: Codes, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the rows whose id and vector count, the smallest vector of each id."""
    v = F.col(vec_col)
    whole = (F.size(v) == codes.dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(whole).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v).alias("v"))


def _search(index: DataFrame, asked: DataFrame, codes: Codes, k: int, id_col: str, whole: bool) -> DataFrame | None:
    """The best `k` of each segment for each query; None without queries."""
    n_blocks, out = -(-asked.count() * 8 * codes.dim // QUERY_BYTES), None
    for block in range(n_blocks):
        part = (asked if n_blocks == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block)).toArrow()
        vectors = np.asarray(part["v"].combine_chunks().flatten().cast(pa.float64())).reshape(-1, codes.dim)
        packed = index.sparkSession.sparkContext.broadcast((part["id"].to_numpy(), vectors, codes(vectors), codes))

        def run(batches, packed=packed):
            q_ids, q_vectors, q_codes, codes = packed.value
            for batch in batches:
                for row in range(batch.num_rows):
                    segment = Segment.unpacked(codes, batch.slice(row, 1).to_pylist()[0])
                    got = [segment.nearest(c, x, q, k, whole) for q, x, c in zip(q_ids, q_vectors, q_codes)]
                    if got:
                        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, [len(g[0]) for g in got])), pa.array(np.concatenate([g[0] for g in got])), pa.array(np.concatenate([g[1] for g in got]))], ["query_id", id_col, "score"])

        best = index.mapInArrow(run, f"query_id long, {id_col} long, score double")
        out = best if out is None else out.unionByName(best)
    return out


def search(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", codes: Codes | None = None, index: DataFrame | None = None) -> DataFrame:
    """query_id, rank (from 1), `id_col`, score (Euclidean distance) of each query's neighbours in `df`.

    `codes` and `index` may come from an earlier `fit` and `build_index` over `df`."""
    none = df.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    codes = codes or fit(df, k, id_col, vec_col)
    if codes is None:
        return none
    index = build_index(df, codes, id_col, vec_col) if index is None else index
    asked = materialize(_valid(queries, codes, id_col, vec_col))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", id_col))

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")

    found = _search(index, asked, codes, k, id_col, False)
    if found is None:
        return none
    found = materialize(ranked(found))
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = materialize(asked.join(full, "id", "left_anti"))
    rest = _search(index, short, codes, k, id_col, True)
    return found if rest is None else found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(ranked(rest))


def probe_shares(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row of measurement: n_rows, n_queries, and over all queries the summed rows in probed buckets
    and within the radius (for up to one block of queries)."""
    codes = fit(df, k, id_col, vec_col)
    part = _valid(queries, codes, id_col, vec_col).limit(QUERY_BYTES // (8 * codes.dim)).toArrow()
    q_codes = codes(np.asarray(part["v"].combine_chunks().flatten().cast(pa.float64())).reshape(-1, codes.dim))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                segment = Segment.unpacked(codes, row)
                yield pa.RecordBatch.from_pylist([{"n_rows": len(segment.ids), "probed": sum(len(segment.probed(c)) for c in q_codes), "near": sum(len(segment.within(c)) for c in q_codes)}])

    out = build_index(df, codes, id_col, vec_col).mapInArrow(run, "n_rows long, probed long, near long")
    return out.agg(*(F.sum(c).alias(c) for c in ("n_rows", "probed", "near"))).withColumns({"n_queries": F.lit(len(q_codes)), "radius": F.lit(codes.radius), "split": F.lit(codes.split)})
