"""Mixing sources to target weights by the cube method.

Each source's target divided by its size gives the copies every document is due: a whole
number, and a fraction that is its inclusion probability. The flight phase moves these
probabilities inside the null-space of two constraints (tokens and documents of the source)
three documents at a time, until at most two in a block stay fractional. Blocks of bounded
size fly on their own, each holding back a few rows; what they leave flies again
together, level by level, until one block of the source remains: every source lands at its
own last level, whatever the other sources' sizes. The landing drops the constraint of
documents first: from the largest open document down, each moves against all smaller open
ones at once, which keeps the token total, until it is in or out; only the smallest is drawn
at last. Every move is a fair one (its expectation is nought), so each document is taken
with its inclusion probability. Only where a landing misses the tokens by more than a
thousandth, as beside a document larger than the others can make up for, further landings
are drawn and the nearest is taken. All chances come from hashes of the rows, so reruns agree.

Defined results: null texts and texts without words have size 0 and take 0; a null source
is a source of its own (sorted last); repeated rows are sampled each; documents of equal
size are taken in the order of their hashes; texts of any length count whole, and a text
larger than all others of its source together may leave the total off by part of its size;
no rows give no rows; other columns, whatever their names, pass through `apply_mix` unread.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.llm.common import materialize

BLOCK_ROWS = 8192
RESERVE = 62  # rows of a block that stay open for the next level
LANDING = 512  # rows of a source's last block that stay open for the landing, half of them at most
JOINED = BLOCK_ROWS // (RESERVE + 2)  # blocks of a level that make one of the next
NEAR, DRAWS = 1e-3, 64  # a landing this near to the tokens (as a share of them) is taken, else the nearest of so many
MOST_BROADCAST = 10_000  # sources; more of them are joined by a shuffle
WEIGHTS = (5, 2, 1)  # repeating over the sorted sources
SHARE, CAP = 1.5, 2.0
EPS = 1e-9


def set_targets(sizes: list[int], weights: list[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """Words for each source: `share` of all by weight, none above `cap` times its size."""
    target, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] / total > cap * sizes[i]]
        if not full:
            for i in open_:
                target[i] = rest * weights[i] / total
            break
        for i in full:
            target[i] = cap * sizes[i]
        open_ = [i for i in open_ if i not in set(full)]
        rest = share * sum(sizes) - sum(t for t in target)
    return target


def flight(size: np.ndarray, chance: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Probabilities moved to 0 or 1 but for at most two, token and document totals unchanged."""
    p = chance.astype(float).tolist()
    s, u = size.astype(float).tolist(), draw.tolist()
    held, at, n = [], 0, len(p)
    while True:
        while len(held) < 3 and at < n:
            if EPS < p[at] < 1 - EPS:
                held.append(at)
            at += 1
        if len(held) == 3:
            i, j, k = held
            step = [s[j] - s[k], s[k] - s[i], s[i] - s[j]]
            if not (step[0] or step[1] or step[2]):
                step = [1.0, -1.0, 0.0]
        elif len(held) == 2 and s[held[0]] == s[held[1]]:
            step = [1.0, -1.0]
        else:
            break
        up = min(((1 - p[h]) / v if v > 0 else p[h] / -v) for h, v in zip(held, step) if v)
        down = min((p[h] / v if v > 0 else (1 - p[h]) / -v) for h, v in zip(held, step) if v)
        move = up if u[held[0]] * (up + down) < down else -down
        for h, v in zip(held, step):
            p[h] += move * v
            if p[h] < EPS:
                p[h] = 0.0
            elif p[h] > 1 - EPS:
                p[h] = 1.0
        held = [h for h in held if 0 < p[h] < 1]
    return np.array(p)


def _draw(seed: int, step: int) -> float:
    x = (seed + (step + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (1 << 64) - 1
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (1 << 64) - 1
    return ((x ^ (x >> 31)) >> 11) / float(1 << 53)


def land(size: np.ndarray, chance: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """All probabilities moved to 0 or 1: from the largest document down against all smaller open ones
    together, tokens unchanged while any is left to move against."""
    p = chance.astype(float).copy()
    order = np.lexsort((seed, -size))
    for place, i in enumerate(order):
        rest, step = order[place + 1 :], 0
        while EPS < p[i] < 1 - EPS:
            rest = rest[(p[rest] > EPS) & (p[rest] < 1 - EPS) & (size[rest] > 0)]
            pull = size[i] / size[rest].sum() if len(rest) else 0.0
            up, down = 1 - p[i], p[i]
            if pull:
                up, down = min(up, p[rest].min() / pull), min(down, (1 - p[rest]).min() / pull)
            move = up if _draw(int(seed[i]), step) * (up + down) < down else -down
            p[i] += move
            p[rest] -= move * pull
            step += 1
        p[np.abs(p) < EPS], p[np.abs(p - 1) < EPS] = 0.0, 1.0
    return p


def land_near(size: np.ndarray, chance: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The first landing within `NEAR` of the tokens; of `DRAWS` landings the nearest where none is, as
    with a document that the others cannot make up for."""
    want, best, off = float(size @ chance), chance, math.inf
    for draw in range(DRAWS):
        p = land(size, chance, seed + np.uint64(draw * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        if abs(float(size @ p) - want) < off:
            best, off = p, abs(float(size @ p) - want)
        if off <= NEAR * want:
            break
    return best


def _fly(rows: pa.Table) -> pa.Table:
    """One block: flight of all but the reserve, and the landing where it is the last of its source."""
    rows = rows.take(np.lexsort((rows["size"].to_numpy(), rows["seed"].to_numpy())))
    size, p, seed = rows["size"].to_numpy(), rows["chance"].to_numpy().copy(), rows["seed"].to_numpy().astype(np.uint64)
    last = rows["blocks"][0].as_py() == 1
    fly = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    fly = fly[: max(0, len(fly) - (min(LANDING, len(fly) // 2) if last else RESERVE))]
    p[fly] = flight(size[fly], p[fly], (seed[fly] >> np.uint64(11)) / float(1 << 53))
    open_ = (p > EPS) & (p < 1 - EPS)
    p = np.where(open_, p, np.round(p))
    if last:
        p[open_] = land_near(size[open_], p[open_], seed[open_])
    return rows.set_column(rows.schema.get_field_index("chance"), "chance", pa.array(p))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, key: Column | None = None) -> DataFrame:
    """`id_col`, size, source_size, target, copies, taken (size x copies), seed for each row; `key` (a
    64-bit hash; of id, text and source unless given) is the seed and decides a row's chances."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.col(id_col), text, F.col(source_col)) if key is None else key
    rows = materialize(df.select(F.col(id_col).alias("id"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("size"), F.col(source_col).cast("string").alias("source"), key.alias("seed")))
    stats = [tuple(r) for r in rows.groupBy("source").agg(F.sum("size"), F.count("*")).collect()]  # one row a source
    stats.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [r[1] for r in stats]
    goal = set_targets(sizes, [weights[i % len(weights)] for i in range(len(stats))], share, cap)
    due = [t / s if s else 0.0 for t, s in zip(goal, sizes)]
    blocks = [max(1, -(-r[2] // BLOCK_ROWS)) for r in stats]
    plan = pa.table({
        "name": pa.array([r[0] for r in stats], pa.string()), "source_size": pa.array(sizes, pa.int64()), "target": pa.array(goal, pa.float64()),
        "base": pa.array([int(d + EPS) for d in due], pa.int64()), "chance": pa.array([max(0.0, d - int(d + EPS)) for d in due], pa.float64()),
        "blocks": pa.array(blocks, pa.int64()), "sid": pa.array(range(len(stats)), pa.int64()),
    })
    plan = spark.createDataFrame(plan)
    rows = rows.join(F.broadcast(plan) if len(stats) <= MOST_BROADCAST else plan, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    rows = rows.withColumn("block", F.pmod(F.col("seed"), F.col("blocks")))
    done, most = None, max(blocks, default=1)
    while True:
        flown = rows.groupBy("sid", "block").applyInArrow(_fly, rows.schema)
        if most == 1:
            break
        flown = materialize(flown)
        settled = F.col("chance").isin(0.0, 1.0)
        part = flown.filter(settled)
        done = part if done is None else done.unionByName(part)
        rows = flown.filter(~settled).withColumns({"block": F.floor(F.col("block") / JOINED), "blocks": F.ceil(F.col("blocks") / JOINED)})
        most = -(-most // JOINED)
    done = flown if done is None else done.unionByName(flown)
    copies = (F.col("base") + F.round("chance").cast("long")).cast("long")
    return done.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "seed")


def apply_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, all columns kept. Only rows that are equal in
    every column stand for each other: what they take together is dealt evenly to them."""
    names = df.columns
    rows = df.toDF(*[f"c{i}" for i in range(len(names))])
    own, text, source = (f"c{names.index(c)}" for c in (id_col, text_col, source_col))
    rows = rows.withColumn("key", F.xxhash64(*rows.columns))
    taken = mix(rows, own, text, source, key=F.col("key"), **options)
    taken = taken.groupBy(F.col(own).alias("id"), F.col("seed")).agg(F.sum("copies").alias("copies"), F.count("*").alias("m")).filter("copies > 0")
    rows = rows.join(taken, (F.col("key") == F.col("seed")) & F.col(own).eqNullSafe(F.col("id")))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("key", own).orderBy("m")))
    n = F.floor(F.col("copies") / F.col("m")) + F.when(F.col("r") <= F.col("copies") % F.col("m"), 1).otherwise(0)
    rows = rows.withColumn("n", n.cast("int")).filter("n > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
