"""Resharding by minimum-cost flow.

Old shards are cut into blocks (a bounded number for each old shard, by a hash of the row).
The driver sees the block sizes only, solves which bytes go from each old shard to each new
one so that the fewest bytes move, realises each flow with whole blocks, and gives every
block its shard and its first slot. Rows then take their place by one broadcast join with
the bounded block table and a row number inside their block. `rewrite_affected` does this to
a layout on disk (a folder `shard=k` for each shard): the folders of the shards that gained
or lost a block are replaced, all others keep their files; rows move with all their columns
and without a shuffle but the one that gathers a shard's rows.

Defined results: a null text has no bytes; null ids are ordinary values; repeated rows each
get a slot; ties in a block are broken by id, checksum and size; texts of any length count
whole, and no block is cut, so shards are equal to within the largest block; an empty table
gives an empty result. Other columns, whatever their names, are carried in `row` or not read.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.llm.common import materialize

BLOCKS_PER_SHARD = 2048
FILE_BYTES = 256_000_000  # of text in a file that is rewritten
MOST_SHARDS = 4096  # old shards; with their blocks they pass through the driver
OVERHEAD = 16  # bytes that the contract adds to each row


def even_capacities(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


class _Network:
    """Successive shortest augmenting paths over an edge list with residual twins."""

    def __init__(self, n: int):
        self.to, self.cap, self.cost, self.out = [], [], [], [[] for _ in range(n)]

    def edge(self, a: int, b: int, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y), self.cap.append(c), self.cost.append(w)
        return len(self.to) - 2

    def solve(self, source: int, sink: int) -> None:
        n = len(self.out)
        while True:
            far, via, queue, queued = [float("inf")] * n, [-1] * n, deque([source]), [False] * n
            far[source] = 0
            while queue:
                a = queue.popleft()
                queued[a] = False
                for e in self.out[a]:
                    b = self.to[e]
                    if self.cap[e] and far[a] + self.cost[e] < far[b]:
                        far[b], via[b] = far[a] + self.cost[e], e
                        if not queued[b]:
                            queued[b] = True
                            queue.append(b)
            if via[sink] < 0:
                return
            path, at = [], sink
            while at != source:
                path.append(via[at])
                at = self.to[via[at] ^ 1]
            step = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= step
                self.cap[e ^ 1] += step


def solve_transfers(old: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from old shard i to new shard j: all old bytes placed, no capacity exceeded, the fewest
    bytes with i != j. Moving costs the same between any two shards, so one hub stands for all
    moves and the network has as many edges as shards, not their product."""
    if sum(old) > sum(capacity):
        raise ValueError("the new shards cannot hold the old ones")
    a, b = len(old), len(capacity)
    source, hub, sink = a + b, a + b + 1, a + b + 2
    net = _Network(a + b + 3)
    stay, leave, come = {}, [], []
    for i, size in enumerate(old):
        net.edge(source, i, size, 0)
        if i < b:
            stay[i] = net.edge(i, a + i, size, 0)
        leave.append(net.edge(i, hub, size, 1))
    for j, size in enumerate(capacity):
        come.append(net.edge(hub, a + j, size, 0))
        net.edge(a + j, sink, size, 0)
    net.solve(source, sink)
    moved = {(i, i): net.cap[e ^ 1] for i, e in stay.items() if net.cap[e ^ 1]}
    given = deque([i, net.cap[e ^ 1]] for i, e in enumerate(leave) if net.cap[e ^ 1])
    for j, e in enumerate(come):
        need = net.cap[e ^ 1]
        while need:
            i, left = given[0]
            step = min(need, left)
            moved[i, j] = moved.get((i, j), 0) + step
            need -= step
            given[0][1] -= step
            if not given[0][1]:
                given.popleft()
    return moved


def place_blocks(blocks: list[tuple[int, int, int]], flow: dict[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """Shard of each (old shard, block, bytes): largest block first, to the flow with the most bytes left."""
    left: dict[int, dict[int, int]] = {}
    for (i, j), n in flow.items():
        left.setdefault(i, {})[j] = n
    home = {}
    for i, block, size in sorted(blocks, key=lambda x: (-x[2], x[0], x[1])):
        goals = left.setdefault(i, {})
        if not goals:
            goals[i] = 0
        j = max(goals, key=lambda k: (goals[k], k == i, -k))
        goals[j] -= size
        home[i, block] = j
    return home


def _described(df: DataFrame, old_shard: Column, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """id, size, text_crc32, old_shard, block (and row, all columns) of each row."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    row = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []
    rows = df.select(F.col(id_col).alias("id"), (F.length(raw).cast("long") + OVERHEAD).alias("size"), F.crc32(raw).alias("text_crc32"), F.coalesce(old_shard.cast("int"), F.lit(0)).alias("old_shard"), *row)
    return rows.withColumn("block", F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(BLOCKS_PER_SHARD)).cast("int"))


def plan_blocks(rows: DataFrame, n_new: int, capacities: list[int] | None = None) -> tuple[pa.Table, list[int], list[int]]:
    """(old_shard, block, shard, base: the block's first slot), the bytes and the rows of each new shard."""
    stats = [tuple(r) for r in rows.groupBy("old_shard", "block").agg(F.sum("size"), F.count("*")).collect()]  # at most old shards x BLOCKS_PER_SHARD
    n_old = 1 + max((s[0] for s in stats), default=0)
    if n_old > MOST_SHARDS or any(s[0] < 0 for s in stats):
        raise ValueError(f"old shards must be numbers from 0 to {MOST_SHARDS - 1}")
    old = [0] * n_old
    for i, _, size, _ in stats:
        old[i] += size
    flow = solve_transfers(old, capacities or even_capacities(sum(old), n_new))
    home = place_blocks([s[:3] for s in stats], flow)
    held, base, columns = [0] * n_new, [0] * n_new, [[], [], [], []]
    for i, block, size, n in sorted(stats):
        j = home[i, block]
        for c, v in zip(columns, (i, block, j, base[j])):
            c.append(v)
        base[j] += n
        held[j] += size
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.table({k: pa.array(v, t) for k, v, t in zip(("old_shard", "block", "shard", "base"), columns, kinds)}), held, base


def reshard(df: DataFrame, old_shard: Column, n_new: int = 40, capacities: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """`id_col`, size, text_crc32, old_shard, shard, slot for each row, with `carry` also row, all its columns.

    `old_shard` must give integers from 0 to MOST_SHARDS - 1 (it is taken as it is; null counts as 0)."""
    rows = _described(df, old_shard, id_col, text_col, carry)
    rows = rows if carry else materialize(rows)
    places = df.sparkSession.createDataFrame(plan_blocks(rows, n_new, capacities)[0])
    rank = F.row_number().over(Window.partitionBy("old_shard", "block").orderBy("id", "text_crc32", "size"))
    return (
        rows.withColumn("rank", rank)
        .join(F.broadcast(places), ["old_shard", "block"])
        .select(F.col("id").alias(id_col), "size", "text_crc32", "old_shard", "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), *(["row"] if carry else []))
    )


def write_layout(df: DataFrame, shard: Column, path: str, shard_col: str = "shard") -> None:
    """The rows as a layout on disk: one folder for each shard. `shard_col` must not be a column of `df`."""
    df.withColumn(shard_col, shard.cast("int")).repartition(shard_col).write.mode("overwrite").partitionBy(shard_col).parquet(path)


def rewrite_affected(spark, path: str, n_new: int = 40, capacities: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> list[int]:
    """Reshard the layout under `path` in place; returns the shards whose folders were replaced or removed.

    The new files are complete before the old folders go, so a lost executor costs a task only."""
    docs = spark.read.parquet(path)
    names = [c for c in docs.columns if c != shard_col]
    rows = _described(docs, F.col(shard_col), id_col, text_col, True)
    places, held, counts = plan_blocks(rows, n_new, capacities)
    moves = [(a, b) for a, b in zip(places["old_shard"].to_pylist(), places["shard"].to_pylist()) if a != b]
    touched = sorted({x for m in moves for x in m})
    if not touched:
        return []
    placed = rows.join(F.broadcast(spark.createDataFrame(places)), ["old_shard", "block"]).filter(F.col("old_shard").isin(touched) | F.col("shard").isin(touched))
    files = max(1, -(-max(held) // FILE_BYTES))  # of a shard, each written by one task
    placed = placed.repartition(F.col("shard"), F.pmod("block", F.lit(files))).select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.col("shard").alias(shard_col))
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard_col).parquet(path)
    left = [s for s in touched if s >= n_new or not counts[s]]
    jvm = spark.sparkContext._jvm
    for s in left:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{shard_col}={s}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return touched
