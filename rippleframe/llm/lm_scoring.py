"""Language-model scoring by context-tree weighting.

The model is a context tree of depth `DEPTH` over the bytes before a byte, one tree for each
of the 255 binary decisions that a byte consists of. Every node holds a Krichevsky-Trofimov
estimate; a node's weighted probability is the mean of its own estimate and the product of
its children's, which mixes all depths. Counts do not depend on the order of the text, so the
tree is built from the distinct (context, byte) grams of the corpus: they are counted by
tasks, merged by one shuffle, and evaluated subtree by subtree (all grams that share their
last three context bytes meet in one partition); only the nodes of depth 0 to 2, at most
65,793 contexts of 255 decisions each whatever the corpus, pass through the driver. A text's score is the sum of the log10 conditional
probabilities of its bytes and of one end mark. The grams go to the scoring tasks in blocks
of bounded size, one pass over the rows a block.

Beside it stands a unigram word score with add-one smoothing. Its most frequent words are a
bounded table in every task; rarer words are joined to the vocabulary by a shuffle.

Defined results: null texts are empty (they hold the end alone); rows with equal content are
scored each; texts of any length are scored whole; without training rows nothing is known and
all estimates are the priors; words of equal counts are taken in word order; an empty table
gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.common import LOWER_TABLE, materialize, slices

DEPTH = 5
TOP_WORDS = 65_536
GRAM_BLOCK = 8_000_000  # grams in memory of a scoring task at a time
CHUNK = 1_000_000  # bytes at a time
_SLOTS = 24
_HASH = np.uint64(0x9E3779B97F4A7C15)
_LN10 = float(np.log(10))


def _fold(column) -> list[bytes]:
    return [(t or "").encode().translate(LOWER_TABLE) for t in column.to_pylist()]


def grams(texts: list[bytes]) -> np.ndarray:
    """Code of every byte and end mark with the DEPTH bytes before it (zeros before the text)."""
    raw = np.frombuffer(b"".join(b"\0" * DEPTH + t + b"\0" for t in texts), np.uint8)
    code = np.zeros(max(0, len(raw) - DEPTH), np.uint64)
    for i in range(DEPTH + 1):
        code = (code << np.uint64(8)) | raw[i : len(raw) - DEPTH + i]
    size = np.array([len(t) + 1 for t in texts])
    start = np.cumsum(size + DEPTH) - (size + DEPTH)
    keep = np.ones(len(code), bool)
    for i in range(DEPTH):  # positions whose last byte is padding of the next text
        keep[(start[1:] - DEPTH + i)] = False
    return code[keep]


def _merge(codes: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    code = np.concatenate(codes)
    order = np.argsort(code)
    code, first = np.unique(code[order], return_index=True)
    return code, np.add.reduceat(np.concatenate(counts)[order], first) if len(code) else np.zeros(0, np.int64)


def _count_grams(batches):
    codes, counts, held = [], [], 0
    for batch in batches:
        texts, train = _fold(batch.column(0)), batch.column(1).to_pylist()
        for use in (True, False):
            mine = [t for t, x in zip(texts, train) if x == use]
            for a, b in slices([len(t) for t in mine], CHUNK):
                code, n = np.unique(grams(mine[a:b]), return_counts=True)
                codes.append(code), counts.append(n * int(use))
                held += len(code)
                if held > 2_000_000:
                    code, n = _merge(codes, counts)
                    codes, counts, held = [code], [n], 0
                    if len(code) > 1_500_000:
                        yield _pairs(code, n)
                        codes, counts = [], []
    if codes:
        yield _pairs(*_merge(codes, counts))


def _pairs(code: np.ndarray, value: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(value)], ["code", "n"])


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.ones_like(x)
    for i in range(7):
        shift *= x + i
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a bit sequence with these counts."""
    a, b = zeros.astype(float), ones.astype(float)
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - np.log(np.pi)


def _node_keys(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the 8 decisions of each gram: (context, decision) key, and the bit taken."""
    byte, context = code & np.uint64(255), (code >> np.uint64(8)) << np.uint64(8)
    t = np.arange(8, dtype=np.uint64)[:, None]
    place = (np.uint64(1) << t) | (byte >> (np.uint64(8) - t))
    return context | place, ((byte >> (np.uint64(7) - t)) & np.uint64(1)).astype(bool)


class Level:
    """Nodes of one depth: sorted keys, counts, own and weighted log probability, stop chance."""

    def __init__(self, key, zeros, ones, below=None):
        self.key, self.zeros, self.ones = key, zeros, ones
        own = kt(zeros, ones)
        self.weighted = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.stop = np.ones(len(key)) if below is None else np.exp(own - np.log(2) - self.weighted)
        self.one = (ones + 0.5) / (zeros + ones + 1)

    def above(self, mask: np.uint64) -> tuple["Level", np.ndarray]:
        """The parents' level, and each node's parent."""
        key, up = np.unique(self.key & mask, return_inverse=True)
        return Level(key, *(np.bincount(up, x, len(key)) for x in (self.zeros, self.ones, self.weighted))), up


def _mask(depth: int) -> np.uint64:
    return np.uint64((1 << (8 * depth + 8)) - 1)


def _subtrees(code: np.ndarray, n: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray, np.ndarray]:
    """The depth-3 level of these grams; for each decision its depth-3 node, bit, and P(one) from there."""
    keys, bits = _node_keys(code)
    key, at = np.unique(keys, return_inverse=True)
    at, weight = at.reshape(keys.shape), np.broadcast_to(n.astype(float), keys.shape)
    ones = np.bincount(at[bits], weight[bits], len(key))
    level = Level(key, np.bincount(at[~bits], weight[~bits], len(key)), ones)
    levels, ups = [level], []
    for depth in range(DEPTH - 1, 2, -1):
        level, up = level.above(_mask(depth))
        levels.append(level), ups.append(up)
    path = [at]
    for up in ups:
        path.append(up[path[-1]])
    one = levels[0].one[path[0]]
    for level, where in zip(levels[1:], path[1:]):
        stop = level.stop[where]
        one = stop * level.one[where] + (1 - stop) * one
    return level, path[-1], bits, one


def _table(batches) -> tuple[np.ndarray, np.ndarray]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([g[0] for g in got]).astype(np.uint64), np.concatenate([g[1] for g in got])


def _roots(batches):
    code, n = _table(batches)
    if len(code):
        level = _subtrees(code, n)[0]
        key, up = np.unique(level.key & _mask(2), return_inverse=True)
        columns = [np.bincount(up, x, len(key)) for x in (level.zeros, level.ones, level.weighted)]
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), *map(pa.array, columns)], ["key", "zeros", "ones", "weighted"])


def _top(key, zeros, ones, below) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each depth-2 decision: P(one) = a + b x P(one) below it, all three depths mixed."""
    level = Level(key.astype(np.uint64), zeros, ones, below)
    a, b, where = level.stop * level.one, 1 - level.stop, np.arange(len(key))
    for depth in (1, 0):
        level, up = level.above(_mask(depth))
        where = up[where]
        stop = level.stop[where]
        a, b = stop * level.one[where] + (1 - stop) * a, (1 - stop) * b
    return key, a, b


def gram_scores(df: DataFrame, text_col: str, train: Column) -> DataFrame:
    """(code, n, score): log10 P(byte | context) of every gram of all texts, learned from the training rows."""
    spark = df.sparkSession
    shape = "code long, n long"
    counted = df.select(F.col(text_col).alias("text"), train.alias("train")).mapInArrow(_count_grams, shape)
    counted = materialize(counted.groupBy("code").agg(F.sum("n").alias("n")))
    parts = counted.repartition(F.shiftright("code", 8).bitwiseAND(0xFFFFFF))
    roots = parts.mapInArrow(_roots, "key long, zeros double, ones double, weighted double")
    top = roots.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "weighted"))).orderBy("key").toArrow()  # contexts of two bytes
    packed = spark.sparkContext.broadcast(_top(*(top[c].to_numpy() for c in ("key", "zeros", "ones", "weighted"))) if top.num_rows else None)

    def run(batches):
        code, n = _table(batches)
        if len(code):
            level, at, bits, one = _subtrees(code, n)
            key, a, b = packed.value
            up = np.searchsorted(key, (level.key & _mask(2)).astype(np.int64))
            one = a[up][at] + b[up][at] * one
            score = np.log10(np.where(bits, one, 1 - one)).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n), pa.array(score.astype(np.float32))], ["code", "n", "score"])

    return parts.mapInArrow(run, "code long, n long, score float")


class GramTable:
    """Scores of a block of grams, found through one slot table with a search for what shares a slot."""

    def __init__(self, code: np.ndarray, n: np.ndarray, score: np.ndarray):
        order = np.argsort(code)
        self.code, self.score = code[order], np.append(score[order], np.float32(0))
        self.slot = np.zeros(1 << _SLOTS, np.int32)
        busy = np.argsort(n[order], kind="stable")  # the most frequent gram of a slot is written last
        self.slot[self._slot(self.code[busy])] = busy

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return (code * _HASH) >> np.uint64(64 - _SLOTS)

    def __call__(self, code: np.ndarray) -> np.ndarray:
        if not len(self.code):
            return np.zeros(len(code))
        at = self.slot[self._slot(code)]
        miss = np.flatnonzero(self.code[at] != code)
        if len(miss):
            want = code[miss]
            place = np.searchsorted(self.code, want)
            place[place == len(self.code)] = 0
            at[miss] = np.where(self.code[place] == want, place, len(self.code))  # another block's gram adds 0
        return self.score[at]


_tables: dict[str, GramTable] = {}


def _gram_table(name: str, packed) -> GramTable:
    """One table a worker process; later tasks of the same block use it too."""
    if name not in _tables:
        _tables.clear()
        _tables[name] = packed.value
    return _tables[name]


def _add_scores(packed):
    """Adds to column `score` what this block's grams give each text."""
    name = uuid.uuid4().hex

    def run(batches):
        grams_of = _gram_table(name, packed)
        for batch in batches:
            texts, add = _fold(batch.column("text")), []
            for a, b in slices([len(t) for t in texts], CHUNK):
                each = grams_of(grams(texts[a:b]))
                size = np.array([len(t) + 1 for t in texts[a:b]])
                add.append(np.add.reduceat(each.astype(float), np.cumsum(size) - size))
            total = batch.column("score").to_numpy(zero_copy_only=False) + np.concatenate(add) if add else batch.column("score")
            yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(total))

    return run


def _count_words(batches):
    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update((text or "").encode().translate(LOWER_TABLE).split())
            if len(seen) > 400_000:
                yield _words(seen)
                seen = Counter()
    if seen:
        yield _words(seen)


def _words(seen: Counter):
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])


def _split_words(top, end_count: int):
    """Rows a text: one of what the frequent words give, and one for each other word and its frequency."""
    end = float(np.log10(end_count + 1))

    def run(batches):
        known = top.value
        task, row = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            ids, held, score = batch.column("id"), batch.column("held_out").to_pylist(), batch.column("score").to_pylist()
            uid, at, word, freq, part, tokens, hits = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = (text or "").encode().translate(LOWER_TABLE).split()
                total, sure, other = end, int(end_count > 0), []
                for w, f in Counter(words).items():
                    v = known.get(w)
                    if v is None:
                        other.append((w, f))
                    else:
                        total += v * f
                        sure += f
                uid += [task + row] * (1 + len(other))
                row += 1
                at += [i] * (1 + len(other))
                word += [b" %d" % (task + row), *(w for w, _ in other)]  # no word holds a space: matches nothing, spreads evenly
                freq += [0, *(f for _, f in other)]
                part += [total] + [0.0] * len(other)
                tokens += [len(words) + 1] + [0] * len(other)
                hits += [sure] + [0] * len(other)
                if len(uid) > 200_000:
                    yield _rows(uid, ids, held, score, at, word, freq, part, tokens, hits)
                    uid, at, word, freq, part, tokens, hits = [], [], [], [], [], [], []
            if uid:
                yield _rows(uid, ids, held, score, at, word, freq, part, tokens, hits)

    return run


def _rows(uid, ids, held, score, at, word, freq, part, tokens, hits):
    first = np.array(tokens) > 0
    row = np.array(at)
    mask = pa.array(np.where(first, row, 0), mask=~first)
    return pa.RecordBatch.from_arrays(
        [pa.array(uid, pa.int64()), ids.take(mask), pa.array(held, pa.bool_()).take(mask), pa.array(score, pa.float64()).take(mask), pa.array(word, pa.binary()), pa.array(freq, pa.int32()), pa.array(part, pa.float64()), pa.array(tokens, pa.int64()), pa.array(hits, pa.int64())],
        ["uid", "id", "held_out", "score", "word", "freq", "part", "n_tokens", "n_known"],
    )


def score_texts(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, held_out, n_tokens, n_known, train_tokens, base_score, score, all log10,
    for each row; rows with `held_out` are scored but not learned from."""
    spark = df.sparkSession
    shown = F.coalesce(held_out, F.lit(False))
    train = df.filter(~shown)
    vocabulary = materialize(train.select(F.col(text_col).alias("text")).mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    distinct, words = vocabulary.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = train.count()
    total, size = words + ends, distinct + (ends > 0)
    top = vocabulary.orderBy(F.desc("n"), "word").limit(TOP_WORDS).toArrow()
    known = spark.sparkContext.broadcast({w: float(v) for w, v in zip(top["word"].to_pylist(), np.log10(top["n"].to_numpy() + 1))})

    model = materialize(gram_scores(df, text_col, ~shown))
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), shown.alias("held_out"), F.lit(0.0).alias("score"))
    blocks = max(1, -(-model.count() // GRAM_BLOCK))
    for block in range(blocks):
        part = (model if blocks == 1 else model.filter(F.pmod(F.xxhash64("code"), F.lit(blocks)) == block)).toArrow()
        packed = spark.sparkContext.broadcast(GramTable(part["code"].to_numpy().astype(np.uint64), part["n"].to_numpy(), part["score"].to_numpy()))
        add = _add_scores(packed)
        if block < blocks - 1:
            rows = rows.mapInArrow(add, rows.schema)
    split = _split_words(known, ends)
    parts = rows.mapInArrow(lambda batches: split(add(batches)), f"uid long, id {kind}, held_out boolean, score double, word binary, freq int, part double, n_tokens long, n_known long")
    counts = vocabulary.hint("shuffle_hash")
    hit = F.col("n").isNotNull()
    parts = parts.join(counts, "word", "left").select(
        "uid", "id", "held_out", "score", "n_tokens",
        (F.col("n_known") + F.when(hit, F.col("freq")).otherwise(0)).alias("n_known"),
        (F.col("part") + F.when(hit, F.col("freq") * F.log10(F.col("n") + 1)).otherwise(0.0)).alias("part"),
    )
    out = parts.groupBy("uid").agg(F.max("id").alias(id_col), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("part").alias("part"), F.max("score").alias("score"))
    base = F.col("part") - F.col("n_tokens") * F.log10(F.lit(float(total + size + 1)))
    return out.select(id_col, "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
