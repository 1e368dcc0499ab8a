"""Near-duplicate documents by ProbMinHash.

A document is the multiset of its five-word shingles, weighted by their counts. Every shingle
is a Poisson process with its weight as rate; its arrivals fall on random components, each of
which keeps the earliest. Shingles drop out once their next arrival is later than every kept
one, so the work is about one arrival a shingle and a constant. Two components agree with the
probability Jaccard similarity (plain Jaccard where all counts are one). Bands of components
give buckets; pairs are verified exactly on the shingles of the whole texts.

Equal word sequences are one node. In the first round each node meets the two most central
nodes of its bucket, those whose buckets hold the most nodes. Where verified links leave a
bucket in several classes, every node outside its main class then meets every node of another
class in it: pair by pair in buckets of up to sixteen nodes, and in larger ones by blocks of
bounded bytes, so that a text travels once for each block it meets. In a pair of blocks the
masses of the shared shingles bound the similarity from above, and only pairs whose bound
reaches the threshold and that are not yet in one class are verified. No pair of a bucket is
left out, so one such round is enough.

Every row has a key, a hash of its id and text, under which its text is fetched again, and a
number that tells equal rows apart; ids may be null or repeated. Of each class one row is kept.

Defined results: null texts are empty; texts without words equal only texts with the same
characters; texts of one to four words have one shingle; texts of any length are compared
whole; a null id is an ordinary row and the class takes its smallest non-null id, null where
it has none; repeated rows fall in one class, of which one row is kept (the smallest id, nulls
last; among rows of that id the first in the table as read); an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rippleframe.llm.common import fold_words, materialize, slices

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
PIVOTS = 2  # nodes of a bucket that all others meet first
WHOLE = 16  # up to this size, all classes of a bucket are compared pair by pair, beyond it by blocks
BLOCK = 2_000_000  # bytes of text in a block
LIFTS = 2  # rounds in which small blocks find the ones that they meet
COMMON = 32  # shingles of more nodes are counted by matrix products, the others by their pairs
CHUNK = 2_000_000  # bytes at a time
WORD_LIMIT = 200_000  # entries of the word hash table of a worker process; each task leaves it empty
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CODE_BITS = np.uint64(44)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORD_LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(docs: list[list[bytes]], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document number, shingle hash) of every shingle; documents of fewer words have one."""
    n = np.array([len(d) for d in docs], np.int64)
    code = np.fromiter((_hashes[w] for d in docs for w in d), np.uint64, int(n.sum()))
    start = np.cumsum(n) - n
    value = np.zeros(len(code), np.uint64)
    for i in range(size):
        value[: len(code) - i] = value[: len(code) - i] * _A + code[i:] if i < len(code) else value[: len(code) - i]
    doc = np.repeat(np.arange(len(docs)), n)
    keep = np.arange(len(code)) - start[doc] <= (n - size)[doc]
    out_doc, out = doc[keep], _mix(value[keep])
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        own = [np.uint64(int.from_bytes(hashlib.blake2b(b" ".join(docs[i]), digest_size=8).digest(), "big")) for i in short]
        out_doc, out = np.append(out_doc, short), np.append(out, np.array(own, np.uint64))
    return out_doc, out


def prob_minhash(doc: np.ndarray, code: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """Signatures (n_docs x m) of weighted elements: per component the element that arrived first."""
    first = np.full(n_docs * m, np.inf)
    sign = np.zeros(n_docs * m, np.uint64)
    at, rate, time, k = doc.astype(np.int64), weight.astype(float), np.zeros(len(doc)), 0
    limit = np.full(n_docs, np.inf)
    while len(at):
        salt = np.uint64((k + 1) * int(_A) & (1 << 64) - 1)
        draw = _mix((code ^ salt) * _B + np.uint64(k))
        time = time - np.log(((draw >> np.uint64(20)) + np.uint64(1)).astype(float) * 2.0**-44 * (1 - 2.0**-45)) / rate
        live = time < limit[at]
        at, code, rate, time, draw = at[live], code[live], rate[live], time[live], draw[live]
        cell = at * m + (((draw & np.uint64(0xFFFFF)) * np.uint64(m)) >> np.uint64(20)).astype(np.int64)
        np.minimum.at(first, cell, time)
        won = time == first[cell]
        sign[cell[won]] = code[won]
        if k < 8 or k % 8 == 0:  # a limit from an earlier round only ends a process later, with the same result
            here = np.unique(at)
            limit[here] = first.reshape(n_docs, m)[here].max(1)
            live = time < limit[at]
            at, code, rate, time = at[live], code[live], rate[live], time[live]
        k += 1
    return sign.reshape(n_docs, m)


def signatures(docs: list[list[bytes]], m: int = BANDS * ROWS) -> np.ndarray:
    doc, value = shingles(docs)
    key, weight = np.unique((doc.astype(np.uint64) << _CODE_BITS) | (value >> np.uint64(64) - _CODE_BITS), return_counts=True)
    return prob_minhash(key >> _CODE_BITS, key & ((np.uint64(1) << _CODE_BITS) - np.uint64(1)), weight, len(docs), m)


def bands(sign: np.ndarray) -> np.ndarray:
    """One bucket hash for each band."""
    rows = sign.reshape(len(sign), BANDS, ROWS)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        out = _mix(out * _A + rows[:, :, i])
    return out.astype(np.int64)


def probability_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two multisets of hashes."""
    keys, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x = np.bincount(at[: len(a)], minlength=len(keys)).astype(float)
    y = np.bincount(at[len(a) :], minlength=len(keys)).astype(float)
    ratio = np.divide(x, y, out=np.full(len(x), np.inf), where=y > 0)
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    low = np.searchsorted(ratio, ratio, "left")
    more, less = np.append(np.cumsum(x[::-1])[::-1], 0), np.append(0, np.cumsum(y))
    both = (x > 0) & (y > 0)
    return float((1 / (more[low][both] / x[both] + less[low][both] / y[both])).sum())


def _node(words: list[bytes], text: str) -> bytes:
    return hashlib.blake2b(b" ".join(words) if words else b"\0" + text.encode(), digest_size=16).digest()


def _sign(batches):
    seen: set[bytes] = set()
    at = TaskContext.get().partitionId() << 33
    for batch in batches:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        for a, b in slices([len(t) for t in texts], CHUNK):
            docs = [fold_words(t.encode()) for t in texts[a:b]]
            nodes = [_node(d, t) for d, t in zip(docs, texts[a:b])]
            fresh = []
            for i, (node, d) in enumerate(zip(nodes, docs)):
                if d and node not in seen:
                    fresh.append(i)
                    seen.add(node)
            found: list = [None] * (b - a)
            if fresh:
                for i, row in zip(fresh, bands(signatures([docs[i] for i in fresh]))):
                    found[i] = row
            if len(seen) > 200_000:
                seen.clear()
            number = pa.array(np.arange(at, at + b - a))
            at += b - a
            yield pa.RecordBatch.from_arrays([number, batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(nodes, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["row", "id", "key", "node", "bands"])
    _hashes.clear()


def _rehash(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        same = [_node(fold_words(t.encode()), t) == n for t, n in zip(texts, batch.column(0).to_pylist())]
        yield batch.filter(pa.array(same, pa.bool_()))


def _verify(threshold: float):
    def run(batches):
        kept: dict[bytes, np.ndarray] = {}

        def of(node, text):
            if node not in kept:
                if len(kept) > 500:
                    kept.clear()
                kept[node] = shingles([fold_words((text or "").encode())])[1]
            return kept[node]

        for batch in batches:
            c = [x.to_pylist() for x in batch.columns]
            close = [probability_jaccard(of(a, s), of(b, t)) >= threshold for a, b, s, t in zip(*c)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(close, pa.bool_())], ["a", "b", "linked"])
        _hashes.clear()

    return run


def _shared(at: np.ndarray, col: np.ndarray, mass: np.ndarray, left: np.ndarray, right: np.ndarray, n_cols: int) -> tuple[np.ndarray, np.ndarray]:
    """For each left and right node their masses on the shingles that both hold. Entries (at, col,
    mass) are in order of at."""
    x, y = (np.zeros((len(left), len(right)), np.float32) for _ in "xy")
    held = np.bincount(col, minlength=n_cols)
    common = np.flatnonzero(held > COMMON)

    def entries(nodes):
        a, b = np.searchsorted(at, nodes), np.searchsorted(at, nodes, "right")
        take = np.repeat(a - np.append(0, np.cumsum(b - a)[:-1]), b - a) + np.arange((b - a).sum())
        return np.repeat(np.arange(len(nodes)), b - a), col[take], mass[take]

    (li, lc, lm), (ri, rc, rm) = entries(left), entries(right)
    for k in range(0, len(common), 1024):
        place = np.full(n_cols, -1)
        place[common[k : k + 1024]] = np.arange(len(common[k : k + 1024]))
        p, q = (np.zeros((n, len(common[k : k + 1024])), np.float32) for n in (len(left), len(right)))
        a, b = place[lc] >= 0, place[rc] >= 0
        p[li[a], place[lc[a]]], q[ri[b], place[rc[b]]] = lm[a], rm[b]
        x += p @ (q > 0).T.astype(np.float32)
        y += (p > 0).astype(np.float32) @ q.T
    a, b = held[lc] <= COMMON, held[rc] <= COMMON
    li, lc, lm, ri, rc, rm = li[a], lc[a], lm[a], ri[b], rc[b], rm[b]
    order = np.argsort(rc, kind="stable")
    ri, rc, rm = ri[order], rc[order], rm[order]
    a, b = np.searchsorted(rc, lc), np.searchsorted(rc, lc, "right")
    one = np.repeat(np.arange(len(lc)), b - a)
    two = np.repeat(a - np.append(0, np.cumsum(b - a)[:-1]), b - a) + np.arange(len(one)) if len(lc) else one
    cell = li[one] * len(right) + ri[two]
    for out, m in ((x, lm[one]), (y, rm[two])):
        out += np.bincount(cell, m, x.size).reshape(x.shape).astype(np.float32)
    return x, y


def _links(threshold: float):
    """Of two blocks the links at the threshold between left and right nodes of different classes, as
    many as connect what they connect."""

    def run(rows: pa.Table) -> pa.Table:
        place: dict[bytes, int] = {}
        names, kinds, texts, sides = (rows[c].to_pylist() for c in ("node", "class", "text", "is_left"))
        at = np.array([place.setdefault(n, len(place)) for n in names])
        first = np.unique(at, return_index=True)[1]
        label = np.unique(np.array([int.from_bytes(kinds[i]) for i in first], object), return_inverse=True)[1]
        doc, code = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, b in slices([len(texts[i]) for i in first], BLOCK // 2):
            d, c = shingles([fold_words(texts[i].encode()) for i in first[a:b]])
            doc.append(d + a), code.append(c)
        doc, code = np.concatenate(doc), np.concatenate(code)
        order = np.lexsort((code, doc))
        doc, code = doc[order], code[order]
        start = np.searchsorted(doc, np.arange(len(place) + 1))
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])))
        mass, total = np.diff(np.append(new, len(doc))), np.diff(start).astype(float)
        _, col, held = np.unique(code[new], return_inverse=True, return_counts=True)
        many = held[col] > 1
        of, col, mass = doc[new][many], (np.cumsum(held > 1) - 1)[col[many]], mass[many].astype(np.float32)
        side = np.array(sides)
        left, right = np.unique(at[side]), np.unique(at[~side])
        found = []
        for k in range(0, len(left), 128):
            part = left[k : k + 128]
            x, y = _shared(of, col, mass, part, right, int((held > 1).sum()))
            with np.errstate(divide="ignore"):
                # concave and homogeneous in (x, y), so the sum over shingles is at most this value of their sums
                bound = 1 / (total[part][:, None] / x + total[right] / y - 1)
            i, j = np.nonzero((bound >= threshold - 1e-6) & (label[part][:, None] != label[right]))
            best = np.argsort(-bound[i, j], kind="stable")
            i, j = part[i[best]], right[j[best]]
            while len(i):
                step = max(64, len(i) // 16)
                for a, b in zip(i[:step], j[:step]):
                    if label[a] != label[b] and probability_jaccard(code[start[a] : start[a + 1]], code[start[b] : start[b + 1]]) >= threshold:
                        label[label == label[b]] = label[a]
                        found.append((names[first[a]], names[first[b]]))
                i, j = i[step:], j[step:]
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
        _hashes.clear()
        return pa.table({"a": pa.array([min(f) for f in found], pa.binary()), "b": pa.array([max(f) for f in found], pa.binary())})

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, class): the smallest node that is connected to each node of links (a, b)."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        step = label.join(near, "node", "left").select("node", F.least("class", "near").alias("next"), "class")
        jump = label.select(F.col("node").alias("next"), F.col("class").alias("far"))
        new = materialize(step.join(jump, "next", "left").select("node", F.least("next", "far").alias("new"), "class"))
        label = new.select("node", F.col("new").alias("class"))
        if not new.filter("new <> class").limit(1).count():
            return label


def find_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`id_col`, key (of id and text), node (its word sequence), class, class_id (the smallest id of its
    class) and kept (true for one row of each class) for each row."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    signed = materialize(rows.mapInArrow(_sign, f"row long, id {kind}, key long, node binary, bands array<long>"))
    nodes = signed.filter("bands is not null").groupBy("node").agg(F.first("bands").alias("bands"), F.min("key").alias("key"))
    nodes = materialize(nodes)
    rows_of = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows_of.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialize(rows_of.join(shared, "bucket"))
    central = members.groupBy("node").agg(F.sum("n").alias("central"))
    best = Window.partitionBy("bucket").orderBy(F.desc("central"), "node")
    pivots = members.join(central, "node").withColumn("r", F.row_number().over(best)).filter(F.col("r") <= PIVOTS)
    pivots = materialize(pivots.select("bucket", F.col("node").alias("x"), "r"))
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", "key")
    texts = wanted.join(rows.select("key", "text"), "key").select("node", "text")
    texts = materialize(texts.mapInArrow(_rehash, texts.schema).dropDuplicates(["node"]))

    def tested(pairs: DataFrame) -> DataFrame:
        x, y = (texts.select(F.col("node").alias(n), F.col("text").alias(f"{n}_text")) for n in "ab")
        full = pairs.join(y, "b").join(x, "a").select("a", "b", "a_text", "b_text")
        return materialize(full.mapInArrow(_verify(threshold), "a binary, b binary, linked boolean"))

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def across(spots: DataFrame) -> DataFrame:
        """Links of apart nodes (left) with all nodes (right) of their buckets. Nodes are dealt into blocks by their
        home, the largest bucket that they are in; homes of few bytes share blocks with others that they meet."""
        size = texts.select("node", F.octet_length("text").alias("size"))
        homes = spots.groupBy("node").agg(F.first("class").alias("class"), F.max(F.struct("n", "bucket")).alias("top"), F.max("apart").alias("apart")).join(size, "node")
        homes = materialize(homes.withColumn("home", F.col("top.bucket")))
        tops = homes.select("node", "top")
        for _ in range(LIFTS):
            above = spots.select("bucket", "node").join(tops, "node").groupBy("bucket").agg(F.max("top").alias("top"))
            tops = spots.select("bucket", "node").join(above, "bucket").groupBy("node").agg(F.max("top").alias("top"))
        blocks = lambda c: (F.ceil((F.sum(v) + 1) / BLOCK).alias(k) for k, v in (("n_right", F.col(c)), ("n_left", F.when(F.col("apart"), F.col(c)).otherwise(0))))
        own = homes.groupBy("home").agg(F.sum("size").alias("bytes"), *blocks("size"))
        homes = materialize(homes.drop("top").join(tops.select("node", F.col("top.bucket").alias("top")), "node").join(own, "home"))
        few = F.col("bytes") <= BLOCK // 4
        shared = homes.filter(few).groupBy("top").agg(*blocks("size")).select("top", F.col("n_right").alias("m_right"), F.col("n_left").alias("m_left"))
        homes = homes.join(shared, "top", "left")
        block = lambda side: F.when(few, F.xxhash64(F.lit(0), "top", F.pmod(F.xxhash64("home"), f"m_{side}"))).otherwise(F.xxhash64(F.lit(1), "home", F.pmod(F.xxhash64("node"), f"n_{side}")))
        homes = materialize(homes.select("node", "class", block("left").alias("left"), block("right").alias("right")))
        spots = spots.select("bucket", "node", "apart").join(homes.drop("class"), "node")
        met = spots.groupBy("bucket").agg(F.collect_set(F.when(F.col("apart"), F.col("left"))).alias("lefts"), F.collect_set("right").alias("rights"))  # blocks, not nodes
        spots = materialize(spots.join(met, "bucket"))
        every = lambda c: F.explode(F.array_distinct(F.flatten(F.collect_set(c))))
        sent = spots.groupBy("node", "right").agg(every("lefts").alias("left")).select("node", "left", "right", F.lit(False).alias("is_left"))
        sent = sent.unionByName(spots.filter("apart").groupBy("node", "left").agg(every("rights").alias("right")).select("node", "left", "right", F.lit(True).alias("is_left")))
        full = sent.join(homes.select("node", "class"), "node").join(texts.select("node", "text"), "node")
        return materialize(full.groupBy("left", "right").applyInArrow(_links(threshold), "a binary, b binary"))

    first = members.join(pivots, "bucket")
    done = tested(ordered(first.select("x", F.col("node").alias("y"))))
    classes = components(done.filter("linked"))
    of = classes.select("node", "class")
    placed = members.join(of, "node", "left").withColumn("class", F.coalesce("class", "node"))
    main = pivots.filter("r = 1").select("bucket", F.col("x").alias("node")).join(of, "node", "left").select("bucket", F.coalesce("class", "node").alias("main"))
    placed = placed.join(main, "bucket").withColumn("apart", F.col("class") != F.col("main"))
    placed = materialize(placed.join(placed.filter("apart").select("bucket").distinct(), "bucket", "left_semi").drop("main"))
    small = placed.filter(F.col("n") <= WHOLE)
    pairs = small.filter("apart").select("bucket", F.col("class").alias("other"), F.col("node").alias("x")).join(small.select("bucket", "class", F.col("node").alias("y")), "bucket").filter("class <> other")
    pairs = ordered(pairs.select("x", "y")).join(done.select("a", "b"), ["a", "b"], "left_anti")
    links = done.filter("linked").select("a", "b").unionByName(tested(pairs).filter("linked").select("a", "b"))
    classes = components(links.unionByName(across(placed.filter(F.col("n") > WHOLE))))
    named = signed.select("row", "id", "key", "node").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    named = materialize(named)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    shared = named.groupBy("class").agg(F.count("*").alias("n"), first.alias("first")).filter("n > 1")  # written, so that a large class can be split in the join
    shared = materialize(shared.select("class", F.col("first.id").alias("class_id"), F.col("first.row").alias("kept")))
    named = named.join(shared, "class", "left")
    alone = F.col("kept").isNull()
    return named.select(F.col("id").alias(id_col), "key", "node", "class", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), (alone | (F.col("kept") == F.col("row"))).alias("kept"))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, all columns kept: that of its smallest id; of rows that are equal in id and
    text any one."""
    names = df.columns
    rows = df.toDF(*[f"c{i}" for i in range(len(names))])
    own, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    keep = find_classes(rows, own, text, threshold).filter("kept").select("key", F.col(own).alias("id"))
    rows = rows.withColumn("own", row_key(own, text))
    rows = rows.join(keep, (F.col("own") == F.col("key")) & F.col(own).eqNullSafe(F.col("id"))).dropDuplicates(["key", "id"])
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
