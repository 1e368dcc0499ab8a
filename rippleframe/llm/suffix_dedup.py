"""Removal of repeated byte strings with suffix arrays built by linear grouping.

Every window of `LENGTH` bytes has one anchor: the leftmost of its `SEED`-byte strings with
the smallest hash. Equal windows have equal anchors at equal offsets, so only anchors whose
hash occurs more than once matter. The bytes around such an anchor (a fragment) hold all
windows that may hang on it. Where all fragments of a hash are equal by a 128-bit digest,
every window in them occurs again. The others travel to the partition of the hash, equal
fragments of a batch as one, and become sequences of eight-byte symbols, to the right of
the anchor and, reversed, to the left. One suffix array orders both: suffix groups are
processed in descending order and split by the pointers to their previous smaller suffix,
then each group's order is emitted, without renaming or recursion. Neighbours in it that
agree on 200 - d bytes to the right and d bytes to the left share the window that starts d
bytes before the anchor; this is exact, whatever the hashes do.

Defined results: a null text is empty; texts of under `LENGTH` bytes lose nothing; repeated
rows count as occurrences of each other, null ids are ordinary; texts of any length are read
whole; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.common import materialize, slices

LENGTH, SEED = 200, 64
LEFT = LENGTH - SEED  # bytes before an anchor that a window may hold
SPAN = 1 << 20  # bytes at a time; positions inside take the low 20 bits of a key
FRAGMENTS = 12_000  # distinct fragments of one suffix array (one anchor's at least)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def suffix_array(symbols: list[int]) -> list[int]:
    """Suffix array of non-negative integers by linear grouping; a proper prefix sorts first."""
    text = [x + 1 for x in symbols] + [0]
    n = len(text)
    members: list[list[int]] = []
    group = [0] * n
    known: dict[int, int] = {}
    for x in sorted(set(text)):
        known[x] = len(members)
        members.append([])
    for i, x in enumerate(text):
        g = known[x]
        group[i] = g
        members[g].append(i)
    size = [len(m) for m in members]
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    closed = [False] * len(members)
    prev = [-1] * n

    # Phase one: from the highest group down, the suffixes before a group's members split off.
    at = len(members) - 1
    top = at
    while at >= 0:
        closed[at] = True
        mine = [i for i in members[at] if group[i] == at] if len(members[at]) != size[at] else members[at]
        hits: dict[int, int] = {}
        for i in mine:
            j = i - 1
            while j >= 0 and closed[group[j]]:
                j = prev[j]
            prev[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        if len(hits) == 1:
            ((j, _),) = hits.items()
            rounds = [[j]]
        elif hits:
            by: dict[int, list[int]] = {}
            for j, c in hits.items():
                by.setdefault(c, []).append(j)
            rounds = [by[c] for c in sorted(by, reverse=True)]
        else:
            rounds = []
        for some in rounds:
            parts: dict[int, list[int]] = {}
            for j in some:
                parts.setdefault(group[j], []).append(j)
            for g, moved in parts.items():
                if len(moved) == size[g]:
                    continue
                new = len(members)
                moved.sort()
                members.append(moved)
                size[g] -= len(moved)
                size.append(len(moved))
                closed.append(False)
                up = above[g]
                below.append(g)
                above.append(up)
                above[g] = new
                if up >= 0:
                    below[up] = new
                for j in moved:
                    group[j] = new
        at = below[at]

    # Phase two: each placed suffix places the chain before it, at the next place of each group.
    first = [0] * len(members)
    at, total = top, n
    while at >= 0:
        total -= size[at]
        first[at] = total
        at = below[at]
    out = [-1] * n
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[first[g]] = j
            first[g] += 1
            placed[j] = True
            j = prev[j]
    return out[1:]


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all windows that lie in one text; `raw` is the texts
    one after the other (at most SPAN bytes), `ends` where each ends."""
    n = len(raw) - LENGTH + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = (raw.astype(np.uint64) + np.uint64(1)) * _A
    h ^= h >> np.uint64(31)
    step, factor = 1, int(_B)
    while step < SEED:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor + 2 * step & (1 << 64) - 1 | 1
        step *= 2
    h = (h ^ (h >> np.uint64(29))) * _B
    h ^= h >> np.uint64(32)
    low = (h & ~np.uint64(SPAN - 1)) | np.arange(len(h), dtype=np.uint64)
    width, want = 1, LENGTH - SEED + 1
    while width * 2 <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (want - width)], low[want - width :])[:n]
    start = np.arange(n)
    inside = start + LENGTH <= ends[np.searchsorted(ends, start, "right")]
    at = np.unique((low[inside] & np.uint64(SPAN - 1)).astype(np.int64))
    return at, h[at]


def text_anchors(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for a, b in slices([len(t) for t in texts], SPAN):
        if b == a + 1 and len(texts[a]) > SPAN:
            raw, parts, step = np.frombuffer(texts[a], np.uint8), [], SPAN - LENGTH + 1
            for s in range(0, len(raw) - LENGTH + 1, step):
                piece = raw[s : s + SPAN]
                at, h = anchors(piece, np.array([len(piece)]))
                parts.append((at + s, h))
            at, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
            out.append((at, np.concatenate([p[1] for p in parts])[first]))
            continue
        ends = np.cumsum([len(t) for t in texts[a:b]])
        at, h = anchors(np.frombuffer(b"".join(texts[a:b]), np.uint8), ends)
        cut = np.searchsorted(at, np.append(0, ends))
        out += [(at[i:j] - s, h[i:j]) for i, j, s in zip(cut, cut[1:], np.append(0, ends))]
    return out


def _anchor_rows(batches):
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
        found = text_anchors(texts)
        n = pa.array(np.repeat(np.arange(len(texts)), [len(f[0]) for f in found]))
        if len(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[1] for f in found]).astype(np.int64)), batch.column(0).take(n), batch.column(1).take(n), pa.array(np.concatenate([f[0] for f in found]).astype(np.int32))], ["hash", "k1", "k2", "at"])


def _around(batch):
    """(k1, k2, anchor, hash, bytes before, bytes from the anchor on) of every place of a batch."""
    k1s, k2s, texts, places = (batch.column(c).to_pylist() for c in ("k1", "k2", "text", "places"))
    for k1, k2, text, found in zip(k1s, k2s, texts, places):
        raw = text.encode()
        for p in found:
            at = p["at"]
            yield k1, k2, at, p["hash"], raw[max(0, at - LEFT) : at], raw[at : at + LENGTH]


def _print_rows(batches):
    """One row for each distinct fragment of a batch: a digest in place of its bytes, its places packed."""
    for batch in batches:
        seen: dict[tuple, list] = {}
        for k1, k2, at, h, left, right in _around(batch):
            digest = hashlib.blake2b(left + b"\0" + right, digest_size=16).digest()
            seen.setdefault((h, digest, len(left), len(right)), []).append((k1, k2, at))
        if seen:
            h, digest, left, right = zip(*seen)
            where = [np.array(v, np.int64).tobytes() for v in seen.values()]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(digest, pa.binary()), pa.array(left, pa.int32()), pa.array(right, pa.int32()), pa.array(where, pa.binary())], ["hash", "digest", "left", "right", "places"])


def _fragment_rows(batches):
    """One row for each distinct fragment of a batch, with its places packed."""
    for batch in batches:
        seen: dict[tuple, list] = {}
        for k1, k2, at, h, left, right in _around(batch):
            seen.setdefault((h, left, right), []).append((k1, k2, at))
        if seen:
            where = [np.array(v, np.int64).tobytes() for v in seen.values()]
            h, left, right = zip(*seen)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(where, pa.binary())], ["hash", "left", "right", "places"])


def _groups(batches):
    """{(digest, left, right): places} of each anchor hash; rows come sorted by hash."""
    current, last = {}, None
    for batch in batches:
        for h, digest, left, right, places in zip(*(c.to_pylist() for c in batch.columns)):
            if h != last and current:
                yield last, current
                current = {}
            last = h
            current.setdefault((digest, left, right), []).append(places)
    if current:
        yield last, current


def _uniform(batches):
    """Ranges of the anchors whose fragments are all equal: every window they hold occurs again."""
    out, held = [], 0
    for _, prints in _groups(batches):
        if len(prints) == 1:
            ((_, left, right), packed), = prints.items()
            places = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 3)
            low = max(0, LENGTH - right)
            if len(places) > 1 and low <= left:
                out.append(np.column_stack([places[:, 0], places[:, 1], places[:, 2] - left, places[:, 2] - low + LENGTH]))
                held += len(places)
        if held > 100_000:
            yield _ranges(np.concatenate(out))
            out, held = [], 0
    if out:
        yield _ranges(np.concatenate(out))


def _mixed(batches):
    """Places of the anchors that stand in different fragments."""
    out, hashes, held = [], [], 0
    for h, prints in _groups(batches):
        if len(prints) > 1:
            places = np.frombuffer(b"".join(x for packed in prints.values() for x in packed), np.int64).reshape(-1, 3)
            out.append(places)
            hashes.append(np.full(len(places), h, np.int64))
            held += len(places)
        if held > 100_000:
            yield _places(np.concatenate(out), np.concatenate(hashes))
            out, hashes, held = [], [], 0
    if out:
        yield _places(np.concatenate(out), np.concatenate(hashes))


def _places(rows: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32))], ["hash", "k1", "k2", "at"])


def _ranges(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3].astype(np.int32))], ["k1", "k2", "start", "stop"])


def _padded(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


def _agree(rows: np.ndarray) -> np.ndarray:
    """Bytes at the front that each row shares with the one before it."""
    same = rows[1:] == rows[:-1]
    return np.append(0, np.where(same.all(1), rows.shape[1], same.argmin(1)))


def repeated_starts(hashes: list[int], left: list[bytes], right: list[bytes], copies: np.ndarray) -> np.ndarray:
    """(fragment, d) whether the window d bytes before the fragment's anchor occurs again."""
    n, wide = len(left), -(-LEFT // 8) * 8
    ahead, back = _padded(right, LENGTH), _padded([x[::-1] for x in left], wide)
    tail = np.ascontiguousarray(ahead[:, SEED:]).view(">u8")
    head = np.array(hashes, np.int64).view(np.uint64)[:, None]
    blocks, sym = np.unique(np.concatenate([head.astype(np.uint64), tail.astype(np.uint64), np.ascontiguousarray(back).view(">u8").astype(np.uint64)], 1), return_inverse=True)
    sym = sym.reshape(n, -1) + 1
    mid = 1 + tail.shape[1]
    gap = np.zeros((n, 1), np.int64)
    text = np.concatenate([sym[:, :mid], gap, sym[:, mid:], gap], 1)
    order = np.array(suffix_array(text.ravel().tolist()))
    length = text.shape[1]
    out = np.zeros((n, LEFT + 1), bool)
    by_right, by_left = order[order % length == 0] // length, order[order % length == mid + 1] // length
    agree_right, agree_left = _agree(ahead[by_right]), _agree(back[by_left])
    size_left, size_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    class_right, class_left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(LEFT + 1):
        class_right[by_right] = np.cumsum(agree_right < LENGTH - d)
        class_left[by_left] = np.cumsum(agree_left < d)
        able = np.flatnonzero((size_left >= d) & (size_right >= LENGTH - d))
        _, same = np.unique(class_right[able] * (n + 1) + class_left[able], return_inverse=True)
        out[able, d] = np.bincount(same, copies[able])[same] >= 2 if len(able) else False
    return out


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """(lowest, highest) d of each run of set windows."""
    edge = np.diff(np.concatenate([[0], starts.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def _solve(groups: list[dict]) -> pa.RecordBatch | None:
    """Removed ranges of all places of the fragments of complete anchor groups."""
    mixed = [x for fragments in groups for x in fragments.items()]
    h, left, right = zip(*(k for k, _ in mixed))
    found = repeated_starts(list(h), list(left), list(right), np.array([len(v) for _, v in mixed]))
    rows = [np.column_stack([p[:, 0], p[:, 1], p[:, 2] - hi, p[:, 2] - lo + LENGTH]) for (_, p), row in zip(mixed, found) if row.any() for lo, hi in _runs(row)]
    return _ranges(np.concatenate(rows)) if rows else None


def _repeats(batches):
    """Rows come sorted by hash: anchor groups are complete when the hash changes."""
    groups, current, last, held = [], {}, None, 0
    for batch in batches:
        for h, left, right, places in zip(*(c.to_pylist() for c in batch.columns)):
            if h != last and current:
                groups.append({k: np.concatenate(v) for k, v in current.items()})
                held += len(current)
                current = {}
                if held >= FRAGMENTS:
                    if (done := _solve(groups)) is not None:
                        yield done
                    groups, held = [], 0
            last = h
            current.setdefault((h, left, right), []).append(np.frombuffer(places, np.int64).reshape(-1, 3))
    if current:
        groups.append({k: np.concatenate(v) for k, v in current.items()})
    if groups and (done := _solve(groups)) is not None:
        yield done


def _cut(batches):
    for batch in batches:
        out = []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw, merged = (text or "").encode(), []
            for r in sorted((r["start"], r["stop"]) for r in ranges or ()):
                if merged and r[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r[1])
                else:
                    merged.append(list(r))
            kept, at = hashlib.sha256(), 0
            for a, b in merged:
                kept.update(raw[at:a])
                at = b
            kept.update(raw[at:])
            out.append((len(raw), merged, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([[{"start": a, "stop": b} for a, b in x[1]] for x in out], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array([x[2] for x in out], pa.string())],
            ["id", "n_bytes", "spans", "kept_sha256"],
        )


def find_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_bytes, spans (removed byte ranges), kept_sha256 for each row."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("id", "text").alias("k1"), F.hash("text", "id").cast("long").alias("k2"), "id", "text")
    found = materialize(rows.select("k1", "k2", "text").mapInArrow(_anchor_rows, "hash long, k1 long, k2 long, at int"))
    twice = materialize(found.groupBy("hash").count().filter("count > 1").select("hash"))  # written, so that the join can split a hot hash

    def around(places: DataFrame) -> DataFrame:
        """The rows that hold these places; the one exchange of the texts serves all joins with them."""
        listed = places.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "hash")).alias("places"))
        return rows.join(listed.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "id", "text", "places")

    ordered = lambda x: x.repartition("hash").sortWithinPartitions("hash")
    prints = ordered(around(found.join(twice, "hash")).mapInArrow(_print_rows, "hash long, digest binary, left int, right int, places binary"))
    uniform = prints.mapInArrow(_uniform, "k1 long, k2 long, start int, stop int")
    mixed = prints.mapInArrow(_mixed, "hash long, k1 long, k2 long, at int")
    fragments = ordered(around(mixed).mapInArrow(_fragment_rows, "hash long, left binary, right binary, places binary"))
    repeats = uniform.unionByName(fragments.mapInArrow(_repeats, "k1 long, k2 long, start int, stop int"))
    ranges = repeats.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    cut = rows.join(ranges.hint("shuffle_hash"), ["k1", "k2"], "left").select("id", "text", "ranges")
    out = cut.mapInArrow(_cut, f"id {kind}, n_bytes long, spans array<struct<start:int,stop:int>>, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
