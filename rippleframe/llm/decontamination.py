"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of ten consecutive words of a benchmark item (the whole item where it has
fewer) becomes a pattern over normalised text. A document is normalised once, scanned once,
and its hits are mapped back to word numbers and to character offsets of the original.
The automaton is bounded by `BLOCK_BYTES` of patterns, about a hundred megabytes of nodes; a
larger benchmark is cut into several, each broadcast once, which pass over the rows one after
the other within the same stage.

Defined results: null texts have no words; items without words match nothing; a null item
id is listed as the empty string; equal item ids count once; repeated rows are scanned each;
texts of any length are scanned whole; empty tables give no rows or no hits; other columns,
whatever their names, are not read, or pass unread where rows are dropped.
"""

from __future__ import annotations

import hashlib
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippleframe.llm.common import UPPER, LOWER, fold_words

WINDOW = 10
BLOCK_BYTES = 2_000_000  # of patterns in one automaton (one item's at least)
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FOLD = str.maketrans(UPPER, LOWER)
_built: dict[str, object] = {}


def item_windows(words: list[bytes], n: int = WINDOW) -> list[bytes]:
    if not words:
        return []
    if len(words) < n:
        return [b" ".join(words)]
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def window_blocks(items, n: int = WINDOW, most: int = BLOCK_BYTES):
    """Blocks of {window: item ids}, closed after the item with which they reach `most` bytes."""
    block: dict[bytes, set[str]] = {}
    held = 0
    for item, text in items:
        for w in item_windows(fold_words((text or "").encode()), n):
            held += 0 if w in block else len(w)
            block.setdefault(w, set()).add("" if item is None else str(item))
        if held >= most:
            yield block
            block, held = {}, 0
    if block:
        yield block


def _automaton(blob: bytes):
    key = hashlib.sha256(blob).hexdigest()
    if key not in _built:
        import ahocorasick

        _built.clear()
        auto = ahocorasick.Automaton()
        for w, items in pickle.loads(blob).items():
            auto.add_word(f" {w.decode('latin-1')} ", (len(w) + 2, w.count(b" ") + 1, tuple(items)))
        auto.make_automaton()
        _built[key] = auto
    return _built[key]


def scan(words: list[bytes], auto) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges (first, past last) of all occurrences, merged and sorted, and the items found."""
    text = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits = [(end - size + 1, n, items) for end, (size, n, items) in auto.iter(text)]
    if not hits:
        return [], set()
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    first = np.searchsorted(starts, [h[0] for h in hits]).tolist()
    return merge([(i, i + h[1]) for i, h in zip(first, hits)]), set().union(*(h[2] for h in hits))


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def character_spans(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Offsets in the original text of the word ranges."""
    at = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    return [{"start": at[a][0], "stop": at[b - 1][1]} for a, b in ranges]


_FOUND = "id {}, n_words long, n_hit long, spans array<struct<start:int,stop:int>>, item_ids array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _packed(df: DataFrame, benchmark: DataFrame, n: int, item_col: str, item_text_col: str, most: int) -> list:
    """The benchmark's blocks, each a broadcast of at most about `most` bytes."""
    items = ((r[0], r[1]) for r in benchmark.select(item_col, item_text_col).toLocalIterator())
    return [df.sparkSession.sparkContext.broadcast(pickle.dumps(b)) for b in window_blocks(items, n, most)]


def _pass(blob, first: bool, last: bool):
    def run(batches):
        auto = _automaton(blob.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            before = [(pickle.loads(b) if b else ([], set())) for b in batch.column(2).to_pylist()] if not first else [([], set())] * len(texts)
            out = []
            for text, (ranges, items) in zip(texts, before):
                words = fold_words((text or "").encode())
                found, more = scan(words, auto) if words else ([], set())
                out.append((len(words), merge(ranges + found), items | more))
            if not last:
                yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array([pickle.dumps(x[1:]) if x[1] else None for x in out], pa.binary())], ["id", "text", "hits"])
                continue
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([x[0] for x in out], pa.int64()), pa.array([sum(b - a for a, b in x[1]) for x in out], pa.int64()), pa.array([character_spans(t, x[1]) if x[1] else [] for t, x in zip(texts, out)], _SPANS), pa.array([sorted(x[2]) for x in out], pa.list_(pa.string()))],
                ["id", "n_words", "n_hit", "spans", "item_ids"],
            )

    return run


def find_contamination(df: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`id_col`, n_words, n_hit, spans (character offsets), item_ids for each row of `df`."""
    blobs = _packed(df, benchmark, n, item_col, item_text_col, block_bytes) or [df.sparkSession.sparkContext.broadcast(pickle.dumps({b"\x00": set()}))]
    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for i, blob in enumerate(blobs):
        last = i == len(blobs) - 1
        out = out.mapInArrow(_pass(blob, i == 0, last), _FOUND.format(kind) if last else f"id {kind}, text string, hits binary")
    return out.withColumnRenamed("id", id_col)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of `df` in which no window occurs, all columns kept."""
    for blob in _packed(df, benchmark, n, item_col, item_text_col, block_bytes):

        def run(batches, blob=blob):
            auto = _automaton(blob.value)
            for batch in batches:
                keep = [not scan(fold_words((t or "").encode()), auto)[0] for t in batch.column(text_col).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
