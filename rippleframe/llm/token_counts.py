"""Token counts without ids.

A byte-pair vocabulary in which no piece holds a word-start mark behind another character
never merges across word starts, so a text's token count is the sum over its pre-tokens
(a run of spaces with what follows up to the next space). Each task keeps one table of
pre-token -> number of pieces; a document contributes its pre-token frequencies, which are
joined to that table and summed. No shuffle, no id sequence of a document, and the table
is emptied at `TABLE_LIMIT` entries (which only means counting again, never another result).

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows are counted
each; texts of any length are counted whole; an empty table gives an empty result; other
columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

TABLE_LIMIT = 600_000
MARK = "▁"  # sentencepiece's fixed word-start mark
_RUN = re.compile(" +[^ ]*")
_CROSSES = re.compile(f"[^{MARK}]{MARK}")
_loaded: dict[str, tuple] = {}


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens, each without the one leading space that the encoder puts back."""
    text = text.replace(MARK, " ")
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return [x[1:] for x in _RUN.findall(" " + text)]
    return text.split(" ")


class PieceTable:
    """Number of pieces of each distinct pre-token, counted once."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        vocab = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.whole = any(_CROSSES.search(p) for p in vocab)  # then texts can't be cut
        self.lone = len(self.model.encode("a ")) - len(self.model.encode("a"))  # a space that ends the text
        self.known: dict[str, int] = {}

    def frequencies(self, text: str) -> Counter:
        return Counter() if not text else Counter([text] if self.whole else pre_tokens(text))

    def learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.known]
        if len(self.known) + len(new) > TABLE_LIMIT:
            self.known.clear()
            new = list(tokens)
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            self.known.update(zip(part, map(len, self.model.encode(part, num_threads=1))))
        if "" in tokens:  # the encoder gives nothing for an empty string, with no space to put back
            self.known[""] = self.lone

    def counts(self, texts: list[str]) -> list[int]:
        out, at, step = [], 0, 64
        while at < len(texts):
            freqs = [self.frequencies(t) for t in texts[at : at + step]]
            self.learn(set().union(*freqs))
            known = self.known
            out += [sum(known[t] * n for t, n in f.items()) for f in freqs]
            at += step
        return out


def piece_table(model_path: str) -> PieceTable:
    """One table for each model and worker process; later tasks of the process use it too."""
    if model_path not in _loaded:
        _loaded[model_path] = PieceTable(model_path)
    return _loaded[model_path]


def count_tokens(df: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 4096) -> DataFrame:
    """`id_col`, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row."""

    def run(batches):
        pieces = piece_table(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = pieces.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
