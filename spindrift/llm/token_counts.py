"""Token counts of a sentencepiece BPE model by rank-synchronous merging of arrays.

A text, with white space marked as the model marks it, splits into pre-tokens: a run of marks with what follows.
No vocabulary entry crosses such a border (checked on loading; else a text stays whole), so each unlike pre-token
is merged once. A batch of new pre-tokens is one flat array of symbols with sequence borders. In each round every
sequence finds its lowest-ranked adjacent pair and all sequences apply theirs at once: each occurrence from the left,
or the leftmost alone where the merged symbol may start a pair of still lower rank. Sequences
without a pair leave the array. The count is the surviving symbols; a symbol outside the vocabulary counts its UTF-8 bytes.

Defined cases: a null or empty text has no tokens and no bytes; strings that look like control symbols are plain text;
repeated rows and null ids stay as they are; other columns are carried along, but for those named like an added one; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from spindrift.llm.common import without
from spindrift.llm.word_bpe import slices

MARK = "▁"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceMerger:
    #: Bytes of pre-tokens held at most, about; the table starts anew beyond that.
    MAX_BYTES = 64 << 20
    #: Bytes of new pre-tokens merged at once.
    BATCH_BYTES = 2 << 20

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.normalize = sp.normalize
        pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.bytes_fall_back = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        symbols = {p: k for k, p in enumerate(pieces)}
        for piece in pieces:
            for char in piece:
                symbols.setdefault(char, len(symbols))
        ranks = {p: r for r, p in enumerate(sorted(pieces, key=lambda p: -pieces[p]))}
        self.n = len(symbols) + 1
        merges = {}
        for piece in pieces:
            for k in range(1, len(piece)):
                a, b = symbols.get(piece[:k]), symbols.get(piece[k:])
                if a is not None and b is not None:
                    merges[a * self.n + b] = (ranks[piece], symbols[piece])
        order = sorted(merges)
        self.keys = np.array(order, np.int64)
        self.ranks = np.array([merges[k][0] for k in order], np.int64)
        self.made = np.array([merges[k][1] for k in order], np.int64)
        # The lowest rank of any pair that a symbol is part of, against the rank of the symbol itself.
        lowest = np.full(self.n, np.iinfo(np.int64).max)
        for part in (self.keys // self.n, self.keys % self.n):
            np.minimum.at(lowest, part, self.ranks)
        own = np.full(self.n, -1, np.int64)
        own[self.made] = self.ranks
        self.safe = lowest > own
        self.symbols = {c: k for c, k in symbols.items() if len(c) == 1}
        self.known = np.zeros(self.n, bool)
        self.known[[symbols[p] for p in pieces]] = True
        splits = all(MARK not in p.lstrip(MARK) for p in pieces)
        self.split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall if splits else (lambda x: [x] if x else [])
        self.plain = sp.normalize(" a  b\n") == f"{MARK}{MARK}a{MARK}{MARK}b\n"
        self.held: dict[str, int] = {}
        self.bytes = 0

    def marked(self, text: str) -> str:
        if not text:
            return ""
        return MARK + text.replace(" ", MARK) if self.plain else self.normalize(text)

    def merge(self, tokens: list[str]) -> np.ndarray:
        """The number of ids of each pre-token."""
        sizes = np.array([len(t) for t in tokens], np.int64)
        unknown, get = self.n - 1, self.symbols.get
        chars = "".join(tokens)
        flat = np.array([get(c, unknown) for c in chars], np.int64)
        seq = np.repeat(np.arange(len(tokens)), sizes)
        # Bytes are settled here: a character without a piece of its own that stays alone counts its bytes.
        wide = np.array([len(c.encode()) if get(c) is None or not self.known[get(c)] else 1 for c in set(chars)] or [0])
        alone = dict(zip(set(chars), wide.tolist()))
        worth = np.array([alone[c] for c in chars], np.int64) if wide.max() > 1 else np.ones(len(flat), np.int64)
        if not self.bytes_fall_back:
            worth[:] = 1
        counts = np.zeros(len(tokens), np.int64)
        while len(flat):
            pair = flat[:-1] * self.n + flat[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            able = (self.keys[at] == pair) & (seq[:-1] == seq[1:])
            rank = np.where(able, self.ranks[at], np.iinfo(np.int64).max)
            rank = np.append(rank, np.iinfo(np.int64).max)
            heads = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            lengths = np.diff(np.append(heads, len(flat)))
            best = np.repeat(np.minimum.reduceat(rank, heads), lengths)
            live = best < np.iinfo(np.int64).max
            if not live.all():
                np.add.at(counts, seq[~live], worth[~live])
                flat, seq, worth, rank, best, at = (x[live] for x in (flat, seq, worth, rank, best, np.append(at, 0)))
                if not len(flat):
                    break
            else:
                at = np.append(at, 0)
            hit = rank == best
            made = self.made[at]
            # Occurrences after the first wait where the new symbol could start a lower pair, and overlaps take turns.
            where = np.flatnonzero(hit)
            same = np.append(False, seq[where[1:]] == seq[where[:-1]])
            chained = np.append(False, where[1:] == where[:-1] + 1) & same
            run = np.arange(len(where)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(where))))
            take = where[((run % 2 == 0) & self.safe[made[where]]) | ~same]
            flat[take], worth[take] = made[take], 1
            stay = np.ones(len(flat), bool)
            stay[take + 1] = False
            flat, seq, worth = flat[stay], seq[stay], worth[stay]
        return counts

    def counts(self, texts: list[str | None]) -> list[int]:
        if self.bytes > self.MAX_BYTES:
            self.held, self.bytes = {}, 0
        split = [self.split(self.marked(t or "")) for t in texts]
        new = list({t for tokens in split for t in tokens if t not in self.held})
        for a, b in slices(pa.array(new, pa.string()), self.BATCH_BYTES):
            self.held.update(zip(new[a:b], self.merge(new[a:b]).tolist()))
        self.bytes += sum(map(len, new)) + 160 * len(new)
        get = self.held.__getitem__
        return [sum(map(get, tokens)) for tokens in split]


_held: dict[str, PieceMerger] = {}


def merger(path: str) -> PieceMerger:
    if path not in _held:
        _held[path] = PieceMerger(path)
    return _held[path]


def count_tokens(docs: DataFrame, model: str | None = None, limit: int = 4096, text_col: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens (long) and over_limit."""
    path = model or default_model()
    docs = without(docs, ("n_bytes", "n_tokens", "over_limit"))
    kept = [c for c in docs.columns if c != text_col]

    def count(batches):
        own = merger(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            counts = [n for a, b in slices(texts, 4 << 20) for n in own.counts(texts.slice(a, b - a).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    own_name = "_text" + "_" * max((len(c) for c in kept), default=0)
    sized = docs.select(*kept, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias(own_name))
    schema = StructType(sized.schema.fields[:-1]).add("n_tokens", LongType())
    return sized.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
