"""Ids of the lower-casing word-level BPE, from the tokenizers library, at the price of its unlike words only.

The tokenizer drops white space before it splits, so a text is the sequence of its chunks between white space, and equal
chunks have equal ids. Arrow splits a slice of texts and numbers its unlike chunks; of those, chunks of plain Latin letters with
marks after them or none split further into a lower-cased stem, which goes straight to the library's BPE model, and the marks. Every
other chunk goes through the library's whole pipeline (white space beyond ASCII inside a chunk included). Each worker
process holds one table of stems and chunks, bounded in bytes.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Id appended to each document by the contract.
END_ID = 2
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", ".,;:!?#*$%&"
_PLAIN = f"^{_LETTERS}$"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordBpe:
    #: Bytes of words that the table holds, about; it starts anew beyond that.
    MAX_BYTES = 64 << 20

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self._clear()

    def _clear(self) -> None:
        self.stems: dict[str, int] = {}
        self.wholes: dict[str, int] = {}
        #: Ids of all entries one after the other, and where each entry's ids begin; the last one is the end.
        self.flat, self.starts, self.bytes = array("H"), array("q", [0]), 0
        self.end = self._put([END_ID])

    def _put(self, ids: Sequence[int]) -> int:
        self.flat.extend(ids)
        self.starts.append(len(self.flat))
        return len(self.starts) - 2

    def _stem(self, stem: str) -> list[int]:
        return [t.id for t in self.model.tokenize(stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters))]

    def _whole(self, chunk: str) -> list[int]:
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def _rows(self, words: pa.Array, table: dict[str, int], ids_of: Callable[[str], list[int]]) -> np.ndarray:
        """The entry of each word; new ones are added."""
        coded = words.dictionary_encode()
        # Through numpy: to_pylist makes an Arrow scalar of each word first.
        unlike = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(table.get, unlike))
        for k in [k for k, row in enumerate(found) if row is None]:
            found[k] = table[unlike[k]] = self._put(ids_of(unlike[k]))
            self.bytes += len(unlike[k]) + 200
        return np.array(found, np.int64)[coded.indices.to_numpy()]

    def _chunk_rows(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each chunk, and that of the marks after it or -1."""
        bare = pc.utf8_rtrim(chunks, characters=_MARKS)
        plain = pc.match_substring_regex(bare, _PLAIN)
        marked = pc.and_(plain, pc.less(pc.binary_length(bare), pc.binary_length(chunks)))
        rows, marks = np.empty(len(chunks), np.int64), np.full(len(chunks), -1, np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        rows[is_plain] = self._rows(pc.utf8_lower(bare.filter(plain)), self.stems, self._stem)
        rows[~is_plain] = self._rows(chunks.filter(pc.invert(plain)), self.wholes, self._whole)
        tails = pc.replace_substring_regex(chunks.filter(marked), _LETTERS, "")
        marks[marked.to_numpy(zero_copy_only=False)] = self._rows(tails, self.wholes, self._whole)
        return rows, marks

    def encode(self, texts: Sequence[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with END_ID after each text, and the number of each text's ids, that one included."""
        if self.bytes > self.MAX_BYTES:
            self._clear()
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        split = pc.ascii_split_whitespace(texts)
        # A text with white space at its ends, or none but that, gives empty chunks there; they have no ids.
        coded = split.flatten().dictionary_encode()
        chunks, sizes = coded.dictionary, pc.list_value_length(split).to_numpy().astype(np.int64)
        rows, marks = self._chunk_rows(chunks)
        flat, starts = np.frombuffer(self.flat, np.uint16), np.frombuffer(self.starts, np.int64)
        # A table of this slice alone: each unlike chunk's ids, with its marks', and one more entry for the end.
        pairs = np.column_stack([np.append(rows, self.end), np.append(marks, -1)]).reshape(-1)
        kept = pairs[pairs >= 0]
        own, _ = _spread(flat, starts[kept], starts[kept + 1] - starts[kept])
        lengths = (starts[rows + 1] - starts[rows]) + np.where(marks >= 0, starts[marks + 1] - starts[marks], 0)
        lengths = np.append(lengths, 1)
        firsts = np.cumsum(lengths) - lengths
        ends = np.cumsum(sizes)
        at = np.full(len(coded) + len(texts), len(chunks), np.int32)
        words = np.ones(len(at), bool)
        words[ends + np.arange(len(texts))] = False
        at[words] = coded.indices.to_numpy()
        ids, stop = _spread(own, firsts[at], lengths[at])
        stop = stop[ends + np.arange(len(texts))] if len(texts) else stop
        return ids, np.diff(stop, prepend=0)


def _spread(flat: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` from each first on, one after the other, and where each ends."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(firsts - (ends - counts), counts)
    at += np.arange(total)
    return flat.take(at), ends


_held: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The tokenizer of this worker process."""
    if path not in _held:
        _held[path] = WordBpe(path)
    return _held[path]


def slices(texts: pa.Array, max_bytes: int = 12 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of a batch that hold about so many bytes at most, or one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
        yield start, stop
        start = stop
