"""Benchmark decontamination: windows of benchmark words, broadcast as a hash set, looked up at every word of every document.

Words are folded to bytes of one alphabet and numbered by the benchmark's vocabulary; a window of n consecutive words is one
64-bit polynomial of the numbers. A batch of documents is one array of numbers with separators, its windows are looked up
together in the sorted window hashes, and each match is verified word by word. Matches become word ranges, which
either cut the text or drop the document.

The benchmark's size is measured first. Up to ``block_bytes`` of text it is broadcast whole; a larger one passes in blocks of
about that size, each over all documents, and the ranges of all blocks are united.

Defined cases: a null or empty text has no words and no hits; items without words match nothing; an item of fewer words than n
is one window; items that share an id are one item with all their windows; repeated rows, null ids and other columns stay as they are (but for columns named like an added one); empty tables are fine.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from spindrift.llm.common import settle, without

#: Bytes of a word: 0-9, a-z after folding A-Z, and all of other alphabets.
_FOLD = bytes((b | 32) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_BASE = 0x9E3779B97F4A7C15 | 1


def fold_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _powers(n: int) -> np.ndarray:
    return np.array([pow(_BASE, k, 1 << 64) for k in range(n)], np.uint64)


def _window_hashes(numbers: np.ndarray, n: int) -> np.ndarray:
    found, powers = np.zeros(max(0, len(numbers) - n + 1), np.uint64), _powers(n)
    for k in range(n):
        found += numbers[k : len(numbers) - n + 1 + k].astype(np.uint64) * powers[k]
    return found


class WindowSet:
    """The windows of some benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], n: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        texts = [np.array([number(w) for w in fold_words(text)], np.int64) for _, text in items]
        self.flat = np.concatenate([*texts, np.empty(0, np.int64)])
        start, by_size = 0, {}
        for k, words in enumerate(texts):
            size = min(n, len(words))
            if size:
                hashes = _window_hashes(words, size)
                by_size.setdefault(size, []).append((hashes, np.full(len(hashes), k), start + np.arange(len(hashes))))
            start += len(words)
        #: size -> sorted hashes, items, places in ``flat``
        self.windows = {}
        for size, parts in by_size.items():
            hashes, owner, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = (hashes[order], owner[order], place[order])

    def scan(self, texts: list[str | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """Per text: its words, the united ranges of hit words, and the items found."""
        get = self.vocabulary.get
        rows = [[get(w, 0) for w in fold_words(t)] for t in texts]
        counts = [len(r) for r in rows]
        numbers = np.array([x for r in rows for x in (*r, 0)], np.int64)
        firsts = np.cumsum([0] + [c + 1 for c in counts])
        marks = np.zeros(len(numbers) + 1, np.int64)
        items: list[set[str]] = [set() for _ in texts]
        known = numbers > 0
        streak = np.cumsum(known)
        for size, (hashes, owner, place) in self.windows.items():
            if len(numbers) < size:
                continue
            inside = streak[size - 1 :] - np.append(0, streak[: len(streak) - size]) == size
            at = np.flatnonzero(inside)
            if not len(at):
                continue
            powers, wanted = _powers(size), np.zeros(len(at), np.uint64)
            for k in range(size):
                wanted += numbers[at + k].astype(np.uint64) * powers[k]
            left, right = np.searchsorted(hashes, wanted), np.searchsorted(hashes, wanted, side="right")
            for j in np.flatnonzero(right > left).tolist():
                here = numbers[at[j] : at[j] + size]
                for w in range(left[j], right[j]):
                    if np.array_equal(here, self.flat[place[w] : place[w] + size]):
                        doc = int(np.searchsorted(firsts, at[j], side="right")) - 1
                        items[doc].add(self.names[owner[w]])
                        marks[at[j]] += 1
                        marks[at[j] + size] -= 1
        covered = np.cumsum(marks[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
        ranges: list[list[tuple[int, int]]] = [[] for _ in texts]
        for a, b in edges.reshape(-1, 2).tolist():
            doc = int(np.searchsorted(firsts, a, side="right")) - 1
            ranges[doc].append((a - int(firsts[doc]), b - int(firsts[doc])))
        return counts, ranges, items


def _unite(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_words(text: str, ranges: list[int]) -> str:
    """The text without the words of ``ranges`` (begin, end, begin, end ...) and what stands between them."""
    spans = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for a, b in zip(ranges[::2], ranges[1::2]):
        kept.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join([*kept, text[at:]])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """Lists of (item, text), each of about ``block_bytes`` at most."""
    named = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + total // block_bytes
    for k in range(n):
        part = named if n == 1 else named.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r["item"] or "", r["text"]) for r in part.toLocalIterator()]


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """Adds n_words, hits (begin and end of each range of hit words, in turn) and items (their ids as strings, sorted)."""
    docs = without(docs, ("n_words", "hits", "items"))
    spark, found, names = docs.sparkSession, docs, docs.columns
    added = StructType().add("n_words", LongType()).add("hits", ArrayType(LongType())).add("items", ArrayType(StringType()))

    def scan(held, place, first):
        def run(batches):
            windows = held.value
            for batch in batches:
                texts = batch.column(place).to_pylist()
                counts, ranges, items = windows.scan(texts)
                columns = batch.columns
                if not first:
                    *columns, _, old_hits, old_items = columns
                    ranges = [_unite([*r, *zip(h[::2], h[1::2])]) for r, h in zip(ranges, old_hits.to_pylist())]
                    items = [s | set(o) for s, o in zip(items, old_items.to_pylist())]
                out = [pa.array(counts, pa.int64()), pa.array([[x for ab in r for x in ab] for r in ranges], pa.list_(pa.int64())), pa.array([sorted(s) for s in items], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, *out], [*names, "n_words", "hits", "items"])

        return run

    for k, block in enumerate(_blocks(benchmark, item_col, item_text, block_bytes)):
        held = spark.sparkContext.broadcast(WindowSet(block, n))
        found = (settle(found, "hits") if k else found).mapInArrow(scan(held, docs.columns.index(text_col), not k), StructType([*docs.schema.fields, *added.fields]))
    return found


def n_hit(hits: str = "hits"):
    return F.expr(f"aggregate(transform({hits}, (x, i) -> if(i % 2 = 0, -x, x)), 0L, (a, b) -> a + b)")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents", text_col: str = "text", **names) -> DataFrame:
    """Documents without contamination: those with a hit go (``documents``), or lose the hit words (``spans``)."""
    docs = without(docs, ("n_words", "hits", "items"))
    found = find_hits(docs, benchmark, n, text_col, **names)
    if remove == "documents":
        return found.where(F.size("hits") == 0).select(*docs.columns)
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    place, kept = found.columns.index(text_col), docs.columns

    def cut(batches):
        for batch in batches:
            texts, hits = batch.column(place).to_pylist(), batch.column(batch.schema.names.index("hits")).to_pylist()
            new = [cut_words(t, h) if h else t for t, h in zip(texts, hits)]
            columns = list(batch.columns[: len(kept)])
            columns[place] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, kept)

    return found.mapInArrow(cut, docs.schema)
