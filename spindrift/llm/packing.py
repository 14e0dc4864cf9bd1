"""Packing by cutting-stock column generation.

A document's ids are cut into full sequences and a rest. Full ones are sequences of their own. The rests are the items of
a cutting-stock problem: their lengths, in classes, make a histogram of fixed size; a linear program over patterns (how
many items of each class share a sequence) is solved on the driver, where a knapsack dynamic program over the dual prices
finds each next pattern, until the value is proven to be within one sequence or one in 2,000 of the optimum; the
rounded-down solution says how often each pattern is used, and what rounding leaves over is packed first-fit decreasing, by
class counts alone. Documents are ranked within their class, in
parallel (counts by class and block of ids give each block's first rank), and the rank says pattern, copy and
place. A sequence holds at most ``capacity`` pieces, so the offsets inside it are one small window.

Text is read and tokenized once, in the pass that makes the pieces and their checksums.

Defined cases: a null or empty text is a document of the end id alone; rows that share a document id are documents of their
own; a null id sorts first; other columns are left; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import id_key, settle
from spindrift.llm.word_bpe import default_tokenizer, slices, word_bpe

CAPACITY = 4096
PIECES = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: full pieces of ``capacity`` ids, then the rest. ``row`` tells rows with one id apart."""
    path = tokenizer or default_tokenizer()

    def cut(batches):
        encoder = word_bpe(path)
        for batch in batches:
            ids_of, rows, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for a, b in slices(texts):
                ids, sizes = encoder.encode(texts.slice(a, b - a))
                data, ends = ids.astype("<u4"), np.cumsum(sizes)
                out: list[tuple] = []
                for k in range(b - a):
                    first, n = int(ends[k] - sizes[k]), int(sizes[k])
                    for s in range(0, n, capacity):
                        size = min(capacity, n - s)
                        out.append((ids_of[a + k], rows[a + k], s, size, zlib.crc32(data[first + s : first + s + size]), n))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(cut, PIECES)


def class_bounds(capacity: int, exact: int = 256, steps: int = 64) -> list[int]:
    """Upper bounds of the length classes: every length up to ``exact``, then ``steps`` to each doubling."""
    bounds, width = list(range(1, min(exact, capacity) + 1)), exact
    while bounds[-1] < capacity:
        bounds += range(width + width // steps, 2 * width + 1, width // steps)
        width *= 2
    return [b for b in bounds if b < capacity] + [capacity]


class _Knapsack:
    """The most valuable patterns for given prices: a dynamic program over room, in which items of a class enter as powers of two."""

    def __init__(self, sizes: np.ndarray, limits: np.ndarray, capacity: int) -> None:
        self.n, self.capacity, self.parts = len(sizes), capacity, []
        for k, (size, limit) in enumerate(zip(sizes.tolist(), limits.tolist())):
            left, part = min(limit, capacity // size), 1
            while left > 0:
                self.parts.append((k, min(part, left), min(part, left) * size))
                left, part = left - min(part, left), 2 * part

    def solve(self, prices: np.ndarray) -> None:
        self.worth, self.taken = np.zeros(self.capacity + 1), []
        for k, n, size in self.parts:
            if (value := n * prices[k]) > 0:
                with_it, without_it = self.worth[: self.capacity + 1 - size] + value, self.worth[size:]
                better = with_it > without_it
                np.copyto(without_it, with_it, where=better)
                self.taken.append((k, n, size, better))

    def pattern(self, room: int) -> np.ndarray:
        """The best pattern that fits ``room``."""
        counts = np.zeros(self.n)
        for k, n, size, better in reversed(self.taken):
            if room >= size and better[room - size]:
                counts[k] += n
                room -= size
        return counts


class _Simplex:
    """The restricted linear program: least sum of uses with basis @ uses = demand, by revised simplex.

    It starts from patterns of one class each, which covers any demand exactly.
    """

    #: Pivots after which the inverse is computed anew, so that errors don't add up.
    REFRESH = 64

    def __init__(self, sizes: np.ndarray, demand: np.ndarray, capacity: int) -> None:
        most = (capacity // sizes).astype(float)
        # A trace more than the demand, unlike for each class, so that no pivot is degenerate and none comes back.
        self.demand = demand + 1e-6 * (1 + np.random.default_rng(1).random(len(sizes)))
        self.basis, self.inverse, self.uses, self.pivots = np.diag(most), np.diag(1 / most), self.demand / most, 0

    def prices(self) -> np.ndarray:
        return self.inverse.sum(axis=0)

    def enter(self, column: np.ndarray) -> bool:
        """Take a pattern into the basis if its prices say that it saves anything."""
        if self.prices() @ column <= 1 + 1e-9:
            return False
        direction = self.inverse @ column
        able = direction > 1e-8
        ratios = np.where(able, self.uses / np.where(able, direction, 1), np.inf)
        # Of ties, the largest pivot.
        out = int(np.argmax(np.where(ratios <= ratios.min() + 1e-10, direction, -np.inf)))
        step = ratios[out]
        self.uses = self.uses - step * direction
        self.uses[out] = step
        self.basis[:, out] = column
        self.pivots += 1
        if self.pivots % self.REFRESH == 0:
            self.inverse = np.linalg.inv(self.basis)
            self.uses = self.inverse @ self.demand
        else:
            row = self.inverse[out] / direction[out]
            self.inverse -= np.outer(direction, row)
            self.inverse[out] = row
        self.uses[(self.uses < 0) & (self.uses > -1e-6)] = 0
        return True


#: The linear program is solved where its value is proven to lie within one sequence, or this share, of the optimum.
GAP = 5e-4
#: Rooms below the capacity whose best patterns are priced in each round too.
ROOMS = 16


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (a row each), how often the linear program uses them, and a proven lower bound of its value.

    Any prices at which no pattern is worth more than 1 bound the value from below: sizes over capacity do, and so do
    the present prices over the worth of the best pattern. It ends where value and bound meet, or no pattern saves anything.
    """
    if not len(sizes):
        return np.zeros((0, 0), np.int64), np.zeros(0), 0.0
    program, knapsack, bound = _Simplex(sizes, demand, capacity), _Knapsack(sizes, demand, capacity), float(sizes @ demand) / capacity
    for pattern, _ in _first_fit(sizes, demand, capacity):
        program.enter(pattern.astype(float))
    while True:
        prices = np.maximum(program.prices(), 0)
        knapsack.solve(prices)
        bound = max(bound, float(prices @ demand) / max(knapsack.worth[capacity], 1.0))
        if program.uses.sum() - bound <= max(1.0, GAP * bound):
            break
        rooms = [r for r in range(capacity, max(0, capacity - ROOMS), -1) if knapsack.worth[r] > 1 + 1e-9]
        if not sum([program.enter(knapsack.pattern(r)) for r in rooms]):
            break
    uses = np.maximum(np.linalg.solve(program.basis, demand.astype(float)), 0)
    assert np.allclose(program.basis @ uses, demand, rtol=1e-6, atol=1e-3), "the linear program misses the demand"
    return program.basis.T.round().astype(np.int64), uses, bound


def _first_fit(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Greedy patterns, largest class first; equal ones are made at once."""
    left, found = demand.copy(), []
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for k in np.flatnonzero(left)[::-1]:
            pattern[k] = min(left[k], room // sizes[k])
            room -= int(pattern[k] * sizes[k])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left -= times * pattern
        found.append((pattern, times))
    return found


@dataclass(frozen=True)
class Plan:
    """Row p: pattern p, used times[p] times, its sequences from first[p] on; rank[p, k]: the first rank of class k in it."""

    patterns: np.ndarray
    times: np.ndarray
    first: np.ndarray
    rank: np.ndarray


def make_plan(bounds: list[int], histogram: dict[int, int], capacity: int) -> Plan:
    """``histogram``: class -> documents."""
    classes = np.array(sorted(histogram), np.int64)
    sizes = np.array(bounds, np.int64)[classes] if len(classes) else classes
    demand = np.array([histogram[int(k)] for k in classes], np.int64)
    columns, uses, _ = column_generation(sizes, demand, capacity)
    chosen: list[tuple[np.ndarray, int]] = []
    left = demand.copy()
    for pattern, used in sorted(zip(columns, uses), key=lambda x: -x[1]):
        filled = pattern > 0
        times = min(int(used + 1e-6), int((left[filled] // pattern[filled]).min())) if filled.any() else 0
        if times:
            chosen.append((pattern, times))
            left -= times * pattern
    chosen += _first_fit(sizes, left, capacity)
    wide = np.zeros((len(chosen), len(bounds)), np.int64)
    for p, (pattern, _) in enumerate(chosen):
        wide[p, classes] = pattern
    times = np.array([t for _, t in chosen], np.int64)
    placed = wide * times[:, None]
    return Plan(wide, times, np.cumsum(times) - times, np.cumsum(placed, axis=0) - placed)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), all long, a row per piece."""
    spark = docs.sparkSession
    cut = settle(pieces(docs, tokenizer, capacity, id_col, text_col), "pieces")
    bounds = class_bounds(capacity)
    lookup = np.searchsorted(bounds, np.arange(capacity + 1)).tolist()
    cut = cut.withColumn("class", F.element_at(F.lit(lookup), (F.col("length") + 1).cast("int")))
    # Blocks of ids rank in parallel: 100,000 pieces each at most, about, and fewer as long as there are few blocks.
    n_pieces = cut.count()
    blocks = max(1, min(n_pieces // 500, 256), n_pieces // 100_000)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)))
    counted = cut.groupBy("class", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("class", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["class"]: r["n"] for r in counted.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(len(bounds) - 1, 0)
    plan = make_plan(bounds, histogram, capacity)
    shared = spark.sparkContext.broadcast(plan)
    within = Window.partitionBy("class", "block").orderBy(id_key(F.col("doc_id")), "row", "start")
    ranked = cut.withColumn("nth", F.row_number().over(within)).join(firsts, ["class", "block"]).withColumn("rank", F.col("first") + F.col("nth") - 1)

    last = len(bounds) - 1

    def place(batches):
        plan = shared.value
        for batch in batches:
            names = batch.schema.names
            cls, rank = (batch.column(names.index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("class", "rank"))
            sequence, slot = rank.copy(), np.zeros(len(rank), np.int64)
            for k in np.unique(cls[cls != last]):
                mine = cls == k
                own = np.flatnonzero(plan.patterns[:, k])
                p = own[np.searchsorted(plan.rank[own, k], rank[mine], side="right") - 1]
                past = rank[mine] - plan.rank[p, k]
                sequence[mine] = full + plan.first[p] + past // plan.patterns[p, k]
                slot[mine] = k * (1 << 32) + past % plan.patterns[p, k]
            keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in keep), pa.array(sequence), pa.array(slot)], [*keep, "sequence_id", "slot"])

    placed = ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))
