"""N-gram Jaccard join of a table of documents with itself, exact, by grouped prefixes.

A document is the set of its word n-grams, as 64-bit hashes. All sets use one order of n-grams, from rare to frequent;
two sets that are similar enough must share an n-gram among their first ones (the prefix).

1. Documents with equal sets collapse into one variant, and variants with equal size and prefix into one group.
2. Groups meet at the n-grams of their prefixes, where size and position bound the overlap they can have. First each
   meets only the leader of the n-gram (the group where it stands first), which links most families of copies like a star.
3. Then groups are expanded: variants of an n-gram that are not yet of one component meet pairwise under the same bounds.
4. Candidates whose parity sketches already differ in more bits than linked sets can are dropped: two sets differ in at least
   as many n-grams as their sketches differ in bits. The rest is verified on the whole sets. Links give components; copies are never expanded into pairs.

The order only decides how many candidates there are, never the result. Frequencies for it are counted over the n-grams of
all documents, by the upper half of their hashes: sorted and counted by each task, packed into bins, added up bin by bin. What is
frequent is kept as levels in a table that grows with the number of frequent n-grams, which is broadcast.

Defined cases: null, empty and blank texts have the empty set and link with nothing; a text of fewer words than n is one
n-gram; rows that share an id are one document with the links of all its texts; a null id is one document, of the smallest
id inside, and null in the result; extra columns are left; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import id_key, release, settle
from spindrift.llm.components import connected_components
from spindrift.llm.word_bpe import slices

#: Bits of an n-gram's hash that find its place in the table of levels: the least, and the most (a byte to each place).
LEAST_BITS, MOST_BITS = 18, 26
#: Bits of a parity sketch: bit b is the parity of the set's n-grams that hash to b.
SKETCH_BITS = 1024
#: Documents that hold an n-gram, from which it counts as frequent.
SEEN = 48
#: Upper bits of a hash that name its bin, of the 32 that are counted; n-grams that a task holds before it packs them.
BIN_BITS, HELD = 12, 1 << 19
#: Bytes of text, about, whose sets a task holds before it hands their rows on; one text at least.
PIECE_BYTES = 4 << 20
#: Parts of the n-grams that are shuffled one after the other, a power of two.
PARTS = 4
#: Ids of documents that are broadcast at most (8 bytes each); pairs from which they are verified in PARTS parts.
BROADCAST_IDS, ONE_ROUND = 4 << 20, 10_000


@dataclass(frozen=True)
class Similar:
    """Sets are linked if 100 * intersection >= percent * union; n words to an n-gram."""

    n: int = 5
    percent: int = 80

    def prefix(self, size: int) -> int:
        return size - (self.percent * size + 99) // 100 + 1

    def overlap(self, a: str, b: str) -> str:
        """SQL for the least intersection of linked sets of these sizes."""
        return f"ceil({self.percent} * ({a} + {b}) / {100 + self.percent}.0D)"

    def unlike(self, a: str, b: str) -> str:
        """SQL for the largest symmetric difference of linked sets of these sizes."""
        return f"floor({100 - self.percent} * ({a} + {b}) / {100 + self.percent}.0D)"

    def possible(self, x: str, y: str) -> str:
        """SQL: sizes and positions of a common n-gram leave room for a link."""
        return (
            f"100 * least({x}.n, {y}.n) >= {self.percent} * greatest({x}.n, {y}.n) and "
            f"least({x}.n - {x}.pos, {y}.n - {y}.pos) >= {self.overlap(f'{x}.n', f'{y}.n')}"
        )


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes hashed at once; bytes from which a word is hashed by itself.
SLICE_BYTES, LONG_WORD = 1 << 18, 1 << 16
_STEP = 0x9E3779B97F4A7C15
#: A value for each byte, A-Z as a-z.
_VALUES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_VALUES[65:91] = _VALUES[97:123]
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """_STEP to the powers that a slice needs, and the inverses of these, modulo 2 ** 64."""
    found = []
    for base in (_STEP, pow(_STEP, -1, 1 << 64)):
        steps = np.full(SLICE_BYTES + LONG_WORD, base, np.uint64)
        steps[0] = 1
        found.append(np.multiply.accumulate(steps))
    return found[0], found[1]


def _word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each word data[start:stop + 1]: a polynomial of its bytes' values, from running sums over slices of bounded size."""
    import xxhash

    powers, inverses = _powers()
    found, at = np.empty(len(starts), np.uint64), 0
    long_words = np.flatnonzero(stops - starts >= LONG_WORD)
    for border in [*long_words.tolist(), len(starts)]:
        while at < border:
            base = starts[at]
            end = min(border, int(np.searchsorted(stops, base + SLICE_BYTES + LONG_WORD)))
            own = np.cumsum(_VALUES[data[base : stops[end - 1] + 1]] * powers[: stops[end - 1] + 1 - base])
            a, b = starts[at:end] - base, stops[at:end] - base
            before = np.where(a > 0, own[a - 1], np.uint64(0))
            found[at:end] = _mix((own[b] - before) * inverses[a] + (b - a).astype(np.uint64))
            at = end
        if border < len(starts):
            word = data[starts[border] : stops[border] + 1]
            found[border] = xxhash.xxh3_64_intdigest(np.where((word > 64) & (word < 91), word + 32, word).astype(np.uint8).tobytes())
            at = border + 1
    return found


def _ngrams(data: np.ndarray, ends: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted set of each text's n-grams, uint64; ``ends``: where each text ends in the UTF-8 bytes.

    An n-gram mixes the hashes of its words in order.
    """
    blank, firsts = _BLANK[data], np.append(0, ends[:-1])
    opens, closes = ~blank, ~blank
    opens[1:] &= blank[:-1]
    closes[:-1] &= blank[1:]
    inner = firsts[(firsts > 0) & (firsts < len(data))]
    opens[inner], closes[inner - 1] = ~blank[inner], ~blank[inner - 1]
    starts, stops = np.flatnonzero(opens), np.flatnonzero(closes)
    words = _word_hashes(data, starts, stops)
    bounds = np.searchsorted(starts, np.append(0, ends))
    made = np.full(max(0, len(words) - n + 1), n, np.uint64)
    for k in range(n):
        made = _mix(made * np.uint64(_STEP) + words[k : len(words) - n + 1 + k])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= n:
            own = np.sort(made[a : b - n + 1])
            yield own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                whole = _mix(whole * np.uint64(_STEP) + w)
            yield whole
        else:
            yield np.empty(0, np.uint64)


def shingles(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted set of n-grams of each text of an Arrow array."""
    for a, b in slices(texts, SLICE_BYTES):
        part = pc.fill_null(texts.slice(a, b - a), "").cast(pa.large_binary())
        _, offsets, data = part.buffers()
        at = np.frombuffer(offsets, np.int64)[part.offset : part.offset + len(part) + 1]
        yield from _ngrams(np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8), at[1:] - at[0], n)


def _pieces(batches, text: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to PIECE_BYTES in the column ``text``: sets are several times their text, and Spark's batches are bounded by rows alone."""
    for batch in batches:
        for a, b in slices(batch.column(text), PIECE_BYTES):
            yield batch.slice(a, b - a)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, np.uint64)]).view(np.int64)))


def _sets(docs: DataFrame, how: Similar) -> DataFrame:
    """Rows of (text, long columns) as (long columns, hashes)."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in _pieces(batches, 0):
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], _lists(list(shingles(batch.column(0), how.n)))], [*names, "hashes"])

    return docs.select("text", *names).mapInArrow(run, ", ".join([*(f"{c} long" for c in names), "hashes array<long>"]))


def _packed(keys: np.ndarray) -> pa.RecordBatch:
    """32-bit keys, counted: a row for each bin, with the gaps between its keys and their counts, bytes of one weight together."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts, keys = np.diff(np.append(starts, len(keys))).astype(np.uint32), keys[starts]
    gaps, bins = np.diff(keys, prepend=np.uint32(0)), keys >> np.uint32(32 - BIN_BITS)
    firsts = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    gaps[firsts] = keys[firsts] & np.uint32((1 << 32 - BIN_BITS) - 1)
    planes = lambda x: x.view(np.uint8).reshape(-1, 4).T.tobytes()
    ends = [*firsts[1:].tolist(), len(keys)]
    packed = [(planes(gaps[a:b]), planes(counts[a:b])) for a, b in zip(firsts.tolist(), ends)]
    return pa.RecordBatch.from_arrays([pa.array(bins[firsts].astype(np.int32)), *(pa.array(x, pa.binary()) for x in zip(*packed))], ["bin", "gaps", "counts"])


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _frequent(docs: DataFrame, how: Similar) -> DataFrame:
    """(level, keys): upper halves of the hashes of n-grams that SEEN documents or more hold, by the logarithm of that number. Every document counts."""

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for own in shingles(batch.column(0), how.n):
                held.append((own >> np.uint64(32)).astype(np.uint32))
                size += len(own)
                if size >= HELD:
                    yield _packed(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield _packed(np.concatenate(held))

    def add(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for at, own in groupby(rows, key=lambda row: row[0]):
            gaps, counts = zip(*((_unpacked(x), _unpacked(y)) for _, x, y in own))
            keys, counts = np.concatenate([np.cumsum(x, dtype=np.uint32) for x in gaps]), np.concatenate(counts)
            order = np.argsort(keys, kind="stable")
            keys, starts = keys[order], np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
            sums = np.add.reduceat(counts[order].astype(np.int64), starts)
            often = sums >= SEEN
            found, levels = keys[starts][often] + np.uint32(at << 32 - BIN_BITS), np.log2(sums[often]).astype(np.int32)
            if len(found):
                kept = [(int(k), found[levels == k].tobytes()) for k in np.unique(levels)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), (pa.int32(), pa.binary()))], ["level", "keys"])

    packed = docs.select("text").mapInArrow(count, "bin int, gaps binary, counts binary")
    return settle(packed.repartition("bin").sortWithinPartitions("bin").mapInArrow(add, "level int, keys binary"), "frequent")


def _levels(docs: DataFrame, how: Similar) -> np.ndarray:
    """By the upper bits of an n-gram's hash: 0, or the logarithm of the number of documents that hold it. At most half the places are taken."""
    known = _frequent(docs, how)
    sizes = sorted(((r["level"], r["n"]) for r in known.groupBy("level").agg(F.sum(F.length("keys") / 4).cast("long").alias("n")).collect()), reverse=True)
    bits = min(MOST_BITS, max(LEAST_BITS, sum(n for _, n in sizes).bit_length() + 1))
    least, left = 1, 1 << (bits - 1)
    for level, n in sizes:
        left -= n
        if left < 0:
            least = level + 1
            break
    table = np.zeros(1 << bits, np.uint8)
    for row in known.where(F.col("level") >= least).toLocalIterator():
        at = np.frombuffer(row["keys"], np.uint32) >> np.uint32(32 - bits)
        table[at] = np.maximum(table[at], row["level"])
    release(known)
    return table


PREFIXES = ", ".join(["d long, n int, f1 long, f2 long, p1 long, p2 long, sketch array<long>", *(f"token{k} array<long>, place{k} array<int>" for k in range(PARTS))])


def _prefixes(docs: DataFrame, how: Similar, table) -> DataFrame:
    """Size, fingerprints of set and prefix, parity sketch, and the prefix: n-grams and their places in the order, in PARTS parts by hash."""

    def run(batches):
        levels = table.value
        shift, other = np.uint64(65 - len(levels).bit_length()), np.uint64(0xD6E8FEB86659FD93)
        for batch in _pieces(batches, 1):
            rows, prefixes, sketches = [], [], []
            for s in shingles(batch.column(1), how.n):
                # The set is in order of hash, so a stable sort by level orders by level and hash.
                head = s[np.argsort(levels[(s >> shift).astype(np.int64)], kind="stable")[: how.prefix(len(s))]] if len(s) else s
                rows.append((len(s), *(int(v) for x in (s, head) for v in (np.add.reduce(_mix(x)).astype(np.int64), np.add.reduce(_mix(x ^ other)).astype(np.int64)))))
                prefixes.append(head)
                odd = np.bincount((s & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
                sketches.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            columns, sizes = [np.array(c, np.int64) for c in zip(*rows)], np.array([len(x) for x in prefixes], np.int64)
            flat = np.concatenate([*prefixes, np.empty(0, np.uint64)])
            place, row = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.arange(len(sizes)), sizes)
            parts = []
            for k in range(PARTS):
                mine = (flat & np.uint64(PARTS - 1)) == k
                ends = pa.array(np.append(0, np.cumsum(np.bincount(row[mine], minlength=len(sizes)))).astype(np.int32))
                parts += [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (flat[mine].view(np.int64), place[mine].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:]), pa.array(sketches, pa.list_(pa.int64())), *parts], _NAMES)

    return docs.select("d", "text").mapInArrow(run, PREFIXES)


_NAMES = [c.split()[0] for c in PREFIXES.split(", ")]


def _near(pairs: DataFrame, found: DataFrame, how: Similar) -> DataFrame:
    """The pairs that sizes and sketches leave, written to shared storage."""
    own = found.select("d", "n", "sketch")
    one, two = (own.select(F.col("d").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in "ab")
    differ = "aggregate(zip_with(s_a, s_b, (x, y) -> bit_count(x ^ y)), 0, (u, x) -> u + x)"
    return settle(pairs.join(one, "a").join(two, "b").where(f"{differ} <= {how.unlike('n_a', 'n_b')}").select("a", "b").distinct(), "near")


def _verified(pairs: DataFrame, rows: DataFrame, how: Similar) -> list[DataFrame]:
    """The pairs (a, b) that are linked, in tables written to shared storage; ``pairs`` is released."""
    wanted = settle(pairs.select(F.col("a").alias("d")).unionByName(pairs.select(F.col("b").alias("d"))).distinct(), "wanted")
    # Few ids meet the texts where these lie; beyond the limit, texts are dealt out by id.
    small = wanted.count() <= BROADCAST_IDS
    sets = settle(_sets(rows.join(F.broadcast(wanted) if small else wanted, "d", "left_semi").select("text", "d"), how), "sets")
    one = sets.select(F.col("d").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("d").alias("b"), F.col("hashes").alias("y"))
    linked = []
    # A document's set is shuffled for each of its pairs: one part of the pairs after the other, as with the n-grams.
    parts = PARTS if pairs.count() >= ONE_ROUND else 1
    for k in range(parts):
        part = pairs.where(F.pmod(F.xxhash64("b"), F.lit(parts)) == k) if parts > 1 else pairs
        met = part.join(one, "a").join(two, "b").where(f"size(array_intersect(x, y)) >= {how.overlap('size(x)', 'size(y)')}")
        linked.append(settle(met.select("a", "b"), "links"))
    release(wanted, sets, pairs)
    return linked


def _buckets(found: DataFrame, first: DataFrame, part: int) -> DataFrame:
    """Where the groups' prefixes meet: (token, pos, g, n, leader) of the tokens of one part that two groups or more have, written to shared storage."""
    heads = found.select("d", "n", "p1", "p2", f"token{part}", f"place{part}").join(first, ["d", "n", "p1", "p2"], "left_semi")
    met = heads.select(F.col("d").alias("g"), "n", F.inline(F.arrays_zip(F.col(f"place{part}").alias("pos"), F.col(f"token{part}").alias("token")))).repartition("token")
    leaders = met.groupBy("token").agg(F.count(F.lit(1)).alias("groups"), F.min(F.struct("pos", "g", "n")).alias("leader"))
    return settle(met.join(leaders, "token").where(F.col("groups") > 1).select("token", "pos", "g", "n", "leader"), "buckets")


def link(docs: DataFrame, how: Similar = Similar(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the size of its set, and the smallest id that links reach."""
    spark = docs.sparkSession
    rows = docs.select(id_key(F.col(id_col)).alias("d"), F.col(text_col).alias("text"))
    table = spark.sparkContext.broadcast(_levels(rows, how))
    found = settle(_prefixes(rows, how, table), "prefixes")
    some = found.where(F.col("n") > 0)
    variants = settle(some.groupBy("n", "f1", "f2").agg(F.min("d").alias("v"), F.min_by(F.struct("p1", "p2"), "d").alias("p")).select("n", "f1", "f2", "v", "p.*"), "variants")
    grouped = variants.groupBy("n", "p1", "p2").agg(F.min("v").alias("g"))
    members = settle(variants.select("n", "p1", "p2", "v").join(grouped, ["n", "p1", "p2"]).select("v", "g", "n"), "members")

    # A group's prefix is read where its first variant has it; ids alone went through the aggregations. One part of the n-grams
    # after the other is shuffled, so that no more than that lies on disk at once.
    first = grouped.withColumnRenamed("g", "d")
    shares = [_buckets(found, first, k) for k in range(PARTS)]
    buckets = reduce(DataFrame.unionByName, shares)
    star = buckets.alias("x").where(F.expr(f"g != leader.g and {how.possible('x', 'leader')}")).select(F.col("g").alias("a"), F.col("leader.g").alias("b"))
    star = settle(star.unionByName(members.where(F.col("v") != F.col("g")).select(F.col("v").alias("a"), F.col("g").alias("b"))).distinct(), "star")

    near = _near(star, some, how)
    linked = reduce(DataFrame.unionByName, _verified(near, rows, how))
    # Variants whose rows share a document id belong together.
    shared = some.join(variants.select("n", "f1", "f2", "v"), ["n", "f1", "f2"]).select("d", "n", "v")
    shared = settle(shared, "rows")
    same = shared.groupBy("d").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low != high").select("d", "low")
    linked = linked.unionByName(shared.join(same, "d").where("v != low").select(F.col("v").alias("a"), F.col("low").alias("b")))
    parts = connected_components(linked)

    # What the stars left: variants of one n-gram in different components.
    owned = members.join(parts.withColumnRenamed("node", "v"), "v", "left").select("v", "g", F.coalesce("component", "v").alias("c"))
    inside = owned.groupBy("g").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    open_buckets = buckets.join(inside, "g").groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("token")
    rest = settle(buckets.join(open_buckets, "token").select("token", "pos", "g", "n").join(owned, "g"), "rest")
    across = rest.alias("x").join(rest.alias("y"), F.expr(f"x.token = y.token and x.v > y.v and x.c != y.c and {how.possible('x', 'y')}")).select(F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    # Groups that meet no other group can still hold variants of different components.
    alone = owned.join(inside.where("low != high"), "g")
    within = alone.alias("x").join(alone.alias("y"), F.expr("x.g = y.g and x.v > y.v and x.c != y.c")).select(F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    left = across.unionByName(within).distinct().join(star, ["a", "b"], "left_anti").join(star.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    left = _near(left, some, how)
    release(rest, *shares, star)
    later = reduce(DataFrame.unionByName, _verified(left, rows, how))
    if not later.isEmpty():
        parts = connected_components(linked.unionByName(later))
    home = shared.join(parts.withColumnRenamed("node", "v"), "v", "left").select("d", F.col("n").alias("n_shingles"), F.coalesce("component", "v").alias("c"))
    all_rows = home.unionByName(found.where(F.col("n") == 0).select("d", F.col("n").alias("n_shingles"), F.col("d").alias("c")))
    plain = lambda c: F.when(F.col(c) != F.lit(-(2**63)), F.col(c))
    return all_rows.select(plain("d").alias("doc_id"), F.col("n_shingles").cast("long"), plain("c").alias("component_id"))


def keep_first(docs: DataFrame, how: Similar = Similar(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: that of the smallest id."""
    first = link(docs, how, id_col, text_col).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(id_key(F.col("doc_id")).alias("_jj")).distinct()
    return docs.join(first, id_key(docs[id_col]) == first["_jj"], "left_semi")
