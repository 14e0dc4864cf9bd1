"""An adaptive range coder for token ids that mixes predictions of order 0, 1 and 2.

Every block starts from the same model and codes alone. In a block, tables keyed by the last id and by a hash of the
last two guess the next id, each guess with a confidence that hits raise and misses lower. The pair of confidences
selects the weights of the order-2 and the order-1 guess, which follow how often such guesses were right in the block; what
remains of the range is the order-0 distribution over all ids: the upper byte by counts that follow the block, the lower byte
given the upper one. The order-0 model starts from the counts of the file (``Prior``), which its header holds. A 64-bit range
coder narrows its range by the order first, then by the upper and the lower byte of an id that no guess hits, and gives 32-bit
words; nothing passes by it.

A block is cut into stripes of consecutive ids. Each has a range coder and a last id of its own, and all learn in the block's one
model. The stripes of a call are coded side by side: step t codes id t of all of them with numpy operations over the
stripes. Blocks do not depend on each other.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK, STRIPES = 4096, 4
#: Bits of the order-0 distributions and of the weights.
_SLOT_BITS, _WEIGHT_BITS = 12, 16
_SLOTS = 1 << _SLOT_BITS
#: A range of less than this takes or gives a word: one at most for each id, since an id leaves 16 of it at least.
_LEAST, _WORD, _LOW = np.uint64(1 << 32), np.uint64(32), np.uint64((1 << 32) - 1)
_SLOT_SHIFT, _WEIGHT_SHIFT, _LAST_SLOT = np.uint64(_SLOT_BITS), np.uint64(_WEIGHT_BITS), np.uint64(_SLOTS - 1)
#: Steps after which order 0 and the weights are renewed: often at first, then each 512 ids.
_RENEW = frozenset(n // STRIPES for n in [16, 32, 64, 96, 160, 224, 320, *range(480, BLOCK, 512)])
#: Weight of the file's counts of upper bytes, and of each id seen in the block.
_START, _SEEN = 2048, 24
#: Bits of the tables of guesses, and an id's share of the place in them: order 1's, then two of order 2's.
_ORDER1, _ORDER2 = 10, 11
_PLACES = (1 << _ORDER1) + (1 << _ORDER2)
_HASH = sum((np.arange(65536) * m >> (16 - bits) & ((1 << bits) - 1)) << at for m, bits, at in ((40503, _ORDER1, 0), (31153, _ORDER2, 16), (50021, _ORDER2, 32)))
#: Per cent of guesses that are right, where a block has not yet shown it, by the confidences of order 2 (outer) and order 1, and
#: the guesses that this counts for; order 1's are those of which order 2's is wrong. Measured on check_l.
_RIGHT2 = np.array([2, 6, 12, 19, 30, 55, 76, 83, 62, 71, 79, 90, 86, 91, 91, 97])
_RIGHT1 = np.array([3, 15, 36, 60, 4, 5, 19, 35, 4, 6, 3, 21, 4, 8, 4, 6])
_TRIES = 32


def _shares(counts: np.ndarray) -> np.ndarray:
    """Each row's counts as whole shares of _SLOTS, none of them 0."""
    total = np.maximum(counts.sum(axis=-1, keepdims=True), 1)
    shares = 1 + counts * (_SLOTS - counts.shape[-1]) // total
    shares[np.arange(len(shares)), counts.argmax(axis=-1)] += _SLOTS - shares.sum(axis=-1)
    return shares


def _pairs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Two numbers in one, so that one look-up finds both."""
    return low.astype(np.uint64) | high.astype(np.uint64) << _WORD


class Prior:
    """The order-0 model that blocks start from: counts of the upper byte, and shares of the lower byte given the upper one."""

    def __init__(self, upper: np.ndarray, lower: np.ndarray) -> None:
        self.upper, self.lower = upper, lower
        #: Each id's first slot and number of slots under its upper byte, and the lower byte of each slot.
        self.slots = _pairs((np.cumsum(lower, axis=1) - lower).reshape(-1), lower.reshape(-1))
        self.symbol = np.repeat(np.tile(np.arange(256, dtype=np.uint8), 256), lower.reshape(-1))

    @classmethod
    def of(cls, ids: np.ndarray) -> Prior:
        counts = np.bincount(ids, minlength=65536).reshape(256, 256)
        return cls(_shares(counts.sum(axis=1)[None])[0], _shares(counts))

    def to_bytes(self) -> bytes:
        return zlib.compress(np.concatenate([self.upper, self.lower.reshape(-1)]).astype("<u2").tobytes(), 6)

    @classmethod
    def from_bytes(cls, data: bytes) -> Prior:
        found = np.frombuffer(zlib.decompress(data), "<u2").astype(np.int64)
        return cls(found[:256], found[256:].reshape(256, 256))


class _Model:
    """The models of some blocks, each with STRIPES lanes."""

    def __init__(self, blocks: int, prior: Prior, decodes: bool = False) -> None:
        self.blocks, self.lanes, self.decodes = blocks, blocks * STRIPES, decodes
        block = np.arange(self.lanes, dtype=np.int64) // STRIPES
        self.base = np.stack([block * _PLACES, block * _PLACES + (1 << _ORDER1)])
        # Guess in the lower 16 bits, confidence 0 to 3 above.
        self.table = np.zeros(blocks * _PLACES, np.int32)
        self.at = np.empty((2, self.lanes), np.int64)
        self.hash = self.before = np.full(self.lanes, _HASH[0])
        self.hit = np.empty((2, self.lanes), bool)
        self.seen = np.tile(1 + prior.upper * _START // _SLOTS, (blocks, 1)).astype(np.int32)
        self.tried = np.zeros((blocks * 16, 4), np.int64)
        self.base_c, self.base_n, self.base_u = block << 4, block << 8, block << _SLOT_BITS
        self.renew(np.empty((0, self.lanes), np.uint16))

    def renew(self, ids: np.ndarray) -> None:
        """Take the ids (steps, lanes) coded since the last time into the order-0 distribution, and their hits into the weights."""
        self.seen += _SEEN * np.bincount(((ids >> 8) + self.base_n).reshape(-1), minlength=self.blocks << 8).reshape(self.blocks, 256).astype(np.int32)
        total = np.cumsum(self.seen, axis=1, dtype=np.int64)
        bounds = np.zeros((self.blocks, 257), np.int64)
        bounds[:, 1:] = total * (_SLOTS - 256) // total[:, -1:] + np.arange(1, 257)
        wide = np.diff(bounds, axis=1)
        #: Each upper byte's first slot and number of slots, and the upper byte of each slot.
        self.slots = _pairs(bounds[:, :-1], wide).ravel()
        if self.decodes:
            self.symbol = np.repeat(np.tile(np.arange(256, dtype=np.uint8), self.blocks), wide.ravel())
        if len(ids):
            self.tried += np.bincount(np.concatenate(self.outcomes), minlength=self.blocks << 6).reshape(-1, 4)
        self.outcomes = []
        miss, only1, hit2, hit21 = self.tried.T
        hit2, n = (hit2 + hit21).reshape(-1, 16), self.tried.sum(axis=1).reshape(-1, 16)
        p2 = ((hit2 * 100 + _RIGHT2 * _TRIES) << _WEIGHT_BITS) // ((n + _TRIES) * 100)
        p1 = ((only1.reshape(-1, 16) * 100 + _RIGHT1 * _TRIES) << _WEIGHT_BITS) // ((n - hit2 + _TRIES) * 100)
        f2 = (p2 * 7 >> 3) + 32
        self.weights = _pairs(f2, f2 + 32 + ((61000 - f2) * p1 >> _WEIGHT_BITS)).ravel()

    def predict(self) -> None:
        """Guesses and their weights: the part below f2 is order 2's, that below f21 order 1's, the rest order 0's."""
        np.bitwise_and(self.hash, 0xFFFF, out=self.at[0])
        np.bitwise_xor(self.hash >> 16, self.before >> 32, out=self.at[1])
        self.at[1] &= 0xFFFF
        self.at += self.base
        self.entry = self.table.take(self.at)
        self.guess1, self.guess2 = self.entry & 0xFFFF
        sure1, sure2 = self.entry >> 16
        self.context = self.base_c + ((sure2 << 2) + sure1)
        both = self.weights.take(self.context)
        self.f2, self.f21 = both & _LOW, both >> _WORD

    def update(self, ids: np.ndarray) -> None:
        hit = self.hit
        np.equal(self.guess1, ids, out=hit[0])
        np.equal(self.guess2, ids, out=hit[1])
        self.outcomes.append((self.context << 2) + (hit[0] + 2 * hit[1].view(np.int8)))
        # One more confidence or one less; no more than 3, and below 0 the id takes the place.
        new = hit.astype(np.int32)
        new <<= 17
        new += self.entry - (1 << 16)
        new -= (new & (1 << 18)) >> 2
        new ^= (new ^ ids.astype(np.int32)) & (new >> 31)
        # One stripe after the other: where two of a block learn at one place, the later one counts.
        for s in range(STRIPES):
            self.table[self.at[:, s::STRIPES]] = new[:, s::STRIPES]
        self.before, self.hash = self.hash, _HASH.take(ids)


def _stripes(n: int) -> list[int]:
    """How many of a block's ids each stripe has."""
    return [(n + STRIPES - 1 - s) // STRIPES for s in range(STRIPES)]


def encode_blocks(ids: np.ndarray, prior: Prior, block: int = BLOCK) -> list[bytes]:
    """The coded bytes of each block of ``ids`` (each under 65536)."""
    n = len(ids)
    whole, rest = divmod(n, block)
    sizes = _stripes(block) * whole + (_stripes(rest) if rest else [])
    lanes, steps = len(sizes), max(sizes, default=0)
    if not lanes:
        return []
    grid, ends = np.zeros((lanes, steps), np.uint16), np.cumsum(sizes)
    for lane, (size, end) in enumerate(zip(sizes, ends.tolist(), strict=True)):
        grid[lane, :size] = ids[end - size : end]
    grid = np.ascontiguousarray(grid.T)
    model = _Model(lanes // STRIPES, prior)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0), np.uint64)
    # The first word takes the carry of what has no word before it, and is always 0.
    words, used = np.zeros((lanes, steps + 8), np.uint32), np.ones(lanes, np.int64)
    flat_words, base_w = words.reshape(-1), np.arange(lanes, dtype=np.int64) * words.shape[1]

    coded: list[bytes] = [b""] * lanes
    short, renewed = range(whole * STRIPES, lanes), 0
    for t in range(steps):
        for lane in short:
            if sizes[lane] == t > 0:
                coded[lane] = _tail(low[lane], words[lane], used[lane])
        if t in _RENEW:
            model.renew(grid[renewed:t])
            renewed = t
        model.predict()
        now = grid[t].astype(np.int64)
        upper, lower = model.slots.take(model.base_n + (now >> 8)), prior.slots.take(now)
        by_order = span >> _WEIGHT_SHIFT
        start = by_order * model.f21
        by_upper = ((by_order << _WEIGHT_SHIFT) - start) >> _SLOT_SHIFT
        start += by_upper * (upper & _LOW)
        by_lower = by_upper * (upper >> _WORD) >> _SLOT_SHIFT
        start += by_lower * (lower & _LOW)
        span = by_lower * (lower >> _WORD)
        model.update(now)
        hits = np.flatnonzero(model.hit[0] | model.hit[1])
        hit2, by_order = model.hit[1][hits], by_order[hits]
        f2 = by_order * model.f2[hits]
        start[hits] = np.where(hit2, 0, f2)
        span[hits] = np.where(hit2, f2, by_order * model.f21[hits] - f2)
        start += low
        over = np.flatnonzero(start < low)
        if len(over):
            _carry(flat_words, base_w[over] + used[over] - 1)
        low = start
        ready = np.flatnonzero(span < _LEAST)
        out, at = low[ready], used[ready]
        flat_words[base_w[ready] + at] = out >> _WORD
        used[ready] = at + 1
        low[ready], span[ready] = out << _WORD, span[ready] << _WORD
    for lane in range(lanes):
        if sizes[lane] == steps:
            coded[lane] = _tail(low[lane], words[lane], used[lane])
    return [_joined(coded[k : k + STRIPES]) for k in range(0, lanes, STRIPES)]


def _carry(words: np.ndarray, at: np.ndarray) -> None:
    """Add one to the number that ends with each of these words."""
    while len(at):
        words[at] += np.uint32(1)
        at = at[words[at] == 0] - 1


def _tail(low: np.uint64, words: np.ndarray, used: np.int64) -> bytes:
    """A stripe's words so far and one more: the range holds a number that ends there."""
    last = int(low) + (1 << 32) - 1 >> 32
    words = words[: used + 1].copy()
    if last >> 32:
        _carry(words, np.array([used - 1]))
    words[used] = last & 0xFFFFFFFF
    return words[1:].astype("<u4").tobytes()


def _joined(stripes: list[bytes]) -> bytes:
    return b"".join([np.array([len(s) // 4 for s in stripes], "<u2").tobytes(), *stripes])


def decode_blocks(coded: list[bytes], sizes: list[int], prior: Prior) -> np.ndarray:
    """The ids of blocks, in order; ``sizes``: ids of each."""
    own = [s for n in sizes for s in _stripes(n)]
    lanes, steps = len(own), max(own, default=0)
    if not steps:
        return np.empty(0, np.uint16)
    lengths = np.array([np.frombuffer(c, "<u2", STRIPES) for c in coded], np.int64)
    words = np.zeros((lanes, int(lengths.max()) + 8), np.uint32)
    for k, c in enumerate(coded):
        at = 2 * STRIPES
        for s, n in enumerate(lengths[k].tolist()):
            words[k * STRIPES + s, :n] = np.frombuffer(c, "<u4", n, at)
            at += 4 * n
    flat, base, end = words.reshape(-1), np.arange(lanes, dtype=np.int64) * words.shape[1], words.shape[1] - 1
    model = _Model(len(coded), prior, decodes=True)
    # How far the number lies above the low end of the range.
    code, span = (words[:, 0].astype(np.uint64) << _WORD) | words[:, 1], np.full(lanes, ~np.uint64(0), np.uint64)
    used = np.full(lanes, 2, np.int64)
    out, renewed = np.zeros((steps, lanes), np.uint16), 0

    for t in range(steps):
        if t in _RENEW:
            model.renew(out[renewed:t])
            renewed = t
        model.predict()
        by_order = span >> _WEIGHT_SHIFT
        f21 = by_order * model.f21
        hits = np.flatnonzero(code < f21)
        by_upper = ((by_order << _WEIGHT_SHIFT) - f21) >> _SLOT_SHIFT
        left = code - f21
        # Hits, and lanes that have ended and go on over zeros, may find a slot beyond the last; what they find is not used.
        slot = np.minimum(left // by_upper, _LAST_SLOT).view(np.int64)
        upper = model.symbol.take(model.base_u + slot).astype(np.int64)
        slots = model.slots.take(model.base_n + upper)
        left -= by_upper * (slots & _LOW)
        by_lower = by_upper * (slots >> _WORD) >> _SLOT_SHIFT
        slot = np.minimum(left // by_lower, _LAST_SLOT).view(np.int64)
        ids = (upper << 8) + prior.symbol.take((upper << _SLOT_BITS) + slot)
        slots = prior.slots.take(ids)
        left -= by_lower * (slots & _LOW)
        span = by_lower * (slots >> _WORD)
        own_code, f21, f2 = code[hits], f21[hits], by_order[hits] * model.f2[hits]
        is2 = own_code < f2
        left[hits] = np.where(is2, own_code, own_code - f2)
        span[hits] = np.where(is2, f2, f21 - f2)
        ids[hits] = np.where(is2, model.guess2[hits], model.guess1[hits])
        code = left
        ready = np.flatnonzero(span < _LEAST)
        at = used[ready]
        code[ready] = (code[ready] << _WORD) | flat[base[ready] + np.minimum(at, end)]
        span[ready] <<= _WORD
        used[ready] = at + 1
        out[t] = ids
        model.update(ids)
    whole = np.ascontiguousarray(out.T)
    return np.concatenate([whole[k, :s] for k, s in enumerate(own)])


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
