"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks. Every block starts from the same state, has its own byte string and the crc32 of its ids, so it can be
decoded alone. Within a block each id is coded with a mixture of three predictions: the id that followed the last two ids
(order 2), the id that followed the last one (order 1), and the id frequencies of the segment (order 0, in its header). That
first state has each context's most frequent successor in the segment, from the header as well; from there a block's contexts
learn its own. Each context keeps how often its guess held, in four levels. The mixture's weights adapt to the levels of both
orders and to the place in the block: the header has those that fit the segment's blocks best, for every ``SPAN`` ids or more.

All blocks of a segment are coded side by side: a step codes one id of every block with array operations.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"FRT5"
BLOCK = 2048
SLOTS = 512  # contexts a block remembers; four times as many save half a byte in a hundred and miss the processor's caches
WEIGHT = 12  # bits of the mixture's weights
SPAN, SHARING = 64, 1 << 15  # at least so many ids of a block, and of all blocks, share weights
_LOW32 = np.uint64((1 << 32) - 1)
_WEIGHT, _WORD = np.uint64(WEIGHT), np.uint64(32)
_ONE, _TWO = np.int32(40503), np.int32(30011)  # of the hashes of contexts


def _frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Positive integers in proportion to the counts that sum to 2**bits."""
    total = 1 << bits
    freq = 1 + (counts * (total - len(counts)) // counts.sum())
    freq[np.argmax(freq)] += total - freq.sum()
    return freq


def _symbols(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids, each id's place among them, and how often each comes."""
    if int(ids.max()) >= 1 << 20:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int32)
    place[symbols] = np.arange(len(symbols))
    return symbols, place.take(ids), counts[symbols]


def _successors(syms: np.ndarray, n: int) -> np.ndarray:
    """For each order and slot the most frequent symbol after the slot's contexts (the larger of equals), ``n`` after none."""
    h1 = syms[:-1] * _ONE
    best = np.full((2, SLOTS), n, np.int64)
    wide = np.uint64 if n > 1 << 23 else np.uint32  # slot and symbol side by side
    bits = wide(n.bit_length())
    for order, slot in enumerate((h1 >> 4, h1[1:] + syms[:-2] * _TWO >> 4)):
        pairs = np.sort((slot & SLOTS - 1).astype(wide) << bits | syms[order + 1 :].astype(wide))
        if not len(pairs):
            continue
        begin = np.append(0, np.flatnonzero(pairs[1:] != pairs[:-1]) + 1)
        pairs, counts = pairs[begin].astype(np.int64), np.diff(begin, append=len(pairs))
        slot, sym = pairs >> int(bits), pairs & (1 << int(bits)) - 1
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        best[order, slot[first]] = np.maximum.reduceat(counts << 32 | sym, first) & 0xFFFFFFFF
    return best


class _Model:
    """Contexts of all blocks of a segment; ``n`` symbols. A slot holds its guess and, in two bits, its level."""

    def __init__(self, blocks: int, n: int, first: np.ndarray):
        """``first`` has the guesses that all blocks begin with, a row for each order; ``n`` where there is none."""
        self.kind = np.uint16 if n < 1 << 14 else np.uint32  # the smaller, the more of the slots stay in the caches
        self.slots = np.repeat(first.astype(self.kind) << 2, blocks, axis=0).reshape(-1)
        self.base = np.arange(2 * blocks, dtype=np.int32).reshape(2, blocks) * SLOTS
        self.p1 = np.full(blocks, n, np.int32)
        self.h2 = np.zeros(blocks, np.int32)
        self.places = np.empty((2, blocks), np.int32)

    def guess(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The guesses of orders 1 and 2 for the first ``m`` blocks, and their levels."""
        at = self.places[:, :m]
        np.multiply(self.p1[:m], _ONE, out=at[0])
        np.add(at[0], self.h2[:m], out=at[1])
        at >>= 4
        at &= SLOTS - 1
        at += self.base[:, :m]
        np.multiply(self.p1[:m], _TWO, out=self.h2[:m])
        self.at = at.astype(np.intp)
        self.value = self.slots.take(self.at)
        self.level = self.value & 3
        return self.value >> 2, self.level

    def learn(self, m: int, sym: np.ndarray, hit: np.ndarray) -> None:
        # Without branches: one up or one down, or at level 0 the symbol in place of the guess.
        change = (self.level < 3) & hit
        fresh = (self.level == 0) > hit
        value = (sym << 2) - self.value
        value *= fresh
        value += self.value
        value += change
        value -= (self.level > 0) > hit
        self.slots[self.at] = value
        self.p1[:m] = sym


def _weights(seen: np.ndarray, bits: int) -> np.ndarray:
    """For each span and pair of levels: where the part of order 2 ends and where that of order 1 does, of 4096.

    ``seen`` counts, for each span and pair of levels, the ids by what guessed them: neither, order 1, or order 2.
    """
    # What a pair of levels did in the whole segment counts as some ids of every span.
    whole = seen.sum(axis=0, keepdims=True) + [1.0, 0.5, 0.5]
    seen = seen + 64 * whole / whole.sum(axis=2, keepdims=True)
    share = seen / seen.sum(axis=2, keepdims=True)
    most = (1 << WEIGHT) - _least(bits)
    end1 = np.clip(np.rint((share[..., 1] + share[..., 2]) * (1 << WEIGHT)), 2, most)
    end2 = np.clip(np.rint(share[..., 2] * (1 << WEIGHT)), 1, end1 - 1)
    return np.stack([end2, end1], axis=2).astype(np.int64)


def _least(bits: int) -> int:
    """What order 0 keeps of 4096 at least, so that the range holds all frequencies."""
    return 1 << bits - 16


def _span(blocks: int) -> int:
    """Ids of a block that share weights: few blocks share them longer, as the weights take space as well."""
    span = SPAN
    while span < BLOCK and span * blocks < SHARING:
        span *= 2
    return span


def _parts(end2: np.ndarray, end1: np.ndarray) -> np.ndarray:
    """Begin and size among the weights by case: 16 times what guessed the id, and the pair of levels."""
    return np.concatenate([[end1, np.uint64(1 << WEIGHT) - end1], [end2, end1 - end2], [0 * end2, end2]], axis=1)


def _places(freq: np.ndarray) -> np.ndarray:
    """Begin, in the upper half, and size of each symbol among the frequencies; before all of them a place for what was guessed."""
    return np.append(1, np.cumsum(freq) - freq << 32 | freq).astype(np.uint64)


def encode(ids: np.ndarray) -> bytes:
    """A segment: header, symbols with frequencies, block table, first guesses, weights, blocks. ``ids`` are uint32, any number of them."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return MAGIC + struct.pack("<IIBI", 0, 0, 0, 0)
    symbols, seq, counts = _symbols(ids)
    bits = max(16, len(symbols).bit_length() + 2)
    freq = _frequencies(counts, bits)
    both = _places(freq)
    steps = min(n, BLOCK)
    last = n - (blocks - 1) * BLOCK
    width = [blocks if k < last else blocks - 1 for k in range(steps)]
    first = _successors(seq.astype(np.int32, copy=False), len(symbols))

    # What guesses each id, and at which levels: the coder needs both for the weights.
    model = _Model(blocks, len(symbols), first)
    step_syms = np.zeros(blocks * BLOCK, model.kind)
    step_syms[:n] = seq
    step_syms = np.ascontiguousarray(step_syms.reshape(blocks, BLOCK).T)
    cases = np.zeros((steps, blocks), np.uint8)
    span = _span(blocks)
    seen = np.empty((-(-steps // span), 16, 3))
    for k, m in enumerate(width):
        sym = step_syms[k, :m]
        guesses, levels = model.guess(m)
        hit = guesses == sym
        kind = hit.view(np.uint8)
        cases[k, :m] = (levels[1] << 2) + levels[0]
        cases[k, :m] += np.maximum(kind[1] << 5, kind[0] << 4)
        model.learn(m, sym, hit)
    for k in range(len(seen)):
        some = cases[k * span : (k + 1) * span]
        seen[k] = np.bincount(np.concatenate([c[:m] for c, m in zip(some, width[k * span :])]), minlength=48).reshape(3, 16).T
    weights = _weights(seen, bits)

    low, rng = np.zeros(blocks, np.uint64), np.full(blocks, (1 << 64) - 1, np.uint64)
    pos = np.zeros(blocks, np.int64)
    words, lanes, carries = [], [], []
    every = np.arange(blocks)
    for k, m in enumerate(width):
        if k % SPAN == 0:
            end2, end1 = weights[k // span].T.astype(np.uint64)
            table = _parts(end2, end1)
            some = cases[k : k + SPAN].astype(np.intp)
            begin, part = table[0].take(some), table[1].take(some)
            alone = some < 16
            own = both.take((step_syms[k : k + len(some)].astype(np.intp) + 1) * alone)
            start, size, shift = own >> _WORD, own & _LOW32, alone * np.uint64(bits)
        j = k % SPAN
        lo, r = low[:m], rng[:m]
        r >>= _WEIGHT
        more = r * begin[j, :m]
        r *= part[j, :m]
        r >>= shift[j, :m]
        more += r * start[j, :m]
        r *= size[j, :m]
        lo += more
        carry = lo < more
        if carry.any():  # into the words that are out
            at = np.flatnonzero(carry)
            carries.append((at, pos[at] - 1))
        go = r <= _LOW32  # the range got small: a word is due
        at = np.flatnonzero(go)
        words.append((lo.take(at) >> _WORD).astype(np.uint32))
        lanes.append(at)
        pos[:m] += go
        move = go * _WORD
        lo <<= move
        r <<= move
    for _ in range(2):
        words.append((low >> _WORD).astype(np.uint32))
        lanes.append(every)
        low <<= _WORD
        pos += 1
    lane = np.concatenate(lanes)
    order = np.argsort(lane.astype(np.uint16) if blocks < 1 << 16 else lane, kind="stable")
    out = np.concatenate(words)[order].astype(np.uint64)
    at = np.concatenate([(np.cumsum(pos) - pos)[a] + p for a, p in carries] or [every[:0]])
    while len(at):
        np.add.at(out, at, np.uint64(1))
        at = np.unique(at)
        over = out[at] >> _WORD > 0
        out[at] &= _LOW32
        at = at[over] - 1
    crcs = np.array([zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) for b in range(blocks)], "<u4")
    head = MAGIC + struct.pack("<IIBI", n, blocks, bits, len(symbols))
    tables = [x.astype("<u4").tobytes() for x in (symbols, freq, pos, crcs, first)]
    return b"".join([head, *tables, weights.astype("<u2").tobytes(), out.astype("<u4").tobytes()])


def decode(data: bytes) -> np.ndarray:
    """The ids of a segment, as uint32. A damaged block raises ValueError."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    n, blocks, bits, many = struct.unpack_from("<IIBI", data, 4)
    if not n:
        return np.empty(0, np.uint32)
    at = 4 + struct.calcsize("<IIBI")
    parts = []
    for count in (many, many, blocks, blocks, 2 * SLOTS):
        parts.append(np.frombuffer(data, "<u4", count, at))
        at += 4 * count
    symbols, freq, size, crcs = parts[0], parts[1].astype(np.int64), parts[2].astype(np.int64), parts[3]
    steps = min(n, BLOCK)
    span = _span(blocks)
    weights = np.frombuffer(data, "<u2", -(-steps // span) * 32, at).reshape(-1, 16, 2)
    at += weights.nbytes
    both = _places(freq)
    stream = np.concatenate([np.frombuffer(data, "<u4", int(size.sum()), at), np.zeros(8, "<u4")]).astype(np.uint64)
    pos = np.cumsum(size) - size
    last = n - (blocks - 1) * BLOCK
    model = _Model(blocks, many, np.minimum(parts[4].reshape(2, SLOTS), many))
    by_slot = np.repeat(np.arange(1, many + 1, dtype=model.kind), freq)
    # The code's distance from low, and the range.
    code, rng = stream[pos] << _WORD | stream[pos + 1], np.full(blocks, (1 << 64) - 1, np.uint64)
    pos += 2
    slots = np.uint64(len(by_slot) - 1)
    found = np.zeros((BLOCK, blocks), model.kind)
    for k in range(steps):
        m = blocks if k < last else blocks - 1
        if k % span == 0:
            end2, end1 = weights[k // span].T.astype(np.uint64)
            begin, part = _parts(end2, end1)
        guesses, levels = model.guess(m)
        case = ((levels[1] << 2) + levels[0]).astype(np.intp)
        c, r = code[:m], rng[:m]
        r >>= _WEIGHT
        hit2, alone = c < r * end2.take(case), c >= r * end1.take(case)
        hit1 = ~(hit2 | alone)
        case += hit2 * 32
        case += hit1 * 16
        c -= r * begin.take(case)
        r *= part.take(case)
        r >>= alone * np.uint64(bits)
        place = by_slot.take(np.minimum(c // r, slots).view(np.int64))  # only a damaged block is beyond
        place *= alone
        own = both.take(place)
        c -= r * (own >> _WORD)
        r *= own & _LOW32
        sym = place - alone
        sym += guesses[1] * hit2
        sym += guesses[0] * hit1
        go = r <= _LOW32
        at = np.flatnonzero(go)
        move = go * _WORD
        c <<= move
        r <<= move
        c[at] |= stream.take(pos[at], mode="clip")
        pos[:m] += go
        model.learn(m, sym, guesses == sym)
        found[k, :m] = sym
    ids = symbols.take(found.T.reshape(-1)[:n], mode="clip").astype(np.uint32)
    for b in range(blocks):
        if zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].astype("<u4").tobytes()) != crcs[b]:
            raise ValueError(f"block {b} is damaged")
    return ids
