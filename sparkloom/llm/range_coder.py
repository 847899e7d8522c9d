"""Adaptive context-mixing range coder for token ids, in independently reset and checksummed blocks that numpy codes side by side.

A frame holds the ids of whole documents, cut into blocks of near equal length. Each block starts from the same state
and carries the crc32 of its ids. The id to come is predicted from the two ids before it (order 2) and from the one
before it (order 1), both by the id that last followed there in this block, and by frequencies (order 0), of which the
frame has a table for each class of ids before. The range is split between the three: order 2 gets as much as its
predictions with as many successes in a row came true so far, in the frame as a whole and then in this block; order 1
its share of what is left; order 0 the rest.

When a frame is written all its ids are known, so contexts, predictions and rates come from stable sorts and running
sums, and only the arithmetic goes id by id. A reader follows the same rules id by id.

    frame  = magic "SLF3", ids u4, blocks u4, size of alphabet u4, classes u4, bytes of tables u4, tables (deflated),
             16-bit words in each block u4 each, crc32 of each block u4 each, the blocks' words u2 each, crc32 of all before u4
    tables = alphabet u4 each, class of each id u1 each, level of each id in each class u1 each, 16 rates u2 each
"""

from __future__ import annotations

import struct
import zlib
from zlib import crc32

import numpy as np

MAGIC = b"SLF3"
#: Ids in a block about; shortest blocks of a small frame; blocks of one; ids from which on a frame has one more doubling of classes, most doublings; pairs that classes are made from; blocks that are modelled at once.
BLOCK_IDS, SHORT_IDS, BLOCKS, CLASS_IDS, DOUBLINGS, CLASS_PAIRS, TOGETHER = 1024, 512, 64, 1 << 15, 4, 1 << 18, 96
#: Bits of the split range, of a rate, of the slots of orders 1 and 2; steps between two renewals of the rates; weight of the frame's rates; levels in an octave of frequency.
SCALE, RATE, BITS1, BITS2, RENEW, PRIOR, OCTAVE = 30, 12, 8, 10, 96, 64, 8
#: Ids below this are counted in a table. A prediction's state: 0 for none, else successes in a row, from 1 on, below this.
TABLE, STATES = 1 << 22, 8
#: A block's range stays in 36 to 52 bits, so that quotients of it are exact in floating point.
BOTTOM, WORD, WHOLE = 1 << 36, 16, 1 << 52
U32 = np.uint32


class _Tables:
    """What the blocks of a frame share: for each class of the id before the share of each id, in parts of 2**bits; the rates to start with."""

    def __init__(self, classes: np.ndarray, levels: np.ndarray, rates: np.ndarray):
        self.classes, self.count, self.size = classes, len(levels), levels.shape[1]
        self.bits = max(16, self.size.bit_length() + 1)
        steps = np.array([int(256 * 2 ** (k / OCTAVE)) for k in range(OCTAVE)], np.int64)
        level = np.maximum(levels.astype(np.int64) - 1, 0)
        some = levels > 0
        often = np.where(some, steps[level % OCTAVE] << (level // OCTAVE), 0)
        room = (1 << self.bits) - some.sum(axis=1, keepdims=True)  # one for each id, the rest by frequency
        ends = np.cumsum(often, axis=1)
        ends = ends * room // np.maximum(ends[:, -1:], 1) + np.cumsum(some, axis=1)
        ends[:, -1] = 1 << self.bits  # belongs to the last id, which takes what rounding left
        low = np.concatenate([np.zeros((self.count, 1), np.int64), ends[:, :-1]], axis=1)
        self.low, self.width = low.reshape(-1), (ends - low).reshape(-1)
        self.most = (1 << RATE) - (1 << RATE >> (SCALE - self.bits) // 2)  # order 0 keeps a part of the range
        self.rates = np.minimum(rates.astype(np.int64).reshape(2, STATES), self.most)

    def owner(self) -> np.ndarray:
        """The id at each place of each class's table."""
        return np.repeat(np.tile(np.arange(self.size), self.count), self.width).astype(np.int32)

    def renewed(self, seen: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Rates of both orders from how often each state was seen and right; the state without a prediction has none."""
        rates = np.clip((hits * (1 << RATE) + self.rates * PRIOR) // (seen + PRIOR), 4, self.most)
        rates[..., 0] = 0
        return rates


def _slots(before1: np.ndarray, before2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of order 1 and order 2, from the ids before (as places in the alphabet, plus one; unsigned)."""
    mixed = before1 * U32(2654435761)
    return mixed >> U32(32 - BITS1), ((before2 ^ (mixed >> U32(9))) * U32(2246822519)) >> U32(32 - BITS2)


def _layout(n: int) -> tuple[int, int, np.ndarray]:
    """(ids of a block, blocks that have one more, where each block starts) of a frame of n ids."""
    blocks = max(1, n // BLOCK_IDS, min(BLOCKS, n // SHORT_IDS))
    each, more = n // blocks, n % blocks
    return each, more, np.arange(blocks) * each + np.minimum(np.arange(blocks), more)


def _sums(ids: np.ndarray, starts: np.ndarray) -> list[int]:
    """crc32 of each block."""
    data = memoryview(ids.astype("<u4").tobytes())
    return [crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True)]


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, place of each id among them)."""
    if ids.max() >= TABLE:
        return np.unique(ids, return_inverse=True)
    alphabet = np.flatnonzero(np.bincount(ids))
    place = np.zeros(int(alphabet[-1]) + 1, np.int32)
    place[alphabet] = np.arange(len(alphabet))
    return alphabet, place[ids]


def _predictions(symbols: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What one order predicts at each place of each block (rows; -1: nothing), and its state."""
    order = np.argsort(slots.astype(np.uint16), axis=1, kind="stable")
    slot, after = np.take_along_axis(slots, order, 1), np.take_along_axis(symbols, order, 1)
    guess = np.full(after.shape, -1, np.int32)
    guess[:, 1:] = np.where(slot[:, 1:] == slot[:, :-1], after[:, :-1], -1)
    known = guess >= 0
    run = known.copy()
    run[:, 1:] &= (guess == after)[:, :-1]
    run[:, 0] = False
    state = known.astype(np.int8)
    for _ in range(STATES - 2):
        state += run
        run[:, 1:] &= run[:, :-1].copy()
    out, states = np.empty_like(guess), np.empty_like(state)
    np.put_along_axis(out, order, guess, 1)
    np.put_along_axis(states, order, state, 1)
    return out, states


def _classed(before: np.ndarray, after: np.ndarray, size: int, doublings: int) -> np.ndarray:
    """Classes of ids such that what follows them is alike: parted in two, and again, by the likelihood of what follows.

    Made from about CLASS_PAIRS pairs, evenly spread; the tables of the classes count all.
    """
    if not len(before):
        return np.zeros(size, np.int64)
    every = -(-len(before) // CLASS_PAIRS)
    pair, often = np.unique(before[::every].astype(np.int64) * size + after[::every], return_counts=True)
    first, second = pair // size, pair % size
    general = np.bincount(second, often, size) + 0.5
    general /= general.sum()
    classes = np.zeros(size, np.int64)
    for d in range(doublings):
        # The new bit starts from a rule of chance and settles in a few rounds.
        bit = (np.arange(size, dtype=np.int64) * 2654435761 >> 13 + d) & 1
        classes = classes * 2 + bit
        for _ in range(5):
            counts = np.bincount(classes[first] * size + second, often, (2 << d) * size).reshape(-1, size) + 30 * general
            logs = np.log(counts / counts.sum(axis=1, keepdims=True))
            gain = np.stack([np.bincount(first, often * logs[c][second], size) for c in range(2 << d)])
            classes = gain.argmax(axis=0)
    return classes


def encode(ids: np.ndarray) -> bytes:
    """A frame of ids (any integers from 0 to 2**32 - 1)."""
    ids = np.asarray(ids, np.int64)
    n = len(ids)
    if not n:
        body = MAGIC + struct.pack("<IIIII", 0, 0, 0, 0, 0)
        return body + struct.pack("<I", crc32(body))
    alphabet, symbols = _alphabet(ids)
    each, more, starts = _layout(n)
    tables, data, los, widths = _modelled(symbols.astype(np.int32), starts, each, more, len(alphabet))
    words, sizes = _coded(los, widths, each, more)
    packed = zlib.compress(alphabet.astype("<u4").tobytes() + data, 6)
    head = MAGIC + struct.pack("<IIIII", n, len(starts), len(alphabet), tables.count, len(packed)) + packed
    body = head + sizes.astype("<u4").tobytes() + np.array(_sums(ids, starts), "<u4").tobytes() + words
    return body + struct.pack("<I", crc32(body))


def _modelled(symbols: np.ndarray, starts: np.ndarray, each: int, more: int, size: int) -> tuple[_Tables, bytes, np.ndarray, np.ndarray]:
    """The frame's tables, as bytes too, and start and width in the split range of each id: a row for each step, a column for each block."""
    steps, blocks = each + (more > 0), len(starts)
    group = np.arange(steps, dtype=np.int32) // RENEW
    groups = int(group[-1]) + 1
    grid = symbols[np.minimum(starts[:, None] + np.arange(steps), len(symbols) - 1)]
    before1 = np.zeros((blocks, steps), U32)
    before1[:, 1:] = grid[:, :-1] + 1
    # State of order 1 * 4 + whether order 1 is right * 2 + whether order 2 is right; the same for order 2.
    found1, found2 = np.empty(grid.shape, np.uint8), np.empty(grid.shape, np.uint8)
    seen, hits = np.empty((2, blocks, groups, 2, STATES), np.int64)
    pairs = []
    for lo in range(0, blocks, TOGETHER):  # few blocks at once stay in the processor's cache
        part = slice(lo, min(lo + TOGETHER, blocks))
        now, before = grid[part], before1[part]
        before2 = np.zeros_like(before)
        before2[:, 1:] = before[:, :-1]
        slots1, slots2 = _slots(before, before2)
        guess1, state1 = _predictions(now, slots1)
        guess2, state2 = _predictions(now, slots2)
        state1[guess1 == guess2] = 0
        real = np.arange(steps) < each + (np.arange(part.start, part.stop)[:, None] < more)
        state1[~real] = state2[~real] = 0
        hit2 = guess2 == now
        hit1 = (guess1 == now) & (state1 > 0) & ~hit2
        found1[part], found2[part] = state1 * np.uint8(4) + hit1 * np.uint8(2) + hit2, state2 * np.uint8(4) + hit2 * np.uint8(3)
        missed = real & ~hit1 & ~hit2  # order 0 only sees what the others did not predict
        pairs.append((before[missed], now[missed]))
        # How often each state was seen, and right, up to each renewal; order 1 has its chance where order 2 isn't right.
        key = (np.arange(len(now), dtype=np.int32)[:, None] * groups + group) * (4 * STATES)
        tally1, tally2 = (np.bincount((key + f).reshape(-1), minlength=len(now) * groups * STATES * 4).reshape(len(now), groups, STATES, 4) for f in (found1[part], found2[part]))
        seen[part] = np.stack([tally1[..., 0] + tally1[..., 2], tally2[..., 0] + tally2[..., 3]], axis=2)
        hits[part] = np.stack([tally1[..., 2], tally2[..., 3]], axis=2)
    rates = (hits.sum(axis=(0, 1)) << RATE) // np.maximum(seen.sum(axis=(0, 1)), 1)
    before, after = (np.concatenate(x) for x in zip(*pairs, strict=True))
    doublings = int(np.clip((len(symbols) // CLASS_IDS).bit_length(), 0, DOUBLINGS))
    classes = np.r_[0, _classed(before[before > 0] - 1, after[before > 0], size, doublings)]
    often = np.bincount(classes.take(before) * size + after, minlength=size << doublings).reshape(-1, size)
    levels = np.where(often > 0, np.round(np.log2(np.maximum(often, 1)) * OCTAVE) + 1, 0).astype(np.uint8)
    tables = _Tables(classes, levels, rates)
    data = classes[1:].astype(np.uint8).tobytes() + levels.tobytes() + tables.rates.astype("<u2").tobytes()

    renewed = tables.renewed(np.cumsum(seen, axis=1) - seen, np.cumsum(hits, axis=1) - hits).astype(np.int32)
    los, widths = np.empty((2, steps, blocks), np.int32)
    for lo in range(0, blocks, TOGETHER):
        part = slice(lo, lo + TOGETHER)
        code1, code2 = found1[part], found2[part]
        hit1, hit2 = code1 & 3 == 2, code2 & 3 == 3
        table = renewed[part].reshape(-1)
        row = (np.arange(len(code1), dtype=np.int32)[:, None] * groups + group) * (2 * STATES)
        part2 = table.take(row + ((code2 >> 2) + np.uint8(STATES))) << (SCALE - RATE)
        part1 = (((1 << SCALE) - part2) >> RATE) * table.take(row + (code1 >> 2))
        base = part1 + part2
        unit = ((1 << SCALE) - base) >> tables.bits
        at = classes.take(before1[part]) * size + grid[part]
        start, width = base + tables.low.take(at) * unit, tables.width.take(at) * unit
        np.copyto(start, part2, where=hit1)
        np.copyto(width, part1, where=hit1)
        np.copyto(start, 0, where=hit2)
        np.copyto(width, part2, where=hit2)
        los[:, part], widths[:, part] = start.T, width.T
    return tables, data, los, widths


def _coded(los: np.ndarray, widths: np.ndarray, each: int, more: int) -> tuple[bytes, np.ndarray]:
    """The blocks' words, and how many each has."""
    steps, lanes = los.shape
    low, span = np.zeros(lanes, np.int64), np.full(lanes, WHOLE - 1, np.int64)
    out = np.zeros((lanes, 2 * steps + 8), "<u2")
    flat, pos = out.reshape(-1), np.arange(lanes) * out.shape[1]
    begin = pos.copy()
    carries = np.zeros(out.size, bool)
    ended = low[:0], pos[:0]
    for t in range(steps):
        if t == each:  # the blocks that have one id more are the first
            ended = low[more:], pos[more:]
            low, span, pos = low[:more].copy(), span[:more].copy(), pos[:more].copy()
        unit = span >> SCALE
        low += unit * los[t, : len(unit)]
        span = unit * widths[t, : len(unit)]
        over = (low >= WHOLE).nonzero()[0]
        if len(over):  # one more for the word before
            carries[pos[over] - 1] = True
            low[over] -= WHOLE
        full = (span < BOTTOM).nonzero()[0]
        while len(full):
            was, at = low.take(full), pos.take(full)
            flat[at] = was >> (52 - WORD)
            pos[full] = at + 1
            low[full] = (was << WORD) & (WHOLE - 1)
            wide = span.take(full) << WORD
            span[full] = wide
            full = full[wide < BOTTOM]
    low, pos = np.r_[low, ended[0]], np.r_[pos, ended[1]]
    for shift in (36, 20, 4, 0):
        flat[pos] = (low >> shift) & 0xFFFF if shift else (low << 12) & 0xFFFF
        pos = pos + 1
    at = np.flatnonzero(carries)
    while len(at):  # a word that wraps hands its carry on
        flat[at] += np.uint16(1)
        at = at[flat[at] == 0] - 1
    sizes = pos - begin
    return b"".join([out[i, : sizes[i]].tobytes() for i in range(lanes)]), sizes


def decode(frame: bytes) -> np.ndarray:
    """The ids of a frame; ValueError if a checksum fails."""
    if frame[:4] != MAGIC or len(frame) < 28 or crc32(frame[:-4]) != struct.unpack("<I", frame[-4:])[0]:
        raise ValueError("not a frame, or a damaged one")
    n, blocks, size, count, packed = struct.unpack("<IIIII", frame[4:24])
    if not n:
        return np.empty(0, np.int64)
    data, at = zlib.decompress(frame[24 : 24 + packed]), 24 + packed
    alphabet = np.frombuffer(data, "<u4", size).astype(np.int64)
    classes = np.r_[0, np.frombuffer(data, np.uint8, size, 4 * size).astype(np.int64)]
    levels = np.frombuffer(data, np.uint8, size * count, 5 * size).reshape(count, size)
    rates = np.frombuffer(data, "<u2", 2 * STATES, (5 + count) * size)
    sizes, sums = np.frombuffer(frame, "<u4", blocks, at).astype(np.int64), np.frombuffer(frame, "<u4", blocks, at + 4 * blocks)
    words = np.frombuffer(frame[at + 8 * blocks : -4], "<u2").astype(np.int64)
    each, more, starts = _layout(n)
    ids = alphabet[_decoded(words, np.cumsum(sizes) - sizes, n, each, more, _Tables(classes, levels, rates))]
    for b, found in enumerate(_sums(ids, starts)):
        if found != sums[b]:
            raise ValueError(f"block {b} is damaged")
    return ids


def _decoded(words: np.ndarray, pos: np.ndarray, n: int, each: int, more: int, tables: _Tables) -> np.ndarray:
    lanes, steps, bits = len(pos), each + (more > 0), tables.bits
    span = np.full(lanes, WHOLE - 1, np.int64)
    code = (words[pos] << 36) | (words[pos + 1] << 20) | (words[pos + 2] << 4) | (words[pos + 3] >> 12)  # as seen from the start of the range
    half = words[pos + 3] & 0xFFF  # 12 bits read already, of the 16 that come next
    pos = pos + 4
    out = np.zeros((steps + 2, lanes), np.int32)  # places in the alphabet plus one, after two zeros
    # What followed a context last in its block, as (place + 1) * 8 + state; rows of two are orders 1 and 2.
    lane = np.arange(lanes)
    after = np.zeros((lanes << BITS1) + (lanes << BITS2), np.int32)
    offset = np.stack([lane << BITS1, (lanes << BITS1) + (lane << BITS2)])
    slots = np.empty((2, lanes), np.int64)
    seen, hits = np.zeros((2, lanes, 2, STATES), np.int64)
    states, rights = np.zeros((RENEW, 2, lanes), np.int8), np.zeros((RENEW, 2, lanes), bool)
    row, counting = lane * STATES * STATES, (lane[None, :] * 2 + np.array([[0], [1]])) * STATES
    owner, classes, low, width, size = tables.owner(), tables.classes, tables.low, tables.width, tables.size
    for t in range(steps):
        if t % RENEW == 0:
            if t:
                chance = np.stack([~rights[:, 1], np.ones_like(rights[:, 1])], axis=1)
                key = counting + states
                seen += np.bincount(key[chance], minlength=seen.size).reshape(seen.shape)
                hits += np.bincount(key[chance & rights], minlength=seen.size).reshape(seen.shape)
            rates = tables.renewed(seen, hits)
            part2s = np.repeat((rates[:, 1] << (SCALE - RATE))[:, :, None], STATES, axis=2)
            part1s = (((1 << SCALE) - part2s) >> RATE) * rates[:, 0, None, :]
            bases = part1s + part2s
            units = (((1 << SCALE) - bases) >> bits).reshape(-1)
            part2s, bases = part2s.reshape(-1), bases.reshape(-1)
        slots[0], slots[1] = _slots(out[t + 1].view(U32), out[t].view(U32))
        slots += offset
        had = after.take(slots)
        guess, state = had >> 3, had & 7
        guess1, guess2 = guess
        state[0] *= guess1 != guess2
        joint = (state[1] << 3) + row
        joint += state[0]
        part2, base, share = part2s.take(joint), bases.take(joint), units.take(joint)
        unit = span >> SCALE
        value = (code / unit).astype(np.int64)
        table = classes.take(out[t + 1])
        place = ((value - base) / share).astype(np.int64)
        place += table << bits
        symbol = owner.take(place, mode="clip")
        symbol += 1
        is2, is1 = value < part2, value < base
        np.putmask(symbol, is1, guess1)
        np.putmask(symbol, is2, guess2)
        out[t + 2] = symbol
        if t == each:
            break
        table *= size
        table += symbol
        table -= 1
        lo, wide = low.take(table), width.take(table)
        lo *= share
        lo += base
        wide *= share
        np.putmask(lo, is1, part2)
        base -= part2
        np.putmask(wide, is1, base)
        np.putmask(lo, is2, 0)
        np.putmask(wide, is2, part2)
        lo *= unit
        code -= lo
        span = unit * wide
        full = (span < BOTTOM).nonzero()[0]
        while len(full):
            at = pos.take(full)
            word = words.take(at, mode="clip")
            code[full] = (code.take(full) << WORD) | (half.take(full) << 4) | (word >> 12)
            half[full] = word & 0xFFF
            pos[full] = at + 1
            wide = span.take(full) << WORD
            span[full] = wide
            full = full[wide < BOTTOM]
        right = guess == symbol
        symbol <<= 3
        symbol += 1
        grown = had + 1
        had |= 7
        after[slots] = np.where(right, np.minimum(grown, had), symbol)
        at = t % RENEW
        states[at], rights[at] = state, right
    out = out[2:] - 1
    return np.concatenate([out[:, :more].T.reshape(-1), out[:each, more:].T.reshape(-1)])
