"""Token-id files: blocks coded by an adaptive context-mixing range coder.

A block of ids is dealt to lanes, which are coded in step: every numpy call works on one
id of each lane. Three predictors share one adaptive model per block: order 2 (the id
that last followed the same two ids), order 1 (the same for one id) and order 0
(frequencies of all ids). How often orders 2 and 1 are right is counted per pair of
confidences; these counts mix the predictions into the code space of the next id: one
part for the order-2 guess, one for the order-1 guess, the rest spread by order 0. Parts
and frequencies add up to powers of two, so an id narrows its lane's interval once, by
shifts and products. Encoder and decoder update the same model, so nothing but the code
words of the carry-less range coders is stored.

Blocks are reset independently and carry two checksums, of the stored bytes and of the
ids, so a block can be decoded and checked alone; damage raises.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Ids of a block, and lanes coded in step.
BLOCK, LANES = 1 << 21, 8192
#: Fixed values of the format.
MAGIC, VERSION = b"CMRC", 2
_HEADER = struct.Struct("<4sHHIIIII")  # magic, version, 0, ids, lanes, vocabulary, crc of ids, crc of the rest

_U = np.uint64
_TOP, _BOTTOM = _U(48), _U(1 << 32)
_TABLE_BITS = 18
_CONFIDENT = 7
#: The code space: shares of the three orders, and order-0 frequencies within the last share.
_SHARE_BITS, _ORDER0_BITS = 12, 19
_SPACE = _U(_SHARE_BITS + _ORDER0_BITS)
#: Confidence after a wrong and after a right guess, by the one before.
_LEVEL = np.array([k >> 1 for k in range(_CONFIDENT + 1)] + [min(k + 1, _CONFIDENT) for k in range(_CONFIDENT + 1)], np.int32)


class _Model:
    """Predictions of all three orders, updated a step at a time.

    A table entry is a guess and, in its last three bits, the confidence in it.
    """

    def __init__(self, vocabulary: int, lanes: int):
        if vocabulary >= 1 << _ORDER0_BITS:
            raise ValueError(f"the format holds vocabularies below {1 << _ORDER0_BITS} ids")
        self.size = vocabulary
        self.one = np.zeros(lanes, np.int64)  # previous id of each lane, plus one; 0 at its start
        self.two = np.zeros(lanes, np.int64)
        self.order2 = np.zeros(1 << _TABLE_BITS, np.int32)
        self.order1 = np.zeros(vocabulary + 1, np.int32)
        states = (_CONFIDENT + 1) ** 2 * 2
        self.mix = np.ones((states, 3), np.int64)
        self.mix += np.array([0, 0, 2])
        self.start = np.zeros((states, 3), _U)  # of the parts in the code space
        self.width = np.zeros((states, 3), _U)  # of the parts; of one order-0 unit in the last
        self.counts = np.zeros(vocabulary, np.int64)
        self.rare: list[np.ndarray] = []  # ids that the counts do not hold yet
        self.step_no, self.rebuild_at = 0, 0

    def _rebuild(self):
        if self.rare:
            self.counts += np.bincount(np.concatenate(self.rare), minlength=self.size)
            self.rare = []
        room = (1 << _ORDER0_BITS) - self.size
        freq = 1 + self.counts * room // max(int(self.counts.sum()), 1)
        left = (1 << _ORDER0_BITS) - int(freq.sum())
        freq += left // self.size
        freq[:left % self.size] += 1
        self.freq_int, self.freq = freq, freq.astype(_U)
        self.cum = (np.cumsum(freq) - freq).astype(_U)
        self.slots = None
        self.rebuild_at = self.step_no + min(max(self.step_no, 1), 32)

    def order0(self, places: np.ndarray) -> np.ndarray:
        """Ids whose order-0 frequencies cover the places."""
        if self.slots is None:
            self.slots = np.repeat(np.arange(self.size, dtype=np.int32), self.freq_int)
        return self.slots[places]

    def look(self, n: int) -> np.ndarray:
        """Mixing state of the first n lanes; guesses and parts are ready after it."""
        if self.step_no >= self.rebuild_at:
            self._rebuild()
        one = self.one[:n]
        self.at2 = ((self.two[:n] * 0x2545F491 + one * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - _TABLE_BITS)
        self.at1 = one
        self.told2, self.told1 = self.order2[self.at2], self.order1[one]
        self.sure2, self.sure1 = self.told2 & _CONFIDENT, self.told1 & _CONFIDENT
        self.g2, self.g1 = self.told2 >> 3, self.told1 >> 3
        self.state = ((self.sure2 << 4) + (self.sure1 << 1) + (self.g1 == self.g2)).astype(np.int64)
        shares = 1 + self.mix * ((1 << _SHARE_BITS) - 3) // self.mix.sum(axis=1, keepdims=True)
        shares[:, 2] = (1 << _SHARE_BITS) - shares[:, 0] - shares[:, 1]
        self.width[:] = shares << np.array([_ORDER0_BITS, _ORDER0_BITS, 0])
        self.start[:] = (np.cumsum(shares, axis=1) - shares) << _ORDER0_BITS
        return self.state

    def modes(self, ids: np.ndarray) -> np.ndarray:
        return np.where(ids == self.g2, 0, 2 - (ids == self.g1))

    def update(self, ids: np.ndarray, part: np.ndarray, rare: np.ndarray):
        """Learn the ids and their parts; ``rare`` are the ids that no guess told."""
        n = len(ids)
        self.mix += np.bincount(part, minlength=self.mix.size).reshape(self.mix.shape)
        if self.mix.max() > 1 << 15:
            self.mix = (self.mix >> 1) + 1
        new = ids << 3
        for entries, at, told, guess, sure in ((self.order2, self.at2, self.told2, self.g2, self.sure2),
                                               (self.order1, self.at1, self.told1, self.g1, self.sure1)):
            level = _LEVEL[sure | (guess == ids).view(np.int8) << np.int32(3)]
            entries[at] = np.where(level > 1, told - sure, new) + level
        self.rare.append(rare)
        self.two[:n] = self.one[:n]
        self.one[:n] = ids + 1
        self.step_no += 1


def _lengths(n: int) -> tuple[int, int]:
    """Lanes of a block and ids of a lane; all lanes are full but the last."""
    lanes = min(LANES, max(1, n // 64))
    each = -(-n // lanes) if n else 0
    return (-(-n // each) if n else 0), each


def _open(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Places where a code word is due: its bits are settled, or the interval got small."""
    return np.flatnonzero((((low ^ (low + rng)) >> _TOP) == 0) | (rng < _BOTTOM))


def _shift(low: np.ndarray, rng: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals after a code word went out; one that straddles a word border is cut at it."""
    settled = ((low ^ (low + rng)) >> _TOP) == 0
    rng = np.where(settled, rng, (~low + _U(1)) & (_BOTTOM - _U(1)))
    return low << _U(16), rng << _U(16)


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    """One self-contained block of up to BLOCK ids below ``vocabulary``."""
    ids = np.ascontiguousarray(ids, "<u4")
    n = len(ids)
    lanes, each = _lengths(n)
    model = _Model(vocabulary, lanes)
    grid = np.zeros(lanes * each, np.int32)
    grid[:n] = ids
    if n and grid.max() >= vocabulary:
        raise ValueError("an id is outside the vocabulary")
    grid = grid.reshape(lanes, each).T.copy() if n else grid.reshape(0, 0)
    low, rng = np.zeros(lanes, _U), np.full(lanes, ~_U(0))
    room = each * 5 + 8
    out = np.zeros(room * lanes, "<u2")
    first = np.arange(lanes) * room
    at = first.copy()
    last = n - (lanes - 1) * each if n else 0
    for t in range(each):
        m = lanes if t < last else lanes - 1
        row = grid[t, :m]
        state = model.look(m)
        mode = model.modes(row)
        part = state * 3 + mode
        start, width = model.start.ravel()[part], model.width.ravel()[part]
        rare = np.flatnonzero(mode == 2)
        values = row[rare]
        unit = width[rare]
        start[rare] += model.cum[values] * unit
        width[rare] = model.freq[values] * unit
        r = rng[:m] >> _SPACE
        low[:m] += r * start
        rng[:m] = r * width
        who = _open(low[:m], rng[:m])
        while len(who):
            l = low[who]
            out[at[who]] = l >> _TOP
            at[who] += 1
            low[who], rng[who] = _shift(l, rng[who])
            who = who[_open(low[who], rng[who])]
        model.update(row, part, values)
    for _ in range(4):
        out[at] = low >> _TOP
        at += 1
        low <<= _U(16)
    rest = (at - first).astype("<u4").tobytes() + b"".join(out[i:j].tobytes() for i, j in zip(first.tolist(), at.tolist()))
    head = _HEADER.pack(MAGIC, VERSION, 0, n, lanes, vocabulary, zlib.crc32(ids.tobytes()), zlib.crc32(rest))
    return head + rest


def decode_block(data: bytes) -> np.ndarray:
    """The ids of one block; raises ValueError if it is damaged."""
    if len(data) < _HEADER.size:
        raise ValueError("not a block")
    magic, version, _, n, lanes, vocabulary, crc, stored = _HEADER.unpack_from(data)
    rest = data[_HEADER.size:]
    if magic != MAGIC or version != VERSION or zlib.crc32(rest) != stored or (lanes, n > 0) != (_lengths(n)[0], lanes > 0):
        raise ValueError("damaged block")
    lanes, each = _lengths(n)
    sizes = np.frombuffer(rest, "<u4", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(rest, "<u2", offset=4 * lanes).astype(_U), np.zeros(4, _U)])
    at = np.cumsum(sizes) - sizes
    code = np.zeros(lanes, _U)
    for _ in range(4 if n else 0):
        code = (code << _U(16)) | words[at]
        at += 1
    low, rng = np.zeros(lanes, _U), np.full(lanes, ~_U(0))
    model = _Model(vocabulary, lanes)
    grid = np.zeros((each, lanes), np.int32)
    last = n - (lanes - 1) * each if n else 0

    for t in range(each):
        m = lanes if t < last else lanes - 1
        state = model.look(m)
        r = rng[:m] >> _SPACE
        v = np.minimum((code[:m] - low[:m]) // r, (_U(1) << _SPACE) - _U(1))
        mode = (v >= model.start[:, 1][state]).astype(np.int64) + (v >= model.start[:, 2][state])
        part = state * 3 + mode
        start, width = model.start.ravel()[part], model.width.ravel()[part]
        row = np.where(mode == 0, model.g2, model.g1)
        rare = np.flatnonzero(mode == 2)
        unit = width[rare]
        values = model.order0(((v[rare] - start[rare]) // unit).astype(np.int64))
        row[rare] = values
        start[rare] += model.cum[values] * unit
        width[rare] = model.freq[values] * unit
        low[:m] += r * start
        rng[:m] = r * width
        who = _open(low[:m], rng[:m])
        while len(who):
            low[who], rng[who] = _shift(low[who], rng[who])
            code[who] = (code[who] << _U(16)) | words[at[who]]
            at[who] += 1
            who = who[_open(low[who], rng[who])]
        grid[t, :m] = row
        model.update(row, part, values)
    ids = grid.T.reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("damaged ids")
    return ids


def join_crc32(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings from the parts' crc32 and the second one's length."""

    def times(a: int, b: int) -> int:  # product of reflected polynomials modulo the crc's
        out = 0
        for i in range(32):
            if b >> (31 - i) & 1:
                out ^= a
            a = (a >> 1) ^ (0xEDB88320 if a & 1 else 0)
        return out

    power, square, n = 1 << 31, 1 << 23, length  # 1 and x^8
    while n:
        if n & 1:
            power = times(power, square)
        square = times(square, square)
        n >>= 1
    return times(first, power) ^ second
