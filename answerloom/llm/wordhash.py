"""Words, shingles and minima of whole texts as 64-bit hashes, with numpy.

For use inside Arrow tasks. Words are maximal runs of bytes outside
`[\\x20\\x09-\\x0D]` of the UTF-8 text, with A-Z lower-cased unless asked otherwise. A text is worked
through in pieces cut at white space, so memory follows the piece, not the
text.
"""

import hashlib

import numpy as np

PIECE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the salt alone."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + np.uint64(salt)) | np.uint64(1)


def _byte_values(fold: bool) -> np.ndarray:
    values = seeds(256, 11)
    if fold:
        values[65:91] = values[97:123]
    return values


FOLDED, EXACT = _byte_values(True), _byte_values(False)
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
# Powers of an odd base, for the places of bytes within a word.
BASE = int(seeds(1, 12)[0])


def _powers(n: int) -> np.ndarray:
    powers = np.full(n, BASE, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def _piece_words(piece: np.ndarray, byte_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one piece of bytes."""
    inside = ~SPACE[piece]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    lengths = ends - starts
    body = piece[inside]
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(len(body)) - np.repeat(firsts, lengths)
    values = byte_values[body] * _powers(int(lengths.max()))[place]
    sums = np.add.reduceat(values, firsts)
    return mix(sums + lengths.astype(np.uint64)), starts, ends


def words(text: bytes, byte_values: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last) of each word of a text.

    With EXACT in place of FOLDED, capital letters count as different.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) <= PIECE_BYTES:
        return _piece_words(data, byte_values)
    parts, at = [], 0
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        while end < len(data) and not SPACE[data[end]]:
            step = np.flatnonzero(SPACE[data[end : end + PIECE_BYTES]])
            end = end + int(step[0]) if len(step) else min(end + PIECE_BYTES, len(data))
        hashes, starts, ends = _piece_words(data[at:end], byte_values)
        parts.append((hashes, starts + at, ends + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words, in text order; the whole sequence if it is shorter."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    take = min(size, n)
    factors = seeds(size, 13)
    total = np.full(n - take + 1, take, dtype=np.uint64)
    for k in range(take):
        total += hashes[k : n - take + 1 + k] * factors[k]
    return mix(total)


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a sequence of numbers, as two signed longs."""
    raw = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return tuple(int(x) for x in np.frombuffer(raw, dtype=np.int64))


class Minima:
    """The smallest values of a set under n hash functions.

    The functions are x -> a x + b on 32 bits, with odd a; `values` is taken
    through in blocks, so that memory does not follow the set's size.
    """

    def __init__(self, n: int, salt: int = 17):
        self.factors = (seeds(n, salt) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.offsets = (seeds(n, salt + 1) >> np.uint64(32)).astype(np.uint32)

    def of(self, values: np.ndarray) -> np.ndarray:
        narrow = (values >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.factors), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(narrow), 2048):
            block = narrow[at : at + 2048, None] * self.factors + self.offsets
            np.minimum(best, block.min(axis=0), out=best)
        return best


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of `rows` minima; the band's number is part of it."""
    table = minima[: bands * rows].reshape(bands, rows).astype(np.uint64)
    sums = (table * seeds(rows, 19)).sum(axis=1, dtype=np.uint64)
    return mix(sums + seeds(bands, 20)).view(np.int64)


def low_bits(minima: np.ndarray) -> np.ndarray:
    """The two low bits of each mixed minimum, as bit planes packed into longs.

    With k minima (a multiple of 64): k/64 longs of first bits, then as many
    of second bits.
    """
    x = minima.copy()
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(13)
    planes = [np.packbits((x >> np.uint32(k)) & np.uint32(1) != 0) for k in (0, 1)]
    return np.concatenate(planes).view(np.int64)
