"""Words of many texts as ragged numpy arrays: their places in one buffer, and a 64-bit hash of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x2545F4914F6CDD1D)
_INVERSE = np.uint64(pow(0x2545F4914F6CDD1D, -1, 2**64))
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_END = np.uint64(0x9E3779B97F4A7C15)


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, as far as they were asked for."""

    def __init__(self):
        self._up = self._down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            for name, base in (("_up", _BASE), ("_down", _INVERSE)):
                powers = np.full(n, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        return self._up[:n], self._down[:n]


def hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A 64-bit polynomial hash of each slice of ``buffer``, its length mixed in."""
    up, down = powers.get(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buffer] * up[: len(buffer)], out=sums[1:], dtype=np.uint64)
    out = (sums[ends] - sums[starts]) * down[starts]
    out ^= (ends - starts).astype(np.uint64) * _END
    out ^= out >> np.uint64(29)
    return out * _BASE


def places(buffer: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of bytes begin and end that are no separators; ``separator``: 256 booleans."""
    inside = np.zeros(len(buffer) + 2, dtype=np.int8)
    inside[1:-1] = ~separator[buffer]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices values[starts[i] : starts[i] + lengths[i]] one after the other."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    step = np.ones(total, dtype=np.int64)
    filled = lengths > 0
    starts, lengths = starts[filled], lengths[filled]
    begin = np.cumsum(lengths) - lengths
    step[begin] = starts
    step[begin[1:]] -= starts[:-1] + lengths[:-1] - 1
    return values[np.cumsum(step)]


def lookup(table: np.ndarray) -> np.ndarray:
    """256 booleans that are true at the given bytes."""
    out = np.zeros(256, dtype=bool)
    out[table] = True
    return out


SPACES = lookup(np.array([9, 10, 11, 12, 13, 32]))


class Words:
    """Words of a batch of texts: places in ``buffer``, hash, and the text each belongs to (``ends_of``: words up to its end)."""

    def __init__(self, texts: list[bytes], fold: np.ndarray, powers: Powers):
        self.buffer = fold[np.frombuffer(b"\n".join(texts), dtype=np.uint8)] if texts else np.empty(0, dtype=np.uint8)
        self.starts, self.ends = places(self.buffer, SPACES)
        self.hash = hashes(self.buffer, self.starts, self.ends, powers)
        self.ends_of = np.searchsorted(self.starts, np.cumsum([len(t) + 1 for t in texts]))
        self.starts_of = np.concatenate([[0], self.ends_of[:-1]]).astype(np.int64)

    def text(self, word: int, n: int = 1) -> bytes:
        """``n`` words from ``word`` on, a space between them."""
        return b" ".join(self.buffer[a:b].tobytes() for a, b in zip(self.starts[word : word + n], self.ends[word : word + n], strict=True))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, and their number per text; a text of fewer words has one, of all of them."""
    n = words.ends_of - words.starts_of
    h = np.zeros(len(words.hash), dtype=np.uint64)
    for i in range(k):
        later = words.hash[i:]
        h[: len(later)] = (h[: len(later)] + later) * _BASE
        h ^= h >> np.uint64(31)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out = gather(h, words.starts_of, count)
    first = np.cumsum(count) - count
    for t in np.flatnonzero((n > 0) & (n < k)):
        whole = np.uint64(0)
        with np.errstate(over="ignore"):
            for x in words.hash[words.starts_of[t] : words.ends_of[t]]:
                whole = (whole + x) * _BASE
                whole ^= whole >> np.uint64(31)
        out[first[t]] = whole ^ np.uint64(n[t])
    return out, count


def steps(sizes: list[int], most: int = 1_000_000) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes, one text at least, so that what is derived from a batch stays small."""
    out, begin, size = [], 0, 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            out.append((begin, i))
            begin, size = i, 0
        size += n
    return [*out, (begin, len(sizes))] if len(sizes) > begin else out


def text_steps(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int, list[bytes]]]:
    """The ranges of :func:`steps` over a column of texts, each with its texts (null: empty). Only those of one range are
    taken off the column at a time, since a batch may hold ten thousand texts and a worker keeps what memory it once had."""
    data = column.cast(pa.binary())
    for a, b in steps([n or 0 for n in pc.binary_length(data).to_pylist()], most):
        yield a, b, [t or b"" for t in data.slice(a, b - a).to_pylist()]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower case, ASCII punctuation as spaces.
PLAIN = LOWER.copy()
PLAIN[np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", dtype=np.uint8)] = 32
