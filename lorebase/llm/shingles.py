"""Word shingles of texts as 64-bit hashes, for whole batches at once in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BREAKS = [bytes([i]) for i in np.flatnonzero(_SPACE)]
_BYTES = np.random.default_rng(20_240_607).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C13)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: list[np.ndarray] = []
#: Bytes hashed at once, and powers kept for the next batch.
PIECE = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64; up to PIECE + 1 of them are kept."""

    def upto(most: int) -> list[np.ndarray]:
        out = []
        for b in (_BASE, _INVERSE):
            x = np.full(most, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        return out

    if n > PIECE + 1:  # a word, or an anchor's batch, beyond a piece: rare
        return tuple(upto(n))
    if not _POWERS:
        _POWERS.extend(upto(PIECE + 1))
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over all others (a bijection of 64-bit values)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of every word between white space (space, 9 to 13), A-Z lower-cased; long data in pieces that end at white space.

    A word's hash is a polynomial in its bytes modulo 2**64, taken as the difference of two prefix sums and
    shifted back to the word's start, so equal words anywhere have equal hashes.
    """
    if len(data) > PIECE:
        return np.concatenate([_hashes(p) for p in _pieces(data)])
    return _hashes(data)


def _pieces(data: bytes) -> Iterator[bytes]:
    """``data`` cut at white space into pieces of at most PIECE bytes, more only where a single word is longer."""
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            last = max(data.rfind(c, at + 1, end) for c in _BREAKS)
            if last < 0:
                later = [x for c in _BREAKS if (x := data.find(c, end)) >= 0]
                last = min(later, default=len(data))
            end = last
        yield data[at:end]
        at = end


def _hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    space = _SPACE[raw]
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[_LOWER[raw]] * power[:-1], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingles of ``width`` words; fewer words are one shingle; none give an empty set."""
    return _set(word_hashes((text or "").encode("utf-8", "surrogatepass")), width)


def _set(words: np.ndarray, width: int) -> np.ndarray:
    if not len(words):
        return words
    n = min(len(words), width)
    s = np.full(len(words) - n + 1, np.uint64(n))
    for i in range(n):
        s = mix(s * np.uint64(0x2545F4914F6CDD1D) + words[i : len(words) - n + 1 + i])
    return np.unique(s)


def shingle_sets(texts: list[str | None], width: int, most: int = PIECE) -> list[np.ndarray]:
    """``shingle_set`` of each text; short texts are hashed together, up to ``most`` bytes at once."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        data = b"\n".join(held)
        words = word_hashes(data)
        raw = np.frombuffer(data, np.uint8)
        before = np.cumsum(np.diff(np.r_[True, _SPACE[raw]].astype(np.int8)) == -1) if len(raw) else np.zeros(0, np.int64)
        at = 0
        for d in held:
            a = int(before[at - 1]) if at else 0
            b = int(before[at + len(d) - 1]) if len(d) else a
            out.append(_set(words[a:b], width))
            at += len(d) + 1
        held.clear()
        size = 0

    for t in texts:
        d = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(d) > most:
            flush()
        held.append(d)
        size += len(d) + 1
    if held:
        flush()
    return out


def set_key(s: np.ndarray) -> bytes:
    """16 bytes that stand for a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()
