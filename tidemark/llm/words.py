"""Words, hashes and word sequences of UTF-8 batches, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 3  # odd, so it has an inverse
INVERSE = pow(BASE, -1, 1 << 64)


def byte_table(outside: bytes) -> np.ndarray:
    """Which bytes belong to words; all beyond ASCII do."""
    out = np.ones(256, bool)
    out[np.frombuffer(outside, np.uint8)] = False
    return out


#: Words are runs of anything but blanks and ASCII line and tab marks.
SPACED = byte_table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words are runs of ASCII letters and digits and everything beyond ASCII.
ALNUM = byte_table(bytes(x for x in range(128) if not chr(x).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


CODES = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
_powers = {"at": np.ones(1, U), "back": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers["at"]) < n:
        with np.errstate(over="ignore"):
            for key, b in (("at", BASE), ("back", INVERSE)):
                step = np.full(n, b, U)
                step[0] = 1
                _powers[key] = np.multiply.accumulate(step)
    return _powers["at"], _powers["back"]


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = SPACED):
    """Starts and ends of all words, and the number of each text's first word."""
    member = inside[data]
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.empty(len(member), bool)
    edge[0] = True
    np.logical_not(member[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < len(member)]] = True
    starts = np.flatnonzero(member & edge)
    edge[-1] = True
    np.logical_not(member[1:], out=edge[:-1])
    ends_at = offsets[1:] - 1
    edge[ends_at[ends_at >= 0]] = True
    ends = np.flatnonzero(member & edge) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word, ASCII letters in lower case if asked."""
    if not len(starts):
        return np.zeros(0, U)
    at, back = powers(len(data) + 1)
    codes = CODES[LOWER] if lower else CODES
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum(codes[data] * at[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; only whole runs."""
    if len(words) < n:
        return np.zeros(0, U)
    m = len(words) - n + 1
    out = words[:m].copy()
    for k in range(1, n):
        out *= U(BASE)
        out += words[k:k + m]
    return mix(out + U(n))
