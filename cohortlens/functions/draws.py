"""Pseudo-random draws as hashes of a seed and a key.

A draw depends on nothing but its own key, so it does not move when partitions, task order or
other rows change, a lost task recomputes the same value, and plain SQL gives the same number.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 13  # 52 bits: exact in both a BIGINT and a double
SPAN = float(1 << 52)


def _joined(parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def _as_long(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long")


def draw(*parts) -> Column:
    """Integer in [0, 2^52) from md5 of the parts joined by '|'."""
    return _as_long(F.md5(_joined(parts)))


def draw_slots(parts, lo: int, hi: int) -> np.ndarray:
    """``draw(*parts, i)`` for i from lo to below hi, inside a task: the same md5, without a row per number."""
    text = "".join(f"{p}|" for p in parts).encode()
    if len(text) + len(str(max(hi - 1, 0))) > 55:  # more than one block of md5
        digests = b"".join([hashlib.md5(text + b"%d" % i).digest() for i in range(lo, hi)])
        return (np.frombuffer(digests, ">u8")[::2] >> np.uint64(12)).astype(np.int64)
    out, at = np.empty(max(hi - lo, 0), np.int64), lo
    while at < hi:  # numbers of one length that differ in their last digits only
        low = min(LOW, len(str(at)))
        end = min(hi, at - at % 10 ** low + 10 ** low)
        out[at - lo:end - lo] = _md5_numbers(text, at, end, low)
        at = end
    return out


LOW = 4  # digits that differ inside one array
_SHIFTS = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) & 0xFFFFFFFF for i in range(64)]
_WORDS = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]


@lru_cache(maxsize=64)
def _low_digits(low: int, at: int, word: int) -> np.ndarray | None:
    """What the last ``low`` digits of 0 .. 10^low - 1, as text from byte ``at``, add to a word of the message."""
    x, i = np.zeros(10 ** low, np.uint32), np.arange(10 ** low)
    mine = [j for j in range(low) if (at + j) // 4 == word]
    for j in mine:
        x |= (i // 10 ** (low - 1 - j) % 10 + 48).astype(np.uint32) << np.uint32(8 * ((at + j) % 4))
    return x if mine else None


def _md5_numbers(text: bytes, lo: int, hi: int, low: int) -> np.ndarray:
    """First 52 bits of md5(text + number), lo <= number < hi, side by side in arrays; all but ``low`` digits are the same."""
    head = text + str(lo).encode()[:-low]
    size = len(head) + low
    block = np.frombuffer((head + bytes(low) + b"\x80").ljust(56, b"\0") + (8 * size).to_bytes(8, "little"), "<u4")
    first = lo % 10 ** low
    words = []
    for w in range(16):
        x = _low_digits(low, len(head), w)
        words.append(int(block[w]) if x is None else x[first:first + hi - lo] | block[w])
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(hi - lo, v, np.uint32) for v in start)
    f = np.empty_like(a)
    for i, (shift, sine, w) in enumerate(zip(_SHIFTS, _SINES, _WORDS)):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        a += f
        if isinstance(words[w], int):
            a += np.uint32((sine + words[w]) & 0xFFFFFFFF)
        else:
            a += words[w]
            a += np.uint32(sine)
        np.left_shift(a, np.uint32(shift), out=f)
        a >>= np.uint32(32 - shift)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    a += np.uint32(start[0])
    b += np.uint32(start[1])
    return ((a.byteswap().astype(np.int64) << 20) | (b.byteswap().astype(np.int64) >> 12))


def unit_draw(*parts) -> Column:
    """The same draw scaled to [0, 1)."""
    return draw(*parts) / F.lit(SPAN)


def hash_unit(key: Column, seed) -> Column:
    """Stable number in [0, 1) of a subject key: sha1 of 'seed|key'."""
    return _as_long(F.sha1(_joined([seed, key]))) / F.lit(SPAN)


def poisson_weight(*parts) -> Column:
    """Poisson(1) weight by inversion of a uniform draw, to the last of its 52 bits (weights up to 17)."""
    u = unit_draw(*parts)
    out, cdf, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(18):  # the mass beyond is below one step of the draw
        cdf += term
        out = out + F.when(u >= F.lit(cdf), 1).otherwise(0)
        term /= k + 1
    return out.cast("long")
