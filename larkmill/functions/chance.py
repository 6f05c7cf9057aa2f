"""Random numbers as hashes of keys: the same in every run, whatever the partitioning, and repeatable in other engines."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hexadecimal digits of md5 that make a number, and what it is divided by.
DIGITS = 13
WHOLE = float(1 << 4 * DIGITS)


def uniform(*keys: Column | str, seed: int = 0) -> Column:
    """A number in (0, 1) of keys and a seed."""
    joined = F.concat_ws("-", *((F.col(k) if isinstance(k, str) else k).cast("string") for k in keys), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(joined), 1, DIGITS), 16, 10).cast("bigint") + 0.5) / WHOLE


def uniform_sql(keys: str, seed: int = 0) -> str:
    """The same in DuckDB; keys: expressions, separated by commas."""
    return f"((('0x' || substr(md5(concat_ws('-', {keys}, '{seed}')), 1, {DIGITS}))::BIGINT + 0.5::DOUBLE) / {WHOLE!r}::DOUBLE)"


def normal(*keys: Column | str, seed: int = 0) -> Column:
    """A standard normal number of keys, from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(*keys, seed=seed))) * F.cos(2 * math.pi * uniform(*keys, seed=seed + 1))


def normal_sql(keys: str, seed: int = 0) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(keys, seed)})) * cos({2 * math.pi!r}::DOUBLE * {uniform_sql(keys, seed + 1)}))"


#: Turns and constants of md5's 64 steps.
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_head(words: list, n: int):
    """First two words of the md5 of n messages of one block each; words: 16 of them, a number or an array of uint32."""
    import numpy as np

    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            at = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            at = 7 * i % 16
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        if isinstance(words[at], int):
            np.add(f, np.uint32((_ADDED[i] + words[at]) & 0xFFFFFFFF), out=f)
        else:
            np.add(f, words[at], out=f)
            np.add(f, np.uint32(_ADDED[i]), out=f)
        np.left_shift(f, np.uint32(_TURNS[i]), out=g)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    return a + np.uint32(_START[0]), b + np.uint32(_START[1])


class Uniforms:
    """uniform(left, key, seed=seed) of many keys at once, for one left key after the other, in numpy. Keys are text; those that are
    None are left out, as concat_ws does."""

    def __init__(self, keys: list[str | None], seed: int = 0):
        import numpy as np

        self.tails = [("" if k is None else f"{k}-").encode() + str(seed).encode() for k in keys]
        sizes = np.array([len(t) for t in self.tails], np.int64)
        self.longest, self.sizes = int(sizes.max(initial=0)), sizes.astype(np.uint32)
        self.placed = []
        if self.longest < 56:
            # the end of each message, from each of the four places within a word, as columns of words
            for shift in range(4):
                room = -(-(shift + self.longest + 1) // 4) * 4
                text = np.frombuffer(b"".join((b"\0" * shift + t + b"\x80").ljust(room, b"\0") for t in self.tails), "<u4").reshape(len(keys), -1)
                self.placed.append([np.ascontiguousarray(w, np.uint32) for w in text.T])

    def __call__(self, left: str | None):
        import numpy as np

        head = b"" if left is None else f"{left}-".encode()
        if len(head) + self.longest >= 56:
            drawn = [int(hashlib.md5(head + t).hexdigest()[:DIGITS], 16) for t in self.tails]
            return (np.array(drawn, np.int64) + 0.5) / WHOLE
        full, shift = divmod(len(head), 4)
        words = [int.from_bytes(head[4 * i : 4 * i + 4], "little") for i in range(full)]
        ends = self.placed[shift]
        words += [ends[0] | np.uint32(int.from_bytes(head[4 * full :], "little")), *ends[1:]]
        words += [0] * (14 - len(words)) + [(self.sizes + np.uint32(len(head))) * np.uint32(8), 0]
        first, second = (x.byteswap().astype(np.int64) for x in _md5_head(words, len(self.tails)))
        return ((first << 20 | second >> 12) + 0.5) / WHOLE


def _steps() -> list[float]:
    """Distribution function of a Poisson variable of mean 1, as far as numbers of 52 bits tell it from 1."""
    total, term, steps = 0.0, math.exp(-1), []
    for k in range(1, 20):
        total += term
        steps.append(total)
        term /= k
    return [s for s in steps if s < 1]


def poisson(u: Column) -> Column:
    """A Poisson number of mean 1 from a uniform one."""
    return sum(((u >= s).cast("int") for s in _steps()), F.lit(0))


def poisson_sql(u: str) -> str:
    return "(" + " + ".join(f"({u} >= {s!r}::DOUBLE)::INT" for s in _steps()) + ")"
