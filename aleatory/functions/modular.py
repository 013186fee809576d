"""Powers modulo one number of many rows at once.

A row is a number in limbs of 17 bits, as doubles. Products are convolutions by
Fourier transforms; the limbs of a product over the modulus' length are folded
down by a matrix of remainders. Rows are reduced only so far that two limbs
over that length hold them, and whole integers again at the end.

All is exact up to 4096 bits (K = 241 limbs): limbs are below 2^17 + 2^6, the
last below 2^22, so coefficients are below 2^45 and the errors of their
transforms far below 1/2; after one carry limbs are below 2^27.4, and the
matrix adds up K + 4 products of them with 17 bits, below 2^53.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np

BITS = 4096
#: Rows worked on at a time, so that they stay in a core's cache, and fewest rows worth it.
ROWS, FEW = 128, 24
W = 17
_RADIX = float(1 << W)


class Modulus:
    def __init__(self, n: int) -> None:
        self.n, self.k = n, -(-n.bit_length() // W)
        self.limbs = self.k + 2
        self.length = 1 << (2 * self.limbs).bit_length()
        self.fold = self._split([pow(2, W * i, n) for i in range(self.k, 2 * self.limbs)])[:, : self.k].copy()

    def _split(self, numbers: Sequence[int]) -> np.ndarray:
        wide = -(-W * self.limbs // 8)
        raw = np.frombuffer(b"".join(v.to_bytes(wide, "little") for v in numbers), np.uint8).reshape(-1, wide)
        bits = np.unpackbits(raw, axis=1, count=W * self.limbs, bitorder="little").reshape(-1, self.limbs, W)
        return bits @ (2.0 ** np.arange(W))

    def _joined(self, rows: np.ndarray) -> list[int]:
        whole = rows.astype(np.int64)

        def numbers(limbs: np.ndarray) -> list[int]:
            bits = (limbs[:, :, None] >> np.arange(W) & 1).astype(np.uint8).reshape(len(limbs), -1)
            return [int.from_bytes(b.tobytes(), "little") for b in np.packbits(bits, axis=1, bitorder="little")]

        return [(a + (b << W)) % self.n for a, b in zip(numbers(whole & (1 << W) - 1), numbers(whole >> W), strict=True)]

    def _powers(self, bases: Sequence[int], exponents: Sequence[int]) -> list[int]:
        """By windows of four bits, from the highest. Arrays are made once and written over: new ones cost more than the work on them."""
        m = len(bases)
        squared, wide = np.empty((m, self.length // 2 + 1), complex), np.empty((m, self.length))
        rest, out = np.empty(m * self.length), np.zeros((m, self.limbs))

        def carry(c: np.ndarray) -> None:
            """What is over a limb's bits moves by one place; the last limb keeps it."""
            flat, over = c.ravel(), rest[: c.size]
            np.multiply(flat, 1 / _RADIX, out=over)
            np.floor(over, out=over)
            over[c.shape[1] - 1 :: c.shape[1]] = 0
            flat[1:] += over[:-1]
            np.multiply(over, _RADIX, out=over)
            flat -= over

        def product(f: np.ndarray, g: np.ndarray, to: np.ndarray) -> None:
            """The product of two transformed rows to ``out``, and transformed to ``to``."""
            np.multiply(f, g, out=squared)
            np.fft.irfft(squared, self.length, out=wide)
            np.rint(wide, out=wide)
            carry(wide)
            np.matmul(wide[:, self.k : 2 * self.limbs], self.fold, out=out[:, : self.k])
            out[:, : self.k] += wide[:, : self.k]
            out[:, self.k :] = 0
            for _ in range(3):
                carry(out)
            np.fft.rfft(out, self.length, out=to)

        table = np.empty((16, *squared.shape), complex)
        np.fft.rfft(self._split([1] * m), self.length, out=table[0])
        np.fft.rfft(self._split([b % self.n for b in bases]), self.length, out=table[1])
        for i in range(2, 16):
            product(table[i - 1], table[1], table[i])
        digits = max(-(-max(e.bit_length() for e in exponents) // 4), 1)
        nibble, at = np.array([[e >> 4 * i & 15 for e in exponents] for i in range(digits)]), np.arange(m)
        f = np.empty_like(squared)
        product(table[nibble[-1], at], table[0], f)
        for window in nibble[-2::-1]:
            for _ in range(4):
                product(f, f, f)
            product(f, table[window, at], f)
        return self._joined(out)

    def powers(self, bases: Sequence[int], exponents: Sequence[int]) -> list[int]:
        """base ** exponent % n, row by row; exponents are 0 or more."""
        out: list[int] = []
        for i in range(0, len(bases), ROWS):
            b, e = bases[i : i + ROWS], exponents[i : i + ROWS]
            if len(b) < FEW or self.n.bit_length() > BITS:
                out += map(pow, b, e, [self.n] * len(b))
            else:
                out += self._powers(b, e)
        return out


@lru_cache(8)
def modulus(n: int) -> Modulus:
    return Modulus(n)
