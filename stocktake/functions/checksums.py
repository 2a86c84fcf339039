"""Checksums of whole contents from those of their parts.

A CRC is linear: the checksum of a content is the sum (XOR) of those of its parts, each carried
over the bytes that follow it. So parts may come in any order, and XOR adds them up before a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a piece, and of all pieces that are looked up side by side.
_PIECE, _AT_ONCE = 512, 4 << 20


@dataclass(frozen=True)
class Crc:
    """A reflected CRC that begins with and ends by inverting all bits."""

    bits: int
    polynomial: int  # reflected

    @property
    def _kind(self) -> type:
        return np.uint64 if self.bits > 32 else np.uint32

    @cached_property
    def bytes_table(self) -> np.ndarray:
        """What each byte leaves of a register of zeros."""
        table = np.arange(256, dtype=self._kind)
        for _ in range(8):
            table = np.where(table & 1, table >> self._kind(1) ^ self._kind(self.polynomial), table >> self._kind(1))
        return table

    @cached_property
    def _doublings(self) -> list[np.ndarray]:
        return [_tables(self.bits, [int(self.bytes_table[1 << i]) if i < 8 else 1 << i - 8 for i in range(self.bits)])]

    def tables(self, k: int) -> np.ndarray:
        """For each byte of a register, and each value, what 2 ** k zero bytes make of it."""
        while len(self._doublings) <= k:
            last = self._doublings[-1]
            self._doublings.append(_tables(self.bits, [int(carried(carried(np.array([1 << i], self._kind), last), last)[0]) for i in range(self.bits)]))
        return self._doublings[k]

    def over(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each checksum as part of a longer content that n more bytes follow: what it adds to the whole's."""
        crc, n = crc.astype(self._kind), n.astype(np.int64).copy()
        k = 0
        while n.any():
            crc = np.where(n & 1, carried(crc, self.tables(k)), crc)
            n, k = n >> 1, k + 1
        return crc

    def _register(self, contents: Sequence[bytes]) -> np.ndarray:
        """What each content leaves of a register of zeros.

        Contents are cut into pieces of one size, with zeros in front, which change nothing. All pieces are
        looked up side by side, byte by byte, and then carried over those that follow in their content.
        """
        lengths = np.array([len(x) for x in contents], np.int64)
        size = max(1, min(_PIECE, int(lengths.max())))
        n = -(-lengths // size)
        ends = np.cumsum(n)
        data = np.zeros(int(ends[-1]) * size, np.uint8)
        for x, end in zip(contents, (ends * size).tolist()):
            data[end - len(x) : end] = np.frombuffer(x, np.uint8)
        found = np.zeros(int(ends[-1]), self._kind)
        for column in np.ascontiguousarray(data.reshape(-1, size).T):
            found = self.bytes_table[found.astype(np.uint8) ^ column] ^ found >> self._kind(8)
        found = self.over(found, (np.repeat(ends, n) - 1 - np.arange(len(found))) * size)
        out = np.zeros(len(contents), self._kind)
        out[n > 0] = np.bitwise_xor.reduceat(found, (ends - n)[n > 0]) if len(found) else 0
        return out

    def each(self, contents: Sequence[bytes]) -> np.ndarray:
        """The checksum of each content, about _AT_ONCE bytes at a time; longer contents go in slices of that."""
        lengths = np.array([len(x) for x in contents], np.int64)
        found = np.zeros(len(contents), self._kind)
        start = 0
        while start < len(contents):
            if lengths[start] > _AT_ONCE:
                view, register = memoryview(contents[start]), np.zeros(1, self._kind)
                for at in range(0, len(view), _AT_ONCE):
                    piece = view[at : at + _AT_ONCE]
                    register = self.over(register, np.array([len(piece)])) ^ self._register([piece])
                found[start], start = register[0], start + 1
                continue
            held = np.cumsum(lengths[start : start + _AT_ONCE // _PIECE])
            stop = start + max(1, int(np.searchsorted(held, _AT_ONCE, side="right")))
            found[start:stop], start = self._register(contents[start:stop]), stop
        ones = self._kind((1 << self.bits) - 1)
        return np.where(lengths > 0, found ^ self.over(np.full(len(contents), ones), lengths) ^ ones, self._kind(0))

    def of(self, data: bytes) -> int:
        """The checksum of a content."""
        return int(self.each([data])[0])


def _tables(bits: int, images: list[int]) -> np.ndarray:
    """Tables by byte of a linear map, from the images of the single bits."""
    kind = np.uint64 if bits > 32 else np.uint32
    out = np.zeros((bits // 8, 256), kind)
    value = np.arange(256)
    for i, image in enumerate(images):
        out[i // 8] ^= np.where(value >> i % 8 & 1, kind(image), kind(0))
    return out


def carried(register: np.ndarray, tables: np.ndarray) -> np.ndarray:
    out = np.zeros_like(register)
    for i, table in enumerate(tables):
        out ^= table[(register >> register.dtype.type(8 * i) & register.dtype.type(255)).astype(np.int64)]
    return out


# The reflected polynomials of CRC-32 and of CRC-64/NVME.
CRC32 = Crc(32, 0xEDB88320)
CRC64NVME = Crc(64, 0x9A6C9329AC4BC9B5)


def crc(content: Column | str, kind: Crc) -> Column:
    """The checksum of each binary content; 64 bits come as a signed long. Null for null."""

    @F.pandas_udf("long")
    def of(contents: pd.Series) -> pd.Series:
        known = contents.notna().to_numpy()
        out = pd.Series(pd.NA, index=contents.index, dtype="Int64")
        out[known] = kind.each(contents[known].tolist()).astype(np.uint64).astype(np.int64)
        return out

    return of(content)


def shifted(crc: Column | str, left: Column | str, kind: Crc) -> Column:
    """What a part's checksum adds to the whole's, where `left` bytes follow the part: bit_xor of these is the whole's checksum. Null for null."""

    @F.pandas_udf("long")
    def of(crcs: pd.Series, n: pd.Series) -> pd.Series:
        known = (crcs.notna() & n.notna()).to_numpy()
        out = pd.Series(pd.NA, index=crcs.index, dtype="Int64")
        found = kind.over(crcs[known].astype("int64").to_numpy().astype(np.uint64), n[known].astype("int64").to_numpy())
        out[known] = found.astype(np.uint64).astype(np.int64)
        return out

    return of(crc, left)


def combined(crc: Column | str, left: Column | str, kind: Crc) -> Column:
    """An aggregate: the checksum of a content from those of its parts, in any order, and the number of bytes that follow each."""
    return F.bit_xor(shifted(crc, left, kind))


def etag_of_parts(digests: Column) -> Column:
    """The entity tag of an object of several parts: the MD5 of their MD5s (hex, in order), and their number."""
    return F.concat(F.md5(F.unhex(F.array_join(digests, ""))), F.lit("-"), F.size(digests).cast("string"))
