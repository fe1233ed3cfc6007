"""Columns of integers as one compressed block of bytes.

A shuffle of many small rows costs disk for their widths and cannot see that neighbours are alike. Tasks
that sort what they send by where it goes send one block for each receiver: a column is cut to the bytes its
largest value needs, laid out byte by byte, and compressed.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import zstandard

MOST_BITS = 22  # no more than 2**22 buckets


def bits_for(places: int, each: int = 500_000) -> int:
    """How many leading bits of a hash give buckets of about `each` of so many places."""
    return min(max(1, (places // each).bit_length()), MOST_BITS)


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits)


def pack(columns: list[np.ndarray], compressor: zstandard.ZstdCompressor | None = None) -> bytes:
    """Columns of unsigned 64-bit integers, which may differ in length. Making a compressor takes longer than a small block."""
    head, body = [struct.pack("<B", len(columns))], []
    for column in columns:
        column = np.ascontiguousarray(column, "<u8")
        width = (int(column.max()).bit_length() + 7) // 8 if len(column) else 0
        head.append(struct.pack("<QB", len(column), width))
        body.append(column.view("u1").reshape(-1, 8)[:, :width].T.tobytes())
    return (compressor or zstandard.ZstdCompressor(level=1)).compress(b"".join(head + body))


def unpack(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    sizes = [struct.unpack_from("<QB", raw, 1 + 9 * i) for i in range(raw[0])]
    at, columns = 1 + 9 * len(sizes), []
    for length, width in sizes:
        whole = np.zeros((length, 8), "u1")
        whole[:, :width] = np.frombuffer(raw, "u1", length * width, at).reshape(width, length).T
        columns.append(whole.view("<u8").reshape(-1))
        at += length * width
    return columns


def runs(ordered: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each value of a sorted array, and where its run begins and ends."""
    if not len(ordered):
        return
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    yield from zip(ordered[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ordered)], strict=True)


def rising(values: np.ndarray) -> np.ndarray:
    """Differences of a sorted column, the first value at its head; `np.cumsum` gives it back."""
    return np.diff(values, prepend=np.uint64(0))


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys, and where in it each different one begins."""
    order = np.argsort(keys)
    keys = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])


def counts_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, a place where each is found, and how often."""
    order, starts = _groups(keys)
    at = order[starts]
    return keys[at], at, np.diff(starts, append=len(keys)).astype("u8")


def summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Different keys in order, a place where each is found, and the sums of the columns over each."""
    order, starts = _groups(keys)
    at = order[starts]
    return keys[at], at, [np.add.reduceat(c[order], starts) if len(starts) else c[:0] for c in columns]
