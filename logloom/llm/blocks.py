"""Patched frame-of-reference blocks: unsigned 32-bit ids to bytes and back.

Layout of a segment, little-endian:

    magic "PFR1", block length u32, ids u64, blocks u32, bytes of all blocks u64
    start of each block u64 (index: any block can be read without those before it)
    per block: minimum u32, width u8, exceptions u16, packed low bits, then the
    exceptions' positions u16 and their values above the minimum u32

Values are stored less the block's minimum in as many bits as a percentile of them
needs; those that need more are exceptions.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 1024
PERCENTILE = 98.0
_HEAD = struct.Struct("<4sIQIQ")
_BLOCK = struct.Struct("<IBH")


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Exact for values below 2**53."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of n values (n a multiple of 64) of `width` bits -> rows of n * width / 8 bytes."""
    rows, n = values.shape
    lanes = values.reshape(rows, n // 64, 64).astype(np.uint64)
    out = np.zeros((rows, n // 64, width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, :, word] |= lanes[:, :, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= lanes[:, :, j] >> np.uint64(64 - shift)
    return out.reshape(rows, -1).view(np.uint8)


def _unpack(packed: np.ndarray, width: int, n: int) -> np.ndarray:
    rows = len(packed)
    words = np.ascontiguousarray(packed).view(np.uint64).reshape(rows, n // 64, width)
    out = np.empty((rows, n // 64, 64), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        x = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | (words[:, :, word + 1] << np.uint64(64 - shift))
        out[:, :, j] = x & mask
    return out.reshape(rows, n)


def encode(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    if block % 64 or not 0 < block < 65536:
        raise ValueError("the block length is a multiple of 64 below 65536")
    n = len(ids)
    count = -(-n // block)
    padded = np.zeros(count * block, np.uint32)
    padded[:n] = ids
    if n:
        padded[n:] = ids[-1]
    rows = padded.reshape(count, block)
    low = rows.min(axis=1) if count else np.empty(0, np.uint32)
    rest = rows - low[:, None]
    at = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    widths = _bit_length(np.partition(rest, at, axis=1)[:, at]) if count else np.empty(0, np.int64)
    over = (rest.astype(np.uint64) >> widths[:, None].astype(np.uint64)) > 0
    packed: list[bytes] = [b""] * count
    for w in np.unique(widths):
        if w:
            own = np.flatnonzero(widths == w)
            for i, p in zip(own, _pack(rest[own] & np.uint32((1 << int(w)) - 1), int(w))):
                packed[i] = p.tobytes()
    parts, starts, total = [], np.empty(count, np.uint64), 0
    for i in range(count):
        out = np.flatnonzero(over[i])
        part = b"".join((
            _BLOCK.pack(int(low[i]), int(widths[i]), len(out)), packed[i],
            out.astype("<u2").tobytes(), rest[i][out].astype("<u4").tobytes(),
        ))
        starts[i] = total
        total += len(part)
        parts.append(part)
    return b"".join((_HEAD.pack(b"PFR1", block, n, count, total), starts.astype("<u8").tobytes(), *parts))


def decode(data: bytes) -> np.ndarray:
    magic, block, n, count, total = _HEAD.unpack_from(data)
    if magic != b"PFR1" or len(data) != _HEAD.size + 8 * count + total:
        raise ValueError("not a whole segment of blocks")
    starts = np.frombuffer(data, "<u8", count, _HEAD.size).astype(np.int64) + _HEAD.size + 8 * count
    heads = [_BLOCK.unpack_from(data, s) for s in starts]
    widths = np.array([h[1] for h in heads], np.int64)
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((count, block), np.uint32)
    for w in np.unique(widths):
        if w:
            own = np.flatnonzero(widths == w)
            size = block * int(w) // 8
            at = starts[own, None] + _BLOCK.size + np.arange(size)
            out[own] = _unpack(raw[at], int(w), block)
    for i, (low, w, many) in enumerate(heads):
        if many:
            at = int(starts[i]) + _BLOCK.size + block * w // 8
            out[i, np.frombuffer(data, "<u2", many, at)] = np.frombuffer(data, "<u4", many, at + 2 * many)
        out[i] += np.uint32(low)
    return out.reshape(-1)[:n]


def read_block(data: bytes, i: int) -> np.ndarray:
    """One block by the index alone."""
    _, block, n, count, _ = _HEAD.unpack_from(data)
    if not 0 <= i < count:
        raise IndexError(i)
    first = _HEAD.size + 8 * count
    at = first + struct.unpack_from("<Q", data, _HEAD.size + 8 * i)[0]
    low, w, many = _BLOCK.unpack_from(data, at)
    at += _BLOCK.size
    size = block * w // 8
    out = np.zeros(block, np.uint32)
    if w:
        out[:] = _unpack(np.frombuffer(data, np.uint8, size, at).reshape(1, -1), w, block)[0]
    if many:
        out[np.frombuffer(data, "<u2", many, at + size)] = np.frombuffer(data, "<u4", many, at + size + 2 * many)
    return (out + np.uint32(low))[: min(block, n - i * block)]
