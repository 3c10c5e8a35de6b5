"""XXH64 of many byte spans of one buffer at once.

Spark's ``xxhash64`` is XXH64 with seed 42; this gives the same values for
spans that already sit next to each other in a buffer, without a Python call a
span. Spans are handled in groups of equal length, so no step needs a mask.
"""

from __future__ import annotations

import numpy as np

U = np.uint64

# The five primes of the XXH64 specification.
P1, P2, P3, P4, P5 = (
    U(x)
    for x in (
        0x9E3779B185EBCA87,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    )
)
BLOCK = 1 << 17


def _rotl(x, r: int):
    return (x << U(r)) | (x >> U(64 - r))


def _same_length(a, v8, v4, p, length: int, seed) -> np.ndarray:
    """Hashes of the spans of one length that start at ``p``."""
    at = 0
    if length >= 32:
        lanes = [np.full(len(p), x, U) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        while at + 32 <= length:
            for k in range(4):
                lanes[k] = _rotl(lanes[k] + v8[p + (at + 8 * k)] * P2, 31) * P1
            at += 32
        h = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
        for lane in lanes:
            h = (h ^ (_rotl(lane * P2, 31) * P1)) * P1 + P4
    else:
        h = np.full(len(p), seed + P5, U)
    h = h + U(length)
    while at + 8 <= length:
        h = _rotl(h ^ (_rotl(v8[p + at] * P2, 31) * P1), 27) * P1 + P4
        at += 8
    if at + 4 <= length:
        h = _rotl(h ^ (v4[p + at].astype(U) * P1), 23) * P2 + P3
        at += 4
    while at < length:
        h = _rotl(h ^ (a[p + at].astype(U) * P5), 11) * P1
        at += 1
    h ^= h >> U(33)
    h *= P2
    h ^= h >> U(29)
    h *= P3
    return h ^ (h >> U(32))


def hash_spans(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``data[s : s + n]`` for each start and length, as uint64."""
    a = np.frombuffer(data + b"\0" * 8, np.uint8)
    v8 = np.ndarray((len(a) - 7,), "<u8", a, strides=(1,))
    v4 = np.ndarray((len(a) - 3,), "<u4", a, strides=(1,))
    out = np.empty(len(starts), U)
    with np.errstate(over="ignore"):
        for lo in range(0, len(starts), BLOCK):
            s, n, part = starts[lo : lo + BLOCK], lengths[lo : lo + BLOCK], out[lo : lo + BLOCK]
            order = np.argsort(n.astype(np.uint8) if n.max() < 256 else n, kind="stable")
            cuts = np.flatnonzero(np.diff(n[order])) + 1
            for group in np.split(order, cuts):
                part[group] = _same_length(a, v8, v4, s[group], int(n[group[0]]), U(seed))
    return out
