"""Hashed n-grams of whole batches of texts, in numpy."""

from __future__ import annotations

import numpy as np

_SALTS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts, each between two spaces, one after another, and their starts (one more than texts)."""
    ends = np.cumsum([0, *(len(t) + 2 for t in texts)])
    codes = np.frombuffer("".join([f" {t} " for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, ends


def mixed(x: np.ndarray, bits: int) -> np.ndarray:
    """Buckets from 0 to 2 ** bits - 1 of 32-bit hashes."""
    x = x * _SALTS[2]
    x ^= x >> np.uint32(15)
    x *= _SALTS[1]
    return (x >> np.uint32(32 - bits)).astype(np.int32)


def char_grams(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each position; the last order - 1 positions hold bucket 0."""
    n = len(codes) - order + 1
    out = np.zeros(len(codes), np.int32)
    if n > 0:
        x = codes[:n] + _SALTS[3] * np.uint32(order)
        for k in range(1, order):
            x = x * _SALTS[0] + codes[k : k + n]
        out[:n] = mixed(x, bits)
    return out


def groups(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of consecutive texts with about `most` characters each (one text may have more)."""
    found, start, total = [], 0, 0
    for k, n in enumerate(sizes):
        if total + n > most and k > start:
            found.append((start, k))
            start, total = k, 0
        total += n
    if start < len(sizes):
        found.append((start, len(sizes)))
    return found
