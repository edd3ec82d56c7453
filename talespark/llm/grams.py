"""Hashed byte n-grams of whole texts, vectorised over the bytes of a text."""

from __future__ import annotations

import numpy as np


def hashed_grams(data: bytes, orders: tuple[int, ...], bits: int, salt: int = 0) -> np.ndarray:
    """Bucket numbers (0 to 2**bits - 1) of all byte n-grams of the given orders."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    h, found = np.full(len(b), (0x811C9DC5 + salt * 0x85EBCA6B) & 0xFFFFFFFF, np.uint32), []
    for n in range(1, min(max(orders), len(b)) + 1):
        h = (h[: len(b) - n + 1] ^ b[n - 1 :]) * np.uint32(0x01000193)  # of the first n bytes at each place
        if n in orders:
            mixed = h ^ (h >> np.uint32(15))
            mixed *= np.uint32(0x2C1B3C6D)
            mixed >>= np.uint32(32 - bits)
            found.append(mixed)
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
