"""Presence of byte n-grams, as bit vectors."""

from __future__ import annotations

import numpy as np

#: Multipliers that hash n-grams of one, two and three bytes into the same table.
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def presence(text: str, dims: int, spectrum: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Bits of the n-grams in the whole text, lower-cased and padded with a blank; dims is a power of two, 2**24 at most."""
    raw = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    bits = np.zeros(dims, dtype=bool)
    shift = np.uint32(32 - dims.bit_length() + 1)
    code = np.zeros(len(raw), dtype=np.uint32)
    for n in range(1, max(spectrum) + 1):
        code = (code[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1 :]
        if n in spectrum:
            bits[(code * _MIX[n - 1] + np.uint32(n)) >> shift] = True
    return bits


def packed(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def unpacked(rows: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(rows), dtype=np.uint8)).reshape(len(rows), -1).astype(np.float32)


def presence_by_segment(text: str, dims: int, width: int, spectrum: tuple[int, ...] = (1, 2, 3)) -> tuple[np.ndarray, np.ndarray]:
    """(bits, bytes) of each segment of width bytes of the whole text; an n-gram belongs to the segment it starts in."""
    raw = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    count = max(1, len(raw) // width)
    at = np.minimum(np.arange(len(raw)) // width, count - 1) * dims  # what is left over joins the last segment
    bits = np.zeros(count * dims, dtype=bool)
    shift = np.uint32(32 - dims.bit_length() + 1)
    code = np.zeros(len(raw), dtype=np.uint32)
    for n in range(1, max(spectrum) + 1):
        code = (code[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1 :]
        if n in spectrum:
            bits[at[: len(code)] + ((code * _MIX[n - 1] + np.uint32(n)) >> shift)] = True
    return bits.reshape(count, dims), np.bincount(at // dims, minlength=count)
