"""Numbers as compressed bytes for shuffles and stored tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that small numbers compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def from_planes(raw: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeeze(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def loosen(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def pack(x: np.ndarray) -> bytes:
    return squeeze(planes(x))


def unpack(raw: bytes, kind) -> np.ndarray:
    return from_planes(loosen(raw), kind)
