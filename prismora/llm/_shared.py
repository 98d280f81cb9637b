"""The folder that all executors share, and packed arrays that travel in rows."""

from __future__ import annotations

import ctypes
import os
import uuid

import numpy as np
import pyarrow as pa

from ..cluster import new_folder, shared_dir, written

__all__ = ["local_path", "new_folder", "planes", "put_file", "release", "shared_dir", "squeeze", "unplanes", "unsqueeze", "written"]


def local_path(uri: str) -> str:
    """The mounted path of a folder whose files are mapped into memory."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"{uri}: memory-mapped levels need a mounted shared folder")
    return uri


def put_file(path: str, data: bytes | np.ndarray) -> None:
    """Write a whole file or nothing, so that a repeated task attempt is harmless."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        f.write(data.tobytes() if isinstance(data, np.ndarray) else data)
    os.replace(tmp, path)


def planes(values: np.ndarray) -> bytes:
    """Non-negative 64-bit integers as compressed byte planes."""
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8).T.copy()
    return len(values).to_bytes(8, "little") + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def unplanes(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(8, n).T.copy().view("<i8").reshape(-1)


def squeeze(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as compressed byte planes of their differences."""
    d = keys.astype(np.uint64)
    d[1:] -= keys[:-1].astype(np.uint64)
    return planes(d)


def unsqueeze(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob).view(np.uint64), dtype=np.uint64)


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on after a large group."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
