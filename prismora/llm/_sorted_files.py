"""Sorted key files in the shared folder: written by tasks, mapped into memory by others."""

from __future__ import annotations

import io
import os

import numpy as np

from ._shared import put_file


def _dump(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def put_shard(folder: str, shard: int, keys: np.ndarray, values: np.ndarray) -> None:
    """The sorted keys of one range and the value of each."""
    put_file(f"{folder}/v-{shard:07d}.npy", _dump(values))
    put_file(f"{folder}/k-{shard:07d}.npy", _dump(keys))


def shard_of(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Ranges of equal width over keys of so many bits; rises with the key."""
    return ((keys >> np.uint64(bits - 20)) * np.uint64(shards)) >> np.uint64(20)


class SortedFiles:
    """Values by key over all ranges of a folder; a range is mapped when first asked for."""

    def __init__(self, folder: str, bits: int, shards: int):
        self.folder, self.bits, self.shards = folder, bits, shards
        self._open: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}

    def _shard(self, s: int):
        if s not in self._open:
            path = f"{self.folder}/k-{s:07d}.npy"
            if os.path.exists(path):
                self._open[s] = np.load(path, mmap_mode="r"), np.load(f"{self.folder}/v-{s:07d}.npy", mmap_mode="r")
            else:
                self._open[s] = None
        return self._open[s]

    def get(self, keys: np.ndarray, default: int = 0) -> np.ndarray:
        """Values of sorted keys."""
        out = np.full(len(keys), default, np.int64)
        if not len(keys):
            return out
        shard = shard_of(keys, self.bits, self.shards)
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        for i, j in zip(cuts, np.r_[cuts[1:], len(keys)]):
            if (found := self._shard(int(shard[i]))) is None or not len(found[0]):
                continue
            k, v = found
            at = np.searchsorted(k, keys[i:j])
            at[at == len(k)] = 0
            hit = k[at] == keys[i:j]
            out[i:j][hit] = v[at[hit]]
        return out

    def all(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among sorted keys, and values, of all entries there are of them; files may hold a key several times."""
        at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        shard = shard_of(keys, self.bits, self.shards)
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(keys) else []
        for i, j in zip(cuts, np.r_[cuts[1:], len(keys)] if len(keys) else []):
            if (got := self._shard(int(shard[i]))) is None:
                continue
            k, v = got
            lo = np.searchsorted(k, keys[i:j], side="left")
            n = np.searchsorted(k, keys[i:j], side="right") - lo
            at.append(np.repeat(np.arange(i, j), n))
            found.append(v[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        return np.concatenate(at), np.concatenate(found)
