"""Normalised vectors as memory-mapped files in the shared folder, addressed by row number."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import local_path, new_folder, put_file, written

_ROW_BITS = 32


class VectorFiles:
    """Vectors and ids of rows (file number << 32 | place in the file)."""

    def __init__(self, folder: str):
        self.folder = folder
        self._open: dict[tuple[str, int], np.ndarray] = {}

    def _file(self, kind: str, k: int) -> np.ndarray:
        if (kind, k) not in self._open:
            self._open[kind, k] = np.load(f"{self.folder}/{kind}-{k:07d}.npy", mmap_mode="r")
        return self._open[kind, k]

    def _get(self, kind: str, rows: np.ndarray) -> np.ndarray:
        files = rows >> _ROW_BITS
        order = np.argsort(files, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(files[order]) != 0]) if len(rows) else []
        out = None
        for i, j in zip(cuts, np.r_[cuts[1:], len(rows)] if len(rows) else []):
            at = order[i:j]
            got = self._file(kind, int(files[at[0]]))[rows[at] & ((1 << _ROW_BITS) - 1)]
            if out is None or out.dtype.itemsize < got.dtype.itemsize:  # longer texts than so far
                out = np.empty((len(rows), *got.shape[1:]), got.dtype) if out is None else out.astype(got.dtype)
            out[at] = got
        return np.zeros((0, 1), np.float32) if out is None else out

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return self._get("x", rows)

    def ids(self, rows: np.ndarray) -> np.ndarray:
        return self._get("id", rows) if len(rows) else np.zeros(0, np.int64)


def id_type(df: DataFrame, id_col: str) -> str:
    """bigint for integers, string for texts; other ids are an error."""
    kind = df.schema[id_col].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return "bigint"
    if kind == "string":
        return kind
    raise TypeError(f"{id_col}: ids are integers or texts, not {kind}")


def arrow_ids(ids: np.ndarray, kind: str) -> pa.Array:
    return pa.array(ids.tolist(), pa.string()) if kind == "string" else pa.array(ids.astype(np.int64))


def dimension(df: DataFrame, id_col: str, vector_col: str) -> int:
    """The length that most vectors have (the larger of two as common); 0 where there are none."""
    v = F.col(f"`{vector_col}`")
    got = df.where(F.col(f"`{id_col}`").isNotNull() & (F.size(v) > 0)).groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return int(got[0]["d"]) if got else 0


def put_vectors(df: DataFrame, id_col: str, vector_col: str, hashes, names: str, what: str) -> tuple[str, int, DataFrame]:
    """Write the usable vectors, and a table of row and hashes(vectors) as columns `names`.

    Left out: null ids, null vectors, those of another length than most, with
    null, infinite or NaN parts, or of no length.  Of an id's several vectors
    the least counts.  Files hold rows by id, so a repeated task writes the
    same file again.
    """
    spark = df.sparkSession
    dim, kind = dimension(df, id_col, vector_col), id_type(df, id_col)
    v = F.col(f"`{vector_col}`")
    own = df.where(F.col(f"`{id_col}`").isNotNull() & (F.size(v) == dim)).select(F.col(f"`{id_col}`").cast(kind).alias("id"), v.cast("array<float>").alias("v"))
    own = own.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    own = own.groupBy("id").agg(F.min("v").alias("v")).sortWithinPartitions("id")
    folder = local_path(new_folder(spark, what))

    def run(batches):
        from pyspark import TaskContext

        k, ids, rows = TaskContext.get().partitionId(), [], []
        for batch in batches:
            if batch.num_rows:
                flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                flat /= np.abs(flat).max(1, keepdims=True)
                rows.append((flat / np.sqrt((flat * flat).sum(1, keepdims=True))).astype(np.float32))
                ids.append(np.array(batch.column("id").to_pylist(), str) if kind == "string" else batch.column("id").to_numpy())
        if not rows:
            return
        x, i = np.concatenate(rows), np.concatenate(ids)
        for what, a in (("x", x), ("id", i)):
            out = io.BytesIO()
            np.save(out, a, allow_pickle=False)
            put_file(f"{folder}/{what}-{k:07d}.npy", out.getvalue())
        row = (np.int64(k) << _ROW_BITS) + np.arange(len(x))
        for lo in range(0, len(x), 4096):
            cols = hashes(x[lo : lo + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(row[lo : lo + 4096]), *[pa.array(c) if not isinstance(c, pa.Array) else c for c in cols]], names=["row", *[x.split()[0] for x in names.split(", ")]])

    return folder, dim, written(own.mapInArrow(run, f"row bigint, {names}"), what)
