"""Near-duplicate embeddings by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected
from ._forest import Forest
from ._shared import release, written
from ._text import U64, mix64
from ._vectors import VectorFiles, arrow_ids, id_type, put_vectors

THRESHOLD = 0.9
TABLES = 40
HASHES = 10
WIDTH = 1.5
#: Vectors that one task looks at in one table, about.
PART_ROWS = 16384


def bucket_keys(x: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """For each vector and table one 64-bit key of its quantised projections."""
    rng = np.random.default_rng(seed)
    a = rng.standard_normal((x.shape[1], tables * hashes))
    b = rng.random(tables * hashes) * width
    cells = np.floor((x.astype(np.float64) @ a + b) / width).astype(np.int64).view(U64).reshape(len(x), tables, hashes)
    key = np.zeros((len(x), tables), U64)
    for k in range(hashes):
        key = mix64(key * U64(0x9E3779B97F4A7C15) + cells[:, :, k])
    return key.view(np.int64)


def _near(df: DataFrame, threshold: float, tables: int, hashes: int, width: float, seed: int, id_col: str, vector_col: str, classes: bool) -> tuple[DataFrame, str, DataFrame]:
    """The rows of usable vectors, the folder of their files, and the pairs or, for classes, links (u, v) between rows that connect what pairs do."""

    def keys(x):
        k = bucket_keys(x, tables, hashes, width, seed)
        return [pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, tables, dtype=np.int32)), pa.array(k.reshape(-1)))]

    kind = id_type(df, id_col)
    folder, _, rows = put_vectors(df, id_col, vector_col, keys, "keys array<bigint>", "dedup-vectors")
    parts = max(1, -(-rows.count() // PART_ROWS))
    spread = rows.select("row", F.posexplode("keys").alias("table", "key"))
    # A bucket of more rows than a task takes is cut into groups by row; two groups meet in each task.
    large = written(spread.groupBy("table", "key").count().where(F.col("count") > PART_ROWS).select("table", "key", F.ceil(2 * F.col("count") / PART_ROWS).alias("groups")), "dedup-large")
    none = F.lit(-1).cast("bigint")
    if large.isEmpty():
        spread = spread.select("row", "table", "key", F.pmod("key", F.lit(parts)).alias("part"), none.alias("low"), none.alias("high"), none.alias("side"))
    else:
        spread = spread.join(large, ["table", "key"], "left").withColumn("side", F.when(F.col("groups").isNotNull(), F.pmod(F.xxhash64("row"), F.col("groups"))).otherwise(none))
        spread = spread.withColumn("other", F.explode(F.when(F.col("groups").isNotNull(), F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)).otherwise(F.array(none))))
        part = F.when(F.col("groups").isNull(), F.pmod("key", F.lit(parts))).otherwise(F.col("key"))
        spread = spread.select("row", "table", "key", part.alias("part"), F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side")

    def pairs(key, members):
        table, cross = key[0].as_py(), key[2].as_py() != key[3].as_py()
        files = VectorFiles(folder)
        order = np.lexsort((members.column("row").to_numpy(), members.column("key").to_numpy()))
        row, bucket, side = (members.column(c).to_numpy()[order] for c in ("row", "key", "side"))
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        length = np.diff(np.r_[start, len(bucket)])
        some = np.repeat(length > 1, length)
        row, side = row[some], side[some]
        length = length[length > 1]
        start = np.cumsum(length) - length
        x = files.vectors(row)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        linked = Forest(len(row))

        def checked(i, j, s):
            if classes:
                near = s.astype(np.float64) >= threshold
                linked.add(i[near], j[near])
                return
            near = (s >= threshold - 1e-6) & (side[i] != side[j]) if cross else s >= threshold - 1e-6
            out.append((i[near], j[near], s[near]))

        # Small buckets together, each member with its later ones; large ones by blocks of a product.
        small = length <= 64
        at = np.repeat(start[small], length[small])
        size = np.repeat(length[small], length[small])
        place = np.arange(len(at)) - np.repeat(np.cumsum(length[small]) - length[small], length[small])
        at, after = at + place, size - 1 - place
        ends = np.cumsum(after)
        lo = 0
        while lo < len(at):
            hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 17), side="right")), lo + 1)
            m = after[lo:hi]
            i = np.repeat(at[lo:hi], m)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
            checked(i, j, np.einsum("ij,ij->i", x[i], x[j]))
            lo = hi
        for a, n in zip(start[~small], length[~small]):
            for lo in range(a, a + n, 1024):
                hi = min(lo + 1024, a + n)
                s = x[lo:hi] @ x[lo : a + n].T
                i, j = np.nonzero(s >= threshold - 1e-6)
                later = j > i
                i, j = i[later], j[later]
                checked(i + lo, j + lo, s[i, j])
        if classes:
            root = linked.roots()
            i = np.flatnonzero(root != np.arange(len(root)))
            u, v = row[i], row[root[i]]
            release()
            return pa.table({"u": pa.array(u), "v": pa.array(v)})
        i, j, s = (np.concatenate(c) for c in zip(*out))
        if table and len(i):
            u, back = np.unique(np.r_[i, j], return_inverse=True)
            k = bucket_keys(x[u], tables, hashes, width, seed)[:, :table]
            first = np.ones(len(i), bool)
            for lo in range(0, len(i), 65536):
                sl = slice(lo, lo + 65536)
                first[sl] = ~(k[back[: len(i)][sl]] == k[back[len(i) :][sl]]).any(1)
            i, j, s = i[first], j[first], s[first]
        ids = files.ids(row)
        a, b = ids[i], ids[j]
        release()
        return pa.table({"vec_a": arrow_ids(np.where(a < b, a, b), kind), "vec_b": arrow_ids(np.where(a < b, b, a), kind), "cosine": np.minimum(s, 1).astype(np.float64)})

    units = spread.groupBy("table", "part", "low", "high")
    if classes:
        return rows, folder, units.applyInArrow(pairs, "u bigint, v bigint")
    return rows, folder, units.applyInArrow(pairs, f"vec_a {kind}, vec_b {kind}, cosine double").where(F.col("cosine") >= threshold)


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Pairs of vectors whose cosine reaches the threshold.

    Each normalised vector falls into one bucket of every table: `hashes`
    quantised projections on normal (2-stable) directions.  Vectors that share
    a bucket are checked exactly, all of them against all, those of very large
    ones group against group in several tasks; a pair is given by the first
    table that holds it, so nothing needs to be made distinct.  With
    the defaults a pair at cosine 0.9 is missed with probability 0.07, at 0.95
    with 1e-3, at 0.99 with 1e-9.

    Returns vec_a < vec_b and cosine.  Ids are integers (bigint in the result)
    or texts, others a TypeError.  Null ids and null, zero, non-finite or
    odd-length vectors have no pairs; of rows that repeat an id the least
    vector counts; equal vectors of different ids are pairs with cosine 1.  An
    empty table gives an empty result.  Other columns are not read.
    """

    return _near(df, threshold, tables, hashes, width, seed, id_col, vector_col, False)[2]


def near_classes(df: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each vector with its class: what chains of pairs of near_duplicates() connect, by the least id in it.

    All vectors of a bucket are checked against all as there; of a task's
    pairs only the links of a spanning forest leave it, so the result grows
    with the vectors and not with the square of a group of copies.  A pair
    that the hashing misses (see there) is still in one class where a chain of
    others connects it.

    Returns vec_id and class_id, a row for each id that isn't null; ids are
    treated as near_duplicates() says.  Null, zero, non-finite or odd-length
    vectors are classes of their own.  An empty table gives an empty result.
    Other columns are not read.
    """
    kind = id_type(df, id_col)
    rows, folder, links = _near(df, threshold, tables, hashes, width, seed, id_col, vector_col, True)

    def named(batches):
        files = VectorFiles(folder)
        for batch in batches:
            r = batch.column("row").to_numpy()
            yield pa.RecordBatch.from_arrays([arrow_ids(files.ids(r), kind), batch.column("row")], names=["vec_id", "row"])

    known = rows.select("row").mapInArrow(named, f"vec_id {kind}, row bigint")
    grouped = known.join(connected(links), F.col("row") == F.col("node"), "left").select("vec_id", F.coalesce("root", "row").alias("grp"))
    least = grouped.groupBy("grp").agg(F.min("vec_id").alias("class_id"))
    found = grouped.join(least, "grp").select("vec_id", "class_id")
    ids = df.select(F.col(f"`{id_col}`").cast(kind).alias("vec_id")).where("vec_id is not null").distinct()
    return ids.join(found, "vec_id", "left").select("vec_id", F.coalesce("class_id", "vec_id").alias("class_id"))
