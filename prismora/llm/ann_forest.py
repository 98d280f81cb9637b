"""Nearest neighbours of all vectors by a forest of hash prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from ._vectors import VectorFiles, arrow_ids, id_type, put_vectors

K = 10
TREES = 64
BITS = 62
#: Most a k-th neighbour may be missed with, by the collision probabilities.
MISS = 0.1
#: Trees and neighbours on either side in them that are looked at before ascending.
FIRST_TREES = 8
WINDOW = 256
#: Vectors that a block of a tree's sorted array has, about.
BLOCK = 8192


def hash_strings(x: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """For each vector and tree a string of BITS signs of random projections, the first bit highest."""
    out = np.empty((len(x), trees), np.int64)
    weight = np.left_shift(np.int64(1), np.arange(BITS - 1, -1, -1, dtype=np.int64))
    for t in range(trees):
        a = np.random.default_rng([seed, t]).standard_normal((x.shape[1], BITS)).astype(np.float32)
        out[:, t] = ((x @ a) > 0) @ weight
    return out


def depth_for(cosine: np.ndarray, trees: int, miss: float) -> np.ndarray:
    """The longest prefix at which a neighbour of that cosine is missed by all trees with probability `miss` at most."""
    p = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    need = 1 - miss ** (1 / trees)
    with np.errstate(divide="ignore"):
        d = np.floor(np.log(need) / np.log(np.clip(p, 1e-12, 1 - 1e-12)))
    return np.clip(d, 0, BITS).astype(np.int64)


def _best(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int):
    """The k best (query, row, cosine) of each query, each row once, by query and rank."""
    q, r, s = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((r, q))
    q, r, s = q[order], r[order], s[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1])
    q, r, s = q[new], r[new], s[new]
    order = np.lexsort((r, -s, q))
    q, r, s = q[order], r[order], s[order]
    head = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(head, np.diff(np.r_[head, len(q)]))
    top = rank < k
    return q[top], r[top], s[top], rank[top]


def _over(s: np.ndarray, least: np.ndarray, query: np.ndarray, row: np.ndarray, k: int):
    """Pairs of a similarity block that reach their query's bound, k a query at most (and ties)."""
    if s.shape[1] > k:
        bound = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
    else:
        bound = least
    i, j = np.nonzero(s >= bound[:, None])
    return query[i], row[j], s[i, j]


def nearest(df: DataFrame, k: int = K, trees: int = TREES, miss: float = MISS, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest neighbours by cosine of every vector.

    Each tree is the array of all vectors sorted by a string of 62 hash bits,
    cut into blocks by prefix.  First every query descends in some trees to
    its longest prefix matches, the vectors beside it in the sorted array; the
    k-th best cosine found bounds that of its true neighbours from below.
    Then all trees ascend together to the longest common depth at which a
    neighbour of that cosine shares the prefix in some tree with probability
    1 - miss, and every vector under these prefixes is compared exactly: no
    limit on candidates, and as many as the recall needs.  A task holds about
    BLOCK vectors, however many have one hash.

    Returns vec_id, neighbor_id, rank (from 1) and cosine; ties are ordered by
    row.  Ids are integers (bigint in the result) or texts, others a TypeError.
    Null ids and null, zero, non-finite or odd-length vectors neither
    ask nor answer; of rows that repeat an id the least vector counts; equal
    vectors of different ids are neighbours.  With k vectors or fewer each has
    all others.  An empty table gives an empty result.  Other columns are not
    read.
    """

    def strings(x):
        h = hash_strings(x, trees, seed)
        return [pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, trees, dtype=np.int32)), pa.array(h.reshape(-1)))]

    kind = id_type(df, id_col)
    folder, _, rows = put_vectors(df, id_col, vector_col, strings, "hashes array<bigint>", "ann-vectors")
    n = rows.count()
    base = max(0, int(np.ceil(np.log2(max(n, 1) / BLOCK))))
    block = lambda h: F.shiftright(h, BITS - base) if base else F.lit(0).cast("bigint")

    def descend(key, table):
        files = VectorFiles(folder)
        order = np.lexsort((table.column("row").to_numpy(), table.column("hash").to_numpy()))
        row = table.column("row").to_numpy()[order]
        x = files.vectors(row)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for lo in range(0, len(row), WINDOW):
            hi, a, b = min(lo + WINDOW, len(row)), max(lo - WINDOW, 0), min(lo + 2 * WINDOW, len(row))
            s = x[lo:hi] @ x[a:b].T
            s[np.arange(hi - lo), np.arange(lo - a, hi - a)] = -2
            found.append(_over(s, np.full(hi - lo, -1.5, np.float32), row[lo:hi], row[a:b], k))
        q, r, s, _ = _best(found, k)
        return pa.table({"query": q, "near": r, "cosine": s.astype(np.float32)})

    def merge(key, table):
        q, r, s, rank = _best([(table.column("query").to_numpy(), table.column("near").to_numpy(), table.column("cosine").to_numpy())], k)
        return pa.table({"query": q, "near": r, "cosine": s, "rank": (rank + 1).astype(np.int32)})

    groups = F.pmod(F.xxhash64("query"), F.lit(max(1, -(-n // 4096)))).alias("g")
    merged_type = "query bigint, near bigint, cosine float, rank int"
    # Where hashes are equal or cluster, a block is cut into parts by row; its queries go to all of them.
    every = rows.select("row", F.posexplode("hashes").alias("tree", "hash"))
    large = written(every.groupBy("tree", block(F.col("hash")).alias("b")).count().where(F.col("count") > 2 * BLOCK).select("tree", "b", F.ceil(F.col("count") / BLOCK).alias("parts")), "ann-large")
    split = not large.isEmpty()

    def in_parts(df, all_of_them: bool):
        if not split:
            return df.withColumn("part", F.lit(0).cast("bigint"))
        n = F.coalesce("parts", F.lit(1).cast("bigint"))
        part = F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)) if all_of_them else F.pmod(F.xxhash64("row"), n)
        return df.join(large, ["tree", "b"], "left").withColumn("part", part).drop("parts")

    some = in_parts(every.where(F.col("tree") < FIRST_TREES).withColumn("b", block(F.col("hash"))), False)
    first = some.groupBy("tree", "b", "part").applyInArrow(descend, "query bigint, near bigint, cosine float")
    first = written(first.groupBy(groups).applyInArrow(merge, merged_type), "ann-first")
    bound = first.groupBy("query").agg(F.min("cosine").alias("least"), F.count("*").alias("found"))

    @F.pandas_udf("int")
    def depth(least, found):
        import pandas as pd

        return pd.Series(np.where(found.to_numpy() < k, 0, depth_for(least.fillna(-1).to_numpy(), trees, miss)).astype(np.int32))

    asking = rows.join(bound, rows["row"] == bound["query"], "left")
    asking = asking.select("row", "hashes", F.coalesce("least", F.lit(-1.5)).cast("float").alias("least"), depth(F.coalesce("least", F.lit(-1.0)), F.coalesce("found", F.lit(0))).alias("depth"))
    spread = asking.select("row", "least", "depth", F.posexplode("hashes").alias("tree", "hash"))
    points = spread.select("tree", block(F.col("hash")).alias("b"), "row", "hash", F.lit(None).cast("float").alias("least"), F.lit(None).cast("int").alias("depth"))
    # A query that ascends above the blocks' root goes to all blocks under its prefix.
    span = F.expr(f"shiftleft(1L, greatest({base} - depth, 0))")
    low = F.expr(f"shiftleft(shiftright({'shiftright(hash, %d)' % (BITS - base) if base else '0L'}, greatest({base} - depth, 0)), greatest({base} - depth, 0))")
    asked = spread.select("tree", F.explode(F.sequence(low, low + span - 1)).alias("b"), "row", "hash", "least", "depth")

    def ascend(key, table):
        files = VectorFiles(folder)
        row, h = table.column("row").to_numpy(), table.column("hash").to_numpy()
        is_query = np.asarray(table.column("depth").is_valid())
        order = np.flatnonzero(~is_query)
        order = order[np.lexsort((row[order], h[order]))]
        prow, ph = row[order], h[order]
        q = np.flatnonzero(is_query)
        empty = pa.table({"query": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "cosine": pa.array([], pa.float32())})
        if not len(prow) or not len(q):
            return empty
        qrow, qh, least = row[q], h[q], table.column("least").to_numpy()[q].astype(np.float32)
        shift = BITS - table.column("depth").to_numpy()[q].astype(np.int64)
        lo = np.searchsorted(ph, (qh >> shift) << shift, side="left")
        hi = np.searchsorted(ph, ((qh >> shift) << shift) + (np.int64(1) << shift) - 1, side="right")
        some = hi - lo > 0
        qrow, least, lo, hi = qrow[some], least[some], lo[some], hi[some]
        if not len(qrow):
            return empty
        x = files.vectors(prow)
        qx = files.vectors(qrow)
        by = np.lexsort((hi, lo))
        qrow, least, lo, hi, qx = qrow[by], least[by], lo[by], hi[by], qx[by]
        cuts = np.flatnonzero(np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for i, j in zip(cuts, np.r_[cuts[1:], len(qrow)]):
            a, b = lo[i], hi[i]
            if b - a == 1 and j - i == 1 and prow[a] == qrow[i]:
                continue
            for c in range(i, j, 512):
                d = min(c + 512, j)
                s = qx[c:d] @ x[a:b].T
                s[qrow[c:d, None] == prow[None, a:b]] = -2
                found.append(_over(s, least[c:d], qrow[c:d], prow[a:b], k))
        fq, fr, fs, _ = _best(found, k)
        return pa.table({"query": fq, "near": fr, "cosine": fs.astype(np.float32)})

    rest = in_parts(points, False).unionByName(in_parts(asked, True)).groupBy("tree", "b", "part").applyInArrow(ascend, "query bigint, near bigint, cosine float")
    both = first.select("query", "near", "cosine").unionByName(rest)

    def finish(key, table):
        files = VectorFiles(folder)
        got = merge(key, table)
        ids = [arrow_ids(files.ids(got.column(c).to_numpy()), kind) for c in ("query", "near")]
        return pa.table({"vec_id": ids[0], "neighbor_id": ids[1], "rank": got.column("rank"), "cosine": np.clip(got.column("cosine").to_numpy(), -1, 1).astype(np.float64)})

    return both.groupBy(groups).applyInArrow(finish, f"vec_id {kind}, neighbor_id {kind}, rank int, cosine double")
