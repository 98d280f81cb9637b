"""Best-fit packing of documents into training sequences with large-item matching."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from ._text import word_counts

CAPACITY = 2048
#: Pieces of one length are numbered in independent parts of about so many.
PART_ROWS = 1 << 17
_RANK_BITS = 40


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Where the items of each length go, and the number of bins.

    histogram: items of each length from 1 to capacity.  Documents of one
    length are interchangeable, so the plan is made for counts: its size and
    cost depend on the capacity, not on the number of documents.

    Returns rows (length, first rank, items, first bin, items a bin, offset of
    the first item in a bin).  Items longer than capacity / 3 come first, at
    most two a bin: each, by falling length, is matched with the longest other
    one that fits.  Shorter ones follow by falling length, each into the bin
    with the smallest gap that holds it (the lowest bin of these), else into a
    new bin.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # gap, first bin, bins; sorted
    bins = 0

    def put(length: int, items: int, first: int, each: int, offset: int) -> None:
        out.append((length, rank[length], items, first, each, offset))
        rank[length] += items
        left[length] -= items

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = bisect_left(large, capacity - a + 1) - 1
        while k >= 0 and (not left[large[k]] or (large[k] == a and left[a] < 2)):
            if not left[large[k]]:
                large.pop(k)
            k -= 1
        if k < 0:
            m, fill = left[a], a
            put(a, m, bins, 1, 0)
        elif large[k] == a:
            m, fill = left[a] // 2, 2 * a
            put(a, 2 * m, bins, 2, 0)
        else:
            b = large[k]
            m, fill = min(left[a], left[b]), a + b
            put(a, m, bins, 1, 0)
            put(b, m, bins, 1, a)
        if fill < capacity:
            insort(gaps, (capacity - fill, bins, m))
        bins += m
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            k = bisect_left(gaps, (s, -1, -1))
            if k < len(gaps):
                gap, first, m = gaps.pop(k)
            else:
                gap, first = capacity, bins
                m = -(-left[s] // (capacity // s))
                bins += m
            each = gap // s
            full = min(m, left[s] // each)
            if full:
                put(s, full * each, first, each, capacity - gap)
                if gap - each * s:
                    insort(gaps, (gap - each * s, first, full))
            rest = left[s] if full < m else 0
            if rest:
                put(s, rest, first + full, rest, capacity - gap)
                if gap - rest * s:
                    insort(gaps, (gap - rest * s, first + full, 1))
                full += 1
            if full < m:
                insort(gaps, (gap, first + full, m - full))
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 6), bins


def _lengths(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(word_counts(batch.column("text")))], names=["doc_id", "n_tokens"])


def pack(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the documents' tokens (white-space words) into bins of `capacity` tokens.

    A document longer than the capacity is cut into full pieces and a rest.
    Returns a row for each piece: doc_id, piece, start (its first token in the
    document), n_tokens, bin_id and bin_offset.  Bins are numbered from 0; the
    plan (see plan_bins) is exact for the whole table and is found from the
    histogram of lengths; rows meet it through their rank in their length,
    by hash part, doc_id and piece.  A length has as many parts as its number
    of pieces asks for, so the many full pieces of long documents are spread.

    Documents with null, empty or white text have one row with n_tokens 0 and
    a null bin.  Repeated rows and ids are packed as often as they occur;
    which of several rows with one id and length comes first is left open.
    Other columns are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_lengths, f"doc_id {id_type}, n_tokens bigint")
    counted = written(counted, "pack-lengths")
    c = F.lit(capacity).cast("bigint")
    pieces = counted.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("n_tokens") / c) - 1, F.lit(0).cast("bigint")))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * c).alias("start"), F.least(F.col("n_tokens") - F.col("piece") * c, c).alias("n_tokens"))
    sizes = dict(map(tuple, pieces.groupBy("n_tokens").count().collect()))  # capacity + 1 rows at most
    parts = [-(-sizes.get(n, 0) // PART_ROWS) or 1 for n in range(capacity + 1)]
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.get(F.lit(parts), F.col("n_tokens").cast("int"))).cast("int"))
    counts = pieces.where("n_tokens > 0").groupBy("n_tokens", "salt").count().collect()  # a row for each part: capacity + pieces / PART_ROWS at most
    histogram: dict[int, int] = {}
    offset = {}
    for n, salt, count in sorted(map(tuple, counts)):
        offset[n, salt] = histogram.get(n, 0)
        histogram[n] = histogram.get(n, 0) + count
    plan, _ = plan_bins(histogram, capacity)
    first_part = np.cumsum([0, *parts])
    before = np.zeros(first_part[-1], np.int64)
    for (n, salt), k in offset.items():
        before[first_part[n] + salt] = k
    shared = spark.sparkContext.broadcast((plan, before, first_part))

    def place(batches):
        rows, first, first_part = shared.value
        keys = (rows[:, 0] << _RANK_BITS) | rows[:, 1]
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            rank = first[first_part[n] + batch.column("salt").to_numpy()] + batch.column("rn").to_numpy() - 1
            none = n == 0
            if len(rows):
                r = rows[np.maximum(np.searchsorted(keys, (n << _RANK_BITS) | rank, side="right") - 1, 0)]
                j = rank - r[:, 1]
                each = r[:, 4]
                bin_id, at = r[:, 3] + j // each, r[:, 5] + (j % each) * n
            else:
                bin_id = at = np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("piece"), batch.column("start"), batch.column("n_tokens"), pa.array(bin_id, mask=none), pa.array(at, mask=none)],
                names=["doc_id", "piece", "start", "n_tokens", "bin_id", "bin_offset"],
            )

    from pyspark.sql import Window

    w = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("rn", F.row_number().over(w))
    return ranked.mapInArrow(place, f"doc_id {id_type}, piece bigint, start bigint, n_tokens bigint, bin_id bigint, bin_offset bigint")
