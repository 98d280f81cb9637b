import hashlib
import math
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from prismora.llm import line_dedup, packing, source_mixing
from pyspark.sql import functions as F

from ..oracle import connect, rows_of, rows_of_sql
from .common import ODD, empty, odd

SF = "/root/testdata/sf0.001"


# == lines


def decoded(bitmap):
    out, keep = [], True
    for n in map(int, bitmap.split(",") if bitmap else []):
        out += [keep] * n
        keep = not keep
    return out


def test_line_bitmaps_odd(spark):
    got = {(r["doc_id"], r["text_hash"]): r for r in line_dedup.line_bitmaps(odd(spark)).collect()}
    by_id = {k[0]: r for k, r in got.items()}
    assert len(got) == 9  # the repeated row is one
    assert decoded(by_id[1]["bitmap"]) == [True] * 4
    assert decoded(by_id[2]["bitmap"]) == [False, True]
    assert (by_id[3]["n_lines"], by_id[3]["bitmap"]) == (0, "")
    assert decoded(by_id[4]["bitmap"]) == [True] and decoded(by_id[5]["bitmap"]) == [True, True]
    assert by_id[None]["n_kept"] == 1


def test_line_bitmaps_spread_over_ranges(spark):
    """One line that fills several ranges is kept once."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("hot\nhot").alias("text"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = line_dedup.line_bitmaps(docs)
        assert {r["doc_id"]: r["bitmap"] for r in got.where("n_kept > 0").collect()} == {0: "1,1"}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_dropped_lines(spark):
    docs = odd(spark)
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == docs.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[2]["text"] == "other line of two" and rows[2]["n_chars"] == 17 and rows[2]["keep"] == "extra"
    assert rows[1]["text"] == ODD[0][1] and rows[3]["text"] is None and rows[4]["text"] == "" and rows[6]["text"] == ODD[5][1]
    copy = spark.createDataFrame([(1, "a b\nc d"), (2, "a b\nc d"), (3, "c d\n\nnew")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(copy).collect()} == {1: "a b\nc d", 3: "\nnew"}
    assert line_dedup.drop_repeated_lines(empty(spark)).count() == 0 and line_dedup.line_bitmaps(empty(spark)).count() == 0


def test_lines_of_a_long_text_by_turns(spark):
    """Kept and dropped lines take turns 30,000 times; the stage is linear in them."""
    n = 30_000
    first = "\n".join(f"old line {i}" for i in range(n))
    second = "\n".join(x for i in range(n) for x in (f"new line {i}", f"old line {n - 1 - i}"))
    docs = spark.createDataFrame([(1, first), (2, second)], "doc_id bigint, text string")
    start = time.time()
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got == {1: first, 2: "\n".join(f"new line {i}" for i in range(n))}
    assert time.time() - start < 60


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "a b\nc d", "s"), (2, "a b\ne f g", "t"), (2, "a b\ne f g", "t"), (None, None, None)], ["my.id", "my.text", "my.source"])
    names = {"id_col": "my.id", "text_col": "my.text"}
    assert {r["doc_id"]: r["bitmap"] for r in line_dedup.line_bitmaps(docs, **names).collect()} == {1: "2", 2: "0,1,1", None: ""}
    got = line_dedup.drop_repeated_lines(docs, **names)
    assert got.columns == docs.columns and sorted(str(r["my.text"]) for r in got.collect()) == ["None", "a b\nc d", "e f g"]
    assert packing.pack(docs, **names).agg(F.sum("n_tokens")).first()[0] == 14
    assert source_mixing.mixture(docs, source_col="my.source", **names).count() == 4
    assert source_mixing.mix(docs, source_col="my.source", **names).columns == docs.columns


# == packing


def bins_by_hand(lengths, capacity):
    """Best fit item by item: the plan's definition."""
    gaps = []
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    while large:
        a = large.pop(0)
        fits = [b for b in large if a + b <= capacity]
        if fits:
            large.remove(max(fits))
        gaps.append(capacity - a - (max(fits) if fits else 0))
    for s in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            k = gaps.index(min(fits))
            gaps[k] -= s
        else:
            gaps.append(capacity - s)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(25))
def test_plan_equals_item_by_item(seed):
    r = np.random.default_rng(seed)
    capacity = int(r.integers(1, 60))
    lengths = r.integers(1, capacity + 1, int(r.integers(0, 150))).tolist()
    plan, bins = packing.plan_bins(Counter(lengths), capacity)
    used, placed = defaultdict(list), Counter()
    for n, rank, items, first, each, offset in plan.tolist():
        assert rank == placed[n]
        placed[n] += items
        for j in range(items):
            used[first + j // each].append((offset + j % each * n, n))
    assert placed == Counter(lengths) and len(used) == bins
    for items in used.values():
        at = 0
        for start, n in sorted(items):
            assert start == at
            at += n
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in items) <= 2
    assert sorted(capacity - sum(n for _, n in v) for v in used.values()) == bins_by_hand(lengths, capacity)


def test_pack_odd(spark):
    got = packing.pack(odd(spark), 100).collect()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert [r["n_tokens"] for r in by[3] + by[4] + by[5]] == [0, 0, 0] and by[3][0]["bin_id"] is None
    assert sorted(r["start"] for r in by[6]) == list(range(0, 30_000, 100)) and len(by[7]) == 2 and len(by[None]) == 1
    slots = [(r["bin_id"], r["bin_offset"] + k) for r in got if r["bin_id"] is not None for k in range(r["n_tokens"])]
    assert len(slots) == len(set(slots)) and max(s for _, s in slots) < 100
    assert packing.pack(empty(spark)).count() == 0


def test_pack_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs, 512).where("bin_id is not null").collect()
    whole = Counter()
    for r in got:
        whole[r["doc_id"]] += r["n_tokens"]
    assert whole == {r["doc_id"]: len(r["text"].split()) for r in docs.collect() if r["text"].split()}
    assert len({r["bin_id"] for r in got}) == len(bins_by_hand([r["n_tokens"] for r in got], 512))


def test_pack_in_many_parts(spark, monkeypatch):
    """However many parts a length is numbered in, the bins are those of the plan and no two pieces meet."""
    monkeypatch.setattr(packing, "PART_ROWS", 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs, 64).where("bin_id is not null").collect()
    slots = [(r["bin_id"], r["bin_offset"] + k) for r in got for k in range(r["n_tokens"])]
    assert len(slots) == len(set(slots)) and max(s for _, s in slots) < 64
    assert len({r["bin_id"] for r in got}) == len(bins_by_hand([r["n_tokens"] for r in got], 64))


# == mixing


def test_query_equals_sql(spark):
    from prismora.llm.queries import OP9_WEIGHTED_SQL, op9_source_mixing

    assert rows_of(op9_source_mixing(spark, SF)) == rows_of_sql(connect(SF), OP9_WEIGHTED_SQL)[0]


def test_weight_column(spark):
    """Keys are -ln(u) / weight; null and NaN count as 1, small and negative weights as the least."""
    weights = [None, float("nan"), 1.0, 0.0, -3.0, 0.01, 0.4, 5.0]
    docs = spark.createDataFrame([(i, "w " * 7, "s", weights[i % 8]) for i in range(800)], "doc_id bigint, text string, source string, weight double")
    got = {r["doc_id"] for r in source_mixing.mixture(docs, {"s": 1.0}, 700, weight_col="weight").where("copies > 0").collect()}
    key = lambda i: -math.log((int(hashlib.md5(f"0|{i}".encode()).hexdigest()[:13], 16) + 1) / (2**52 + 1)) / [1, 1, 1, 0.01, 0.01, 0.01, 0.4, 5][i % 8]
    assert got == set(sorted(range(800), key=key)[:100])
    mixed = source_mixing.mix(docs, {"s": 1.0}, 700, weight_col="weight")
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == got


def test_mixture_equals_sql(spark):
    from prismora.llm.queries import OP9_SQL

    assert rows_of(source_mixing.mixture(spark.read.parquet(f"{SF}/documents.parquet"))) == rows_of_sql(connect(SF), OP9_SQL)[0]


def test_mixture_odd(spark):
    docs = odd(spark)
    rows = source_mixing.mixture(docs).collect()
    assert len(rows) == docs.count()
    assert all(r["copies"] == 0 for r in rows if r["n_tokens"] == 0)
    assert all(r["copies"] >= 1 for r in rows if r["n_tokens"])  # every source once at least
    twins = [r["copies"] for r in rows if r["doc_id"] == 7]
    assert len(twins) == 2 and len(set(twins)) == 1
    assert source_mixing.mixture(empty(spark)).count() == 0 and source_mixing.mix(empty(spark)).count() == 0


def test_targets_and_budget(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i % 4 else "b") for i in range(400)], "doc_id bigint, text string, source string")
    got = source_mixing.mixture(docs, {"a": 1.0, "b": 3.0}, 4000).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()
    assert {r["source"]: r["n"] for r in got} == {"a": 1000, "b": 3000}
    per = source_mixing.mixture(docs, {"b": 1.0}, 2500).groupBy("source").agg(F.min("copies").alias("lo"), F.max("copies").alias("hi")).collect()
    assert {r["source"]: (r["lo"], r["hi"]) for r in per} == {"a": (0, 0), "b": (2, 3)}  # complete epochs first


def test_weights_matter(spark):
    docs = spark.createDataFrame([(i, "aa bb cc" if i % 2 else "a| b| c|", "s") for i in range(2000)], "doc_id bigint, text string, source string")
    got = source_mixing.mixture(docs, {"s": 1.0}, 1500).where("copies > 0").groupBy((F.col("doc_id") % 2).alias("good")).count().collect()
    n = {r["good"]: r["count"] for r in got}
    assert n[1] > 5 * n.get(0, 0)


def test_mix_gives_rows_as_told(spark):
    docs = odd(spark)
    told = Counter()
    for r in source_mixing.mixture(docs).collect():
        told[r["doc_id"]] += r["copies"]
    got = source_mixing.mix(docs)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == {k: v for k, v in told.items() if v}
    assert math.isclose(source_mixing.ALPHA, 0.7)
