import random
from collections import Counter

import numpy as np
from prismora.llm import jaccard_join as J
from prismora.operators.graph import connected
from pyspark.sql import functions as F

from ..oracle import connect, rows_of, rows_of_sql
from .common import empty, odd

SF = "/root/testdata/sf0.001"


def by_hand(rows, n, t):
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        if w:
            sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}
    out = {}
    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common >= t * len(sets[a] | sets[b]) - 1e-9:
                out[a, b] = common
    return out


def test_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "SHARD_GRAMS", 300)
    monkeypatch.setattr(J, "SHARD_BYTES", 2000)
    r = random.Random(1)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = []
    for i in range(30):
        rows.append((len(rows), " ".join(f"a{i}_{k}" for k in range(r.randrange(1, 80))) + (f" {shared}" if i % 3 == 0 else "")))
    for i in range(90):
        w = rows[i % 6][1].split()
        for _ in range(r.randrange(0, 8)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((len(rows), " ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    got = {(x["doc_a"], x["doc_b"]): x["common"] for x in J.similar_pairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == by_hand(rows, 3, 0.5) and len(got) > 100


def test_one_giant_chain_is_cut_into_bounded_units(spark, monkeypatch):
    """Each document is similar to the next alone, yet all are connected: no task gets the component."""
    monkeypatch.setattr(J, "SHARD_GRAMS", 2500)
    monkeypatch.setattr(J, "UNIT_DOCS", 60)
    seen = []
    places = J._places

    def spy(*args):
        seen.append(J.written(places(*args), "test-places"))
        return seen[-1]

    monkeypatch.setattr(J, "_places", spy)
    word = lambda i: f"w{i}"
    rows = [(i, " ".join(word(k) for k in range(15 * i, 15 * i + 60))) for i in range(300)]
    rows += [(1000 + i, " ".join(f"x{i}_{k}" for k in range(40)) + f" y{j}") for i in range(5) for j in range(2)]
    got = {(x["doc_a"], x["doc_b"]): x["common"] for x in J.similar_pairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == by_hand(rows, 3, 0.5) and len(got) >= 299
    units = seen[0].groupBy((F.col("part") / 4).cast("bigint").alias("unit")).count().collect()
    assert len(units) > 20 and max(r["count"] for r in units) <= 1.5 * J.UNIT_DOCS
    assert seen[0].groupBy("node").count().agg(F.max("count")).first()[0] <= 7  # it meets its neighbours' blocks alone


def test_large_groups_of_copies_over_blocks(spark, monkeypatch):
    """Groups of near copies that a common passage connects; all pairs are found once."""
    monkeypatch.setattr(J, "SHARD_GRAMS", 3000)
    monkeypatch.setattr(J, "UNIT_DOCS", 30)
    r = random.Random(3)
    rows, passage = [], " ".join(f"p{k}" for k in range(40))
    for group in range(4):
        body = [f"g{group}_{k}" for k in range(30)]
        for _ in range(40):
            w = list(body)
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(30)] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w) + (f" {passage}" if r.random() < 0.5 else "")))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(x["doc_a"], x["doc_b"], x["common"]) for x in J.similar_pairs(df).collect()]
    want = by_hand(rows, 3, 0.5)
    assert len(got) == len(want) > 1000 and {(a, b): c for a, b, c in got} == want


def test_fragments_are_balanced_ranges_of_one_order():
    r = np.random.default_rng(0)
    df = np.r_[np.full(4000, 2), r.integers(2, 50, 1000), [3000, 2**30]]
    g = r.integers(0, 2**63, len(df)).astype(np.uint64)
    postings = Counter()
    for c, n in zip(J._df_class(df).tolist(), df.tolist()):
        postings[c] += n if n < 2**30 else 1
    cuts = J._fragment_ends(dict(postings), 4)
    frag = np.searchsorted(cuts, J._order_key(df, g), side="right")
    order = np.lexsort((g, df))
    assert (np.diff(frag[order]) >= 0).all() and set(frag) == {0, 1, 2, 3}
    weight = np.bincount(frag, weights=np.minimum(df, 3000))
    assert weight.max() < 0.4 * weight.sum()
    assert (J._fragment_ends({}, 4) == 1 << 63).all()


def test_pairs_equal_sql(spark):
    from prismora.llm.queries import OP3_SQL

    assert rows_of(J.similar_pairs(spark.read.parquet(f"{SF}/documents.parquet"))) == rows_of_sql(connect(SF), OP3_SQL)[0]


def test_ids_of_several_texts(spark):
    """A pair of ids is given once, with its highest similarity."""
    base = " ".join(f"w{k}" for k in range(30))
    rows = [(1, base), (1, base + " more words here"), (2, base + " more words here now"), (2, base), (3, base + " else")]
    got = sorted((r["doc_a"], r["doc_b"], r["common"], round(r["jaccard"], 6)) for r in J.similar_pairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(1, 2, 28, 1.0), (1, 3, 28, round(28 / 29, 6)), (2, 3, 28, round(28 / 29, 6))]


def test_odd(spark):
    docs = odd(spark)
    more = docs.withColumn("doc_id", docs["doc_id"] + 100).where("doc_id in (106, 107, 104)")
    both = docs.unionByName(more)
    got = sorted((r["doc_a"], r["doc_b"]) for r in J.similar_pairs(both).collect())
    assert got == [(6, 106), (7, 107)]
    kept = J.drop_near_copies(both)
    assert kept.columns == both.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 9, 104]
    assert J.similar_pairs(empty(spark)).count() == 0 and J.drop_near_copies(empty(spark)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (None, 3), (9, 8), (8, 10), (10, 11), (11, 12)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 8, 9: 8, 10: 8, 11: 8, 12: 8}


def classes_by_hand(ids, pairs):
    """Class and number of links of each id."""
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return {i: (root[i], sum(i in p for p in pairs)) for i in ids}


def test_rows_of_the_query_grow_with_the_documents(spark, tmp_path):
    """A group of near and exact copies gives a row each, with all its links counted."""
    from prismora.llm.queries import op3_ngram_jaccard_join

    r = random.Random(7)
    rows = [(0, "alone " + " ".join(f"z{k}" for k in range(30))), (1, None), (2, "")]
    for group in range(3):
        body = [f"g{group}_{k}" for k in range(30)]
        for _ in range(40):
            w = list(body)
            if r.random() < 0.6:
                w[r.randrange(30)] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in op3_ngram_jaccard_join(spark, str(tmp_path)).collect()]
    want = classes_by_hand([i for i, _ in rows], by_hand(rows, 3, 0.5))
    assert len(got) == len(rows) and {i: (c, n) for i, c, n in got} == want and max(n for _, n in want.values()) == 39


def test_classes_over_blocks_and_ids_of_several_texts(spark, monkeypatch):
    monkeypatch.setattr(J, "SHARD_GRAMS", 2500)
    monkeypatch.setattr(J, "UNIT_DOCS", 60)
    monkeypatch.setattr(J, "_FLUSH", 50)
    rows = [(i, " ".join(f"w{k}" for k in range(15 * i, 15 * i + 60))) for i in range(200)]
    rows += [(1000 + i, f"{rows[i][1]} more") for i in range(20)]
    rows += [(5, rows[150][1]), (5, rows[150][1] + " y"), (7, rows[5][1]), (7, rows[150][1]), (2000, "z1 z2 z3 z4"), (2000, "z5 z6 z7"), (2001, "z5 z6 z7")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    pairs = {(r["doc_a"], r["doc_b"]) for r in J.similar_pairs(df).collect()}
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in J.similar_classes(df).collect()}
    assert got == classes_by_hand({i for i, _ in rows}, pairs) and got[2001] == (2000, 1) and (5, 7) in pairs


def test_classes_equal_sql(spark):
    from prismora.llm.queries import OP3_CLASSES_SQL

    got = rows_of(J.similar_classes(spark.read.parquet(f"{SF}/documents.parquet")))
    assert got == rows_of_sql(connect(SF), OP3_CLASSES_SQL)[0] and len(got) == 200


def test_classes_of_odd_documents(spark):
    docs = odd(spark)
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in J.similar_classes(docs.unionByName(docs.withColumn("doc_id", docs["doc_id"] + 100).where("doc_id in (106, 107)"))).collect()}
    assert got == {i: (i, 0) for i in (1, 2, 3, 4, 5, 9)} | {6: (6, 1), 106: (6, 1), 7: (7, 1), 107: (7, 1)}
    assert J.similar_classes(empty(spark)).count() == 0
