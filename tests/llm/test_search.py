import numpy as np
import pytest
from prismora.llm import ann_forest, embedding_dedup
from pyspark.sql import functions as F

TYPE = "vec_id bigint, embedding array<float>, label int"
ODD = [
    (1, [1.0, 0.0, 0.0, 0.0], 0), (2, [2.0, 0.0, 0.0, 0.0], 0), (3, [0.99, 0.05, 0.0, 0.0], 0), (4, [0.0, 1.0, 0.0, 0.0], 1), (5, None, 1), (6, [], 1), (7, [0.0] * 4, 1),
    (8, [float("nan"), 1.0, 0.0, 0.0], 1), (9, [1.0, 2.0], 1), (None, [1.0, 0.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0, 0.0], 0), (10, [float("inf"), 0.0, 0.0, 0.0], 2),
]


def planted(n=600, dim=24, seed=0):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)).astype(np.float32)
    x[n - 60 :] = x[:60] + 0.05 * r.standard_normal((60, dim))
    return x


def as_table(spark, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row], 0) for i, row in enumerate(x)], TYPE)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_dedup_against_brute_force(spark):
    x = planted()
    s = np.triu(unit(x) @ unit(x).T, 1)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(s >= 0.9))}
    got = [(r["vec_a"], r["vec_b"]) for r in embedding_dedup.near_duplicates(as_table(spark, x)).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got) & want) >= 0.95 * len(want) > 0


def test_dedup_odd(spark):
    df = spark.createDataFrame(ODD, TYPE).withColumns({c: F.lit(1) for c in ("row", "key", "keys", "part")})
    got = {(r["vec_a"], r["vec_b"]): r["cosine"] for r in embedding_dedup.near_duplicates(df).collect()}
    assert set(got) == {(1, 2), (1, 3), (2, 3)} and got[1, 2] == pytest.approx(1)
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_dedup_equals_sql_where_there_are_pairs(spark):
    import duckdb
    from prismora.llm.queries import OP6_SQL

    r = np.random.default_rng(2)
    x = np.repeat(r.standard_normal((40, 16)), 6, axis=0) + 0.01 * r.standard_normal((240, 16))
    df = as_table(spark, x)
    embeddings = df.toArrow()  # noqa: F841, read by name
    want = {(a, b): c for a, b, c in duckdb.sql(OP6_SQL.replace("round(", "(").replace("::double, 4)", "::double)")).fetchall()}
    got = {(p["vec_a"], p["vec_b"]): p["cosine"] for p in embedding_dedup.near_duplicates(df).collect()}
    assert len(want) >= 600 and got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-4


def test_ids_may_be_texts(spark):
    df = spark.createDataFrame([(f"v{'x' * (i % 7)}{i}", [float(v) for v in row]) for i, row in enumerate(planted(80, 8))], "vec_id string, embedding array<float>")
    number = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(planted(80, 8))], "vec_id int, embedding array<float>")
    name = lambda i: f"v{'x' * (i % 7)}{i}"
    pairs = {frozenset((name(r["vec_a"]), name(r["vec_b"]))) for r in embedding_dedup.near_duplicates(number).collect()}
    got = embedding_dedup.near_duplicates(df).collect()
    assert {frozenset((r["vec_a"], r["vec_b"])) for r in got} == pairs and len(pairs) == len(got) > 10 and all(r["vec_a"] < r["vec_b"] for r in got)
    near = {(name(r["vec_id"]), r["rank"], round(r["cosine"], 5)) for r in ann_forest.nearest(number, 3).collect()}
    assert {(r["vec_id"], r["rank"], round(r["cosine"], 5)) for r in ann_forest.nearest(df, 3).collect()} == near
    for f in (embedding_dedup.near_duplicates, ann_forest.nearest):
        with pytest.raises(TypeError):
            f(number.withColumn("vec_id", F.lit(1.5)))


def test_dedup_of_large_buckets_in_groups(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PART_ROWS", 40)
    x = planted(300, 12)
    x[:150] = x[0] + 0.02 * np.random.default_rng(1).standard_normal((150, 12))
    s = np.triu(unit(x) @ unit(x).T, 1)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(s >= 0.9))}
    got = [(r["vec_a"], r["vec_b"]) for r in embedding_dedup.near_duplicates(as_table(spark, x)).collect()]
    assert len(want) > 10_000 and len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.99 * len(want)


def test_dedup_many_copies(spark):
    df = spark.range(150).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    assert embedding_dedup.near_duplicates(df).count() == 150 * 149 // 2


def test_classes_of_vectors_equal_sql(spark, monkeypatch, tmp_path):
    """A row a vector, whatever the size of the groups; large buckets in groups, small forests."""
    from prismora.llm import _forest
    from prismora.llm.queries import OP6_CLASSES_SQL, op6_embedding_near_dedup

    from ..oracle import connect

    r = np.random.default_rng(4)
    x = np.repeat(r.standard_normal((8, 16)), 30, axis=0) + 0.02 * r.standard_normal((240, 16))
    x[120:] += 0.3 * r.standard_normal((120, 16))  # chains, too
    df = as_table(spark, r.permutation(np.r_[x, r.standard_normal((60, 16))]))
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = dict(connect(str(tmp_path)).execute(OP6_CLASSES_SQL).fetchall())
    got = [tuple(p) for p in op6_embedding_near_dedup(spark, str(tmp_path)).collect()]
    assert len(got) == 300 and dict(got) == want and 60 < len(set(want.values())) < 250
    monkeypatch.setattr(embedding_dedup, "PART_ROWS", 20)
    monkeypatch.setattr(_forest, "_FLUSH", 40)
    assert {p["vec_id"]: p["class_id"] for p in embedding_dedup.near_classes(df).collect()} == want


def test_classes_of_odd_vectors(spark):
    df = spark.createDataFrame(ODD, TYPE).withColumns({c: F.lit(1) for c in ("row", "key", "keys", "part")})
    got = [tuple(r) for r in embedding_dedup.near_classes(df).collect()]
    assert dict(got) == {i: 1 if i < 4 else i for i in range(1, 11)} and len(got) == 10
    texts = {r["vec_id"]: r["class_id"] for r in embedding_dedup.near_classes(df.withColumn("vec_id", F.concat(F.lit("v"), "vec_id"))).collect()}
    assert texts == {f"v{i}": "v1" if i < 4 else f"v{i}" for i in range(1, 11)}
    assert embedding_dedup.near_classes(df.where("false")).count() == 0


def test_forest_recall(spark):
    x = planted()
    s = unit(x) @ unit(x).T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :10]
    rows = ann_forest.nearest(as_table(spark, x)).collect()
    got = {}
    for r in rows:
        got.setdefault(r["vec_id"], {})[r["rank"]] = r["neighbor_id"]
    assert len(got) == len(x) and all(sorted(v) == list(range(1, 11)) for v in got.values())
    assert np.mean([len(set(want[i]) & set(got[i].values())) / 10 for i in range(len(x))]) >= 0.9
    assert all(got[i][1] == i + 540 for i in range(60))


def test_forest_over_blocks(spark, monkeypatch):
    """Queries that ascend above the blocks' root still find their neighbours."""
    monkeypatch.setattr(ann_forest, "BLOCK", 64)
    x = planted(400, 16, 3)
    s = unit(x) @ unit(x).T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    got = {}
    for r in ann_forest.nearest(as_table(spark, x), k=5).collect():
        got.setdefault(r["vec_id"], set()).add(r["neighbor_id"])
    assert np.mean([len(set(want[i]) & got[i]) / 5 for i in range(len(x))]) >= 0.9


def test_forest_of_clusters_in_bounded_blocks(spark, monkeypatch):
    """Copies of few vectors have equal hashes; their blocks are cut and nothing is lost."""
    monkeypatch.setattr(ann_forest, "BLOCK", 20)
    r = np.random.default_rng(5)
    x = np.repeat(r.standard_normal((6, 12)), 70, axis=0) + 0.05 * r.standard_normal((420, 12))
    s = unit(x) @ unit(x).T
    np.fill_diagonal(s, -2)
    want = np.argsort(-s, axis=1)[:, :5]
    got = {}
    for p in ann_forest.nearest(as_table(spark, x), k=5).collect():
        got.setdefault(p["vec_id"], []).append(p["neighbor_id"])
    assert all(len(v) == 5 for v in got.values()) and np.mean([len(set(want[i]) & set(got[i])) / 5 for i in range(420)]) >= 0.9


def test_forest_odd(spark):
    df = spark.createDataFrame(ODD, TYPE).withColumns({c: F.lit(1) for c in ("row", "hash", "tree", "depth")})
    got = {}
    for r in ann_forest.nearest(df).collect():
        got.setdefault(r["vec_id"], []).append(r["neighbor_id"])
    assert {k: sorted(v) for k, v in got.items()} == {1: [2, 3, 4], 2: [1, 3, 4], 3: [1, 2, 4], 4: [1, 2, 3]}
    assert ann_forest.nearest(df.where("false")).count() == 0
    assert ann_forest.nearest(df.where("vec_id = 4")).count() == 0


def test_depth_bounds_the_miss():
    c = np.linspace(-0.9, 0.999, 50)
    d = ann_forest.depth_for(c, 64, 0.1)
    p = 1 - np.arccos(c) / np.pi
    assert ((1 - p**d) ** 64 <= 0.1 + 1e-9).all() and (np.diff(d) >= 0).all()
