"""The ordered fold against its sequential definition, and enrichment."""

import random

import pytest
from prismora.operators import assembly as A
from pyspark.sql import functions as F

TYPE = "seq bigint, id string, override boolean, fields map<string,string>"


def by_hand(rows):
    """The log folded one row after another, as it is defined; nothing of the library takes part.

    A base record takes its address if that is free, and is a duplicate
    otherwise; corrections change the latest record of their id, and move it
    to another address where they give one, which frees the old one.
    """
    records, at_address, latest, other = [], {}, {}, []
    strip = lambda u: (u or "").rstrip("/")
    for seq, id_, override, fields in sorted(rows):
        fields = dict(fields)
        if override and id_ not in latest:
            other.append((seq, id_, "orphaned", fields))
        elif override:
            record = records[latest[id_]]
            new = fields.get("url")
            if new and new != record[2].get("url"):
                at_address.pop(strip(record[2].get("url")), None)
                at_address[strip(new)] = latest[id_]
            record[2].update(fields)
        elif fields.get("duplicate_of"):
            other.append((seq, id_, "retired", fields))
        elif strip(fields.get("url")) and strip(fields["url"]) in at_address:
            other.append((seq, id_, "duplicate", fields))
        else:
            latest[id_] = len(records)
            at_address[strip(fields.get("url"))] = len(records)
            records.append((seq, id_, fields))
    done = [(seq, id_, "retired" if fields.get("duplicate_of") else "kept", fields) for seq, id_, fields in records]
    return sorted((seq, id_, state, tuple(sorted(fields.items()))) for seq, id_, state, fields in done + other)


def folded(spark, rows):
    got = A.fold_log(spark.createDataFrame(rows, TYPE)).where("state <> 'applied'").collect()
    return sorted((r.seq, r.id, r.state, tuple(sorted(r.fields.items()))) for r in got)


CASES = [
    [(1, "a", False, {"url": "u/"}), (2, "b", False, {"url": "u"}), (3, "b", True, {"t": "1"})],  # the copy's id is unknown
    [(1, "a", True, {"t": "0"}), (2, "a", False, {"url": "u", "t": "1"}), (3, "a", True, {"t": ""}), (4, "a", True, {"v": "[]"})],
    [(1, "a", False, {"url": "u"}), (2, "a", True, {"url": "v"}), (3, "b", False, {"url": "u"}), (4, "c", False, {"url": "v"})],  # a move frees an address
    [(1, "a", False, {"url": "u"}), (2, "b", False, {"url": "v"}), (3, "a", True, {"url": "v"})],  # onto one that is taken: both stay
    [(1, "a", False, {"url": "u", "duplicate_of": "x"}), (2, "a", True, {"t": "1"})],
    [(1, "a", False, {"url": "u"}), (2, "a", True, {"duplicate_of": "b"})],
    [(1, "a", False, {"url": ""}), (2, "b", False, {})],
    [],
]


@pytest.mark.parametrize("rows", CASES)
def test_fold_cases(spark, rows):
    assert folded(spark, rows) == by_hand(rows)


# Records and corrections that empty addresses would connect; ids with several kept bases, and moves back and forth.
MOVES = [
    [(1, "a", False, {"url": "u"}), (2, "a", True, {"t": "1"}), (3, "a", True, {"url": "v"}), (4, "a", False, {"url": "u"}), (5, "a", True, {"t": "2"}), (6, "b", False, {"url": "v"})],
    [(1, "a", False, {}), (2, "b", False, {}), (3, "a", True, {"url": "u"}), (4, "c", False, {"url": "u"}), (5, "b", True, {"url": "w"}), (6, "d", False, {"url": "w/"})],
    [(1, "a", False, {"url": "u"}), (2, "b", False, {"url": "v"}), (3, "b", True, {"url": "u"}), (4, "b", True, {"url": "w"}), (5, "a", True, {"url": "u/"}), (6, "c", False, {"url": "u"}), (7, "d", False, {"url": "v"})],
    [(1, "a", False, {"url": "u"}), (2, "a", True, {"url": ""}), (3, "a", True, {"url": "v"}), (4, "b", False, {"url": "u"}), (5, "c", False, {"url": "v"})],
]


@pytest.mark.parametrize("rows", MOVES)
def test_fold_moves(spark, rows):
    assert folded(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("seed", range(3))
def test_fold_random_with_repeated_ids(spark, seed):
    r = random.Random(seed)
    rows = []
    for seq in range(300):
        url = {"url": f"u{r.randrange(12)}" + "/" * r.randrange(2)} if r.random() < 0.4 else {}
        rows.append((seq, f"i{r.randrange(15)}", r.random() < 0.6, {r.choice("abc"): str(seq), **url, **({"duplicate_of": "x"} if r.random() < 0.1 else {})}))
    assert folded(spark, rows) == by_hand(rows)


def test_moves_of_unrelated_records_stay_apart(spark):
    """Retired rows and others without an address connect nothing, so groups that are gone through in order stay small."""
    rows = [(10 * i + k, f"i{i}", override, fields) for i in range(30) for k, (override, fields) in enumerate([(False, {"duplicate_of": "x"}), (False, {}), (False, {"url": f"u{i}"}), (True, {"url": f"v{i}"})])]
    log = spark.createDataFrame(rows, TYPE).selectExpr("*", "fields['url'] as url", "coalesce(fields['url'], '') as key")
    groups = A._moving(log.where("not override"), log.where("override"))
    assert groups.groupBy("root").count().agg(F.count("*"), F.max("count")).first()[:] == (30, 3)
    assert folded(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("seed", range(3))
def test_fold_random(spark, seed):
    r = random.Random(seed)
    rows, used = [], 0
    for seq in range(60):
        if r.random() < 0.5:
            used += 1
            rows.append((seq, f"i{used}", False, {"url": f"u{r.randrange(25)}", **({"duplicate_of": "x"} if r.random() < 0.1 else {})}))
        else:
            rows.append((seq, f"i{r.randrange(1, 40)}", True, {r.choice("abc"): str(seq), **({"url": f"u{r.randrange(25)}"} if r.random() < 0.15 else {})}))
    assert folded(spark, rows) == by_hand(rows)


def test_shared_ids_are_an_error(spark):
    with pytest.raises(ValueError):
        A.assembled(spark.createDataFrame([(1, "a", False, {"url": "u"}), (2, "a", False, {"url": "v"})], TYPE))


def test_ordinals_and_blank_keys(spark):
    df = spark.range(100).repartition(7).orderBy(F.desc("id"))
    assert [r["i"] for r in A.ordinals(df).orderBy("i").collect()] == list(range(100))
    assert [r["id"] for r in A.ordinals(df).orderBy("i").limit(2).collect()] == [99, 98]
    x = spark.createDataFrame([(1, ""), (2, ""), (3, None), (4, "k"), (5, "k")], "i int, k string")
    assert sorted(r["i"] for r in A.first_per_key(x, F.col("k"), F.col("i")).collect()) == [1, 2, 3, 4]


def test_ordinals_of_many_wide_rows(spark):
    """Every row has one place, though counts need fewer columns than rows have."""
    wide = F.repeat(F.sha2(F.col("id").cast("string"), 512), 3)
    df = spark.range(0, 600_000, 1, 12).select("id", F.xxhash64("id").alias("h"), wide.alias("text"), F.md5(wide).alias("more")).orderBy("h", "id")
    got = A.ordinals(df, "pos")
    assert got.agg(F.count("*"), F.count("pos"), F.count_distinct("pos"), F.min("pos"), F.max("pos")).first()[:] == (600_000, 600_000, 600_000, 0, 599_999)
    pairs = [tuple(r) for r in got.where("pos between 299990 and 300010").select("pos", "h").orderBy("pos").collect()]
    assert [p for p, _ in pairs] == list(range(299_990, 300_011)) and sorted(h for _, h in pairs) == [h for _, h in pairs]
    assert got.where("pos = 0").first()["h"] == df.agg(F.min("h")).first()[0]
    assert A.ordinals(df.where("false")).count() == 0


def test_content_hash_is_a_tree(spark):
    import hashlib

    df = spark.range(1000).select("id", F.md5(F.col("id").cast("string")).alias("t"))
    flat, tree = A.content_hash(df, ["id"]).first()[0], A.content_hash(df, ["id"], leaf=7).first()[0]
    rows = [hashlib.sha256(f'{{"id":{i},"t":"{hashlib.md5(str(i).encode()).hexdigest()}"}}'.encode()).hexdigest() for i in range(1000)]
    assert flat == hashlib.sha256("".join(rows).encode()).hexdigest() != tree
    assert tree == A.content_hash(df.repartition(9), ["id"], leaf=7).first()[0] != A.content_hash(df.where("id <> 500"), ["id"], leaf=7).first()[0]
    assert A.content_hash(df.where("false"), ["id"]).first()[0] == hashlib.sha256(b"").hexdigest()


def test_batches_and_thirds_in_ranges(spark):
    from prismora.operators import worklists as W

    df = spark.range(1000).select(F.xxhash64("id").alias("k")).repartition(6)
    keys = sorted(r["k"] for r in df.collect())
    assert {r["k"]: r["batch"] for r in W.batches(df, 7, F.col("k")).collect()} == {k: i // 7 + 1 for i, k in enumerate(keys)}
    counts = spark.createDataFrame([(f"v{i:02}", 100 - i) for i in range(11)], "v string, n int")
    got = {r["v"]: r["third"] for r in W.frequency_sample(counts, "v", "n", 2).collect()}
    assert got == {"v00": "high", "v01": "high", "v04": "mid", "v05": "mid", "v08": "low", "v09": "low"}
