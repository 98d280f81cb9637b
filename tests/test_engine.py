"""The engine's semantics on a small corpus, and its plan."""

import pytest
from prismora.functions import derive
from prismora.functions.text import fold
from prismora.operators import postings as P
from prismora.plans import facets as E
from pyspark.sql import functions as F

ROWS = [
    (0, "Alpha beta", ["paper"], ["x", "y"], ["academic"], ["americas"], 5, 0.9, 2020, ["Ann Lee"]),
    (1, "Beta gamma", ["paper"], ["y"], ["non_academic"], [], 3, 0.3, 2021, ["Bo"]),
    (2, "Gämma delta", ["repo"], ["__none__"], ["academic", "non_academic"], ["americas", "asia"], None, 0.3, None, []),
    (3, "Betamax", ["repo"], ["x"], ["unaffiliated"], [], 0, 0.1, 1999, ["Ann Q"]),
]
TYPE = "i bigint, title string, kind array<string>, use_case array<string>, aff_type array<string>, aff_region array<string>, importance int, pop double, year_n int, authors array<string>"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ROWS, TYPE).withColumns({"folded_title": fold(F.col("title")), "summary": F.lit("")}).cache()


@pytest.fixture(scope="module")
def engine(corpus):
    return E.FacetEngine(corpus, P.build_postings(corpus, "i", {"text": F.col("title"), "authors": F.array_join("authors", " ")}))


def ids(df):
    return sorted(r["i"] for r in df.collect())


def test_floors(engine):
    assert ids(engine.snapshot(E.FacetQuery(min_importance=0)).results) == [0, 1, 2, 3]
    assert ids(engine.snapshot(E.FacetQuery(min_importance=1)).results) == [0, 1]
    assert engine.floor(50) == 0.3 and engine.floor(75) == 0.9 and engine.floor(0) == -1


def test_permit_vetoes_but_not_the_empty(engine):
    q = E.FacetQuery(min_importance=0, permit={**E.ALL_LIT, "aff_region": frozenset(["americas"])})
    assert ids(engine.snapshot(q).results) == [0, 1, 3]
    assert ids(engine.snapshot(E.FacetQuery(min_importance=0, permit={"aff_region": frozenset()})).results) == [0, 1, 2, 3]


def test_counts_leave_their_own_facet_out(engine):
    q = E.FacetQuery(min_importance=0, select={"kind": frozenset(["paper"]), "use_case": frozenset(["x"])})
    got = {(r["facet"], r["value"]): r["n"] for r in engine.snapshot(q).counts.collect()}
    assert got["kind", "paper"] == 1 and got["kind", "repo"] == 1  # with use_case x alone
    assert got["use_case", "x"] == 1 and got["use_case", "y"] == 2  # with kind paper alone
    assert ids(engine.snapshot(q).results) == [0]
    assert ids(engine.snapshot(q).excluded("kind")) == [0, 3]


@pytest.mark.parametrize(("text", "want"), [("", [0, 1, 2, 3]), ("  ", [0, 1, 2, 3]), ("beta", [0, 1, 3]), ("beta ", [0, 1, 3]), ("beta!", [0, 1]), ("gam", [1, 2]), ("alpha be", [0]), ("!!", []), ("zzz", []), ("beta ann", [0]), ("max", [])])
def test_search(engine, text, want):
    assert ids(engine.snapshot(E.FacetQuery(text=text, min_importance=0)).results) == want


def test_answers_of_an_interaction(engine):
    q = E.FacetQuery(min_importance=0, sort="title")
    counts, rows = engine.snapshot(q).answer(derive.label_for, "i", "title")
    assert [r["i"] for r in rows] == [0, 1, 3, 2] and rows[0].asDict().keys() == {"i", "title"}
    assert {(r["facet"], r["value"]): r["n"] for r in counts}["kind", "repo"] == 2
    _, groups = engine.snapshot(q.changed(group="kind")).answer(derive.label_for)
    assert {r["heading"]: (r["total"], r["shown"]) for r in groups} == {"Paper": (2, 2), "Repo": (2, 2)}


def test_scopes(engine):
    assert ids(engine.snapshot(E.FacetQuery(text="Gamma  d", scope="title", min_importance=0)).results) == [2]
    assert ids(engine.snapshot(E.FacetQuery(text="AMAX", scope="substring", min_importance=0)).results) == [3]


def test_order_page_groups(engine):
    snap = engine.snapshot(E.FacetQuery(min_importance=0, limit=3, group="use_case"))
    assert [r["i"] for r in snap.page().collect()] == [0, 1, 3]
    g = {r["heading"]: (r["total"], r["shown"]) for r in snap.groups(derive.label_for).collect()}
    assert g == {"X": (2, 2), "Y": (2, 2)}


def test_states():
    q = E.FacetQuery(limit=300)
    assert q.toggled("kind", "a").limit == 100 and q.toggled("kind", "a").toggled("kind", "a").signature() == q.signature()
    two = q.toggled_permit("aff_type", "academic")
    assert two.permit["aff_type"] == {"non_academic", "unaffiliated"}
    assert E.FacetQuery(scope="title", text="x").cleared() == E.FacetQuery(scope="title", min_importance=0)
    assert q.more().limit == 400


def test_snapshots_are_kept(engine):
    a, b = engine.snapshot(E.FacetQuery(text="Beta")), engine.snapshot(E.FacetQuery(text=" beta ", limit=7))
    assert a.masked is b.masked and b.query.limit == 7


def test_counts_take_one_scan_and_one_exchange(spark, tmp_path, corpus):
    corpus.write.parquet(f"{tmp_path}/c")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = E.FacetEngine(spark.read.parquet(f"{tmp_path}/c")).snapshot(E.FacetQuery(select={"kind": frozenset(["paper"])})).counts
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1


@pytest.mark.parametrize("percent", [1, 33, 50, 99, 100])
def test_threshold_from_counts_of_values(spark, percent):
    """The plan has no top-k that grows with the corpus, and the value is that of the sorted list."""
    df = spark.range(5000).select(F.when(F.col("id") % 7 != 0, (F.pmod(F.xxhash64("id"), F.lit(97)) / 97).cast("double")).alias("pop"))
    got = E.popularity_threshold(df, percent)
    values = sorted(r["pop"] for r in df.collect() if r["pop"] is not None)
    assert [r["threshold"] for r in got.collect()] == [values[min(len(values) * percent // 100, len(values) - 1)]]
    plan = got._jdf.queryExecution().toString()
    assert "TakeOrdered" not in plan and "Limit" not in plan
    assert E.popularity_threshold(df.where("false"), percent).count() == 0


def test_postings_in_blocks(spark, monkeypatch):
    """A token's ordinals lie in rows of bounded length; search doesn't notice."""
    monkeypatch.setattr(P, "BLOCK", 10)
    df = spark.range(95).select(F.col("id").alias("i"), F.concat(F.lit("common w"), (F.col("id") % 3).cast("string")).alias("t"))
    index = P.build_postings(df, "i", {"text": F.col("t")})
    assert index.agg(F.max(F.size("ids"))).first()[0] == 10 and index.where("token = 'common'").count() == 10
    assert ids(P.search(index, "common w1 ")) == [i for i in range(95) if i % 3 == 1]
    assert ids(P.exact(index, "common")) == list(range(95)) == ids(P.with_prefix(index, "com"))
