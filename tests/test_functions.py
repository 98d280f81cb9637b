"""Text and derivation functions on hand-made cases."""

import json
import math
import random
import re
import time

import pytest
from prismora.functions import derive as D
from prismora.functions import text as X
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [("C++", ["c"]), ("naïve", ["naive"]), ("Müller", ["muller"]), ("straße", ["straße"]), ("ﬁle", ["file"]), ("Ångström", ["angstrom"]), ("深層学習", ["深層学習"]), ("O'Brien", ["o", "brien"]), ("x²", ["x2"]), ("a_b", ["a", "b"]), ("café-au-lait", ["cafe", "au", "lait"]), ("", []), ("...", [])],
)
def test_tokens(spark, text, tokens):
    assert one(spark, X.tokenize(X.fold(F.lit(text)))) == tokens


def test_nulls_pass_through(spark):
    n = F.lit(None).cast("string")
    for f in (X.norm_url, X.url_key, X.dedupe_key, X.norm_title, X.fold, X.canonical_text, X.comparison_key, X.paragraphs, X.squeeze, X.repo_of, X.doi_in):
        assert one(spark, f(n)) is None
    assert one(spark, X.tokenize(n)) == []


def test_url_keys_differ_as_they_should(spark):
    u = F.lit("HTTPS://www.A.example/B//")
    assert (one(spark, X.norm_url(u)), one(spark, X.url_key(u)), one(spark, X.dedupe_key(u))) == ("a.example/b", "www.a.example/b", "HTTPS://www.A.example/B")


@pytest.mark.parametrize(("raw", "want"), [("Dr. Ada Lovelace", "Ada Lovelace"), ("LOVELACE, ADA", "Ada Lovelace"), ("ada de la cruz", "Ada de la Cruz"), ("Ada <a@b.example>", "Ada <>"), ("McKay, PhD", "McKay"), ("acme ai", "acme ai"), ("unknown", None), ("", None), (None, None)])
def test_person_names(raw, want):
    assert X.person_name_of(raw)[0] == want


def test_objects_and_mending():
    assert X.objects_of('x {"a": "}"} y {"b": {"c": 1}} {') == ['{"a": "}"}', '{"b": {"c": 1}}']
    assert X.mended("{\"a\": low}") == '{"a": "low"}'
    assert X.mended("{") is None


def test_bibliography_takes_the_last_late_heading(spark):
    text = "References\n" + "x\n" * 40 + "References\nlast"
    got = one(spark, X.split_bibliography(F.lit(text)))
    assert got["bibliography"] == "References\nlast"


def test_popularity(spark):
    def pop(kind, stars=None, forks=None, contributors=None, commits=None, cited=None):
        c = [F.lit(v).cast("bigint") for v in (stars, forks, contributors, commits, cited)]
        return one(spark, D.popularity_of(F.lit(kind), *c))

    assert pop("code_repo", 100, 10, 4, 500) == pytest.approx(math.log1p(190) / math.log1p(8000), abs=1e-15)
    assert pop("code_repo") == 0.0
    assert pop("paper") == 0.3
    assert pop("paper", cited=0) == 0.0
    assert pop("paper", cited=10**6) == 1.0


def test_organizations_and_rows(spark):
    a = F.array(F.lit("MIT; TU Delft"), F.lit(None), F.lit(" MIT ;;")).cast("array<string>")
    assert one(spark, D.organizations_of(a)) == ["MIT", "TU Delft"]
    rows = one(spark, D.affiliation_rows(D.organizations_of(a), F.array(F.lit("academic")), F.array(F.lit("the Netherlands"))))
    assert [(r.organization, r.sector, r.country) for r in rows] == [("MIT", "academic", "the Netherlands"), ("TU Delft", "", "")]
    assert one(spark, D.region_of(F.lit("The Netherlands"))) == "europe"
    assert one(spark, D.region_of(F.lit("Atlantis"))) == ""
    assert one(spark, D.aff_types(F.array(F.lit("academic"), F.lit("")))) == ["academic", "non_academic"]
    assert one(spark, D.aff_types(F.array().cast("array<string>"))) == ["unaffiliated"]


def test_delta(spark):
    a = F.array(*[F.lit(v).cast("bigint") for v in (3, 4, 9)])
    assert one(spark, D.delta_encode(a)) == [3, 1, 5]
    assert one(spark, D.delta_decode(D.delta_encode(a))) == [3, 4, 9]


def test_title_match(spark):
    m = lambda a, b: one(spark, X.title_match(F.lit(a), F.lit(b)))
    assert m("A: b", "a b") == "exact"
    assert m("one two three four five six seven", "One two three four five six") == "prefix"
    assert m("one two three four", "one two three five") is None
    assert m("", "x") is None


def test_finalized_answers(spark):
    from prismora.catalog.curation import RULES
    from prismora.operators import curation as C

    answer = '```json\n{"title": "T", "summary": "s", "authors": ["A", null], "importance": 3, "concept": [], "needs": "n", "other": 1}\n```'
    df = spark.createDataFrame([(7, answer)], "k int, a string")
    got = json.loads(df.select(C.finalized(F.col("a"), RULES, id=F.concat(F.lit("r-"), F.col("k").cast("string")), reviewed=F.lit(False), model=F.lit(None).cast("string"))).first()[0])
    assert got == {"id": "r-7", "reviewed": False, "model": None, "title": "T", "summary": "s", "authors": ["A", None], "importance": 3, "concept": [], "needs": "n"}


def test_slugs_against_the_loop(spark):
    """Ids are given out one after another; order is that of the columns' types, nulls first."""
    import re

    from prismora.operators import worklists as W

    rows = [(i if i % 13 else None, f"own{i % 7}/{'Tool' if i % 3 else 'a--tool!'}{i % 5 if i % 2 else ''}") for i in range(60)] + [(100, "a/tool"), (101, "x/a-tool"), (102, "own1/" + "very-long-" * 9), (103, "own2/" + "very-long-" * 9), (104, "z/!!")]
    word = lambda s: re.sub("[^a-z0-9]+", "-", s.lower()).strip("-")
    made = [(n, r, f"repo-{word(r.split('/')[1]) or 'repo'}", f"repo-{word(r.split('/')[0])}-{word(r.split('/')[1]) or 'repo'}") for n, r in rows]
    taken = {"repo-tool1", "repo-own1-tool", "repo-a-tool-2"}
    want, seen = {}, set(taken)
    for n, r, stem, other in sorted(made, key=lambda x: (x[0] is not None, x[0] or 0, json.dumps({**({"n": x[0]} if x[0] is not None else {}), "r": x[1], "stem": x[2], "other": x[3], "year": ""}, separators=(",", ":")))):
        slug, k = W._fit(stem, 60), 2
        if slug in seen:
            slug = W._fit(other, 60)
        while slug in seen:
            slug, k = W._fit(stem, 60 - len(f"-{k}")) + f"-{k}", k + 1
        seen.add(slug)
        want.setdefault((n, r), []).append(slug)
    df = spark.createDataFrame([(*x, "") for x in made], "n int, r string, stem string, other string, year string")
    got = {}
    for x in W.slugs(df, "stem", "year", ["n"], spark.createDataFrame([(t,) for t in taken], "id string"), "id", alternative="other").collect():
        got.setdefault((x["n"], x["r"]), []).append(x["slug"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_fold_in_the_jvm_is_fold_text(spark):
    """Every Latin letter and mark, alone and beside others, and texts of other scripts, against the definition."""
    r = random.Random(5)
    every = [chr(c) for c in (*range(0x20, 0x250), *range(0x300, 0x370))]
    texts = [*every, *(f"A{c}e" for c in every), "", None, "ΟΔΟΣ Σ", "Ω½ﬁ", "한글 É", "a𝔘b", "İSTANBUL\nİ"]
    texts += ["".join(r.choice(every) for _ in range(40)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {x["i"]: x["f"] for x in df.select("i", X.fold(F.col("t")).alias("f")).collect()}
    assert [got[i] for i in range(len(texts))] == [X.fold_text(t) for t in texts]


def test_fold_keeps_ascii_texts_out_of_python(spark):
    """Python holds some texts of a batch at a time: an ASCII text doesn't reach it, and a slice is all that it turns into objects."""
    plan = spark.createDataFrame([("A",)], "t string").select(X.fold(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython [_fold(CASE WHEN NOT" in re.sub(r"#\d+", "", plan)


def test_bibliography_is_cut_at_its_place(spark):
    def by_hand(v):
        late = [m.start() for m in X._HEADING.finditer(v) if m.start() > 0.45 * len(v)]
        cut = late[-1] if late else len(v)
        return v[:cut], v[cut:]

    texts = ["", "x", "é𝔘" * 30 + "\nReferences:\n[1] ü𝔘\nREFERENCE\n2", "References\n" + "a" * 50, "a" * 30 + "\n 3. Lıterature Cited \nx", "b" * 30 + "\nworKs cited\nx\nBİBLIOGRAPHY\n", "b" * 30 + "\n(references)\n"]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "i int, t string")
    got = {x["i"]: x["b"] for x in df.select("i", X.split_bibliography(F.col("t")).alias("b")).collect()}
    assert tuple(got.pop(99)) == (None, None)
    assert {i: tuple(b) for i, b in got.items()} == {i: by_hand(t) for i, t in enumerate(texts)}
    assert sum(bool(b) for _, b in map(by_hand, texts)) == 3


def test_slugs_of_many_equal_stems(spark):
    """Numbers go on where they stopped; looking for each from 2 on takes time with the square of the copies."""
    from prismora.operators import worklists as W

    n = 12_000
    df = spark.range(n).selectExpr("id", "if(id % 3 = 0, 'paper-one-two', 'paper-one') as stem", "if(id % 2 = 0, 'y24', '') as year")
    taken = spark.createDataFrame([("paper-one-5",), ("paper-one-2-y24",)], "id string")
    began = time.time()
    got = {x["id"]: x["slug"] for x in W.slugs(df, "stem", "year", ["id"], taken, "id").collect()}
    assert time.time() - began < 20
    seen = {"paper-one-5", "paper-one-2-y24"}
    for stem in ("paper-one", "paper-one-two"):
        for year in ("", "y24"):
            tail = f"-{year}" if year else ""
            names = (f"{stem}{mark}{tail}" for mark in ["", *(f"-{k}" for k in range(2, n))])
            ids = [i for i in range(n) if (i % 3 == 0) == (stem == "paper-one-two") and (i % 2 == 0) == (year == "y24")]
            assert [got[i] for i in ids] == [x for _, x in zip(ids, (x for x in names if x not in seen))]


def test_gaps_of_long_lists(spark):
    df = spark.createDataFrame([([5],), ([3, 4, 9, 1 << 40],), ([],), (None,), (list(range(0, 400, 2)),)], "ids array<bigint>")
    got = df.select("ids", D.delta_decode(D.delta_encode(F.col("ids"))).alias("back")).collect()
    assert all(x["ids"] == x["back"] for x in got)
