from pathlib import Path

import pytest


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Clean documents, and planted ones that a stage has to catch."""
    import random

    r = random.Random(5)
    words = [f"word{i}" for i in range(3000)]
    clean = {i: "\n".join(" ".join(r.choice(words) for _ in range(12)) + "." for _ in range(6)) for i in range(120)}
    rows = [(i, t, "en", f"s{i % 3}") for i, t in clean.items()]
    rows += [(200 + i, clean[i], "en", "s0") for i in range(10)]  # exact copies
    for i in range(10, 20):
        w = clean[i].replace("\n", " ").split()
        w[5] = "changed"
        rows.append((200 + i, " ".join(w), "en", "s1"))  # near copies, in one line
    rows += [(300 + i, " ".join(f"{r.choice(words)}%%%" for _ in range(60)), "en", "s2") for i in range(40)]  # noise
    rows += [(400, None, None, None), (401, "", "en", "s0"), (None, "a document without an id", "en", "s0")]
    d = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) as n_chars")
    docs.write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(120)] + [(300 + i, 0, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, tables):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, tables), f"test-{name}")
        assert docs.columns == columns
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not seen["quality_classifier"] & set(range(300, 340)) and set(range(120)) <= seen["quality_classifier"]
    assert not seen["line_dedup"] & set(range(200, 210)) and set(range(120)) <= seen["line_dedup"]
    assert not seen["ngram_jaccard_join"] & set(range(210, 220)) and set(range(120)) <= seen["ngram_jaccard_join"]
    assert set(range(120)) <= seen["source_mixing"]
    packed = C.STAGES[-1][1](spark, docs, tables)
    whole = {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert set(range(120)) <= set(whole) and all(whole[i] % 72 == 0 for i in range(120))


def test_mixing_without_the_raw_documents(spark, tables, tmp_path):
    """The fourth stage takes the first one's model, and neither fits it again nor reads the documents of the folder."""
    import shutil

    import corpus_pipeline as C

    shutil.copytree(f"{tables}/labels.parquet", tmp_path / "labels.parquet")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = C.written(C.quality_stage(spark, docs, str(tmp_path)), "test-kept")
    want = sorted(map(str, C.mixing_stage(spark, kept, tables).collect()))
    assert sorted(map(str, C.mixing_stage(spark, kept, str(tmp_path)).collect())) == want and len(want) >= 120


def test_other_documents_leave_no_model(spark, tables, tmp_path):
    import shutil

    import corpus_pipeline as C

    shutil.copytree(tables, tmp_path / "sf")
    sf = str(tmp_path / "sf")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    C.quality_stage(spark, docs.where("doc_id < 50"), sf)
    assert C.quality_fm.kept_model(C._model_folder(spark, sf)) is None
    C.quality_stage(spark, docs, sf)
    got, want = C.quality_fm.kept_model(C._model_folder(spark, sf)), C.quality_fm.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert all((getattr(got, k) == v).all() for k, v in vars(want).items())


def test_run(spark, tables):
    import corpus_pipeline as C

    got = C.run(spark, tables)
    assert got.where("bin_id is not null").count() >= 120
    assert len(C.STAGES) == 5 and C.ORACLE_SQL is None


def test_nothing_else_imports_the_folder():
    root = Path(__file__).resolve().parents[2] / "prismora"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and ".llm" in p.read_text()]
