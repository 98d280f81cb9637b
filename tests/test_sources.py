"""Sources, sinks and the streamed log."""

import json
import zipfile

import pytest
from prismora.functions import derive
from prismora.operators import assembly as A
from prismora.operators import postings as P
from prismora.sources import files, paged
from prismora.streaming import shards
from pyspark.sql import functions as F


def test_shards_keep_order_and_presence(spark, tmp_path):
    d = tmp_path / "shards"
    d.mkdir()
    (d / "002-b.json").write_text(json.dumps([{"id": "a", "override": True, "authors": [], "year": 2020}]))
    (d / "001-a.json").write_text(json.dumps([{"id": "a", "url": "u", "authors": ["x"]}, {"id": "b", "url": "v"}]))
    rows = files.read_shards(spark, str(d)).orderBy("file", "pos").collect()
    assert [(r["file"], r["pos"], r["id"]) for r in rows] == [("001-a.json", 0, "a"), ("001-a.json", 1, "b"), ("002-b.json", 0, "a")]
    assert set(rows[2]["fields"]) == {"id", "override", "authors", "year"} and rows[2]["authors"] == [] and rows[1]["authors"] is None


def test_files_of_many_lines(spark, tmp_path):
    """Shards and pools are written with line breaks inside their arrays; errors in lines have their numbers."""
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "1.json").write_text(json.dumps([{"id": "a", "url": "u"}, {"id": "b"}], indent=1))
    assert [(r["pos"], r["id"]) for r in files.read_shards(spark, str(tmp_path / "s")).orderBy("pos").collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "p.json").write_text(json.dumps({"entries": [{"a": 1}, {"a": 2}]}, indent=2))
    assert [r["a"] for r in files.read_pool(spark, str(tmp_path / "p.json"), "a int").orderBy("pos").collect()] == [1, 2]
    (tmp_path / "x.jsonl").write_text('// note\n\n{"a": 1}\n{"a": \n{"a": 3}\nno\n')
    _, errors = files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int")
    assert [(r["file"][-7:], r["line"], r["value"]) for r in errors.orderBy("line").collect()] == [("x.jsonl", 4, '{"a":'), ("x.jsonl", 6, "no")]


def test_archives(spark, tmp_path):
    import io
    import tarfile

    from prismora.functions.text import pattern_hits

    for name, members in (("own__one", {"one-main/src/a.py": b"import alpha\nx = 1\n", "one-main/README.md": "größe".encode(), "../evil.py": b"no", "/abs.py": b"no", "one-main/big.bin": b"z" * 5000, "one-main/raw.bin": b"\xff\xfe\x00"}), ("own__bad", None)):
        with open(tmp_path / f"{name}.tar.gz", "wb") as f:
            if members is None:
                f.write(b"not an archive")
                continue
            with tarfile.open(fileobj=f, mode="w:gz") as tar:
                for path, data in members.items():
                    info = tarfile.TarInfo(path)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
                link = tarfile.TarInfo("one-main/link")
                link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
                tar.addfile(link)
    got = files.read_archives(spark, str(tmp_path / "*.tar.gz"), most=1000)
    rows = {(r["archive"], r["file"]): (r["text"], r["error"]) for r in got.collect()}
    assert rows["own__one", "src/a.py"] == ("import alpha\nx = 1\n", None) and rows["own__one", "README.md"][0] == "größe"
    assert {f for a, f in rows if a == "own__one"} == {"src/a.py", "README.md", "raw.bin"} and rows["own__bad", None][1]
    hits = got.where("text is not null").select("file", F.explode(pattern_hits(F.col("text"), {"alpha": r"\bimport alpha\b"})).alias("h"))
    assert [(r["file"], r["h"]["line"]) for r in hits.collect()] == [("src/a.py", 1)]


def test_pools_in_both_shapes(spark, tmp_path):
    for name, value in (("list", [{"a": 1}, {"a": 2}]), ("boxed", {"repos": [{"a": 1}, {"a": 2}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
        got = files.read_pool(spark, str(tmp_path / f"{name}.json"), "a int").collect()
        assert [(r["pos"], r["a"]) for r in got] == [(0, 1), (1, 2)]
    assert files.optional_json(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_json_lines_collect_errors(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('// note\n\n{"a": 1}\n{"a": \n{"a": 3}\n')
    rows, errors = files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int")
    assert sorted(r["a"] for r in rows.collect()) == [1, 3] and [r["value"] for r in errors.collect()] == ['{"a":']


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "i int, tags array<string>")
    files.write_csv(df, str(tmp_path / "c"))
    got = files.read_csv(spark, str(tmp_path / "c"), "i int, tags array<string>", ("tags",))
    assert sorted((r["i"], r["tags"]) for r in got.collect()) == [(1, ["a", "b"]), (2, [])]


def test_projection_and_lookup(spark, tmp_path):
    core = spark.createDataFrame([(i, f"p{i}", f"title {i}") for i in range(40)], "i bigint, id string, title string")
    detail = core.select("id", F.concat(F.lit("about "), "id").alias("summary"), derive.bucket_of(F.col("id")).alias("b"))
    files.write_projection(core, detail, P.build_postings(core, "i", {"text": F.col("title")}), str(tmp_path / "site"))
    got_core, got_detail, got_postings = files.read_projection(spark, str(tmp_path / "site"))
    assert got_core.count() == 40 and files.detail_of(got_detail, "p7").first()["summary"] == "about p7"
    assert sorted(r["i"] for r in P.search(got_postings, "title 3").collect()) == [3, *range(30, 40)]
    with pytest.raises(ValueError):
        files.read_projection(spark, str(tmp_path / "site"), 2)


def test_export_and_chunks(spark, tmp_path):
    df = spark.createDataFrame([("b", "ü"), ("a", None)], "id string, t string")
    files.write_export(df, ["id"], str(tmp_path / "e.json"))
    assert (tmp_path / "e.json").read_text() == '[\n {\n  "id": "a"\n },\n {\n  "id": "b",\n  "t": "ü"\n }\n]\n'
    files.write_chunks(df, "id", str(tmp_path / "chunks"), size=1, first=5)
    assert sorted(p.name for p in (tmp_path / "chunks").glob("chunk=*")) == ["chunk=5", "chunk=6"]
    with pytest.raises(Exception):  # noqa: B017
        files.write_chunks(df, "id", str(tmp_path / "chunks"))


def test_export_of_many_rows_and_none(spark, tmp_path):
    df = spark.range(300).select("id", F.array(F.col("id"), F.lit(1)).alias("x"), F.struct(F.lit("a\nb").alias("t")).alias("s")).repartition(5)
    files.write_export(df, ["id"], str(tmp_path / "e.json"))
    assert (tmp_path / "e.json").read_text() == json.dumps([{"id": i, "x": [i, 1], "s": {"t": "a\nb"}} for i in range(300)], indent=1) + "\n"
    files.write_export(df.where("false"), ["id"], str(tmp_path / "n.json"))
    assert json.loads((tmp_path / "n.json").read_text()) == []


def test_sheet(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><r><t>A</t></r><r><t>da</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>3</v></c></row></sheetData></worksheet>')
    assert files.read_sheet(str(tmp_path / "s.xlsx")) == [{"name": "Ada", "n": "3"}]
    assert [tuple(r) for r in files.read_sheets(spark, str(tmp_path / "*.xlsx")).collect()] == [("s.xlsx", 0, {"name": "Ada", "n": "3"})]


def test_paged_source(spark):
    def fetch(anchor, cursor):
        at = int(cursor or 0)
        return [(at + k,) for k in range(2)], str(at + 2) if at < 4 else None

    got = paged.read_paged(spark, fetch, ["x", "y"], "n int").collect()
    assert sorted((r["anchor"], r["n"]) for r in got) == [(a, n) for a in "xy" for n in range(6)]
    assert paged.read_paged(spark, fetch, ["x"], "n int", most=3).count() == 3


def test_planning_helpers(spark):
    sizes = list(range(100))
    count = lambda a, b: sum(a <= s <= b for s in sizes)
    ranges = paged.bisected(count, 0, 127, 10)
    assert all(count(a, b) <= 10 for a, b in ranges) and sorted(s for a, b in ranges for s in range(a, b + 1) if s < 100) == sizes
    name, text, log = paged.first_route([("a", lambda k: None), ("b", lambda k: 1 / 0), ("c", lambda k: "x" * 9)], "k", 5)
    assert (name, text) == ("c", "x" * 9) and log == ["a: 0 characters", "b: ZeroDivisionError", "c: ok"]
    rows = spark.createDataFrame([(1, "k"), (2, None)], "i int, key string")
    got = {r["i"]: (r["route"], r["text"], r["log"]) for r in paged.routed(rows, "key", [("a", lambda k: None), ("b", lambda k: 1 / 0), ("c", lambda k: k * 9)], 5).collect()}
    assert got == {1: ("c", "k" * 9, ["a: 0 characters", "b: ZeroDivisionError", "c: ok"]), 2: (None, None, [])}
    left = paged.todo(spark.range(5), spark.range(3), "id")
    assert sorted(r["id"] for r in left.collect()) == [3, 4]


def test_streamed_log_folds_like_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"seq": 1, "id": "a", "override": False, "fields": {"url": "u"}}, {"seq": 2, "id": "a", "override": True, "fields": {"t": "1"}}, {"seq": 3, "id": "b", "override": False, "fields": {"url": "u/"}}]
    seen = []
    for k, part in enumerate((rows[:1], rows[1:])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        shards.follow(spark, str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "ck"), lambda log: seen.append(log.count())).awaitTermination()
    assert seen == [1, 3]
    log = spark.read.parquet(str(tmp_path / "log"))
    assert {(r["seq"], r["state"]) for r in A.fold_log(log).collect()} == {(1, "kept"), (2, "applied"), (3, "duplicate")}


def test_scratch_leaves_nothing(spark):
    from pathlib import Path

    from prismora.cluster import scratch, shared_dir, written

    local_folder = lambda s: Path(shared_dir(s).removeprefix("file://"))

    before = set(local_folder(spark).iterdir())
    with scratch(spark):
        outer = written(spark.range(5), "outer")
        with scratch(spark):
            assert written(spark.range(7), "inner").count() == 7
        assert outer.count() == 5 and len(set(local_folder(spark).iterdir()) - before) == 1
    assert set(local_folder(spark).iterdir()) == before
