"""File sources and sinks."""

from __future__ import annotations

import hashlib
import json
import zipfile
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_TYPE = "id string, title string, url string, kind string, summary string, authors array<string>, affiliations array<string>, affiliation_types array<string>, affiliation_countries array<string>, year int, importance int, duplicate_of string, override boolean"


def read_shards(spark: SparkSession, path: str, record_type: str = RECORD_TYPE) -> DataFrame:
    """Arrays of records in files, with file, pos and seq: files by name, records in array order.

    fields holds what each record itself has, as a map of texts, since a
    correction changes what it has and nothing else.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    each = whole.select("file", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "value"))
    fields = F.from_json("value", "map<string,string>")
    rows = each.select("file", "pos", F.from_json("value", record_type).alias("r"), fields.alias("fields"))
    return rows.select("r.*", "fields", F.regexp_extract("file", r"([^/]+)$", 1).alias("file"), "pos")


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table, or an empty one where the file isn't there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_pool(spark: SparkSession, path: str, row_type: str, wrappers: tuple[str, ...] = ("repos", "entries", "records")) -> DataFrame:
    """Rows of a file that is an array, or an object with the array under one of the names."""
    text = spark.read.text(path, wholetext=True)
    boxed = [F.from_json("value", f"struct<{w}:array<struct<{_ddl(row_type)}>>>")[w] for w in wrappers]
    plain = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{_ddl(row_type)}>>"))
    return text.select(F.posexplode(F.coalesce(plain, *boxed)).alias("pos", "r")).select("pos", "r.*")


def _ddl(columns: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in T._parse_datatype_string(columns).fields)


def read_json_lines(spark: SparkSession, path: str, row_type: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors as file, line from 1 and text): blank lines and // comments are passed over, bad lines don't stop the rest.

    Rows are read line by line from splits; the errors read whole files, for the numbers of their lines.
    """

    def parsed(lines: DataFrame) -> DataFrame:
        live = lines.withColumn("value", F.trim("value")).where("value <> '' and not startswith(value, '//')")
        return live.withColumn("r", F.from_json("value", f"{row_type}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))

    names = [f.name for f in T._parse_datatype_string(row_type).fields]
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("pos", "value"))
    bad = parsed(whole.withColumn("line", F.col("pos") + 1)).where("r._bad is not null or r is null")
    return parsed(spark.read.text(path)).where("r._bad is null and r is not null").select(*[f"r.{n}" for n in names]), bad.select("file", "line", "value")


def read_archives(spark: SparkSession, path: str, most: int = 1 << 20) -> DataFrame:
    """Files of gzipped tar archives: archive (its name without endings), file, text and error.

    Only regular files of `most` bytes at most are read; links, absolute names
    and names that lead out of the archive are passed over, and the folder
    that all lie in is left out of their names.  An archive that can't be read
    is one row with its error, and doesn't stop the rest.
    """

    def run(parts):
        import io
        import tarfile

        import pandas as pd

        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                archive, out = name.rsplit("/", 1)[-1].split(".", 1)[0], []
                try:
                    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                        for m in tar:
                            if m.isfile() and m.size <= most and not m.name.startswith("/") and ".." not in m.name.split("/"):
                                out.append((archive, m.name.split("/", 1)[-1], tar.extractfile(m).read().decode("utf-8", "replace"), None))
                except (tarfile.TarError, EOFError, OSError) as e:
                    out.append((archive, None, None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=["archive", "file", "text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, file string, text string, error string")


def read_csv(spark: SparkSession, path: str, schema: str, arrays: tuple[str, ...] = (), separator: str = r"\|") -> DataFrame:
    """CSV with a header; the array columns are JSON, or parted by the separator."""
    fields = T._parse_datatype_string(schema).fields
    flat = ", ".join(f"{f.name} {'string' if f.name in arrays else f.dataType.simpleString()}" for f in fields)
    df = spark.read.option("header", True).schema(flat).csv(path)
    return df.withColumns({a: F.when(F.col(a).startswith("["), F.from_json(a, "array<string>")).otherwise(F.filter(F.split(a, separator), lambda x: x != "")) for a in arrays})


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, nested columns as JSON."""
    nested = {f.name: F.to_json(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.AtomicType)}
    df.withColumns(nested).write.mode("overwrite").option("header", True).csv(path)


def write_projection(core: DataFrame, detail: DataFrame, postings: DataFrame, path: str, version: int = 1) -> None:
    """The read side: core, details by bucket, postings by token, and a manifest of counts and a hash."""
    from ..operators.assembly import content_hash
    from ..operators.postings import write_postings

    core.write.mode("overwrite").parquet(f"{path}/core")
    detail.repartition("b").write.mode("overwrite").partitionBy("b").parquet(f"{path}/detail")
    write_postings(postings, f"{path}/postings")
    manifest = content_hash(core, ["id"]).crossJoin(core.agg(F.count("*").alias("records"))).crossJoin(postings.agg(F.count_distinct("field", "token").alias("tokens"))).withColumn("schema_version", F.lit(version))
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def read_projection(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(core, detail, postings), after a check of the manifest's version."""
    got = spark.read.json(f"{path}/manifest").first()
    if got is None or got["schema_version"] != version:
        raise ValueError(f"{path}: projection of another version")
    return tuple(spark.read.parquet(f"{path}/{part}") for part in ("core", "detail", "postings"))


def detail_of(detail: DataFrame, id_: str) -> DataFrame:
    """One record's detail: its bucket's partition only."""
    bucket = f"{hashlib.sha256(id_.encode()).digest()[0] & 31:02x}"
    return detail.where((F.col("b") == bucket) & (F.col("id") == id_))


def write_export(df: DataFrame, order: list, path: str) -> None:
    """The legacy export: one JSON array, one space of indent, a final line feed; written whole or not at all.

    One file has one writer; it holds one partition of the sorted rows at a time.
    """
    part = Path(f"{path}.part")
    with part.open("w", encoding="utf-8") as out:
        before = "["
        for r in df.orderBy(*order).select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator():
            out.write(f"{before}\n")
            out.write("\n".join(f" {line}" for line in json.dumps(json.loads(r["j"]), indent=1, ensure_ascii=False).split("\n")))
            before = ","
        out.write("[]\n" if before == "[" else "\n]\n")
    part.replace(path)


def write_chunks(df: DataFrame, key: str, path: str, size: int = 120, first: int = 1) -> None:
    """Numbered chunks by key; chunks that there are already are never written over."""
    from ..operators.worklists import batches

    batches(df, size, F.col(key), name="chunk").withColumn("chunk", F.col("chunk") + (first - 1)).write.mode("errorifexists").partitionBy("chunk").json(path)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the first sheets of workbooks: file, pos and the cells by header, read on the executors."""

    def run(parts):
        import io

        import pandas as pd

        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                rows = read_sheet(io.BytesIO(content))
                yield pd.DataFrame({"file": name.rsplit("/", 1)[-1], "pos": range(len(rows)), "cells": rows}, columns=["file", "pos", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, pos int, cells map<string,string>")


def read_sheet(path) -> list[dict[str, str]]:
    """Rows of the first sheet of a workbook, by its header row."""
    with zipfile.ZipFile(path) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iterfind(".//{*}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("{*}si")]
        rows = []
        for row in ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iterfind(".//{*}row"):
            cells = {}
            for c in row.iterfind("{*}c"):
                v = c.find("{*}v")
                inline = "".join(t.text or "" for t in c.iterfind(".//{*}t"))
                text = inline if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                cells["".join(x for x in c.get("r", "") if x.isalpha())] = text or ""
            rows.append(cells)
    head = rows[0] if rows else {}
    return [{name: r.get(col, "") for col, name in head.items()} for r in rows[1:]]
