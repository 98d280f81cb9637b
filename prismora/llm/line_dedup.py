"""Corpus-wide removal of repeated lines, decided as one compressed bitmap per document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._names import fresh
from ._shared import written

_FLAGS = "doc_id {id}, text_hash bigint, pos int, keep boolean, part int, head boolean, h1 bigint, h2 int, last1 bigint, last2 int"


def _first_of_runs(batches):
    """Flags the first row of each run of equal hashes in a sorted partition."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    before = None
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h1 = batch.column("h1").to_numpy(zero_copy_only=False)
        h2 = batch.column("h2").to_numpy(zero_copy_only=False)
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        head = np.zeros(len(h1), bool)
        if before is None:
            head[0] = True
        else:
            new[0] = (h1[0], h2[0]) != before
        before = (h1[-1], h2[-1])
        keep = pa.array(new | batch.column("blank").to_numpy(zero_copy_only=False))
        if held is not None:
            yield held
        n = len(h1)
        held = pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), batch.column("pos"), keep, pa.array(np.full(n, part, np.int32)), pa.array(head), batch.column("h1"), batch.column("h2"), pa.array(np.full(n, h1[-1])), pa.array(np.full(n, h2[-1]))],
            names=["doc_id", "text_hash", "pos", "keep", "part", "head", "h1", "h2", "last1", "last2"],
        )
    if held is not None:
        yield held


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Which lines of each document are the first of their kind in the whole corpus.

    Lines are the parts of a text between line feeds.  Their hashes (96 bits)
    are range-partitioned and sorted by hash, document and position; a streaming
    pass over each range keeps the first row of each run.  The ranges are cut
    on the whole sort key, so a line that repeats very often spreads over
    several tasks; one row a range says whether its first run began earlier.
    Texts don't take part in the shuffles.

    Returns doc_id, text_hash, n_lines, n_kept and bitmap: run lengths, by
    turns of kept and dropped lines, kept first ("3,1,2": lines 4 goes).

    Blank lines are kept.  Documents with null or empty text have no lines to
    drop (n_lines 0, or 1 for the empty line).  A null doc_id sorts first and
    is an id like others.  Rows that repeat an id and text are one document
    and one result row; rows with one id and different texts are told apart by
    text_hash.  Other columns are not read.
    """
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(i.alias("doc_id"), F.xxhash64(t).alias("text_hash"), F.posexplode_outer(F.split(t, "\n")).alias("pos", "line"))
    blank = F.coalesce(F.trim(F.regexp_replace("line", r"[\t\r\f\x0B]", " ")) == "", F.lit(True))
    rows = rows.select(
        "doc_id", "text_hash", "pos", blank.alias("blank"),
        F.when(blank, F.xxhash64("doc_id", "text_hash", "pos")).otherwise(F.xxhash64("line")).alias("h1"),
        F.when(blank, F.lit(0)).otherwise(F.hash("line")).alias("h2"),
    )
    key = ["h1", "h2", "doc_id", "text_hash", "pos"]
    # Rows that repeat a document are equal in all of the key and follow one another.
    ranged = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    flags = written(ranged.mapInArrow(_first_of_runs, _FLAGS.format(id=docs.schema[id_col].dataType.simpleString())), "line-flags")
    heads = flags.where("head").select("part", "h1", "h2")
    lasts = flags.groupBy("part").agg(F.max_by(F.struct("last1", "last2"), F.struct("h1", "h2")).alias("last"))
    ends = {r["part"]: (r["last"]["last1"], r["last"]["last2"]) for r in lasts.collect()}
    order = sorted(ends)
    earlier = dict(zip(order[1:], order))
    late = [r["part"] for r in heads.collect() if r["part"] in earlier and ends[earlier[r["part"]]] == (r["h1"], r["h2"])]  # a row a range
    keep = F.col("keep")
    if late:
        keep = keep & ~(F.col("head") & F.col("part").isin(late))
    per_line = flags.groupBy("doc_id", "text_hash", "pos").agg(F.max(keep).alias("keep"))
    runs = F.array_sort(F.collect_list(F.struct("pos", "keep")))
    bits = per_line.groupBy("doc_id", "text_hash").agg(
        F.count("pos").cast("int").alias("n_lines"),
        F.count(F.when(F.col("keep") & F.col("pos").isNotNull(), 1)).cast("int").alias("n_kept"),
        F.array_join(F.transform(runs, lambda x: F.when(x["pos"].isNull(), "").when(x["keep"], "1").otherwise("0")), "").alias("bits"),
    )
    lengths = F.array_join(F.transform(F.regexp_extract_all("bits", F.lit("(1+|0+)"), F.lit(1)), lambda x: F.length(x).cast("string")), ",")
    return bits.select("doc_id", "text_hash", "n_lines", "n_kept", F.when(F.col("bits").startswith("0"), F.concat(F.lit("0,"), lengths)).otherwise(lengths).alias("bitmap"))


def _one_of_each(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each id and text, nulls being values like others; only rows that may repeat are shuffled."""
    k = fresh(docs, "line_row")
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    row = F.xxhash64(i, i.isNull(), t, t.isNull())
    twice = written(docs.select(row.alias(k)).groupBy(k).count().where("count > 1").select(k), "repeated-rows")
    if twice.isEmpty():
        return docs
    keyed = docs.withColumn(k, row)
    same = keyed.join(twice, k, "left_semi").dropDuplicates([id_col, text_col])
    return keyed.join(twice, k, "left_anti").unionByName(same).drop(k)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the lines that line_bitmaps() doesn't keep.

    Only the bitmaps of documents that lose lines are joined with the texts.
    Documents that had lines and keep none but blank ones go, as do repeats of
    a row's id and text; documents with null or empty text stay.  A column
    n_chars, where there is one, is brought up to date; other columns stay.
    Of an empty table nothing is left.  The work is linear in the lines of a
    document, however long it is and however often kept and dropped lines take
    turns.
    """
    docs = _one_of_each(docs, id_col, text_col)
    maps = line_bitmaps(docs, id_col, text_col)
    h, i, b = fresh(docs, "line_hash"), fresh(docs, "line_id"), fresh(docs, "line_bitmap")
    own_id, own_text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    changed = maps.where("n_kept < n_lines").select(F.col("doc_id").alias(i), F.col("text_hash").alias(h), F.col("bitmap").alias(b))
    # The id may be null and the join is null-safe through the pair of hashes.
    k = fresh(docs, "line_key")
    changed = changed.select(F.xxhash64(i, F.col(i).isNull(), h).alias(k), F.col(h), F.col(b))
    left = docs.withColumn(h, F.xxhash64(own_text)).withColumn(k, F.xxhash64(own_id, own_id.isNull(), F.col(h)))
    left = left.join(changed, [k, h], "left")
    # A flag for each line, then the lines whose flag is set: array_join leaves nulls out.
    flags = F.flatten(F.transform(F.split(b, ","), lambda x, j: F.array_repeat(j % 2 == 0, x.cast("int"))))
    kept = F.zip_with(F.split(own_text, "\n"), flags, lambda line, flag: F.when(flag, line))
    out = left.withColumn(text_col, F.when(F.col(b).isNull(), own_text).otherwise(F.array_join(kept, "\n")))
    out = out.where(F.col(b).isNull() | own_text.rlike(r"\S"))
    if "n_chars" in docs.columns and text_col != "n_chars":
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(b).isNull(), F.col("n_chars")).otherwise(F.length(own_text).cast(kind)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
