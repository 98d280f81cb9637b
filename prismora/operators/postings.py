"""Inverted indexes as tables, and token search over them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, fold_text, tokenize


#: Ordinals that one row of a token spans.
BLOCK = 1 << 16


def build_postings(records: DataFrame, ordinal: str, fields: dict[str, Column]) -> DataFrame:
    """(field, token, block, ids): for each token of each field the rising distinct ordinals of its records.

    The ordinals are cut into blocks of BLOCK, a row each, so a common token
    doesn't gather the whole corpus in one row.
    """
    each = None
    for name, text in fields.items():
        rows = records.select(F.lit(name).alias("field"), F.col(ordinal).alias("i"), F.explode(F.array_distinct(tokenize(fold(text)))).alias("token"))
        each = rows if each is None else each.unionByName(rows)
    return each.groupBy("field", "token", F.floor(F.col("i") / BLOCK).alias("block")).agg(F.array_sort(F.collect_set("i")).alias("ids"))


def write_postings(postings: DataFrame, path: str, partitions: int | None = None) -> None:
    """Sorted by token, so that a lookup or prefix reads the few row groups with it."""
    keyed = postings.repartitionByRange(partitions, "token") if partitions else postings.repartitionByRange("token")
    keyed.sortWithinPartitions("token", "field", "block").write.mode("overwrite").parquet(path)


def exact(postings: DataFrame, term: str) -> DataFrame:
    return postings.where(F.col("token") == term).select(F.explode("ids").alias("i")).distinct()


def with_prefix(postings: DataFrame, term: str) -> DataFrame:
    """Records of all tokens that begin so; a range of tokens, which the scan can prune by."""
    return postings.where((F.col("token") >= term) & F.startswith(F.col("token"), F.lit(term))).select(F.explode("ids").alias("i")).distinct()


def terms_of(text: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+|_+", fold_text(text)) if t]


def prefix_wanted(text: str) -> bool:
    """The last term is still being typed: the trimmed text ends with a letter or digit."""
    text = text.strip()
    return bool(text) and text[-1].isalnum()


def search(postings: DataFrame, text: str) -> DataFrame | None:
    """Ordinals of records with all terms, each in any field, the last as a prefix.

    None: a blank text, no constraint.  A text of punctuation, or with a term
    that nothing has, matches nothing.
    """
    if not text.strip():
        return None
    terms = terms_of(text)
    if not terms:
        return postings.where(F.lit(False)).select(F.explode("ids").alias("i"))
    wanted = {t: False for t in terms}
    if prefix_wanted(text):
        wanted[terms[-1]] = True
    fits = [F.when((F.col("token") >= t) & F.startswith(F.col("token"), F.lit(t)) if p else F.col("token") == t, F.lit(k)) for k, (t, p) in enumerate(wanted.items())]
    any_fits = None
    for t, p in wanted.items():
        one = (F.col("token") >= t) & F.startswith(F.col("token"), F.lit(t)) if p else F.col("token") == t
        any_fits = one if any_fits is None else any_fits | one
    hits = postings.where(any_fits).select(F.explode(F.array_compact(F.array(*fits))).alias("term"), "ids").select("term", F.explode("ids").alias("i"))
    return hits.groupBy("i").agg(F.count_distinct("term").alias("terms")).where(F.col("terms") == len(wanted)).select("i")
