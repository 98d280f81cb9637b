"""Data-quality constraints: each a query that returns what violates it, as (check, id, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_url


def _violations(df: DataFrame, check: str, id_: Column, detail: Column, where: Column) -> DataFrame:
    return df.where(where).select(F.lit(check).alias("check"), id_.cast("string").alias("id"), detail.cast("string").alias("detail"))


def unreadable(errors: DataFrame) -> DataFrame:
    """Lines that a source couldn't read (file, line, value), as 'file:line'."""
    return _violations(errors, "unreadable", F.concat_ws(":", F.regexp_extract("file", r"([^/]+)$", 1), F.col("line").cast("string")), F.col("value"), F.lit(True))


def required(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Missing required fields, one row each: a single pass, no union of scans."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def gone(c: str) -> Column:
        k = kinds[c]
        return F.col(c).isNull() | ((F.trim(c) == "") if k == "string" else (F.size(c) == 0) if k.startswith(("array", "map")) else F.lit(False))

    lost = F.array_compact(F.array(*[F.when(gone(c), F.lit(c)) for c in fields]))
    return df.select(F.lit("required").alias("check"), F.col(id_col).cast("string").alias("id"), F.explode(lost).alias("detail"))


def unique(df: DataFrame, id_col: str, key: Column, check: str = "unique") -> DataFrame:
    return df.where(key.isNotNull() & (key != "")).groupBy(key.cast("string").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(check).alias("check"), "id", F.col("n").cast("string").alias("detail"))


def unique_urls(df: DataFrame, id_col: str, url: str) -> DataFrame:
    return unique(df, id_col, norm_url(F.col(url)), "unique_url")


def known_target(df: DataFrame, id_col: str, target: str, records: DataFrame, record_id: str, check: str = "target") -> DataFrame:
    """References to records that there aren't."""
    known = records.select(F.col(record_id).alias("_k")).distinct()
    lost = df.where(F.col(target).isNotNull()).join(known, F.col(target) == F.col("_k"), "left_anti")
    return lost.select(F.lit(check).alias("check"), F.col(id_col).cast("string").alias("id"), F.col(target).cast("string").alias("detail"))


def vocabulary(df: DataFrame, id_col: str, values: Column, vocab: DataFrame, term: str) -> DataFrame:
    """Values outside a closed vocabulary."""
    used = df.select(F.col(id_col).cast("string").alias("id"), F.explode(values).alias("detail"))
    return used.join(vocab.select(F.col(term).alias("detail")).distinct(), "detail", "left_anti").select(F.lit("vocabulary").alias("check"), "id", "detail")


def in_range(df: DataFrame, id_col: str, field: str, low, high) -> DataFrame:
    return _violations(df, f"range_{field}", F.col(id_col), F.col(field), F.col(field).isNotNull() & ~F.col(field).between(low, high))


def url_shape(df: DataFrame, id_col: str, url: str) -> DataFrame:
    """Not http(s) with a host and without white space."""
    u = F.coalesce(F.col(url), F.lit(""))
    return _violations(df, "url_shape", F.col(id_col), F.col(url), ~u.rlike(r"^https?://[^/\s?#]+\.[^/\s?#]+[^\s]*$"))


def repo_shape(df: DataFrame, id_col: str, url: str) -> DataFrame:
    """Repository URLs with another number of path parts than two."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.col(url), r"^https?://[^/]+", ""), r"[?#].*$", ""), "/"), lambda p: p != "")
    return _violations(df, "repo_shape", F.col(id_col), F.col(url), F.size(parts) != 2)


def aligned(df: DataFrame, id_col: str, left: str, right: str) -> DataFrame:
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)))
    return _violations(df, "aligned", F.col(id_col), F.concat_ws("<>", size(left), size(right)), size(left) != size(right))


def one_fact(df: DataFrame, key: str, fact: Column) -> DataFrame:
    """Keys with several facts."""
    n = df.groupBy(F.col(key).cast("string").alias("id")).agg(F.count_distinct(fact).alias("n"))
    return n.where("n > 1").select(F.lit("one_fact").alias("check"), "id", F.col("n").cast("string").alias("detail"))


def agreeing(df: DataFrame, id_col: str, a: Column, b: Column, check: str) -> DataFrame:
    """Both there, and different."""
    return _violations(df, check, F.col(id_col), F.concat_ws(" <> ", a, b), a.isNotNull() & b.isNotNull() & (a != b))


def patch_conflicts(patches: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """Fields that patches give different values."""
    n = patches.groupBy(key, field).agg(F.count_distinct(value).alias("n")).where("n > 1")
    return n.select(F.lit("patch_conflict").alias("check"), F.col(key).cast("string").alias("id"), F.concat_ws(":", field, F.col("n").cast("string")).alias("detail"))


def cautious(df: DataFrame, id_col: str, integration: str, confidence: str) -> DataFrame:
    """An unclear integration with high confidence."""
    return _violations(df, "unclear_high", F.col(id_col), F.col(integration), (F.col(integration) == "unclear") & (F.col(confidence) == "high"))


def lossless(full: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Rows that stripping and joining again would change."""
    return full.exceptAll(rebuilt)


def drift(left: DataFrame, right: DataFrame, key: str, exact: list[str], near: dict[str, float]) -> DataFrame:
    """Full outer comparison: one-sided keys, changed fields, and numbers beyond their tolerance."""
    a = left.select(key, F.struct(*exact, *near).alias("a"))
    b = right.select(key, F.struct(*exact, *near).alias("b"))
    both = a.join(b, key, "full_outer")
    found = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in exact]
    found += [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) & (F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")), F.lit(float("inf"))) > tol), F.lit(c)) for c, tol in near.items()]
    detail = F.when(F.col("a").isNull(), "only right").when(F.col("b").isNull(), "only left").otherwise(F.array_join(F.array_compact(F.array(*found)), ","))
    return both.select(F.col(key), detail.alias("detail")).where("detail <> ''")


def run_constraints(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
