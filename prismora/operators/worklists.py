"""Worklists: candidates, reasons, batches, budgets, slugs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected


def excluded_with_reason(candidates: DataFrame, key: Column, lists: list[tuple[str, DataFrame, str]]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with the first matching reason)."""
    out, flags = candidates.withColumn("_k", key), []
    for n, (reason, table, column) in enumerate(lists):
        out = out.join(table.select(F.col(column).alias("_k"), F.lit(reason).alias(f"_r{n}")).distinct(), "_k", "left")
        flags.append(F.col(f"_r{n}"))
    out = out.withColumn("reason", F.coalesce(*flags)).drop("_k", *[f"_r{n}" for n in range(len(lists))])
    return out.where("reason is null").drop("reason"), out.where("reason is not null")


def unseen(candidates: DataFrame, keys: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Candidates that no list holds by any of its keys; a null key is unseen."""
    for column, table, other in keys:
        candidates = candidates.join(table.select(F.col(other).alias("_k")).where("_k is not null").distinct(), F.col(column) == F.col("_k"), "left_anti")
    return candidates


def batches(df: DataFrame, size: int, *order: Column, name: str = "batch") -> DataFrame:
    """Batch number from 1 by order; rows are numbered range by range, not in one task."""
    from .assembly import ordinals

    at = ordinals(df.orderBy(*order), "_at")
    return at.withColumn(name, (F.floor(F.col("_at") / F.lit(size)) + 1).cast("int")).drop("_at")


def capped_list(items: Column, most: int, more: str = "et al.") -> Column:
    """The items joined, the rest told by a word."""
    return F.when(F.size(items) > most, F.concat_ws("; ", F.array_join(F.slice(items, 1, most), "; "), F.lit(more))).otherwise(F.array_join(items, "; "))


def budget_prefix(df: DataFrame, group: list[str], order: list[Column], length: Column, most: int) -> DataFrame:
    """Rows of each group up to the first that would overflow the budget; later ones that would fit stay out too."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(length).over(w)).where(F.col("running") <= most)


def frequency_sample(counts: DataFrame, value: str, n: str, each: int) -> DataFrame:
    """The first `each` values of the upper, middle and lower third by frequency; earlier thirds take what is over."""
    from .assembly import ordinals

    placed = ordinals(counts.orderBy(F.col(n).desc(), F.col(value).asc()), "_at")
    total = placed.count()
    low = total // 3 + (total % 3 > 0)
    mid = low + total // 3 + (total % 3 > 1)
    at = F.col("_at")
    third = F.when(at < low, "high").when(at < mid, "mid").otherwise("low")
    first = F.when(at < low, 0).when(at < mid, low).otherwise(mid)
    return placed.where(at - first < each).withColumn("third", third).drop("_at")


_STOP = frozenset("a an the of on in into to for from by at as and or with is are be via using toward towards based study approach novel new its their that this these over under between through data".split())


def slug_stem(title: Column, prefix: Column) -> Column:
    """prefix and up to four content words of three letters or more."""
    words = F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*sorted(_STOP)))
    stem = F.array_join(F.slice(words, 1, 4), "-")
    return F.concat_ws("-", prefix, F.when(stem == "", "untitled").otherwise(stem))


def _fit(slug: str, most: int) -> str:
    if len(slug) <= most:
        return slug
    cut = slug[:most].rstrip("-")
    at = cut.rfind("-")
    return (cut[:at] if at > 9 else cut).rstrip("-")


def slugs(df: DataFrame, stem: str, year: str, order: list[str], taken: DataFrame, taken_col: str, most: int = 60, name: str = "slug", alternative: str | None = None) -> DataFrame:
    """A free id for each row: the stem and year, else the alternative stem where there is one, else numbered -2, -3, ...

    Uniqueness depends on order, so rows that could compete are numbered in
    order, nulls first; the others are independent of one another.  Rows whose
    trimmed stems meet, or that meet a taken id, are in one group by the first
    two words; where rows fall back on alternatives, groups that these connect
    are one.
    """
    head = lambda c: F.array_join(F.slice(F.split(c, "-"), 1, 2), "-")
    names = [f"o{k}" for k in range(len(order))]
    rows = df.select(
        F.to_json(F.struct(*df.columns)).alias("row"), F.col(stem).alias("stem"), (F.col(alternative) if alternative else F.lit(None).cast("string")).alias("other"), F.col(year).cast("string").alias("year"),
        *[F.col(c).alias(o) for c, o in zip(order, names)], head(F.col(stem)).alias("head"),
    )
    used = taken.select(F.col(taken_col).alias("id"), head(F.col(taken_col)).alias("head"))
    if alternative:
        # Only a stem that comes twice or is taken can need its alternative; what this meets is in its group.
        edges = rows.select(F.xxhash64("head").alias("u"), F.xxhash64(head(F.col("other"))).alias("v")).where("u <> v").distinct()
        roots = connected(edges).groupBy("node").agg(F.min("root").alias("root"))
        grouped = lambda x: x.withColumn("node", F.xxhash64("head")).join(roots, "node", "left").withColumn("head", F.coalesce("root", "node").cast("string")).drop("node", "root")
        rows, used = grouped(rows), grouped(used)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        seen, out, free = set(right["id"]), [], {}
        for r in left.sort_values([*names, "row"], na_position="first").itertuples():
            tail = f"-{r.year}" if r.year else ""
            slug = _fit(r.stem, most - len(tail)) + tail
            if slug in seen and r.other:
                slug = _fit(r.other, most - len(tail)) + tail
            if slug in seen:
                k = free.get((r.stem, tail), 2)  # lower numbers stay taken
                while slug in seen:
                    mark = f"-{k}{tail}"
                    slug, k = _fit(r.stem, most - len(mark)) + mark, k + 1
                free[r.stem, tail] = k
            seen.add(slug)
            out.append((r.row, slug))
        return pd.DataFrame(out, columns=["row", "slug"])

    got = rows.groupBy("head").cogroup(used.groupBy("head")).applyInPandas(run, "row string, slug string")
    again = got.select(F.from_json("row", df.schema).alias("r"), "slug")
    return again.select(*[F.col(f"r.`{c}`") for c in df.columns if c != name], F.col("slug").alias(name))


def claims_backfill(claimed: DataFrame, found: DataFrame, key: str, values: str) -> DataFrame:
    """Override rows for records whose code shows what they don't claim: the sorted union."""
    side = found.groupBy(key).agg(F.array_sort(F.collect_set(values)).alias("_f"))
    out = claimed.join(side, key).withColumn("_all", F.array_sort(F.array_union(values, "_f")))
    return out.where(F.size("_all") > F.size(F.array_distinct(values))).select(key, F.lit(True).alias("override"), F.col("_all").alias(values))


def groups_of_copies(records: DataFrame, id_col: str, duplicate_of: str) -> DataFrame:
    """Records that aren't copies, with the sorted ids of theirs."""
    copies = records.where(F.col(duplicate_of).isNotNull()).groupBy(F.col(duplicate_of).alias("_k")).agg(F.array_sort(F.collect_list(id_col)).alias("copies"))
    base = records.where(F.col(duplicate_of).isNull())
    return base.join(copies, base[id_col] == F.col("_k"), "left").select(id_col, F.coalesce("copies", F.array().cast("array<string>")).alias("copies"))
