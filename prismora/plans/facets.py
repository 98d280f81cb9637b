"""The faceted query engine: one scan, one bit a facet, counts that leave out their own facet."""

from __future__ import annotations

import json
import math
from collections import OrderedDict
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..cluster import written
from ..functions.derive import NONE
from ..functions.text import fold_text

SELECT_FACETS = ("kind", "component", "concept", "use_case", "integration", "industry", "authors", "affiliations", "year")
PERMIT_FACETS = ("aff_type", "aff_region")
ALL_LIT: Mapping[str, frozenset[str]] = {
    "aff_type": frozenset(["academic", "non_academic", "unaffiliated"]),
    "aff_region": frozenset(["americas", "europe", "asia", "africa_oceania"]),
}
#: Facets whose values vanish from the panel at a count of 0 unless selected.
HIDE_EMPTY = ("authors", "affiliations")
KIND_ORDER = ("paper", "preprint", "thesis", "code_repo", "documentation", "tutorial", "blog_post", "case_study", "dataset_benchmark", "announcement", "news_article", "video", "forum", "patent")
CONFIDENCE_ORDER = {"high": 3, "medium": 2, "low": 1}


@dataclass(frozen=True)
class FacetQuery:
    """A query's state; changes give new states."""

    text: str = ""
    scope: str = "all"  # all: tokens of all indexes; title: folded title; substring: title and summary
    min_importance: int = 1
    min_popularity: int = 0
    select: Mapping[str, frozenset[str]] = field(default_factory=dict)
    permit: Mapping[str, frozenset[str]] = field(default_factory=lambda: dict(ALL_LIT))
    group: str = "none"
    sort: str = "importance"
    limit: int | None = 100

    def changed(self, **values) -> FacetQuery:
        """Another filter, group or sort: the page starts anew."""
        return replace(self, **{"limit": 100, **values})

    def toggled(self, facet: str, value: str) -> FacetQuery:
        now = set(self.select.get(facet, ()))
        now ^= {value}
        return self.changed(select={**self.select, facet: frozenset(now)})

    def toggled_permit(self, facet: str, value: str, all_lit: Mapping[str, frozenset[str]] = ALL_LIT) -> FacetQuery:
        """A group never goes dark: of two the other one lights up, of more all do."""
        now = frozenset(set(self.permit.get(facet, all_lit[facet])) ^ {value})
        if not now:
            now = all_lit[facet] - {value} if len(all_lit[facet]) == 2 else all_lit[facet]
        return self.changed(permit={**self.permit, facet: now})

    def cleared(self) -> FacetQuery:
        """All filters off; scope, group and sort stay."""
        return FacetQuery(scope=self.scope, group=self.group, sort=self.sort, min_importance=0)

    def more(self, step: int = 100) -> FacetQuery:
        return replace(self, limit=None if self.limit is None else self.limit + step)

    def signature(self) -> str:
        """The same for states with equal results."""
        lit = {f: sorted(v) for f, v in self.permit.items() if v and v != ALL_LIT.get(f)}
        chosen = {f: sorted(v) for f, v in self.select.items() if v}
        return json.dumps([" ".join(self.text.split()).lower(), self.scope, self.min_importance, self.min_popularity, chosen, lit], sort_keys=True)


# == predicates


def importance_floor(least: int, importance: str = "importance") -> Column:
    """Unrated records fall out at any floor above 0."""
    return F.lit(True) if least <= 0 else F.coalesce(F.col(importance) >= least, F.lit(False))


def popularity_threshold(corpus: DataFrame, percent: int, pop: str = "pop") -> DataFrame:
    """One row: the value at floor(n p / 100) of the whole corpus in rising order, -1 for p = 0.

    It is found from the counts of distinct values, sorted by range: sums of
    the ranges tell which holds the place, running sums in that range the value.
    """
    spark = corpus.sparkSession
    if percent <= 0:
        return spark.sql("SELECT CAST(-1 AS DOUBLE) AS threshold")
    values = corpus.where(F.col(pop).isNotNull()).groupBy(F.col(pop).cast("double").alias("threshold")).agg(F.count("*").alias("n"))
    counts = written(values.orderBy("threshold").withColumn("part", F.spark_partition_id()), "popularity")
    sums = sorted(map(tuple, counts.groupBy("part").agg(F.sum("n")).collect()))  # a row a range
    n = sum(m for _, m in sums)
    rank = min(n * percent // 100, n - 1)
    for part, m in sums:
        if rank < m:
            running = F.sum("n").over(Window.partitionBy("part").orderBy("threshold"))
            return counts.where(F.col("part") == part).withColumn("running", running).where(F.col("running") > rank).agg(F.min("threshold").alias("threshold"))
        rank -= m
    return spark.createDataFrame([], "threshold double")


def includes(values: Column, chosen) -> Column:
    """Any of the record's values is chosen; an empty choice passes all."""
    return F.arrays_overlap(values, F.array(*[F.lit(v) for v in sorted(chosen)])) if chosen else F.lit(True)


def permits(values: Column, lit, everything) -> Column:
    """All of the record's values are lit; no value passes, as does a group that is all lit or all dark."""
    if not lit or frozenset(lit) >= frozenset(everything):
        return F.lit(True)
    return F.forall(values, lambda v: v.isin(*sorted(lit)))


def title_contains(folded_title: Column, text: str) -> Column:
    needle = fold_text(" ".join(text.split()))
    return F.contains(folded_title, F.lit(needle)) if needle else F.lit(True)


def substring_contains(title: Column, summary: Column, text: str) -> Column:
    needle = text.strip().lower()
    return F.contains(F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(summary, F.lit("")))), F.lit(needle)) if needle else F.lit(True)


# == one pass


def masked(base: DataFrame, query: FacetQuery, select: tuple[str, ...], permit: tuple[str, ...] = PERMIT_FACETS, all_lit: Mapping[str, frozenset[str]] = ALL_LIT) -> tuple[DataFrame, dict[str, int]]:
    """base with _mask, a bit for each active facet that the record fails, and the bits."""
    bits, mask = {}, F.lit(0)
    for f in (*select, *permit):
        if f in permit:
            lit = query.permit.get(f, frozenset())
            if not lit or lit >= all_lit[f]:
                continue
            passes = permits(F.col(f), lit, all_lit[f])
        else:
            if not query.select.get(f):
                continue
            passes = includes(F.col(f), query.select[f])
        bits[f] = 1 << len(bits)
        mask = mask + F.when(passes, 0).otherwise(bits[f])
    return base.withColumn("_mask", mask), bits


def facet_counts(with_mask: DataFrame, bits: Mapping[str, int], facets: tuple[str, ...]) -> DataFrame:
    """(facet, value, n): records that fail no facet but perhaps that one.

    One scan and one shuffle of partial counts: records are exploded to
    (facet, value) in the map stage and never joined.
    """

    def entries(f: str) -> Column:
        others = F.col("_mask").bitwiseAND(F.lit(~bits.get(f, 0))) == 0
        pairs = F.transform(F.array_distinct(F.col(f)), lambda v: F.struct(F.lit(f).alias("facet"), v.cast("string").alias("value")))
        return F.when(others, pairs).otherwise(F.array().cast("array<struct<facet:string,value:string>>"))

    pairs = with_mask.select(F.explode(F.concat(*[entries(f) for f in facets])).alias("e"))
    return pairs.groupBy("e.facet", "e.value").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, facets: tuple[str, ...]) -> DataFrame:
    return facet_counts(df.withColumn("_mask", F.lit(0)), {}, facets)


def zero_filled(universe: DataFrame, counts: DataFrame) -> DataFrame:
    return universe.join(counts, ["facet", "value"], "left").select("facet", "value", F.coalesce("n", F.lit(0)).alias("n"))


# == order


def sort_keys(sort: str, title: str = "title", ordinal: str = "i") -> list[Column]:
    """Keys of a result order; ties fall to the corpus ordinal."""
    importance, pop, year = F.coalesce("importance", F.lit(-1)).desc(), F.col("pop").desc(), F.coalesce("year_n", F.lit(0)).desc()
    name = F.collate(F.lower(title), "UNICODE").asc()
    keys = {"importance": [importance, pop, year, name], "popularity": [pop, importance, year, name], "title": [name]}
    return [*keys.get(sort, [year, name]), F.col(ordinal).asc()]


def page(results: DataFrame, sort: str, limit: int | None) -> DataFrame:
    """The first records: a distributed top-k, not a full sort."""
    out = results.orderBy(*sort_keys(sort))
    return out if limit is None else out.limit(limit)


def with_position(page_df: DataFrame, sort: str) -> DataFrame:
    """pos from 0 over a page of at most a few hundred records."""
    return page_df.withColumn("pos", F.row_number().over(Window.orderBy(*sort_keys(sort))) - 1)


def panel_order(counts: DataFrame) -> DataFrame:
    """pos within each facet: the sentinel last, confidence by rank, year falling, else count falling, then label."""
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE_ORDER.items() for x in kv]), F.col("value")), F.lit(0))
    first = F.when(F.col("facet") == "confidence", -rank).when(F.col("facet") == "year", -F.coalesce(F.col("value").try_cast("int"), F.lit(0))).otherwise(-F.col("n"))
    w = Window.partitionBy("facet").orderBy((F.col("value") == NONE).asc(), first.asc(), F.col("label").asc(), F.col("value").asc())
    return counts.withColumn("pos", (F.row_number().over(w) - 1).cast("int"))


def capped(ordered: DataFrame, most: int = 200, searching: str = "") -> DataFrame:
    """The panel's first values, or all with the searched text in them."""
    if searching.strip():
        return ordered.where(F.contains(F.lower("value"), F.lit(searching.strip().lower())))
    return ordered.where(F.col("pos") < most)


def visible_values(counts: DataFrame, query: FacetQuery) -> DataFrame:
    chosen = [f"{f}\0{v}" for f in HIDE_EMPTY for v in query.select.get(f, ())]
    return counts.where(~F.col("facet").isin(*HIDE_EMPTY) | (F.col("n") > 0) | F.concat_ws("\0", "facet", "value").isin(*chosen or [""]))


def headings(group: str, label) -> Column:
    """Headings that a record stands under: labels of its values, 'Other' without any."""
    values = F.filter(F.col(group), lambda v: v != NONE)
    named = F.array_distinct(F.transform(values, lambda v: label(F.lit(group), v.cast("string"))))
    none = F.lit("Undated" if group == "year" else "Other")
    return F.when(F.size(named) == 0, F.array(none)).otherwise(named)


def group_plan(results: DataFrame, visible: DataFrame, group: str, label) -> DataFrame:
    """(heading, total, shown, pos): totals of all results, members of the page.

    Kinds stand in fixed order, years fall with undated last, confidences by
    rank, other facets by total and name.
    """
    h = lambda df: df.select("i", F.explode(headings(group, label)).alias("heading"))
    totals = h(results).groupBy("heading").agg(F.count("*").alias("total"))
    members = h(visible).groupBy("heading").agg(F.count("*").alias("shown"))
    both = totals.join(members, "heading")
    name = F.lower(F.regexp_replace("heading", " ", "_"))
    if group == "kind":
        rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in {k: i for i, k in enumerate(KIND_ORDER)}.items() for x in kv]), name), F.lit(99))
        keys = [rank.asc(), F.col("heading").asc()]
    elif group == "year":
        keys = [(F.col("heading") == "Undated").asc(), F.col("heading").try_cast("int").desc()]
    elif group == "confidence":
        keys = [F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE_ORDER.items() for x in kv]), name), F.lit(0)).desc(), F.col("heading").asc()]
    else:
        keys = [F.col("total").desc(), F.col("heading").asc()]
    return both.withColumn("pos", (F.row_number().over(Window.orderBy(*keys)) - 1).cast("int"))


# == engine


def together(*frames: DataFrame) -> list[list[Row]]:
    """The rows of several results, planned and run at one time."""
    with ThreadPoolExecutor(len(frames)) as pool:
        return list(pool.map(lambda df: df.collect(), frames))


@dataclass
class Snapshot:
    """Lazy parts of a query's answer."""

    results: DataFrame
    counts: DataFrame
    masked: DataFrame
    bits: Mapping[str, int]
    floor: float
    query: FacetQuery

    def excluded(self, facet: str) -> DataFrame:
        """Records that this facet alone keeps out, with the results."""
        return self.masked.where(F.col("_mask").bitwiseAND(F.lit(~self.bits.get(facet, 0))) == 0).drop("_mask")

    def page(self) -> DataFrame:
        return page(self.results, self.query.sort, self.query.limit)

    def groups(self, label) -> DataFrame:
        return group_plan(self.results, self.page(), self.query.group, label)

    def answer(self, label, *columns: str) -> tuple[list[Row], list[Row]]:
        """(counts, page), or (counts, groups) where the query groups, as one interaction shows them; columns of the page."""
        shown = self.groups(label) if self.query.group != "none" else self.page().select(*columns) if columns else self.page()
        return tuple(together(self.counts, shown))


class FacetEngine:
    """Queries over a corpus of normalised records (array columns for facets; i, title, folded_title, importance, pop, year_n).

    Snapshots are kept by signature, the last few; a snapshot is plans, not rows.
    """

    def __init__(self, corpus: DataFrame, postings: DataFrame | None = None, facets: tuple[str, ...] = SELECT_FACETS, permit: tuple[str, ...] = PERMIT_FACETS, keep: int = 16):
        self.corpus, self.postings = corpus, postings
        self.facets = tuple(f for f in facets if f in corpus.columns)
        self.permit = tuple(f for f in permit if f in corpus.columns)
        self._floors: dict[int, float] = {}
        self._kept: OrderedDict[str, Snapshot] = OrderedDict()
        self._keep = keep

    def floor(self, percent: int) -> float:
        if percent not in self._floors:
            got = popularity_threshold(self.corpus, percent).collect()
            self._floors[percent] = float(got[0]["threshold"]) if got else -math.inf
        return self._floors[percent]

    def snapshot(self, query: FacetQuery) -> Snapshot:
        from ..operators.postings import search

        key = query.signature()
        if key in self._kept:
            self._kept.move_to_end(key)
            return replace_query(self._kept[key], query)
        floor = self.floor(query.min_popularity)
        base = self.corpus.where(importance_floor(query.min_importance) & (F.col("pop") >= floor))
        if query.scope == "substring":
            base = base.where(substring_contains(F.col("title"), F.col("summary"), query.text))
        elif query.scope == "title" or self.postings is None:
            base = base.where(title_contains(F.col("folded_title"), query.text))
        elif (found := search(self.postings, query.text)) is not None:
            base = base.join(found, "i", "left_semi")
        with_mask, bits = masked(base, query, self.facets, self.permit)
        snap = Snapshot(with_mask.where("_mask = 0").drop("_mask"), facet_counts(with_mask, bits, (*self.facets, *self.permit)), with_mask, bits, floor, query)
        self._kept[key] = snap
        if len(self._kept) > self._keep:
            self._kept.popitem(last=False)
        return snap


def replace_query(snapshot: Snapshot, query: FacetQuery) -> Snapshot:
    return Snapshot(snapshot.results, snapshot.counts, snapshot.masked, snapshot.bits, snapshot.floor, query)
