"""Queries of the faceted engine: filters, counts, order, pages, groups, search."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from ..cluster import written
from ..functions import derive
from ..functions.text import fold
from ..operators import postings as P
from ..plans import facets as E
from ..testbed import CORPUS_SQL, FACETS, PERMIT, corpus, docs, folded_docs, table

LIT = frozenset(["africa_oceania", "asia", "europe"])
KINDS = ("ECONOMY", "PROMO")
USES = ("anvil", "small")
STATE = E.FacetQuery(min_importance=1, select={"kind": frozenset(KINDS), "use_case": frozenset(USES)}, permit={"aff_region": LIT})


def sql(body: str) -> str:
    return f"with {CORPUS_SQL} {body}"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PRED = {"kind": f"list_has_any(kind, {_list(KINDS)})", "use_case": f"list_has_any(use_case, {_list(USES)})", "aff_region": f"list_has_all({_list(sorted(LIT))}, aff_region)"}


def a1(spark, d):
    return E.FacetEngine(corpus(spark, d), None, FACETS, PERMIT).snapshot(STATE).counts


def _a1_sql() -> str:
    parts = []
    for f in (*FACETS, *PERMIT):
        other = " and ".join(["importance >= 1", *(p for g, p in PRED.items() if g != f)])
        parts.append(f"select '{f}' as facet, v as value, count(*) as n from (select unnest(list_distinct({f})) v from c where {other}) group by v")
    return sql(" union all ".join(parts))


def a2(spark, d):
    return E.value_counts(corpus(spark, d), (*FACETS, *PERMIT))


A2_SQL = sql(" union all ".join(f"select '{f}' as facet, v as value, count(*) as n from (select unnest(list_distinct({f})) v from c) group by v" for f in (*FACETS, *PERMIT)))


def a3(spark, d):
    c = corpus(spark, d)
    universe = E.value_counts(c, FACETS).select("facet", "value")
    return E.zero_filled(universe, E.value_counts(c.where(E.includes(F.col("kind"), ["PROMO"]) & E.importance_floor(5)), FACETS))


A3_SQL = sql(
    " union all ".join(
        f"select '{f}' as facet, u.v as value, coalesce(n, 0) as n from (select distinct unnest({f}) v from c) u left join (select v, count(*) n from (select unnest(list_distinct({f})) v from c where list_contains(kind, 'PROMO') and importance >= 5) group by v) x on u.v = x.v"
        for f in FACETS
    )
)


def a4(spark, d):
    counts = E.value_counts(corpus(spark, d), ("kind", "component", "use_case"))
    labelled = counts.withColumn("label", derive.label_for(F.col("facet"), F.col("value")))
    return E.panel_order(labelled)


def _panel_sql(where: str = "true") -> str:
    inner = " union all ".join(f"select '{f}' as facet, v as value, count(*) as n from (select unnest(list_distinct({f})) v from c where {where}) group by v" for f in ("kind", "component", "use_case"))
    label = "case when value = '__none__' then 'Not specified' else upper(replace(value, '_', ' ')[1:1]) || replace(value, '_', ' ')[2:] end"
    return sql(f"select facet, value, n, label, (row_number() over (partition by facet order by value = '__none__', n desc, label, value) - 1)::int as pos from (select *, {label} as label from ({inner}))")


def a5(spark, d):
    return E.value_counts(corpus(spark, d), FACETS).groupBy("facet").agg(F.count_if(F.col("n") > 0).alias("active"), F.concat_ws(" of ", F.least(F.count("*"), F.lit(200)).cast("string"), F.count("*").cast("string")).alias("shown"))


A5_SQL = sql("select facet, count(*) as active, least(count(*), 200)::varchar || ' of ' || count(*)::varchar as shown from (" + " union all ".join(f"select '{f}' as facet, v from (select distinct unnest({f}) v from c)" for f in FACETS) + ") group by facet")


def a6(spark, d):
    c = corpus(spark, d).where(E.importance_floor(4))
    return E.group_plan(c, E.page(c, "importance", 50), "component", derive.label_for)


ORDER = {"importance": "coalesce(importance, -1) desc, pop desc, year_n desc, lower(title), i", "popularity": "pop desc, coalesce(importance, -1) desc, year_n desc, lower(title), i", "year": "year_n desc, lower(title), i", "title": "lower(title), i"}
_HEAD = "unnest(case when list_contains(component, '__none__') then ['Other'] else component end)"
A6_SQL = sql(f"""
, v as (select * from c where importance >= 4 order by {ORDER["importance"]} limit 50),
t as (select h as heading, count(*) as total from (select {_HEAD} h from c where importance >= 4) group by h),
m as (select h as heading, count(*) as shown from (select {_HEAD} h from v) group by h)
select heading, total, shown, (row_number() over (order by total desc, heading) - 1)::int as pos from t join m using (heading)""")


def o7(spark, d):
    c = corpus(spark, d).where(E.importance_floor(3))
    return E.group_plan(c, E.page(c, "year", 100), "year", derive.label_for)


O7_SQL = sql(f"""
, v as (select * from c where importance >= 3 order by {ORDER["year"]} limit 100)
select heading, total, shown, (row_number() over (order by heading::int desc) - 1)::int as pos from
  (select year[1] as heading, count(*) as total from c where importance >= 3 group by 1) join (select year[1] as heading, count(*) as shown from v group by 1) using (heading)""")


def f1(spark, d):
    return corpus(spark, d).where(E.importance_floor(3)).select("id", "importance")


def f2(spark, d):
    c = written(corpus(spark, d).select("id", "pop"), "corpus")  # read by the threshold and the filter
    t = E.popularity_threshold(c, 50)
    return c.crossJoin(F.broadcast(t)).where("pop >= threshold").select("id", F.round("pop", 9).alias("pop"))  # t: one row


def f3(spark, d):
    return corpus(spark, d).where(E.includes(F.col("use_case"), USES)).select("id")


def f4(spark, d):
    return corpus(spark, d).where(E.permits(F.col("aff_region"), LIT, E.ALL_LIT["aff_region"])).select("id", F.size("aff_region").alias("regions"))


def f5(spark, d):
    return E.FacetEngine(corpus(spark, d), None, FACETS, PERMIT).snapshot(STATE).results.select("id")


def f6(spark, d):
    return folded_docs(spark, d).where(E.title_contains(F.col("folded_title"), "  The   the ")).select("i", "title")


def f7(spark, d):
    return docs(spark, d).where(E.substring_contains(F.col("title"), F.col("summary"), "Tion the")).select("i")


def f9(spark, d):
    counts = E.value_counts(corpus(spark, d), ("use_case",)).withColumn("label", F.col("value"))
    return E.capped(E.panel_order(counts), searching="an").select("value", "n")


def f10(spark, d):
    c = corpus(spark, d)
    filled = E.zero_filled(E.value_counts(c, ("affiliations",)).select("facet", "value"), E.value_counts(c.where(E.includes(F.col("kind"), ["PROMO"]) & (F.col("i") < 100)), ("affiliations",)))
    return E.visible_values(filled, E.FacetQuery(select={"affiliations": frozenset(["Supplier#000000001"])}))


F10_SQL = sql("select 'affiliations' as facet, u.v as value, coalesce(n, 0) as n from (select distinct unnest(affiliations) v from c) u left join (select v, count(*) n from (select unnest(list_distinct(affiliations)) v from c where list_contains(kind, 'PROMO') and i < 100) group by v) x on u.v = x.v where coalesce(n, 0) > 0 or u.v = 'Supplier#000000001'")


def _sorted(sort: str):
    def run(spark, d):
        return E.with_position(E.page(corpus(spark, d), sort, 100), sort).select("id", "pos")

    return run, sql(f"select id, (row_number() over (order by {ORDER[sort]}) - 1)::int as pos from c qualify pos < 100")


def o5(spark, d):
    counts = E.value_counts(corpus(spark, d), ("affiliations",)).withColumn("label", F.col("value"))
    return E.capped(E.panel_order(counts)).select("value", "n", "pos")


def o6(spark, d):
    return E.page(corpus(spark, d).where(E.importance_floor(1)), "importance", 200).select("id")


def q12(spark, d):
    return corpus(spark, d).select("id", F.explode(E.headings("use_case", derive.label_for)).alias("heading"))


def o14(spark, d):
    from ..operators.worklists import frequency_sample

    return frequency_sample(E.value_counts(corpus(spark, d), ("use_case",)), "value", "n", 3).select("value", "n", "third")


# == search

_DOC_SQL = "d as (select doc_id as i, lower(strip_accents(regexp_extract(text, '^[^\\n.]{0,80}'))) as t, lower(strip_accents(text)) as s, source from documents), tok as (select distinct i, unnest(string_split_regex(s, '[^\\p{L}\\p{N}]+')) as token, 'text' as field from d union select distinct i, unnest(string_split_regex(lower(strip_accents(source)), '[^\\p{L}\\p{N}]+')), 'authors' from d)"


def _postings(spark, d):
    return P.build_postings(docs(spark, d), "i", {"text": F.col("summary"), "authors": F.get("authors", F.lit(0))})


def a8(spark, d):
    p = _postings(spark, d)
    return p.select("field", "token", "block", F.array_join("ids", ",").alias("ids"))


def m6(spark, d):
    p = _postings(spark, d).where(F.size("ids") < 200)
    gaps = p.withColumn("gaps", derive.delta_encode(F.col("ids")))
    back = gaps.withColumn("same", F.to_json(derive.delta_decode(F.col("gaps"))) == F.to_json("ids"))
    return back.select("field", "token", "block", F.array_join("gaps", ",").alias("gaps"), "same")


def q2(spark, d):
    return P.exact(_postings(spark, d), "the")


def q3(spark, d):
    return P.with_prefix(_postings(spark, d), "tion")


def q5(spark, d):
    return P.search(_postings(spark, d), "the and tio")


def q6(spark, d):
    return P.search(_postings(spark, d), "src1 the ")


def q7(spark, d):
    e = E.FacetEngine(folded_docs(spark, d).withColumns({"kind": F.array("kind"), "pop": F.lit(0.3)}), _postings(spark, d), ("kind",), ())
    return e.snapshot(E.FacetQuery(text="the of", min_importance=3)).counts


def u2(spark, d):
    p = _postings(spark, d)
    return P.exact(p, "the").intersect(P.exact(p, "of"))


def u3(spark, d):
    p = _postings(spark, d)
    return P.exact(p, "src2").union(P.with_prefix(p, "thl")).distinct()


def a22(spark, d):
    """Recall of token search against substring search, for a list of frequent words."""
    r = docs(spark, d)
    p = _postings(spark, d)
    asked = ("the", "tion", "und", "les", "que")
    words = F.broadcast(spark.createDataFrame([(w,) for w in asked], "q string"))  # five words
    found = r.select("i", fold(F.col("summary")).alias("s")).join(words, F.contains("s", "q")).select("q", "i", F.lit(True).alias("a"), F.lit(False).alias("b"))
    p = p.where(reduce(or_, (F.startswith("token", F.lit(w)) for w in asked)) & (F.col("field") == "text"))  # before the lists are made
    listed = p.join(words, F.startswith("token", "q")).select("q", F.explode("ids").alias("i"), F.lit(False).alias("a"), F.lit(True).alias("b"))
    each = found.union(listed).groupBy("q", "i").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    n = each.groupBy("q").agg(*[F.count_if(c).cast("int").alias(name) for name, c in {"v1": F.col("a"), "v2": F.col("b"), "kept": F.col("a") & F.col("b"), "gained": ~F.col("a") & F.col("b")}.items()])
    return words.join(n, "q", "left").fillna(0)


def s24(spark, d):
    c = corpus(spark, d).withColumn("b", derive.bucket_of(F.col("id")))
    from ..sources.files import detail_of

    return detail_of(c, "part-17").select("id", "b", "title")


_o_imp, _o_pop, _o_year, _o_title = (_sorted(s) for s in ("importance", "popularity", "year", "title"))

QUERIES = {
    "a1_self_excluding_counts": (a1, _a1_sql()), "a2_value_counts": (a2, A2_SQL), "a3_zero_filled": (a3, A3_SQL), "a4_facet_report": (a4, _panel_sql()), "a5_active_values": (a5, A5_SQL),
    "a6_group_plan": (a6, A6_SQL), "o7_header_order": (o7, O7_SQL),
    "f1_importance_floor": (f1, sql("select id, importance from c where importance >= 3")),
    "f2_popularity_floor": (f2, sql("select id, round(pop, 9) as pop from c where pop >= (select list_sort(list(pop))[1 + count(*) * 50 // 100] from c)")),
    "f3_include": (f3, sql(f"select id from c where {PRED['use_case']}")), "f4_permit": (f4, sql(f"select id, len(aff_region)::int as regions from c where {PRED['aff_region']}")),
    "f5_all_facets": (f5, sql("select id from c where importance >= 1 and " + " and ".join(PRED.values()))),
    "f6_title_substring": (f6, "select doc_id as i, regexp_extract(text, '^[^\\n.]{0,80}') as title from documents where contains(lower(strip_accents(regexp_extract(text, '^[^\\n.]{0,80}'))), 'the the')"),
    "f7_text_substring": (f7, "select doc_id as i from documents where contains(lower(regexp_extract(text, '^[^\\n.]{0,80}') || ' ' || text), 'tion the')"),
    "f8_candidates": (lambda s, d: docs(s, d).select("i").join(P.exact(_postings(s, d), "der"), "i", "left_semi"), f"with {_DOC_SQL} select distinct i from tok where token = 'der'"),
    "f9_value_search": (f9, sql("select v as value, count(*) as n from (select unnest(list_distinct(use_case)) v from c) where contains(lower(v), 'an') group by v")),
    "f10_hide_empty": (f10, F10_SQL),
    "o2_sort_importance": _o_imp, "o2_sort_popularity": _o_pop, "o2_sort_year": _o_year, "o2_sort_title": _o_title,
    "o4_panel_order": (a4, _panel_sql()),
    "o5_top_values": (o5, sql("select v as value, count(*) as n, (row_number() over (order by count(*) desc, v) - 1)::int as pos from (select unnest(list_distinct(affiliations)) v from c) group by v qualify pos < 200")),
    "o6_page": (o6, sql(f"select id from (select * from c where importance >= 1 order by {ORDER['importance']} limit 200)")),
    "o14_frequency_sample": (o14, sql("select value, n, third from (select *, row_number() over (partition by third order by n desc, value) rn from (select *, ['high', 'mid', 'low'][ntile(3) over (order by n desc, value)] as third from (select v as value, count(*) as n from (select unnest(list_distinct(use_case)) v from c) group by v))) where rn <= 3")),
    "q12_headings": (q12, sql("select id, upper(h[1:1]) || h[2:] as heading from (select id, unnest(case when list_contains(use_case, '__none__') then ['Other'] else use_case end) h from c)")),
    "a8_postings": (a8, f"with {_DOC_SQL} select field, token, i // 65536 as block, string_agg(i::varchar, ',' order by i) as ids from tok where token <> '' group by field, token, i // 65536"),
    "m6_delta": (m6, f"with {_DOC_SQL}, g as (select field, token, i // 65536 as block, i - coalesce(lag(i) over (partition by field, token, i // 65536 order by i), 0) as gap, i from tok where token <> '') select field, token, block, string_agg(gap::varchar, ',' order by i) as gaps, true as same from g group by field, token, block having count(*) < 200"),
    "q2_exact": (q2, f"with {_DOC_SQL} select distinct i from tok where token = 'the'"), "q3_prefix": (q3, f"with {_DOC_SQL} select distinct i from tok where token like 'tion%'"),
    "q5_candidates": (q5, f"with {_DOC_SQL} select i from tok where token in ('the', 'and') or token like 'tio%' group by i having count(distinct case when token in ('the', 'and') then token else 'tio' end) = 3"),
    "q6_multi_index": (q6, f"with {_DOC_SQL} select i from tok where token = 'src1' or token like 'the%' group by i having bool_or(token = 'src1') and bool_or(token like 'the%')"),
    "q7_search_counts": (q7, f"with {_DOC_SQL} select 'kind' as facet, lang as value, count(*) as n from documents join labels using (doc_id) where quality * 3 + toxic >= 3 and doc_id in (select i from tok where token = 'the') and doc_id in (select i from tok where token like 'of%') group by lang"),
    "u2_term_and": (u2, f"with {_DOC_SQL} select i from tok where token = 'the' intersect select i from tok where token = 'of'"),
    "u3_term_union": (u3, f"with {_DOC_SQL} select i from tok where token = 'src2' union select i from tok where token like 'thl%'"),
    "a22_recall": (a22, f"with {_DOC_SQL}, q as (select unnest(['the', 'tion', 'und', 'les', 'que']) q), a as (select q, i from q join d on contains(s, q)), b as (select distinct q, i from q join tok on starts_with(token, q) and field = 'text') select q, (select count(*) from a where a.q = q.q)::int v1, (select count(*) from b where b.q = q.q)::int v2, (select count(*) from a join b using (q, i) where a.q = q.q)::int kept, (select count(*) from b anti join a using (q, i) where b.q = q.q)::int gained from q"),
    "s24_bucket_lookup": (s24, sql("select id, lower(printf('%02x', ('0x' || sha256(id)[1:2])::int & 31)) as b, title from c where id = 'part-17'")),
}
