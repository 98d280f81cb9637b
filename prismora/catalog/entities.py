"""Queries of votes, clusters, links and worklists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import norm_title
from ..operators import linkage as L
from ..operators import worklists as W
from ..testbed import corpus, table
from .facets import sql


def a9(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 4 == 0, "unknown").otherwise(F.col("o_orderpriority")).alias("p"))
    return L.majority(o, "o_custkey", "p", hint=F.lit("3-MEDIUM")).select("o_custkey", "p", "n", F.array_join("tied", ",").alias("tied"))


A9_SQL = """with v as (select o_custkey, case when o_orderkey % 4 = 0 then 'unknown' else o_orderpriority end p, count(*) n from orders group by all), r as (select *, bool_or(p <> 'unknown') over (partition by o_custkey) real from v),
t as (select * from r where not real or p <> 'unknown' qualify n = max(n) over (partition by o_custkey)), g as (select o_custkey, list_sort(list(p)) ps, max(n) n from t group by 1)
select o_custkey, case when list_contains(ps, '3-MEDIUM') then '3-MEDIUM' else ps[1] end as p, n, array_to_string(ps, ',') as tied from g"""


def a10(spark, d):
    o = table(spark, d, "orders")
    return L.conflicts(o, "o_custkey", "o_orderstatus", "o_orderpriority").select("o_custkey", F.size("facts").alias("facts"))


def a11(spark, d):
    c = table(spark, d, "customer").select(F.lower("c_mktsegment").alias("g"), F.when(F.col("c_custkey") % 3 == 0, F.upper("c_mktsegment")).otherwise(F.initcap("c_mktsegment")).alias("name"), "c_custkey")
    return L.preferred_spelling(c, "g", "name", "c_custkey")


def a12(spark, d):
    n = table(spark, d, "nation")
    a = n.select(F.col("n_name").alias("name"), F.lit("nation").alias("types"), F.col("n_regionkey").cast("string").alias("countries"))
    b = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"), F.lit("supplier").alias("types"))
    e = L.evidence_sets([a, b], "name", ["types", "countries"])
    return e.select("name", F.array_join("types", ",").alias("types"), F.array_join("countries", ",").alias("countries"))


def a13(spark, d):
    c = table(spark, d, "customer")
    raw = F.element_at(F.array(F.lit("Ada Lovelace"), F.lit("ADA LOVELACE"), F.lit("Ada Löv"), F.lit("ada löv")), (F.col("c_custkey") % 4 + 1).cast("int"))
    r = L.name_clusters(c.select(raw.alias("name"), "c_mktsegment", "c_custkey"), "name", "c_mktsegment", "c_custkey")
    return r.select("c_mktsegment", "name_key", "canonical_name", F.array_join("variants", "|").alias("variants"), F.size("accounts").alias("accounts"), "n")


A13_SQL = "select c_mktsegment, k as name_key, canonical as canonical_name, canonical as variants, count(*)::int as accounts, count(*) as n from (select c_mktsegment, case when c_custkey % 4 < 2 then 'ada lovelace' else 'ada lov' end k, case when c_custkey % 4 < 2 then 'Ada Lovelace' else 'Ada Löv' end canonical from customer) group by all"


def a14(spark, d):
    e = table(spark, d, "events")
    g = e.groupBy("event_type", (F.col("user_id") % 10).alias("raw")).agg(F.array_join(F.array_sort(F.collect_set((F.col("event_id") % 3).cast("string"))), ",").alias("statuses"), F.count("*").alias("n"))
    return g


def a15(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("s"))
    r = L.coverage(o, "o_custkey", "o_orderpriority", "s")
    return r.withColumn("affiliations", F.array_join("affiliations", ","))


A15_SQL = "with p as (select o_custkey, o_orderpriority, bool_or(o_orderkey % 3 = 0) has from orders group by 1, 2), a as (select o_custkey, count(*) identities, count_if(has)::bigint covered from p group by 1), s as (select o_custkey, string_agg(distinct o_orderstatus, ',' order by o_orderstatus) t from orders where o_orderkey % 3 = 0 group by 1) select o_custkey, identities, covered, coalesce(t, '') as affiliations, case when covered = 0 then 'none' when covered < identities then 'partial' else 'full' end as status from a left join s using (o_custkey)"


def a16(spark, d):
    o = table(spark, d, "orders")
    return o.agg(F.count("*").alias("orders"), F.count_distinct("o_custkey", "o_orderstatus").alias("pairs"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.count_distinct("o_orderpriority").alias("priorities"))


def a17(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return L.dominant(n, "user_id", "event_type")


A17_SQL = "with n as (select user_id, event_type, count(*) n from events group by 1, 2), r as (select *, row_number() over (partition by user_id order by n desc, event_type) k from n) select user_id, max(case when k = 1 then event_type end) as event_type, max(case when k = 1 then n end) as n, max(case when k = 1 then n end) >= 2 and max(case when k = 1 then n end) >= 2 * coalesce(max(case when k = 2 then n end), 0) as dominant, count(*) filter (k <= 5) as listed from r group by 1"


def a18(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), "|").alias("codes"))


def a19(spark, d):
    e = table(spark, d, "events")
    lists = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    return lists.select("user_id", F.array_join(F.array_distinct(F.transform("x", lambda y: y["event_type"])), ",").alias("anchors"))


def a20(spark, d):
    e = table(spark, d, "events")
    from pyspark.sql import Window

    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("p", before).where("p is not null and p <> event_type").groupBy(F.concat_ws("→", "p", "event_type").alias("change")).agg(F.count("*").alias("n"))


def a21(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    wide = x.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("quality", "toxic", "lang")])
    return wide.unpivot([], ["quality", "toxic", "lang"], "field", "missing")


def a23(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.round(F.median("value"), 9).alias("median"), F.round(F.expr("percentile_disc(0.95) within group (order by value)"), 9).alias("p95"))


def a7(spark, d):
    e = table(spark, d, "events")
    return e.agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in ("view", "click", "signup", "error", "purchase")], F.count_if(F.col("value").isNotNull()).alias("filled"))


def j11(spark, d):
    docs = table(spark, d, "documents").where("length(text) > 40").select("doc_id", F.substring("text", 1, 80).alias("title"))
    left = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("l_id"), F.upper("title").alias("t"))
    right = docs.where("doc_id % 10 <> 0")
    return L.title_links(left, right, "l_id", "t", "doc_id", "title").select("l_id", "doc_id", "how", F.round("score", 9).alias("score"))


J11_SQL = """with t as (select doc_id, trim(regexp_replace(lower(text[1:80]), '[^a-z0-9]+', ' ', 'g')) t from documents where length(text) > 40), a as (select doc_id l, t lt, string_split(t, ' ') lw from t where doc_id % 10 = 0 and t <> ''), b as (select doc_id r, t rt, string_split(t, ' ') rw from t where doc_id % 10 <> 0 and t <> ''),
p as (select *, len(list_intersect(lw, rw)) / len(list_distinct(list_concat(lw, rw))) as j from a join b on list_has_any(lw, rw)),
h as (select *, case when lt = rt then 'exact' when (len(lw) >= 6 and starts_with(rt, lt || ' ')) or (len(rw) >= 6 and starts_with(lt, rt || ' ')) then 'prefix' when j >= 0.75 then 'fuzzy' end how from p)
select l as l_id, r as doc_id, how, round(j, 9) as score from h where how is not null qualify row_number() over (partition by l order by case how when 'exact' then 0 when 'prefix' then 1 else 2 end, j desc, r) = 1"""


def j12(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", F.concat(F.reverse(F.split("p_name", " "))[0], F.lit(" extra")).alias("other"))
    return L.same_work(p, "p_name", "other").select("p_partkey", F.round("overlap", 9).alias("overlap"), F.round("ratio", 9).alias("ratio"), "same")


def k13(spark, d):
    return L.containment(table(spark, d, "benchmark"), "item_id", "text", table(spark, d, "documents"), "doc_id", "text", 0.7).select("item_id", "doc_id", "shared", F.round("share", 9).alias("share"))


K13_SQL = "with a as (select distinct item_id, unnest([x for x in string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') if x <> '']) w from benchmark), b as (select distinct doc_id, unnest([x for x in string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') if x <> '']) w from documents), n as (select item_id, count(*) n from a group by 1) select item_id, doc_id, count(*) as shared, round(count(*) / max(n), 9) as share from a join b using (w) join n using (item_id) group by 1, 2 having count(*) / max(n) >= 0.7"


def f12(spark, d):
    c = table(spark, d, "customer")
    lists = [("indexed", table(spark, d, "orders"), "o_custkey"), ("never", table(spark, d, "events").where("event_type = 'error'"), "user_id")]
    return W.excluded_with_reason(c, F.col("c_custkey"), lists)[1].select("c_custkey", "reason")


def f14(spark, d):
    c = table(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 5 == 0, F.lit("root@host")).when(F.col("c_custkey") % 5 == 1, F.lit("x")).otherwise(F.col("c_name"))
    ok = (F.length(name) > 2) & ~name.contains("@") & ~F.lower(name).isin("root", "unknown", "your name") & name.rlike(r"^\p{L}")
    return c.where(ok).select("c_custkey")


def f17(spark, d):
    p = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 7 == 0, F.concat("url", F.lit(">"))).otherwise(F.col("url")).alias("url"))
    return p.where("page_id % 9 <> 0").select("page_id", F.when(~F.col("url").endswith(">"), F.col("url")).alias("url"))


def k1(spark, d):
    """Candidates: good status, not blocked, not done, with their counts."""
    o = table(spark, d, "orders").where("o_orderstatus = 'O'")
    blocked = table(spark, d, "customer").where("c_custkey % 6 = 0").select("c_custkey")
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return o.select(F.col("o_custkey").alias("c_custkey")).distinct().join(blocked, "c_custkey", "left_anti").join(n, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "n")


def k2(spark, d):
    from ..functions.derive import evidence_tier

    # Whether there is text is all that the tier asks, so texts stay out of the join.
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source", F.left("text", F.lit(1)).alias("text"))
    x = docs.join(table(spark, d, "labels"), "doc_id")
    c = x.select("doc_id", "n_chars", evidence_tier(F.when(F.col("quality") == 1, F.col("text")), F.when(F.col("toxic") == 1, F.col("source")), F.lit(None).cast("array<string>")).alias("tier"))
    return c.orderBy(F.desc("n_chars"), "doc_id")


def k4(spark, d):
    c = table(spark, d, "customer")
    reason = F.when(F.col("c_acctbal") < 0, "negative").when(F.col("c_mktsegment") == "BUILDING", "segment").when(F.col("c_custkey") % 2 == 0, "even").otherwise("kept")
    return c.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def k5(spark, d):
    from ..functions.derive import slice_of

    docs = table(spark, d, "documents")
    done = table(spark, d, "labels").select("doc_id")
    k = F.col("doc_id").cast("string")
    return docs.where("n_chars > 500").join(done, "doc_id", "left_anti").select("doc_id", slice_of(k).alias("slice"))


def k7(spark, d):
    docs = table(spark, d, "documents")
    first = docs.groupBy("text").agg(F.min("doc_id").alias("first"))
    r = docs.join(first, "text").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") != F.col("first"), F.col("first").cast("string")).alias("duplicate_of"))
    return W.groups_of_copies(r, "id", "duplicate_of").select("id", F.array_join("copies", ",").alias("copies"))


K7_SQL = "select min(doc_id)::varchar as id, coalesce(array_to_string(list_sort([x::varchar for x in list(doc_id) if x <> min(doc_id)]), ','), '') as copies from documents group by text"


def k8(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("a", F.lit("buyer"))
    b = table(spark, d, "events").select(F.col("user_id").alias("k")).distinct().withColumn("b", F.lit("visitor"))
    return a.join(b, "k", "full_outer").select("k", F.concat_ws(",", "a", "b").alias("roles"))


def k9(spark, d):
    """Repository and author rows: contributor roles by trust, names by segment."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("l_partkey").agg(F.array_join(F.array_sort(F.collect_set("s_name")), ";").alias("authors"), F.count_distinct("n_name").alias("affiliations"))


def k10(spark, d):
    """Three routes of records in one table."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("scholarly").alias("route"), F.col("source").alias("author"))
    repos = table(spark, d, "events").where("event_type = 'signup'").select(F.col("event_id").cast("string").alias("id"), F.lit("repository").alias("route"), F.col("user_id").cast("string").alias("author"))
    web = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("id"), F.lit("web").alias("route"), F.regexp_extract("url", "//([^/]+)/", 1).alias("author"))
    return docs.unionByName(repos).unionByName(web)


def k12(spark, d):
    """Facts that are no longer what the derivation gives."""
    c = corpus(spark, d)
    stale = c.select("id", F.when(F.col("i") % 20 == 0, F.lit("old")).otherwise(F.array_join("aff_type", ",")).alias("stored"))
    now = c.select("id", F.array_join("aff_type", ",").alias("now"))
    return stale.join(now, "id").where(~F.col("stored").eqNullSafe(F.col("now")))


def o13(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey").limit(25)


def o15(spark, d):
    o = table(spark, d, "orders")
    key = F.struct((F.col("o_orderstatus") != "O").alias("a"), (F.col("o_orderpriority") != "1-URGENT").alias("b"), F.col("o_orderkey").alias("k"))
    x = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(key)).alias("x"))
    return x.select("o_custkey", F.array_join(F.transform("x", lambda y: y["k"].cast("string")), ",").alias("orders"))


def s12(spark, d):
    return W.batches(table(spark, d, "part").select("p_partkey"), 120, F.col("p_partkey"), name="chunk")


QUERIES = {
    "a7_counters": (a7, "select count_if(event_type = 'view')::bigint as view, count_if(event_type = 'click')::bigint as click, count_if(event_type = 'signup')::bigint as signup, count_if(event_type = 'error')::bigint as error, count_if(event_type = 'purchase')::bigint as purchase, count(value) as filled from events"),
    "a9_majority_vote": (a9, A9_SQL), "a10_conflicts": (a10, "select o_custkey, count(distinct o_orderstatus || o_orderpriority)::int as facts from orders group by 1 having facts > 1"),
    "a11_preferred_spelling": (a11, "with x as (select lower(c_mktsegment) g, case when c_custkey % 3 = 0 then upper(c_mktsegment) else upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) end name, count(*) n, min(c_custkey) p from customer group by 1, 2) select g, name, n from x qualify row_number() over (partition by g order by n desc, p) = 1"),
    "a12_evidence_sets": (a12, "select n_name as name, case when n_nationkey in (select s_nationkey from supplier) then 'nation,supplier' else 'nation' end as types, n_regionkey::varchar as countries from nation"),
    "a13_name_clusters": (a13, A13_SQL), "a14_aggregate": (a14, "select event_type, user_id % 10 as raw, string_agg(distinct (event_id % 3)::varchar, ',' order by (event_id % 3)::varchar) as statuses, count(*) as n from events group by 1, 2"),
    "a15_coverage": (a15, A15_SQL), "a16_summary": (a16, "select count(*) as orders, count(distinct o_custkey || '|' || o_orderstatus) as pairs, count_if(o_totalprice > 100000)::bigint as large, count(distinct o_orderpriority) as priorities from orders"),
    "a17_dominant_name": (a17, A17_SQL), "a18_code_union": (a18, "select user_id, string_agg(distinct event_type, '|' order by event_type) as codes from events group by 1"),
    "a19_ordered_anchors": (a19, "select user_id, string_agg(event_type, ',' order by t, i) as anchors from (select user_id, event_type, min(ts) t, arg_min(event_id, (ts, event_id)) i from events group by 1, 2) group by 1"),
    "a20_transitions": (a20, "select p || '→' || event_type as change, count(*) as n from (select event_type, lag(event_type) over (partition by user_id order by ts, event_id) p from events) where p <> event_type group by 1"),
    "a21_missing": (a21, "select field, count_if(v is null)::bigint as missing from (select unnest(['quality', 'toxic', 'lang']) as field, unnest([quality::varchar, toxic::varchar, lang]) as v from documents left join labels using (doc_id)) group by 1"),
    "a23_quantiles": (a23, "select event_type, round(median(value), 9) as median, round(quantile_disc(value, 0.95), 9) as p95 from events group by 1"),
    "j11_title_match": (j11, J11_SQL), "j12_same_work": (j12, None), "k13_containment": (k13, K13_SQL),
    "f12_excluded": (f12, "select c_custkey, case when c_custkey in (select o_custkey from orders) then 'indexed' else 'never' end as reason from customer where c_custkey in (select o_custkey from orders) or c_custkey in (select user_id from events where event_type = 'error')"),
    "f14_usable_names": (f14, "select c_custkey from customer where c_custkey % 5 > 1"), "f17_hygiene": (f17, "select page_id, case when page_id % 7 <> 0 then url end as url from pages where page_id % 9 <> 0"),
    "k1_candidates": (k1, "select o_custkey as c_custkey, count(*) as n from orders where o_custkey in (select o_custkey from orders where o_orderstatus = 'O') and o_custkey % 6 <> 0 group by 1"),
    "k2_tiered": (k2, "select doc_id, n_chars, case when quality = 1 and text <> '' then 'full_text' when toxic = 1 then 'abstract_context' else 'metadata_only' end as tier from documents join labels using (doc_id)"),
    "k4_reasons": (k4, "select case when c_acctbal < 0 then 'negative' when c_mktsegment = 'BUILDING' then 'segment' when c_custkey % 2 = 0 then 'even' else 'kept' end as reason, count(*) as n from customer group by 1"),
    "k5_lane": (k5, "select doc_id, chr(65 + ('0x' || sha1(doc_id::varchar)[40:40])::int % 4) as slice from documents where n_chars > 500 and doc_id not in (select doc_id from labels)"),
    "k7_copies": (k7, K7_SQL), "k8_roles": (k8, "with a as (select distinct o_custkey k from orders), b as (select distinct user_id k from events) select coalesce(a.k, b.k) as k, concat_ws(',', case when a.k is not null then 'buyer' end, case when b.k is not null then 'visitor' end) as roles from a full join b on a.k = b.k"),
    "k9_repo_authors": (k9, "select l_partkey, array_to_string(list_sort(list(distinct s_name)), ';') as authors, count(distinct n_name) as affiliations from lineitem join supplier on l_suppkey = s_suppkey left join nation on s_nationkey = n_nationkey group by 1"),
    "k10_routes": (k10, "select doc_id::varchar as id, 'scholarly' as route, source as author from documents union all select event_id::varchar, 'repository', user_id::varchar from events where event_type = 'signup' union all select page_id::varchar, 'web', regexp_extract(url, '//([^/]+)/', 1) from pages"),
    "k12_drift": (k12, sql("select id, 'old' as stored, array_to_string(aff_type, ',') as now from c where i % 20 = 0")),
    "o13_top_n": (o13, "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 25"),
    "o15_priority_lists": (o15, "select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderstatus <> 'O', o_orderpriority <> '1-URGENT', o_orderkey) as orders from orders group by 1"),
    "s12_chunks": (s12, "select p_partkey, (1 + (row_number() over (order by p_partkey) - 1) // 120)::int as chunk from part"),
}
