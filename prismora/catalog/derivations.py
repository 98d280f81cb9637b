"""Queries of derived columns and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import derive as D
from ..functions import text as X
from ..testbed import CORPUS_SQL, corpus, derived, raw_corpus, table
from .facets import sql

_raw = raw_corpus


def p1(spark, d):
    return _raw(spark, d).select("id", F.array_join(D.organizations_of(F.col("affiliation_list")), "|").alias("organizations"))


def p2(spark, d):
    r = derived(_raw(spark, d)).select("id", F.posexplode("aff_rows").alias("pos", "r"))
    return r.select("id", "pos", "r.organization", "r.sector", "r.country")


def p3(spark, d):
    return table(spark, d, "region").select("r_name", D.region_of(F.col("r_name"), {"africa": "africa_oceania", "america": "americas", "asia": "asia", "europe": "europe"}).alias("region"))


def p3n(spark, d):
    k = F.col("n_nationkey")
    country = F.when(k % 4 == 0, " The Netherlands").when(k % 4 == 1, "United States").when(k % 4 == 2, "JAPAN").otherwise(F.col("n_name"))
    return table(spark, d, "nation").select("n_name", D.region_of(country).alias("region"))


def p4(spark, d):
    return derived(_raw(spark, d)).select("id", F.array_join("aff_type", ",").alias("aff_type"))


def p5(spark, d):
    return derived(_raw(spark, d)).select("id", F.array_join("aff_region", ",").alias("aff_region"))


def p6(spark, d):
    return corpus(spark, d).select("id", F.round("pop", 9).alias("pop"))


def p7(spark, d):
    k = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", D.bucket_of(k).alias("b"), D.slice_of(k).alias("slice"), F.sha2(k, 256).alias("sha256"), F.sha1(k).alias("sha1"))


def p9(spark, d):
    r = derived(_raw(spark, d))
    return r.select("id", *D.lossy({"title": "string"}), F.when(F.size("organizations") > 0, F.array_join("organizations", ";")).alias("organizations"), F.when(F.size("types") > 0, F.lit(True)).alias("ht"), "cited", "importance")


def p10(spark, d):
    c = corpus(spark, d)
    return c.select("id", *[F.array_join(f, ",").alias(f) for f in ("kind", "year", "component", "use_case", "industry", "affiliations", "aff_type", "aff_region")])


def p11(spark, d):
    """Pages as pool works: URL by order of trust, kind from a type map, no count as 0."""
    p = table(spark, d, "pages")
    landing = F.when(F.col("page_id") % 3 != 0, F.col("url"))
    kind = F.coalesce(F.element_at(F.create_map(*map(F.lit, ("en", "paper", "de", "preprint", "fr", "thesis"))), F.regexp_extract("url", r"/(\w\w)/", 1)), F.lit("paper"))
    return p.select("page_id", F.coalesce(landing, F.concat(F.lit("https://w.example/"), F.col("page_id").cast("string"))).alias("url"), kind.alias("kind"), F.coalesce(F.when(F.col("page_id") % 4 == 0, F.col("page_id")), F.lit(0)).alias("cited"), F.lit("tail").alias("tier"))


def p12(spark, d):
    """Events as repositories: hit codes to components, the year of a date text."""
    e = table(spark, d, "events")
    codes = F.split(F.concat_ws("|", "event_type", F.when(F.col("event_id") % 2 == 0, "view"), F.lit("other")), r"\|")
    table_ = F.create_map(*map(F.lit, ("view", "core", "click", "core", "purchase", "shop")))
    comps = F.array_distinct(F.array_compact(F.transform(codes, lambda c: F.element_at(table_, c))))
    return e.select("event_id", F.array_join(comps, ",").alias("component"), D.year_in(F.date_format("ts", "yyyy-MM-dd")).alias("year"))


def p13(spark, d):
    return table(spark, d, "part").select("p_type", D.label_for(F.lit("kind"), F.lower("p_type"), {"kind:promo": "On offer"}).alias("label"), D.label_for(F.lit("year"), F.lit("__none__")).alias("undated")).distinct()


def p14(spark, d):
    k = F.element_at(F.array(*map(F.lit, ("code_repo", "paper", "forum"))), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", D.action_label(k, F.when(F.col("page_id") % 2 == 0, F.lit("https://GitHub.com/a/b")).otherwise(F.col("url"))).alias("action"))


def p15(spark, d):
    c = corpus(spark, d)
    b = D.bibtex(F.when(F.col("i") % 2 == 0, F.col("id")), F.when(F.col("i") % 3 == 0, "paper").otherwise("forum"), F.col("title"), F.slice("affiliations", 1, 2), F.col("year_n"), F.lit(""), F.lit(None).cast("string"), F.concat(F.lit("https://x/\n"), F.col("id")))
    return c.select("id", b.alias("entry"))


P15_SQL = sql("""select id, '@' || case when i % 3 = 0 then 'article' else 'misc' end || '{' || case when i % 2 = 0 then id else regexp_replace(lower(title), '[^a-z0-9]+', '', 'g')[1:24] || year_n::varchar end || E',\\n' ||
  case when len(affiliations) > 0 then '  author = {' || array_to_string(affiliations[1:2], ' and ') || E'},\\n' else '' end || '  title = {{' || title || E'}},\\n  year = {' || year_n::varchar || E'},\\n  url = {https://x/ ' || id || E'}\\n}' as entry from c""")


def p19(spark, d):
    from ..operators.worklists import batches, capped_list

    w = corpus(spark, d).where("importance = 6").select("id", capped_list(F.col("use_case"), 1).alias("words"))
    return batches(w, 40, F.col("id"))


def p20(spark, d):
    c = table(spark, d, "customer")
    key = D.identity_key([("account", F.when(F.col("c_custkey") % 3 == 0, F.col("c_name"))), ("segment", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")))])
    return c.select("c_custkey", key.alias("k")).select("c_custkey", "k.key", "k.status")


def p21(spark, d):
    c = table(spark, d, "customer")
    login = F.when(F.col("c_custkey") % 10 == 0, F.lit("merge-bot")).otherwise(F.lower("c_name"))
    return c.select("c_custkey", D.account_kind(login, F.col("c_name"), F.when(F.col("c_custkey") % 4 == 0, "Organization").otherwise("User")).alias("kind"))


def p22(spark, d):
    s = table(spark, d, "supplier").withColumn("name", F.concat(F.element_at(F.array(*map(F.lit, ("General Hospital ", "National Centre ", "State University ", "Works Inc "))), (F.col("s_suppkey") % 4 + 1).cast("int")), F.col("s_suppkey").cast("string")))
    types = F.when(F.col("s_suppkey") % 5 == 0, F.array(F.lit("Facility"))).when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("other"))).otherwise(F.array(F.lit("company")))
    return s.select("s_suppkey", D.organization_type(F.col("name"), types).alias("type"))


P22_SQL = """select s_suppkey, case when s_suppkey % 4 = 0 then 'nonprofit' when s_suppkey % 5 = 0 then ['', 'government', 'academic', 'corporate'][1 + s_suppkey % 4]
  when s_suppkey % 3 = 0 then case when s_suppkey % 4 = 3 then 'corporate' else 'other' end else 'corporate' end as type from supplier"""


def p23(spark, d):
    p = table(spark, d, "pages")
    loc = lambda k, u: F.struct(F.lit(k).alias("kind"), u.alias("url"))
    places = F.array(loc("mirror", F.col("url")), loc("best", F.when(F.col("page_id") % 2 == 0, F.concat("url", F.lit("#pdf")))), loc("archive", F.when(F.col("page_id") % 3 == 0, F.lit("https://a.example/x.pdf"))))
    return p.select("page_id", D.first_location(places, "url", ["best", "archive", "mirror"]).alias("url"))


def p24(spark, d):
    p = table(spark, d, "pages")
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://doi.example/10.1234/Ab."), F.col("page_id").cast("string"), F.lit("/pdf?x"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("http://arxiv.org/abs/2101."), F.lpad(F.col("page_id").cast("string"), 5, "0"))).otherwise(F.col("url"))
    return p.select("page_id", X.url_lane(u).alias("lane"), X.doi_in(u).alias("doi"), X.arxiv_in(u).alias("arxiv"))


def p25(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    tier = D.evidence_tier(F.when(F.col("quality") == 1, F.col("text")), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.lit(None).cast("array<string>"))
    return x.select("doc_id", tier.alias("tier"), D.capped_confidence(F.lit("high"), tier).alias("confidence"))


def x22(spark, d):
    r = _raw(spark, d)
    return r.select("id", F.array_join(D.spread_types(F.slice("types", 1, 1), F.size("types")), ",").alias("types"))


def x21(spark, d):
    n = table(spark, d, "nation")
    v = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("unknown; "), F.col("n_name"), F.lit(";x"))).when(F.col("n_nationkey") % 3 == 1, F.lit(" Unknown")).otherwise(F.col("n_name"))
    return n.select("n_nationkey", D.canon_country(v, {"nation_2": "Second"}).alias("country"))


def m2(spark, d):
    o = table(spark, d, "orders")
    date = F.when(F.col("o_orderkey") % 5 == 0, F.lit("n.d.")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", D.year_in(date).alias("year"), F.substring(date, 1, 10).alias("day"))


def m7(spark, d):
    """Texts to inverted maps of word to positions, and back."""
    docs = table(spark, d, "documents").where("n_chars < 1500").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "word"))
    inverted = docs.groupBy("doc_id", "word").agg(F.array_sort(F.collect_list("pos")).alias("places"))
    back = inverted.select("doc_id", "word", F.explode("places").alias("pos")).groupBy("doc_id", "pos").agg(F.max("word").alias("word"))
    return back.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"))


def m4(spark, d):
    w = table(spark, d, "part").select("p_partkey", F.array_distinct(F.split("p_name", "")).alias("letters"), F.split("p_name", " ").alias("words"))
    return w.select("p_partkey", F.array_join(F.slice("letters", 1, 3), "").alias("first"), F.array_position("letters", "a").alias("a_at"), F.to_json(F.arrays_zip("words", F.reverse("words").alias("back"))).alias("zipped"), F.array_contains("words", "anvil").alias("anvil"))


QUERIES = {
    "p1_organizations": (p1, sql("select id, array_to_string(affiliations, '|') as organizations from c")),
    "p2_affiliation_rows": (p2, sql("select id, pos::int as pos, orgs[pos + 1] as organization, case types[pos + 1] when 'academic' then 'academic' else 'non_academic' end as sector, countries[pos + 1] as country from (select id, orgs, types, countries, unnest(range(len(orgs))) as pos from derived)")),
    "p3_region_of": (p3, "select r_name, case lower(r_name) when 'africa' then 'africa_oceania' when 'america' then 'americas' when 'asia' then 'asia' when 'europe' then 'europe' else '' end as region from region"),
    "p3_country_regions": (p3n, "select n_name, case n_nationkey % 4 when 0 then 'europe' when 1 then 'americas' when 2 then 'asia' else '' end as region from nation"),
    "p4_aff_types": (p4, sql("select id, array_to_string(aff_type, ',') as aff_type from c")), "p5_aff_regions": (p5, sql("select id, array_to_string([x for x in case when len(aff_region) = 2 and regions[1] = aff_region[2] then list_reverse(aff_region) else aff_region end], ',') as aff_region from (select id, aff_region, regions from c join (select id, regions from derived) using (id))")),
    "p6_popularity": (p6, sql("select id, round(pop, 9) as pop from c")),
    "p7_bucket_slice_hashes": (p7, "select doc_id, lower(printf('%02x', ('0x' || sha256(k)[1:2])::int & 31)) as b, chr(65 + ('0x' || sha1(k)[40:40])::int % 4) as slice, sha256(k) as sha256, sha1(k) as sha1 from (select doc_id, 'doc-' || doc_id as k from documents)"),
    "p9_project": (p9, sql("select id, title, case when len(affiliations) > 0 then array_to_string(affiliations, ';') end as organizations, case when len(affiliations) > 0 then true end as ht, cited, importance from c")),
    "p10_facet_vectors": (p10, sql("select id, " + ", ".join(f"array_to_string({f}, ',') as {f}" for f in ("kind", "year", "component", "industry", "affiliations", "aff_type")) + ", case when i % 11 <> 0 then replace(title, ' ', ',') else '__none__' end as use_case" + ", array_to_string(case when len(aff_region) = 2 and regions[1] = aff_region[2] then list_reverse(aff_region) else aff_region end, ',') as aff_region from (select c.*, regions from c join (select id, regions from derived) using (id))")),
    "p11_pool_works": (p11, "select page_id, case when page_id % 3 <> 0 then url else 'https://w.example/' || page_id end as url, case regexp_extract(url, '/(\\w\\w)/', 1) when 'de' then 'preprint' when 'fr' then 'thesis' else 'paper' end as kind, case when page_id % 4 = 0 then page_id else 0 end as cited, 'tail' as tier from pages"),
    "p12_pool_repos": (p12, "select event_id, case when event_type = 'purchase' then case when event_id % 2 = 0 then 'shop,core' else 'shop' end when event_type in ('view', 'click') or event_id % 2 = 0 then 'core' else '' end as component, year(ts)::int as year from events"),
    "p13_labels": (p13, "select distinct p_type, case when lower(p_type) = 'promo' then 'On offer' else upper(lower(p_type)[1:1]) || lower(p_type)[2:] end as label, 'Undated' as undated from part"),
    "p14_action_label": (p14, "select page_id, case page_id % 3 when 0 then case when page_id % 2 = 0 then 'GitHub' else 'Repository' end when 1 then 'PDF' else 'Open' end as action from pages"),
    "p15_bibtex": (p15, P15_SQL),
    "p19_batches": (p19, sql("select id, case when len(use_case) > 1 then use_case[1] || '; et al.' else use_case[1] end as words, (1 + (row_number() over (order by id) - 1) // 40)::int as batch from (select id, case when i % 11 <> 0 then string_split(title, ' ') else ['__none__'] end use_case from c where importance = 6)")),
    "p20_identity_key": (p20, "select c_custkey, case when c_custkey % 3 = 0 then 'account:' || c_name when c_custkey % 2 = 0 then 'segment:' || c_mktsegment else 'unattributed' end as key, case when c_custkey % 3 = 0 then 'account' when c_custkey % 2 = 0 then 'segment' else 'unattributed' end as status from customer"),
    "p21_account_kind": (p21, "select c_custkey, case when c_custkey % 10 = 0 then 'bot' when c_custkey % 4 = 0 then 'organization' else 'person' end as kind from customer"),
    "p22_organization_type": (p22, P22_SQL),
    "p23_first_location": (p23, "select page_id, case when page_id % 2 = 0 then url || '#pdf' when page_id % 3 = 0 then 'https://a.example/x.pdf' else url end as url from pages"),
    "p24_url_lanes": (p24, "select page_id, case page_id % 3 when 0 then 'doi_in_url' when 1 then 'arxiv' else 'title_only' end as lane, case when page_id % 3 = 0 then '10.1234/ab.' || page_id end as doi, case when page_id % 3 = 1 then '2101.' || lpad(page_id::varchar, 5, '0') end as arxiv from pages"),
    "p25_evidence_tier": (p25, "select doc_id, tier, case tier when 'full_text' then 'high' when 'abstract_context' then 'medium' else 'low' end as confidence from (select doc_id, case when quality = 1 and text <> '' then 'full_text' when doc_id % 2 = 0 then 'abstract_context' else 'metadata_only' end as tier from documents left join labels using (doc_id))"),
    "x21_canon_country": (x21, "select n_nationkey, case n_nationkey % 3 when 1 then 'unknown' else case when lower(n_name) = 'nation_2' then 'Second' else n_name end end as country from nation"),
    "x22_spread_types": (x22, sql("select id, array_to_string(list_transform(types, lambda x: types[1]), ',') as types from derived")),
    "m2_year_prefix": (m2, "select o_orderkey, case when o_orderkey % 5 <> 0 then year(o_orderdate)::int end as year, case when o_orderkey % 5 = 0 then 'n.d.' else strftime(o_orderdate, '%Y-%m-%d') end as day from orders"),
    "m4_array_functions": (m4, """with l as (select p_partkey, string_split(p_name, ' ') as w, string_split(p_name, '') as s from part), x as (select *, list_filter(s, lambda c, i: list_position(s, c) = i) as letters from l)
select p_partkey, array_to_string(letters[1:3], '') as first, coalesce(list_position(letters, 'a'), 0)::bigint as a_at, '[' || array_to_string(['{"words":"' || w[i] || '","back":"' || w[len(w) + 1 - i] || '"}' for i in range(1, len(w) + 1)], ',') || ']' as zipped, list_contains(w, 'anvil') as anvil from x"""),
    "m7_reconstruct": (m7, "select doc_id, array_to_string(string_split_regex(text, '\\s+'), ' ') as text from documents where n_chars < 1500"),
}
