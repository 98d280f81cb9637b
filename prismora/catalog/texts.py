"""Queries of text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..testbed import table


def _pages(spark, d):
    """Pages with addresses in the forms that people write."""
    u = F.when(F.col("page_id") % 5 == 0, F.upper("url")).when(F.col("page_id") % 5 == 1, F.regexp_replace("url", "://", "://www.")).when(F.col("page_id") % 5 == 2, F.concat("url", F.lit("//"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", u.alias("url"))


_PAGES = "p as (select page_id, case page_id % 5 when 0 then upper(url) when 1 then replace(url, '://', '://www.') when 2 then url || '//' else url end as url from pages)"


def x1(spark, d):
    return _pages(spark, d).select("page_id", X.norm_url(F.col("url")).alias("norm"), X.url_key(F.col("url")).alias("key"), X.dedupe_key(F.col("url")).alias("dedupe"))


def x4(spark, d):
    return table(spark, d, "documents").select("doc_id", X.norm_title(F.substring("text", 1, 120)).alias("title"))


def x5(spark, d):
    k = F.col("page_id").cast("string")
    doi = F.element_at(F.array(F.concat(F.lit("https://doi.org/10.1/A"), k), F.concat(F.lit("doi: 10.1/A"), k, F.lit("./")), F.concat(F.lit(" http://dx.doi.org/10.1/A"), k, F.lit("/ "))), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", X.norm_doi(doi).alias("doi"))


def x6(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded"))


def x7(spark, d):
    t = X.tokenize(X.fold(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("tokens"), F.size(F.array_distinct(t)).alias("types"), F.get(t, F.lit(0)).alias("first"))


def x8(spark, d):
    hits = X.pattern_hits(F.col("text"), {"the": r"\bthe\b", "der": r"\bder\b"})
    return table(spark, d, "documents").select("doc_id", F.explode(hits).alias("h")).select("doc_id", "h.code", "h.line", F.md5("h.text").alias("text"), F.md5(F.array_join("h.context", "|")).alias("context"))


X8_SQL = """
with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as n, string_split(text, chr(10)) as lines from documents),
h as (select doc_id, code, t, n, lines, row_number() over (partition by doc_id, code order by n) as r from l, (values ('the', '\\bthe\\b'), ('der', '\\bder\\b')) v(code, p) where regexp_matches(t, p))
select doc_id, code, n::int as line, md5(t) as text, md5(array_to_string(lines[greatest(n - 4, 1):n + 4], '|')) as context from h where r <= 12
"""


def x9(spark, d):
    t = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit("\nReferences:\n[1] one\n")).otherwise(""))
    b = table(spark, d, "documents").select("doc_id", X.split_bibliography(t).alias("b"))
    return b.select("doc_id", F.length("b.body").alias("body"), F.length("b.bibliography").alias("bibliography"))


def x10(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.windows(F.col("text"), r"(?i)\bthe\b", 3, 90)).alias("window"))


def x11(spark, d):
    """Conversations packed: turns in order to a budget of characters."""
    from ..operators.worklists import budget_prefix

    kept = budget_prefix(table(spark, d, "conversations"), ["conv_id"], [F.col("turn")], F.length("text"), 2000)
    return kept.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat_ws(": ", x["role"], x["text"])), "\n")).alias("packed"), F.count("*").alias("turns"))


X11_SQL = "with r as (select *, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding) as n from conversations) select conv_id, md5(string_agg(role || ': ' || text, chr(10) order by turn)) as packed, count(*) as turns from r where n <= 2000 group by conv_id"


def o11(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return c.select("conv_id", F.array_join(X.even_sample_of(F.col("turns"), 3), ",").alias("sample"))


O11_SQL = "with t as (select conv_id, list_sort(list(turn)) t from conversations group by 1) select conv_id, case when len(t) <= 3 then array_to_string(t, ',') else array_to_string([t[1 + least(len(t) - 1, i * len(t) // 3)] for i in range(3)], ',') end as sample from t"


def o12(spark, d):
    from ..operators.worklists import budget_prefix

    return budget_prefix(table(spark, d, "conversations"), ["conv_id"], [F.col("turn")], F.length("text"), 1500).select("conv_id", "turn", "running")


def x12(spark, d):
    e = table(spark, d, "events")
    answer = F.concat(F.when(F.col("event_id") % 2 == 0, F.lit("```json\n")).otherwise("Sure: "), F.col("props"), F.when(F.col("event_id") % 2 == 0, F.lit("\n```")).otherwise("."))
    return e.select("event_id", X.record_text(answer).alias("record"))


def x13(spark, d):
    e = table(spark, d, "events")
    text = F.concat(F.lit("noise } "), F.col("props"), F.lit(" and {type: "), F.col("event_type"), F.lit('} {"type": '), F.col("event_type"), F.lit("}"))
    return e.select("event_id", F.array_join(X.json_objects(text), ";").alias("objects"))


def x14(spark, d):
    """Problems of each answer, as a list."""
    e = table(spark, d, "events").select("event_id", "event_type", "value", F.get_json_object("props", "$.k").try_cast("int").alias("k"))  # parsed once a row
    k = F.col("k")
    found = F.concat_ws("; ", F.when(k.isNull(), "k missing"), F.when(~k.between(0, 50), "k out of range"), F.when(~F.col("event_type").isin("view", "click", "purchase"), "type unknown"), F.when(F.col("value") < 0, "value negative"))
    return e.select("event_id", found.alias("problems"))


X14_SQL = "with e as (select *, (props ->> '$.k')::int k from events) select event_id, concat_ws('; ', case when k is null then 'k missing' end, case when not k between 0 and 50 then 'k out of range' end, case when event_type not in ('view', 'click', 'purchase') then 'type unknown' end, case when value < 0 then 'value negative' end) as problems from e"


def x15(spark, d):
    from ..operators.worklists import slug_stem, slugs

    docs = table(spark, d, "documents").select("doc_id", slug_stem(F.substring("text", 1, 60), F.lit("paper")).alias("stem"), F.when(F.col("doc_id") % 2 == 0, F.lit("2024")).otherwise("").alias("year"))
    return slugs(docs, "stem", "year", ["doc_id"], docs.where("doc_id % 50 = 0").select(F.concat_ws("-", "stem", F.lit("2024")).alias("id")), "id").select("doc_id", "slug")


def x16(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.comparison_key(F.col("text"))).alias("key"))


def x17(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.canonical_text(F.col("text"))).alias("text"))


def x18(spark, d):
    c = table(spark, d, "customer")
    raw = F.element_at(F.array(F.concat(F.lit("Dr. "), F.lit("ada VON lovelace")), F.lit("LOVELACE, ADA"), F.lit("ada de la cruz"), F.concat(F.lit("Ada <a@b.example>, PhD"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select("c_custkey", X.person_name(raw).alias("p")).select("c_custkey", "p.value", "p.status", F.array_join("p.notes", ",").alias("notes"))


def x20(spark, d):
    """Placeholders out, aliases in, facts aligned again by name."""
    n = table(spark, d, "nation").withColumn("names", F.array(F.lit("n/a"), F.col("n_name"), F.lit("none"), F.concat(F.lit("old "), F.col("n_name"))))
    alias = F.transform(F.filter("names", lambda x: ~F.lower(x).isin("n/a", "none", "unknown")), lambda x: F.regexp_replace(x, "^old ", ""))
    return n.select("n_nationkey", F.array_join(F.array_distinct(alias), ";").alias("names"))


def x24(spark, d):
    p = table(spark, d, "pages")
    u = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://GitHub.com/own/r"), F.col("page_id").cast("string"), F.lit(".git"))).otherwise(F.col("url"))
    return p.select("page_id", X.repo_of(u).alias("repo"))


def x25(spark, d):
    p = table(spark, d, "documents").select("doc_id", X.paragraphs(F.regexp_replace("text", "\n", "\n \n")).alias("p"))
    return p.select("doc_id", F.size("p").alias("paragraphs"))


def x26(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.squeeze(F.col("text"))).alias("text"), F.substring(X.squeeze(F.col("text")), 1, 40).alias("head"))


def x27(spark, d):
    t = F.concat(F.lit(" [pdf] "), F.col("p_name"), F.lit(r" $\unicode{x3b1}$ "))
    return table(spark, d, "part").select("p_partkey", X.clean_scraped_title(t).alias("title"))


def x19(spark, d):
    """Best effort at affiliation texts: a URL's host, an address's domain, else the text squeezed."""
    p = table(spark, d, "pages")
    t = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.lit("ada@uni.example.edu")).otherwise(F.lit("  Uni   of X "))
    host = F.regexp_replace(F.parse_url(F.when(t.startswith("http"), t), F.lit("HOST")), r"^(www|m|blog)\.", "")
    return p.select("page_id", F.when(t.startswith("http"), host).when(t.contains("@"), F.regexp_extract(t, "@(.+)$", 1)).otherwise(X.squeeze(t)).alias("name"))


def m9(spark, d):
    p = table(spark, d, "pages")
    html = F.concat(F.lit('<meta content="A &amp; B" name="citation_title"><meta property="og:url" content="/x">'), F.coalesce("html", F.lit("")))
    return p.select("page_id", X.meta_content(html, "citation_title").alias("title"), X.absolute_url(F.lit("https://h.example/a/"), X.meta_content(html, "og:url")).alias("link"))


def m8(spark, d):
    p = table(spark, d, "pages")
    block = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": ["Article"], "headline": "T'), F.col("page_id").cast("string"), F.lit('", "author": [{"name": "Ada"}, "Bo"]}]}</script>'))
    return p.select("page_id", X.json_ld_article(F.concat("html", block)).alias("a")).select("page_id", "a.type", "a.title", F.array_join("a.authors", ";").alias("authors"))


def f15(spark, d):
    words = "stea|thre|ungen|ciónes"
    return table(spark, d, "documents").where(F.lower("text").rlike(rf"\b({words})\b")).select("doc_id")


def f16(spark, d):
    p = table(spark, d, "pages")
    why = F.array_join(F.array_compact(F.array(F.when(F.col("url").contains("utm_"), "url hint"), F.when(F.lower("html").rlike(r"<h1"), "wording"))), " + ")
    return p.select("page_id", why.alias("reasons")).where("reasons <> ''")


def f13(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return docs.groupBy("doc_id").agg(F.count_if(~F.col("line").rlike(r"^\s*(#|//)") & F.col("line").rlike(r"[|]")).alias("lines"))


QUERIES = {
    "x1_url_keys": (x1, f"with {_PAGES} select page_id, regexp_replace(regexp_replace(lower(url), '^https?://(www\\.)?', ''), '/+$', '') as norm, regexp_replace(regexp_replace(lower(url), '^https?://', ''), '/+$', '') as key, regexp_replace(url, '/+$', '') as dedupe from p"),
    "x4_norm_title": (x4, "select doc_id, trim(regexp_replace(lower(text[1:120]), '[^a-z0-9]+', ' ', 'g')) as title from documents"),
    "x5_norm_doi": (x5, "select page_id, '10.1/a' || page_id as doi from pages"),
    "x6_fold": (x6, "select doc_id, md5(lower(strip_accents(text))) as folded from documents"),
    "x7_tokenize": (x7, "with t as (select doc_id, [x for x in string_split_regex(lower(strip_accents(text)), '[^\\p{L}\\p{N}]+') if x <> ''] t from documents) select doc_id, len(t)::int as tokens, len(list_distinct(t))::int as types, t[1] as first from t"),
    "x8_pattern_scan": (x8, X8_SQL), "x9_bibliography": (x9, None), "x10_windows": (x10, None), "x11_packed_evidence": (x11, X11_SQL),
    "x12_record_text": (x12, "select event_id, props as record from events"), "x13_objects": (x13, None), "x14_answer_problems": (x14, X14_SQL), "x15_slugs": (x15, None),
    "x16_comparison_key": (x16, None), "x17_canonical_text": (x17, None), "x18_person_names": (x18, None), "x19_best_effort": (x19, "select page_id, case page_id % 3 when 0 then regexp_replace(regexp_extract(url, '//([^/?#]+)', 1), '^(www|m|blog)\\.', '') when 1 then 'uni.example.edu' else 'Uni of X' end as name from pages"),
    "x20_clean_names": (x20, "select n_nationkey, n_name as names from nation"),
    "x24_repo_of": (x24, "select page_id, case when page_id % 2 = 0 then 'own/r' || page_id end as repo from pages"),
    "x25_paragraphs": (x25, "select doc_id, len([x for x in string_split(text, chr(10)) if trim(x) <> ''])::int as paragraphs from documents"),
    "x26_squeeze": (x26, "select doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as text, trim(regexp_replace(text, '\\s+', ' ', 'g'))[1:40] as head from documents"),
    "x27_clean_title": (x27, "select p_partkey, p_name as title from part"),
    "o11_even_sample": (o11, O11_SQL), "o12_budget_prefix": (o12, "select conv_id, turn, running from (select conv_id, turn, sum(length(text)) over (partition by conv_id order by turn rows unbounded preceding)::bigint as running from conversations) where running <= 1500"),
    "m8_jsonld": (m8, "select page_id, 'Article' as type, 'T' || page_id as title, 'Ada;Bo' as authors from pages"), "m9_meta": (m9, "select page_id, 'A & B' as title, 'https://h.example/x' as link from pages"),
    "f13_live_lines": (f13, "select doc_id, count_if(not regexp_matches(line, '^\\s*(#|//)') and contains(line, '|'))::bigint as lines from (select doc_id, unnest(string_split(text, chr(10))) line from documents) group by doc_id"),
    "f15_keyword_triage": (f15, "select doc_id from documents where list_has_any(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ['stea', 'thre', 'ungen', 'ciónes'])"),
    "f16_audit_reasons": (f16, "select page_id, concat_ws(' + ', case when contains(url, 'utm_') then 'url hint' end, case when contains(lower(html), '<h1') then 'wording' end) as reasons from pages where contains(url, 'utm_') or contains(lower(html), '<h1')"),
}
