"""Queries of curation: answers and their problems, candidates, authors, projections, cards, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import new_folder
from ..functions import derive as D
from ..operators import constraints as V
from ..operators import curation as C
from ..sources import files
from ..testbed import raw_corpus, table
from .facets import sql

RULES = C.AnswerRules(
    required=("title", "summary", "authors", "affiliations", "affiliation_types", "affiliation_countries", "component", "concept", "use_case", "industry", "integration", "importance", "evidence", "confidence"),
    facets={"component": frozenset(["core", "extra"]), "concept": frozenset(["copula"]), "use_case": frozenset(["alpha", "beta"]), "industry": frozenset(["health"])},
    integration=frozenset(["uses", "unclear", "citation_only", "name_collision"]), sectors=frozenset(["academic", "corporate"]),
)


def _answers(spark, d):
    """A model's answer for each part, with a fault of every kind in some."""
    k = F.col("p_partkey")
    w = lambda c, a, b: F.when(c, a).otherwise(b)
    words = lambda *x: F.array(*map(F.lit, x))
    fields = {
        "title": F.col("p_name"),
        "summary": w(k % 7 == 3, F.lit("too short"), F.concat(F.lit("A record about "), "p_name", F.lit(" that is long enough to pass"), w(k % 11 == 0, F.lit(""), F.lit(".")))),
        "authors": words("Ann", "Bo"), "affiliations": w(k % 7 == 4, words("Uni A; Inst B"), words("Uni A; Inst B", "Uni A")),
        "affiliation_types": w(k % 7 == 4, words("academic", "corporate", "royal"), words("academic", "corporate")), "affiliation_countries": words("US", "FR"),
        "component": words("core"), "concept": F.array().cast("array<string>"), "use_case": w(k % 7 == 1, words("alpha", "zeta"), w(k % 7 == 2, F.array().cast("array<string>"), words("alpha"))),
        "industry": w(k % 5 == 0, F.lit(None), words("health")), "integration": w(k % 13 == 0, F.lit("weird"), w(k % 7 == 2, F.lit("unclear"), F.lit("uses"))),
        "importance": w(k % 7 == 3, F.lit(9), (k % 6).cast("int")), "evidence": w(k % 8 == 0, F.lit(None).cast("string"), w(k % 9 == 0, F.lit("  "), F.lit("seen in code"))), "confidence": w(k % 10 == 1, F.lit("sure"), F.lit("high")),
    }
    text = F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))
    text = w(k % 5 == 0, F.regexp_replace(text, r'"integration"', '"industry":"health","integration"'), text)
    answer = w(k % 7 == 5, F.concat(F.lit("```json\n"), text, F.lit("\n```")), w(k % 7 == 6, F.lit("no object here"), text))
    return table(spark, d, "part").select(k.alias("k"), answer.alias("answer"))


_PROBLEMS = """p as (select p_partkey as k, case when p_partkey % 7 = 6 then ['no JSON object'] when p_partkey % 8 = 0 then ['missing evidence'] else list_filter([
  case when p_partkey % 7 = 1 then 'use_case: zeta is not in the vocabulary' end, case when p_partkey % 5 = 0 then 'industry is not a list' end,
  case when p_partkey % 7 = 2 and p_partkey % 13 = 0 then 'use_case is empty' end, case when p_partkey % 13 = 0 then 'integration: weird is not in the vocabulary' end,
  case when p_partkey % 7 = 3 then 'importance 9 is not an integer 0-5' end, case when p_partkey % 10 = 1 then 'confidence sure is not high/medium/low' end,
  case when p_partkey % 7 = 2 and p_partkey % 13 <> 0 and p_partkey % 10 <> 1 then 'unclear with high confidence' end,
  case when p_partkey % 7 = 3 then 'summary of 9 characters' when p_partkey % 11 = 0 then 'summary does not end in a sentence' end, case when p_partkey % 9 = 0 then 'evidence is empty' end,
  case when p_partkey % 7 = 4 then '2 authors, 1 affiliations' end, case when p_partkey % 7 = 4 then 'affiliation_type royal is not in the vocabulary' end,
  case when p_partkey % 7 = 4 then 'affiliation_types has 3 values, affiliations name 2' end], lambda x: x is not null) end as problems from part)"""


def x14(spark, d):
    return C.judged(_answers(spark, d), "answer", RULES).select("k", F.array_join("problems", "; ").alias("problems"))


def k11(spark, d):
    """Stored answers under the rules of now: how many pass, and why the others don't."""
    done = table(spark, d, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("key"))
    promoted, _, reasons = C.recovered(_answers(spark, d), "k", "answer", done, "key", RULES)
    return promoted.agg(F.lit("promoted").alias("reason"), F.count("*").alias("n")).unionByName(reasons)


def x20(spark, d):
    n = table(spark, d, "nation")
    a = F.array(F.concat(F.lit("n/a; "), "n_name"), F.concat(F.lit("old "), "n_name", F.lit("; none")), F.lit("None."), F.lit(None), F.lit(""))
    facts = lambda c: F.when(F.col("n_nationkey") % 5 == 0, F.array(F.lit(f"{c}0"), F.lit(f"{c}1"))).otherwise(F.array(*[F.lit(f"{c}{i}") for i in range(5)]))
    r = C.cleaned_affiliations(a, facts("t"), facts("c"), {"old NATION_1": "NATION_1", "old NATION_3": "NATION_3", "old NATION_7": "Nation Seven"})
    text = lambda c: F.array_join(c, "|", "-")
    return n.select("n_nationkey", r.alias("r")).select("n_nationkey", text("r.affiliations").alias("affiliations"), text("r.types").alias("types"), text("r.countries").alias("countries"), "r.changed")


X20_SQL = """with n as (select *, n_nationkey in (1, 3) as same, case n_nationkey when 1 then n_name when 3 then n_name when 7 then 'Nation Seven' else 'old ' || n_name end as o from nation)
select n_nationkey, n_name || '|' || o || '|-|-|' as affiliations, case when n_nationkey % 5 = 0 then 't0|t1' when same then 't1' else 't1|t2' end as types,
  case when n_nationkey % 5 = 0 then 'c0|c1' when same then 'c1' else 'c1|c2' end as countries, true as changed from n"""


def f16(spark, d):
    p = table(spark, d, "pages")
    checks = {"repository url": F.lower("url").contains("/de/"), "thesis wording in the text": F.lower("html").rlike(r"\bthe\b"), "third": F.col("page_id") % 3 == 0}
    return p.select("page_id", C.audit_reasons(checks).alias("reasons"))


def k1(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k, F.concat(F.lit("own"), k.cast("string"), F.lit("/Tool "), (k % 40).cast("string")).alias("repo"))
    evidence = p.select("repo", F.when(k % 6 == 0, "error").otherwise("ok").alias("status"))
    pool = p.where("p_partkey % 2 = 0").select("repo", (k * 3).alias("stars"))
    taken = spark.createDataFrame([("repo-tool-3",), ("repo-own5-tool-5",), ("repo-x",)], "id string")
    out = C.repo_candidates(evidence, pool, p.where("p_partkey % 7 = 0").select(F.upper("repo").alias("repo")), p.where("p_partkey % 11 = 0").select("repo"), p.where("p_partkey % 13 = 0").select("repo"), taken, ["stars"])
    return out.select("repo", "stars", "id")


K1_SQL = """with e as (select p_partkey k, p_partkey % 40 as t, 'own' || p_partkey || '/Tool ' || (p_partkey % 40) as repo from part where p_partkey % 6 <> 0 and p_partkey % 7 <> 0 and p_partkey % 11 <> 0 and p_partkey % 13 <> 0),
r as (select *, row_number() over (partition by t order by repo) as rn from e)
select repo, case when k % 2 = 0 then k * 3 end as stars, case when rn = 1 and t <> 3 then 'repo-tool-' || t when k = 5 then 'repo-tool-5-2' else 'repo-own' || k || '-tool-' || t end as id from r"""


def k3(spark, d):
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    works = table(spark, d, "part").select(
        k.alias("seq"), F.concat(F.lit("W"), (k % 1500).cast("string")).alias("id"), F.when(k % 5 == 0, F.concat(F.lit("https://doi.org/10.1/x"), s)).alias("doi"), F.col("p_name").alias("title"),
        F.when(k % 4 != 0, F.concat(F.lit("https://x.example/"), s)).alias("url"), F.when(k % 3 == 0, "an abstract").alias("abstract"), (k % 17).alias("cited"), (2000 + k % 10).alias("year"),
    )
    curated = table(spark, d, "part").where("p_partkey % 7 = 0").select(F.concat(F.lit("http://www.x.example/"), s, F.lit("/")).alias("url"))
    done = table(spark, d, "part").where("p_partkey % 11 = 0").select(F.concat(F.lit("x.example/"), s).alias("key"))
    contexts = spark.createDataFrame([("COLD  widget", "one"), ("cold-widget", "two"), ("large bolt", "three")], "title string, sentence string")
    out = C.work_candidates(works, curated, done, spark.createDataFrame([("paper-cold-widget-2001",)], "id string"), contexts)
    return out.select("key", "url", "tier", F.coalesce(F.array_join("cites", ","), F.lit("")).alias("cites"), "cited")


K3_SQL = """with w as (select p_partkey k, case when p_partkey % 4 <> 0 then 'https://x.example/' || p_partkey else 'W' || (p_partkey % 1500) end as url, p_name from part where p_partkey < 1500 and p_partkey % 5 <> 0),
c as (select *, case p_name when 'cold widget' then 'one,two' when 'large bolt' then 'three' else '' end as cites from w where k % 4 = 0 or (k % 7 <> 0 and k % 11 <> 0))
select lower(replace(url, 'https://', '')) as key, url, case when k % 3 = 0 or cites <> '' then 'abstract_context' else 'metadata_only' end as tier, cites, k % 17 as cited from c"""


def k4(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    doi = F.concat(F.lit("https://doi.org/10.5/"), F.col("doc_id").cast("string"))
    records = docs.select("doc_id", F.when(F.col("doc_id") % 4 != 0, doi).alias("doi"), F.when(F.col("doc_id") % 5 == 0, "full_text").otherwise("metadata_only").alias("evidence_tier"))
    out, skipped = C.rejudged(records, docs.where("doc_id % 3 <> 0").select(doi.alias("doi"), "text"), docs.where("doc_id % 7 = 0").select(doi.alias("doi")), docs.where("doc_id % 11 <> 0").select(F.upper(doi).alias("doi")))
    return out.agg(F.lit("candidate").alias("reason"), F.count("*").alias("n")).unionByName(skipped)


K4_SQL = "select case when doc_id % 4 = 0 then 'no doi' when doc_id % 5 = 0 then 'already full_text' when doc_id % 3 = 0 or text = '' then 'no text on disk' when doc_id % 7 = 0 then 'already re-judged' when doc_id % 11 = 0 then 'not in the tail' else 'candidate' end as reason, count(*) as n from documents group by 1"


def k6(spark, d):
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    p = table(spark, d, "part")
    records = p.select(F.concat(F.lit("r"), s).alias("id"), F.concat(F.lit("o/r"), s).alias("repo"), F.when(k % 5 == 0, F.array(F.lit("alpha"), F.lit("beta"))).otherwise(F.array(F.lit("alpha"))).alias("component"))
    none = F.array().cast("array<string>")
    line = lambda file, text, vendored=none: F.struct(F.lit(file).alias("file"), text.alias("text"), vendored.alias("vendored"))
    lines = F.array(
        line("src/main.py", F.when(k % 2 == 0, "import beta").otherwise("# import beta")), line("Third/lib/x.py", F.lit("from gamma import y"), F.when(k % 3 == 0, F.array(F.lit("third/lib/"))).otherwise(none)), line("pkg/delta/core.py", F.lit("import delta")),
    )
    hits = p.select(F.concat(F.lit("o/r"), s).alias("repo"), F.explode(lines).alias("l")).select("repo", "l.*")
    out = C.component_backfill(records, hits, {n: rf"\b(?:import|from)\s+{n}\b" for n in ("alpha", "beta", "gamma", "delta")}, "component")
    return out.select("id", "override", F.array_join("component", ",").alias("component"))


K6_SQL = """with x as (select 'r' || p_partkey as id, p_partkey % 2 = 0 as b, p_partkey % 3 <> 0 as g, p_partkey % 5 = 0 as claimed from part)
select id, true as override, 'alpha' || case when b or claimed then ',beta' else '' end || case when g then ',gamma' else '' end as component from x where g or (b and not claimed)"""


def _repositories(spark, d):
    k, s, o = F.col("p_partkey"), F.col("p_partkey").cast("string"), (F.col("p_partkey") % 10).cast("string")
    pool = table(spark, d, "part").where("p_partkey % 2 = 0").select(
        k.alias("seq"), F.concat(F.lit("Own"), o, F.lit("/r"), s).alias("repo"), F.when(k % 4 != 0, F.concat(F.lit("own"), o)).alias("owner"), F.array(F.concat(F.lit("c"), (k % 3).cast("string")), F.concat(F.lit("OWN"), o)).alias("top_contributors")
    )
    index = table(spark, d, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("part-"), s).alias("id"), F.concat(F.lit("https://github.com/own"), o, F.lit("/R"), s, F.lit("/tree/main")).alias("url"))
    return C.repositories(pool, index)


_REPOS = """a as (
  select p_partkey k, 'own' || p_partkey % 10 || '/r' || p_partkey as repo_key, case when p_partkey % 3 = 0 then 'part-' || p_partkey else '' end as ids,
    case when p_partkey % 4 = 0 then 'Own' else 'own' end || p_partkey % 10 as raw, 'owner,top_contributor' as roles from part where p_partkey % 2 = 0
  union all select p_partkey, 'own' || p_partkey % 10 || '/r' || p_partkey, case when p_partkey % 3 = 0 then 'part-' || p_partkey else '' end, 'c' || p_partkey % 3, 'top_contributor' from part where p_partkey % 2 = 0
  union all select p_partkey, 'own' || p_partkey % 10 || '/r' || p_partkey, 'part-' || p_partkey, 'own' || p_partkey % 10, 'owner' from part where p_partkey % 2 = 1 and p_partkey % 3 = 0
)"""


def k8(spark, d):
    return _repositories(spark, d).select("repo_key", F.array_join("ids", ",").alias("ids"), "raw", F.array_join("roles", ",").alias("roles"))


def k9(spark, d):
    repos = _repositories(spark, d)
    k = F.regexp_extract("repo_key", r"/r(\d+)$", 1).cast("int")
    kind = "array<struct<login:string,anonymous:string,contributions:int>>"
    people = F.array(F.struct(F.concat(F.lit("C"), (k % 3).cast("string")).alias("login"), F.lit(None).cast("string").alias("anonymous"), k.alias("contributions")))
    meta = repos.select("repo_key").distinct().select("repo_key", F.when(k % 8 != 0, F.split_part("repo_key", F.lit("/"), F.lit(1))).alias("owner_login"), F.when(k % 6 == 0, F.array().cast(kind)).otherwise(people.cast(kind)).alias("contributors"))
    identities = spark.createDataFrame([("c0", "c0", "Zero", "MIT "), ("own1", "Own1", "One", "mit"), ("x", "C2", "Two", None)], "raw_key string, login string, public_name string, affiliation string")
    mapping = spark.createDataFrame([("MIT", "Massachusetts Institute of Technology")], "raw string, name string")
    out = C.repo_authors(repos, meta, identities, mapping)
    return out.select("repo", "raw", "identity_source", "verified", "contributions", "public_name", "affiliation_raw", "affiliation")


K9_SQL = f"""with {_REPOS}, s as (select *, case when roles like 'owner%' then 'repository_owner' when k % 6 <> 0 then 'linked_contributor' else 'unverified_contributor_string' end as src from a),
n as (select *, case when src = 'repository_owner' and lower(raw) = 'own1' then 'One' when src = 'linked_contributor' and raw = 'c0' then 'Zero' when src = 'linked_contributor' and raw = 'c2' then 'Two' end as pn from s)
select case when k % 2 = 0 then 'Own' || k % 10 || '/r' || k else 'own' || k % 10 || '/R' || k end as repo, raw, src as identity_source, src <> 'unverified_contributor_string' as verified, case when src = 'linked_contributor' then k end as contributions,
  pn as public_name, case pn when 'One' then 'mit' when 'Zero' then 'MIT ' end as affiliation_raw, case when pn in ('One', 'Zero') then 'Massachusetts Institute of Technology' end as affiliation from n"""


def k10(spark, d):
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    docs = table(spark, d, "documents")
    records = docs.select(i.alias("id"), F.element_at(F.array(F.lit("paper"), F.lit("blog_post"), F.lit("code_repo")), (i % 3 + 1).cast("int")).alias("kind"), F.when(i % 3 == 2, F.concat(F.lit("https://github.com/o/r"), s)).otherwise("https://x.example").alias("url"))
    none = F.array().cast("array<string>")
    works = docs.select(i.alias("id"), F.when(i % 2 == 0, "ok").otherwise("failed").alias("status"), F.array(F.struct(F.col("source").alias("name"), F.array("lang", F.lit("X")).alias("institutions")), F.struct(F.lit("solo").alias("name"), none.alias("institutions"))).alias("authorships"))
    repo_rows = docs.where("doc_id % 5 = 0").select(i.alias("id"), F.lit("dev").alias("name"), F.lit("U").alias("affiliation"))
    pages = docs.where("doc_id % 7 <> 0").select(i.alias("id"), F.array("source").alias("authors"), F.col("lang").alias("publisher"))
    return C.publication_authors(records, works, repo_rows, pages)


K10_SQL = """with r as (select doc_id id, source, lang, ['paper', 'blog_post', 'code_repo'][doc_id % 3 + 1] as kind, case when doc_id % 3 = 0 then case when doc_id % 2 = 1 and doc_id % 5 = 0 then 'repository' else 'scholarly' end when doc_id % 3 = 2 and doc_id % 5 = 0 then 'repository' else 'web' end as route from documents),
x as (
  select id, kind, route, 1 as author_position, source as author, 1 as affiliation_position, lang as affiliation from r where route = 'scholarly' and id % 2 = 0
  union all select id, kind, route, 1, source, 2, 'X' from r where route = 'scholarly' and id % 2 = 0
  union all select id, kind, route, 2, 'solo', null, null from r where route = 'scholarly' and id % 2 = 0
  union all select id, kind, route, null, null, null, null from r where (route = 'scholarly' and id % 2 = 1) or (route = 'web' and id % 7 = 0)
  union all select id, kind, route, 1, 'dev', 1, 'U' from r where route = 'repository'
  union all select id, kind, route, 1, source, 1, lang from r where route = 'web' and id % 7 <> 0
) select *, case when author is null then 'unattributed' else 'attributed' end as status from x"""


def p16(spark, d):
    k = F.col("p_partkey")
    person = lambda a: F.struct(F.concat(F.lit("A"), a.cast("string")).alias("name"), F.array(F.struct(F.concat(F.lit("I"), (a % 3).cast("string")).alias("name"), F.when(a % 2 == 0, "US").otherwise("").alias("country"))).alias("institutions"))
    place = lambda here, name: F.when(here, F.struct(F.when(k % 2 == 0, F.lit(name)).alias("source"), F.lit(f"https://{name}").alias("landing"), F.when(k % 3 == 0, F.lit(f"https://{name}/pdf")).alias("pdf")))
    work = F.struct(
        F.col("p_name").alias("title"), F.when(k % 4 == 0, F.upper("p_name")).alias("display_name"), F.col("p_size").alias("year"), place(k % 5 != 0, "one").alias("location"), place(k % 7 != 0, "two").alias("best"),
        F.transform(F.sequence(F.lit(1), F.when(k % 10 == 0, 14).otherwise(2)), person).alias("authorships"),
    )
    out = table(spark, d, "part").select("p_partkey", C.lifted_work(work).alias("w")).select("p_partkey", "w.*")
    return out.withColumns({c: F.array_join(c, ",") for c in ("authors", "institutions", "countries")})


P16_SQL = """with w as (select p_partkey k, p_name, p_size, case when p_partkey % 5 <> 0 then 'one' when p_partkey % 7 <> 0 then 'two' end as place, case when p_partkey % 10 = 0 then 14 else 2 end as n from part)
select k as p_partkey, case when k % 4 = 0 then upper(p_name) else p_name end as title, p_size as year, case when k % 2 = 0 then place end as venue, 'https://' || place as landing, case when k % 3 = 0 then 'https://' || place || '/pdf' end as pdf,
  array_to_string(['A' || x for x in range(1, least(n, 12) + 1)], ',') as authors, n::int as n_authors, case when n = 14 then 'I0,I1,I2' else 'I1,I2' end as institutions, 'US' as countries from w"""


def p17(spark, d):
    k, s = F.col("p_partkey"), F.col("p_partkey").cast("string")
    name = C.package_name(F.when(k % 3 == 0, F.concat(F.lit("[project]\n name = 'py."), s, F.lit("'\n"))), F.when(k % 2 == 0, F.concat(F.lit("[metadata]\nname = cfg-"), s)).otherwise(""), F.when(k % 5 == 0, F.concat(F.lit('setup(name="sp'), s, F.lit('")'))))
    return table(spark, d, "part").select("p_partkey", name.alias("package"))


def p18(spark, d):
    k = F.col("p_partkey")
    n = lambda c: c.cast("int")
    node = F.struct(
        F.col("p_name").alias("name"), F.when(k % 2 == 0, F.col("p_brand")).alias("owner"), n(k).alias("stars"), F.lit(None).cast("int").alias("forks"), n(k * 2).alias("commits"),
        F.when(k % 4 != 0, F.array(F.array(n(k % 3), F.lit(None).cast("int")), F.array().cast("array<int>"), F.array(F.lit(2), F.lit(5)))).alias("releases"), F.when(k % 5 == 0, F.split("p_name", " ")).alias("topics"), F.lit("  about ").alias("description"), F.lit("2020-02-03T04:05").alias("created"),
    )
    r = C.repo_metrics(F.when(k % 9 != 0, node), F.concat(F.lit("asked-"), k.cast("string")))
    return table(spark, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.*").withColumn("topics", F.array_join("topics", ","))


P18_SQL = """select p_partkey, case when gone then 'asked-' || p_partkey else p_name end as repo, case when not gone then case when p_partkey % 2 = 0 then p_brand else '' end end as owner, case when not gone then p_partkey end as stars, case when not gone then 0 end as forks,
  case when not gone then p_partkey * 2 end as commits, case when not gone then case when p_partkey % 4 <> 0 then p_partkey % 3 + 7 else 0 end end as release_downloads, case when not gone then case when p_partkey % 5 = 0 then replace(p_name, ' ', ',') else '' end end as topics,
  case when not gone then 'about' end as description, case when not gone then '2020-02-03' end as created, case when gone then 'gone' else 'ok' end as status from (select *, p_partkey % 9 = 0 as gone from part)"""


def x23(spark, d):
    text = F.concat(F.lit("# Terms\n\n**kind** (an aside): alpha, beta (gloss, x), "), F.lower("r_name"), F.lit(",\n gamma_b, 9no\n\n**other**: z\n"))
    return table(spark, d, "region").select("r_name", *[F.array_join(C.vocabulary_terms(text, f), ",").alias(f) for f in ("kind", "other", "third")])


def q11(spark, d):
    c, k = raw_corpus(spark, d), F.col("i")
    records = c.select(
        "id", F.when(k % 19 != 0, F.col("title")).otherwise("").alias("title"), F.element_at(F.array(F.lit("paper"), F.lit("code_repo"), F.lit("blog_post")), (k % 3 + 1).cast("int")).alias("kind"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.concat(F.lit("https://GitHub.com/a/"), "id")).otherwise("https://x.example").alias("url"), F.when(k % 5 == 0, F.col("brand")).alias("venue"), F.col("year_n").alias("year"), "stars", "cited",
        F.when(k % 6 == 0, F.array(F.lit("Ann"), F.lit("Bo"))).alias("authors"), F.when(k % 7 == 0, "").when(k % 7 == 1, "line 3").alias("evidence"), F.when(k % 8 == 0, "10.1/x").when(k % 8 == 1, "https://doi.org/10.1/y").alias("doi"),
        F.when(k % 2 == 0, F.array(F.lit("ctgan_like"), F.lit("core"))).alias("component"), F.array("brand").alias("use_case"), F.when(k % 10 == 0, "tail").alias("tier"),
    )
    out = C.cards(records, ("component", "use_case"), D.label_for)
    return out.withColumns({"chips": F.array_join(F.transform("chips", lambda x: F.concat_ws(":", x["facet"], x["label"])), ","), "actions": F.array_join("actions", ",")})


Q11_SQL = sql("""select id, case when i % 19 <> 0 then title else 'Untitled' end as heading, u as url, ['Paper', 'Code repo', 'Blog post'][i % 3 + 1] as badge, i % 10 = 0 as tail,
  concat_ws(' · ', case when i % 5 = 0 then brand end, year_n::varchar, '★ ' || stars, 'cited by ' || cited) as meta, case when i % 6 = 0 then 'Ann, Bo' else '' end as authors, case when i % 7 = 1 then 'evidence: line 3' end as evidence,
  case i % 8 when 0 then 'https://doi.org/10.1/x' when 1 then 'https://doi.org/10.1/y' end as doi_url, case when i % 2 = 0 then 'component:Ctgan like,component:Core,' else '' end || 'use_case:' || brand as chips,
  concat_ws(',', case when u is not null then case i % 3 when 1 then case when i % 4 = 1 then 'GitHub' else 'Repository' end when 0 then 'PDF' else 'Open' end end, case when i % 8 < 2 then 'DOI' end, case when i % 3 = 0 then 'BibTeX' end, case when u is not null then 'Copy link' end) as actions
from (select *, case i % 4 when 0 then null when 1 then 'https://GitHub.com/a/' || id else 'https://x.example' end as u from raw)""")


def s1(spark, d):
    """Shards as files of arrays: written, and read in their order."""
    folder = new_folder(spark, "shards")
    row = F.struct(F.col("event_id").alias("o"), F.col("event_id").cast("string").alias("id"), F.concat(F.lit("https://x.example/"), F.col("event_id").cast("string")).alias("url"), (F.col("event_id") % 3 == 0).alias("override"))
    lists = table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("shard")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    lists.select("shard", F.to_json(F.transform("rows", lambda r: F.struct(r["id"], r["url"], r["override"])))).write.partitionBy("shard").text(folder)
    return files.read_shards(spark, f"{folder}/*/*").select(F.col("id").cast("bigint").alias("event_id"), "pos", "override", F.element_at("fields", "url").alias("url"))


def s5(spark, d):
    """Lines of JSON with comments, blanks and faults: the good rows, and the faults by file and line."""
    folder = new_folder(spark, "lines")
    e = F.col("event_id")
    line = F.when(e % 10 == 0, "").when(e % 10 == 1, "// note").when(e % 10 == 2, F.concat(F.lit('{"a": '), e.cast("string"))).otherwise(F.concat(F.lit('{"a": '), e.cast("string"), F.lit("}")))
    texts = table(spark, d, "events").groupBy((e % 2).alias("f")).agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))).alias("x"))
    texts.select("f", F.array_join(F.transform("x", lambda x: x["l"]), "\n")).write.partitionBy("f").text(folder)
    rows, errors = files.read_json_lines(spark, f"{folder}/*/*", "a bigint")
    return rows.select("a", F.lit(None).cast("int").alias("line")).unionByName(errors.select(F.regexp_extract("value", r"(\d+)$", 1).cast("bigint").alias("a"), "line"))


def v1(spark, d):
    """Unreadable lines as violations, by file and line."""
    folder = new_folder(spark, "lines")
    e = F.col("event_id")
    line = F.when(e % 100 == 7, F.concat(F.lit("bad "), e.cast("string"))).otherwise(F.concat(F.lit('{"a": '), e.cast("string"), F.lit("}")))
    texts = table(spark, d, "events").agg(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))).alias("x"))
    texts.select(F.array_join(F.transform("x", lambda x: x["l"]), "\n")).write.text(folder)
    return V.unreadable(files.read_json_lines(spark, f"{folder}/*.txt", "a bigint")[1]).select("check", F.split_part("id", F.lit(":"), F.lit(2)).alias("line"), "detail")


def s18(spark, d):
    """The chosen one among a registry's answers."""
    k = F.col("n_nationkey")
    item = lambda name, chosen: F.struct(chosen.alias("chosen"), F.lit("EXACT").alias("matching_type"), F.struct(name.alias("name"), F.concat(F.lit("https://r/"), k.cast("string")).alias("id"), F.when(k % 3 == 0, "France").alias("country"), F.array(F.lit("education")).alias("types")).alias("organization"))
    items = F.when(k % 5 != 0, F.array(item(F.lit("first"), k % 2 == 0), item(F.col("n_name"), F.lit(True)), item(F.lit("last"), F.lit(True))))
    return table(spark, d, "nation").select("n_nationkey", C.registry_match(items).alias("m")).select("n_nationkey", "m.status", "m.name", "m.id", "m.country", F.array_join("m.types", ",").alias("types"))


QUERIES = {
    "x14_answers": (x14, f"with {_PROBLEMS} select k, array_to_string(problems, '; ') as problems from p"),
    "k11_recovered": (k11, f"with {_PROBLEMS}, l as (select * from p where k % 4 <> 0) select 'promoted' as reason, count(*) as n from l where len(problems) = 0 union all select q[1:60], count(*) from (select unnest(problems) q from l) group by 1"),
    "x20_affiliations": (x20, X20_SQL),
    "f16_audit": (f16, "select page_id, nullif(concat_ws(' + ', case when contains(lower(url), '/de/') then 'repository url' end, case when regexp_matches(lower(html), '\\bthe\\b') then 'thesis wording in the text' end, case when page_id % 3 = 0 then 'third' end), '') as reasons from pages"),
    "k1_repo_candidates": (k1, K1_SQL), "k3_work_candidates": (k3, K3_SQL), "k4_rejudged": (k4, K4_SQL), "k6_component_backfill": (k6, K6_SQL),
    "k8_repositories": (k8, f"with {_REPOS} select repo_key, ids, raw, roles from a"), "k9_identities": (k9, K9_SQL), "k10_publications": (k10, K10_SQL),
    "p16_lifted_works": (p16, P16_SQL), "p17_package_names": (p17, "select p_partkey, case when p_partkey % 3 = 0 then 'py.' || p_partkey when p_partkey % 2 = 0 then 'cfg-' || p_partkey when p_partkey % 5 = 0 then 'sp' || p_partkey else '' end as package from part"),
    "p18_repo_metrics": (p18, P18_SQL), "x23_vocabulary": (x23, "select r_name, array_to_string(list_sort(list_concat(['alpha', 'beta', 'gamma_b'], string_split(lower(r_name), ' '))), ',') as kind, 'z' as other, null as third from region"),
    "q11_cards": (q11, Q11_SQL),
    "s1_shards": (s1, "select event_id, (row_number() over (partition by user_id % 3 order by event_id) - 1)::int as pos, event_id % 3 = 0 as override, 'https://x.example/' || event_id as url from events"),
    "s5_json_lines": (s5, "select event_id as a, case when event_id % 10 = 2 then row_number() over (partition by event_id % 2 order by event_id)::int end as line from events qualify event_id % 10 >= 2"),
    "v1_unreadable": (v1, "select 'unreadable' as \"check\", (row_number() over (order by event_id))::varchar as line, 'bad ' || event_id as detail from events qualify event_id % 100 = 7"),
    "s18_registry_match": (s18, "select n_nationkey, case when n_nationkey % 5 = 0 then 'unmatched' else 'matched' end as status, case when n_nationkey % 5 <> 0 then case when n_nationkey % 2 = 0 then 'first' else n_name end end as name, case when n_nationkey % 5 <> 0 then 'https://r/' || n_nationkey end as id, case when n_nationkey % 5 <> 0 and n_nationkey % 3 = 0 then 'France' end as country, case when n_nationkey % 5 <> 0 then 'education' end as types from nation"),
}
