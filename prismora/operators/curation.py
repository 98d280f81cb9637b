"""Curation: what a model's answer has to satisfy, which records go to a model, and who wrote what."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import written
from ..functions.derive import evidence_tier, first_match, organizations_of
from ..functions.text import norm_doi, norm_title, norm_url, record_text, repo_of
from .linkage import two_key_lookup
from .worklists import claims_backfill, slug_stem, slugs

# == answers


@dataclass(frozen=True)
class AnswerRules:
    """Fields that an answer must have, and the closed vocabularies of its facets."""

    required: tuple[str, ...]
    facets: Mapping[str, frozenset[str]]
    integration: frozenset[str]
    sectors: frozenset[str]
    component: str = "component"
    #: A record of none of the corpus; these and the next need no use case.
    collision: str = "name_collision"
    without_use: tuple[str, ...] = ("name_collision", "citation_only", "unclear")
    importance: tuple[int, int] = (0, 5)
    summary: tuple[int, int] = (40, 1400)
    confidence: tuple[str, ...] = ("high", "medium", "low")


def _isin(c: Column, values) -> Column:
    return F.coalesce(c.isin(*sorted(values)), F.lit(False))


def answer_problems(answer: Column, rules: AnswerRules) -> Column:
    """What is wrong with a model's answer, in a fixed order; an empty list if nothing.

    The answer is a JSON object, in a fence or between other words.  Where
    required fields are missing, only that is told.
    """
    return _problems(F.try_parse_json(record_text(answer)), rules)


def judged(df: DataFrame, answer: str, rules: AnswerRules) -> DataFrame:
    """df with the problems of its answers, each parsed once."""
    return df.withColumn("_v", F.try_parse_json(record_text(F.col(answer)))).withColumn("problems", _problems(F.col("_v"), rules)).drop("_v")


def _problems(v: Column, rules: AnswerRules) -> Column:
    field = lambda f: F.try_variant_get(v, f"$.{f}", "variant")
    kind = lambda f: F.coalesce(F.schema_of_variant(field(f)), F.lit("VOID"))
    text = lambda f: F.try_variant_get(v, f"$.{f}", "string")
    listed = lambda f: kind(f).startswith("ARRAY")
    nothing = F.array().cast("array<string>")
    values = lambda f: F.when(listed(f), F.coalesce(F.try_variant_get(v, f"$.{f}", "array<string>"), nothing)).otherwise(nothing)
    one = lambda when, told: F.when(when, F.array(told)).otherwise(nothing)
    say = lambda *parts: F.concat(*[F.coalesce(p, F.lit("nothing")) if isinstance(p, Column) else F.lit(p) for p in parts])

    unknown = lambda c, known, what: F.transform(F.filter(c, lambda x: ~_isin(x, known)), lambda x: say(what, x, " is not in the vocabulary"))

    missing = F.array_compact(F.array(*[F.when(field(f).isNull(), F.lit(f"missing {f}")) for f in rules.required]))
    found = []
    for f, vocabulary in rules.facets.items():
        found.append(F.when(listed(f), unknown(values(f), vocabulary, f"{f}: ")).otherwise(F.array(F.lit(f"{f} is not a list"))))
    integration, confidence, importance, summary = text("integration"), text("confidence"), text("importance"), F.coalesce(text("summary"), F.lit(""))
    none = lambda f: F.when(listed(f), F.size(values(f)) == 0).otherwise(F.coalesce(text(f), F.lit("")).isin("", "0", "false"))
    found.append(one(~_isin(integration, rules.without_use) & none("use_case"), F.lit("use_case is empty")))
    found.append(one(~_isin(integration, [rules.collision]) & none("industry"), F.lit("industry is empty")))
    found.append(one(~_isin(integration, rules.integration), say("integration: ", integration, " is not in the vocabulary")))
    found.append(one(~_isin(integration, [rules.collision]) & none(rules.component), F.lit(f"{rules.component} is empty")))
    whole = kind("importance").isin("BIGINT") & F.coalesce(importance.try_cast("int").between(*rules.importance), F.lit(False))
    found.append(one(~whole, say("importance ", importance, f" is not an integer {rules.importance[0]}-{rules.importance[1]}")))
    found.append(one(~_isin(confidence, rules.confidence), say("confidence ", confidence, f" is not {'/'.join(rules.confidence)}")))
    found.append(one(_isin(integration, ["unclear"]) & _isin(confidence, ["high"]), F.lit("unclear with high confidence")))
    length = F.length(summary)
    ended = F.rtrim(summary).rlike(r"[.!?]$")
    found.append(F.when(~length.between(*rules.summary), F.array(say("summary of ", length.cast("string"), " characters"))).otherwise(one(~ended, F.lit("summary does not end in a sentence"))))
    found.append(one(F.trim(F.coalesce(text("evidence"), F.lit(""))) == "", F.lit("evidence is empty")))
    authors, affiliations = values("authors"), values("affiliations")
    blank = F.exists(authors, lambda a: F.coalesce(F.trim(a), F.lit("")) == "")
    counted = say(F.size(authors).cast("string"), " authors, ", F.size(affiliations).cast("string"), " affiliations")
    found.append(
        F.when(~(listed("authors") & listed("affiliations")), F.array(F.lit("authors and affiliations are not both lists")))
        .when(F.size(authors) != F.size(affiliations), F.array(counted)).otherwise(one(blank, F.lit("an author is empty")))
    )
    found.append(unknown(values("affiliation_types"), rules.sectors, "affiliation_type "))
    named = F.size(organizations_of(affiliations))
    for f in ("affiliation_types", "affiliation_countries"):
        found.append(one(F.size(values(f)) > named, say(f"{f} has ", F.size(values(f)).cast("string"), " values, affiliations name ", named.cast("string"))))
    return F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.array(F.lit("no JSON object"))).when(F.size(missing) > 0, missing).otherwise(F.concat(*found))


def finalized(answer: Column, rules: AnswerRules, **own: Column) -> Column:
    """The record that an accepted answer becomes, as JSON: its own fields, then those that the pipeline owns."""
    v = F.try_parse_json(record_text(answer))
    asked = [F.struct(F.lit(f).alias("key"), F.to_json(F.try_variant_get(v, f"$.{f}", "variant")).alias("value")) for f in dict.fromkeys((*rules.required, "needs"))]
    given = [F.struct(F.lit(k).alias("key"), F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}).alias("value")) for k, c in own.items()]
    bare = lambda x: F.regexp_extract(x["value"], r'(?s)^\{"x":(.*)\}$', 1)
    parts = F.concat(F.transform(F.array(*given), lambda x: F.concat(F.lit('"'), x["key"], F.lit('":'), bare(x))), F.transform(F.filter(F.array(*asked), lambda x: x["value"].isNotNull()), lambda x: F.concat(F.lit('"'), x["key"], F.lit('":'), x["value"])))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def recovered(review: DataFrame, key: str, answer: str, done: DataFrame, done_key: str, rules: AnswerRules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(promoted, remaining, reasons): stored answers judged again by the rules as they are now.

    Rows whose key is done by now are spent and in neither; reasons counts the
    first 60 characters of what is still wrong.
    """
    left = review.join(done.select(F.col(done_key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti")
    told = written(judged(left, answer, rules), "judged")  # once, for three uses
    remaining = told.where(F.size("problems") > 0)
    reasons = remaining.select(F.explode("problems").alias("p")).groupBy(F.left("p", F.lit(60)).alias("reason")).agg(F.count("*").alias("n"))
    return told.where(F.size("problems") == 0).drop("problems"), remaining, reasons


# == candidates


def repo_candidates(evidence: DataFrame, pool: DataFrame, indexed: DataFrame, blocked: DataFrame, done: DataFrame, taken: DataFrame, metrics: list[str]) -> DataFrame:
    """Repositories to judge: scanned well, neither indexed nor blocked nor done, with their metrics and an id.

    evidence: repo and status; indexed, blocked, done: repo; taken: id.  Ids are
    repo-<name>, else repo-<owner>-<name>, else numbered, by repository.
    """
    low = lambda df: df.select(F.lower("repo").alias("_k")).distinct()
    left = evidence.where("status = 'ok'").join(low(indexed.unionByName(blocked)), F.lower("repo") == F.col("_k"), "left_anti")
    left = left.join(done.select(F.col("repo").alias("_d")).distinct(), F.col("repo") == F.col("_d"), "left_anti")
    side = pool.groupBy(F.col("repo").alias("_p")).agg(*[F.max(m).alias(m) for m in metrics])
    left = left.join(side, F.col("repo") == F.col("_p"), "left").drop("_p")
    word = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))
    owner, name = word(F.split_part("repo", F.lit("/"), F.lit(1))), F.coalesce(F.nullif(word(F.split_part("repo", F.lit("/"), F.lit(2))), F.lit("")), F.lit("repo"))
    stems = left.withColumns({"_stem": F.concat(F.lit("repo-"), name), "_other": F.concat_ws("-", F.lit("repo"), owner, name), "_year": F.lit("")})
    return slugs(stems, "_stem", "_year", ["repo"], taken, "id", name="id", alternative="_other").drop("_stem", "_other", "_year")


def work_candidates(works: DataFrame, curated: DataFrame, done: DataFrame, taken: DataFrame, contexts: DataFrame) -> DataFrame:
    """Works without a DOI to judge, each once, most cited first: key, url, tier, cites and id.

    works: seq, id, doi, title, url, abstract, cited and year; curated: url;
    done: key; taken: id; contexts: title and sentence.  A work is curated if
    its URL or its id is.
    """
    first = works.groupBy("id").agg(F.min_by(F.struct(*[c for c in works.columns if c != "id"]), "seq").alias("_r")).select("id", "_r.*")
    left = first.where(~F.coalesce(norm_doi(F.col("doi")), F.lit("")).startswith("10.")).withColumn("url", F.coalesce("url", "id")).where("url <> ''")
    known = curated.select(norm_url(F.col("url")).alias("_u")).where("_u is not null").distinct()
    for c in ("url", "id"):
        left = left.join(known, norm_url(F.col(c)) == F.col("_u"), "left_anti")
    left = left.withColumn("key", F.coalesce(F.nullif(norm_url(F.col("url")), F.lit("")), F.col("id"))).join(done.select("key").distinct(), "key", "left_anti")
    said = contexts.select(norm_title(F.col("title")).alias("_t"), "sentence").where("_t <> ''").groupBy("_t").agg(F.array_sort(F.collect_list("sentence")).alias("cites"))
    left = left.join(said, norm_title(F.col("title")) == F.col("_t"), "left").drop("_t")
    tier = evidence_tier(F.lit(None).cast("string"), F.col("abstract"), F.col("cites"))
    stems = left.withColumns({"tier": tier, "_stem": slug_stem(F.col("title"), F.lit("paper")), "_year": F.coalesce(F.col("year").cast("string"), F.lit("")), "_rank": -F.coalesce("cited", F.lit(0))})
    return slugs(stems, "_stem", "_year", ["_rank", "seq"], taken, "id", name="entry_id").drop("_stem", "_year", "_rank")


def rejudged(records: DataFrame, texts: DataFrame, done: DataFrame, tail: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, skipped): curated papers whose full text has come since; the others by the first reason that holds.

    records: id, doi and evidence_tier; texts: doi and text; done, tail: doi.
    """
    d = lambda df, *more: df.select(norm_doi(F.col("doi")).alias("_d"), *more)
    out = records.withColumn("_d", F.coalesce(norm_doi(F.col("doi")), F.lit("")))
    out = out.join(d(texts, "text").where("text <> ''").groupBy("_d").agg(F.max("text").alias("text")), "_d", "left")
    out = out.join(d(done).distinct().withColumn("_done", F.lit(True)), "_d", "left").join(d(tail).distinct().withColumn("_tail", F.lit(True)), "_d", "left")
    reason = (
        F.when(~F.col("_d").startswith("10."), "no doi").when(F.col("evidence_tier") == "full_text", "already full_text").when(F.col("text").isNull(), "no text on disk")
        .when(F.col("_done"), "already re-judged").when(F.col("_tail").isNull(), "not in the tail")
    )
    out = out.withColumn("reason", reason)
    return out.where("reason is null").drop("reason", "_d", "_done", "_tail"), out.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def component_backfill(records: DataFrame, hits: DataFrame, imports: Mapping[str, str], components: str) -> DataFrame:
    """Override rows for records whose own code imports what they don't claim.

    records: id, repo and the claimed components; hits: repo, vendored (the
    directories of copied packages), file and text, a line of code.  Lines in
    such directories or in the package's own tree, and comments, don't count.
    """
    line, file = F.col("text"), F.lower(F.col("file"))
    live = hits.where(~F.trim(line).rlike(r"^(#|//|\"\"\"|''')") & ~F.exists("vendored", lambda v: F.concat(F.lit("/"), file).contains(F.concat(F.lit("/"), F.lower(F.rtrim(v, F.lit("/"))), F.lit("/")))))
    found = live.select("repo", file.alias("file"), F.explode(F.array_compact(F.array(*[F.when(line.rlike(p), F.lit(n)) for n, p in imports.items()]))).alias("package"))
    found = found.where(~F.concat(F.lit("/"), "file").contains(F.concat(F.lit("/"), "package", F.lit("/")))).join(records.select("id", "repo"), "repo").select("id", F.col("package").alias(components))
    return claims_backfill(records.select("id", components), found, "id", components)


# == authors


def repositories(pool: DataFrame, index: DataFrame) -> DataFrame:
    """(repo_key, repo, ids, raw, roles): the authors of pool and index repositories, each once, with all their roles.

    pool: seq, repo, owner and top_contributors; index: id and url.  A
    repository without authors in the pool has its owner.
    """
    named = pool.where("repo like '%/%'").select(F.lower("repo").alias("repo_key"), "seq", F.trim("repo").alias("repo"), "owner", "top_contributors")
    owner = F.struct(F.lit(0).alias("o"), F.coalesce(F.nullif("owner", F.lit("")), F.split_part("repo", F.lit("/"), F.lit(1))).alias("raw"), F.lit("owner").alias("role"))
    others = F.transform(F.coalesce("top_contributors", F.array().cast("array<string>")), lambda x, i: F.struct((i + 1).alias("o"), x.alias("raw"), F.lit("top_contributor").alias("role")))
    people = named.select("repo_key", "seq", F.explode(F.concat(F.array(owner), others)).alias("a")).select("repo_key", "seq", "a.*").where("raw <> ''")
    ids = index.select(repo_of(F.col("url")).alias("r"), "id").where("r is not null").groupBy(F.lower("r").alias("repo_key")).agg(F.array_sort(F.collect_set("id")).alias("ids"), F.min("r").alias("index_repo"))
    names = named.groupBy("repo_key").agg(F.min_by("repo", "seq").alias("repo")).join(ids, "repo_key", "full_outer").select("repo_key", F.coalesce("repo", "index_repo").alias("repo"), F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    each = people.groupBy("repo_key", F.lower("raw").alias("raw_key")).agg(F.min_by("raw", F.struct("seq", "o")).alias("raw"), F.array_sort(F.collect_set("role")).alias("roles"))
    out = names.join(each, "repo_key", "left")
    return out.select("repo_key", "repo", "ids", F.coalesce("raw", F.split_part("repo", F.lit("/"), F.lit(1))).alias("raw"), F.coalesce("roles", F.array(F.lit("owner"))).alias("roles"))


LOGIN = r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,38})$"


def repo_authors(repos: DataFrame, meta: DataFrame, identities: DataFrame, mapping: DataFrame) -> DataFrame:
    """A row for each repository and author: how the identity is known, contributions, public name and affiliation.

    repos: as repositories() gives them; meta: repo_key, owner_login and
    contributors (login, anonymous, contributions); identities: raw_key,
    login, public_name and affiliation; mapping: raw affiliation and name.
    By trust: the owner, a linked contributor, an anonymous commit, a name
    that is no login, and what remains unverified.
    """
    who = identities.select(F.lower("raw_key").alias("_key"), F.struct("login", "public_name", "affiliation").alias("p"))
    by_login = identities.where("login is not null").groupBy(F.lower("login").alias("_login")).agg(F.min(F.struct("login", "public_name", "affiliation")).alias("q"))
    x = repos.join(meta, "repo_key", "left").withColumn("_raw", F.lower("raw")).join(who, F.col("_raw") == F.col("_key"), "left")
    mine = lambda c: F.coalesce((F.lower(c) == F.col("_raw")) | (F.lower(c) == F.lower("p.login")), F.lower(c) == F.col("_raw"), F.lit(False))
    owner = F.array_contains("roles", "owner") | mine(F.col("owner_login"))
    hit = F.get(F.filter("contributors", lambda c: mine(c["login"]) | F.coalesce(F.lower(c["anonymous"]) == F.col("_raw"), F.lit(False))), F.lit(0))
    x = x.withColumns({"_owner": owner, "_hit": hit})
    linked = F.col("_hit").isNotNull() & mine(F.col("_hit.login"))
    source = (
        F.when(F.col("_owner"), "repository_owner").when(linked, "linked_contributor").when(F.col("_hit").isNotNull(), "anonymous_commit")
        .when(~F.col("raw").rlike(LOGIN), "unlinked_name").otherwise("unverified_contributor_string")
    )
    x = x.withColumn("identity_source", source).join(by_login, F.lower("_hit.login") == F.col("_login"), "left")
    known = F.col("identity_source").isin("repository_owner", "linked_contributor")
    profile = F.when(F.col("identity_source") == "repository_owner", F.col("p")).when(F.col("identity_source") == "linked_contributor", F.coalesce("p", "q"))
    x = x.withColumns({"_profile": profile, "verified": known, "contributions": F.when(F.col("identity_source").isin("linked_contributor", "anonymous_commit"), F.col("_hit.contributions"))})
    flat = x.select("repo", "ids", "raw", "roles", "identity_source", "verified", "contributions", F.col("_profile.login").alias("login"), F.col("_profile.public_name").alias("public_name"), F.col("_profile.affiliation").alias("affiliation_raw"))
    return two_key_lookup(flat, mapping.select(F.col("raw").alias("affiliation_raw"), F.col("name").alias("affiliation")), "affiliation_raw", "affiliation")


SCHOLARLY = ("paper", "preprint", "thesis")


def publication_authors(records: DataFrame, works: DataFrame, repo_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each publication, author and affiliation, from where such a publication is best known.

    records: id, kind and url; works: id, status and authorships (name,
    institutions); repo_rows: id, name and affiliation; pages: id, authors and
    publisher.  Scholarly kinds go by their work, by their repository where
    there is no good one; repositories by their authors; the rest, and
    repositories without any, by their page.  A publication without authors
    has one unattributed row.
    """
    repo = repo_rows.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("name", "affiliation"))).alias("rows"))
    x = records.join(works.where("status = 'ok'").select("id", F.col("authorships")), "id", "left").join(repo, "id", "left").join(pages.select("id", "authors", "publisher"), "id", "left")
    scholarly = F.col("kind").isin(*SCHOLARLY)
    has_repo = F.col("rows").isNotNull()
    route = F.when(scholarly, F.when(F.col("authorships").isNull() & has_repo, "repository").otherwise("scholarly")).when(repo_of(F.col("url")).isNotNull() & has_repo, "repository").otherwise("web")
    made = "array<struct<author_position:int,author:string,affiliation_position:int,affiliation:string>>"
    empty = F.array().cast(made)
    row = lambda p, a, q, f: F.struct(p.cast("int").alias("author_position"), a.alias("author"), q.cast("int").alias("affiliation_position"), f.alias("affiliation"))
    none = F.lit(None).cast("string")
    listed = lambda a, i: F.when(F.size(a["institutions"]) > 0, F.transform(a["institutions"], lambda t, j: row(i + 1, a["name"], j + 1, t))).otherwise(F.array(row(i + 1, a["name"], F.lit(None), none)))
    by_work = F.flatten(F.transform("authorships", listed))
    by_repo = F.transform("rows", lambda r, i: row(i + 1, r["name"], F.when(r["affiliation"].isNotNull(), 1), r["affiliation"]))
    by_page = F.transform("authors", lambda a, i: row(i + 1, a, F.when(F.col("publisher").isNotNull(), 1), F.col("publisher")))
    found = F.when(F.col("route") == "scholarly", by_work).when(F.col("route") == "repository", by_repo).otherwise(by_page)
    x = x.withColumn("route", route).withColumn("found", F.coalesce(found.cast(made), empty))
    x = x.withColumn("found", F.when(F.size("found") == 0, F.array(row(F.lit(None), none, F.lit(None), none)).cast(made)).otherwise(F.col("found")))
    return x.select("id", "kind", "route", F.explode("found").alias("r")).select("id", "kind", "route", "r.*", F.when(F.col("r.author").isNull(), "unattributed").otherwise("attributed").alias("status"))


# == projections


def package_name(pyproject: Column, setup_cfg: Column, setup_py: Column) -> Column:
    """The name that the first packaging file with one gives; '' without."""
    return F.coalesce(
        first_match([pyproject], r"""(?m)^\s*name\s*=\s*["']([A-Za-z0-9._-]+)["']"""), first_match([setup_cfg], r"(?m)^\s*name\s*=\s*([A-Za-z0-9._-]+)"),
        first_match([setup_py], r"""name\s*=\s*["']([A-Za-z0-9._-]+)["']"""), F.lit(""),
    )


def repo_metrics(node: Column, asked: Column) -> Column:
    """A fetched repository node as a flat row; one of status 'gone' where there is no node.

    node: struct with name, owner, stars, forks, commits, releases
    (array<array<int>>, the downloads of each release's files), topics,
    description and created.
    """
    n = lambda c: F.coalesce(c.cast("bigint"), F.lit(0))
    downloads = F.aggregate(F.flatten(F.coalesce(node["releases"], F.array().cast("array<array<int>>"))), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    t = lambda c: F.coalesce(F.trim(c), F.lit(""))
    here = F.struct(
        node["name"].alias("repo"), t(node["owner"]).alias("owner"), n(node["stars"]).alias("stars"), n(node["forks"]).alias("forks"), n(node["commits"]).alias("commits"), downloads.alias("release_downloads"),
        F.coalesce(node["topics"], F.array().cast("array<string>")).alias("topics"), t(node["description"]).alias("description"), F.substring(t(node["created"]), 1, 10).alias("created"), F.lit("ok").alias("status"),
    )
    gone = F.struct(asked.alias("repo"), *[F.lit(None).cast(k).alias(c) for c, k in (("owner", "string"), ("stars", "bigint"), ("forks", "bigint"), ("commits", "bigint"), ("release_downloads", "bigint"), ("topics", "array<string>"), ("description", "string"), ("created", "string"))], F.lit("gone").alias("status"))
    return F.when(node.isNull(), gone).otherwise(here)


def lifted_work(work: Column, most: int = 12) -> Column:
    """A nested work as a flat record: title, year, venue, links, its first authors and the sorted distinct institutions and countries.

    work: struct with title, display_name, year, location and best (source,
    landing, pdf), and authorships (name, institutions of name and country).
    """
    authors = F.coalesce(work["authorships"], F.array().cast("array<struct<name:string,institutions:array<struct<name:string,country:string>>>>"))
    places = F.flatten(F.transform(authors, lambda a: F.coalesce(a["institutions"], F.array().cast("array<struct<name:string,country:string>>"))))
    distinct = lambda f: F.array_sort(F.array_distinct(F.filter(F.transform(places, lambda p: p[f]), lambda x: x != "")))
    return F.struct(
        F.coalesce(work["display_name"], work["title"]).alias("title"), work["year"].alias("year"), F.coalesce(work["location"]["source"], work["best"]["source"]).alias("venue"),
        F.coalesce(work["location"]["landing"], work["best"]["landing"]).alias("landing"), F.coalesce(work["location"]["pdf"], work["best"]["pdf"]).alias("pdf"),
        F.slice(F.transform(authors, lambda a: a["name"]), 1, most).alias("authors"), F.size(authors).alias("n_authors"), distinct("name").alias("institutions"), distinct("country").alias("countries"),
    )


def registry_match(items: Column) -> Column:
    """The chosen one of a registry's answers: status, name, id, country and types; status 'unmatched' without one.

    items: array of struct(chosen, matching_type, organization(name, id, country, types)).
    """
    got = F.get(F.filter(items, lambda x: F.coalesce(x["chosen"], F.lit(False))), F.lit(0))
    o = got["organization"]
    return F.struct(F.when(got.isNull(), "unmatched").otherwise("matched").alias("status"), *[o[f].alias(f) for f in ("name", "id", "country", "types")], got["matching_type"].alias("matching_type"))


PLACEHOLDERS = ("n/a", "na", "none", "unknown", "independent", "null", "-", "")


def cleaned_affiliations(affiliations: Column, types: Column, countries: Column, aliases: Mapping[str, str], placeholders: tuple[str, ...] = PLACEHOLDERS) -> Column:
    """struct(affiliations, types, countries, changed): placeholders out, aliases in, facts aligned again by name.

    An author's entry of which nothing is left becomes null, so entries and
    authors stay aligned.  types and countries belong to the distinct
    organisations in order; where they fit, each surviving organisation keeps
    its own, an alias takes over that of the name it replaces, and others are
    'unknown'.  Lists that don't fit stay as they are.
    """
    before = organizations_of(affiliations)
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else F.create_map().cast("map<string,string>")
    alias = lambda o: F.coalesce(F.element_at(table, o), o)
    parts = lambda a: F.filter(F.transform(F.split(a, ";"), lambda o: F.trim(o)), lambda o: o != "")
    dropped = lambda o: F.trim(F.lower(o), F.lit(".")).isin(*placeholders)
    kept = lambda a: F.array_distinct(F.transform(F.filter(parts(a), lambda o: ~dropped(o)), alias))
    out = F.transform(affiliations, lambda a: F.when(F.coalesce(a, F.lit("")) == "", a).otherwise(F.when(F.size(kept(a)) > 0, F.array_join(kept(a), "; "))))
    changed = F.exists(affiliations, lambda a: F.exists(parts(F.coalesce(a, F.lit(""))), lambda o: dropped(o) | F.map_contains_key(table, o)))
    aligned = (F.size(types) == F.size(before)) & (F.size(countries) == F.size(before))
    # The first organisation that is, or becomes, the name; one that is the name comes before those that become it.
    at = lambda o: F.coalesce(F.nullif(F.array_position(before, o), F.lit(0)), F.nullif(F.array_position(F.transform(before, alias), o), F.lit(0)))
    facts = lambda values: F.transform(organizations_of(out), lambda o: F.coalesce(F.get(values, (at(o) - 1).cast("int")), F.lit("unknown")))
    fit = changed & aligned
    return F.struct(F.when(changed, out).otherwise(affiliations).alias("affiliations"), F.when(fit, facts(types)).otherwise(types).alias("types"), F.when(fit, facts(countries)).otherwise(countries).alias("countries"), changed.alias("changed"))


def vocabulary_terms(text: Column, facet: str) -> Column:
    """The terms of '**facet** (aside): a, b, c' in a Markdown text, glosses in brackets left out; null without the list."""
    body = F.regexp_extract(F.concat(text, F.lit("\n\n")), rf"(?s)\*\*{facet}\*\*[^:]*:(.*?)\n\s*\n", 1)
    terms = F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(body, r"\([^)]*\)", " "), r"[,\s]+"), lambda t: t.rlike("^[a-z][a-z_]*$"))))
    return F.when(text.rlike(rf"\*\*{facet}\*\*[^:]*:"), terms)


def audit_reasons(checks: Mapping[str, Column]) -> Column:
    """The reasons that hold, joined by ' + '; null for none."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))
    return F.when(F.size(found) > 0, F.array_join(found, " + "))


CITABLE = ("paper", "preprint", "thesis")


def cards(records: DataFrame, facets: tuple[str, ...], label) -> DataFrame:
    """What a record's card shows: heading, badge, meta line, authors, evidence, chips of what the record itself has, and actions.

    label(facet, value) gives a value's label; facets are raw arrays, so a record with none has no chip.
    """
    have = set(records.columns)
    c = lambda x: F.col(x) if x in have else F.lit(None).cast("string")
    url = F.nullif(c("url"), F.lit(""))
    bits = F.array(F.nullif(c("venue"), F.lit("")), F.nullif(c("year").cast("string"), F.lit("0")), F.concat(F.lit("★ "), c("stars").cast("string")), F.concat(F.lit("cited by "), c("cited").cast("string")))
    chip = lambda f: F.transform(F.coalesce(f, F.array().cast("array<string>")), lambda v: F.struct(F.lit(f).alias("facet"), label(F.lit(f), v).alias("label")))
    chips = F.concat(*[chip(f) for f in facets])
    citable = c("kind").isin(*CITABLE)
    first = F.when(c("kind") == "code_repo", F.when(F.lower(url).contains("github.com"), "GitHub").otherwise("Repository")).when(citable, "PDF").otherwise("Open")
    doi = F.nullif(c("doi"), F.lit(""))
    actions = F.array(F.when(url.isNotNull(), first), F.when(doi.isNotNull(), "DOI"), F.when(citable, "BibTeX"), F.when(url.isNotNull(), "Copy link"))
    return records.select(
        "id", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("heading"), url.alias("url"), label(F.lit("kind"), c("kind")).alias("badge"), (F.coalesce(c("tier"), F.lit("")) == "tail").alias("tail"),
        F.array_join(F.array_compact(bits), " · ").alias("meta"), F.array_join(F.coalesce(c("authors").cast("array<string>") if "authors" in have else F.array().cast("array<string>"), F.array().cast("array<string>")), ", ").alias("authors"),
        F.when(c("evidence") != "", F.concat(F.lit("evidence: "), c("evidence"))).alias("evidence"), F.when(doi.isNotNull(), F.when(doi.rlike("^https?:"), doi).otherwise(F.concat(F.lit("https://doi.org/"), doi))).alias("doi_url"),
        chips.alias("chips"), F.array_compact(actions).alias("actions"),
    )
