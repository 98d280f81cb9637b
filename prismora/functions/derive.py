"""Derived columns of catalogue records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

NONE = "__none__"
ACADEMIC = ("academic", "non_academic", "unaffiliated")

_REGIONS = {
    "americas": "argentina bahamas barbados belize bolivia brazil canada chile colombia|costa rica|cuba dominica|dominican republic|ecuador|el salvador|grenada guatemala guyana haiti honduras jamaica mexico nicaragua panama paraguay peru|puerto rico|suriname|trinidad and tobago|united states|united states of america|uruguay usa venezuela",
    "europe": "albania andorra austria belarus belgium|bosnia and herzegovina|bulgaria croatia cyprus|czech republic|czechia denmark estonia finland france germany gibraltar greece hungary iceland ireland italy kosovo latvia liechtenstein lithuania luxembourg malta moldova monaco montenegro netherlands|north macedonia|norway poland portugal romania russia|russian federation|san marino|serbia slovakia slovenia spain sweden switzerland turkey türkiye uk ukraine|united kingdom|vatican city",
    "asia": "afghanistan armenia azerbaijan bahrain bangladesh bhutan brunei cambodia china georgia|hong kong|india indonesia iran iraq israel japan jordan kazakhstan kuwait kyrgyzstan laos lebanon macao macau malaysia maldives mongolia myanmar nepal|north korea|oman pakistan palestine philippines qatar|saudi arabia|singapore|south korea|korea|sri lanka|syria taiwan tajikistan thailand|timor-leste|turkmenistan|united arab emirates|uzbekistan vietnam|viet nam|yemen",
    "africa_oceania": "algeria angola australia benin botswana|burkina faso|burundi cameroon|cape verde|chad comoros congo|côte d'ivoire|djibouti egypt eritrea eswatini ethiopia fiji gabon gambia ghana guinea|ivory coast|kenya kiribati lesotho liberia libya madagascar malawi mali mauritania mauritius morocco mozambique namibia nauru|new zealand|niger nigeria palau|papua new guinea|rwanda samoa senegal seychelles|sierra leone|solomon islands|somalia|south africa|south sudan|sudan tanzania togo tonga tunisia tuvalu uganda vanuatu zambia zimbabwe",
}


def _expand(names: str) -> list[str]:
    """'|' parts names of several words; a part of lone words is one name a word."""
    known = {"bosnia", "burkina", "cape", "costa", "czech", "côte", "dominican", "el", "hong", "ivory", "new", "north", "papua", "puerto", "russian", "san", "saudi", "sierra", "solomon", "south", "sri", "trinidad", "united", "vatican", "viet"}
    out = []
    for part in names.split("|"):
        out += [part] if part.split()[0] in known and " " in part else part.split()
    return out


REGION_OF: dict[str, str] = {c: r for r, names in _REGIONS.items() for c in _expand(names)}


def _map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def is_missing(c: Column, kind: str) -> Column:
    """Null, or empty for texts, arrays and maps; a number 0 is there."""
    if kind == "string":
        return c.isNull() | (c == "")
    return c.isNull() | (F.size(c) == 0) if kind.startswith(("array", "map")) else c.isNull()


def organizations_of(affiliations: Column) -> Column:
    """Distinct organisations of an author-aligned list whose elements hold several, parted by ';', in order."""
    parts = F.flatten(F.transform(F.filter(F.coalesce(affiliations, F.array().cast("array<string>")), lambda a: a.isNotNull()), lambda a: F.split(a, ";")))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def affiliation_rows(organizations: Column, types: Column, countries: Column) -> Column:
    """array<struct(organization, sector, country)>: positions that the other lists lack are ''."""

    def sector(t: Column) -> Column:
        return F.when(t.isNull() | t.isin("", "unknown"), "").when(t == "academic", "academic").otherwise("non_academic")

    return F.transform(organizations, lambda o, i: F.struct(o.alias("organization"), sector(F.get(types, i)).alias("sector"), F.coalesce(F.get(countries, i), F.lit("")).alias("country")))


def region_of(country: Column, regions: Mapping[str, str] = REGION_OF) -> Column:
    """Region of a country's name, without case and leading 'the'; '' for one that isn't placed."""
    return F.coalesce(F.element_at(_map(regions), F.regexp_replace(F.lower(F.trim(country)), r"^the ", "")), F.lit(""))


def aff_types(sectors: Column) -> Column:
    """Sides that a record's organisations are on: unaffiliated without any; an unknown sector isn't academic."""
    academic, other = F.exists(sectors, lambda s: s == "academic"), F.exists(sectors, lambda s: s != "academic")
    a, n = F.array(F.lit("academic")), F.array(F.lit("non_academic"))
    return F.when(F.size(sectors) == 0, F.array(F.lit("unaffiliated"))).when(academic & other, F.concat(a, n)).when(academic, a).otherwise(n)


def aff_regions(regions: Column) -> Column:
    return F.array_distinct(F.filter(regions, lambda r: r != ""))


def popularity_of(kind: Column, stars: Column, forks: Column, contributors: Column, commits: Column, cited: Column) -> Column:
    """The larger of a repository's and a citation's score between 0 and 1; 0.3 without either."""
    n = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    weight = n(stars) + 2 * n(forks) + 5 * n(contributors) + 0.1 * F.least(n(commits), F.lit(2000.0))
    repo = F.when((kind == "code_repo") | stars.isNotNull(), F.least(F.lit(1.0), F.log1p(weight) / F.log1p(F.lit(8000.0))))
    cites = F.when(cited.isNotNull(), F.least(F.lit(1.0), F.log1p(cited.cast("double")) / F.log1p(F.lit(1500.0))))
    return F.coalesce(F.greatest(repo, cites), F.lit(0.3))


def bucket_of(key: Column, buckets: int = 32) -> Column:
    """Two hex digits: the first byte of the key's SHA-256 below a power of two."""
    first = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 2), 16, 10).cast("int")
    return F.lower(F.lpad(F.hex(first.bitwiseAND(F.lit(buckets - 1))), 2, "0"))


def slice_of(key: Column, slices: int = 4) -> Column:
    """A stable part A, B, ... of a worklist by the key's SHA-1 (slices a power of two up to 16)."""
    last = F.conv(F.substring(F.sha1(key.cast("string")), 40, 1), 16, 10).cast("int")
    return F.char(F.lit(65) + last % F.lit(slices))


def facet_vector(values: Column, with_none: bool = True) -> Column:
    """The values without nulls and empty ones; the sentinel for none, where the facet has one."""
    kept = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))
    return F.when(F.size(kept) == 0, F.array(F.lit(NONE))).otherwise(kept) if with_none else kept


def prettify(code: Column) -> Column:
    spaced = F.regexp_replace(F.coalesce(code, F.lit("")), "_", " ")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 2**30))


def label_for(facet: Column, value: Column, labels: Mapping[str, str] | None = None) -> Column:
    """Display label: of the table (keys 'facet:value'), else prettified."""
    pretty = F.when(value == NONE, F.when(facet == "year", "Undated").otherwise("Not specified")).otherwise(prettify(value))
    return F.coalesce(F.element_at(_map(labels), F.concat_ws(":", facet, value)), pretty) if labels else pretty


def action_label(kind: Column, url: Column) -> Column:
    repo = F.when(F.lower(F.coalesce(url, F.lit(""))).contains("github.com"), "GitHub").otherwise("Repository")
    return F.when(kind == "code_repo", repo).when(kind.isin("paper", "preprint", "thesis"), "PDF").otherwise("Open")


def bib_key(id_: Column, title: Column, year: Column) -> Column:
    stem = F.substring(F.regexp_replace(F.lower(F.coalesce(title, F.lit("untitled"))), r"[^a-z0-9]+", ""), 1, 24)
    return F.coalesce(F.nullif(id_, F.lit("")), F.concat(stem, F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit(""))))


def bibtex(id_: Column, kind: Column, title: Column, authors: Column, year: Column, venue: Column, doi: Column, url: Column) -> Column:
    """A BibTeX entry; fields without a value are left out, line breaks in values become spaces."""
    entry = F.coalesce(F.element_at(_map({"paper": "article", "preprint": "misc", "thesis": "mastersthesis"}), kind), F.lit("misc"))

    def field(name: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"  {name} = {{"), F.regexp_replace(value, r"[\n\r]+", " "), F.lit("}")))

    fields = F.array(
        field("author", F.array_join(F.coalesce(authors, F.array().cast("array<string>")), " and ")),
        field("title", F.concat(F.lit("{"), F.coalesce(title, F.lit("")), F.lit("}"))),
        field("year", F.nullif(year, F.lit(0)).cast("string")), field("note", venue), field("doi", doi), field("url", url),
    )
    return F.concat(F.lit("@"), entry, F.lit("{"), bib_key(id_, title, year), F.lit(",\n"), F.array_join(F.filter(fields, lambda x: x.isNotNull()), ",\n"), F.lit("\n}"))


def year_in(date: Column) -> Column:
    """The year that a date text begins with, null without one."""
    return F.substring(date, 1, 4).try_cast("int")


def first_match(blobs: list[Column], pattern: str) -> Column:
    """The first group of a pattern in the first blob that has it."""
    return F.coalesce(*[F.nullif(F.regexp_extract(b, pattern, 1), F.lit("")) for b in blobs])


def first_location(locations: Column, field: str, order: list[str]) -> Column:
    """A field of the first location, by order of kinds, that has it."""
    return F.coalesce(*[_of_kind(locations, field, kind) for kind in order])


def _of_kind(locations: Column, field: str, kind: str) -> Column:
    return F.get(F.filter(locations, lambda x: (x["kind"] == kind) & x[field].isNotNull()), F.lit(0))[field]


def identity_key(parts: list[tuple[str, Column]]) -> Column:
    """struct(key, status) of the first part with a value: 'status:value'; unattributed without any."""
    out = F.struct(F.lit("unattributed").alias("key"), F.lit("unattributed").alias("status"))
    for status, value in reversed(parts):
        out = F.when(value.isNotNull() & (value != ""), F.struct(F.concat_ws(":", F.lit(status), value).alias("key"), F.lit(status).alias("status"))).otherwise(out)
    return out


def organization_type(name: Column, types: Column, manual: Mapping[str, str] | None = None) -> Column:
    """Type of an organisation by an ordered cascade: hospitals, the table, registry types, then what the name says."""
    has = lambda t: F.array_contains(F.transform(types, F.lower), t)
    government, academic, corporate = (name.rlike(p) for p in (r"(?i)national|federal|ministry|government", r"(?i)universit|institut|college|school|academy", r"(?i)\b(inc|llc|ltd|corp|gmbh)\b"))
    by_name = F.when(government, "government").when(academic, "academic").when(corporate, "corporate")
    out = F.when(name.rlike(r"(?i)hospital|clinic|medical cent"), "nonprofit")
    if manual:
        out = out.when(F.element_at(_map(manual), name).isNotNull(), F.element_at(_map(manual), name))
    out = out.when(has("company"), "corporate").when(has("education"), "academic").when(has("government"), "government").when(has("nonprofit") | has("healthcare"), "nonprofit")
    out = out.when(has("facility") | has("funder"), F.coalesce(by_name, F.lit("nonprofit")))
    return out.when(has("other"), F.when(corporate, "corporate").otherwise("other")).otherwise("unknown")


def account_kind(login: Column, name: Column, account_type: Column) -> Column:
    """bot, organization, person or unknown."""
    return (
        F.when(F.lower(login).rlike(r"\[bot\]$|[-_]bot$|^dependabot"), "bot").when(F.lower(account_type) == "organization", "organization")
        .when(name.rlike(r"(?i)\b(team|lab|group|inc|llc)\b"), "organization").when(F.lower(account_type) == "user", "person").otherwise("unknown")
    )


def evidence_tier(full_text: Column, abstract: Column, contexts: Column) -> Column:
    has = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    return F.when(has(full_text), "full_text").when(has(abstract) | (F.size(F.coalesce(contexts, F.array().cast("array<string>"))) > 0), "abstract_context").otherwise("metadata_only")


def capped_confidence(confidence: Column, tier: Column) -> Column:
    """No higher than the evidence allows."""
    rank = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in (("low", 1), ("medium", 2), ("high", 3)) for x in kv]), c)
    most = F.when(tier == "full_text", 3).when(tier == "abstract_context", 2).otherwise(1)
    return F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), F.least(F.coalesce(rank(confidence), F.lit(1)), most))


def delta_encode(ids: Column) -> Column:
    """First value and gaps of a rising array."""
    return F.transform(ids, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(ids, i - 1)))


def delta_decode(gaps: Column) -> Column:
    """The rising array of first value and gaps, in one pass."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
    step = lambda a, x: F.struct((a["at"] + x).cast("bigint").alias("at"), F.concat(a["all"], F.array((a["at"] + x).cast("bigint"))).alias("all"))
    return F.aggregate(gaps, start, step, lambda a: a["all"])


def spread_types(values: Column, n: Column) -> Column:
    """One distinct value for all n organisations; none is 'unknown', several conflicting are ''. Lists that fit stay."""
    known = F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))
    fill = F.when(F.size(known) == 1, F.get(known, F.lit(0))).when(F.size(known) == 0, "unknown").otherwise("")
    return F.when(F.size(values) == n, values).otherwise(F.array_repeat(fill, n))


def canon_country(value: Column, preferred: Mapping[str, str] | None = None) -> Column:
    """The first known country of a compound value, in the preferred spelling; 'unknown' without one."""
    parts = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: (p != "") & (F.lower(p) != "unknown"))
    first = F.get(parts, F.lit(0))
    if preferred:
        first = F.coalesce(F.element_at(_map(preferred), F.lower(first)), first)
    return F.coalesce(first, F.lit("unknown"))


def lossy(kinds: Mapping[str, str]) -> list[Column]:
    """Columns with empty texts, arrays and maps as null."""
    return [F.when(~is_missing(F.col(c), k), F.col(c)).alias(c) for c, k in kinds.items()]
