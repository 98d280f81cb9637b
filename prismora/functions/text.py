"""Text functions over columns.

Whatever Catalyst can say is a plain expression; Unicode decomposition, HTML
entities, difference ratios and stateful scans are Arrow-batched UDFs.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from difflib import SequenceMatcher
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf



def _row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, t) for k, t in fields.items()])


# == URLs


def norm_url(url: Column) -> Column:
    """Lower case without scheme, leading www. and trailing slashes: the key of enrichment."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), r"^\s*https?://(www\.)?|^www\.", ""), r"/+$", "")


def url_key(url: Column) -> Column:
    """As norm_url, but www. stays: the key of the pools' residue."""
    return F.regexp_replace(F.regexp_replace(F.lower(url), r"^https?://", ""), r"/+$", "")


def dedupe_key(url: Column) -> Column:
    """The URL without trailing slashes, case kept: the key of assembly."""
    return F.regexp_replace(url, r"/+$", "")


def norm_title(title: Column) -> Column:
    """Lower case, everything but a-z and 0-9 to single spaces."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9]+", " "))


def norm_doi(doi: Column) -> Column:
    """Lower case without resolver, doi: prefix and trailing dots and slashes."""
    bare = F.regexp_replace(F.lower(F.trim(doi)), r"^(https?://)?(dx\.)?doi\.org/|^doi:\s*", "")
    return F.regexp_replace(bare, r"[./]+$", "")


def doi_in(url: Column) -> Column:
    """The DOI inside a URL, without the view that publishers append; null without one."""
    found = F.lower(F.regexp_replace(F.regexp_extract(url, r"\b10[.][0-9]{4,9}/[^#&?\s]+", 0), r"\.+$", ""))
    return F.nullif(F.regexp_replace(found, r"[./](epdf|pdf|abs|abstract|full-text|full|html|long|meta|short)$", ""), F.lit(""))


def arxiv_in(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"arxiv\.org/(?:pdf|abs)/(\d{4}\.\d{4,5})", 1), F.lit(""))


def url_lane(url: Column) -> Column:
    """How a URL's work can be looked up."""
    u = F.coalesce(url, F.lit(""))
    return F.when(u.rlike(r"arxiv\.org/(pdf|abs)/"), "arxiv").when(u.rlike(r"\b10[.][0-9]{4,9}/"), "doi_in_url").otherwise("title_only")


def repo_of(url: Column) -> Column:
    """owner/name of a GitHub URL, null for others."""
    m = F.regexp_replace(F.regexp_extract(url, r"^(?i:https?://(?:www[.])?github[.]com)/([^\s#?/]+/[^\s#?/]+)", 1), "[.]git$", "")
    return F.nullif(m, F.lit(""))


# == folding and tokens


def fold_text(value: str | None) -> str | None:
    """Compatibility decomposition without combining marks, lower case."""
    if value is None:
        return None
    if value.isascii():
        return value.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).lower()


#: Texts of a batch that are Python objects at one time.
_SLICE = 256


@arrow_udf(T.StringType())
def _fold(texts: pa.Array) -> pa.Array:
    parts = [pa.array(map(fold_text, texts.slice(k, _SLICE).to_pylist()), pa.string()) for k in range(0, len(texts), _SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def fold(text: Column) -> Column:
    """fold_text; texts of ASCII are lower-cased in the JVM, and only others go to Python."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(_fold(F.when(~plain, text)))


def tokenize(folded: Column) -> Column:
    """Runs of letters and digits of a folded text; '_' parts them."""
    return F.filter(F.split(F.coalesce(folded, F.lit("")), r"[^\p{L}\p{N}]+"), lambda x: x != "")


_LOW_PLAIN = dict(zip("øłđðþßæœ", ("o", "l", "d", "d", "th", "ss", "ae", "oe")))
_PLAIN = str.maketrans(_LOW_PLAIN | {k.upper(): v.title() for k, v in _LOW_PLAIN.items() if len(k.upper()) == 1})


def comparison_key_of(value: str | None, transliterate: bool = True) -> str | None:
    """Case-folded words without marks and punctuation; equal for spellings of one name."""
    if not value:
        return None
    bare = unicodedata.normalize("NFKD", value.translate(_PLAIN) if transliterate else value)
    bare = "".join(c for c in bare if not unicodedata.combining(c)).casefold()
    return " ".join(re.findall(r"\w+", bare))


@pandas_udf(T.StringType())
def comparison_key(s: pd.Series) -> pd.Series:
    return s.map(comparison_key_of, na_action="ignore")


_DASHES = "‐‑‒–—―−"


def canonical_text(text: Column) -> Column:
    """Dashes to '-', zero-width spaces out, white space to single spaces, composed form."""
    plain = F.translate(F.translate(text, _DASHES, "-" * len(_DASHES)), "​﻿", "")
    return _nfc(squeeze(plain))


@pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: v if v.isascii() else unicodedata.normalize("NFC", v), na_action="ignore")


def squeeze(text: Column) -> Column:
    """White space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_scraped_title(title: Column) -> Column:
    """A result title without its format mark and inline unicode commands."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?i)^\s*\[(pdf|html|book|b|citation)\]\s*", "")
    return F.trim(F.regexp_replace(bare, r"[$]\\unicode *[{][^{}]*[}] *[$]", " "))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")


# == scans


def split_bibliography(text: Column) -> Column:
    """struct(body, bibliography): cut at the last heading of references in the later 55 % of the text.

    Only texts with such a word go to Python, and only the place comes back.
    """
    cut = F.coalesce(_bibliography_at(F.when(text.rlike(_HINT), text)), F.length(text))
    return F.struct(F.substring(text, F.lit(1), cut).alias("body"), F.substring(text, cut + 1, F.length(text)).alias("bibliography"))


#: In every heading, in letters that have no other case beyond ASCII.
_HINT = "(?i)ograph|referen|wor.s c.ted|terature"
_GAP = "[\\t ]*"
_HEADING = re.compile(f"^{_GAP}(?:[0-9]+[).]?{_GAP})?(?:bibliography|references?|works cited|literature cited){_GAP}:?{_GAP}$", re.I | re.M)


@pandas_udf(T.IntegerType())
def _bibliography_at(s: pd.Series) -> pd.Series:
    def last(v: str) -> int | None:
        late = [m.start() for m in _HEADING.finditer(v) if m.start() > 0.45 * len(v)]
        return late[-1] if late else None

    return pd.Series([None if v is None else last(v) for v in s], dtype="Int32")


def even_sample(items: list, k: int) -> list:
    """k items spread evenly; all where there are no more."""
    n = len(items)
    if k <= 0:
        return []
    return items if n <= k else [items[min(n - 1, i * n // k)] for i in range(k)]


def windows(text: Column, pattern: str, limit: int, width: int = 600) -> Column:
    """Passages of `width` characters around matches, a third before; matches inside a taken window add none; evenly sampled to `limit`."""
    find = re.compile(pattern)

    @pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        out = []
        for v in s:
            if v is None:
                out.append(None)
                continue
            spans, end = [], -1
            for m in find.finditer(v):
                if m.start() >= end:
                    start = max(0, m.start() - width // 3)
                    end = start + width
                    spans.append(v[start:end].replace("\n", " "))
            out.append(even_sample(spans, limit))
        return pd.Series(out)

    return run(text)


def even_sample_of(items: Column, k: int) -> Column:
    """even_sample over an array column."""
    n = F.size(items)
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(items, F.least(n - 1, F.floor(i * n / F.lit(k)).cast("int"))))
    return F.when(n <= k, items).otherwise(at)


def pattern_hits(text: Column, patterns: dict[str, str], most: int = 12, around: int = 4) -> Column:
    """array<struct(code, line, text, context)>: the first `most` lines of each pattern with the lines around them."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))

    def one(code: str, pattern: str) -> Column:
        hits = F.slice(F.filter(numbered, lambda x: x["text"].rlike(pattern)), 1, most)
        return F.transform(
            hits,
            lambda x: F.struct(
                F.lit(code).alias("code"), x["line"].alias("line"), x["text"].alias("text"),
                F.slice(lines, F.greatest(x["line"] - around, F.lit(1)), F.least(x["line"], F.lit(around + 1)) + around).alias("context"),
            ),
        )

    return F.concat(*[one(c, p) for c, p in patterns.items()])


def record_text(answer: Column) -> Column:
    """The JSON object in an answer: fences off, from the first '{' to the last '}'; null without one."""
    bare = F.regexp_replace(F.trim(answer), r"^```[a-zA-Z]*\s*|\s*```$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))


def objects_of(value: str) -> list[str]:
    """Top-level JSON objects in a text; braces in strings don't count."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    for i, c in enumerate(value):
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"' and depth:
            quoted = True
        elif c == "{":
            if not depth:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(value[start : i + 1])
    return out


_BARE = re.compile(r'([:\[,]\s*)([A-Za-z_][\w-]*)(?=\s*[,}\]])')


def mended(value: str) -> str | None:
    """The object as JSON, bare words quoted where it only fails for these; null if it still fails."""
    quote = lambda m: m[0] if m[2] in {"null", "true", "false"} else m[1] + json.dumps(m[2])
    for v in (value, _BARE.sub(quote, value)):
        try:
            return json.dumps(json.loads(v), ensure_ascii=False)
        except ValueError:
            continue
    return None


@pandas_udf(T.ArrayType(T.StringType()))
def json_objects(s: pd.Series) -> pd.Series:
    """The readable objects of a text, as JSON."""
    return s.map(lambda v: [m for o in objects_of(v) if (m := mended(o)) is not None], na_action="ignore")


def meta_content(page: Column, name: str) -> Column:
    """The content of the first <meta> with that name or property, entities resolved."""
    n = re.escape(name)
    one = F.regexp_extract(page, rf"""(?is)<meta\s[^>]*(?:name|property)\s*=\s*["']{n}["'][^>]*\scontent\s*=\s*["']([^"']*)["']""", 1)
    two = F.regexp_extract(page, rf"""(?is)<meta\s[^>]*\bcontent\s*=\s*["']([^"']*)["'][^>]*(?:name|property)\s*=\s*["']{n}["']""", 1)
    return unescape(F.coalesce(F.nullif(one, F.lit("")), F.nullif(two, F.lit(""))))


@pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


@pandas_udf(T.StringType())
def absolute_url(base: pd.Series, link: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else urljoin(a, b) for a, b in zip(base, link)])


def _nodes(value) -> list[dict]:
    """Nodes of parsed JSON-LD, @graph opened, in order."""
    if isinstance(value, list):
        return [n for v in value for n in _nodes(v)]
    if isinstance(value, dict):
        return [value, *_nodes(value.get("@graph", []))]
    return []


def person_names(value) -> list[str]:
    """Names in an author value: a text, an object or a list of these."""
    if isinstance(value, str):
        return [value.strip()] if value.strip() else []
    if isinstance(value, dict):
        return person_names(value.get("name") or "")
    if isinstance(value, list):
        return [n for v in value for n in person_names(v)]
    return []


_LD_BLOCK = re.compile("<script[^<>]*application/ld[+]json[^<>]*>(.*?)</script", re.S | re.I)
_ARTICLES = {"article", "scholarlyarticle", "newsarticle", "blogposting", "report", "techarticle", "thesis"}


@pandas_udf(_row(type=T.StringType(), title=T.StringType(), authors=T.ArrayType(T.StringType())))
def json_ld_article(page: pd.Series) -> pd.DataFrame:
    """The first article with an author in a page's JSON-LD."""
    out = []
    for v in page:
        row = (None, None, None)
        for block in _LD_BLOCK.findall(v or ""):
            try:
                nodes = _nodes(json.loads(block))
            except ValueError:
                continue
            for n in nodes:
                kinds = n.get("@type", [])
                kinds = [kinds] if isinstance(kinds, str) else kinds
                people = person_names(n.get("author"))
                if people and any(str(k).lower() in _ARTICLES for k in kinds):
                    row = (str(kinds[0]), n.get("headline") or n.get("name"), people)
                    break
            if row[0]:
                break
        out.append(row)
    return pd.DataFrame(out, columns=["type", "title", "authors"])


# == similarity


@pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts (0 for a null)."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else 0.0 for x, y in zip(a, b)])


def word_jaccard(a: Column, b: Column) -> Column:
    """Shared among all distinct words of two normalised titles; 0 for two empty ones."""
    x, y = (F.filter(F.array_distinct(F.split(c, " ")), lambda w: w != "") for c in (a, b))
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def word_overlap(a: Column, b: Column) -> Column:
    """Shared words over those of the shorter."""
    x, y = (F.filter(F.array_distinct(F.split(c, " ")), lambda w: w != "") for c in (a, b))
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.least(F.size(x), F.size(y)), F.lit(0)), F.lit(0.0))


def title_match(candidate: Column, target: Column) -> Column:
    """How a candidate title matches: exact, prefix (six words at least), fuzzy (Jaccard of 0.75) or null."""
    c, t = norm_title(candidate), norm_title(target)
    words = lambda x: F.size(F.split(x, " "))
    longer = (words(t) >= 6) & c.startswith(F.concat(t, F.lit(" ")))
    shorter = (words(c) >= 6) & t.startswith(F.concat(c, F.lit(" ")))
    return F.when(c == "", None).when(c == t, "exact").when(longer | shorter, "prefix").when(word_jaccard(c, t) >= 0.75, "fuzzy")


# == person names

_MAIL = re.compile(r"\b[\w.%+-]+@[\w.-]+\.[a-z]{2,}\b", re.I)
_TITLE = re.compile(r"^(?:prof(?:essor)?|dr|mrs|mr|ms)\.?\s+", re.I)
_DEGREE = r"(?:ph\.?d|m\.?sc|m\.?s|m\.?b\.?a|pmp)\.?"
_DEGREES = re.compile(rf"(?:,\s*)+{_DEGREE}(?:\s*,\s*{_DEGREE})*\s*$", re.I)
_LOW = frozenset("al bin da de del der di dos du la le van von".split())
_NOT_PEOPLE = frozenset("ai bot enterprise group inc lab llc ltd ml platform team".split())
_NOBODY = frozenset(["your name", "unknown", "test user", "first last", "xxxx xxxx", *".=?", ""])
_EASTERN = ("CJK", "HIRAGANA", "KATAKANA", "HANGUL")


def smart_title(value: str) -> str:
    """Title case for a name of one case throughout; particles stay low, initials high, Eastern scripts as they are."""
    parts = value.split()
    letters = "".join(filter(str.isalpha, value))
    if any(mark in unicodedata.name(c, "") for c in value for mark in _EASTERN):
        return value
    if len(parts) < 2 or not (letters.islower() or letters.isupper()) or set("&|@") & set(value):
        return value
    if any(p.strip("{}[]();:,.").lower() in _NOT_PEOPLE for p in parts):
        return value
    done = []
    for k, p in enumerate(parts):
        core = p.strip(".,")
        done.append(p.upper() if len(core) == 1 and core.isalpha() else p.lower() if k and core.casefold() in _LOW else p.title())
    return " ".join(done)


def person_name_of(raw: str | None) -> tuple[str | None, str, list[str]]:
    """(display form, status, what was done) of a name as people write it."""
    tidy = lambda v: " ".join(v.replace("​", "").split())
    name = unicodedata.normalize("NFC", tidy(raw or ""))
    if name.casefold() in _NOBODY:
        return None, "invalid", ["no usable name"]
    notes = ["white space"] if name != raw else []
    if _MAIL.search(name):
        name = tidy(_MAIL.sub("", name).strip(" -|,;"))
        if not name:
            return None, "invalid", ["an address only"]
        notes.append("address")
    for pattern, note in ((_TITLE, "honorific"), (_DEGREES, "degree")):
        if (bare := tidy(pattern.sub("", name))) != name:
            name = bare
            notes.append(note)
    if name.count(",") == 1:
        family, given = map(tidy, name.split(","))
        if all(x[:1].isalpha() and not re.search("[0-9/@|]", x) for x in (family, given)):
            name = f"{given} {family}"
            notes.append("order")
    if (cased := smart_title(name)) != name:
        name = cased
        notes.append("case")
    return name, "changed" if notes else "unchanged", notes


@pandas_udf(_row(value=T.StringType(), status=T.StringType(), notes=T.ArrayType(T.StringType())))
def person_name(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([person_name_of(v) for v in s], columns=["value", "status", "notes"])
