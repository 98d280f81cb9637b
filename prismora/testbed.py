"""Catalogue views over the star-schema test tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import derive
from .functions.text import fold

FACETS = ("kind", "year", "component", "use_case", "industry", "affiliations")
PERMIT = ("aff_type", "aff_region")
REGIONS = {"africa": "africa_oceania", "america": "americas", "asia": "asia", "europe": "europe"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each part: organisations from its suppliers, signals from its lines."""
    part, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    orders, supplier = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    lines = li.select("l_partkey", "l_orderkey", "l_suppkey", "l_quantity").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left").drop("o_orderkey")
    # One shuffle by part and a mark at the first line of each order, supplier and customer; distinct counts of three columns would multiply the lines.
    first = lambda c: (F.row_number().over(Window.partitionBy("l_partkey", c).orderBy(c)) == 1) & F.col(c).isNotNull()
    lines = lines.repartition("l_partkey").withColumns({"order1": first("l_orderkey"), "supplier1": first("l_suppkey"), "customer1": first("o_custkey")})
    stats = lines.groupBy("l_partkey").agg(
        F.min("l_suppkey").alias("s1"), F.max("l_suppkey").alias("s2"), F.count("*").alias("stars"), F.count_if("order1").alias("forks"),
        F.count_if("supplier1").alias("contributors"), F.sum("l_quantity").cast("bigint").alias("commits"), F.count_if("customer1").alias("cited"),
    )
    place = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    place = place.select("s_suppkey", "s_name", F.when(F.col("s_acctbal") < 5000, "academic").otherwise("company").alias("s_type"), F.col("r_name").alias("s_region"))
    one, two = (place.select(F.col("s_suppkey").alias(f"k{i}"), F.struct("s_name", "s_type", "s_region").alias(f"o{i}")) for i in (1, 2))
    joined = part.join(stats, F.col("p_partkey") == F.col("l_partkey"), "left").join(one, F.col("s1") == F.col("k1"), "left").join(two, F.col("s2") == F.col("k2"), "left")
    orgs = F.when(F.col("p_partkey") % 13 == 0, F.array().cast("array<struct<s_name:string,s_type:string,s_region:string>>")).otherwise(F.array_distinct(F.array_compact(F.array("o1", "o2"))))
    k = F.col("p_partkey")
    return joined.withColumn("orgs", orgs).select(
        k.alias("i"), F.concat(F.lit("part-"), k.cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("kind_code"), (F.lit(1970) + F.col("p_size")).cast("int").alias("year_n"),
        F.when(k % 8 != 7, (k % 8).cast("int")).alias("importance"), F.col("p_brand").alias("brand"), "stars", "forks", "contributors", "commits", F.when(k % 3 == 0, F.col("cited")).alias("cited"),
        # As records carry them: compound affiliations and lists aligned to the distinct organisations.
        F.array(F.array_join(F.transform("orgs", lambda o: o["s_name"]), "; ")).alias("affiliation_list"), F.transform("orgs", lambda o: o["s_type"]).alias("types"), F.transform("orgs", lambda o: o["s_region"]).alias("countries"),
    )


def derived(raw: DataFrame) -> DataFrame:
    """Organisations, sectors, regions and popularity of raw records."""
    out = raw.withColumn("organizations", derive.organizations_of(F.col("affiliation_list")))
    out = out.withColumn("aff_rows", derive.affiliation_rows(F.col("organizations"), F.col("types"), F.col("countries")))
    out = out.withColumn("aff_type", derive.aff_types(F.transform("aff_rows", lambda r: r["sector"])))
    out = out.withColumn("aff_region", derive.aff_regions(F.transform("aff_rows", lambda r: derive.region_of(r["country"], REGIONS))))
    return out.withColumn("pop", derive.popularity_of(F.col("kind_code"), F.col("stars"), F.col("forks"), F.col("contributors"), F.col("commits"), F.col("cited")))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised records: facet vectors and order keys."""
    d = derived(raw_corpus(spark, sf_dir))
    k, v = F.col("i"), derive.facet_vector
    return d.select(
        "i", "id", "title", F.lower("title").alias("folded_title"), "importance", "pop", "year_n", v(F.array("kind_code")).alias("kind"), v(F.array(F.col("year_n").cast("string"))).alias("year"),
        v(F.when(k % 7 != 0, F.array("brand"))).alias("component"), v(F.when(k % 11 != 0, F.split("title", " "))).alias("use_case"), v(F.when(k % 5 != 0, F.array("kind_code"))).alias("industry"),
        v(F.col("organizations"), False).alias("affiliations"), "aff_type", "aff_region",
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the first line as title, the text as summary, the source as author."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    j = d.join(labels, "doc_id", "left")
    return j.select(
        F.col("doc_id").alias("i"), F.regexp_extract("text", r"^[^\n.]{0,80}", 0).alias("title"), F.col("text").alias("summary"), F.array("source").alias("authors"), F.col("lang").alias("kind"),
        (F.col("quality") * 3 + F.col("toxic")).alias("importance"),
    )


def folded_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).withColumn("folded_title", fold(F.col("title")))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record log: a user's sign-ups are base records, errors retired ones, the rest corrections."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    url = F.when(kind == "signup", F.concat(F.lit("https://x.example/u"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "/").otherwise("")))
    # A few views move their user to another address.
    url = F.coalesce(url, F.when((kind == "view") & (F.col("event_id") % 97 == 0), F.concat(F.lit("https://x.example/u"), (F.col("user_id") + 1).cast("string"))))
    dup = F.when(kind == "error", "gone").when((kind == "view") & (F.col("event_id") % 89 == 0), "merged")
    pairs = F.array(F.struct(F.lit("url").alias("k"), url.alias("v")), F.struct(F.lit("duplicate_of").alias("k"), dup.alias("v")), F.struct(F.lit("value").alias("k"), F.when(kind != "error", F.col("value").cast("string")).alias("v")), F.struct(F.lit("k").alias("k"), F.get_json_object("props", "$.k").alias("v")))
    fields = F.map_from_entries(F.transform(F.filter(pairs, lambda p: p["v"].isNotNull()), lambda p: F.struct(p["k"], p["v"])))
    seq = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") * 1000 + F.col("event_id") % 1000
    return e.select(seq.alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), (~kind.isin("signup", "error")).alias("override"), fields.alias("fields"))


CORPUS_SQL = """
stats as (
  select l_partkey, min(l_suppkey) s1, max(l_suppkey) s2, count(*) stars, count(distinct l_orderkey) forks, count(distinct l_suppkey) contributors,
    sum(l_quantity)::bigint commits, count(distinct o_custkey) cited
  from lineitem left join orders on l_orderkey = o_orderkey group by 1
), place as (
  select s_suppkey, s_name, case when s_acctbal < 5000 then 'academic' else 'company' end s_type, r_name s_region
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
), raw as (
  select p_partkey i, 'part-' || p_partkey id, p_name title, p_type kind_code, (1970 + p_size)::int year_n, case when p_partkey % 8 <> 7 then (p_partkey % 8)::int end importance,
    p_brand brand, stars, forks, contributors, commits, case when p_partkey % 3 = 0 then s.cited end cited,
    case when p_partkey % 13 = 0 or a.s_name is null then [] when a.s_name = b.s_name then [a.s_name] else [a.s_name, b.s_name] end orgs,
    case when p_partkey % 13 = 0 or a.s_name is null then [] when a.s_name = b.s_name then [a.s_type] else [a.s_type, b.s_type] end types,
    case when p_partkey % 13 = 0 or a.s_name is null then [] when a.s_name = b.s_name then [a.s_region] else [a.s_region, b.s_region] end countries
  from part left join stats s on p_partkey = l_partkey left join place a on a.s_suppkey = s1 left join place b on b.s_suppkey = s2
), derived as (
  select *,
    case when len(orgs) = 0 then ['unaffiliated'] when list_contains(types, 'academic') and list_contains(types, 'company') then ['academic', 'non_academic']
      when list_contains(types, 'academic') then ['academic'] else ['non_academic'] end aff_type,
    [x for x in [case lower(c) when 'africa' then 'africa_oceania' when 'america' then 'americas' when 'asia' then 'asia' when 'europe' then 'europe' else '' end for c in countries] if x <> ''] regions,
    coalesce(greatest(case when stars is not null or kind_code = 'code_repo' then least(1.0::double, ln(1 + coalesce(stars, 0) + 2 * coalesce(forks, 0) + 5 * coalesce(contributors, 0) + 0.1::double * least(coalesce(commits, 0), 2000)) / ln(8001::double)) end,
      case when cited is not null then least(1.0::double, ln(1 + cited::double) / ln(1501::double)) end), 0.3::double) pop
  from raw
), c as (
  select i, id, title, lower(title) folded_title, importance, pop, year_n, [kind_code] kind, [year_n::varchar] as year,
    case when i % 7 <> 0 then [brand] else ['__none__'] end component, case when i % 11 <> 0 then list_distinct(string_split(title, ' ')) else ['__none__'] end use_case,
    case when i % 5 <> 0 then [kind_code] else ['__none__'] end industry, orgs affiliations, aff_type, list_distinct(regions) aff_region, stars, forks, contributors, commits, cited
  from derived
)
"""
