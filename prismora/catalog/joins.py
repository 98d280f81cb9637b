"""Queries of joins, the ordered fold, dedupe, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..cluster import written
from ..functions import derive as D
from ..functions.text import norm_url, url_key
from ..operators import assembly as A
from ..operators import constraints as V
from ..operators import linkage as L
from ..testbed import corpus, event_log, table
from .facets import ORDER, sql


def _curated(spark, d):
    """Every fifth page under another spelling of its address."""
    p = table(spark, d, "pages").where("page_id % 5 = 0")
    return p.select(F.concat(F.lit("c"), F.col("page_id").cast("string")).alias("cid"), F.when(F.col("page_id") % 2 == 0, F.upper("url")).otherwise(F.concat("url", F.lit("/"))).alias("curl"))


_CUR = "cur as (select 'c' || page_id as cid, case when page_id % 2 = 0 then upper(url) else url || '/' end as curl from pages where page_id % 5 = 0)"
_KEY = "regexp_replace(regexp_replace(lower({0}), '^https?://', ''), '/+$', '')"
_NORM = "regexp_replace(regexp_replace(lower({0}), '^https?://(www\\.)?', ''), '/+$', '')"


def j1(spark, d):
    """The last pool row of each address wins; a record's own value stays."""
    pool = table(spark, d, "pages").select("page_id", "url", F.lit(None).cast("bigint").alias("x")).withColumn("stars", F.col("page_id") * 2)
    pool = pool.unionByName(pool.where("page_id % 2 = 0").withColumn("stars", F.col("page_id") * 3).withColumn("page_id", F.col("page_id") + 100_000_000))
    cur = _curated(spark, d).withColumn("stars", F.when(F.col("cid") == "c0", F.lit(7).cast("bigint")))
    return A.enrich_last_wins(cur, pool, "curl", "url", "page_id", ["stars"]).select("cid", "stars")


def j2(spark, d):
    """By any of three addresses, else by title."""
    pool = table(spark, d, "pages").where("page_id % 3 <> 0").select("page_id", "url", F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit("/alt"))).alias("alt"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"))
    cur = _curated(spark, d).withColumn("name", F.concat(F.lit("PAGE -- "), F.substring("cid", 2, 20)))
    cur = cur.withColumn("curl", F.when(F.col("cid").endswith("5"), "https://nowhere.example").otherwise(F.col("curl")))
    return A.enrich_by_keys(cur, pool, "curl", "name", ["url", "alt"], "title", "page_id", ["page_id"]).select("cid", "matched_by", "pool_page_id")


def j3(spark, d):
    c = corpus(spark, d).select("id", F.when(F.col("i") % 2 == 0, F.array().cast("array<string>")).otherwise(F.col("component")).alias("authors"), (F.col("i") % 4 == 0).alias("has_authors"), F.when(F.col("i") % 3 == 0, "").otherwise(F.col("title")).alias("venue"), F.array(F.lit("joined")).alias("p_authors"), F.lit("pool").alias("p_venue"))
    out = A.fill_missing(c, {"authors": "p_authors", "venue": "p_venue"}, {"authors": "has_authors"})
    return out.select("id", F.array_join("authors", ",").alias("authors"), "venue")


def j4(spark, d):
    c = corpus(spark, d).select("id", F.col("importance").cast("bigint").alias("cited"))
    impact = corpus(spark, d).where("i % 10 = 0").select("id", F.when(F.col("i") % 20 == 0, F.col("i")).alias("cited"))
    return A.override_by_id(c, impact, "id", ["cited"])


def j5(spark, d):
    pool = table(spark, d, "pages")
    alt = F.array("url", F.concat(F.col("url"), F.lit("/")), F.when(F.col("page_id") % 2 == 0, F.lit("https://other.example")))
    return A.residue(pool.select("page_id", "url"), "page_id", alt, _curated(spark, d), "curl").select("page_id")


def v14(spark, d):
    """How many rows the exact addresses miss that the aliases catch."""
    pool, cur = table(spark, d, "pages").select("page_id", "url"), _curated(spark, d)
    naive = pool.join(cur, F.col("url") == F.col("curl"), "left_semi").agg(F.count("*").alias("exact"))
    by_alias = pool.join(cur.select(url_key(F.col("curl")).alias("k")).distinct(), url_key(F.col("url")) == F.col("k"), "left_semi").agg(F.count("*").alias("by_alias"))
    return naive.crossJoin(by_alias)


def j7(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"), F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("p"))
    z = o.select("o_custkey", F.posexplode(F.arrays_zip("k", F.col("p.o_orderpriority").alias("q"))).alias("pos", "z"))
    return z.select("o_custkey", "pos", F.col("z.k").alias("o_orderkey"), F.col("z.q").alias("priority"))


def j9(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type")
    c = table(spark, d, "customer")
    return c.join(e, F.col("c_custkey") == F.col("user_id"), "left").groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("contexts"))


def j10(spark, d):
    from ..operators.worklists import unseen

    c = table(spark, d, "customer")
    o, e = table(spark, d, "orders").where("o_orderkey % 3 = 0"), table(spark, d, "events").where("event_type = 'signup'")
    return unseen(c.select("c_custkey", "c_name"), [("c_custkey", o, "o_custkey"), ("c_custkey", e, "user_id"), ("c_name", c.where("c_custkey % 7 = 0"), "c_name")]).select("c_custkey")


def j13(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    steps = [("owner", table(spark, d, "orders").where("o_orderkey % 50 = 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("v")), ["c_custkey"]), ("event", table(spark, d, "events").where("event_id % 5 = 0").groupBy(F.col("user_id").alias("c_custkey")).agg(F.min("event_type").alias("v")), ["c_custkey"])]
    return L.cascade(c, steps, "v")


J13_SQL = "with o as (select o_custkey k, min(o_orderpriority) v from orders where o_orderkey % 50 = 0 group by 1), e as (select user_id k, min(event_type) v from events where event_id % 5 = 0 group by 1) select c_custkey, coalesce(o.v, e.v) as v, case when o.v is not null then 'owner' when e.v is not null then 'event' else 'unverified' end as match from customer left join o on o.k = c_custkey left join e on e.k = c_custkey"


def j14(spark, d):
    e = table(spark, d, "events")
    names = e.select(F.col("user_id").alias("record"), F.col("event_id").alias("pos"), F.col("event_type").alias("name"))
    found = e.where("event_id % 3 = 0").select(F.col("user_id").alias("record"), F.col("event_id").alias("pos"), F.col("event_type").alias("name"), F.round("value", 6).alias("value"))
    return L.aligned_byline(names, found, "record", "pos", "name", ["value"]).select("record", "pos", "name", "value", "matched")


J14_SQL = "with a as (select user_id record, event_id pos, event_type name, row_number() over (partition by user_id, event_type order by event_id) n from events), b as (select user_id record, event_type name, round(value, 6) as value, row_number() over (partition by user_id, event_type order by event_id) n from events where event_id % 3 = 0) select record, pos, name, value, b.n is not null as matched from a left join b using (record, name, n)"


def j15(spark, d):
    li = table(spark, d, "orders").select("o_orderkey", F.concat_ws("#", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("key"), "o_orderstatus")
    fix = li.where("o_orderkey % 9 = 0").select("key", F.lit("X").alias("o_orderstatus"))
    return A.override_by_id(li, fix, "key", ["o_orderstatus"]).select("key", "o_orderstatus")


def j16(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("raw"))
    t = table(spark, d, "customer").select(F.col("c_mktsegment").alias("raw")).distinct().withColumn("name", F.concat(F.lit("seg:"), "raw"))
    return L.two_key_lookup(c, t, "raw", "name").select("c_custkey", "name")


def j17(spark, d):
    e = table(spark, d, "events")
    old = e.where("event_type = 'view'").groupBy("user_id", (F.col("event_id") % 5).cast("int").alias("k")).agg(F.min("event_id").alias("at")).withColumn("v", F.when(F.col("k") % 2 == 0, F.lit("old")))
    new = e.where("event_type = 'click'").groupBy("user_id", (F.col("event_id") % 5).cast("int").alias("k")).agg(F.min("event_id").alias("at")).withColumn("v", F.lit("new"))
    return L.ordered_outer(old, new, ["user_id", "k"], "at", "v")


J17_SQL = """with o as (select user_id, (event_id % 5)::int k, min(event_id) a, case when (event_id % 5) % 2 = 0 then 'old' end v from events where event_type = 'view' group by user_id, event_id % 5), n as (select user_id, (event_id % 5)::int k, min(event_id) b, 'new' v from events where event_type = 'click' group by 1, 2)
select user_id, k, (row_number() over (partition by user_id order by a is null, a, b, k) - 1)::int as at, coalesce(o.v, n.v) as v from o full join n using (user_id, k)"""


def j18(spark, d):
    a = corpus(spark, d).select("id", "title", F.col("importance").cast("string").alias("importance"), "use_case")
    b = a.withColumn("use_case", F.when(F.col("id").endswith("3"), F.slice("use_case", 1, 1)).otherwise(F.reverse("use_case"))).withColumn("importance", F.when(F.col("id").endswith("7"), F.lit(None)).otherwise(F.col("importance")))
    return L.changed_fields(a, b, "id", ["title", "importance", "use_case"])


J18_SQL = sql("""select id, 'use_case' as field, array_to_string(list_sort(use_case), ';') as before, use_case[1] as after from (select id, i, case when i % 11 <> 0 then string_split(title, ' ') else ['__none__'] end use_case from c) where id like '%3' and len(use_case) > 1
union all select id, 'importance', importance::varchar, null from c where id like '%7' and importance is not null""")


def j19(spark, d):
    a = written(corpus(spark, d).select("id", F.round("pop", 12).alias("pop"), "title"), "corpus")  # both sides
    b = a.where("id <> 'part-5'").withColumn("pop", F.when(F.col("id") == "part-7", F.col("pop") + 1e-3).when(F.col("id") == "part-8", F.col("pop") + 1e-14).otherwise(F.col("pop"))).withColumn("title", F.when(F.col("id") == "part-9", "other").otherwise(F.col("title")))
    return V.drift(a, b, "id", ["title"], {"pop": 1e-12})


def g(spark, d):
    f = A.fold_log(event_log(spark, d))
    return f.select("seq", "id", "state", F.element_at("fields", "url").alias("url"), F.element_at("fields", "k").alias("k"))


def g_counts(spark, d):
    return A.fold_log(event_log(spark, d)).groupBy("state").agg(F.count("*").alias("n"))


def j6(spark, d):
    """Corrections without an earlier base record."""
    log = event_log(spark, d)
    first = log.where("not override and not map_contains_key(fields, 'duplicate_of')").groupBy("id").agg(F.min("seq").alias("base"))
    return log.where("override").join(first, "id", "left").where("base is null or base >= seq").select("id", "seq")


_LOG = "log as (select epoch_us(ts) * 1000 + event_id % 1000 as seq, 'u' || user_id as id, event_type, event_id, user_id, value, props from events)"


def o8(spark, d):
    e = table(spark, d, "events")
    first = A.first_per_key(e, F.when(F.col("event_type") != "view", F.concat_ws("/", "event_type", F.col("user_id").cast("string"))), F.col("ts"), F.col("event_id"))
    return first.select("event_id")


def o8_tail(spark, d):
    e = table(spark, d, "events")
    ids = F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string"))
    return A.first_present(e, [ids, F.when(F.col("event_id") % 3 == 0, F.col("event_type"))], F.col("event_id")).select("event_id")


def o10(spark, d):
    e = event_log(spark, d).where("override")
    return A.latest_fields(e).select("id", F.element_at("fields", "k").alias("k"), F.element_at("fields", "url").alias("url"))


def o1(spark, d):
    c = corpus(spark, d).withColumn("k", F.get("kind", F.lit(0)))
    return A.ordinals(c.orderBy(*A.index_order("k", "year_n", "title", "i")).select("id"), "pos")


def u1(spark, d):
    a = corpus(spark, d).where("i <= 50").select("id", "title", F.lit(0).alias("part"))
    b = table(spark, d, "pages").where("page_id < 50").select(F.col("url").alias("id"), F.lit(1).alias("part"))
    return a.unionByName(b, allowMissingColumns=True)


def u4(spark, d):
    a = table(spark, d, "orders").select("o_custkey")
    b = table(spark, d, "orders").where("o_orderkey % 2 = 0").select("o_custkey")
    return a.exceptAll(b).groupBy("o_custkey").agg(F.count("*").alias("n"))


def u5(spark, d):
    e = table(spark, d, "events")
    side = lambda t: e.where(F.col("event_type") == t).groupBy("user_id").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.array_sort(F.collect_set((F.col("event_id") % 4).cast("int"))).alias("marks"))
    return A.upsert(side("view"), side("click"), "user_id", ["first"], ["marks"]).withColumn("marks", F.array_join("marks", ","))


U5_SQL = "with v as (select user_id, min(event_id) f, max(event_id) l, list((event_id % 4)::int) m from events where event_type = 'view' group by 1), k as (select user_id, min(event_id) f, max(event_id) l, list((event_id % 4)::int) m from events where event_type = 'click' group by 1) select user_id, coalesce(v.f, k.f) as first, coalesce(k.l, v.l) as last, array_to_string(list_sort(list_distinct(list_concat(coalesce(v.m, []), coalesce(k.m, [])))), ',') as marks from v full join k using (user_id)"


def u6(spark, d):
    from ..operators.worklists import claims_backfill

    claimed = corpus(spark, d).select("id", F.array_sort("use_case").alias("use_case"))
    found = corpus(spark, d).where("i % 4 = 0").select("id", F.explode("component").alias("use_case"))
    return claims_backfill(claimed, found, "id", "use_case").withColumn("use_case", F.array_join("use_case", ","))


def u7(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    have = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return have.withColumn("seeded", F.lit(False)).unionByName(c.join(have, "c_custkey", "left_anti").withColumn("seeded", F.lit(True)))


def a24(spark, d):
    """Sets of the same rows hash alike, whatever their partitioning."""
    t = table(spark, d, "nation")
    return A.content_hash(t, ["n_nationkey"]).crossJoin(A.content_hash(t.repartition(5), ["n_nationkey"]).withColumnRenamed("data_hash", "again")).select("data_hash", (F.col("data_hash") == F.col("again")).alias("same"))


def s1(spark, d):
    """The log's order: position within the user's file."""
    e = table(spark, d, "events")
    return e.select("event_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("pos"))


G_SQL = None
QUERIES = {
    "s1_shard_ordinal": (s1, "select event_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as pos from events"),
    "j1_enrich_last_wins": (j1, f"with {_CUR}, pool as (select {_NORM.format('url')} k, max_by(stars, o) stars from (select url, page_id o, page_id * 2 stars from pages union all select url, page_id + 100000000, page_id * 3 from pages where page_id % 2 = 0) group by 1) select cid, case when cid = 'c0' then 7 else stars end as stars from cur left join pool on k = {_NORM.format('curl')}"),
    "j2_two_key_enrich": (j2, f"with {_CUR}, x as (select cid, case when cid like '%5' then 'https://nowhere.example' else curl end curl, cid[2:]::bigint n from cur), u as (select {_NORM.format('url')} k, min(page_id) p from pages where page_id % 3 <> 0 group by 1) select cid, case when p is not null then 'url' when n % 3 <> 0 then 'title' end as matched_by, coalesce(p, case when n % 3 <> 0 then n end) as pool_page_id from x left join u on k = {_NORM.format('curl')}"),
    "j3_fill_missing": (j3, sql("select id, case when i % 4 <> 0 then 'joined' else '' end as authors, case when i % 3 = 0 then 'pool' else title end as venue from c")),
    "j4_override": (j4, sql("select id, case when i % 20 = 0 then i else importance end as cited from c")),
    "j5_alias_anti_join": (j5, f"with {_CUR} select page_id from pages where {_KEY.format('url')} not in (select {_KEY.format('curl')} from cur)"),
    "j6_orphans": (j6, f"with {_LOG}, b as (select id, min(seq) base from log where event_type = 'signup' group by 1) select id, seq from log left join b using (id) where event_type not in ('signup', 'error') and (base is null or base >= seq)"),
    "j7_positional_zip": (j7, "select o_custkey, (row_number() over (partition by o_custkey order by o_orderkey, o_orderpriority) - 1)::int as pos, o_orderkey, o_orderpriority as priority from orders"),
    "j8_unknown_targets": (lambda s, d: V.known_target(table(s, d, "events"), "event_id", "user_id", table(s, d, "customer").where("c_custkey % 3 <> 0"), "c_custkey"), "select 'target' as \"check\", event_id::varchar as id, user_id::varchar as detail from events where user_id not in (select c_custkey from customer where c_custkey % 3 <> 0)"),
    "j9_contexts": (j9, "select c_custkey, coalesce(string_agg(distinct event_type, ',' order by event_type), '') as contexts from customer left join events on c_custkey = user_id group by 1"),
    "j10_unseen": (j10, "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 3 = 0) and c_custkey not in (select user_id from events where event_type = 'signup') and c_custkey % 7 <> 0"),
    "j13_cascade": (j13, J13_SQL), "j14_byline": (j14, J14_SQL), "j15_position_override": (j15, "select o_orderkey || '#' || o_custkey as key, case when o_orderkey % 9 = 0 then 'X' else o_orderstatus end as o_orderstatus from orders"),
    "j16_two_key_lookup": (j16, "select c_custkey, 'seg:' || c_mktsegment as name from customer"), "j17_ordered_outer": (j17, J17_SQL), "j18_changed_fields": (j18, J18_SQL),
    "j19_differential": (j19, "select * from (values ('part-5', 'only left'), ('part-7', 'pop'), ('part-9', 'title')) t(id, detail)"),
    "g_assemble_fold": (g, None), "g_counters": (g_counts, None),
    "o1_index_order": (o1, sql("select id, row_number() over (order by kind[1], year_n desc, title, i) - 1 as pos from c")),
    "o8_first_wins": (o8, "select event_id from events where event_type = 'view' union all select event_id from events where event_type <> 'view' qualify row_number() over (partition by event_type, user_id order by ts, event_id) = 1"),
    "o8_first_of_keys": (o8_tail, "with k as (select event_id, case when event_id % 2 = 0 then '0:' || user_id when event_id % 3 = 0 then '1:' || event_type end k from events) select event_id from k where k is null union all select min(event_id) from k where k is not null group by k"),
    "o10_latest_wins": (o10, f"with {_LOG}, p as (select id, seq, props ->> '$.k' as k, case when event_type = 'view' and event_id % 97 = 0 then 'https://x.example/u' || (user_id + 1) end u from log where event_type not in ('signup', 'error')) select id, max_by(k, seq) filter (k is not null) as k, max_by(u, seq) filter (u is not null) as url from p group by id"),
    "u1_union": (u1, sql("select id, title, 0 as part from c where i <= 50 union all select url, null, 1 from pages where page_id < 50")),
    "u4_difference": (u4, "select o_custkey, count(*) filter (o_orderkey % 2 = 1) as n from orders group by 1 having n > 0"), "u5_upsert": (u5, U5_SQL),
    "u6_claims_backfill": (u6, sql("select id, true as override, array_to_string(list_sort(list_distinct(list_concat(use_case, component))), ',') as use_case from c where i % 4 = 0 and not list_has_all(use_case, component)")),
    "u7_seed_missing": (u7, "select distinct o_custkey as c_custkey, false as seeded from orders union all select c_custkey, true from customer where c_custkey not in (select o_custkey from orders)"),
    "v14_alias_gain": (v14, f"with {_CUR} select (select count(*) from pages where url in (select curl from cur)) as exact, (select count(*) from pages where {_KEY.format('url')} in (select {_KEY.format('curl')} from cur)) as by_alias"),
    "a24_content_hash": (a24, """select sha256(string_agg(sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}'), '' order by n_nationkey)) as data_hash, true as same from nation"""),
}
