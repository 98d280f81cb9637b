"""Assembly: append-only shards folded into records, and their enrichment."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import written
from ..functions.text import dedupe_key, norm_title, norm_url, url_key
from .graph import connected

FOLD_TYPE = "id string, seq bigint, fields map<string,string>, state string"


def first_per_key(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key; a null or empty key never repeats."""
    w = Window.partitionBy("_key").orderBy(*order)
    blank = key.isNull() | (key == "")
    keyed = df.withColumn("_key", F.when(blank, F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))).otherwise(key))
    return keyed.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_key")


def first_present(df: DataFrame, keys: list[Column], *order: Column) -> DataFrame:
    """First wins by the first of several keys that a row has (id, then DOI, then title)."""
    return first_per_key(df, F.coalesce(*[F.when(k != "", F.concat(F.lit(f"{i}:"), k)) for i, k in enumerate(keys)]), *order)


def last_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by one hash aggregation instead of a sort."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return best.select(*keys, "_r.*")


def latest_fields(patches: DataFrame, key: str = "id", seq: str = "seq", fields: str = "fields") -> DataFrame:
    """For each key the latest value of every field that any patch has, wholesale: a present empty value wins too."""
    each = patches.select(key, seq, F.explode(fields).alias("field", "value"))
    # The value travels in a struct: max_by of a null value is a value.
    last = each.groupBy(key, "field").agg(F.max(F.struct(F.col(seq).alias("s"), F.struct("value").alias("v"))).alias("m"))
    return last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", F.col("m.v.value").alias("value")))).alias(fields))


def _claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which live bases get their URL, in rows by root, seq and kind, some at a time.

    What is held is the addresses that are taken and each id's address, of one
    root; the fields pass through as they are.
    """
    root, taken, at = None, set(), {}
    for batch in batches:
        state = []
        for r, id_, override, url in zip(*(batch.column(c).to_pylist() for c in ("root", "id", "override", "url"))):
            if r != root:
                root, taken, at = r, set(), {}
            url = url or ""
            if override:
                old = at.get(id_)
                if old is not None:
                    if url and url != old:
                        taken.discard(old.rstrip("/"))
                        taken.add(url.rstrip("/"))
                    at[id_] = url
                state.append(None)
            else:
                key = url.rstrip("/")
                if key and key in taken:
                    state.append("duplicate")
                else:
                    taken.add(key)
                    at[id_] = url
                    state.append("kept")
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "seq", "fields")), pa.array(state, pa.string())], names=["id", "seq", "fields", "state"])


def _moving(live: DataFrame, patches: DataFrame) -> DataFrame | None:
    """(node, root) of the ids and URLs, as hashes, that corrections to other URLs connect; None without any.

    Empty URLs belong to nobody and connect nothing.  Hashes that collide only
    put two groups together.
    """
    known = live.select("id", "key").distinct()
    moved = patches.where(F.col("url") != "").select("id", F.col("key").alias("to")).distinct()
    who = known.join(moved, "id").where("key <> to").select("id").distinct()
    ends = known.unionByName(moved.withColumnRenamed("to", "key")).where("key <> ''").distinct().join(who, "id", "left_semi")
    edges = written(ends.select(_node("i", "id").alias("u"), _node("k", "key").alias("v")), "moves")
    return None if edges.isEmpty() else connected(edges)


def _node(kind: str, name: str) -> Column:
    return F.xxhash64(F.lit(kind), F.col(name))


def fold_log(log: DataFrame) -> DataFrame:
    """Every row of a record log with what became of it: kept, duplicate, retired, applied or orphaned.

    log: seq (the order), id, override and fields, a map of the fields that
    the row has (texts or JSON; url and duplicate_of are looked at).  The
    first base row of a URL is kept with all later corrections of its id
    folded in by field, up to the id's next kept base; bases with duplicate_of
    are retired, as are those that a correction gives one; a correction whose
    id has no kept base before it is an orphan.  Of rows with one seq
    corrections come first.  This is relational; only where a correction moves
    a record to another URL, the base rows and URLs connected by such moves
    are gone through in order, each connected group for itself, as a stream.
    """
    log = log.select("seq", "id", F.coalesce("override", F.lit(False)).alias("override"), F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"))
    log = log.withColumn("url", F.element_at("fields", "url")).withColumn("key", F.coalesce(dedupe_key(F.col("url")), F.lit("")))
    log = written(log, "log")
    bases, patches = log.where("not override"), log.where("override")
    gone = F.coalesce(F.element_at("fields", "duplicate_of"), F.lit("")) != ""
    retired, live = bases.where(gone).withColumn("state", F.lit("retired")), bases.where(~gone)
    cols = ["id", "seq", "fields", "state"]
    groups, tangled = _moving(live, patches), None
    if groups is not None:
        of_id, of_key = (groups.select(F.col("node").alias(f"_{k}"), F.col("root").alias(f"_r{k}")) for k in "ik")
        rooted = lambda df: df.join(of_id, _node("i", "id") == F.col("_i"), "left").join(of_key, _node("k", "key") == F.col("_k"), "left").withColumn("root", F.coalesce("_ri", F.when(F.col("key") != "", F.col("_rk"))))
        live = rooted(live)
        moves = rooted(patches.where(F.map_contains_key("fields", F.lit("url"))))
        rows = live.unionByName(moves).where("root is not null").select("root", "seq", "id", "override", "url", "fields")
        in_order = rows.repartition("root").sortWithinPartitions("root", "seq", F.desc("override"), "id", "url")
        tangled = in_order.mapInArrow(_claims, FOLD_TYPE).where("state is not null")
        live = live.where("root is null")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    ranked = live.where("key <> ''").withColumn("rn", rank).select("id", "seq", "fields", "rn").union(live.where("key = ''").select("id", "seq", "fields", F.lit(1)))
    ranked = ranked.withColumn("state", F.when(F.col("rn") == 1, "kept").otherwise("duplicate")).select(*cols)
    judged = written(ranked if tangled is None else ranked.union(tangled.select(*cols)), "log-bases")
    kept, dupes = judged.where("state = 'kept'"), judged.where("state = 'duplicate'")

    # The last kept base of the id before each correction.
    timeline = patches.select("id", "seq", "fields", F.lit(None).cast(log.schema["seq"].dataType).alias("own")).union(kept.select("id", "seq", F.lit(None).cast("map<string,string>"), F.col("seq").alias("own")))
    before = F.last("own", True).over(Window.partitionBy("id").orderBy("seq", F.col("own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    placed = timeline.withColumn("base", before).where("own is null")
    corrected = placed.select("id", "seq", "fields", F.when(F.col("base").isNotNull(), "applied").otherwise("orphaned").alias("state"))
    merged = latest_fields(placed.where("base is not null").select(F.struct("id", "base").alias("record"), "seq", "fields"), "record")
    merged = merged.select(F.col("record.id").alias("_id"), F.col("record.base").alias("_seq"), F.col("fields").alias("patch"))
    full = kept.join(merged, (F.col("id") == F.col("_id")) & (F.col("seq") == F.col("_seq")), "left")
    fields = F.when(F.col("patch").isNull(), F.col("fields")).otherwise(F.map_concat(F.map_filter("fields", lambda k, v: ~F.map_contains_key("patch", k)), "patch"))
    state = F.when(F.coalesce(F.element_at(fields, "duplicate_of"), F.lit("")) != "", "retired").otherwise("kept")
    full = full.select("id", "seq", fields.alias("fields"), state.alias("state"))
    return full.union(retired.select(*cols)).union(dupes.select(*cols)).union(corrected.select(*cols))


def assembled(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, counters): the kept records, and how many rows came to each state.

    Ids that two kept records share are an error, as they are in the log.
    """
    folded = fold_log(log)
    records = folded.where("state = 'kept'").select("id", "seq", "fields")
    twice = records.groupBy("id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"ids of several records: {[r['id'] for r in twice]}")
    return records, folded.groupBy("state").agg(F.count("*").alias("n"))


def enrich_last_wins(records: DataFrame, pool: DataFrame, url: str, pool_url: str, order: str, values: list[str]) -> DataFrame:
    """Left join on the normalised URL with the pool's last row of each; a record's own values come first."""
    side = pool.select(norm_url(F.col(pool_url)).alias("_k"), F.col(order).alias("_o"), *[F.col(v).alias(f"_p_{v}") for v in values])
    side = last_per_key(side, ["_k"], "_o").drop("_o")
    out = records.withColumn("_k", norm_url(F.col(url))).join(side, "_k", "left")
    return fill_missing(out, {v: f"_p_{v}" for v in values}).drop("_k", *[f"_p_{v}" for v in values])


def enrich_by_keys(records: DataFrame, pool: DataFrame, url: str, title: str, pool_urls: list[str], pool_title: str, order: str, values: list[str]) -> DataFrame:
    """Left join with the pool's first row that has the URL among its own, else the first with the title."""
    rows = pool.withColumn("_r", F.struct(F.col(order).alias("o"), *values))
    urls = rows.select(F.explode(F.array_distinct(F.array(*[norm_url(F.col(u)) for u in pool_urls]))).alias("_k"), "_r").where("_k <> ''")
    by_url = urls.groupBy("_k").agg(F.min_by("_r", F.col("_r.o")).alias("_u"))
    by_title = rows.select(norm_title(F.col(pool_title)).alias("_t"), "_r").where("_t <> ''").groupBy("_t").agg(F.min_by("_r", F.col("_r.o")).alias("_v"))
    out = records.withColumn("_k", norm_url(F.col(url))).withColumn("_t", norm_title(F.col(title)))
    out = out.join(by_url, "_k", "left").join(by_title, "_t", "left").withColumn("_m", F.coalesce("_u", "_v"))
    out = out.withColumn("matched_by", F.when(F.col("_u").isNotNull(), "url").when(F.col("_v").isNotNull(), "title"))
    return out.select(*records.columns, "matched_by", *[F.col(f"_m.{v}").alias(f"pool_{v}") for v in values])


def fill_missing(df: DataFrame, sources: dict[str, str], only_absent: dict[str, str] | None = None) -> DataFrame:
    """Each target from its source where it is missing (null or empty) and the source is there.

    only_absent: targets with a presence flag; these are filled only where the
    field itself was absent, so that an empty list blocks it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def empty(c: str) -> Column:
        k = kinds[c]
        return F.col(c).isNull() | ((F.col(c) == "") if k == "string" else (F.size(c) == 0) if k.startswith(("array", "map")) else F.lit(False))

    cols = {}
    for target, source in sources.items():
        flag = (only_absent or {}).get(target)
        wanted = ~F.col(flag) if flag else empty(target)
        cols[target] = F.when(wanted & ~empty(source), F.col(source)).otherwise(F.col(target))
    return df.withColumns(cols)


def override_by_id(df: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Left join whose right side wins on the values that it has."""
    side = right.select(key, *[F.col(v).alias(f"_o_{v}") for v in values])
    out = df.join(side, key, "left")
    return out.withColumns({v: F.coalesce(f"_o_{v}", v) for v in values}).drop(*[f"_o_{v}" for v in values])


def residue(pool: DataFrame, pool_id: str, alias_urls: Column, taken: DataFrame, taken_url: str) -> DataFrame:
    """Pool rows of which no alias is among the taken URLs: one anti join by row after a semi join by alias."""
    names = pool.select(pool_id, F.explode(F.array_distinct(F.transform(F.filter(alias_urls, lambda u: u.isNotNull()), url_key))).alias("_a"))
    known = taken.select(url_key(F.col(taken_url)).alias("_a")).distinct()
    return pool.join(names.join(known, "_a", "left_semi").select(pool_id).distinct(), pool_id, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, preserve: list[str], union: list[str]) -> DataFrame:
    """Full outer merge: new rows overlay old ones, but keep `preserve` where the old has it and join the arrays of `union`."""
    values = [c for c in old.columns if c != key]
    a = old.select(key, *[F.col(c).alias(f"_a_{c}") for c in values], F.lit(True).alias("_a"))
    b = new.select(key, *[F.col(c).alias(f"_b_{c}") for c in values], F.lit(True).alias("_b"))
    out = a.join(b, key, "full_outer")

    def value(c: str) -> Column:
        left, right = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        if c in union:
            return F.array_sort(F.array_distinct(F.concat(F.coalesce(left, F.array().cast(old.schema[c].dataType)), F.coalesce(right, F.array().cast(old.schema[c].dataType)))))
        if c in preserve:
            return F.coalesce(left, right)
        return F.when(F.col("_b").isNotNull(), right).otherwise(left)

    return out.select(key, *[value(c).alias(c) for c in values])


def index_order(kind: str = "kind", year: str = "year", title: str = "title", seq: str = "seq") -> list[Column]:
    """Kind, falling year with none as 0, title by code point, place in the log."""
    return [F.col(kind).asc(), F.coalesce(F.col(year), F.lit(0)).desc(), F.col(title).asc(), F.col(seq).asc()]


def ordinals(df: DataFrame, name: str = "i") -> DataFrame:
    """Dense positions from 0 in the order that df is sorted by: counts of range partitions, no single-task window.

    df must be the outcome of orderBy.  The sorted rows are written once, each
    with its partition and place in it; counts and positions are made from
    that table, as two runs of one plan may be cut into different partitions.
    """
    tagged = written(df.withColumn("_id", F.monotonically_increasing_id()), "ordinals").withColumn("_part", F.shiftright("_id", 33))
    at, starts = 0, []
    for p, n in sorted(map(tuple, tagged.groupBy("_part").count().collect())):  # a row a partition
        starts.append((p, at))
        at += n
    first = df.sparkSession.createDataFrame(starts, "_part bigint, _first bigint")
    place = (F.col("_first") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint")
    return tagged.join(first, "_part").select(*[F.col(f"`{c}`") for c in df.columns], place.alias(name))


def content_hash(df: DataFrame, order: list[str], leaf: int = 4096) -> DataFrame:
    """One SHA-256 over the row hashes in order.

    Beyond `leaf` rows it is a tree: rows fall into buckets by a hash of their
    order key, each bucket is hashed in order, and the buckets' hashes in turn,
    about `leaf` at a time; what it gives depends on the rows alone.
    """
    rows = df.select(F.struct(*order).alias("o"), F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "h"))), lambda x: x["h"]), ""), 256)
    buckets, key = -(-df.count() // leaf), F.xxhash64("o")
    while buckets > 1:
        rows = rows.groupBy(F.pmod(key, F.lit(buckets)).alias("o")).agg(joined.alias("h"))
        buckets, key = (-(-buckets // leaf) if buckets > leaf else 1), F.col("o")
    return rows.agg(joined.alias("data_hash"))


def parsed_fields(text: str) -> dict[str, str]:
    """The fields of a JSON object as texts, those that aren't texts as JSON."""
    return {k: v if isinstance(v, str) else json.dumps(v) for k, v in json.loads(text).items()}
