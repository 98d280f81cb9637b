"""Votes, clusters and links between entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import written
from ..functions.text import comparison_key, norm_title, person_name, sequence_ratio, tokenize, word_jaccard, word_overlap


def majority(votes: DataFrame, key: str, value: str, unknown: str = "unknown", hint: Column | None = None) -> DataFrame:
    """(key, value, n, tied): the value with most votes; unknown ones count only alone.

    Ties fall to the hinted value where it is among them, else to the first in
    alphabetical order; `tied` lists all of them.
    """
    counts = votes.groupBy(key, value).agg(F.count("*").alias("n"), *([F.first(hint, True).alias("_h")] if hint is not None else []))
    if hint is None:
        counts = counts.withColumn("_h", F.lit(None).cast("string"))
    real = F.max(F.when(F.col(value) != unknown, 1).otherwise(0)).over(Window.partitionBy(key))
    pool = counts.withColumn("_real", real).where((F.col("_real") == 0) | (F.col(value) != unknown))
    top = pool.withColumn("_top", F.max("n").over(Window.partitionBy(key))).where("n = _top")
    out = top.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("tied"), F.max("n").alias("n"), F.first("_h", True).alias("_h"))
    chosen = F.when(F.array_contains("tied", F.coalesce("_h", F.lit(""))), F.col("_h")).otherwise(F.get("tied", F.lit(0)))
    return out.select(key, chosen.alias(value), "n", "tied")


def conflicts(facts: DataFrame, key: str, *values: str) -> DataFrame:
    """Keys with several distinct facts, and these."""
    return facts.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*values))).alias("facts")).where(F.size("facts") > 1)


def preferred_spelling(names: DataFrame, group: str, name: str, position: str) -> DataFrame:
    """The most used spelling of each group, ties by position."""
    n = names.groupBy(group, name).agg(F.count("*").alias("n"), F.min(position).alias("p"))
    return n.groupBy(group).agg(F.max_by(name, F.struct("n", -F.col("p"))).alias(name), F.max("n").alias("n"))


def evidence_sets(sources: list[DataFrame], key: str, values: list[str]) -> DataFrame:
    """For each key the sorted set of each value over all sources."""
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s, allowMissingColumns=True)
    return rows.groupBy(key).agg(*[F.array_sort(F.collect_set(v)).alias(v) for v in values])


def name_clusters(names: DataFrame, name: str, category: str, account: str) -> DataFrame:
    """Spellings of one name by category and comparison key: the chosen one, the variants and the accounts.

    The chosen spelling has most rows, then mixed case, then most letters
    beyond ASCII, then is the longest, then the first.
    """
    shaped = names.select(category, account, person_name(F.col(name)).alias("p")).where(F.col("p.value").isNotNull())
    rows = shaped.select(category, account, F.col("p.value").alias("formatted"), comparison_key(F.col("p.value")).alias("name_key"))
    per = rows.groupBy(category, "name_key", "formatted").agg(F.count("*").alias("n"), F.collect_set(account).alias("ids"))
    f = F.col("formatted")
    mixed = ((F.lower(f) != f) & (F.upper(f) != f)).cast("int")
    marks = F.length(F.regexp_replace(f, r"[\x00-\x7F]", ""))
    score = F.struct("n", mixed.alias("a"), marks.alias("b"), F.length(f).alias("c"))
    best = F.struct(score.alias("s"), F.transform(F.split(f, ""), lambda c: -F.ascii(c)).alias("t"))
    return per.groupBy(category, "name_key").agg(
        F.max_by("formatted", best).alias("canonical_name"), F.array_sort(F.collect_set("formatted")).alias("variants"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("accounts"), F.sum("n").alias("n"),
    )


def dominant(counts: DataFrame, key: str, value: str, n: str = "n") -> DataFrame:
    """The five most frequent values of each key; dominant is the first if it has two and twice the second's."""
    w = Window.partitionBy(key).orderBy(F.col(n).desc(), F.col(value).asc())
    ranked = counts.withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    out = ranked.groupBy(key).agg(F.max(F.when(F.col("rank") == 1, F.struct(value, n))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col(n))).alias("b"), F.count("*").alias("listed"))
    clear = (F.col(f"a.{n}") >= 2) & (F.col(f"a.{n}") >= 2 * F.coalesce("b", F.lit(0)))
    return out.select(key, F.col(f"a.{value}").alias(value), F.col(f"a.{n}").alias(n), clear.alias("dominant"), "listed")


def title_links(left: DataFrame, right: DataFrame, left_id: str, left_title: str, right_id: str, right_title: str) -> DataFrame:
    """For each left title its best right one: exact, then prefix, then most shared words.

    All titles that match meet, without a cross join: equal ones by an equi-join
    on the title, prefixes by one on the heads of six words or more.  Where the
    Jaccard similarity reaches 0.75, at most a quarter of a title's words are
    missing from the other, so both share one of their floor(n / 4) + 1 rarest.
    Of equal right titles only that of the least id takes part.
    """
    a = left.select(F.col(left_id).alias("l"), norm_title(F.col(left_title)).alias("lt")).where("lt <> ''")
    b = right.select(F.col(right_id).alias("r"), norm_title(F.col(right_title)).alias("rt")).where("rt <> ''").groupBy("rt").agg(F.min("r").alias("r"))
    targets = a.select("lt").distinct()
    exact = targets.join(b, F.col("lt") == F.col("rt")).select("lt", "r", F.lit("exact").alias("how"), F.lit(1.0).alias("score"))

    def heads(df: DataFrame, t: str) -> DataFrame:
        words = F.split(t, " ")
        ends = F.when(F.size(words) > 6, F.sequence(F.lit(6), F.size(words) - 1))
        return df.withColumn("key", F.explode(F.transform(ends, lambda k: F.xxhash64(F.array_join(F.slice(words, 1, k), " ")))))

    whole = lambda df, t: df.where(F.size(F.split(t, " ")) >= 6).withColumn("key", F.xxhash64(t))
    longer = whole(targets, "lt").join(heads(b, "rt"), "key").where(F.col("rt").startswith(F.concat("lt", F.lit(" "))))
    shorter = heads(targets, "lt").join(whole(b, "rt"), "key").where(F.col("lt").startswith(F.concat("rt", F.lit(" "))))
    prefix = longer.unionByName(shorter).select("lt", "r", F.lit("prefix").alias("how"), word_jaccard(F.col("rt"), F.col("lt")).alias("score"))

    words = lambda df, t: df.withColumn("w", F.explode(F.array_distinct(F.split(t, " "))))
    df = words(b.select("rt"), "rt").groupBy("w").agg(F.count("*").alias("df"))

    def rarest(df_: DataFrame, by: list[str], ws: str, at: str) -> DataFrame:
        counted = words(df_, by[0]).join(df, "w", "left")  # words that the right side lacks count too
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w")))
        own = counted.groupBy(*by).agg(order.getField("w").alias(ws))
        return own.select(*by, ws, F.posexplode(F.slice(ws, F.lit(1), F.floor(F.size(ws) / 4).cast("int") + 1)).alias(at, "w"))

    n, m = F.size("lw"), F.size("rw")
    # What is left from the first shared word on bounds the shared words.
    near = rarest(targets, ["lt"], "lw", "la").join(rarest(b, ["rt", "r"], "rw", "ra"), "w").where(7 * F.least(n - F.col("la"), m - F.col("ra")) >= 3 * (n + m))
    shared = F.size(F.array_intersect("lw", "rw"))
    fuzzy = near.select("lt", "r", F.lit("fuzzy").alias("how"), (shared / (n + m - shared)).alias("score")).where("score >= 0.75")

    found = exact.unionByName(prefix).unionByName(fuzzy)
    rank = F.when(F.col("how") == "exact", 0).when(F.col("how") == "prefix", 1).otherwise(2)
    best = F.min_by(F.struct("r", "how", "score"), F.struct(rank, -F.col("score"), F.col("r"))).alias("m")
    per_title = found.groupBy("lt").agg(best).select("lt", "m.*")
    return a.join(per_title, "lt").groupBy("l").agg(best).select(F.col("l").alias(left_id), F.col("m.r").alias(right_id), "m.how", "m.score")


def same_work(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """same where the texts' matching blocks reach 0.70 or their words overlap by 0.85 of the shorter."""
    x, y = norm_title(F.col(a)), norm_title(F.col(b))
    return pairs.withColumn("overlap", word_overlap(x, y)).withColumn("ratio", sequence_ratio(x, y)).withColumn("same", (F.col("ratio") >= 0.70) | (F.col("overlap") >= 0.85))


def containment(items: DataFrame, item_id: str, item_text: str, docs: DataFrame, doc_id: str, doc_text: str, least: float) -> DataFrame:
    """Pairs where a document holds at least that share of an item's distinct words.

    A document that holds it has one of the item's (1 - least) n + 1 rarest
    words, so common words bring nothing together: candidates come from an
    equi-join on these, and their shared words are counted exactly.  Words that
    no item has are dropped before they are shuffled.
    """
    word = lambda df, i, t: df.select(F.col(i), F.explode(F.array_distinct(tokenize(F.lower(F.col(t))))).alias("w"))
    a = word(items, item_id, item_text).distinct()
    b = written(word(docs, doc_id, doc_text).join(a.select("w").distinct(), "w", "left_semi"), "item-words")
    df = b.groupBy("w").agg(F.count("*").alias("df"))
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w")))
    sized = a.join(df, "w", "left").groupBy(item_id).agg(order.getField("w").alias("ws"))
    prefix = F.size("ws") - F.ceil(F.size("ws") * F.lit(least) - 1e-9).cast("int") + 1
    rare = sized.select(item_id, F.explode(F.slice("ws", F.lit(1), F.least(prefix, F.size("ws")))).alias("w"))
    # Words repeat, so their table is small as a file and large in memory: never broadcast it by its size.
    found = rare.join(b.hint("merge"), "w").select(item_id, doc_id).distinct()
    shared = found.join(a, item_id).join(b.hint("merge"), [doc_id, "w"]).groupBy(item_id, doc_id).agg(F.count_distinct("w").alias("shared"))
    return shared.join(sized.select(item_id, F.size("ws").alias("size")), item_id).select(item_id, doc_id, "shared", (F.col("shared") / F.col("size")).alias("share")).where(F.col("share") >= least)


def cascade(left: DataFrame, steps: list[tuple[str, DataFrame, list[str]]], value: str) -> DataFrame:
    """Left joins in order of trust; the first that has a value gives it and its step's name."""
    out, names = left, []
    for k, (name, right, on) in enumerate(steps):
        out = out.join(right.select(*on, F.col(value).alias(f"_c{k}")), on, "left")
        names.append((name, f"_c{k}"))
    step = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(n)) for n, c in names], F.lit("unverified"))
    return out.withColumn(value, F.coalesce(*[F.col(c) for _, c in names])).withColumn("match", step).drop(*[c for _, c in names])


def aligned_byline(names: DataFrame, found: DataFrame, record: str, pos: str, key: str, values: list[str]) -> DataFrame:
    """Each name of a byline with the found row of that name, each row used once, in order; shells (nulls) for the rest."""
    number = lambda df, o: df.withColumn("_n", F.row_number().over(Window.partitionBy(record, key).orderBy(o)))
    side = number(found, pos).select(record, key, "_n", *values, F.lit(True).alias("matched"))
    return number(names, pos).join(side, [record, key, "_n"], "left").drop("_n").withColumn("matched", F.coalesce("matched", F.lit(False)))


def two_key_lookup(left: DataFrame, table: DataFrame, raw: str, value: str) -> DataFrame:
    """By the exact text, else by the first row with an equal comparison key."""
    exact = table.groupBy(raw).agg(F.min(value).alias("_e"))
    loose = table.withColumn("_k", comparison_key(F.col(raw))).groupBy("_k").agg(F.min_by(value, F.col(raw)).alias("_l"))
    out = left.join(exact, raw, "left").withColumn("_k", comparison_key(F.col(raw))).join(loose, "_k", "left")
    return out.withColumn(value, F.coalesce("_e", "_l")).drop("_e", "_l", "_k")


def ordered_outer(old: DataFrame, new: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Old rows in their order with nulls filled from new, then new rows that the old lacks, in theirs."""
    a = old.select(*keys, F.col(order).alias("_a"), F.col(value).alias("_va"))
    b = new.select(*keys, F.col(order).alias("_b"), F.col(value).alias("_vb"))
    out = a.join(b, keys, "full_outer")
    w = Window.partitionBy(*keys[:-1]).orderBy(F.col("_a").isNull().asc(), "_a", "_b", keys[-1])
    return out.select(*keys, (F.row_number().over(w) - 1).cast("int").alias(order), F.coalesce("_va", "_vb").alias(value))


def changed_fields(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after) where the two sides differ, arrays as sets."""
    text = lambda df, c: F.array_join(F.array_sort(c), ";") if df.schema[c].dataType.simpleString().startswith("array") else F.col(c).cast("string")
    tall = lambda df, n: df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text(df, f).alias("v")) for f in fields])).alias("e")).select(key, "e.field", F.col("e.v").alias(n))
    return tall(old, "before").join(tall(new, "after"), [key, "field"]).where(~F.col("before").eqNullSafe(F.col("after")))


def coverage(rows: DataFrame, publication: str, identity: str, affiliation: str) -> DataFrame:
    """Per publication: identities, those with an affiliation, and a status."""
    per = rows.groupBy(publication, identity).agg(F.max(F.col(affiliation).isNotNull() & (F.col(affiliation) != "")).alias("has"), F.array_sort(F.collect_set(affiliation)).alias("names"))
    out = per.groupBy(publication).agg(F.count("*").alias("identities"), F.count_if("has").alias("covered"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("affiliations"))
    status = F.when(F.col("covered") == 0, "none").when(F.col("covered") < F.col("identities"), "partial").otherwise("full")
    return out.withColumn("status", status)
