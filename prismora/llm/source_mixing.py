"""Weighted sampling of sources to target token weights."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._names import fresh
from ._shared import written
from ._text import word_counts

#: Share of a source among the targets: its tokens to this power.
ALPHA = 0.7
#: Parts of the key range whose token sums are found first.
BUCKETS = 4096
NOISE = "|%&$#*!~^"
#: What lower weights count as.
LEAST_WEIGHT = 0.01


def _count(batches):
    for batch in batches:
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(word_counts(batch.column("text")))], names=[*names, "n_tokens"])


def quality_weight(text) -> Column:
    """1 less eight times the share of noise signs in a text, 0.05 at least."""
    chars = F.length(text)
    noise = chars - F.length(F.translate(text, NOISE, ""))
    return F.greatest(F.lit(0.05), F.coalesce(1 - F.lit(8.0) * (noise / F.nullif(chars, F.lit(0))), F.lit(1.0)))


def _weight(text, weight_col: str | None) -> Column:
    if weight_col is None:
        return quality_weight(text)
    w = F.col(f"`{weight_col}`").cast("double")
    return F.greatest(F.lit(LEAST_WEIGHT), F.when(F.isnan(w), 1.0).otherwise(F.coalesce(w, F.lit(1.0))))


def _with_key(df: DataFrame, seed: int, doc_id, weight, source, names: tuple[str, str, str]) -> DataFrame:
    """df with the sampling key, its range and the null-safe source, under the given names."""
    key, bucket, skey = names
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + 1) / F.lit(float(2**52 + 1))
    df = df.withColumn(key, -F.log(u) / weight)
    df = df.withColumn(bucket, F.least(F.floor((1 - F.exp(-F.col(key))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    return df.withColumn(skey, F.concat(F.when(source.isNull(), "n").otherwise("s"), F.coalesce(source.cast("string"), F.lit(""))))


def _cuts(rows: DataFrame, targets: Mapping[str, float] | None, total_tokens: int | None, alpha: float) -> DataFrame:
    """For each source its epochs, the key range that the cut falls in, and the last row taken of that range."""
    sums = written(rows.groupBy("skey", "bucket").agg(F.sum("n_tokens").alias("tokens")), "mix-sums")
    sources = sums.groupBy("skey").agg(F.sum("tokens").alias("source_tokens"))
    if targets is None:
        share = F.pow(F.col("source_tokens").cast("double"), F.lit(alpha))
    else:
        given = [x for k, v in targets.items() for x in (F.lit("n" if k is None else f"s{k}"), F.lit(float(v)))]
        share = F.coalesce(F.element_at(F.create_map(*given), F.col("skey")), F.lit(0.0)) if given else F.lit(0.0)
    sources = sources.withColumn("share", share)
    whole = sources.agg(F.sum("share").alias("shares"), F.max(F.when(F.col("share") > 0, F.col("source_tokens") / F.col("share"))).alias("most"))
    total = F.col("most") * F.col("share") if total_tokens is None else F.when(F.col("shares") > 0, F.col("share") / F.col("shares") * F.lit(total_tokens))
    sources = sources.crossJoin(F.broadcast(whole)).withColumn("budget", F.coalesce(F.floor(total + 0.5), F.lit(0)).cast("bigint"))  # whole: one row
    sources = sources.select("skey", F.floor(F.col("budget") / F.col("source_tokens")).alias("epochs"), (F.col("budget") % F.col("source_tokens")).alias("rest"))
    ranges = sums.select("skey", "bucket", "tokens", (F.sum("tokens").over(Window.partitionBy("skey").orderBy("bucket")) - F.col("tokens")).alias("before"))
    # The rest is less than a source's tokens, so exactly one range holds the cut.
    cut = ranges.join(sources, "skey").where("before <= rest and rest < before + tokens").select("skey", F.col("bucket").alias("cut_bucket"), "before", "epochs", "rest")
    inside = rows.join(cut, (rows["skey"] == cut["skey"]) & (rows["bucket"] == cut["cut_bucket"])).select(cut["skey"], "cut_bucket", "before", "rest", "key", "doc_id", "n_tokens")
    running = F.col("before") + F.sum("n_tokens").over(Window.partitionBy("skey", "cut_bucket").orderBy("key", "doc_id"))  # ties together
    last = inside.withColumn("running", running).where("running <= rest").groupBy("skey").agg(F.max(F.struct("key", "doc_id")).alias("cut"))
    return written(cut.join(last, "skey", "left").select("skey", "cut_bucket", F.col("epochs").cast("int").alias("epochs"), "cut"), "mix-cuts")


def _rows(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str, weight_col: str | None) -> DataFrame:
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"), _weight(F.col(f"`{text_col}`"), weight_col).alias("weight"))
    own = _with_key(own, seed, F.col("doc_id"), F.col("weight"), F.col("source"), ("key", "bucket", "skey")).drop("weight")
    types = {c: own.schema[c].dataType.simpleString() for c in ("doc_id", "source", "key", "bucket", "skey")}
    return written(own.mapInArrow(_count, ", ".join(f"{c} {t}" for c, t in types.items()) + ", n_tokens bigint"), "mix-rows")


def mixture(docs: DataFrame, targets: Mapping[str, float] | None = None, total_tokens: int | None = None, alpha: float = ALPHA, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """How often each document goes into a mixture with the target weights.

    targets: weight of each source (others get 0); by default tokens ** alpha.
    total_tokens: tokens of the mixture; by default as many as give every
    source one complete epoch at least.
    weight_col: the documents' quality weights, a classifier's scores say; a
    null or NaN counts as 1, less than LEAST_WEIGHT as that.  Without such a
    column a text's share of noise signs gives them.

    A source's budget is its share of total_tokens, rounded.  It holds as many
    complete epochs as fit; the rest is filled by Efraimidis-Spirakis
    sampling without replacement: each document has the exponential key
    -ln(u) / weight, u from a hash of seed and id; by rising key, documents are taken as long as their running tokens stay in
    the rest.  The running sums are two-level (sums of key ranges, then the
    rows of the one range with the cut), so a hot source spreads over many
    tasks and no source is sorted as a whole.

    Returns doc_id, source, n_tokens, epochs and copies for each row.  A null
    source is a source of its own; a null id is an id.  Documents without
    tokens get 0 copies.  Repeated rows are sampled as rows; rows with one id
    and key are taken together or not at all.  An empty table gives an empty
    result.  Other columns are not read.
    """
    rows = _rows(docs, seed, id_col, text_col, source_col, weight_col)
    cuts = _cuts(rows.where("n_tokens > 0"), targets, total_tokens, alpha)
    placed = rows.join(cuts, "skey", "left")
    taken = (F.col("bucket") < F.col("cut_bucket")) | ((F.col("bucket") == F.col("cut_bucket")) & (F.struct("key", "doc_id") <= F.col("cut")))
    epochs = F.when(F.col("n_tokens") == 0, 0).otherwise(F.coalesce("epochs", F.lit(0)))
    copies = F.when(F.col("n_tokens") == 0, 0).otherwise(epochs + F.when(taken, 1).otherwise(0))
    return placed.select("doc_id", "source", "n_tokens", epochs.cast("int").alias("epochs"), copies.cast("int").alias("copies"))


def mix(docs: DataFrame, targets: Mapping[str, float] | None = None, total_tokens: int | None = None, alpha: float = ALPHA, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None) -> DataFrame:
    """The documents, each row as often as mixture() says; columns as given.

    A row's copies follow from its own key and its source's cut, so the texts
    meet a table of one row a source and aren't shuffled for it.  Null ids and
    sources, ties, repeated rows and weights are treated as mixture() says;
    documents with null, empty or white text go; of an empty table nothing is
    left.
    """
    cuts = _cuts(_rows(docs, seed, id_col, text_col, source_col, weight_col).where("n_tokens > 0"), targets, total_tokens, alpha)
    key, bucket, skey = (fresh(docs, f"mix_{x}") for x in ("key", "bucket", "skey"))
    b, e, c, n = (fresh(docs, f"mix_{x}") for x in ("cut_bucket", "epochs", "cut", "copies"))
    cuts = cuts.select(F.col("skey").alias(skey), F.col("cut_bucket").alias(b), F.col("epochs").alias(e), F.col("cut").alias(c))
    text = F.col(f"`{text_col}`")
    left = _with_key(docs.where(text.rlike(r"[^ \t\n\x0B\f\r]")), seed, F.col(f"`{id_col}`"), _weight(text, weight_col), F.col(f"`{source_col}`"), (key, bucket, skey)).join(cuts, skey)
    same = F.struct(F.col(key).alias("key"), F.col(f"`{id_col}`").alias("doc_id")) <= F.col(c)
    taken = (F.col(bucket) < F.col(b)) | ((F.col(bucket) == F.col(b)) & same)
    left = left.withColumn(n, F.col(e) + F.when(taken, 1).otherwise(0)).where(F.col(n) > 0)
    return left.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"`{x}`") for x in docs.columns])
