"""URL filter: gradient-boosted trees on lexical features and suffix statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._names import fresh
from ._shared import written

#: Labelled URLs that the trees are fitted on, at most (those of lowest hash).
TRAIN_ROWS = 40_000
TREES = 80
DEPTH = 4
#: Parts of the labelled URLs, by hash: a part's statistics are of the others, and it is held out once to find the number of trees.
FOLDS = 5
THRESHOLD = 0.5
FEATURES = [
    "length", "host_length", "path_length", "query_length", "depth", "host_labels", "digit_ratio", "host_digits", "upper_ratio", "hyphens", "entropy",
    "params", "escapes", "has_fragment", "secure", "has_port", "extension", "longest_segment", "sign_ratio",
    "suffix_rate", "suffix_count", "domain_rate", "domain_count",
]


@dataclass
class Trees:
    """Complete binary trees: feature and threshold of each inner node, value of each leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray


def _host(u: Column) -> Column:
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", ""), r":[0-9]*$", ""))


def lexical(df: DataFrame, url: Column) -> DataFrame:
    """df with the lexical features of a URL column, and its suffix and domain as _suffix and _domain."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    host = _host(u)
    tail = F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"^[^/?#]*", "")
    path = F.regexp_extract(tail, r"^([^?#]*)", 1)
    query = F.regexp_extract(tail, r"\?([^#]*)", 1)
    segments = F.split(path, "/")
    of = lambda s, chars: F.length(s) - F.length(F.translate(s, chars, ""))
    digits = "0123456789"
    count = lambda c: (F.length(u) - F.length(F.replace(u, c, F.lit("")))).cast("double")
    entropy = F.aggregate(F.filter(F.array_distinct(F.split(u, "")), lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - count(c) / n * F.log2(count(c) / n))
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    cols = {
        "length": F.length(u), "host_length": F.length(host), "path_length": F.length(path), "query_length": F.length(query),
        "depth": F.size(F.filter(segments, lambda x: x != "")), "host_labels": F.size(labels), "digit_ratio": of(u, digits) / n, "host_digits": of(host, digits),
        "upper_ratio": of(u, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n, "hyphens": of(u, "-_"), "entropy": entropy,
        "params": F.when(query == "", 0).otherwise(of(query, "&;") + 1), "escapes": of(u, "%"), "has_fragment": u.contains("#"), "secure": F.lower(u).startswith("https:"),
        "has_port": F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.-]*://", "").rlike(r"^[^/?#]*:[0-9]+"), "extension": F.length(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)),
        "longest_segment": F.coalesce(F.array_max(F.transform(segments, F.length)), F.lit(0)), "sign_ratio": of(u, "=&?%~+,;!$'()*@") / n,
    }
    out = df.withColumns({f"f_{k}": (v.cast("int") if k in ("has_fragment", "secure", "has_port") else v).cast("float") for k, v in cols.items()})
    return out.withColumns({"_suffix": F.coalesce(F.element_at(F.when(F.size(labels) > 0, labels), -1), F.lit("")), "_domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")})


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]


def _base(y: np.ndarray) -> float:
    p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    return float(np.log(p / (1 - p)))


def _loss(margin: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, margin).sum() - margin @ y)


def _boosted(code: np.ndarray, edges: list[np.ndarray], y: np.ndarray, fits: np.ndarray, trees: int, depth: int, rate: float, l2: float, least: int) -> tuple[Trees, list[float]]:
    """Trees grown on the rows `fits`, and the loss on the others before the first tree and after each."""
    n, f = code.shape
    inner = (1 << depth) - 1
    out = Trees(_base(y[fits]), np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, 1 << depth)))
    # A row's bin of each feature, and the bin that a node splits above; a node without a split sends all to the left.
    above = np.full((trees, inner), 1 << 30)
    margin = np.full(n, out.base)
    losses = [_loss(margin[~fits], y[~fits])]
    mine = code[fits]
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin[fits]))
        g, h = p - y[fits], p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            best = np.full(width, 1e-6)
            own = node[fits]
            for j in range(f):
                m = len(edges[j]) + 1
                if m == 1:
                    continue
                key = own * m + mine[:, j]
                gs, hs, cs = (np.bincount(key, weights=w, minlength=width * m).reshape(width, m).cumsum(1) for w in (g, h, None))
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(cs < least) | (ct - cs < least)] = 0
                gain = gain[:, :-1]
                at = gain.argmax(1)
                value = gain[np.arange(width), at]
                better = value > best
                best[better] = value[better]
                out.feature[t, first : first + width][better] = j
                out.threshold[t, first : first + width][better] = edges[j][at[better]]
                above[t, first : first + width][better] = at[better]
            node = 2 * node + (code[np.arange(n), out.feature[t, first + node]] > above[t, first + node])
        own = node[fits]
        gs, hs = np.bincount(own, weights=g, minlength=1 << depth), np.bincount(own, weights=h, minlength=1 << depth)
        out.leaf[t] = -rate * gs / (hs + l2)
        margin += out.leaf[t][node]
        losses.append(_loss(margin[~fits], y[~fits]))
    return out, losses


def fit_trees(x: np.ndarray, y: np.ndarray, fold: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = 0.1, bins: int = 64, l2: float = 5.0, least: int = 20) -> Trees:
    """Histogram gradient boosting on the logistic loss with second-order leaves.

    Each fold is held out once; the trees are as many, `trees` at most, as
    give the least loss over all held-out rows.  Where addresses tell nothing
    about labels these are few or none, and every score is near the base rate.
    """
    edges = _edges(x, bins) if len(x) else []
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.int32) if len(x) else np.zeros((0, x.shape[1]), np.int32)
    parts = np.unique(fold)
    if len(parts) > 1:
        losses = np.sum([_boosted(code, edges, y, fold != k, trees, depth, rate, l2, least)[1] for k in parts], axis=0)
        trees = int(losses.argmin())
    else:
        trees = 0  # nothing to hold out
    return _boosted(code, edges, y, np.ones(len(y), bool), trees, depth, rate, l2, least)[0]


def predict(model: Trees, x: np.ndarray) -> np.ndarray:
    """Probability of an acceptable URL."""
    margin = np.full(len(x), model.base)
    depth = model.leaf.shape[1].bit_length() - 1
    row = np.arange(len(x))
    for t in range(len(model.leaf)):
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            at = (1 << level) - 1 + node
            node = 2 * node + (x[row, model.feature[t, at]] > model.threshold[t, at])
        margin += model.leaf[t][node]
    return 1 / (1 + np.exp(-margin))


def _suffixes(pages: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """URLs with each suffix among all pages, and labelled URLs and good ones among these: of all, and of each fold."""
    k = f"_{key}"
    every = pages.groupBy(k).agg(F.count("*").alias(f"{key}_all"))
    each = [F.struct(F.count_if(F.col("fold") == i).alias("n"), F.sum(F.when(F.col("fold") == i, F.col("good")).otherwise(0)).alias("good")) for i in range(FOLDS)]
    known = labelled.groupBy(k).agg(F.count("*").alias(f"{key}_n"), F.sum("good").alias(f"{key}_good"), F.array(*each).alias(f"{key}_folds"))
    return every.join(known, k, "left")


def _with_statistics(df: DataFrame, tables: dict[str, DataFrame], base: float, fold: Column | None) -> DataFrame:
    """The share of good labelled URLs with the suffix, smoothed to the base rate by ten; fold: the row's own, whose labels are left out."""
    for key, table in tables.items():
        df = df.join(table if fold is not None else table.drop(f"{key}_folds"), f"_{key}", "left")
        good, n = F.coalesce(f"{key}_good", F.lit(0)), F.coalesce(f"{key}_n", F.lit(0))
        if fold is not None:
            own = F.get(f"{key}_folds", fold)
            good, n = good - F.coalesce(own["good"], F.lit(0)), n - F.coalesce(own["n"], F.lit(0))
        rate = (good + 10.0 * base) / (n + 10.0)
        df = df.withColumns({f"f_{key}_rate": rate.cast("float"), f"f_{key}_count": F.log1p(F.coalesce(f"{key}_all", F.lit(0)).cast("double")).cast("float")})
    return df


def score_urls(pages: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The chance that each page's URL leads to an acceptable page, and whether it is kept.

    labelled: columns url and good (0 or 1).  Suffix statistics (of the last
    host label and the last two) count all pages and all labelled URLs; the
    trees are fitted on at most train_rows labelled URLs, those of lowest
    hash, with statistics of the URLs outside their own fold: a row's label,
    and that of its repeats, never comes into its own features.

    Returns page_id, url_score and keep for each row; a score equal to the
    threshold is kept.  A null or empty URL has the features of an empty one;
    labelled rows with a null URL or label are left out; without any labelled
    URL all scores are 0.5.  Rows that repeat are scored alike; an empty table
    gives an empty result.  Of other columns none is read.
    """
    spark = pages.sparkSession
    rows = lexical(pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url")), F.col("url")).drop("url")
    rows = written(rows, "url-features")
    known = labelled.where("url is not null and good is not null").select("url", F.col("good").cast("int").alias("good"))
    known = known.withColumn("h", F.xxhash64("url")).withColumn("fold", F.pmod(F.shiftright("h", 8), F.lit(FOLDS)).cast("int"))
    known = written(lexical(known, F.col("url")), "url-labelled")
    tables = {k: written(_suffixes(rows, known, k), f"url-{k}") for k in ("suffix", "domain")}
    base = known.agg(F.coalesce(F.avg("good"), F.lit(0.5))).collect()[0][0]
    sample = _with_statistics(known.orderBy("h", "url", "good").limit(train_rows), tables, base, F.col("fold"))
    names = [f"f_{k}" for k in FEATURES]
    # train_rows rows at most; rows of one hash differ in nothing but the label, short of a collision.
    got = sample.select("h", "good", "fold", *names).toArrow().sort_by([("h", "ascending"), *((c, "ascending") for c in ("good", "f_length", "f_entropy"))])
    x = np.stack([got.column(c).to_numpy() for c in names], axis=1) if got.num_rows else np.zeros((0, len(names)), np.float32)
    y, fold = (got.column(c).to_numpy() if got.num_rows else np.zeros(0) for c in ("good", "fold"))
    shared = spark.sparkContext.broadcast(fit_trees(x, y.astype(float), fold))

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)
            p = predict(shared.value, x)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(p), pa.array(p >= threshold)], names=["page_id", "url_score", "keep"])

    id_type = pages.schema[id_col].dataType.simpleString()
    return _with_statistics(rows, tables, base, None).select("id", *names).mapInArrow(run, f"page_id {id_type}, url_score double, keep boolean")


def labelled_pages(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """URLs of pages whose document has a label: good where its quality is 1 and it isn't toxic.

    The document's id is the number that begins the last part of the path.
    """
    k = fresh(labels, "url_doc")
    own = pages.select(F.col(f"`{url_col}`").alias("url"), F.regexp_extract(F.col(f"`{url_col}`"), r"/([0-9]{1,18})(?:\.[a-z]+)?/?(?:[?#].*)?$", 1).try_cast("bigint").alias(k))
    known = labels.select(F.col("doc_id").alias(k), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    return own.join(known, k).select("url", "good")
