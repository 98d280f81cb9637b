"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import pieces, text_buffer

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3)
#: Labelled rows that the model is fitted and calibrated on, at most (those of lowest hashed id).
TRAIN_ROWS = 4_000
UNKNOWN = "und"


@dataclass
class Model:
    classes: list[str]
    weights: np.ndarray  # buckets x classes, mostly zero
    bias: np.ndarray
    idf: np.ndarray
    temperature: float


def _lower() -> np.ndarray:
    """Lower-case code points of the basic plane, where one letter stays one letter."""
    table = np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        if len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    return table


_LOWER = _lower()


def char_grams(text) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece: first and last text; text number, bucket and count of each distinct n-gram of characters."""
    buf, off = text_buffer(text)
    for a, b in pieces(off, 1 << 18):
        part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        if not len(part):
            e = np.zeros(0, np.int64)
            yield a, b, e, e, e
            continue
        starts = np.cumsum((part & 0xC0) != 0x80)
        co = np.r_[0, starts[o[1:] - 1]] if o[0] == 0 and o[1] > 0 else np.r_[0, np.where(o[1:] > 0, starts[np.maximum(o[1:] - 1, 0)], 0)]
        cp = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
        cp = np.where(cp < 0x10000, _LOWER[np.minimum(cp, 0xFFFF)], cp)
        doc = np.repeat(np.arange(b - a, dtype=np.uint32), np.diff(co))
        keys = []
        h = np.zeros(len(cp), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            m = len(cp) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint32(0x01000193) + cp[n - 1 :]
            if n in ORDERS:
                g = h * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
                key = (doc[:m].astype(np.uint64) << np.uint64(BUCKET_BITS)) | (g >> np.uint32(32 - BUCKET_BITS)).astype(np.uint64)
                keys.append(key[doc[:m] == doc[n - 1 :]] if n > 1 else key)
        key = np.sort(np.concatenate(keys))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        times = np.diff(np.r_[first, len(key)])
        key = key[first].astype(np.int64)
        yield a, b, key >> BUCKET_BITS, key & (BUCKETS - 1), times


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each bucket occurs, and their number."""

    def count(batches):
        df, n = np.zeros(BUCKETS + 1, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for *_, bucket, _ in char_grams(batch.column("text")):
                df[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
        df[BUCKETS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["bucket", "n"])

    # BUCKETS + 1 rows at most come back.
    got = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return df[:BUCKETS], int(df[BUCKETS])


def _tfidf(d: np.ndarray, bucket: np.ndarray, times: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    x = (1 + np.log(times)) * idf[bucket]
    norm = np.sqrt(np.bincount(d, weights=x * x, minlength=n))
    return x / np.maximum(norm, 1e-12)[d]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: list[str], idf: np.ndarray, l1: float = 2e-2, l2: float = 1e-4, alpha: float = 1.0, beta: float = 1.0, epochs: int = 4, batch: int = 8, seed: int = 0) -> Model:
    """FTRL-proximal with elastic net, then a temperature on every tenth row, held out.

    rows: (buckets, tf-idf values) of each document; y: class numbers.
    """
    rng = np.random.default_rng(seed)
    c = len(classes)
    z, n = np.zeros((BUCKETS, c)), np.zeros((BUCKETS, c))
    bias, bias_seen = np.zeros(c), np.ones(c)

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    every = np.arange(len(rows))
    held = every[every % 10 == 9]
    learn = np.setdiff1d(every, held)
    for _ in range(epochs):
        order = rng.permutation(learn)
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            f = np.concatenate([rows[i][0] for i in pick])
            x = np.concatenate([rows[i][1] for i in pick])
            d = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            at, back = np.unique(f, return_inverse=True)
            w = weights(at)
            logits = np.stack([np.bincount(d, weights=x * w[back, k], minlength=len(pick)) for k in range(c)], axis=1) + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            g = np.stack([np.bincount(back, weights=x * p[d, k], minlength=len(at)) for k in range(c)], axis=1)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
            gb = p.sum(0)
            bias_seen += gb * gb
            bias -= 0.1 * gb / np.sqrt(bias_seen)
    model = Model(classes, weights(slice(None)).astype(np.float32), bias, idf, 1.0)
    if len(held):
        logits = np.stack([model.weights[rows[i][0]].T.astype(float) @ rows[i][1] for i in held]) + bias
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        losses = []
        for t in grid:
            s = logits / t
            s = s - s.max(1, keepdims=True)
            losses.append(-(s[np.arange(len(held)), y[held]] - np.log(np.exp(s).sum(1))).mean())
        model.temperature = float(grid[int(np.argmin(losses))])
    return model


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Fit on at most train_rows of the rows with a label and a text; document frequencies are of all rows.

    The sample is the rows of lowest hashed id (ties by text hash), so it is
    the same at every run; rows of it that repeat an id and text count once,
    with the first of their labels.
    """
    df, n = document_frequencies(docs, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1
    own = docs.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label"))
    own = own.where("label is not null and text <> ''").withColumns({"k": F.xxhash64("doc_id"), "t": F.xxhash64("text")})
    # Only hashes are sorted for the cut; the texts of the sample alone are read after it.
    cut = own.select("k", "t").orderBy("k", "t").limit(train_rows).agg(F.max(F.struct("k", "t")).alias("m")).collect()[0]["m"]
    if cut is None:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), idf, 1.0)
    own = own.where(F.struct("k", "t") <= F.struct(F.lit(cut["k"]).alias("k"), F.lit(cut["t"]).alias("t")))
    own = own.groupBy("k", "t").agg(F.min(F.struct("label", "text")).alias("r")).select("k", "t", "r.label", "r.text")  # train_rows rows at most

    def extract(batches):
        for batch in batches:
            for a, b, d, bucket, times in char_grams(batch.column("text")):
                cut = np.searchsorted(d, np.arange(b - a + 1))
                pack = lambda v, t: pa.array([v[i:j].astype(t).tobytes() for i, j in zip(cut, cut[1:])], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(a, b - a), batch.column("t").slice(a, b - a), batch.column("label").slice(a, b - a), pack(bucket, "<u2"), pack(times, "<u4")], names=["k", "t", "label", "bucket", "times"])

    got = own.select("k", "t", "label", "text").mapInArrow(extract, "k bigint, t bigint, label string, bucket binary, times binary").toArrow()
    got = got.sort_by([("k", "ascending"), ("t", "ascending"), ("label", "ascending")])
    labels = got.column("label").to_pylist()
    classes = sorted(set(labels))
    rows = []
    for bucket, times in zip(got.column("bucket").to_pylist(), got.column("times").to_pylist()):
        b, t = np.frombuffer(bucket, "<u2").astype(np.int64), np.frombuffer(times, "<u4")
        rows.append((b, _tfidf(np.zeros(len(b), np.int64), b, t, idf, 1)))
    return fit(rows, np.array([classes.index(x) for x in labels]), classes, idf)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of each row and its calibrated probability.

    Null and empty texts, and all texts where there was nothing to learn from,
    get 'und' and probability 0.  Each row is judged by itself on its whole
    text, capitals of the basic plane lowered: repeated rows get equal results;
    ties go to the first language in alphabetical order.  Returns doc_id, predicted_lang and probability; other
    columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        names = np.array([*m.classes, UNKNOWN], dtype=object)
        c = len(m.classes)
        table = m.weights * m.idf[:, None].astype(np.float32)
        squared = (m.idf**2).astype(np.float32)
        for batch in batches:
            best, prob = np.full(batch.num_rows, c), np.zeros(batch.num_rows)
            for a, b, d, bucket, times in char_grams(batch.column("text")):
                if not len(d):
                    continue
                tf = (1 + np.log(times)).astype(np.float32)
                heads = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                norm = np.sqrt(np.add.reduceat(tf * tf * squared[bucket], heads))
                logits = (np.add.reduceat(table[bucket] * tf[:, None], heads, axis=0) / norm[:, None] + m.bias) / m.temperature
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                at = a + d[heads]
                if c > 1 or m.classes != [UNKNOWN]:
                    best[at], prob[at] = p.argmax(1), p.max(1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(prob)], names=["doc_id", "predicted_lang", "probability"])

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {id_type}, predicted_lang string, probability double")
