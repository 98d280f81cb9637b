"""Document quality by a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._names import fresh
from ._shared import put_file, release
from ._text import WHITE, U64, pieces, span_hashes, spans, text_buffer

WORD_BITS = 18
WORD_BUCKETS = 1 << WORD_BITS
META_BUCKETS = 64
FACTORS = 8
#: Labelled rows that the model is fitted on, at most (those of lowest hashed id).
TRAIN_ROWS = 16_000
THRESHOLD = 0.5

_SIGN = np.zeros(256, bool)
_SIGN[list(b"|%&$#*!~^<>{}[]=_+@\\")] = True
#: White space and ASCII punctuation part the words that are hashed; capitals are lowered.
_APART = WHITE.copy()
_APART[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True
_STATS = 12


@dataclass
class Model:
    """Two factorisation machines over one feature space: accepted quality, and toxicity.

    table: for each feature the weight and factors of either head.
    """

    bias: np.ndarray
    table: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def _count(lut: np.ndarray, part: np.ndarray, o: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(lut[part])
    return np.searchsorted(at, o[1:]) - np.searchsorted(at, o[:-1])


def features(text, meta: list) -> Iterator[tuple]:
    """For each piece: first and last text; text number, word bucket and value of each distinct word; statistics; metadata buckets."""
    buf, off = text_buffer(text)
    tags = []
    for k, column in enumerate(meta):
        b, o = text_buffer(column)
        tags.append((span_hashes(b, o[:-1], o[1:]) + U64(k)) % U64(META_BUCKETS) if len(o) > 1 else np.zeros(0, U64))
    for a, b in pieces(off, 1 << 19):
        part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        n = b - a
        start, end, doc = spans(part, o)
        h = span_hashes(part, start, end)
        words = np.bincount(doc, minlength=n)
        low = _FOLD[part]
        ws, we, wdoc = spans(low, o, _APART)
        key = np.sort((wdoc.astype(np.int64) << WORD_BITS) | (span_hashes(low, ws, we) & U64(WORD_BUCKETS - 1)).astype(np.int64))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.r_[first, len(key)])
        key = key[first]
        d, bucket = key >> WORD_BITS, key & (WORD_BUCKETS - 1)
        value = (1 + np.log(times)).astype(np.float32)
        distinct = np.bincount(d, minlength=n)
        norm = np.sqrt(np.sqrt(np.bincount(d, weights=value * value, minlength=n)))
        value /= np.maximum(norm, 1e-9)[d].astype(np.float32)

        size = np.diff(o)
        chars = np.maximum(size, 1)
        lines = _count(_LINE, part, o) + 1
        w = np.maximum(words, 1)
        last_sign = _SIGN[part[end - 1]] if len(end) else np.zeros(0, bool)
        all_sign = last_sign & (end - start == 1)
        again = np.zeros(len(h), bool)
        if len(h):
            again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        stats = np.stack([
            np.log1p(size), np.log1p(words), np.bincount(doc, weights=end - start, minlength=n) / w,
            _count(_SIGN, part, o) / chars, _count(_UPPER, part, o) / chars, _count(_DIGIT, part, o) / chars, np.log1p(words / lines),
            distinct / w, np.bincount(doc, weights=last_sign, minlength=n) / w, np.bincount(doc, weights=all_sign, minlength=n) / w,
            np.bincount(doc, weights=again, minlength=n) / w, _count(WHITE, part, o) / chars,
        ], axis=1)
        yield a, b, d, bucket, value, stats.astype(np.float32), np.stack([t[a:b] for t in tags], axis=1).astype(np.int64) if tags else np.zeros((n, 0), np.int64)


def _standard(stats: np.ndarray, model: Model) -> np.ndarray:
    return np.clip((stats - model.mean) / model.scale, -4, 4).astype(np.float32) * np.float32(0.3)


def score(model: Model, d: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Logits of both heads for each text, in time linear in its features.

    The pairwise term is half of (sum of v x) squared less the sum of (v x)
    squared, summed over factors.
    """
    n = len(stats)
    width = model.table.shape[1]
    k = width // 2 - 1
    sums = np.zeros((n, width), np.float32)
    squares = np.zeros((n, width), np.float32)
    if len(d):
        rows = model.table[bucket] * value[:, None]
        heads = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        sums[d[heads]] = np.add.reduceat(rows, heads, axis=0)
        np.multiply(rows, rows, out=rows)
        squares[d[heads]] = np.add.reduceat(rows, heads, axis=0)
    z = _standard(stats, model)
    t = model.table[WORD_BUCKETS : WORD_BUCKETS + _STATS]
    sums += z @ t
    squares += (z * z) @ (t * t)
    for j in range(meta.shape[1]):
        r = model.table[WORD_BUCKETS + _STATS + j * META_BUCKETS + meta[:, j]] * np.float32(0.3)
        sums += r
        squares += r * r
    pairs = 0.5 * (sums * sums - squares)
    out = np.empty((n, 2))
    for head in range(2):
        c = head * (k + 1)
        out[:, head] = model.bias[head] + sums[:, c] + pairs[:, c + 1 : c + 1 + k].sum(1)
    return out


def fit(rows: list[tuple], labels: np.ndarray, factors: int = FACTORS, epochs: int = 5, rate: float = 0.3, l2: float = 3e-6, l1: float = 1e-4, toxic_weight: float = 3.0, seed: int = 0) -> Model:
    """Fit both heads with AdaGrad on mini-batches.

    l1 shrinks the linear weights of words; toxic_weight is what a toxic row
    counts for in its head, since there are few.

    rows: for each document (buckets, values, stats, meta buckets); labels: two
    columns of 0 and 1.
    """
    rng = np.random.default_rng(seed)
    n_meta = len(rows[0][3]) if rows else 0
    size = WORD_BUCKETS + _STATS + n_meta * META_BUCKETS
    width = 2 * (factors + 1)
    table = (rng.standard_normal((size, width)) * 0.05).astype(np.float32)
    table[:, [0, factors + 1]] = 0
    stats = np.array([r[2] for r in rows], np.float32).reshape(-1, _STATS)
    mean, scale = (stats.mean(0), stats.std(0) + 1e-6) if len(rows) else (np.zeros(_STATS, np.float32), np.ones(_STATS, np.float32))
    base = np.clip(labels.mean(0) if len(rows) else np.array([0.5, 0.5]), 0.01, 0.99)
    model = Model(np.log(base / (1 - base)), table, mean, scale)
    z = _standard(stats, model)
    seen = np.full((size, width), 1e-2, np.float32)
    # Bits of a document: its words, then statistics, then metadata, all as (feature, value).
    feats, values = [], []
    for i, r in enumerate(rows):
        feats.append(np.concatenate([r[0], WORD_BUCKETS + np.arange(_STATS), WORD_BUCKETS + _STATS + np.arange(n_meta) * META_BUCKETS + np.asarray(r[3], np.int64)]).astype(np.int32))
        values.append(np.concatenate([r[1], z[i], np.full(n_meta, 0.3, np.float32)]).astype(np.float32))
    batch = 64
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            f = np.concatenate([feats[i] for i in pick])
            x = np.concatenate([values[i] for i in pick])[:, None]
            count = np.array([len(feats[i]) for i in pick])
            heads = np.r_[0, np.cumsum(count)[:-1]]
            d = np.repeat(np.arange(len(pick)), count)
            w = table[f]
            vx = w * x
            sums = np.add.reduceat(vx, heads, axis=0)
            squares = np.add.reduceat(vx * vx, heads, axis=0)
            grad = np.empty_like(w)
            for head in range(2):
                c = head * (factors + 1)
                v = slice(c + 1, c + 1 + factors)
                logit = model.bias[head] + sums[:, c] + 0.5 * (sums[:, v] ** 2 - squares[:, v]).sum(1)
                err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[pick, head]).astype(np.float32)
                if head:
                    err = err * np.where(labels[pick, head] > 0, np.float32(toxic_weight), np.float32(1))
                model.bias[head] -= rate * 0.1 * err.mean()
                e = err[d][:, None]
                grad[:, c : c + 1] = e * x
                grad[:, v] = e * (x * sums[d][:, v] - vx[:, v] * x)
            grad /= len(pick)
            grad += l2 * w
            by = np.argsort(f, kind="stable")
            fs = f[by]
            u = np.flatnonzero(np.r_[True, fs[1:] != fs[:-1]])
            total = np.add.reduceat(grad[by], u, axis=0)
            at = fs[u]
            g2 = seen[at] + total * total
            seen[at] = g2
            step = rate / np.sqrt(g2)
            new = table[at] - step * total
            word = at < WORD_BUCKETS
            for c in (0, factors + 1):
                v = new[word, c]
                new[word, c] = np.sign(v) * np.maximum(np.abs(v) - l1 * step[word, c], 0)
            table[at] = new
    return model


def _meta(docs: DataFrame, meta_cols: tuple[str, ...]) -> list:
    return [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"meta{k}") for k, c in enumerate(meta_cols)]


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang",)) -> Model:
    """Fit the model on at most train_rows labelled documents.

    labels: doc_id, quality and toxic (0 or 1; a null counts as quality 1 and
    toxic 0).  Of an id's several label rows the lowest (quality, toxic)
    counts, and of its several texts the one of least hash.  The sample is the
    labelled ids of lowest hash, the same at every run; features are made on
    the executors.
    """
    own = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.struct(F.coalesce(F.col("quality").cast("int"), F.lit(1)).alias("quality"), F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("toxic"))).alias("label"))
    own = own.select("doc_id", "label.quality", "label.toxic").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    # The labelled side has train_rows rows at most, whatever the input.
    joined = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("h"), *_meta(docs, meta_cols)).join(F.broadcast(own), "doc_id")

    kept = ["quality", "toxic", "bucket", "value", "stats", "meta"]

    def extract(batches):
        names = [f"meta{k}" for k in range(len(meta_cols))]
        for batch in batches:
            for a, b, d, bucket, value, stats, meta in features(batch.column("text"), [batch.column(c) for c in names]):
                cut = np.searchsorted(d, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a).cast(pa.string()), batch.column("h").slice(a, b - a), batch.column("quality").slice(a, b - a), batch.column("toxic").slice(a, b - a),
                        pa.array([bucket[i:j].astype("<u4").tobytes() for i, j in zip(cut, cut[1:])], pa.binary()), pa.array([value[i:j].astype("<f4").tobytes() for i, j in zip(cut, cut[1:])], pa.binary()),
                        pa.array([s.tobytes() for s in stats.astype("<f4")], pa.binary()), pa.array([m.astype("<i8").tobytes() for m in meta], pa.binary()),
                    ],
                    names=["doc_id", "h", *kept],
                )

    each = joined.mapInArrow(extract, "doc_id string, h bigint, quality int, toxic int, bucket binary, value binary, stats binary, meta binary")
    got = each.groupBy("doc_id").agg(F.min(F.struct("h", *kept)).alias("r")).select("doc_id", *[f"r.{c}" for c in kept]).toArrow()  # train_rows rows at most
    got = got.sort_by([("doc_id", "ascending"), ("bucket", "ascending"), ("value", "ascending")])
    rows = [
        (np.frombuffer(b, "<u4"), np.frombuffer(v, "<f4"), np.frombuffer(s, "<f4"), np.frombuffer(m, "<i8"))
        for b, v, s, m in zip(*(got.column(c).to_pylist() for c in ("bucket", "value", "stats", "meta")))
    ]
    y = np.stack([got.column("quality").to_numpy(), got.column("toxic").to_numpy()], axis=1).astype(np.float32) if rows else np.zeros((0, 2), np.float32)
    del got
    release()
    model = fit(rows, y)
    del rows
    release()
    return model


def keep_model(model: Model, folder: str) -> None:
    """Write the model as one file of a folder, over one that is there."""
    out = io.BytesIO()
    np.savez(out, **vars(model))
    put_file(f"{folder}/model.npz", out.getvalue())


def kept_model(folder: str) -> Model | None:
    """The model that keep_model() wrote; None where there is none."""
    try:
        with np.load(f"{folder}/model.npz", allow_pickle=False) as got:
            return Model(**got)
    except FileNotFoundError:
        return None


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = ("lang",)) -> DataFrame:
    """quality and toxicity (probabilities) of each row, and whether it is kept.

    A document is rejected when its quality is below the threshold or its
    toxicity above it.  Null and empty texts are scored on their statistics
    and metadata alone; null metadata count as ''.  Each row is scored by
    itself: repeated rows get equal results and an empty table none.  Returns
    doc_id, quality, toxicity and keep; other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *_meta(docs, meta_cols))
    return scored.mapInArrow(_scorer(docs, model, threshold, len(meta_cols), ["doc_id"]), f"doc_id {id_type}, quality double, toxicity double, keep boolean")


def _scorer(docs: DataFrame, model: Model, threshold: float, n_meta: int, carry: list[str]):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            out = np.zeros((batch.num_rows, 2))
            for a, b, d, bucket, value, stats, meta in features(batch.column("text"), [batch.column(f"meta{k}") for k in range(n_meta)]):
                out[a:b] = score(m, d, bucket, value, stats, meta)
            p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            keep = (p[:, 0] >= threshold) & (p[:, 1] <= threshold)
            yield pa.RecordBatch.from_arrays([*map(batch.column, carry), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(keep)], names=[*carry, "quality", "toxicity", "keep"])

    return run


def drop_rejected(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text", meta_cols: tuple[str, ...] = ("lang",)) -> DataFrame:
    """The rows that classify() keeps, columns as given.

    The verdict is a vectorised function of text and metadata, so nothing is
    joined or shuffled.  Null and empty texts and null metadata are judged as
    classify() says; a score equal to the threshold is kept; each row is
    judged by itself, so of rows that repeat all stay or none; of an empty
    table nothing is left.
    """
    k = fresh(docs, "quality_keep")
    return docs.withColumn(k, _judged(docs, model, lambda p: (p[:, 0] >= threshold) & (p[:, 1] <= threshold), "boolean", text_col, meta_cols)).where(F.col(k)).drop(k)


def with_quality(docs: DataFrame, model: Model, name: str, text_col: str = "text", meta_cols: tuple[str, ...] = ("lang",)) -> DataFrame:
    """docs with each row's quality times the chance that it isn't toxic; rows are judged as in classify()."""
    return docs.withColumn(name, _judged(docs, model, lambda p: p[:, 0] * (1 - p[:, 1]), "double", text_col, meta_cols))


def _judged(docs: DataFrame, model: Model, verdict, kind: str, text_col: str, meta_cols: tuple[str, ...]) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(kind)
    def judged(text: pa.Array, *meta: pa.Array) -> pa.Array:
        out = np.zeros((len(text), 2))
        for a, b, d, bucket, value, stats, tags in features(text, list(meta)):
            out[a:b] = score(shared.value, d, bucket, value, stats, tags)
        return pa.array(verdict(1 / (1 + np.exp(-np.clip(out, -30, 30)))))

    return judged(F.col(f"`{text_col}`"), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in meta_cols])
