"""Self-join of documents by the Jaccard similarity of their word n-grams, vertically partitioned."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected
from ._forest import forest, spanning
from ._names import fresh
from ._shared import local_path, new_folder, release, squeeze, unsqueeze, written
from ._sorted_files import SortedFiles, put_shard, shard_of
from ._text import U64, mix64, ngram_sets, words

NGRAM = 3
THRESHOLD = 0.5
#: Ranges that the global n-gram order is cut into.
FRAGMENTS = 4
#: Text bytes, and n-grams and documents, that one task of a reduction gets.
SHARD_BYTES = 24 << 20
SHARD_GRAMS = 2 << 20
UNIT_DOCS = 4096
_FLUSH = 1 << 20
_DF_BITS = 48


def _document_sets(batch, n: int):
    """For each piece: first and last row; row number and hash of each distinct n-gram, by row and hash."""
    for a, b, doc, h in words(batch.column("text")):
        yield a, b, *ngram_sets(doc, h, b - a, n)


def _frequencies(n: int, shards: int):
    """Map side: sorted 48-bit n-gram hashes of many documents, packed by range."""

    def run(batches):
        held, size = [], 0

        def flush():
            keys = np.sort(np.concatenate(held))
            shard = shard_of(keys, _DF_BITS, shards)
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            ends = np.r_[cuts[1:], len(keys)]
            return pa.RecordBatch.from_arrays([pa.array(shard[cuts].astype(np.int32)), pa.array([squeeze(keys[i:j]) for i, j in zip(cuts, ends)], pa.binary())], names=["shard", "keys"])

        for batch in batches:
            for _, _, _, g in _document_sets(batch, n):
                if len(g):
                    held.append(g >> U64(64 - _DF_BITS))
                    size += len(g)
                if size >= _FLUSH:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        del held
        release()

    return run


def _df_class(df: np.ndarray) -> np.ndarray:
    """Document frequencies up to 16 each for itself, then sixteen classes an octave; rises with the frequency."""
    return np.floor(16 * np.log2(df)).astype(np.int32)


def _order_key(df: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Place in the global order of n-grams: by document frequency, then by hash."""
    return (np.minimum(df, (1 << 24) - 1).astype(np.uint64) << U64(40)) | (g >> U64(24))


def _fragment_ends(postings: dict[int, int], fragments: int) -> np.ndarray:
    """Places that cut the global order into fragments of about equal numbers of postings.

    postings: n-grams times documents in each class of document frequencies.
    """
    classes = sorted(postings)
    total, done, out = sum(postings.values()), 0, []

    def least(c: int) -> int:
        """The least document frequency of a class."""
        df = max(1, int(2 ** (c / 16)) - 1)
        while _df_class(np.array([df]))[0] < c:
            df += 1
        return df

    for c in classes:
        lo, hi = least(c), least(c + 1)
        while len(out) < fragments - 1 and (done + postings[c]) * fragments >= total * (len(out) + 1):
            share = (total * (len(out) + 1) / fragments - done) / postings[c]
            out.append(int(lo + share * max(hi - lo, 1)) << 40 if hi - lo != 1 else (lo << 40) + int(share * (1 << 40)))
        done += postings[c]
    return np.array(out + [1 << 63] * (fragments - 1 - len(out)), U64)


def _repeated(folder: str):
    """Reduce side: the n-grams of a range that two documents or more have, with their number, as a file.

    Returns how many postings they have in each class of document frequencies.
    """

    def run(key, table):
        shard = key[0].as_py()
        keys = np.sort(np.concatenate([unsqueeze(x.as_py()) for x in table.column("keys")]))
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        times = np.diff(np.r_[first, len(keys)])
        more = times > 1
        put_shard(folder, shard, keys[first[more]], times[more].astype(np.uint32))
        classes, at = np.unique(_df_class(times[more]), return_inverse=True)
        postings = np.bincount(at, weights=times[more], minlength=len(classes)).astype(np.int64)
        del keys, first, times
        release()
        return pa.table({"class": pa.array(classes, pa.int32()), "n": pa.array(postings, pa.int64())})

    return run


def _survivors(n: int, threshold: float, folder: str, shards: int, cuts: np.ndarray):
    """Documents that enough repeated n-grams leave a chance of a partner.

    Their repeated n-grams are in the global order, with the place where each
    fragment ends in them; the first `rares` are those of which two similar
    documents have one in common.  `row` is a number of the row alone, the
    same when a task is repeated.
    """

    def run(batches):
        from pyspark import TaskContext

        lookup = SortedFiles(folder, _DF_BITS, shards)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            rows = mix64(np.arange(base, base + batch.num_rows, dtype=np.uint64)).view(np.int64)
            base += batch.num_rows
            held, size, first = [], 0, None
            for a, b, d, g in _document_sets(batch, n):
                first = a if first is None else first
                held.append((d + a, g))
                size += len(g)
                if size >= _FLUSH or b == batch.num_rows:
                    yield one(lookup, ids, hashes, rows, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), first, b)
                    held, size, first = [], 0, None
        release()

    def one(lookup, ids, hashes, rows, d, g, first, last):
        count = last - first
        d = d - first
        order = np.argsort(g)
        df = np.empty(len(g), np.int64)
        df[order] = lookup.get(g[order] >> U64(64 - _DF_BITS))
        size = np.bincount(d, minlength=count)
        more = df > 1
        again = np.bincount(d[more], minlength=count)
        keep = (size > 0) & (again >= np.ceil(threshold * size - 1e-9))
        sums = np.zeros(count, U64)
        heads = np.flatnonzero(np.r_[True, d[1:] != d[:-1]]) if len(d) else np.zeros(0, np.int64)
        if len(heads):
            sums[d[heads]] = np.add.reduceat(mix64(g), heads)
        sig = mix64(sums + size.astype(U64)).view(np.int64)
        more &= keep[d]
        d, g, df = d[more], g[more], df[more]
        order = np.lexsort((g, df, d))
        g, df = g[order], df[order]  # d is sorted as it is
        cut = np.searchsorted(d, np.arange(count + 1))
        # N-grams that occur once come first in the order and have no partner, so they only shorten the prefix.
        prefix = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1 - (size - again)
        frag = np.searchsorted(cuts, _order_key(df, g), side="right")
        ends = np.cumsum(np.bincount(d * (len(cuts) + 1) + frag, minlength=count * (len(cuts) + 1)).reshape(count, -1), axis=1)
        at = np.flatnonzero(keep)
        rares = np.clip(prefix, 0, np.diff(cut))
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(at + first)), hashes.take(pa.array(at + first)), pa.array(sig[at]), pa.array(size[at]),
                pa.array([g[cut[i] : cut[i + 1]].astype("<u8").tobytes() for i in at], pa.binary()), pa.array([x.astype("<u4").tobytes() for x in ends[at]], pa.binary()), pa.array(rares[at]), pa.array(rows[at + first]),
            ],
            names=["doc_id", "text_hash", "sig", "size", "grams", "ends", "rares", "row"],
        )

    return run


def _unpack(batch) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams in a batch of survivors, one document after another, and where each document's begin."""
    raw = [x.as_py() for x in batch.column("grams")]
    return np.frombuffer(b"".join(raw), "<u8"), np.cumsum([0, *(len(x) // 8 for x in raw)])


def _postings_blob(keys: np.ndarray, row: np.ndarray, facts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sorted keys; for each the place of its document in the list of documents; that list, a column of facts each."""
    at, back = np.unique(row, return_inverse=True)
    return squeeze(keys), back.astype("<u2" if len(at) <= 65536 else "<u4").tobytes(), facts[:, at].astype("<i8").tobytes()


def _postings(table, facts: int):
    """The blobs of a group together: n-gram number and document number of each posting, once each and by document; facts by document.

    The first fact is the signature; documents are numbered by it.
    """
    keys, place, docs, base = [], [], [], 0
    for k, at, d in zip(*(table.column(c) for c in ("keys", "at", "docs"))):
        keys.append(unsqueeze(k.as_py()))
        raw = at.as_py()
        place.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * len(keys[-1]) else "<u4").astype(np.int64) + base)
        docs.append(np.frombuffer(d.as_py(), "<i8").reshape(facts, -1))
        base += docs[-1].shape[1]
    both = np.concatenate(docs, axis=1)
    _, first, back = np.unique(both[0], return_index=True, return_inverse=True)
    gram, known = pd.factorize(np.concatenate(keys))
    # A document's n-grams are of one row or, where its set has several rows, of equal ones.
    code = np.unique(back[np.concatenate(place)] * np.int64(len(known)) + gram)
    return code % max(len(known), 1), code // max(len(known), 1), both[:, first], len(known)


def _rarest(shards: int, folder: str, parts: int):
    """The rarest n-grams of the survivors whose row has a value in the folder, with this, by range of the hash."""

    def run(batches):
        lookup = SortedFiles(folder, 64, parts)
        for batch in batches:
            g, begin = _unpack(batch)
            sig, rares = batch.column("sig").to_numpy(), batch.column("rares").to_numpy()
            doc, value = _found(lookup, batch)
            facts = np.stack([sig, np.zeros(len(sig), np.int64)])
            facts[1, doc] = value
            at, _ = _spans_of(begin, doc, rares[doc])
            keys, rows = g[at], np.repeat(doc, rares[doc])
            by = np.argsort(keys)
            keys, rows = keys[by], rows[by]
            shard = shard_of(keys, 64, shards)
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(keys) else np.zeros(0, np.int64)
            blobs = [_postings_blob(keys[i:j], rows[i:j], facts) for i, j in zip(cuts, np.r_[cuts[1:], len(keys)])]
            yield pa.RecordBatch.from_arrays([pa.array(shard[cuts].astype(np.int32)), *(pa.array([x[k] for x in blobs], pa.binary()) for k in range(3))], names=["shard", "keys", "at", "docs"])
        release()

    return run


def _found(lookup: SortedFiles, batch) -> tuple[np.ndarray, np.ndarray]:
    """Places in a batch, and values, of all that the folder has for its rows."""
    row = batch.column("row").to_numpy().view(np.uint64)
    order = np.argsort(row)
    at, value = lookup.all(row[order])
    return order[at], value


def _links(key, table):
    """From each document to the least one that shared rarest n-grams connect it with in this range."""
    gram, place, (sig, _), _ = _postings(table, 2)
    order = np.argsort(gram, kind="stable")
    gram, place = gram[order], place[order]
    start = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    length = np.diff(np.r_[start, len(gram)])
    root = forest(place[np.repeat(start, length)], place, len(sig))
    linked = np.flatnonzero(root != np.arange(len(sig)))
    del gram, place, order
    release()
    return pa.table({"u": pa.array(sig[linked]), "v": pa.array(sig[root[linked]])})


def _spans_of(begin: np.ndarray, which: np.ndarray, length: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first entries (all by default) of these rows one after another, and where each row's begin."""
    s = begin[which]
    m = begin[which + 1] - s if length is None else length
    head = np.cumsum(m) - m
    return np.arange(m.sum()) - np.repeat(head, m) + np.repeat(s, m), head


def _sketches(folder: str, parts: int):
    """Of each set its n-grams, and the least hash of those in its prefix, which near copies mostly share."""

    def run(batches):
        lookup = SortedFiles(folder, 64, parts)
        for batch in batches:
            g, begin = _unpack(batch)
            doc, _ = _found(lookup, batch)
            rares = batch.column("rares").to_numpy()[doc]
            doc, rares = doc[rares > 0], rares[rares > 0]
            at, head = _spans_of(begin, doc, rares)
            low = np.minimum.reduceat(mix64(g[at]), head) if len(at) else np.zeros(0, U64)
            sig, row = (batch.column(c).to_numpy()[doc] for c in ("sig", "row"))
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(row), pa.array(np.diff(begin)[doc]), pa.array(low.view(np.int64))], names=["sig", "row", "m", "low"])

    return run


def _meetings(key, table):
    """Each document with the blocks of all that share a prefix n-gram of this range with it."""
    gram, place, (sig, code), grams = _postings(table, 2)
    blocks, own = np.unique(code, return_inverse=True)
    by = np.argsort(gram, kind="stable")
    gram, place = gram[by], place[by]
    held = np.unique(gram * len(blocks) + own[place])
    begin, held = np.searchsorted(held // len(blocks), np.arange(grams + 1)), held % len(blocks)
    stop = np.cumsum(begin[gram + 1] - begin[gram])
    out, lo = np.zeros(0, np.int64), 0
    while lo < len(gram):
        hi = max(lo + 1, int(np.searchsorted(stop, (stop[lo - 1] if lo else 0) + _FLUSH, side="right")))
        at, _ = _spans_of(begin, gram[lo:hi])
        doc = np.repeat(place[lo:hi], begin[gram[lo:hi] + 1] - begin[gram[lo:hi]])
        out = np.union1d(out, doc * len(blocks) + held[at])
        lo = hi
    doc, other = out // len(blocks), out % len(blocks)
    release()
    return pa.table({"node": pa.array(sig[doc]), "own": pa.array(code[doc]), "other": pa.array(blocks[other])})


def _by_unit(folder: str, parts: int, fragments: int, prefix: bool):
    """The survivors' n-grams by unit: of the prefixes, or of all by fragment of the global order.

    Facts of a document are signature, size and side with prefixes; else
    signature, size and its n-grams before and after the fragment.
    """

    def run(batches):
        lookup = SortedFiles(folder, 64, parts)
        for batch in batches:
            g, begin = _unpack(batch)
            sig, size, rares = (batch.column(c).to_numpy() for c in ("sig", "size", "rares"))
            ends = np.frombuffer(b"".join(x.as_py() for x in batch.column("ends")), "<u4").astype(np.int64).reshape(len(sig), -1)
            doc, place = _found(lookup, batch)
            unit, side = place >> 2, (place & 3) - 1
            length = rares[doc] if prefix else np.diff(begin)[doc]
            # Documents of large components go to many units: some at a time.
            stop = np.cumsum(length)
            lo = 0
            while lo < len(doc):
                hi = max(lo + 1, int(np.searchsorted(stop, (stop[lo - 1] if lo else 0) + _FLUSH, side="right")))
                yield one(g, begin, sig, size, ends, doc[lo:hi], unit[lo:hi], side[lo:hi], length[lo:hi])
                lo = hi
        release()

    def one(g, begin, sig, size, ends, doc, unit, side, length):
        at, head = _spans_of(begin, doc, length)
        row = np.repeat(np.arange(len(doc)), length)
        cell = unit[row]
        if not prefix:
            rank = np.arange(len(at)) - np.repeat(head, length)
            cell = cell * fragments + (rank[:, None] >= ends[doc[row], :-1]).sum(1)
        keys = g[at]
        order = np.lexsort((keys, cell))
        keys, row, cell = keys[order], row[order], cell[order]
        cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        blobs = []
        for i, j in zip(cuts, np.r_[cuts[1:], len(cell)]):
            if prefix:
                facts = np.stack([sig[doc], size[doc], side])
            else:
                f = int(cell[i] % fragments)
                facts = np.stack([sig[doc], size[doc], ends[doc, f - 1] if f else np.zeros(len(doc), np.int64), ends[doc, -1] - ends[doc, f]])
            blobs.append(_postings_blob(keys[i:j], row[i:j], facts))
        of = cell[cuts]
        where = [pa.array(of)] if prefix else [pa.array(of // fragments), pa.array((of % fragments).astype(np.int32))]
        names = ["unit"] if prefix else ["unit", "fragment"]
        return pa.RecordBatch.from_arrays([*where, *(pa.array([x[k] for x in blobs], pa.binary()) for k in range(3))], names=[*names, "keys", "at", "docs"])

    return run


def _candidates(threshold: float):
    """The pairs of a unit that share an n-gram of both prefixes and whose sizes may reach the threshold.

    Some at a time: the signatures of the documents, rising; for each left one
    how many partners it has; these by their place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        unit = table.column("unit")[0].as_py()
        gram, place, (sig, size, side), grams = _postings(table, 3)
        del table
        n = len(sig)
        begin = np.searchsorted(place, np.arange(n + 1))
        by = np.argsort(gram, kind="stable")
        who, begin_w = place[by], np.searchsorted(gram[by], np.arange(grams + 1))
        seen = np.zeros(n, bool)

        def told(left, count, right):
            a, b = np.array(left), np.concatenate(right)
            some = np.unique(np.r_[a, b])
            blob = [x.tobytes() for x in (sig[some].astype("<i8"), np.searchsorted(some, a).astype("<u4"), np.array(count, "<u4"))]
            blob.append(pa.compress(np.searchsorted(some, b).astype("<u4").tobytes(), codec="zstd", asbytes=True))
            return pa.RecordBatch.from_arrays([pa.array([unit]), *(pa.array([x], pa.binary()) for x in blob), pa.array([len(b)])], names=["unit", "sigs", "a", "count", "b", "n"])

        left, count, right, waiting = [], [], [], 0
        for a in range(n):
            at, _ = _spans_of(begin_w, gram[begin[a] : begin[a + 1]])
            seen[who[at]] = True
            b = np.flatnonzero(seen[a + 1 :]) + (a + 1)
            seen[:] = False
            b = b[np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9]
            if side[a] >= 0:
                b = b[side[b] != side[a]]
            if len(b):
                left.append(a)
                count.append(len(b))
                right.append(b)
                waiting += len(b)
            if waiting >= 1 << 18:
                yield told(left, count, right)
                left, count, right, waiting = [], [], [], 0
        if waiting:
            yield told(left, count, right)
        release()

    return run


_PARTIAL = {"a": pa.int64(), "b": pa.int64(), "size_a": pa.int64(), "size_b": pa.int64(), "common": pa.int64()}


def _partial(threshold: float):
    """N-grams that the pairs of a unit share in one fragment.

    A pair is left out where all it could share before and after the fragment
    would not bring it to the threshold: its sum falls short then, too.
    """

    def run(segments: pa.Table, pairs: pa.Table) -> pa.Table:
        out = [[] for _ in _PARTIAL]
        if segments.num_rows and pairs.num_rows:
            gram, place, (sig, size, before, after), grams = _postings(segments, 4)
            begin = np.searchsorted(place, np.arange(len(sig) + 1))
            flag = np.zeros(grams, bool)
            for sigs, a, count, b, n in zip(*(pairs.column(c).to_pylist() for c in ("sigs", "a", "count", "b", "n"))):
                known = np.frombuffer(sigs, "<i8")
                at = np.minimum(np.searchsorted(sig, known), len(sig) - 1)
                at[sig[at] != known] = -1  # no n-gram in this fragment
                a, count = at[np.frombuffer(a, "<u4")], np.frombuffer(count, "<u4").astype(np.int64)
                b = at[np.frombuffer(pa.decompress(b, decompressed_size=4 * n, codec="zstd", asbytes=True), "<u4")]
                both = np.repeat(a >= 0, count) & (b >= 0)
                a, b = np.repeat(a, count)[both], b[both]
                if not len(a):
                    continue
                total = np.zeros(len(b), np.int64)
                cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                for i, j in zip(cuts, np.r_[cuts[1:], len(a)]):
                    mine = gram[begin[a[i]] : begin[a[i] + 1]]
                    flag[mine] = True
                    for lo in range(i, j, 4096):
                        hi = min(lo + 4096, j)
                        theirs, head = _spans_of(begin, b[lo:hi])
                        total[lo:hi] = np.add.reduceat(flag[gram[theirs]].view(np.int8).astype(np.int64), head)
                    flag[mine] = False
                most = total + np.minimum(before[a], before[b]) + np.minimum(after[a], after[b])
                at = np.flatnonzero((total > 0) & (most >= threshold * (size[a] + size[b] - most) - 1e-9))
                for to, x in zip(out, (sig[a], sig[b], size[a], size[b], total)):
                    to.append(x[at])
        got = pa.table({c: pa.array(np.concatenate(x) if x else [], kind) for (c, kind), x in zip(_PARTIAL.items(), out)})
        release()
        return got

    return run


def _put_labels(folder: str):
    def run(key, table):
        shard = key[0].as_py()
        node, part = table.column("node").to_numpy().view(np.uint64), table.column("part").to_numpy()
        order = np.argsort(node)
        put_shard(folder, shard, node[order], part[order])
        return pa.table({"n": pa.array([len(node)], pa.int64())})

    return run


def similar_sets(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of classes of documents with equal n-gram sets.

    members: doc_id, a hash of the text and sig, the class, of each document
    that may have a partner; pairs: classes a < b with common, the n-grams they share, and
    their sizes, where the Jaccard similarity reaches the threshold.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    own = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("doc_id"), F.lower(F.col(f"`{text_col}`")).alias("text"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    shards = int(-(-size // SHARD_BYTES)) or 1
    folder = local_path(new_folder(spark, "ngram-frequencies"))
    packed = own.select("text").mapInArrow(_frequencies(n, shards), "shard int, keys binary")
    classes = packed.groupBy("shard").applyInArrow(_repeated(folder), "class int, n bigint").groupBy("class").agg(F.sum("n")).collect()  # some hundred
    cuts = _fragment_ends(dict(map(tuple, classes)), FRAGMENTS)

    kept = written(own.mapInArrow(_survivors(n, threshold, folder, shards, cuts), f"doc_id {id_type}, text_hash bigint, sig bigint, size bigint, grams binary, ends binary, rares bigint, row bigint"), "ngram-survivors")
    # Of documents with equal sets one row stands for all.
    sets = written(kept.groupBy("sig").agg(F.min_by(F.struct("row", (F.octet_length("grams") / 8).alias("m"), "rares"), "row").alias("r")).select("r.*"), "ngram-sets")
    grams, rares, rows = sets.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("rares"), F.lit(0)), F.count("*")).collect()[0]
    ranges, parts = int(-(-rares // SHARD_GRAMS)) or 1, int(max(-(-grams // SHARD_GRAMS), -(-rows // (4 * UNIT_DOCS)))) or 1
    folder = _by_node(sets.select(F.col("row").alias("node"), F.lit(0).cast("bigint").alias("part")), parts, "ngram-rows")
    own = kept.select("sig", "size", "grams", "ends", "rares", "row")
    near = own.mapInArrow(_rarest(ranges, folder, parts), "shard int, keys binary, at binary, docs binary")
    roots = connected(near.groupBy("shard").applyInArrow(_links, "u bigint, v bigint"))
    folder = _by_node(_places(own, roots, folder, parts, ranges), parts, "ngram-units")

    found = own.mapInArrow(_by_unit(folder, parts, FRAGMENTS, True), "unit bigint, keys binary, at binary, docs binary").groupBy("unit").applyInArrow(_candidates(threshold), "unit bigint, sigs binary, a binary, count binary, b binary, n bigint")
    everywhere = found.withColumn("fragment", F.explode(F.array(*map(F.lit, range(FRAGMENTS)))))
    segments = own.mapInArrow(_by_unit(folder, parts, FRAGMENTS, False), "unit bigint, fragment int, keys binary, at binary, docs binary")
    partial = segments.groupBy("unit", "fragment").cogroup(everywhere.groupBy("unit", "fragment")).applyInArrow(_partial(threshold), ", ".join(f"{c} bigint" for c in _PARTIAL))
    pairs = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("common").alias("common"))
    return kept.select("doc_id", "text_hash", "sig", "size"), pairs.where(F.col("common") >= threshold * (F.col("size_a") + F.col("size_b") - F.col("common")) - 1e-9)


def _by_node(labels: DataFrame, parts: int, what: str) -> str:
    """Files of (node, part) rows, by node."""
    folder = local_path(new_folder(labels.sparkSession, what))
    shard = F.shiftright(F.shiftrightunsigned("node", 44) * parts, 20)
    labels.groupBy(shard.alias("shard")).applyInArrow(_put_labels(folder), "n bigint").agg(F.sum("n")).collect()
    return folder


def _places(kept: DataFrame, roots: DataFrame, folder: str, parts: int, ranges: int) -> DataFrame:
    """(node, part): where each row that may have a partner takes part, as four times the unit and one more than the side.

    Small components go by hash into units 0 to parts - 1, with side -1: each
    is paired with all.  A component of more than SHARD_GRAMS n-grams or
    UNIT_DOCS documents is cut into blocks of half of that, near copies
    together where they share their least prefix hash; two blocks make a unit,
    in which the documents of one are paired with those of the other, and a
    document goes only to units where a prefix n-gram of its own awaits it.
    """
    spark = kept.sparkSession
    sets = kept.mapInArrow(_sketches(folder, parts), "sig bigint, row bigint, m bigint, low bigint")
    placed = written(roots.join(sets, F.col("node") == F.col("sig")).select(F.col("row").alias("node"), "root", "m", "low"), "ngram-components")
    small = F.pmod(F.xxhash64("root"), F.lit(parts)) * 4
    large = placed.groupBy("root").agg(F.sum("m").alias("m"), F.count("*").alias("n")).where((F.col("m") > SHARD_GRAMS) | (F.col("n") > UNIT_DOCS)).collect()  # each fills a unit
    if not large:
        return placed.select("node", small.alias("part"))
    of = lambda m, n: int(max(-(-2 * m // SHARD_GRAMS), -(-2 * n // UNIT_DOCS)))
    cut = spark.createDataFrame([(r["root"], of(r["m"], r["n"])) for r in large], "root bigint, blocks bigint")
    inside = placed.join(cut, "root").select("node", "root", "m", F.pmod(F.xxhash64("low"), F.col("blocks")).alias("block"))
    sizes = inside.groupBy("root", "block").agg(F.sum("m").alias("m"), F.count("*").alias("n")).orderBy("root", "block").collect()  # two a unit's worth
    splits = [of(r["m"], r["n"]) for r in sizes]
    first = np.cumsum([0, *splits]).tolist()
    codes = spark.createDataFrame([(r["root"], r["block"], a, b) for r, a, b in zip(sizes, first, splits)], "root bigint, block bigint, first bigint, splits bigint")
    coded = inside.join(codes, ["root", "block"]).select("node", (F.col("first") + F.pmod(F.xxhash64("node"), F.col("splits"))).alias("part"))
    folder = _by_node(coded, parts, "ngram-blocks")
    near = kept.withColumn("sig", F.col("row")).mapInArrow(_rarest(ranges, folder, parts), "shard int, keys binary, at binary, docs binary")
    met = near.groupBy("shard").applyInArrow(_meetings, "node bigint, own bigint, other bigint").distinct()
    unit = F.lit(parts) + F.least("own", "other") * first[-1] + F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return placed.join(cut, "root", "left_anti").select("node", small.alias("part")).unionByName(met.select("node", (unit * 4 + side).alias("part")))


def similar_pairs(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All pairs of documents whose sets of word n-grams have a Jaccard similarity of the threshold or more.

    The texts are lower-cased and cut at white space; a text of fewer than n
    words has one gram.  Exact: n-grams are ordered by document frequency and
    hash, and documents that share none of their rarest are passed over, as
    are those with too few n-grams that occur twice.  The global order is cut
    into fragments; each document's n-grams of a fragment travel apart, tasks
    count what pairs share in one fragment, and the counts are summed per
    pair.  What no chain of shared rare n-grams connects doesn't meet; large
    connected components are cut into blocks, two of which meet where they
    share such n-grams, so no task holds more than a fragment of two blocks.
    Documents with equal sets are one class throughout.

    Returns doc_a < doc_b, common, and jaccard.  Null and empty texts have no
    n-grams and no partner; rows with a null id are left out, and rows that
    repeat an id are one document with several texts: a pair is given once,
    with its highest similarity, never an id with itself.  An empty table
    gives an empty result.  Other columns are not read.
    """
    members, pairs = similar_sets(docs, n, threshold, id_col, text_col)
    members = members.select("doc_id", "sig", "size").distinct()
    left, right = members.select(F.col("doc_id").alias("x"), F.col("sig").alias("a")), members.select(F.col("doc_id").alias("y"), F.col("sig").alias("b"))
    across = pairs.join(left, "a").join(right, "b").select("x", "y", "common", (F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))).alias("jaccard"))
    within = members.select(F.col("doc_id").alias("x"), "sig", F.col("size").alias("common")).join(members.select(F.col("doc_id").alias("y"), "sig"), "sig").where("x < y").select("x", "y", "common", F.lit(1.0).alias("jaccard"))
    both = across.where("x <> y").unionByName(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "common", "jaccard")
    if members.groupBy("doc_id").count().where("count > 1").isEmpty():
        return both  # each pair of ids is one of sets
    return both.groupBy("doc_a", "doc_b").agg(F.max(F.struct("jaccard", "common")).alias("m")).select("doc_a", "doc_b", F.col("m.common").alias("common"), F.col("m.jaccard").alias("jaccard"))


def _spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of many links (u, v) those of a spanning forest."""
    u, v, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        size += batch.num_rows
        if size >= max(_FLUSH, len(u)):
            u, v = spanning(*(np.concatenate(x) for x in zip((u, v), *held)))
            held, size = [], 0
    u, v = spanning(*(np.concatenate(x) for x in zip((u, v), *held)))
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
    release()


def similar_classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its class and its number of links: the documents that similar_pairs() pairs it with.

    All pairs of sets are found and checked as there, and counted instead of
    given: a group of k copies makes k rows, not k squared.  A class is what
    chains of links connect; its id is the least in it.

    Returns doc_id, class_id and links, a row for each id that isn't null.
    Null and empty texts have no links and are classes of their own, as is all
    that has no partner.  Rows that repeat an id are one document with several
    texts: it has the links of each, another id counts once, and the classes
    of its texts are one.  An empty table gives an empty result.  Other
    columns are not read.
    """
    members, pairs = similar_sets(docs, n, threshold, id_col, text_col)
    members = written(members.select("doc_id", "sig").distinct(), "ngram-members")
    pairs = written(pairs.select("a", "b"), "ngram-pairs")
    several = members.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("sig").alias("u")).where("n > 1").select("doc_id", "u")
    plain = several.isEmpty()

    edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).coalesce(int(-(-pairs.count() // _FLUSH)) or 1).mapInArrow(_spanned, "u bigint, v bigint")
    if not plain:
        several = written(several, "ngram-several")
        edges = edges.unionByName(members.join(several, "doc_id").select("u", F.col("sig").alias("v")))
    grouped = members.join(connected(edges), F.col("sig") == F.col("node"), "left").select("doc_id", "sig", F.coalesce("root", "sig").alias("grp"))
    least = grouped.groupBy("grp").agg(F.min("doc_id").alias("class_id"))

    # Documents of one set alone are counted by set; links of the others are made distinct.
    single = members if plain else members.join(several, "doc_id", "left_anti")
    own = single.groupBy("sig").agg(F.count("*").alias("n"))
    ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = ways.join(own.withColumnRenamed("sig", "b"), "b").groupBy("a").agg(F.sum("n").alias("n"))
    links = own.select("sig", F.col("n") - 1).union(across.select("a", "n")).toDF("sig", "n").groupBy("sig").agg(F.sum("n").alias("n"))
    links = single.join(links, "sig").select("doc_id", "n")
    if not plain:
        same = members.select(F.col("sig").alias("a"), F.col("sig").alias("b")).distinct()
        mine = members.join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("y"), F.col("sig").alias("a"))
        met = mine.join(ways.unionByName(same), "a").join(members.select(F.col("doc_id").alias("x"), F.col("sig").alias("b")), "b").where("x <> y").select("x", "y").distinct()
        met = written(met, "ngram-met")
        back = met.join(several, met["x"] == several["doc_id"], "left_anti")
        links = links.union(met.groupBy("x").count()).union(back.groupBy("y").count()).toDF("doc_id", "n")
    found = grouped.join(least, "grp").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    found = found.join(links.groupBy("doc_id").agg(F.sum("n").alias("n")), "doc_id", "left")
    ids = docs.select(F.col(f"`{id_col}`").alias("doc_id")).where("doc_id is not null").distinct()
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n", F.lit(0)).cast("bigint").alias("links"))


def drop_near_copies(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document, that of the least id, of each group that similar pairs connect; columns as given.

    Documents without n-grams and rows with a null id stay as they are; rows
    that repeat an id and text are one group and one row of them stays.  Rows
    with one id and different texts are different documents, told apart by a
    hash of the text; of those in one group one stays.
    """
    members, pairs = similar_sets(docs, n, threshold, id_col, text_col)
    roots = connected(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    members = written(members.join(roots, members["sig"] == roots["node"], "left").select("doc_id", "text_hash", F.coalesce("root", "sig").alias("grp")), "ngram-groups")
    row = F.struct("doc_id", "text_hash")
    least = members.groupBy("grp").agg(F.min(row).alias("least"), F.count("*").alias("n")).where("n > 1")
    gone_id, gone_hash, h = fresh(docs, "near_copy_id"), fresh(docs, "near_copy_hash"), fresh(docs, "near_copy_text")
    named = lambda df: df.select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct()
    gone = named(members.join(least, "grp").where(row != F.col("least")))
    on = (F.col(f"`{id_col}`") == F.col(gone_id)) & (F.col(h) == F.col(gone_hash))
    stay = docs.withColumn(h, F.xxhash64(F.col(f"`{text_col}`"))).join(gone, on, "left_anti")
    # Only documents that occur twice in one group can repeat a row.
    twice = named(members.groupBy("grp", "doc_id", "text_hash").count().where("count > 1"))
    if twice.isEmpty():
        return stay.drop(h)
    same = stay.join(twice, on, "left_semi").dropDuplicates([id_col, text_col])
    return stay.join(twice, on, "left_anti").unionByName(same).drop(h)
