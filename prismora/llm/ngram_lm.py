"""Language-model scores from an Elias-Fano trie of all word n-grams of the corpus."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import local_path, new_folder, planes, put_file, release, squeeze, unplanes, unsqueeze
from ._text import U64, mix64, pieces, span_hashes, spans, text_buffer

#: Absolute discount of bigrams and trigrams.
DISCOUNT = 0.75
#: Natural-log step of the quantised probabilities and back-off weights (one byte each).
STEP = 0.08
#: Text bytes that one shard of the trie holds, about.
SHARD_BYTES = 16 << 20
#: Times that a word may occur before its subtree is spread over several shards.
HOT_WORD = 1 << 20
#: Shards of one kind that a worker keeps mapped.
OPEN_SHARDS = 4096
_FLUSH = 1 << 20
#: Bits of a packed sort key; wider trigrams are sorted by columns.
_KEY_BITS = 63
_END = U64(0)  # closes each document, twice


# == Elias-Fano


def ef_encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """A monotone sequence: low bits packed, high bits unary, and the ones before each 64-bit word."""
    n = len(values)
    universe = int(values[-1]) + 1 if n else 1
    low = max(0, (universe // max(n, 1)).bit_length() - 1)
    v = values.astype(np.uint64)
    high = (v >> U64(low)).astype(np.int64) + np.arange(n)
    size = (int(high[-1]) + 64 if n else 64) // 64 + 1
    bits = np.zeros(size * 64, np.uint8)
    bits[high] = 1
    words = np.packbits(bits, bitorder="little").view("<u8")
    ones = np.r_[0, np.cumsum(bits.reshape(-1, 64).sum(1))].astype(np.uint32)
    return {"head": np.array([n, low], np.int64), "low": _pack_by_parts(v & U64((1 << low) - 1), low), "high": words, "ones": ones}


def _pack(v: np.ndarray, width: int) -> np.ndarray:
    """Fixed-width bit packing (width 56 at most), with room for an eight-byte read at the end."""
    n = len(v)
    if not width or not n:
        return np.zeros(8, np.uint8)
    # Eight values take `width` whole bytes; each of the eight lanes is written byte by byte.
    lanes = np.zeros(-(-n // 8) * 8, U64)
    lanes[:n] = v
    lanes = lanes.reshape(-1, 8)
    out = np.zeros((len(lanes), width), np.uint8)
    for lane in range(8):
        byte, bit = divmod(lane * width, 8)
        x = lanes[:, lane] << U64(bit)
        for k in range(-(-(bit + width) // 8)):
            out[:, byte + k] |= (x >> U64(8 * k)).astype(np.uint8)
    return np.r_[out.reshape(-1), np.zeros(8, np.uint8)]


def _unpack(a: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Packed values at these places (width 56 at most)."""
    if not width:
        return np.zeros(len(at), np.int64)
    bit = at * width
    eight = np.ndarray((len(a) - 7,), "<u8", buffer=a, strides=(1,))[bit >> 3]
    bit &= 7
    eight >>= bit.view(U64)
    eight &= U64((1 << width) - 1)
    return eight.view(np.int64)


def _select(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one of each 64-bit word, by halving."""
    word, k = word.copy(), k.astype(np.uint8)
    out = np.zeros(len(word), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(word & U64((1 << half) - 1))
        above = ones <= k
        k -= np.where(above, ones, np.uint8(0))
        step = above * np.int64(half)
        out += step
        word >>= step.view(U64)
    return out


def ef_get(e: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    """The values at rising places."""
    low = int(e["head"][1])
    word = np.searchsorted(e["ones"], at.astype(np.uint32), side="right") - 1
    select = word * 64 + _select(e["high"][word], at - e["ones"][word])
    return ((select - at) << low) | _unpack(e["low"], at, low)


# == files


def _save(path: str, arrays: dict[str, np.ndarray], extra: dict) -> None:
    """Arrays one after another behind a header, to be mapped as one file."""
    place, at = {}, 0
    for k, a in arrays.items():
        place[k] = (at, str(a.dtype), a.shape[0])
        at += -(-a.nbytes // 8) * 8
    head = json.dumps({"arrays": place, **extra}).encode()
    head += b" " * (-len(head) % 8)
    body = b"".join(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays.values())
    put_file(path, len(head).to_bytes(8, "little") + head + body)


def _load(path: str) -> tuple[dict[str, np.ndarray], dict]:
    raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + size].tobytes())
    out = {}
    for k, (at, kind, n) in head["arrays"].items():
        t = np.dtype(kind)
        out[k] = raw[8 + size + at : 8 + size + at + n * t.itemsize].view(t)
    return out, head


class Shards:
    """Files of one kind by shard number, mapped when asked for; the one mapped first goes when there are too many."""

    def __init__(self, folder: str, kind: str, made=lambda arrays, head: arrays):
        self._path, self._made, self._open = f"{folder}/{kind}", made, {}

    def get(self, shard: int):
        """None where there is no such file."""
        if shard not in self._open:
            if len(self._open) >= OPEN_SHARDS:
                self._open.pop(next(iter(self._open)))
            path = f"{self._path}-{shard:07d}"
            self._open[shard] = self._made(*_load(path)) if os.path.exists(path) else None
        return self._open[shard]


def _sub(arrays: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    return {k[len(prefix) :]: a for k, a in arrays.items() if k.startswith(prefix)}


def quantise(p: np.ndarray) -> np.ndarray:
    """-ln p in steps, a byte each; 0 probability is the last step."""
    with np.errstate(divide="ignore"):
        return np.clip(np.rint(-np.log(p) / STEP), 0, 255).astype(np.uint8)


_VALUE = np.exp(-STEP * np.arange(256))
_VALUE[255] = 0.0


# == vocabulary (level 0)


def _tokens(column):
    """For each piece: first and last text; text number and hash of its tokens, each text closed by two end marks."""
    buf, off = text_buffer(column)
    for a, b in pieces(off):
        part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        start, end, doc = spans(part, o)
        h = np.maximum(span_hashes(part, start, end), U64(1))
        count = np.bincount(doc, minlength=b - a)
        size = count + 2 * (count > 0)
        at = np.arange(len(h)) + np.repeat(np.cumsum(size) - size - np.cumsum(count) + count, count)
        out = np.full(int(size.sum()), _END, U64)
        out[at] = h
        yield a, b, np.repeat(np.arange(b - a), size), out, count


def _top(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> U64(44)) * U64(shards)) >> U64(20)


def _word_counts(shards: int):
    def run(batches):
        held, size = [], 0

        def flush():
            words, n = np.unique(np.concatenate(held), return_counts=True)
            shard = _top(words, shards)
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            ends = np.r_[cuts[1:], len(words)]
            return pa.RecordBatch.from_arrays([pa.array(shard[cuts].astype(np.int32)), pa.array([squeeze(words[i:j]) for i, j in zip(cuts, ends)], pa.binary()), pa.array([n[i:j].astype("<u4").tobytes() for i, j in zip(cuts, ends)], pa.binary())], names=["shard", "words", "n"])

        for batch in batches:
            for *_, h, count in _tokens(batch.column("text")):
                # One end mark of the two is predicted, and counts.
                held.append(np.r_[h[h != _END], np.zeros(int((count > 0).sum()), U64)])
                size += len(h)
                if size >= _FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()
        release()

    return run


def _put_words(folder: str, hot_word: int):
    def run(key, table):
        shard = key[0].as_py()
        words = np.concatenate([unsqueeze(x.as_py()) for x in table.column("words")])
        n = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("n")])
        order = np.argsort(words)
        words, n = words[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
        n = np.add.reduceat(n, first)
        words = words[first]
        _save(f"{folder}/words-{shard:07d}", {"word": words, "n": n}, {})
        hot = np.flatnonzero((n > hot_word) & (words != _END))
        release()
        return pa.table({"shard": pa.array([shard], pa.int32()), "types": pa.array([len(words)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64()), "hot": pa.array([hot], pa.list_(pa.int64())), "n": pa.array([n[hot]], pa.list_(pa.int64()))})

    return run


class Words:
    """Numbers of words: their rank by hash in the whole vocabulary, mapped shard by shard."""

    def __init__(self, folder: str, model: Model):
        self.model, self._files = model, Shards(folder, "words")

    def numbers(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (-1 if unknown) and count of sorted hashes."""
        number, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        shard = _top(h, self.model.shards)
        cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(h) else []
        for i, j in zip(cuts, np.r_[cuts[1:], len(h)] if len(h) else []):
            s = int(shard[i])
            if (a := self._files.get(s)) is None:
                continue
            at = np.searchsorted(a["word"], h[i:j])
            at[at == len(a["word"])] = 0
            hit = a["word"][at] == h[i:j]
            number[i:j][hit] = at[hit] + self.model.first_word[s]
            count[i:j][hit] = a["n"][at[hit]]
        return number, count


# == trie (levels 1 to 3)


@dataclass
class Model:
    folder: str
    shards: int
    #: Words before each vocabulary shard; the last entry is their number.
    first_word: np.ndarray
    tokens: int
    #: Numbers (sorted) and counts of the words whose subtrees lie in several shards, and their back-off steps.
    hot: np.ndarray
    hot_count: np.ndarray
    hot_back: np.ndarray
    hot_word: int = HOT_WORD

    @property
    def types(self) -> int:
        return int(self.first_word[-1])

    def unigram(self, count: np.ndarray) -> np.ndarray:
        """Discounted by DISCOUNT, the mass given to all words and one unknown alike."""
        n = max(self.tokens, 1)
        return np.maximum(count - DISCOUNT, 0) / n + DISCOUNT * self.types / n / (self.types + 1)

    def is_hot(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the hot words are, and which of them each is."""
        if not len(self.hot):
            none = np.zeros(0, np.int64)
            return none, none
        at = np.minimum(np.searchsorted(self.hot, a), len(self.hot) - 1)
        here = np.flatnonzero(self.hot[at] == a)
        return here, at[here]

    def shard(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shard of the pair a b: that of a's subtree, or of the part of it that b falls into."""
        x = (a.astype(np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15)
        here, which = self.is_hot(a)
        if len(here):
            parts = (-(-self.hot_count // self.hot_word)).astype(np.uint64)[which]
            x[here] = mix64(x[here] + (mix64(b[here].astype(np.uint64)) % parts))
        return ((x >> U64(44)) * U64(self.shards)) >> U64(20)


def _ranks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each value among the distinct ones, and these, sorted."""
    codes, known = pd.factorize(x)
    order = np.argsort(known)
    rank = np.empty(len(known), np.int64)
    rank[order] = np.arange(len(known))
    return rank[codes], known[order]


def _sorted_trigrams(a, b, c, n=None):
    """Distinct trigrams with summed counts (1 each by default), sorted.

    Numbers that would make a packed key wider than 63 bits are first replaced
    by their rank among those at hand, one column after another; where that
    doesn't help, three columns are sorted.
    """
    if not len(a):
        return a, b, c, np.zeros(0, np.int64)
    n = np.ones(len(a), np.int64) if n is None else n
    cols, known = [a, b, c], [None, None, None]
    bits = [max(1, int(x.max()).bit_length()) for x in cols]
    for k in range(3):
        if sum(bits) > _KEY_BITS:
            cols[k], known[k] = _ranks(cols[k])
            bits[k] = max(1, (len(known[k]) - 1).bit_length())
    if sum(bits) <= _KEY_BITS:
        key = (cols[0] << (bits[1] + bits[2])) | (cols[1] << bits[2]) | cols[2]
        order = np.argsort(key)
        key, n = key[order], n[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key = key[first]
        out = [key >> (bits[1] + bits[2]), (key >> bits[2]) & ((1 << bits[1]) - 1), key & ((1 << bits[2]) - 1)]
        out = [x if u is None else u[x] for u, x in zip(known, out)]
    else:
        order = np.lexsort((c, b, a))
        a, b, c, n = a[order], b[order], c[order], n[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
        out = [a[first], b[first], c[first]]
    return *out, np.add.reduceat(n.astype(np.int64), first)


def _trigrams(model: Model):
    """Map side: trigrams of many documents, counted and packed by the shard of their first word."""

    def run(batches):
        words = Words(model.folder, model)
        held, size, base = [], 0, 0

        def flush():
            rank, known = _ranks(np.concatenate([h for _, h in held]))
            doc = np.concatenate([d for d, _ in held])
            inside = np.flatnonzero(doc[:-2] == doc[2:])
            # Numbers rise with hashes, so ranks sort as numbers do.
            number, bits = words.numbers(known)[0], max(1, (len(known) - 1).bit_length())
            x, y, z = rank[inside], rank[inside + 1], rank[inside + 2]
            if 3 * bits <= _KEY_BITS:
                key = np.sort((x << (2 * bits)) | (y << bits) | z)
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                n = np.diff(np.r_[first, len(key)])
                key = key[first]
                a, b, c = number[key >> (2 * bits)], number[(key >> bits) & ((1 << bits) - 1)], number[key & ((1 << bits) - 1)]
            else:
                a, b, c, n = _sorted_trigrams(number[x], number[y], number[z])
            shard = model.shard(a, b).astype(np.uint16 if model.shards <= 65536 else np.int64)
            order = np.argsort(shard, kind="stable")
            a, b, c, n, shard = a[order], b[order], c[order], n[order], shard[order]
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            packed = []
            for i, j in zip(cuts, np.r_[cuts[1:], len(a)]):
                more = np.flatnonzero(n[i:j] > 1)
                packed.append((squeeze(a[i:j].astype(np.uint64)), planes(b[i:j]), planes(c[i:j]), more.astype("<u4").tobytes(), n[i:j][more].astype("<u4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(shard[cuts].astype(np.int32)), *(pa.array(list(x), pa.binary()) for x in zip(*packed))], names=["shard", "a", "b", "c", "more", "n"])

        for batch in batches:
            for lo, _, doc, h, _ in _tokens(batch.column("text")):
                if not len(h):
                    continue
                held.append((doc + (lo + base), h))
                size += len(h)
                if size >= _FLUSH:
                    yield flush()
                    held, size = [], 0
            base += batch.num_rows
        if size:
            yield flush()
        release()

    return run


def _put_trie(model: Model, bits: int):
    """Reduce side: the levels of one shard, as a file.

    Level 1: the first words; level 2: for each its successors; level 3: for
    each pair its successors.  Word numbers are packed, child ranges are
    Elias-Fano pointers; bigrams and trigrams have discounted probabilities,
    words and bigrams the back-off weight of their context, quantised.
    """

    def run(key, table):
        shard = key[0].as_py()
        cols, counts = [[], [], []], []
        for a, b, c, more, n in zip(*(table.column(x).to_pylist() for x in ("a", "b", "c", "more", "n"))):
            cols[0].append(unsqueeze(a).view(np.int64))
            cols[1].append(unplanes(b))
            cols[2].append(unplanes(c))
            count = np.ones(len(cols[0][-1]), np.uint32)
            count[np.frombuffer(more, "<u4")] = np.frombuffer(n, "<u4")
            counts.append(count)
        a, b, c = (np.concatenate(x) for x in cols)
        del cols
        a, b, c, n3 = _sorted_trigrams(a, b, c, np.concatenate(counts))
        del counts
        at2 = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        n2, kids2 = np.add.reduceat(n3, at2), np.diff(np.r_[at2, len(a)])
        a2, b2 = a[at2], b[at2]
        at1 = np.flatnonzero(np.r_[True, a2[1:] != a2[:-1]])
        n1, kids1 = np.add.reduceat(n2, at1), np.diff(np.r_[at1, len(a2)])
        one = a2[at1]
        # A hot word's successors lie in several shards; each of its occurrences begins a trigram.
        here, which = model.is_hot(one)
        n1[here] = model.hot_count[which]
        p3 = (n3 - DISCOUNT) / np.repeat(n2, kids2)
        p2 = (n2 - DISCOUNT) / np.repeat(n1, kids1)
        arrays = {"one": one, "back1": quantise(DISCOUNT * kids1 / n1), "two": _pack_by_parts(b2, bits), "p2": quantise(p2), "back2": quantise(DISCOUNT * kids2 / n2), "three": _pack_by_parts(c, bits), "p3": quantise(p3)}
        arrays |= {f"to2_{k}": v for k, v in ef_encode(np.r_[at1, len(a2)]).items()}
        arrays |= {f"to3_{k}": v for k, v in ef_encode(np.r_[at2, len(a)]).items()}
        _save(f"{model.folder}/trie-{shard:07d}", arrays, {"bits": bits})
        sizes = [len(one), len(a2), len(c)]
        del arrays, a, b, c, p3, n3
        release()
        # Of a hot word: which it is, and its successors here; and one row for the shard.
        return pa.table({"hot": pa.array([-1, *which], pa.int64()), "n": pa.array([sum(sizes), *kids1[here]], pa.int64())})

    return run


def _pack_by_parts(v: np.ndarray, width: int) -> np.ndarray:
    """As _pack, some hundred thousand at once (a multiple of eight, so that parts end on bytes)."""
    step = 1 << 17
    parts = [_pack(v[i : i + step].astype(np.uint64), width)[:-8] for i in range(0, len(v), step)]
    return np.concatenate([*parts, np.zeros(8, np.uint8)])


class Trie:
    """The levels of all shards; a shard is mapped when first asked for."""

    def __init__(self, model: Model):
        self.model = model
        self._files = Shards(model.folder, "trie", lambda a, head: (a, _sub(a, "to2_"), _sub(a, "to3_"), head["bits"]))

    @staticmethod
    def _successor(packed: np.ndarray, bits: int, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
        """In each context's range [lo, hi) the place of the word number `want`, -1 where it isn't.

        The ranges are halved around the last number that doesn't exceed `want`;
        a context of one successor needs the last comparison alone.
        """
        out = lo.copy()
        at = np.flatnonzero(hi - lo > 1)
        a, b, w = lo[at], hi[at], want[at]
        while len(at):
            mid = (a + b) >> 1
            up = _unpack(packed, mid, bits) <= w
            a = np.where(up, mid, a)
            b = np.where(up, b, mid)
            wide = b - a > 1
            if not wide.all():
                out[at[~wide]] = a[~wide]
                at, a, b, w = at[wide], a[wide], b[wide], w[wide]
        ok = lo < hi
        ok[ok] = _unpack(packed, out[ok], bits) == want[ok]
        out[~ok] = -1
        return out

    def lookup(self, a: np.ndarray, b: np.ndarray, c: np.ndarray):
        """For sorted distinct trigrams: (p3, back2) of a b c, then (p2, back1) of a b.

        Zero probability and back-off 1 where the trie has no such node.
        """
        m = len(a)
        p3, back2, p2, back1 = np.zeros(m), np.ones(m), np.zeros(m), np.ones(m)
        shard = self.model.shard(a, b).astype(np.uint16 if self.model.shards <= 65536 else np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.r_[True, shard[order[1:]] != shard[order[:-1]]]) if m else []
        for i, j in zip(cuts, np.r_[cuts[1:], m] if m else []):
            found = self._files.get(int(shard[order[i]]))
            if found is None:
                continue
            t, to2, to3, bits = found
            at = order[i:j]
            x, y, z = a[at], b[at], c[at]
            head1 = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            of1 = np.repeat(np.arange(len(head1)), np.diff(np.r_[head1, len(x)]))
            node1 = np.searchsorted(t["one"], x[head1])
            node1[node1 == len(t["one"])] = 0
            known = t["one"][node1] == x[head1]
            lo1, hi1 = ef_get(to2, node1), ef_get(to2, node1 + 1)
            hi1 = np.where(known, hi1, lo1)
            back1[at] = np.where(known, _VALUE[t["back1"][node1]], 1.0)[of1]
            head2 = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            of2 = np.repeat(np.arange(len(head2)), np.diff(np.r_[head2, len(x)]))
            node2 = self._successor(t["two"], bits, lo1[of1[head2]], hi1[of1[head2]], y[head2])
            has2 = node2 >= 0
            safe = np.where(has2, node2, 0)
            p2[at] = np.where(has2, _VALUE[t["p2"][safe]], 0.0)[of2]
            back2[at] = np.where(has2, _VALUE[t["back2"][safe]], 1.0)[of2]
            lo2, hi2 = np.zeros(len(head2), np.int64), np.zeros(len(head2), np.int64)
            lo2[has2], hi2[has2] = ef_get(to3, node2[has2]), ef_get(to3, node2[has2] + 1)
            node3 = self._successor(t["three"], bits, lo2[of2], hi2[of2], z)
            has3 = node3 >= 0
            p3[at] = np.where(has3, _VALUE[t["p3"][np.where(has3, node3, 0)]], 0.0)
        here, which = self.model.is_hot(a)
        back1[here] = _VALUE[self.model.hot_back[which]]
        return p3, back2, p2, back1


def build(docs: DataFrame, text_col: str = "text") -> Model:
    """Count the words and trigrams of all documents and write the trie into the shared folder.

    Counts meet in tasks, one for each shard of words and of first words, and
    go to files; the driver sees two numbers a shard.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(f"`{text_col}`").alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()[0][0]
    shards = int(-(-size // SHARD_BYTES)) or 1
    folder = local_path(new_folder(spark, "ngram-trie"))
    counted = own.mapInArrow(_word_counts(shards), "shard int, words binary, n binary")
    sizes = np.zeros(shards + 1, np.int64)
    tokens, hot = 0, []
    for r in counted.groupBy("shard").applyInArrow(_put_words(folder, HOT_WORD), "shard int, types bigint, tokens bigint, hot array<bigint>, n array<bigint>").collect():
        sizes[r["shard"] + 1] = r["types"]
        tokens += r["tokens"]
        hot += [(r["shard"], w, n) for w, n in zip(r["hot"], r["n"])]
    first = np.cumsum(sizes)
    hot = np.array(sorted((first[s] + w, n) for s, w, n in hot), np.int64).reshape(-1, 2)  # tokens / HOT_WORD at most
    model = Model(folder, shards, first, tokens, hot[:, 0], hot[:, 1], np.zeros(len(hot), np.uint8), HOT_WORD)
    bits = max(1, int(model.types).bit_length())
    grams = own.mapInArrow(_trigrams(model), "shard int, a binary, b binary, c binary, more binary, n binary")
    nodes = grams.groupBy("shard").applyInArrow(_put_trie(model, bits), "hot bigint, n bigint").groupBy("hot").agg(F.sum("n").alias("n")).collect()
    kids = dict(map(tuple, nodes))
    model.hot_back = quantise(DISCOUNT * np.array([kids[k] for k in range(len(hot))], float) / np.maximum(model.hot_count, 1))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Mean log-probability of each document's words under the trie, and its perplexity.

    A word's probability is that of the interpolated trigram model with
    absolute discounting: p(c|ab) = d(abc) + back(ab) (d(bc) + back(b) p(c)).
    The first two words have the contexts that there are; the end of a
    document is predicted too.  Unknown words share the unigram's spare mass.

    Returns doc_id, n_tokens (end included), mean_logprob (natural) and
    perplexity.  Null, empty and white texts have n_tokens 0 and nulls.
    Repeated rows are scored alike, and count as often as they occur; an empty
    table gives an empty model and result.  Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        words, trie = Words(m.folder, m), Trie(m)
        for batch in batches:
            total, many = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            held, size = [], 0
            for lo, hi, doc, h, count in _tokens(batch.column("text")):
                held.append((doc + lo, h))
                size += len(h)
                if size >= _FLUSH or hi == batch.num_rows:
                    one(m, words, trie, *(np.concatenate(x) for x in zip(*held)), total, many)
                    held, size = [], 0
            none = many == 0
            mean = total / np.maximum(many, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(many), pa.array(mean, mask=none), pa.array(np.exp(-mean), mask=none)], names=["doc_id", "n_tokens", "mean_logprob", "perplexity"])
        release()

    def one(m, words, trie, doc, h, total, many):
        if not len(h):
            return
        back, u = _ranks(h)
        number, count = words.numbers(u)
        p1 = m.unigram(count)[back]
        w = number[back]
        # Each place i asks for its word after the two before it; the second end mark isn't asked for.
        first = np.r_[True, doc[1:] != doc[:-1]]
        second = np.r_[False, first[:-1]] & ~first
        last = np.r_[doc[1:] != doc[:-1], True]
        n = len(h)
        # Trigrams (i, i+1, i+2) inside a document give p3, and p2 of their first two words.
        inside = np.flatnonzero(doc[:-2] == doc[2:]) if n > 2 else np.zeros(0, np.int64)
        # Ranks in this piece stand for words; three of them nearly always fit into one key.
        x, y, z = back[inside], back[inside + 1], back[inside + 2]
        bits = max(1, (len(u) - 1).bit_length())
        order = np.argsort((x << (2 * bits)) | (y << bits) | z) if 3 * bits <= _KEY_BITS else np.lexsort((z, y, x))
        inside = inside[order]
        a, b, c = w[inside], w[inside + 1], w[inside + 2]
        head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]) if len(a) else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(a)]))
        p3, back2, p2, back1 = (x[of] for x in trie.lookup(a[head], b[head], c[head]))
        # At inside[k]: p2 and back1 belong to the pair (i, i+1), p3 and back2 to (i, i+1, i+2).
        pair, lead = np.zeros(n), np.ones(n)
        pair[inside + 1] = p2
        lead[inside + 1] = back1
        lower = np.where(first, p1, pair + lead * p1)
        full = lower.copy()
        full[inside + 2] = p3 + back2 * lower[inside + 2]
        asked = ~last
        total += np.bincount(doc[asked], weights=np.log(np.maximum(np.where(second, lower, full)[asked], 1e-300)), minlength=len(total))
        many += np.bincount(doc[asked], minlength=len(many))

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, mean_logprob double, perplexity double")
