import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from prismora.llm import _shared, _text as T
from prismora.llm._sorted_files import SortedFiles, put_shard, shard_of

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab \n\tß深", max_size=30)), max_size=8)


def tokens(t):
    return [w for w in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if w]


@settings(max_examples=60, deadline=None)
@given(texts, st.integers(1, 3))
def test_tokens_and_ngrams(values, n):
    column = pa.array(values, pa.string())
    assert T.word_counts(column).tolist() == [len(tokens(v)) for v in values]
    sizes = []
    for a, b, doc, h in T.words(column):
        d, g = T.ngram_sets(doc, h, b - a, n)
        sizes += np.bincount(d, minlength=b - a).tolist()
        assert len(set(zip(d.tolist(), g.tolist()))) == len(g)
    grams = lambda w: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    assert sizes == [len(grams(tokens(v))) for v in values]


def test_hash_is_of_the_bytes_alone():
    column = pa.array(["x abc", "abc  x", "é abc"])
    (_, _, _, h), = T.words(column)
    assert h[1] == h[2] == h[5] and h[0] == h[3] and len(set(h.tolist())) == 3


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_packed_keys(n):
    keys = np.sort(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    assert (_shared.unsqueeze(_shared.squeeze(keys)) == keys).all()


def test_sorted_files(tmp_path):
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)) * np.uint64(2)
    shard = shard_of(keys, 64, 5)
    for s in np.unique(shard):
        put_shard(str(tmp_path), int(s), keys[shard == s], np.flatnonzero(shard == s))
    files = SortedFiles(str(tmp_path), 64, 5)
    assert (files.get(keys) == np.arange(500)).all()
    assert (files.get(keys + np.uint64(1), -1) == -1).all()
