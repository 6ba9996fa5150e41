import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.elias_fano import EliasFano
from quire.llm.words import batches, shingle_sets


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbÉé中 \n\t\x0b\x1c.-", max_size=40)), max_size=8), st.integers(1, 60))
def test_words_are_those_of_bytes_split(texts, size):
    names, hashes = [], []
    for a, b, w in batches(pa.array(texts, pa.string()), size=size):
        for k in range(b - a):
            hashes += w.hashes[w.first[k] : w.first[k + 1]].tolist()
            names += (texts[a + k] or "").encode().lower().split()
    assert len(names) == len(hashes)
    assert len(set(zip(names, hashes))) == len(set(names)) == len(set(hashes))


def test_long_words_and_few_words():
    t = ["x" * 5000 + " " + "x" * 5001 + " " + "x" * 5000, "a", "", "a b"]
    (_, _, w), = batches(pa.array(t))
    assert w.hashes[0] == w.hashes[2] != w.hashes[1]
    assert [len(s) for s in shingle_sets(w, 3)] == [1, 1, 0, 1]


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 10**9)), st.lists(st.integers(0, 2 * 10**9)))
def test_elias_fano(values, asked):
    v = np.array(sorted(values), np.int64)
    e = EliasFano.of(v)
    assert e.access(np.arange(len(v))).tolist() == v.tolist()
    place = {int(x): i for i, x in enumerate(v)}
    asked = [*asked, *v.tolist()]
    assert e.find(np.array(asked, np.int64)).tolist() == [place.get(x, -1) for x in asked]
