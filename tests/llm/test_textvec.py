import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.textvec import chunks, grams, shingle_sets, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n .x\x0b", max_size=40)), max_size=6)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words_match_the_pattern(rows):
    w = words_of(pa.array(rows, pa.string()))
    want = [WORD.findall(lower(t)) for t in rows]
    assert w.counts().tolist() == [len(x) for x in want]
    flat = [x for r in want for x in r]
    assert [bytes(w.buf[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)] == flat
    same = {}
    for x, h in zip(flat, w.h.tolist(), strict=True):
        assert same.setdefault(x, h) == h
    assert len(set(same.values())) == len(same)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 4))
def test_shingles_match_brute_force(rows, k):
    w = words_of(pa.array(rows, pa.string()))
    z, bounds = shingle_sets(w, k)
    seen = {}
    for i, t in enumerate(rows):
        x = WORD.findall(lower(t))
        want = {tuple(x[j : j + k]) for j in range(len(x) - k + 1)} if len(x) >= k else ({tuple(x)} if x else set())
        got = z[bounds[i] : bounds[i + 1]].tolist()
        assert len(got) == len(want) and sorted(set(got)) == got
        key = frozenset(want)
        assert seen.setdefault(key, got) == got
    assert len({tuple(v) for v in seen.values()}) == len(seen)


def test_a_slice_gives_the_same_words():
    a = pa.array(["xx yy", None, "aa bb cc", "dd"])
    assert words_of(a.slice(2, 2)).h.tolist() == words_of(a).h[2:].tolist()
    assert [(f, len(p)) for f, p in chunks(a, 4)] == [(0, 1), (1, 1), (2, 1), (3, 1)] or sum(len(p) for _, p in chunks(a, 4)) == 4
    z, at = grams(words_of(a), 2)
    assert at.tolist() == [0, 2, 3] and len(set(z.tolist())) == 3
