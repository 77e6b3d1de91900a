import random

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from quire.llm.paragraphs import BANDS, MIN_WORDS, SHINGLE, WINDOW, WORDS, anchors, near_links, paragraphs, remove_repeats, repeated_spans, set_keys, tune
from quire.llm.textvec import words_of


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def planted(seed=5):
    """Documents with known passages: text, and the spans that others repeat."""
    rng = random.Random(seed)
    passages = [words(rng, n) for n in (51, 60, 90, 150, 400)] + [words(rng, 30)]
    docs, want = [], {}
    for i in range(40):
        body = words(rng, 300)
        if i % 2 == 0:
            p = passages[i // 2 % len(passages)]
            at = rng.randrange(50, 250)
            body[at:at] = p
            if len(p) > MIN_WORDS and i // 2 >= len(passages):
                want[i] = (at, at + len(p))
        docs.append((i, " ".join(body)))
    return docs, want


def test_passages_are_found_to_their_ends(spark):
    docs, want = planted()
    got = {r.doc_id: (r.first_word, r.end_word) for r in repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert set(got) == set(want)
    for i, (a, b) in want.items():  # a paragraph that is 80 % alike may reach a few words beyond
        assert got[i][0] in range(a - 5, a + 1) and got[i][1] in range(b, b + 6)


def test_removal_leaves_the_rest(spark):
    docs, _ = planted()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, a string, n_chars long")
    want = {r.doc_id: (r.first_word, r.end_word) for r in repeated_spans(df).collect()}
    out = {r.doc_id: r for r in remove_repeats(df).collect()}
    for i, t in docs:
        w = t.split()
        if i in want:
            a, b = want[i]
            assert out[i].text.split() == w[:a] + w[b:]
        else:
            assert out[i].text == t
        assert out[i].n_chars == len(out[i].text)


def test_near_copies(spark):
    rng = random.Random(8)
    base = words(rng, 200)
    docs = [(0, " ".join(words(rng, 80) + base))]
    for i in range(1, 8):
        w = list(base)
        for at in rng.sample(range(200), 3):
            w[at] = "changed"
        docs.append((i, " ".join(words(rng, 80) + w)))
    got = repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(1, 8))
    assert all(r.keep_id < r.doc_id for r in got)


def test_odd_rows(spark, odd, empty):
    got = repeated_spans(odd).collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(2, 1), (3, 1)}
    kept = remove_repeats(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in odd.collect() if r.doc_id not in (2, 3))
    assert repeated_spans(empty).count() == 0 and remove_repeats(empty).count() == 0


@pytest.mark.parametrize("line", ["la", "one two three four five six seven", "we say this line again and again in many places"])
def test_a_line_said_over_and_over(spark, line):
    docs = [(i, f"begin{i} " + f"{line} " * 40 + f"end{i}") for i in range(5)]
    got = {r.doc_id: r for r in repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    n = 40 * len(line.split())
    if n < MIN_WORDS:
        assert not got
    else:
        assert set(got) == {1, 2, 3, 4} and all((r.first_word, r.end_word, r.keep_id) == (1, 1 + n, 0) for r in got.values())


def test_anchors_depend_on_nearby_words_only():
    rng = random.Random(1)
    passage = words(rng, WINDOW + WORDS - 1)
    for _ in range(50):
        one, two = (" ".join(words(rng, rng.randrange(60)) + passage + words(rng, rng.randrange(60))) for _ in range(2))
        w = words_of(pa.array([one, two]))
        at = anchors(w)
        first = [one.split().index(passage[0]), w.bounds[1] + two.split().index(passage[0])]
        inside = [set((at[(at >= f) & (at + WORDS <= f + len(passage))] - f).tolist()) for f in first]
        assert inside[0] & inside[1]


def test_bands():
    """One paragraph at 0.8 is found with a recall of 0.95."""
    assert tune(0.8, 0.95) == BANDS and 1 - (1 - 0.8**2) ** BANDS >= 0.95


def test_links_of_contents_by_brute_force(spark):
    """Contents that are 0.8 alike are linked, in crowds, shifted by a word and with repeated shingles too; all others are not."""
    rng = random.Random(2)
    base = [words(rng, WORDS) for _ in range(4)]
    texts = base + [b[:-1] + [f"x{i}"] for b in base[:3] for i in range(150)] + [[f"y{i}"] + b[1:] for b in base[1:3] for i in range(20)]
    texts += [b[:7] + ["z"] + b[8:] for b in base] + [b[1:] + [f"s{i}"] for b in base for i in range(3)] + [[f"t{i}"] + b[:-1] for b in base for i in range(3)]
    for period in range(1, 13):  # lines said over and over, at every phase, and broken at their ends
        cycle = [f"p{period}_{i}" for i in range(period)] * 20
        texts += [cycle[i : i + WORDS] for i in range(period)]
        texts += [[*cycle[i : i + n], *(f"q{period}_{i}_{j}" for j in range(WORDS - n))] for i in range(min(period, 3)) for n in (9, 11, 12)]
    for _ in range(300):  # few words, so that shingles and runs of three repeat
        texts.append([rng.choice(["a", "b", "c"]) for _ in range(WORDS)])
        texts.append(texts[-1][1:] + ["a"])
    texts = [list(t) for t in dict.fromkeys(map(tuple, texts))]
    w = words_of(pa.array([" ".join(t) for t in texts]))
    size, whole, less, bounds = set_keys(w, w.bounds[:-1])
    rows = [(i, int(size[i]), int(whole[i].view(np.int64)), [int(x) for x in less[bounds[i] : bounds[i + 1]].view(np.int64)]) for i in range(len(texts))]
    got = near_links(spark.createDataFrame(rows, "h long, size int, whole long, less array<long>")).collect()
    sets = [{tuple(t[k : k + SHINGLE]) for k in range(WORDS - SHINGLE + 1)} for t in texts]
    up = list(range(len(texts)))

    def root(h):
        while up[h] != h:
            h = up[h]
        return h

    for r in got:
        assert 100 * len(sets[r.a] & sets[r.b]) >= 80 * len(sets[r.a] | sets[r.b]), (texts[r.a], texts[r.b])
        up[root(r.a)] = root(r.b)
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                assert root(i) == root(j), (texts[i], texts[j])
    assert len(got) > 400


def test_exact_copies_reach_their_ends_behind_an_edited_copy(spark):
    """Documents 1 and 2 hold the passage word for word, document 0 with one word changed: the copies go whole."""
    docs, length = [], 51
    for case in range(100):
        rng = random.Random(case)
        passage = words(rng, length)
        edited = list(passage)
        edited[length // 2 + 10] = "changed"
        docs += [(3 * case + i, " ".join(words(rng, 60) + p + words(rng, 60))) for i, p in enumerate((edited, passage, passage))]
    got = {r.doc_id: r for r in repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    whole = [c for c in range(100) if 3 * c + 2 in got and got[3 * c + 2].first_word <= 60 and got[3 * c + 2].end_word >= 60 + length]
    assert len(whole) >= 98


def similar(p, q):
    s, t = ({tuple(x[i : i + SHINGLE]) for i in range(len(x) - SHINGLE + 1)} for x in (p, q))
    return 100 * len(s & t) >= 80 * len(s | t)


@pytest.mark.parametrize("edit", ["replaced", "added", "left out"])
def test_recall_of_edited_passages_by_brute_force(spark, edit):
    """Every pair of passages that are 0.8 alike, compared directly, loses its second copy; recall of 0.95 and more, and hardly
    anything else goes."""
    rng = random.Random(7)
    docs, alike = [], []
    for case in range(300):
        n = rng.choice([51, 55, 60, 80, 100, 150, 240])
        passage = words(rng, n)
        edited = list(passage)
        for _ in range(rng.choice([1, 1, 2, 3])):
            at = rng.randrange(2, len(edited) - 2)
            if edit == "replaced":
                edited[at] = "changed"
            elif edit == "added":
                edited[at:at] = ["added"]
            else:
                del edited[at]
        docs += [(2 * case, " ".join(words(rng, 40) + passage + words(rng, 40))), (2 * case + 1, " ".join(words(rng, 40) + edited + words(rng, 40)))]
        if similar(passage, edited) and min(len(passage), len(edited)) >= 51:
            alike.append((2 * case + 1, len(edited)))
    got = {}
    for r in repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        assert r.doc_id % 2 == 1 and r.keep_id == r.doc_id - 1
        assert r.first_word >= 40 - 1 and r.end_word <= 40 + len(docs[r.doc_id][1].split()) - 80 + 1
        got[r.doc_id] = got.get(r.doc_id, 0) + r.end_word - r.first_word
    found = [i for i, n in alike if got.get(i, 0) >= 0.9 * n]
    assert len(alike) > 100 and len(found) >= 0.95 * len(alike)
