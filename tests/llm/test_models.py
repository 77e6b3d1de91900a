"""Quality, toxicity and context-tree scores."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm.context_tree import build_tree, padded, score_texts
from quire.llm.quality import fit_rules, quality, statistics
from quire.llm.toxicity import features, fit_ftrl, fit_toxicity, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held_out_accuracy(scored, labels, label):
    rows = scored.where("held_out").join(labels.select("doc_id", label), "doc_id").collect()
    return sum(r.predicted == r[label] for r in rows) / len(rows), len(rows)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality(docs, labels)
    accuracy, n = held_out_accuracy(scored, labels, "quality")
    assert n > 50 and accuracy > 0.93
    assert scored.count() == docs.count() and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity(docs, labels)
    accuracy, n = held_out_accuracy(scored, labels, "toxic")
    assert n > 500 and accuracy > 0.95
    assert scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


@pytest.mark.parametrize("score", [quality, toxicity])
def test_odd_rows(spark, score, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (None, 1, 1), (5, None, None), (9, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("false"), labels.where("doc_id = 1")):
        got = score(odd, known)
        assert got.count() == odd.count() and got.where("score IS NULL OR predicted IS NULL").count() == 0
    assert score(empty, labels).count() == 0


def test_rules_are_compiled_as_they_were_fitted(spark):
    rng = np.random.RandomState(0)
    x = rng.rand(600, 3)
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.4)).astype(float)
    model = fit_rules(x, y, ["a", "b", "c"])
    assert 0 < len(model.rules) < 60
    got = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").select("a", "b", "c", model.column().alias("s")).collect()
    assert np.mean([(r.s > 0.5) == ((r.a > 0.5) and (r.b < 0.4)) for r in got]) > 0.97


def quality_by_hand(rules, bias, measured):
    total = bias
    for terms, weight in rules:
        if all(measured[n] <= bound if below else measured[n] > bound for n, below, bound in terms):
            total += weight
    return 1 / (1 + math.exp(-total))


def test_quality_scores_are_the_rules_evaluated_plainly(spark, monkeypatch):
    """Every document's score against its rules in plain Python, over statistics that Spark measured."""
    from quire.llm import quality as module

    fitted = []

    def spy(*args, **kwargs):
        fitted.append(fit_rules(*args, **kwargs))
        return fitted[-1]

    monkeypatch.setattr(module, "fit_rules", spy)
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = {r.doc_id: r for r in quality(docs, labels).collect()}
    measured = docs.select("doc_id", *(c.cast("double").alias(n) for n, c in statistics().items())).collect()
    (model,) = fitted
    assert model.rules and len(measured) == len(scored)
    for row in measured:
        want = quality_by_hand(model.rules, model.bias, row.asDict())
        assert scored[row.doc_id].score == pytest.approx(want, abs=1e-12)
        assert scored[row.doc_id].predicted == int(scored[row.doc_id].score >= 0.7)


def test_toxicity_scores_are_dot_products_over_features(spark):
    """Every document's score against a sum of weights over its distinct features in plain Python."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    weights = dict(zip(model.values.tolist(), model.weights.tolist(), strict=True))
    assert weights
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    scored = toxicity(docs, labels).collect()
    assert len(scored) == len(texts)
    for row in scored:
        z, _ = features(pa.array([texts[row.doc_id]]))
        total = model.bias + sum(weights.get(v, 0.0) for v in set(z.tolist()))
        assert row.score == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, total)))), abs=1e-9)


def ftrl_by_hand(rows, labels, order, epochs, alpha=0.3, beta=1.0, l1=5.0, l2=0.5):
    """FTRL-proximal a coordinate at a time, with an unpenalised intercept."""
    z, n, bias, bias_n = Counter(), Counter(), 0.0, 0.0

    def weight(f):
        if abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - math.copysign(l1, z[f])) / ((beta + math.sqrt(n[f])) / alpha + l2)

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            w = {f: weight(f) for f in rows[i]}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - labels[i]
            for f in rows[i]:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
            bias_n += g * g
            bias -= alpha * g / (beta + math.sqrt(bias_n))
    return {f: weight(f) for f in z if weight(f)}, bias


def test_ftrl_is_its_definition():
    rng = np.random.RandomState(3)
    rows = [np.unique(rng.randint(1, 30, 8)).astype(np.uint64) for _ in range(120)]
    labels = [int(5 in r or 7 in r) for r in rows]
    model = fit_ftrl(rows, labels, sum(labels), len(labels) - sum(labels), min_docs=1)
    want, bias = ftrl_by_hand([r.tolist() for r in rows], labels, np.random.RandomState(7), 12)
    assert dict(zip(model.values.tolist(), model.weights.tolist(), strict=True)) == pytest.approx(want)
    assert model.bias == pytest.approx(bias) and want


def test_statistics(spark):
    row = spark.createDataFrame([("The The cat### | 12\nThe The\nThe The",)], "text string").select(*(c.alias(n) for n, c in statistics().items())).first()
    assert (row.words, row.symbols, row.bars) == (9.0, 3 / 9, 1 / 9)
    assert row.repeats == pytest.approx(4 / 9) and row.same_lines == pytest.approx(1 / 3)


def test_ftrl_is_sparse():
    rng = np.random.RandomState(1)
    rows = [np.unique(np.concatenate([rng.randint(10, 5000, 60), [1] if i % 3 == 0 else [2]])).astype(np.uint64) for i in range(300)]
    model = fit_ftrl(rows, [int(i % 3 == 0) for i in range(300)], 100, 200)
    assert 1 in model.values.tolist() and len(model.values) < 400
    assert model.weights[model.values.tolist().index(1)] > 0


def test_features_are_words_pairs_and_skips():
    z, owner = features(pa.array(["a b c", "a, b", None, "x"]))
    assert np.bincount(owner, minlength=4).tolist() == [6, 3, 0, 1]  # stems need longer words
    assert len(set(z[owner == 0].tolist()) & set(z[owner == 1].tolist())) == 3


def tree_by_definition(texts, depth, least):
    """P(next byte | context) by recursion over the definition."""
    counts = [Counter() for _ in range(depth + 1)]
    for t in texts:
        b = [0] * depth + list(t.lower().encode()) + [255]
        for i in range(depth, len(b)):
            for d in range(depth + 1):
                counts[d][tuple(b[i - d : i]), b[i]] += 1
    kept = [{c for c in {c for c, _ in counts[d]} if d == 0 or sum(n for (x, _), n in counts[d].items() if x == c) >= least} for d in range(depth + 1)]
    kept[0] = {()}

    def pair(rows, bit, prefix):
        out = [0, 0]
        for byte, n in rows.items():
            if byte >> (8 - bit) == prefix:
                out[byte >> (7 - bit) & 1] += n
        return out

    def rows_of(d, c):
        return {b: n for (x, b), n in counts[d].items() if x == c}

    def other(d, c):
        rest = Counter(rows_of(d, c))
        for k in kept[d + 1]:
            if k[1:] == c:
                rest.subtract(rows_of(d + 1, k))
        return rest

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(d, c, bit, prefix):
        own = kt(*pair(rows_of(d, c), bit, prefix))
        if d == depth:
            return own, None
        below = kt(*pair(other(d, c), bit, prefix)) + sum(weighted(d + 1, k, bit, prefix)[0] for k in kept[d + 1] if k[1:] == c)
        total = np.logaddexp(own, below) - math.log(2)
        return total, math.exp(own - math.log(2) - total)

    def chance(past, byte):
        p = 1.0
        for bit in range(8):
            prefix, want = byte >> (8 - bit), byte >> (7 - bit) & 1
            q, rest, d = 0.0, 1.0, 0
            while True:
                c = tuple(past[len(past) - d :]) if d else ()
                n = pair(rows_of(d, c), bit, prefix)
                if d == depth:
                    q += rest * (n[want] + 0.5) / (sum(n) + 1)
                    break
                stay = weighted(d, c, bit, prefix)[1]
                q += rest * stay * (n[want] + 0.5) / (sum(n) + 1)
                rest *= 1 - stay
                longer = tuple(past[len(past) - d - 1 :])
                if longer not in kept[d + 1]:
                    n = pair(other(d, c), bit, prefix)
                    q += rest * (n[want] + 0.5) / (sum(n) + 1)
                    break
                d += 1
            p *= q
        return p

    return counts, kept, chance


def test_context_tree_by_definition():
    texts, depth = ["abracadabra", "Abba", "", "cab"], 2
    counts, kept, chance = tree_by_definition(texts, depth, 2)
    levels = []
    for d in range(depth + 1):
        rows = [(sum(x << (8 * (d - 1 - i)) for i, x in enumerate(c)), b, n) for (c, b), n in counts[d].items() if c in kept[d]]
        levels.append((np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], dtype=float)))
    tree = build_tree(levels, depth)
    for text in ["abra", "", "zebra", "ABBA é"]:
        b = [0] * depth + list("".join(c.lower() if c.isascii() else c for c in text).encode()) + [255]
        want = sum(math.log10(chance(b[:i], b[i])) for i in range(depth, len(b)))
        assert tree.score(pa.array([text]))[0] == pytest.approx(want, rel=1e-5)
    table = 10 ** tree.log_p.reshape(-1, 256).astype(float)
    assert table.sum(axis=1) == pytest.approx(np.ones(len(table)), rel=1e-4)


def test_padding():
    out, at, bounds = padded(pa.array(["aB", None, "c"]), 2)
    assert out.tolist() == [0, 0, 97, 98, 255, 0, 0, 255, 0, 0, 99, 255] and bounds.tolist() == [0, 3, 4, 6] and at.tolist() == [2, 3, 4, 7, 10, 11]


@pytest.mark.parametrize("hot", [1 << 18, 3])
def test_base_score_by_brute_force(spark, odd, hot):
    held = F.col("doc_id") % 3 == 0
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    tokens = [WORD.findall(t.lower()) + [None] for _, t in rows]
    teach = [t for (i, _), t in zip(rows, tokens, strict=True) if i is None or i % 3]
    c = Counter(x for t in teach for x in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(t), sum(c[x] > 0 for x in t), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 4)) for (i, _), t in zip(rows, tokens, strict=True))
    got = score_texts(odd, held, hot_words=hot).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)


def test_no_training_rows(spark, odd, empty):
    assert score_texts(empty, F.lit(False)).count() == 0
    got = score_texts(odd.where("doc_id = 7"), F.lit(True)).first()
    assert got.n_known == 0 and got.train_tokens == 0 and got.score < 0 and got.base_score == 0


def test_every_context_counts_and_the_model_grows(spark):
    """Shards against the tree in memory with all contexts; one line in 100,000 bytes that occurs twice is learnt."""
    rng = np.random.RandomState(2)
    twice = "qzx jwvk qqzz xkcd vwxyz"
    texts = [" ".join(rng.choice(["one", "two", "three", "four"], 400)) for _ in range(60)] + [twice, twice, twice, None, "é x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    held = F.col("doc_id") == 62
    got = {r.doc_id: r.score for r in score_texts(docs, held, depth=4, group=30_000, shard=20_000).collect()}
    assert len(got) == len(texts)
    out, at, _ = padded(pa.array([t for i, t in enumerate(texts) if i != 62]), 4)
    levels = []
    for d in range(5):
        ctx = sum((out[at - j].astype(np.uint64) << np.uint64(8 * (j - 1)) for j in range(1, d + 1)), np.zeros(len(at), dtype=np.uint64))
        pairs, c = np.unique(np.stack([ctx, out[at].astype(np.uint64)]), axis=1, return_counts=True)
        levels.append((pairs[0], pairs[1].astype(np.int64), c.astype(float)))
    want = build_tree(levels, 4).score(pa.array(texts))
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, rel=1e-4)
    deeper = {r.doc_id: r.score for r in score_texts(docs, held, group=30_000, shard=20_000).collect()}
    assert deeper[62] > -1.0 * len(twice)


def test_the_tree_beats_word_frequencies_on_held_out_rows(spark):
    """Code length per byte, and the held-out total against add-one word frequencies."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).where("held_out")
    r = got.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.count_if(F.col("score") > F.col("base_score")).alias("up"), F.count(F.lit(1)).alias("n"), F.min("bits_per_byte").alias("least")).first()
    assert r.s > r.b and r.up > 0.9 * r.n and r.least > 0


def test_the_quality_fit_is_bounded_where_ids_repeat(spark, documents, labels, monkeypatch):
    from quire.llm import quality as module

    seen = []

    def fit(x, y, names):
        seen.append(len(x))
        return fit_rules(x, y, names)

    monkeypatch.setattr(module, "fit_rules", fit)
    many = documents.union(documents).union(documents)
    scored = module.quality(many, labels, sample_rows=40)
    assert seen == [40] and scored.count() == many.count()
