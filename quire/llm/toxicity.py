"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are split at every ASCII byte that is neither letter nor digit. A document's features are the 64-bit hashes of its
words, of the stems (first bytes) of longer words, of neighbouring pairs and of pairs with one word between, each counted once. Per-coordinate learning rates and the L1 term
keep most weights at exactly zero, so the model is a short table that is broadcast. It is fitted in one executor task on at
most ``per_class`` labelled documents of either class (the smallest id hashes), in the order of their hashes, as long as their different
features number ``max_features`` at most (both bounds are parameters and keep the task's share fixed); only the weights come to
the driver. The intercept is then moved to the classes' true proportion, counted over all labels. Every text is scored whole.

Cases: a null, empty or wordless text gets the intercept's score; with no usable label the score is 0.5 (the smoothed rate
when only one class is labelled); repeated label rows of an id count once, by the larger label; null labels or ids teach
nothing; labelled ids that several rows share teach by each of them, within the bounds; an empty table gives an empty result;
other columns, whatever their names, are ignored or, by :func:`score_toxicity`, kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import text_batches, unused
from .textvec import U, binary_column, chunks, mix, tidy, words_of

PER_CLASS = 3000
MAX_FEATURES = 16_000_000
MIN_DOCS = 5
STEMS = (4, 5, 6)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes (with repeats) and the index of the text that each is from."""
    w = words_of(texts, breaks="punctuation")
    owner = w.owner()
    parts, owners = [w.h], [owner]
    for gap, salt in ((1, 0x8CB92BA72F3D8DD7), (2, 0xAEF17502108EF2D9)):
        if len(w.h) > gap:
            same = np.flatnonzero(owner[gap:] == owner[:-gap])
            parts.append(mix(w.h[same] * U(salt) + w.h[same + gap]))
            owners.append(owner[same])
    for stem in STEMS:
        long = np.flatnonzero(w.ends - w.starts > stem)
        packed = np.zeros(len(long), dtype=U)
        for j in range(stem):
            packed = (packed << U(8)) | w.buf[w.starts[long] + j].astype(U)
        parts.append(mix(packed ^ U((stem * 0x9FB21C651E98DF25) % 2**64)))
        owners.append(owner[long])
    return np.concatenate(parts), np.concatenate(owners)


@dataclass
class Model:
    values: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        seen = np.zeros(1 << 16, dtype=bool)
        seen[(self.values & U(0xFFFF)).astype(np.int64)] = True
        return seen

    def score(self, texts: pa.Array, table: np.ndarray) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        if len(self.values):
            z, owner = features(texts)
            maybe = np.flatnonzero(table[(z & U(0xFFFF)).astype(np.int64)])
            z, owner = z[maybe], owner[maybe]
            at = np.minimum(np.searchsorted(self.values, z), len(self.values) - 1)
            hit = self.values[at] == z
            pairs = np.unique(owner[hit] * len(self.values) + at[hit])
            np.add.at(total, pairs // len(self.values), self.weights[pairs % len(self.values)])
        return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def fit_ftrl(
    rows: list[np.ndarray], labels: list[int], positives: int, negatives: int, alpha: float = 0.3, beta: float = 1.0,
    l1: float = 5.0, l2: float = 0.5, epochs: int = 12, min_docs: int = MIN_DOCS,
) -> Model:
    """``rows`` are distinct features of each sampled document; positives and negatives count all labels, for the intercept."""
    prior = math.log((positives + 1) / (negatives + 1))
    if not rows or min(sum(labels), len(labels) - sum(labels)) == 0:
        return Model(np.zeros(0, dtype=U), np.zeros(0), prior)
    # a coarse count by the low bits first: most features occur once and need not be sorted
    coarse = np.zeros(1 << 23, dtype=np.uint16)
    low = U((1 << 23) - 1)
    for x in rows:
        coarse[np.unique((x & low).astype(np.int64))] += 1
    rows = [x[coarse[(x & low).astype(np.int64)] >= min_docs] for x in rows]
    del coarse
    values, where, counts = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    dense = np.cumsum(counts >= min_docs) - 1
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    kept = counts[where] >= min_docs
    ids = [dense[where[a:b][kept[a:b]]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    values = values[counts >= min_docs]
    z, n, w = np.zeros(len(values)), np.zeros(len(values)), np.zeros(len(values))
    bias = bias_n = 0.0
    order = np.random.RandomState(7)
    for _ in range(epochs):
        for i in order.permutation(len(ids)):
            x = ids[i]
            zx, nx = z[x], n[x]
            wx = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + wx.sum()))))
            g = p - labels[i]
            grown = nx + g * g
            z[x] = zx + g - (np.sqrt(grown) - np.sqrt(nx)) / alpha * wx
            n[x] = grown
            bias_n += g * g
            bias -= alpha * g / (beta + math.sqrt(bias_n))
    live = np.abs(z) > l1
    w[live] = -(z[live] - np.sign(z[live]) * l1) / ((beta + np.sqrt(n[live])) / alpha + l2)
    ones = sum(labels)
    shift = prior - math.log((ones + 1) / (len(labels) - ones + 1))
    return Model(values[live], w[live], bias + shift)


@tidy
def _training_rows(batches):
    for batch in batches:
        for first, part in chunks(batch.column(0)):
            z, owner = features(part)
            order = np.lexsort((z, owner))
            z, owner = z[order], owner[order]
            keep = np.ones(len(z), dtype=bool)
            keep[1:] = (z[1:] != z[:-1]) | (owner[1:] != owner[:-1])
            bounds = np.searchsorted(owner[keep], np.arange(len(part) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, len(part)), batch.column(2).slice(first, len(part)), binary_column(z[keep], bounds)], names=["h", "y", "x"])


def _fit(positives: int, negatives: int, max_features: int):
    @tidy
    def run(batches):
        rows, labels, held = [], [], 0
        for batch in batches:
            for y, x in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = np.frombuffer(x.as_buffer(), dtype=U)
                if held + len(found) <= max_features:
                    rows.append(found)
                    labels.append(y)
                    held += len(found)
        model = fit_ftrl(rows, labels, positives, negatives)
        yield pa.RecordBatch.from_arrays([pa.array([model.values.tobytes()]), pa.array([model.weights.tobytes()]), pa.array([model.bias])], names=["v", "w", "bias"])

    return run


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_class: int = PER_CLASS, max_features: int = MAX_FEATURES,
) -> Model:
    """``learns`` says, over ``labels``, which ids may teach."""
    text_batches(docs.sparkSession)
    usable = labels.where(learns & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    usable = usable.groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y")).withColumn("h", F.xxhash64("i"))
    known = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    sample = [usable.where(F.col("y") == y).orderBy("h", "i").limit(per_class) for y in (0, 1)]
    # at most 2 * per_class rows of three numbers; the rows are taken in the order of their hashes
    sample = sample[0].union(sample[1])
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    rows = texts.join(F.broadcast(sample), "i").select("t", "h", "y").mapInArrow(_training_rows, "h long, y int, x binary")
    fit = _fit(known.get(1, 0), known.get(0, 0), max_features)
    got = rows.repartition(1).sortWithinPartitions("h", "y", "x").mapInArrow(fit, "v binary, w binary, bias double").first()
    if got is None:
        return fit_ftrl([], [], known.get(1, 0), known.get(0, 0))
    return Model(np.frombuffer(got.v, dtype=U), np.frombuffer(got.w), got.bias)


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score; ``score_col`` must be a new name."""
    text_batches(docs.sparkSession)
    if score_col != unused(docs, score_col):
        raise ValueError(f"{score_col} is a column already; name another score_col")
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    @tidy
    def run(batches):
        table = held.value.table()
        for batch in batches:
            for first, part in chunks(batch.column(at)):
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(part)) for c in batch.columns), pa.array(held.value.score(part, table))], names=[*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted): learns from ids whose crc32 is not ``held`` modulo ``folds``."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(-1))
    model = fit_toxicity(docs, labels, fold != held)
    scored = score_toxicity(docs.select("doc_id", (fold == held).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
