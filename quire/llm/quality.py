"""Quality classifier: a sparse rule ensemble.

Statistics of each text are Spark column expressions. Small boosted trees over them are fitted on at most ``sample_rows``
labelled documents (the smallest id hashes; the bound is a parameter), every path from a root becomes a conjunctive rule, a
lasso-penalised logistic regression keeps few of the rules, and those are compiled back into one column expression, so
scoring runs inside the JVM with no shuffle. Whole texts are measured.

Cases: a null, empty or wordless text has all statistics 0 and the score of the rules that then hold; without labels of both
classes the score is their smoothed rate; repeated label rows of an id count once, by the smaller label; null labels or ids
teach nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut

SAMPLE_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def statistics(text_col: str = "text") -> dict[str, Column]:
    """Named statistics of a text, from counts that are made once."""
    t = F.coalesce(F.col(text_col), F.lit(""))

    def per(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    def chars(which: str) -> Column:
        return F.length(t) - F.length(F.translate(t, which, ""))

    n, words, lines = F.length(t), F.regexp_count(t, F.lit(WORD)), F.size(F.split(t, "\n"))
    return {
        "words": words.cast("double"),
        "chars_per_word": per(n, words),
        "symbols": per(chars("#$%&*@^~_=+<>{}[]\\"), words),
        "bars": per(chars("|"), words),
        "digits": per(chars("0123456789"), n),
        "upper": per(chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n),
        "stops": per(chars(".!?"), words),
        "commas": per(chars(",;:"), words),
        "repeats": per(F.regexp_count(t, F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?=[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D]))")), words),
        "long_words": per(F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]{20,}+")), words),
        "wide": per(F.octet_length(t) - n, n),
        "lines": per(lines, words),
        "same_lines": 1 - per(F.size(F.array_distinct(F.split(t, "\n"))), lines),
        "different_words": per(F.size(F.array_distinct(F.split(F.substring(F.lower(t), 1, 2**31 - 1), r"[\x20\x09-\x0D]+"))), words),
    }


@dataclass
class Rules:
    """score = logistic(bias + sum of weights of the rules that hold); a rule is a list of (name, at most?, bound)."""

    bias: float
    rules: list[tuple[list[tuple[str, bool, float]], float]]

    def column(self) -> Column:
        total = F.lit(float(self.bias))
        for terms, weight in self.rules:
            holds = F.lit(True)
            for name, below, bound in terms:
                holds = holds & ((F.col(name) <= bound) if below else (F.col(name) > bound))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rows: np.ndarray, least: int, path: tuple, paths: list) -> list[tuple[np.ndarray, float]]:
    """Grow one tree by gain on binned columns; appends each node's path and returns (rows, value) of leaves."""
    if path:
        paths.append(path)
    value = -g[rows].sum() / (h[rows].sum() + 1.0)
    if depth == 0 or len(rows) < 2 * least:
        return [(rows, value)]
    best = (1e-6, None)
    for j in range(bins.shape[1]):
        b = bins[rows, j]
        size = int(bins[:, j].max()) + 1
        sg, sh, sn = (np.cumsum(np.bincount(b, weights=w, minlength=size)) for w in (g[rows], h[rows], np.ones(len(rows))))
        left, right = sg**2 / (sh + 1.0), (sg[-1] - sg) ** 2 / (sh[-1] - sh + 1.0)
        gain = np.where((sn >= least) & (sn[-1] - sn >= least), left + right - sg[-1] ** 2 / (sh[-1] + 1.0), 0)
        c = int(gain.argmax())
        if gain[c] > best[0]:
            best = (gain[c], (j, c))
    if best[1] is None:
        return [(rows, value)]
    j, c = best[1]
    low = bins[rows, j] <= c
    return _tree(bins, g, h, depth - 1, rows[low], least, (*path, (j, True, c)), paths) + _tree(bins, g, h, depth - 1, rows[~low], least, (*path, (j, False, c)), paths)


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, penalty: float = 0.002, seed: int = 3) -> Rules:
    """Boost trees on random halves, turn paths into rules, and fit lasso logistic weights by accelerated proximal steps."""
    rate = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Rules(float(np.log(rate / (1 - rate))), [])
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    order = np.random.RandomState(seed)
    f = np.full(len(y), np.log(rate / (1 - rate)))
    paths: list[tuple] = []
    least = max(5, len(y) // 400)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        rows = np.flatnonzero(order.rand(len(y)) < 0.5)
        if len(rows) < 2 * least:
            rows = np.arange(len(y))
        grown: list[tuple] = []
        _tree(bins, p - y, p * (1 - p), depth, rows, least, (), grown)
        for path in grown:
            if all(len(edges[j]) > c for j, _, c in path):
                paths.append(tuple(sorted(path)))
        # apply the tree to all rows
        leaves = [q for q in grown if not any(len(o) > len(q) and o[: len(q)] == q for o in grown)]
        for path in leaves:
            hold = np.ones(len(y), dtype=bool)
            for j, low, c in path:
                hold &= (bins[:, j] <= c) == low
            got = hold[rows]
            if got.any():
                f[hold] += 0.3 * -(p - y)[rows][got].sum() / ((p * (1 - p))[rows][got].sum() + 1.0)
    paths = sorted(set(paths))
    z = np.ones((len(y), len(paths)), dtype=np.float64)
    for i, path in enumerate(paths):
        for j, low, c in path:
            z[:, i] *= (bins[:, j] <= c) == low
    _, once = np.unique(z, axis=1, return_index=True)
    once = np.sort(once)
    z, paths = z[:, once], [paths[i] for i in once]
    spread = np.maximum(z.std(axis=0), 0.02)
    mean = z.mean(axis=0)
    s = (z - mean) / spread
    w, b = np.zeros(s.shape[1]), float(np.log(rate / (1 - rate)))
    step = 1 / (0.25 * max(1.0, np.linalg.norm(s, 2) ** 2 / len(y)) + 0.25)
    v, bv, t = w.copy(), b, 1.0
    for _ in range(600):
        p = 1 / (1 + np.exp(-np.clip(s @ v + bv, -40, 40)))
        gw, gb = s.T @ (p - y) / len(y), float((p - y).mean())
        new = v - step * gw
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty)
        nb = bv - step * gb
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, bv = new + (t - 1) / t1 * (new - w), nb + (t - 1) / t1 * (nb - b)
        w, b, t = new, nb, t1
    live = np.flatnonzero(np.abs(w) > 1e-6)
    raw = w[live] / spread[live]
    rules = [([(names[j], low, float(edges[j][c])) for j, low, c in paths[i]], float(r)) for i, r in zip(live, raw, strict=True)]
    return Rules(float(b - (raw * mean[live]).sum()), rules)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.7, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted): learns from ids whose crc32 is not ``held`` modulo ``folds``."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds, F.lit(-1))
    stats = statistics()
    measured = cut(docs.select("doc_id", (fold == held).alias("held_out"), *(c.cast("double").alias(n) for n, c in stats.items())), "stats")
    usable = labels.where((fold != held) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("y"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    drawn = measured.join(F.broadcast(sample), "doc_id").orderBy(F.xxhash64("doc_id"), *stats).limit(sample_rows)  # ids may repeat
    got = drawn.select("y", *stats).toArrow()
    y = np.asarray(got.column("y"), dtype=np.float64)
    x = np.stack([np.asarray(got.column(n), dtype=np.float64) for n in stats], axis=1) if len(y) else np.zeros((0, len(stats)))
    order = np.lexsort((*x.T, y)) if len(y) else np.zeros(0, dtype=np.int64)
    model = fit_rules(x[order], y[order], list(stats))
    return measured.select("doc_id", "held_out", model.column().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
