"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as lower-cased (A-Z) bytes with each run of white space as one space. An item of m bytes may
be matched with up to ``k = floor(rate * m)`` edits: it is split into k + 1 pieces, one of which must occur exactly wherever
the item does. All pieces are searched at once by their first eight bytes, a hit's neighbourhood must hold enough of the
item's 5-byte strings (an edit destroys at most five), and what is left is verified by Myers' bit-parallel distance over the
windows that the pieces allow. Whole texts are scanned, in blocks that overlap.

Repetitive texts stay cheap: a piece that an item says several times, or several items say, is found once; hits whose windows
overlap are one window, in which 5-byte strings are counted by prefix sums and which is verified in one pass. Work for a text and an
item with hits is at most linear in the text, times the item's length over 64.

The benchmark is measured first. Up to ``block_bytes`` it is one broadcast; beyond, it is dealt into blocks of that size which
are searched one after another, so what is broadcast is bounded.

Cases: null or blank items and texts match nothing; items shorter than eight bytes are one piece; repeated rows are matched
each; an empty table or benchmark gives no match; other columns are kept by :func:`drop_contaminated`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import text_batches
from .textvec import LOWER, SPACE, U, chunks, text_bytes, tidy

RATE = 0.1
BLOCK_BYTES = 8 << 20
SCAN = 1 << 20
#: Groups of an item's 5-byte strings that are counted apart.
GROUPS = 64
_BREAK = SPACE.copy()
_BREAK[0] = True


def normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of several texts with eight zeros after each, and their bounds (without the zeros)."""
    buf, offsets = text_bytes(texts)
    low = LOWER[buf]
    gap = _BREAK[low] if len(low) else np.zeros(0, dtype=bool)
    low[gap] = 0x20
    keep = ~gap
    if len(low):
        first = np.zeros(len(low) + 1, dtype=bool)
        first[offsets] = True
        before = np.concatenate([[True], gap[:-1]]) | first[:-1]
        keep |= gap & ~before
    total = np.concatenate([[0], np.cumsum(keep)])
    sizes = total[offsets[1:]] - total[offsets[:-1]]
    starts = total[offsets[:-1]] + 8 * np.arange(len(sizes))
    out = np.zeros(int(total[-1]) + 8 * len(sizes), dtype=np.uint8)
    if len(low):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        out[np.arange(int(total[-1])) + 8 * owner] = low[keep]
    ends = starts + sizes
    trail = (sizes > 0) & (out[np.maximum(ends - 1, 0)] == 0x20)
    return out, np.stack([starts, ends - trail])


def myers(pattern: bytes, text: bytes, most: int) -> int | None:
    """The smallest edit distance of the pattern to any substring of the text, if at most ``most``."""
    m = len(pattern)
    ones, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    plus, minus, score, best = ones, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & ones
        hp = (minus | ~(d0 | plus)) & ones
        hn = plus & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            best = min(best, score)
        hp = (hp << 1) & ones
        hn = (hn << 1) & ones
        plus = (hn | ~(d0 | hp)) & ones
        minus = hp & d0
    return best if best <= most else None


@dataclass
class Items:
    """Search tables of a block of test items. A piece is a string that items say; ``uses`` gives, for each, the items with the first
    and the last place where they say it."""

    ids: list[int]
    texts: list[bytes]
    budgets: list[int]
    keys: dict[int, tuple[np.ndarray, np.ndarray]]
    pieces: list[bytes]
    uses: list[list[tuple[int, int, int]]]
    grams: list[tuple[np.ndarray, np.ndarray]]
    seen: dict[int, np.ndarray]


def prepare(rows: list[tuple[int, str]], rate: float = RATE) -> Items:
    ids, texts, budgets, grams = [], [], [], []
    known: dict[bytes, int] = {}
    uses: list[dict[int, tuple[int, int]]] = []
    for item_id, text in rows:
        out, ((start,), (end,)) = normal(pa.array([text], pa.string()))
        body = out[start:end].tobytes()
        if not body:
            continue
        i, m, k = len(ids), len(body), int(rate * len(body))
        ids.append(item_id), texts.append(body), budgets.append(k)
        cuts = [m * j // (k + 1) for j in range(k + 2)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            piece = known.setdefault(body[a:b], len(uses))
            if piece == len(uses):
                uses.append({})
            first, _ = uses[piece].get(i, (a, a))
            uses[piece][i] = (first, a)
        grams.append(np.unique(_five(np.frombuffer(body, dtype=np.uint8)), return_counts=True))
    by_length: dict[int, list[tuple[int, int]]] = {}
    for text, piece in known.items():
        width = min(8, len(text))
        by_length.setdefault(width, []).append((int.from_bytes(text[:width], "big"), piece))
    keys, seen = {}, {}
    for width, found in by_length.items():
        found.sort()
        keys[width] = (np.array([v for v, _ in found], dtype=U), np.array([p for _, p in found], dtype=np.int64))
        table = np.zeros(1 << 20, dtype=bool)
        table[_spot(keys[width][0])] = True
        seen[width] = table
    return Items(ids, texts, budgets, keys, list(known), [[(i, a, z) for i, (a, z) in u.items()] for u in uses], grams, seen)


def _five(buf: np.ndarray) -> np.ndarray:
    """The five bytes from each place that has so many."""
    n = max(0, len(buf) - 4)
    v = np.zeros(n, dtype=U)
    for j in range(5):
        v = (v << U(8)) | buf[j : j + n].astype(U)
    return v


def _spot(v: np.ndarray) -> np.ndarray:
    return ((v * U(0x9E3779B97F4A7C15)) >> U(44)).astype(np.int64)


def _packed(buf: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first n places, the first highest; eight bytes must follow."""
    v = np.zeros(n, dtype=U)
    for j in range(8):
        v = (v << U(8)) | buf[j : j + n].astype(U)
    return v


def _hits(buf: np.ndarray, items: Items) -> dict[int, np.ndarray]:
    """For each piece that occurs, the places where it does."""
    place, piece = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for a in range(0, max(len(buf) - 8, 0), SCAN):
        n = min(SCAN, len(buf) - 8 - a)
        v = _packed(buf[a : a + n + 8], n)
        for width, (keys, which) in items.keys.items():
            value = v >> U(8 * (8 - width))
            maybe = np.flatnonzero(items.seen[width][_spot(value)])
            lo = np.searchsorted(keys, value[maybe], side="left")
            times = np.searchsorted(keys, value[maybe], side="right") - lo
            hit = np.repeat(maybe, times)
            nth = np.arange(len(hit)) - np.repeat(np.cumsum(times) - times, times)
            place.append(hit + a)
            piece.append(which[np.repeat(lo, times) + nth])
    at, which = np.concatenate(place), np.concatenate(piece)
    order = np.argsort(which, kind="stable")
    at, which = at[order], which[order]
    bounds = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1], [True]])) if len(at) else np.zeros(1, dtype=np.int64)
    found = {}
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        mine, text = at[lo:hi], items.pieces[int(which[lo])]
        for j in range(8, len(text)):  # the rest of a longer piece
            mine = mine[buf[np.minimum(mine + j, len(buf) - 1)] == text[j]]
        if len(mine):
            found[int(which[lo])] = mine
    return found


def _merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows sorted by (row, lo) as disjoint ones: row, lo, hi, and which of them holds each window."""
    reach = np.maximum.accumulate(hi)  # rows follow one another, so a later row's windows end later
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (lo[1:] > reach[:-1])])
    first = np.flatnonzero(new)
    return row[first], lo[first], reach[np.concatenate([first[1:], [len(row)]]) - 1], np.cumsum(new) - 1


def _enough(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, joined: tuple, grams: tuple[np.ndarray, np.ndarray], need: int) -> np.ndarray:
    """Which windows hold at least ``need`` of an item's 5-byte strings, none counted more often than the item says it."""
    _, a, b, inside = joined
    values, said = grams
    base = np.concatenate([[0], np.cumsum(b - a)])
    spots = np.empty(int(base[-1]), dtype=np.int32)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        v = _five(buf[x:y])
        at = np.minimum(np.searchsorted(values, v), len(values) - 1)
        spots[base[i] : base[i] + len(v)] = np.where(values[at] == v, at, -1)
        spots[base[i] + len(v) : base[i + 1]] = -1
    first, last = base[inside] + lo - a[inside], base[inside] + np.maximum(hi - 4, lo) - a[inside]
    total = np.concatenate([[0], np.cumsum(spots >= 0, dtype=np.int32)])
    ok = total[last] - total[first] >= need
    if ok.sum() > GROUPS:  # many windows: count again by groups of strings, each no more often than the item says them
        counts, cap = np.zeros(len(lo), dtype=np.int64), np.bincount(np.arange(len(values)) % GROUPS, weights=said, minlength=GROUPS).astype(np.int64)
        group = np.where(spots >= 0, spots % GROUPS, -1)
        for g in range(min(GROUPS, len(values))):
            total = np.concatenate([[0], np.cumsum(group == g, dtype=np.int32)])
            counts += np.minimum(total[last] - total[first], cap[g])
        ok &= counts >= need
    return ok


def matches(texts: pa.Array, items: Items) -> list[tuple[int, int, int]]:
    """(row, item index, distance) of every text and item within the item's budget."""
    if not items.ids or not len(texts):
        return []
    buf, (starts, ends) = normal(texts)
    hits = _hits(buf, items)
    by_item: dict[int, list[tuple[int, int, int]]] = {}
    for piece in hits:
        for i, first, last in items.uses[piece]:
            by_item.setdefault(i, []).append((piece, first, last))
    found: list[tuple[int, int, int]] = []
    for i, own in sorted(by_item.items()):
        m, k = len(items.texts[i]), items.budgets[i]
        at = np.concatenate([hits[p] for p, _, _ in own])
        begin = at - np.concatenate([np.full(len(hits[p]), last) for p, _, last in own])
        end = at - np.concatenate([np.full(len(hits[p]), first) for p, first, _ in own])
        row = np.searchsorted(starts, at, side="right") - 1
        lo, hi = np.maximum(begin - k, starts[row]), np.minimum(end + m + k, ends[row])
        order = np.lexsort((hi, lo, row))
        row, lo, hi = row[order], lo[order], hi[order]
        kept = np.concatenate([[True], (row[1:] != row[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        row, lo, hi = row[kept], lo[kept], hi[kept]
        need = m - 4 - 5 * k
        if need > 0:
            ok = _enough(buf, lo, hi, _merged(row, lo, hi), items.grams[i], need)
            row, lo, hi = row[ok], lo[ok], hi[ok]
        if not len(row):
            continue
        best: dict[int, int] = {}
        for r, a, b in zip(*(x.tolist() for x in _merged(row, lo, hi)[:3]), strict=True):
            if best.get(r) == 0:
                continue
            window = buf[a:b].tobytes()
            d = 0 if items.texts[i] in window else myers(items.texts[i], window, k)
            if d is not None and d < best.get(r, k + 1):
                best[r] = d
        found += [(r, i, d) for r, d in best.items()]
    return found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, rate: float, block_bytes: int):
    """The benchmark's search tables, a bounded block at a time."""
    text_batches(benchmark.sparkSession)
    rows = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first().b
    n = -(-int(total) // block_bytes)
    for block in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == block)
        items = prepare(sorted((r.i, r.t) for r in part.collect()), rate)
        if items.ids:
            yield benchmark.sparkSession.sparkContext.broadcast(items)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance): every document with every item that it holds within the item's edit budget."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    out = None
    for items in _blocks(benchmark, item_col, item_text_col, rate, block_bytes):

        @tidy
        def run(batches):
            for batch in batches:
                for first, part in chunks(batch.column(1)):
                    got = matches(part, items.value)
                    if got:
                        ids = batch.column(0).slice(first, len(part)).take(pa.array([r for r, _, _ in got]))
                        yield pa.RecordBatch.from_arrays([ids, pa.array([items.value.ids[i] for _, i, _ in got], pa.int64()), pa.array([d for _, _, d in got], pa.int32())], names=["doc_id", "item_id", "distance"])

        got = texts.mapInArrow(run, "doc_id long, item_id long, distance int")
        out = got if out is None else out.union(got)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int")
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance")).withColumnRenamed("doc_id", id_col).withColumnRenamed("item_id", item_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a test item; no shuffle."""
    at = docs.columns.index(text_col)
    for items in _blocks(benchmark, item_col, item_text_col, rate, block_bytes):

        @tidy
        def run(batches):
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for first, part in chunks(batch.column(at)):
                    clean[[first + r for r, _, _ in matches(part, items.value)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
