"""Substring dedup by MinHash banding of paragraphs.

A paragraph is a run of ``WORDS`` words that begins at an anchor: a word pair whose hash is the smallest of ``WINDOW``
neighbouring pairs. Anchors depend on nearby words only, so a passage has the same paragraphs wherever it is embedded, and
every run of WINDOW + WORDS - 1 = 25 words that two documents share holds a whole one. A passage of 51 words or more whose
five-word shingles are 0.8 alike has such a run whichever words were replaced: one replaced word costs five shingles, so there
is at most one for every 45 words, and the longest run between them has 25 words or more.

1. Each paragraph has ``BANDS`` keys of ``ROWS`` MinHash values over its shingles; ``tune`` gives the bands for a recall of 0.95
   of *one* paragraph at 0.8. A key that two documents hold makes its paragraphs candidates; equal ones always collide.
2. Candidates are verified and linked: equal contents are one node. Two contents are 0.8 alike exactly when, as sets of shingles, they
   are equal, or one has one shingle more than the other (of four or more), or both have nine and share eight. So each content has a
   key for its set and for its set without each of its shingles, and the contents of a key form a star: linear work for crowds of
   any size, and no pair is missed. Where no three words in a row are said twice, only the set without its first or its last shingle
   can be another's, at either end of it (a paragraph that begins a word later, too), and two keys do.
   Connected components of these links are the clusters.
3. Each paragraph is held against an earlier place: the first document with the same content, or else the first of its
   cluster. Where a chain of paragraphs along one such document ends, the words around both places (``AROUND``) are aligned
   outwards, across single replaced, added or left out words.
4. The matched runs along one earlier document are joined over at most ``GAP`` words into a span, as long as the span's
   shingles are 0.8 alike to what it is aligned with; spans of ``MIN_WORDS`` words or more are removed.

Cases: a null or short text has no paragraph; a null id takes no part and its text stays as it is; rows that share an id are
one document (a span is applied only where its words are found again); repeats within one document stay; a line said over and
over is matched along its whole run as soon as an earlier document says it for a paragraph's length; an empty table gives an
empty result; other columns, whatever their names, are kept by :func:`remove_repeats`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bloom
from .components import components
from .store import cut, drop, few, join_hot, text_batches, unused
from .textvec import U, Words, binary_column, chunks, grams, mix, tidy, words_of

WORDS, WINDOW, SHINGLE = 13, 13, 5
BANDS, ROWS = 3, 2
SIMILARITY = (80, 100)
MIN_WORDS = 50
GAP = 8
AROUND = 40
EDITS, RUN = 3, 4
MIDDLE = WORDS // 2
OUTWARDS = AROUND + WORDS - MIDDLE
_SEEDS = np.array(
    [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB],
    dtype=U,
)


def tune(similarity: float, recall: float, rows: int = ROWS) -> int:
    """The fewest bands of ``rows`` values with which one paragraph of that similarity is found with the given recall."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def _runs(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i:i + width], by doubling; the last width - 1 places are not meaningful."""
    have, out = 1, x
    while have * 2 <= width:
        new = out.copy()
        pick(out[:-have], out[have:], out=new[:-have])
        out, have = new, have * 2
    if have < width:
        step = width - have
        new = out.copy()
        pick(out[:-step], out[step:], out=new[:-step])
        out = new
    return out


def anchors(w: Words) -> np.ndarray:
    """Word indices at which a paragraph of WORDS words begins."""
    n = len(w.h)
    if n < WORDS:
        return np.zeros(0, dtype=np.int64)
    last = np.repeat(w.bounds[1:], w.counts())
    v = mix(w.h * U(0x9FB21C651E98DF25) + np.concatenate([w.h[1:], w.h[:1]])) | U(1)
    width = min(WINDOW, n)
    least = _runs(v, width, np.minimum)
    # a text's last window begins where it holds pairs of this text only, or at its first word
    least[np.arange(n) + width + 1 > last] = 0
    back = _runs(np.concatenate([np.zeros(width - 1, dtype=U), least]), width, np.maximum)[:n]
    at = np.flatnonzero((back == v) & (np.arange(n) + WORDS <= last))
    if len(at):
        # of a run of equal pairs every WORDS-th is enough
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (v[at[1:]] != v[at[:-1]])
        begin = np.flatnonzero(new)[np.cumsum(new) - 1]
        at = at[(np.arange(len(at)) - begin) % WORDS == 0]
    return at


def paragraphs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words, content hashes, band keys by band) of the paragraphs of several texts."""
    at = anchors(w)
    inside = _shingles(w, at)
    content = np.zeros(len(at), dtype=U)
    for z in inside:
        content = content * U(0x9E3779B97F4A7C15) + z
    keys = np.zeros((BANDS, len(at)), dtype=U)
    for b in range(BANDS):
        for r in range(ROWS):
            keys[b] = keys[b] * U(0xC2B2AE3D27D4EB4F) + mix((inside * _SEEDS[b * ROWS + r]).min(axis=0))
        keys[b] = mix(keys[b] + U(b + 1))
    return at, mix(content), keys


def _runs_of(w: Words, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words of each paragraph, a run to a row."""
    z, first = grams(w, k)
    s = np.zeros(len(w.h), dtype=U)
    s[first] = z
    n = WORDS - k + 1
    return np.stack([s[at + j] for j in range(n)]) if len(at) else np.zeros((n, 0), dtype=U)


def _shingles(w: Words, at: np.ndarray) -> np.ndarray:
    return _runs_of(w, at, SHINGLE)


def set_keys(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the paragraphs at ``at``: the number of different shingles, a hash of their set, and hashes of the set without one
    shingle each, one paragraph's after another, with their bounds."""
    inside = _shingles(w, at)
    ordered = np.sort(inside, axis=0)
    new = np.ones(ordered.shape, dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    each = mix(ordered + U(3))
    size, whole = new.sum(axis=0), np.where(new, each, U(0)).sum(axis=0, dtype=U)
    threes = np.sort(_runs_of(w, at, 3), axis=0)
    plain = (threes[1:] != threes[:-1]).all(axis=0)
    left = new & ~plain & (size > 4)
    which, row = np.nonzero(left)
    ends = np.flatnonzero(plain)
    owner = np.concatenate([row, ends, ends])
    gone = np.concatenate([each[which, row], mix(inside[0, ends] + U(3)), mix(inside[-1, ends] + U(3))])
    order = np.argsort(owner, kind="stable")
    return size, whole, (whole[owner] - gone)[order], np.searchsorted(owner[order], np.arange(len(at) + 1))


@tidy
def _all_keys(batches):
    for batch in batches:
        for first, part in chunks(batch.column(1)):
            w = words_of(part)
            at, _, keys = paragraphs(w)
            if len(at):
                owner = np.searchsorted(w.bounds, at, side="right") - 1
                ids = batch.column(0).slice(first, len(part)).take(pa.array(owner))
                for k in keys:
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), ids], names=["k", "doc_id"])


def _candidates(table):
    @tidy
    def run(batches):
        for batch in batches:
            for first, part in chunks(batch.column(1)):
                w = words_of(part)
                at, content, keys = paragraphs(w)
                keep = np.flatnonzero(np.logical_or.reduce([bloom.maybe(table.value, k) for k in keys])) if len(at) else []
                if not len(keep):
                    continue
                at = at[keep]
                owner = np.searchsorted(w.bounds, at, side="right") - 1
                size, whole, less, bounds = set_keys(w, at)
                sets = (pa.array(size.astype(np.int32)), pa.array(whole.view(np.int64)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(less.view(np.int64))))
                ids = batch.column(0).slice(first, len(part)).take(pa.array(owner))
                pos = pa.array((at - w.bounds[owner]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids, pos, pa.array(content[keep].view(np.int64)), *sets], names=["doc_id", "pos", "h", "size", "whole", "less"])

    return run


def _place_keys(doc_id: np.ndarray, pos: np.ndarray, side: np.ndarray | int) -> np.ndarray:
    place = doc_id.astype(np.int64).view(U) * U(0x9E3779B97F4A7C15) + pos.astype(U) * U(2)
    return mix(place + (U(side) if isinstance(side, int) else side.astype(U)))


@tidy
def _keyed(batches):
    for batch in batches:
        key = _place_keys(*(np.asarray(batch.column(c)) for c in range(3)))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["k"])


def _surroundings(table):
    """(doc_id, pos, side, words): for paragraphs whose places the filter holds, OUTWARDS words from the middle to the left (side
    0) or to the right (1), 16 bits a word and 0 beyond the text."""

    @tidy
    def run(batches):
        for batch in batches:
            for first, part in chunks(batch.column(1)):
                w = words_of(part)
                at = anchors(w)
                if not len(at):
                    continue
                owner = np.searchsorted(w.bounds, at, side="right") - 1
                ids = np.asarray(batch.column(0).slice(first, len(part)))[owner]
                for side, steps in enumerate((np.arange(MIDDLE - 1, MIDDLE - 1 - OUTWARDS, -1), np.arange(MIDDLE, MIDDLE + OUTWARDS))):
                    keep = np.flatnonzero(bloom.maybe(table.value, _place_keys(ids, at - w.bounds[owner], side)))
                    if not len(keep):
                        continue
                    place, own = at[keep][:, None] + steps, owner[keep]
                    real = (place >= w.bounds[own][:, None]) & (place < w.bounds[own + 1][:, None])
                    words = np.where(real, (w.h[np.clip(place, 0, len(w.h) - 1)] >> U(48)).astype(np.uint16) | np.uint16(1), np.uint16(0))
                    columns = [pa.array(ids[keep]), pa.array((at[keep] - w.bounds[own]).astype(np.int32)), pa.array(np.full(len(keep), side, dtype=np.int32))]
                    yield pa.RecordBatch.from_arrays([*columns, binary_column(words.ravel(), np.arange(len(keep) + 1) * OUTWARDS)], names=["doc_id", "pos", "side", "words"])

    return run


def near_links(contents: DataFrame) -> DataFrame:
    """(a, b): stars of contents whose shingle sets are 0.8 alike. ``contents`` is one row (h, size, whole, less) a content: the number of its
    shingles, the key of their set, and keys of the set without one of them."""
    most = WORDS - SHINGLE + 1
    whole = contents.where(F.col("size") < most).select(F.col("whole").alias("k"), F.col("size").alias("t"), "h", F.lit(True).alias("full"))
    less = contents.select(F.explode("less").alias("k"), (F.col("size") - 1).alias("t"), "h", F.lit(False).alias("full"))
    some = whole.unionByName(less).select(F.xxhash64("k", "t").alias("k"), "t", "h", "full")
    # sets without one shingle are alike among themselves only if they had all nine; others only resemble a whole set
    middle = F.when(F.first("t") == most - 1, F.min("h")).otherwise(F.min(F.when(F.col("full"), F.col("h"))))
    stars = cut(some.groupBy("k").agg(F.count(F.lit(1)).alias("c"), middle.alias("a")).where("c > 1 AND a IS NOT NULL"), "stars")
    return join_hot(some.select("k", "h"), stars.select("k", "a"), "k", stars.select("k", "c")).where("a <> h").select("a", F.col("h").alias("b"))


def _outwards(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Matched runs (first, end, shift of y against x) of each row from its first word on, across up to EDITS single edits; the
    first run may be empty, a later one has RUN words or more."""
    n, width = x.shape
    shifts = np.arange(-EDITS, EDITS + 1)
    length = np.zeros((len(shifts), n, width + 1), dtype=np.int16)
    for i, d in enumerate(shifts):
        a, b = max(0, -d), min(width, width - d)
        same = np.zeros((n, width), dtype=bool)
        same[:, a:b] = (x[:, a:b] == y[:, a + d : b + d]) & (x[:, a:b] != 0)
        for k in range(width - 1, -1, -1):
            length[i, :, k] = np.where(same[:, k], length[i, :, k + 1] + 1, 0)
    rows = np.arange(n)
    at, d = np.zeros(n, dtype=np.int64), np.full(n, EDITS)
    out, alive = [], np.ones(n, dtype=bool)
    for turn in range(EDITS + 1):
        if turn:
            # a word replaced, a word more in x, a word more in y
            ways = [(np.minimum(at + 1, width), d), (np.minimum(at + 1, width), np.maximum(d - 1, 0)), (at, np.minimum(d + 1, 2 * EDITS))]
            runs = np.stack([length[w, rows, k] for k, w in ways])
            best = runs.argmax(axis=0)
            at, d = (np.stack([way[j] for way in ways])[best, rows] for j in range(2))
            alive &= runs.max(axis=0) >= RUN
        run = np.where(alive, length[d, rows, at], 0)
        out.append((at.copy(), at + run, shifts[d]))
        at = at + run
    return out


@tidy
def _extended(batches):
    """Matched runs (doc_id, ref_id, first word, end word, shift) outwards from the paragraphs at the ends of chains."""
    for batch in batches:
        for first in range(0, batch.num_rows, 4096):
            part = batch.slice(first, 4096)
            n = part.num_rows
            pos, off, side = (np.asarray(part.column(c), dtype=np.int64) for c in (1, 3, 4))
            x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint16).reshape(n, OUTWARDS) for c in (5, 6))
            middle, right = pos + MIDDLE, side == 1
            for a, b, d in _outwards(x, y):
                some = np.flatnonzero(b > a)
                begin, end = np.where(right, middle + a, middle - b), np.where(right, middle + b, middle - a)
                columns = [begin, end, off + np.where(right, d, -d)]
                take = pa.array(some)
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(2).take(take), *(pa.array(c[some].astype(np.int32)) for c in columns)], names=["doc_id", "ref_id", "a", "b", "shift"])


def spans_of(runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans of MIN_WORDS words or more from sorted matched runs (first, end, shift) along one other document."""
    per, of = SIMILARITY
    pieces: list[list[int]] = []
    for a, b, d in runs:
        if pieces and a <= pieces[-1][1] and (d == pieces[-1][2] or a + SHINGLE <= pieces[-1][1] or b <= pieces[-1][1]):
            if b > pieces[-1][1]:
                pieces[-1][1:] = [b, d]
        else:
            pieces.append([a, b, d])
    out, i = [], 0
    while i < len(pieces):
        best, matched, j = None, 0, i
        while j < len(pieces) and (j == i or (pieces[j][0] - pieces[j - 1][1] <= GAP and abs(pieces[j][2] - pieces[j - 1][2]) <= GAP)):
            a, b, _ = pieces[j]
            matched += max(0, b - a - SHINGLE + 1)
            all_ = b - pieces[i][0] - SHINGLE + 1
            if b - pieces[i][0] >= MIN_WORDS and of * matched >= per * (2 * all_ - matched):
                best = j
            j += 1
        if best is None:
            i += 1
        else:
            out.append((pieces[i][0], pieces[best][1]))
            i = best + 1
    return out


@tidy
def _merged(batches):
    """A document's spans, from its matched runs; those that touch become one, with the smallest document that keeps a part."""
    for batch in batches:
        out = []
        for doc_id, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by_ref: dict[int, list[tuple[int, int, int]]] = {}
            for r in runs:
                by_ref.setdefault(r["ref_id"], []).append((r["a"], r["b"], r["shift"]))
            spans = sorted((a, b, ref) for ref, found in by_ref.items() for a, b in spans_of(found))
            last = None
            for a, b, ref in spans:
                if last is not None and a <= last[1]:
                    last = (last[0], max(last[1], b), min(last[2], ref))
                    continue
                if last is not None:
                    out.append((doc_id, *last))
                last = (a, b, ref)
            if last is not None:
                out.append((doc_id, *last))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "first_word", "end_word", "keep_id"])


def _earlier(found: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, pos, h, ref_id, ref_pos, exact): each paragraph that an earlier document holds, with that place; and the tables that
    this reads."""
    contents = found.groupBy("h").agg(
        *(F.first(c).alias(c) for c in ("size", "whole", "less")), F.min(F.struct("doc_id", "pos")).alias("m"), F.max("doc_id").alias("z"), F.count(F.lit(1)).alias("c")
    )
    contents = cut(contents, "contents")
    cluster = components(near_links(contents.select("h", "size", "whole", "less")))
    joined = contents.join(cluster.select(F.col("node").alias("h"), F.col("component").alias("g")).hint("merge"), "h", "left").withColumn("g", F.coalesce("g", "h"))
    joined = cut(joined.select("h", "g", "m", "z", "c"), "joined")
    groups = joined.groupBy("g").agg(F.min("m").alias("gm"), F.max("z").alias("gz"), F.count(F.lit(1)).alias("c"))
    groups = cut(groups.where("gm.doc_id <> gz"), "groups")
    first = join_hot(joined.drop("c"), groups.select("g", "gm"), "g", groups.select("g", "c")).where("gm IS NOT NULL")
    first = cut(first.select("h", "m", "gm"), "first")
    met = join_hot(found.select("doc_id", "pos", "h"), first, "h", contents.select("h", "c")).where("m IS NOT NULL")
    exact = F.col("m.doc_id") != F.col("doc_id")
    ref = F.when(exact, F.col("m")).when(F.col("gm.doc_id") != F.col("doc_id"), F.col("gm"))
    met = met.select("doc_id", "pos", "h", exact.alias("exact"), ref.alias("ref")).where("ref IS NOT NULL")
    met = met.select("doc_id", "pos", "h", F.col("ref.doc_id").alias("ref_id"), F.col("ref.pos").alias("ref_pos"), "exact")
    return met, [contents, joined, groups, first]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first_word, end_word, keep_id): spans of words to remove, each with the first document that holds a part of it."""
    text_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    keys = texts.mapInArrow(_all_keys, "k long, doc_id long").groupBy("k").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    table = sc.broadcast(bloom.make(keys.where("a <> b").select("k")))
    found = cut(texts.mapInArrow(_candidates(table), "doc_id long, pos int, h long, size int, whole long, less array<long>"), "found")
    table.destroy()
    met, used = _earlier(found)
    along = Window.partitionBy("doc_id", "ref_id").orderBy("pos")
    # a content said over and over is one chain along its first place
    again = (F.lag("h").over(along) == F.col("h")) & (F.col("pos") - F.lag("pos").over(along) <= WORDS)
    met = met.withColumn("new", ~F.coalesce(again, F.lit(False)))
    begun = F.last(F.when(F.col("new"), F.col("ref_pos") - F.col("pos")), ignorenulls=True)
    met = met.withColumn("shift", begun.over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def ends(step) -> Column:
        apart = F.abs(step("pos").over(along) - F.col("pos")) > WORDS
        return ~F.col("exact") | F.coalesce(apart | (step("shift").over(along) != F.col("shift")), F.lit(True))

    met = met.withColumn("left", ends(F.lag)).withColumn("right", ends(F.lead))
    met = cut(met.select("doc_id", "pos", "ref_id", "ref_pos", "shift", "left", "right", "exact"), "chains")
    for table in (found, *used):
        drop(table)
    sides = F.filter(F.array(F.when(F.col("left"), 0), F.when(F.col("right"), 1)), lambda s: s.isNotNull())
    asked = met.where("left OR right").select("doc_id", "pos", "ref_id", "ref_pos", "shift", F.explode(sides).alias("side"))
    places = asked.select("doc_id", "pos", "side").union(asked.select("ref_id", "ref_pos", "side"))
    table = sc.broadcast(bloom.make(places.mapInArrow(_keyed, "k long")))
    near = texts.mapInArrow(_surroundings(table), "doc_id long, pos int, side int, words binary")
    near = cut(near.select(F.xxhash64("doc_id", "pos", "side").alias("k"), "words"), "around")
    table.destroy()
    near = near.dropDuplicates(["k"])  # rows that share an id
    own = asked.withColumn("k", F.xxhash64("doc_id", "pos", "side")).join(near.withColumnRenamed("words", "x").hint("merge"), "k").drop("k")
    sizes = cut(asked.groupBy(F.xxhash64("ref_id", "ref_pos", "side").alias("k")).agg(F.count(F.lit(1)).alias("c")), "sizes")
    both = join_hot(own.withColumn("k", F.xxhash64("ref_id", "ref_pos", "side")), near, "k", sizes).where("words IS NOT NULL")
    grown = both.select("doc_id", "pos", "ref_id", "shift", "side", "x", "words").mapInArrow(_extended, "doc_id long, ref_id long, a int, b int, shift int")
    runs = met.where("exact").select("doc_id", "ref_id", F.col("pos").alias("a"), (F.col("pos") + WORDS).alias("b"), "shift").union(grown)
    marks = runs.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("a", "b", "shift", "ref_id"))).alias("runs"))
    merged = marks.mapInArrow(_merged, "doc_id long, first_word int, end_word int, keep_id long")
    return merged.withColumnRenamed("doc_id", id_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without the repeated spans; documents of which only blanks are left go. The spans meet their documents in a join:
    a broadcast while they are few, else a shuffle of the texts."""
    spans = cut(repeated_spans(docs, id_col, text_col), "spans")
    own, cuts = unused(docs, "span_id"), unused(docs, "cuts")
    marks = spans.groupBy(F.col(id_col).alias(own)).agg(F.array_sort(F.collect_list(F.array("first_word", "end_word"))).alias(cuts))
    marked = docs.join(few(marks, spans, 100_000), F.col(id_col) == F.col(own), "left").drop(own)
    marked = marked.withColumn(cuts, F.coalesce(F.flatten(cuts), F.array().cast("array<int>")))
    at, spans_at = marked.columns.index(text_col), marked.columns.index(cuts)

    @tidy
    def run(batches):
        for batch in batches:
            text, marks = batch.column(at), batch.column(spans_at).to_pylist()
            hit = [i for i, m in enumerate(marks) if m]
            stays = np.ones(batch.num_rows, dtype=bool)
            values = text.to_pylist() if hit else None
            for i in hit:
                if values[i] is None:
                    continue
                w = words_of(pa.array([values[i]]))
                raw, out, last, m = values[i].encode(), [], 0, marks[i]
                for a, b in zip(m[::2], m[1::2], strict=True):
                    if a < len(w.starts):
                        out.append(raw[last : w.starts[a]])
                        last = int(w.ends[min(b, len(w.ends)) - 1])
                values[i] = b"".join([*out, raw[last:]]).decode()
                stays[i] = bool(values[i].strip(" \t\n\r\v\f"))
            columns = list(batch.columns)
            if hit:
                columns[at] = pa.array(values, type=text.type)
            del columns[spans_at]
            yield pa.RecordBatch.from_arrays(columns, names=[n for j, n in enumerate(batch.schema.names) if j != spans_at]).filter(pa.array(stays))

    kept = marked.mapInArrow(run, docs.schema)
    if chars_col and chars_col in docs.columns:
        kept = kept.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return kept
