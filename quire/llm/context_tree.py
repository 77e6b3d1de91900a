"""Language-model scores by context-tree weighting over bytes.

Texts are lower-cased (A-Z) bytes with an end mark. Every byte is eight binary choices, most significant bit first; each of
the 255 places in that binary tree has a context tree of its own over the preceding ``DEPTH`` bytes, with a
Krichevsky-Trofimov estimate at every node, and the weighted probability of a node mixes its own estimate with the product
of its children's. Every context of the training rows is in the tree, however rare, so the model grows with the corpus.

No process holds the model. Texts are taken in groups of about GROUP bytes; a group asks for each different place (context
and byte) that it holds, once, with the count of its training rows. Places are dealt to shards by their nearest ROOT bytes,
as many shards as the corpus has SHARD bytes. A shard adds up the counts of all groups, weighs its subtrees and hands the
sums at their roots up; the levels above (contexts of under ROOT bytes, so their number does not depend on the corpus) are
weighed by the driver and broadcast; with them the shard answers every group's places, and answers meet their texts again.

Beside it the base model: add-one word frequencies. Counts are made over all training rows, pre-aggregated where they are
made. The HOT_WORDS most frequent counts are broadcast (12 bytes each); all other words meet their counts in a join.

Cases: a null text is empty (one end token, one end mark); with no training rows every probability is uniform and the base
is log10(1 / 1) a token; repeated ids are scored row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut, drop, text_batches
from .textvec import LOWER, U, chunks, mix, text_bytes, tidy, words_of

DEPTH = 6
ROOT = 3
GROUP = 1 << 24
SHARD = 1 << 23
HOT_WORDS = 1 << 18
END_WORD = 0x5BD1E9955BD1E995
END_BYTE = 0xFF


def padded(texts: pa.Array, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with ``depth`` zeros before and the end mark after each text; places that are predicted; text bounds among them."""
    buf, offsets = text_bytes(texts)
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    out = np.zeros(len(buf) + n * (depth + 1), dtype=np.uint8)
    begins = offsets[:-1] + np.arange(n) * (depth + 1) + depth
    spot = np.ones(len(out), dtype=bool)
    for j in range(1, depth + 1):
        spot[begins - j] = False
    out[begins + sizes] = END_BYTE
    place = spot.copy()
    place[begins + sizes] = False
    out[place] = LOWER[buf]
    return out, np.flatnonzero(spot), np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)


def _keys(out: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` bytes before each place, the nearest highest, and its own byte lowest."""
    key = out[at].astype(U)
    for j in range(1, depth + 1):
        key |= out[at - j].astype(U) << U(8 * (depth - j + 1))
    return key


class _Tally:
    """Counts of keys within a task, folded whenever many are held and handed on when the table itself is large."""

    def __init__(self, hold: int = 1 << 21, most: int = 1 << 20):
        self.hold, self.most = hold, most
        self.raw, self.size = [], 0
        self.keys, self.counts = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None):
        self.raw.append((keys, counts))
        self.size += len(keys)
        if self.size >= self.hold:
            yield from self.fold(False)

    def fold(self, done: bool):
        if self.raw:
            new = np.concatenate([k for k, _ in self.raw])
            keys, counts = np.unique(new, return_counts=True)
            both = np.concatenate([self.keys, keys])
            sums = np.concatenate([self.counts, counts])
            order = np.argsort(both, kind="stable")
            both, sums = both[order], sums[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, dtype=np.int64)
            self.keys, self.counts = both[first], np.add.reduceat(sums, first) if len(first) else sums
            self.raw, self.size = [], 0
        if len(self.keys) and (done or len(self.keys) > self.most):
            yield pa.RecordBatch.from_arrays([pa.array(self.keys.view(np.int64)), pa.array(self.counts)], names=["h", "c"])
            self.keys, self.counts = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)


@tidy
def _count(batches):
    words = _Tally()
    for batch in batches:
        for _, part in chunks(batch.column(0)):
            yield from words.add(np.concatenate([words_of(part).h, np.full(len(part), END_WORD, dtype=U)]))
    yield from words.fold(True)


def _folded(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and their counts in all."""
    both, sums = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(both, kind="stable")
    both, sums = both[order], sums[order]
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, dtype=np.int64)
    return both[first], np.add.reduceat(sums, first) if len(first) else sums


def _dealt(keys: np.ndarray, depth: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted keys by shard, and the bounds of the shards in it."""
    shard = (mix(keys >> U(8 * (depth - min(ROOT, depth) + 1))) % U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys by their steps, byte planes apart, as most planes hold little."""
    steps = np.diff(keys, prepend=U(0))
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(U).ravel(), dtype=U)


ASKED = ["grp", "shard", "n", "places", "counts", "rows"]
SENT = ["rid", "doc_id", "held_out", "t"]


def _shipped(columns: list[pa.Array]) -> bytes:
    """A record batch of rows, compressed."""
    batch = pa.RecordBatch.from_arrays(columns, names=SENT)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _ask(depth: int, shards: int, group: int):
    """Compressed batches of texts (shard -1) with their group, and for each group and shard the group's places with their counts
    in training rows."""

    @tidy
    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 24, [], 0

        def asked():
            keys, counts = _folded([k for k, _ in held], [c for _, c in held])
            order, bounds = _dealt(keys, depth, shards)
            some = np.flatnonzero(np.diff(bounds))
            mine = [order[bounds[i] : bounds[i + 1]] for i in some]
            blobs = [_packed(keys[m]) for m in mine]
            seen = [pa.compress(counts[m].astype(np.int64).tobytes(), codec="zstd", asbytes=True) for m in mine]
            m = len(some)
            columns = [pa.array(np.full(m, number)), pa.array(some.astype(np.int32)), pa.array([len(x) for x in mine], pa.int32())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary()), pa.array(seen, pa.binary()), pa.nulls(m, pa.binary())], names=ASKED)

        for batch in batches:
            for first, part in chunks(batch.column(3)):
                out, at, bounds = padded(part, depth)
                keys = _keys(out, at, depth)
                apart = np.repeat(np.asarray(batch.column(2).slice(first, len(part)).to_numpy(zero_copy_only=False), dtype=bool), np.diff(bounds))
                teach, counts = np.unique(keys[~apart], return_counts=True)
                ask = np.unique(keys[apart])
                held += [(teach, counts), (ask, np.zeros(len(ask), dtype=np.int64))]
                size += len(keys)
                m = len(part)
                sent = _shipped([batch.column(c).slice(first, m) for c in range(4)])
                columns = [pa.array([number]), pa.array([-1], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([sent])]
                yield pa.RecordBatch.from_arrays(columns, names=ASKED)
                if size >= group:
                    yield asked()
                    number, held, size = number + 1, [], 0
        if held:
            yield asked()

    return run


def _lgamma(x: np.ndarray) -> np.ndarray:
    shift = np.ones_like(x)
    for j in range(8):
        shift = shift * (x + j)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def _log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1) - np.log(np.pi)


class Tree:
    """The trained weighting: node 0 is the empty context; ``child[node * 256 + byte]`` extends a context into the past."""

    def __init__(self, depth: int, child: np.ndarray, log_p: np.ndarray):
        self.depth, self.child, self.log_p = depth, child, log_p

    def score(self, texts: pa.Array) -> np.ndarray:
        """log10 probability of each text."""
        out, at, bounds = padded(texts, self.depth)
        if len(bounds) == 1:
            return np.zeros(0)
        node = np.zeros(len(at), dtype=np.int64)
        alive = np.ones(len(at), dtype=bool)
        for j in range(1, self.depth + 1):
            step = self.child[node * 256 + out[at - j]]
            alive &= step >= 0
            node = np.where(alive, step, node)
        return np.add.reduceat(self.log_p[node * 256 + out[at]].astype(np.float64), bounds[:-1])


def build_tree(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> Tree:
    """``levels[d]`` holds (context, byte, count) of the kept contexts of d bytes; the contexts are closed under shortening."""
    names, counts = [], []
    for d in range(depth + 1):
        ctx, byte, c = levels[d]
        name = np.unique(ctx) if d else np.zeros(1, dtype=U)
        table = np.zeros((len(name), 256))
        np.add.at(table, (np.searchsorted(name, ctx), byte), c)
        names.append(name)
        counts.append(table)
    parents = [np.zeros(0, dtype=np.int64)] + [np.searchsorted(names[d - 1], names[d] & U((1 << (8 * (d - 1))) - 1)) if d > 1 else np.zeros(len(names[d]), dtype=np.int64) for d in range(1, depth + 1)]
    others = []
    for d in range(depth + 1):
        rest = counts[d].copy()
        if d < depth:
            np.subtract.at(rest, parents[d + 1], counts[d + 1])
        others.append(rest)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in names])])
    log_p = np.zeros((starts[-1], 256))
    for bit in range(8):
        two = [x.reshape(len(x), 1 << bit, 2, 128 >> bit).sum(axis=3) for x in counts]
        two_other = [x.reshape(len(x), 1 << bit, 2, 128 >> bit).sum(axis=3) for x in others]
        own = [_log_kt(x[:, :, 0], x[:, :, 1]) for x in two]
        weighted = [None] * (depth + 1)
        weighted[depth] = own[depth]
        stay = [None] * depth
        for d in range(depth - 1, -1, -1):
            below = _log_kt(two_other[d][:, :, 0], two_other[d][:, :, 1])
            np.add.at(below, parents[d + 1], weighted[d + 1])
            weighted[d] = np.logaddexp(own[d], below) - np.log(2)
            stay[d] = np.exp(np.minimum(0.0, own[d] - np.log(2) - weighted[d]))
        gone = rest = None
        for d in range(depth + 1):
            kt = (two[d] + 0.5) / (two[d].sum(axis=2, keepdims=True) + 1)
            up_gone = gone[parents[d]] if d else np.zeros_like(kt)
            up_rest = rest[parents[d]] if d else np.ones(kt.shape[:2])
            if d < depth:
                gone = up_gone + (up_rest * stay[d])[:, :, None] * kt
                rest = up_rest * (1 - stay[d])
                kt_other = (two_other[d] + 0.5) / (two_other[d].sum(axis=2, keepdims=True) + 1)
                p = gone + rest[:, :, None] * kt_other
            else:
                p = up_gone + up_rest[:, :, None] * kt
            part = np.log10(p).reshape(len(p), 2 << bit)
            log_p[starts[d] : starts[d + 1]] += np.repeat(part, 256 >> (bit + 1), axis=1)
    child = np.full(starts[-1] * 256, -1, dtype=np.int32)
    for d in range(1, depth + 1):
        oldest = (names[d] >> U(8 * (d - 1))).astype(np.int64)
        child[(starts[d - 1] + parents[d]) * 256 + oldest] = starts[d] + np.arange(len(names[d]))
    return Tree(depth, child, log_p.astype(np.float32).ravel())


_SMALL = 1 << 16
_tables: list[np.ndarray] = []


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_log_kt of whole numbers, by tables where they are small."""
    if not _tables:
        _tables.extend([_lgamma(np.arange(_SMALL) + 0.5), _lgamma(np.arange(_SMALL) + 1.0)])
    half, whole = _tables
    out = np.empty(len(a))
    few = a + b < _SMALL
    x, y = a[few], b[few]
    out[few] = half[x] + half[y] - whole[x + y] - np.log(np.pi)
    out[~few] = _log_kt(a[~few].astype(np.float64), b[~few].astype(np.float64))
    return out


def _climb(name: np.ndarray, two: np.ndarray, bit: int, levels: int, below: np.ndarray | None = None) -> list[tuple]:
    """Weighs the nodes of one bit, deepest level first: (names, counts of 0 and 1, share that stays, places of parents).

    A name is the context followed by ``bit`` bits of the byte. The last level's fourth entry is its weighted log probability.
    """
    out = []
    own = _kt(two[0], two[1])
    weighted = own if below is None else np.logaddexp(own, below) - np.log(2)
    stay = np.ones(len(name)) if below is None else np.exp(np.minimum(0.0, own - np.log(2) - weighted))
    for _ in range(levels):
        up_name, up = np.unique((name >> U(8 + bit)) << U(bit) | (name & U((1 << bit) - 1)), return_inverse=True)
        out.append((name, two, stay, up))
        name, n = up_name, len(up_name)
        two = np.stack([np.bincount(up, weights=x, minlength=n).astype(np.int64) for x in two])
        below = np.bincount(up, weights=weighted, minlength=n)
        own = _kt(two[0], two[1])
        weighted = np.logaddexp(own, below) - np.log(2)
        stay = np.exp(np.minimum(0.0, own - np.log(2) - weighted))
    out.append((name, two, stay, weighted))
    return out


def _descend(levels: list[tuple], gone: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(settled probability of 0 and 1, weight that is left) at the deepest nodes, from those above the shallowest."""
    for i in range(len(levels) - 1, -1, -1):
        _, two, stay, _ = levels[i]
        gone = gone + rest * stay * ((two + 0.5) / (two.sum(axis=0) + 1))
        rest = rest * (1 - stay)
        if i:
            up = levels[i - 1][3]
            gone, rest = gone[:, up], rest[up]
    return gone, rest


def _bottom(keys: np.ndarray, counts: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, counts, node of each key) of one bit's deepest nodes."""
    name, node = np.unique(keys >> U(8 - bit), return_inverse=True)
    one = ((keys >> U(7 - bit)) & U(1)).astype(bool)
    return name, np.stack([np.bincount(node, weights=np.where(one == v, counts, 0), minlength=len(name)).astype(np.int64) for v in (False, True)]), node


def _joint(name: np.ndarray, bit: int) -> np.ndarray:
    """Names of nodes of one bit, made different from those of other bits."""
    return (name >> U(bit)) << U(8) | U(1 << bit) | (name & U((1 << bit) - 1))


def subtree_roots(keys: np.ndarray, counts: np.ndarray, depth: int) -> pa.Table:
    """(node, n0, n1, w): parents of the shard's roots, each with its share of their counts and weighted log probability."""
    root = min(ROOT, depth)
    parts = []
    for bit in range(8):
        name, two, _ = _bottom(keys, counts, bit)
        name, two, _, w = _climb(name, two, bit, depth - root)[-1]
        up_name, up = np.unique((name >> U(8 + bit)) << U(bit) | (name & U((1 << bit) - 1)), return_inverse=True)
        parts.append((_joint(up_name, bit), *(np.bincount(up, weights=x, minlength=len(up_name)) for x in (*two, w))))
    node, n0, n1, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.table({"node": pa.array(node.view(np.int64)), "n0": pa.array(n0.astype(np.int64)), "n1": pa.array(n1.astype(np.int64)), "w": pa.array(w)})


def weigh_top(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, w: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, settled probabilities, weights left) above the shards' roots."""
    root = min(ROOT, depth)
    parts = [(np.zeros(0, dtype=U), np.zeros((2, 0)), np.zeros(0))]
    for bit in range(8):
        here = ((node & U(255)) >> U(bit)) == U(1)
        name = (node[here] >> U(8)) << U(bit) | (node[here] & U((1 << bit) - 1))
        order = np.argsort(name)
        levels = _climb(name[order], np.stack([n0[here][order], n1[here][order]]), bit, root - 1, w[here][order])
        m = len(levels[-1][0])
        gone, rest = _descend(levels, np.zeros((2, m)), np.ones(m))
        parts.append((_joint(levels[0][0], bit), gone, rest))
    nodes, gone, rest = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1), np.concatenate([p[2] for p in parts])
    order = np.argsort(nodes)
    return nodes[order], gone[:, order], rest[order]


def place_logs(keys: np.ndarray, counts: np.ndarray, depth: int, top: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of each place of a shard."""
    root = min(ROOT, depth)
    nodes, above, left = top
    total = np.zeros(len(keys))
    for bit in range(8):
        name, two, node = _bottom(keys, counts, bit)
        levels = _climb(name, two, bit, depth - root)
        first = levels[-1][0]
        at = np.searchsorted(nodes, _joint((first >> U(8 + bit)) << U(bit) | (first & U((1 << bit) - 1)), bit))
        gone, _ = _descend(levels, above[:, at], left[at])
        total += np.log10(gone[((keys >> U(7 - bit)) & U(1)).astype(np.int64), node])
    return total.astype(np.float32)


def _gathered(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """A shard's places by group, and all its places with their counts."""
    sizes = table.column("n").to_pylist()
    keys = [_unpacked(b, n) for b, n in zip(table.column("places").to_pylist(), sizes, strict=True)]
    counts = [np.frombuffer(pa.decompress(b, decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.int64) for b, n in zip(table.column("counts").to_pylist(), sizes, strict=True)]
    return keys, *_folded(keys, counts)


def _roots(depth: int):
    def run(table: pa.Table) -> pa.Table:
        _, keys, counts = _gathered(table)
        return subtree_roots(keys, counts, depth)

    return run


def _packed_logs(logs: np.ndarray) -> bytes:
    """log10 probabilities in steps of 2 ** -19 (an error of at most one millionth), three byte planes."""
    steps = np.clip(np.rint(logs * -(1 << 19)), 0, (1 << 24) - 1).astype(np.uint32)
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes(), codec="zstd", asbytes=True)


def _unpacked_logs(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=3 * n, codec="zstd", asbytes=True), dtype=np.uint8).reshape(3, n)
    steps = planes[0].astype(np.int32) | planes[1].astype(np.int32) << 8 | planes[2].astype(np.int32) << 16
    return steps * -(2.0**-19)


def _answer(depth: int, top):
    def run(table: pa.Table) -> pa.Table:
        asked, keys, counts = _gathered(table)
        logs = place_logs(keys, counts, depth, top.value)
        blobs = [_packed_logs(logs[np.searchsorted(keys, k)]) for k in asked]
        return pa.table({"grp": table.column("grp"), "shard": table.column("shard"), "n": table.column("n"), "logs": pa.array(blobs, pa.binary())})

    return run


def _score(depth: int, shards: int, hot):
    """Scores of a group's texts, from the answers to its places."""

    def run(table: pa.Table) -> pa.Table:
        values, logs = hot.value
        answers = table.filter(pa.compute.greater_equal(table.column("shard"), 0)).sort_by("shard")
        sent = table.filter(pa.compute.less(table.column("shard"), 0)).column("rows").to_pylist()
        batches = [b for blob in sent for b in pa.ipc.open_stream(blob)]
        # a chunk's places are sorted once; which of them each byte has is kept in 32 bits
        found = []
        for texts in batches:
            out, at, bounds = padded(texts.column("t"), depth)
            places, which = np.unique(_keys(out, at, depth), return_inverse=True)
            found.append((places, which.astype(np.int32), bounds))
        keys, _ = _folded([f[0] for f in found], [np.zeros(len(f[0]), dtype=np.int64) for f in found])
        order, _ = _dealt(keys, depth, shards)
        told = np.empty(len(keys))
        told[order] = np.concatenate([_unpacked_logs(b, n) for b, n in zip(answers.column("logs").to_pylist(), answers.column("n").to_pylist(), strict=True)])
        parts = []
        for texts, (places, which, bounds) in zip(batches, found, strict=True):
            part = texts.column("t")
            score = np.add.reduceat(told[np.searchsorted(keys, places)][which], bounds[:-1])
            w = words_of(part)
            n = len(part)
            h = np.concatenate([w.h, np.full(n, END_WORD, dtype=U)])
            owner = np.concatenate([w.owner(), np.arange(n)])
            kinds, which = np.unique(h, return_inverse=True)
            at = np.minimum(np.searchsorted(values, kinds), max(len(values) - 1, 0))
            known = values[at] == kinds if len(values) else np.zeros(len(kinds), dtype=bool)
            value = np.where(known, logs[at] if len(values) else 0.0, 0.0)
            base = np.bincount(owner, weights=value[which], minlength=n)
            seen = np.bincount(owner, weights=known[which], minlength=n).astype(np.int64)
            ids = [texts.column(c) for c in range(3)]
            parts.append(pa.table([*ids, pa.array(w.counts() + 1), pa.array(seen), pa.array(base), pa.array(score), pa.array(np.diff(bounds)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names=NAMES))
            rare = np.flatnonzero(~known[which])
            if len(rare):
                order = rare[np.lexsort((which[rare], owner[rare]))]
                new = np.flatnonzero(np.concatenate([[True], (which[order][1:] != which[order][:-1]) | (owner[order][1:] != owner[order][:-1])]))
                times = np.diff(np.concatenate([new, [len(order)]])).astype(np.int32)
                m = len(new)
                parts.append(pa.table([ids[0].take(pa.array(owner[order[new]])), pa.nulls(m, ids[1].type), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.int64()), pa.array(h[order[new]].view(np.int64)), pa.array(times)], names=NAMES))
        return pa.concat_tables(parts)

    return run


NAMES = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "h", "times"]


def score_texts(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, hot_words: int = HOT_WORDS,
    group: int = GROUP, shard: int = SHARD,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every row; rows where
    ``held_out`` is false teach. ``n_bytes`` counts the end mark; ``bits_per_byte`` is the code length that the score means."""
    text_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    held = F.coalesce(held_out, F.lit(False))
    teaching = docs.where(~held).select(F.col(text_col).alias("t"))
    words = cut(teaching.mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("c").alias("v")).first()
    unit = total.n + total.v + 1
    top = words.orderBy(F.desc("c"), "h").limit(hot_words).toArrow()
    h, c = np.asarray(top.column("h")).view(U), np.asarray(top.column("c"), dtype=np.float64)
    order = np.argsort(h)
    hot = sc.broadcast((h[order], np.log10((c[order] + 1) / unit)))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("t"))
    shards = max(8, -(-(docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0) // shard))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    asked = cut(rows.mapInArrow(_ask(depth, shards, group), "grp long, shard int, n int, places binary, counts binary, rows binary"), "asked")
    places = asked.where("shard >= 0").select("grp", "shard", "n", "places", "counts")
    roots = places.groupBy("shard").applyInArrow(_roots(depth), "node long, n0 long, n1 long, w double")
    roots = roots.groupBy("node").agg(*(F.sum(x).alias(x) for x in ("n0", "n1", "w"))).toArrow()
    counted = (np.asarray(roots.column(x)) for x in ("n0", "n1", "w"))
    above = sc.broadcast(weigh_top(np.asarray(roots.column("node")).view(U), *counted, depth))
    answers = places.groupBy("shard").applyInArrow(_answer(depth, above), "grp long, shard int, n int, logs binary")
    texts = asked.where("shard < 0").select("grp", "shard", "n", F.lit(None).cast("binary").alias("logs"), "rows")
    met = texts.unionByName(answers, allowMissingColumns=True)
    schema = f"rid long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, h long, times int"
    scored = cut(met.groupBy("grp").applyInArrow(_score(depth, shards, hot), schema), "scored")
    for sent in (hot, above):
        sent.destroy()
    drop(asked)
    rare = scored.where("h IS NOT NULL").select("rid", "h", "times").join(words, "h", "left")
    more = F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(unit))))
    rare = rare.groupBy("rid").agg(more.alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("also"))
    whole = scored.where("h IS NULL").join(rare, "rid", "left")
    return whole.select(
        F.col("doc_id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(int(total.n)).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score", "n_bytes", (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
