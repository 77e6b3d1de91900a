"""Approximate nearest neighbours by robust-pruned directed graphs.

Rows are dealt by length into bands of nearly equal lengths, and by hash into shards of at most ``shard_rows`` of a band. In each
shard equal vectors are one node; nodes are inserted in random order in growing batches, and once more when all are in: a greedy
beam search over the graph so far proposes neighbours, relaxed distance pruning (``alpha``) keeps diverse edges up to ``degree``, and
edges are added back and pruned again. A node that no walk would meet then gets an edge from a near one that is met, so every
row can be found. Each query is answered by a beam search in every shard, from the nearest of some sampled nodes, with a beam that
grows with the root of the shard; the beams' vectors are scored exactly and the shards' best are merged.

Largest inner product becomes smallest distance by one added coordinate, sqrt(M - |x|^2), with M the largest squared length of the
shard. Where lengths differ much, that coordinate outweighs all others and graphs on it cannot be walked; within a band it is
small, and distances order rows as their angles do.

The index is a table (one row a shard, written to the shared folder), so searches in blocks of ``query_rows`` queries read it
without building it again. Every valid row is indexed.

Graphs are walked in single precision; results are scored on the original components in double precision.

Cases: rows with a null id or a vector that is null, empty, zero, of another length than most, or with null or non-finite parts
take no part; rows that share an id are one vector, the smallest of theirs in order of components; equal vectors tie by smaller
id, and a node keeps its k + 1 smallest ids, as no query can return more of them; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import cut

SHARDS, SHARD_ROWS, QUERY_ROWS = 12, 20_000, 20_000
DEGREE, BEAM, SEARCH_BEAM, ALPHA = 32, 64, 80, 1.2
#: Columns for edges to nodes that no other edge leads to.
SPARE = 2
#: Nodes from which a walk starts.
STARTS = 8
#: Lengths of a band differ by this factor at most, but for the last band, of rows shorter by a thousand and more.
RATIO, BANDS = 1.03, 234


def _dist(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of x[ids[i, j]] to q[i]; +inf where the id is negative."""
    v = x[np.maximum(ids, 0)] - q[:, None, :]
    d = np.einsum("ijk,ijk->ij", v, v)
    d[ids < 0] = np.inf
    return d


def nearest_starts(x: np.ndarray, starts: np.ndarray, q: np.ndarray, many: int) -> np.ndarray:
    """For each query the ``many`` nearest of the nodes ``starts``."""
    if len(starts) <= many:
        return np.tile(starts, (len(q), 1))
    v = x[starts]
    d = np.einsum("ij,ij->i", v, v)[None, :] - 2 * (q @ v.T)
    return starts[np.argpartition(d, many - 1, axis=1)[:, :many]]


def beam_search(
    x: np.ndarray, graph: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int, width: int = 4, met: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the ``beam`` nearest nodes met from those of ``starts`` that are nearest to each query; -1 where fewer
    were met. ``met`` is scratch space of at least len(q) x len(x) False values, which is left as it was found."""
    b, n = len(q), len(x)
    first = nearest_starts(x, starts, q, min(STARTS, beam))
    ids = np.full((b, beam), -1, dtype=np.int64)
    ids[:, : first.shape[1]] = first
    d = _dist(x, ids, q).astype(np.float32)
    open_ = ids >= 0
    met = np.zeros((b, n), dtype=bool) if met is None else met
    marked = [(np.repeat(np.arange(b), first.shape[1]), first.ravel())]
    met[marked[0]] = True
    live = np.arange(b)
    while len(live):
        order = np.where(open_[live], d[live], np.inf)
        pick = np.argpartition(order, min(width, beam - 1), axis=1)[:, :width]
        chosen = np.where(np.isfinite(np.take_along_axis(order, pick, axis=1)), np.take_along_axis(ids[live], pick, axis=1), -1)
        open_[live[:, None], pick] = False
        near = graph[np.maximum(chosen, 0)]
        near[chosen < 0] = -1
        near = near.reshape(len(live), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[(near >= 0) & met[live[:, None], np.maximum(near, 0)]] = -1
        rows, cols = np.nonzero(near >= 0)
        marked.append((live[rows], near[rows, cols]))
        met[marked[-1]] = True
        all_d = np.concatenate([d[live], _dist(x, near, q[live])], axis=1)
        all_ids = np.concatenate([ids[live], near], axis=1)
        all_open = np.concatenate([open_[live], near >= 0], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        d[live], ids[live], open_[live] = (np.take_along_axis(a, best, axis=1) for a in (all_d, all_ids, all_open))
        ids[~np.isfinite(d)] = -1
        open_ &= ids >= 0
        live = live[open_[live].any(axis=1)]
    for places in marked:
        met[places] = False
    return ids, d


def robust_prune(x: np.ndarray, own: np.ndarray, ids: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node own[i], up to ``degree`` of the candidates ids[i]: the nearest, then those not better reached through one kept."""
    ids = np.where(ids == own[:, None], -1, ids)
    d = _dist(x, ids, x[own])
    order = np.argsort(d, axis=1)
    ids, d = np.take_along_axis(ids, order, axis=1), np.take_along_axis(d, order, axis=1)
    v = x[np.maximum(ids, 0)]
    square = np.einsum("ijk,ijk->ij", v, v)
    between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    covered = alpha * alpha * between <= d[:, None, :]
    alive = np.isfinite(d)
    out = np.full((len(own), degree), -1, dtype=np.int64)
    rows = np.arange(len(own))
    for j in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        out[some, j] = ids[rows, first][some]
        alive &= ~covered[rows, first]
        alive[rows, first] = False
    return out


def _back_edges(x: np.ndarray, graph: np.ndarray, new: np.ndarray, degree: int, alpha: float) -> None:
    """Adds the reverse of the new nodes' edges; a node that has too many then is pruned."""
    src, dst = np.repeat(new, degree), graph[new, :degree].ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    by = np.argsort(dst, kind="stable")
    src, dst = src[by], dst[by]
    touched, first, many = np.unique(dst, return_index=True, return_counts=True)
    n = len(x)
    for width in (w for w in (degree, 4 * degree, 16 * degree, n + degree) if len(touched)):
        now = many <= width
        if now.any():
            t, f, m = touched[now], first[now], np.minimum(many[now], width)
            add = np.full((len(t), int(m.max())), -1, dtype=np.int64)
            cols = np.arange(add.shape[1])
            fill = cols < m[:, None]
            add[fill] = src[(f[:, None] + cols)[fill]]
            both = np.sort(np.concatenate([graph[t, :degree], add], axis=1), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            free = (both >= 0).sum(axis=1) <= degree
            if free.any():
                packed = np.sort(np.where(both[free] < 0, n, both[free]), axis=1)[:, :degree]
                packed = np.concatenate([packed, np.full((len(packed), max(0, degree - packed.shape[1])), n, dtype=np.int64)], axis=1)
                graph[t[free], :degree] = np.where(packed == n, -1, packed)
            for a in range(0, int((~free).sum()), 512):
                full = np.flatnonzero(~free)[a : a + 512]
                graph[t[full], :degree] = robust_prune(x, t[full], both[full], degree, alpha)
        touched, first, many = touched[~now], first[~now], many[~now]


def reached(graph: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Which nodes a walk along the edges from the nodes ``new`` can meet."""
    seen = np.zeros(len(graph), dtype=bool)
    while len(new):
        seen[new] = True
        near = np.unique(graph[new])
        new = near[(near >= 0) & ~seen[np.maximum(near, 0)]]
    return seen


def _attach(x: np.ndarray, graph: np.ndarray, starts: np.ndarray, degree: int, beam: int) -> None:
    """Gives every node that cannot be reached an edge, in a spare column, from a near one that can be and has a spare left."""
    spare = (graph[:, degree:] < 0).sum(axis=1)
    seen = reached(graph, starts[:1])
    last = int(starts[0])
    while not seen.all():
        lost = np.flatnonzero(~seen)
        ids, d = beam_search(x, graph, starts[:1], x[lost[:256]], beam)
        ids = np.take_along_axis(ids, np.argsort(d, axis=1), axis=1)
        for node, near in zip(lost[:256].tolist(), ids, strict=True):
            if seen[node]:
                continue
            host = next((v for v in (*near.tolist(), last) if v >= 0 and spare[v] > 0), None)
            if host is None:
                host = int(np.flatnonzero(seen & (spare > 0))[0])
            graph[host, graph.shape[1] - spare[host]] = node
            spare[host] -= 1
            seen |= reached(graph, np.array([node]))
            last = node


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 5, passes: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Out-edges (padded with -1) and the nodes where walks start; from the first of them every node can be reached. The last ``SPARE``
    columns hold only edges to nodes that could not be reached otherwise."""
    n = len(x)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, degree + SPARE), -1, dtype=np.int64)
    order = np.random.RandomState(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    starts = order[: min(n, int(4 * np.sqrt(n)) + 1)]
    met = np.zeros((256, n), dtype=bool)
    for turn in range(passes):
        relaxed = alpha if turn == passes - 1 else 1.0
        done = 0 if turn else 1
        while done < n:
            size = min(256 if turn else max(1, done // 2), 256, n - done)
            new = order[done : done + size]
            ids, _ = beam_search(x, graph, starts if turn else starts[:done], x[new], beam, met=met)
            if turn:
                ids = np.sort(np.concatenate([ids, graph[new, :degree]], axis=1), axis=1)
                ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            graph[new, :degree] = robust_prune(x, new, ids, degree, relaxed)
            done += size
            _back_edges(x, graph, new, degree, relaxed)
    _attach(x, graph, starts, degree, beam)
    return graph, starts


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _wide(x: np.ndarray) -> np.ndarray:
    """Single-precision vectors with the coordinate that turns inner products into distances, all scaled alike to lengths of one."""
    x = x.astype(np.float64) / np.abs(x).max()
    square = (x**2).sum(axis=1)
    top = square.max()
    return (np.concatenate([x, np.sqrt(np.maximum(0, top - square))[:, None]], axis=1) / np.sqrt(top)).astype(np.float32)


def search_beam(n: int, least: int = SEARCH_BEAM) -> int:
    """The beam for a shard of n nodes."""
    return max(least, int(1.6 * np.sqrt(n)))


def _index(keep: int):
    def run(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("vec_id"))
        raw = _matrix(table.column("embedding"))
        order = np.argsort(ids, kind="stable")
        ids, raw = ids[order], np.ascontiguousarray(raw[order])
        bounds = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]]))
        own = [a if b - a == 1 else a + min(range(b - a), key=lambda i, a=a: raw[a + i].tolist()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        ids, raw = ids[own], raw[own]
        _, first, node = np.unique(raw.view(np.dtype((np.void, raw.shape[1] * raw.itemsize))).ravel(), return_index=True, return_inverse=True)
        x = raw[first]
        by = np.argsort(node, kind="stable")
        rank = np.arange(len(by)) - np.searchsorted(node[by], node[by])
        held = rank < keep
        graph, starts = build_graph(_wide(x))
        row = {"shard": [table.column("shard")[0].as_py()], "dim": [x.shape[1]], "starts": [starts.astype(np.int32).tobytes()], "vectors": [x.tobytes()], "edges": [graph.astype(np.int32).tobytes()], "node": [node[by][held].astype(np.int32).tobytes()], "ids": [ids[by][held].astype(np.int64).tobytes()]}
        return pa.table(row, schema=pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("starts", pa.binary()), ("vectors", pa.binary()), ("edges", pa.binary()), ("node", pa.binary()), ("ids", pa.binary())]))

    return run


def _search(k: int, beam: int, kind: str):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(key, index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return schema.empty_table()
        row = {c: index.column(c)[0].as_py() for c in index.column_names}
        x = np.frombuffer(row["vectors"], dtype=kind).reshape(-1, row["dim"])
        node, ids = np.frombuffer(row["node"], dtype=np.int32), np.frombuffer(row["ids"], dtype=np.int64)
        first = np.searchsorted(node, np.arange(len(x) + 1))
        q, qid = _matrix(queries.column("embedding")), np.asarray(queries.column("query_id"))
        graph, wide = np.frombuffer(row["edges"], dtype=np.int32).reshape(len(x), -1).astype(np.int64), _wide(x)
        starts, most = np.frombuffer(row["starts"], dtype=np.int32).astype(np.int64), search_beam(len(x), max(beam, k + 1))
        out = [[], [], []]
        step = max(1, min(1024, 16_000_000 // len(x)))
        met = np.zeros((step, len(x)), dtype=bool)
        for a in range(0, len(q), step):
            part = q[a : a + step]
            flat = np.concatenate([part, np.zeros((len(part), 1))], axis=1).astype(np.float64)
            flat /= np.abs(flat).max(axis=1)[:, None]
            flat = (flat / np.sqrt((flat**2).sum(axis=1))[:, None]).astype(np.float32)  # a query's length orders nothing
            near, _ = beam_search(wide, graph, starts, flat, most, met=met)
            score = np.einsum("ijk,ik->ij", x[np.maximum(near, 0)].astype(np.float64), part.astype(np.float64))
            score[near < 0] = -np.inf
            for i in range(len(part)):
                best = np.lexsort((ids[first[np.maximum(near[i], 0)]], -score[i]))[: k + 1]
                best = best[np.isfinite(score[i][best])]
                nodes = near[i][best]
                many = first[nodes + 1] - first[nodes]
                got = np.concatenate([ids[first[v] : first[v + 1]] for v in nodes]) if len(nodes) else np.zeros(0, dtype=np.int64)
                s = np.repeat(score[i][best], many)
                keep = got != qid[a + i]
                got, s = got[keep], s[keep]
                top_k = np.lexsort((got, -s))[:k]
                out[0].append(np.full(len(top_k), qid[a + i]))
                out[1].append(got[top_k])
                out[2].append(s[top_k])
        return pa.table([np.concatenate(c) for c in out], schema=schema)

    return run


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shards: int = SHARDS,
    shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, beam: int = SEARCH_BEAM,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows by inner product of each row that ``is_query`` names."""
    v = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    single = vectors.schema[vector_col].dataType.elementType == T.FloatType()
    v = v if single else v.cast("array<double>")
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    common = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("embedding") == common.dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.bool_or("asks").alias("asks"))
    most = F.array_max(F.transform("embedding", lambda e: F.abs(e.cast("double"))))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, e: s + (e.cast("double") / F.col("_most")) * (e.cast("double") / F.col("_most")))
    rows = rows.withColumn("_most", most).withColumn("_log", F.log("_most") + F.log(square) / 2).drop("_most")  # of any length, without overflow
    rows = cut(rows, "vectors")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max("_log").alias("top")).first()
    band = F.least(F.lit(BANDS).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.lit(stats.top) - F.col("_log")) / float(np.log(RATIO)))))
    banded = rows.withColumn("band", band.cast("int"))
    at_most = min(shard_rows, -(-stats.n // shards))
    s, dealing = 0, []
    for r in banded.groupBy("band").count().orderBy("band").collect():  # one row a band
        many = -(-r["count"] // at_most)
        dealing += [F.lit(r.band), F.struct(F.lit(s).alias("first"), F.lit(many).alias("many"))]
        s += many
    place = F.try_element_at(F.create_map(*dealing), F.col("band"))
    shard = (place["first"] + F.pmod(F.xxhash64("vec_id"), place["many"])).cast("int")
    dealt = banded.select(shard.alias("shard"), "vec_id", "embedding")
    index = cut(dealt.groupBy("shard").applyInArrow(_index(k + 1), "shard int, dim int, starts binary, vectors binary, edges binary, node binary, ids binary"), "index")
    blocks = max(1, -(-stats.n // (20 * query_rows)))
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    asked = rows.where("asks").select(F.explode(F.sequence(F.lit(0), F.lit(s - 1))).alias("shard"), block.alias("block"), F.col("vec_id").alias("query_id"), "embedding")
    ready = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = ready.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_search(k, beam, "float32" if single else "float64"), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
