import numpy as np
from pyspark.sql import functions as F

from quire.llm.neighbours import SHARD_ROWS, _wide, beam_search, build_graph, nearest, reached, search_beam


def brute(vectors, queries, k):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], dtype=np.float32).astype(np.float64)
    out = {}
    for q in queries:
        s = x @ np.array(vectors[q], dtype=np.float32).astype(np.float64)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def recall(got, want):
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / max(1, len(want[q])) for q in want])


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_on_graphs(spark):
    rng = np.random.RandomState(2)
    centres = rng.randn(10, 24)
    vectors = {i: (centres[i % 10] + rng.randn(24) * (1 + i % 3)).tolist() for i in range(3000)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    got = collect(nearest(df, F.col("vec_id") % 20 == 0, shards=2))
    want = brute(vectors, [i for i in vectors if i % 20 == 0], 20)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    for q in got:
        for v, s in got[q]:
            assert abs(s - np.dot(np.float32(vectors[v]).astype(float), np.float32(vectors[q]).astype(float))) < 1e-9
    again = collect(nearest(df, F.col("vec_id") % 20 == 0, shards=2, query_rows=4))
    assert recall(again, want) >= 0.9


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    got = collect(nearest(df, F.col("vec_id") % 20 == 0))
    assert recall(got, brute(vectors, [i for i in vectors if i % 20 == 0], 20)) >= 0.9


def test_ties_and_unsound_rows(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(40)] + [(100, [0.0, 0.0, 0.0]), (101, None), (102, []), (103, [1.0, None, 2.0]), (104, [float("nan"), 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0]), (106, [1.0, 2.0]), (None, same), (120, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = collect(nearest(df, F.col("vec_id") % 20 == 0))
    assert set(got) == {0, 20, 120}
    assert [v for v, _ in got[0]] == [120, *range(1, 20)] and [v for v, _ in got[120]] == list(range(20))
    assert nearest(df.where("false"), F.lit(True)).count() == 0
    few = collect(nearest(df.where("vec_id < 3"), F.lit(True)))
    assert [v for v, _ in few[1]] == [0, 2]


def test_every_node_can_be_reached():
    rng = np.random.RandomState(3)
    tight = np.repeat(rng.randn(40, 8), 40, axis=0) + 0.01 * rng.randn(1600, 8)
    for x in (rng.randn(1500, 8), tight, tight * np.exp(rng.randn(1600, 1))):
        graph, starts = build_graph(x.astype(np.float32))
        assert reached(graph, starts[:1]).all() and (graph[:, :32] >= 0).sum(axis=1).max() <= 32 and graph.shape[1] == 34


def test_recall_at_the_largest_shard():
    """Spread vectors without any structure, the hardest; queries are no rows of the shard, as for most shards of a table."""
    rng = np.random.RandomState(8)
    x = rng.randn(SHARD_ROWS, 48)
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = rng.randn(200, 48)
    q /= np.linalg.norm(q, axis=1)[:, None]
    wide = _wide(x)
    graph, starts = build_graph(wide)
    assert reached(graph, starts[:1]).all()
    flat = np.concatenate([q, np.zeros((200, 1))], axis=1).astype(np.float32)
    ids, _ = beam_search(wide, graph, starts, flat, search_beam(len(x)))
    want = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) / 20 for a, b in zip(ids.tolist(), want.tolist(), strict=True)]) >= 0.9


def test_recall_where_lengths_differ(spark):
    rng = np.random.RandomState(9)
    n, d = 6000, 32
    kinds = {"spread": rng.randn(n, d), "long tails": rng.randn(n, d) * np.exp(0.6 * rng.randn(n, 1)), "tight": (2 * rng.randn(100, d))[rng.randint(100, size=n)] + 0.3 * rng.randn(n, d)}
    for name, x in kinds.items():
        vectors = {i: v.tolist() for i, v in enumerate(x)}
        got = collect(nearest(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0))
        assert recall(got, brute(vectors, [i for i in vectors if i % 20 == 0], 20)) >= 0.9, name


def test_doubles_and_repeated_rows(spark):
    """Scores are exact in double precision; rows that share an id are one vector and one query."""
    rng = np.random.RandomState(6)
    vectors = {i: rng.randn(16).tolist() for i in range(400)}
    rows = list(vectors.items()) + [(20, vectors[20]), (40, [9.0] + vectors[40][1:]), (7, vectors[7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collect(nearest(df, F.col("vec_id") % 20 == 0, shards=2))
    assert all(len({v for v, _ in found}) == 20 for found in got.values()) and len(got) == 20
    x = {i: np.array(v) for i, v in vectors.items()}
    x[40] = np.array(min(vectors[40], [9.0] + vectors[40][1:]))
    for q, found in got.items():
        for v, s in found:
            assert abs(s - x[v] @ x[q]) < 1e-12
    want = {q: sorted(((v, float(x[v] @ x[q])) for v in x if v != q), key=lambda r: (-r[1], r[0]))[:20] for q in got}
    assert recall(got, want) >= 0.9


def test_lengths_at_the_ends_of_the_range(spark):
    rng = np.random.RandomState(12)
    scale = [1e200, 1e-200, 1.0, 1e-3, 5e-308]
    vectors = {i: (rng.rand(4) * scale[i % 5]).tolist() for i in range(200)}
    got = collect(nearest(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 2))
    for q, found in got.items():
        want = sorted((v for v in vectors if v != q), key=lambda v: (-float(np.dot(vectors[v], vectors[q])), v))[:20]
        assert len(set(want) & {v for v, _ in found}) >= 18


def test_graphs_are_built_for_small_shards():
    """No size below which the graph is left out."""
    x = np.random.RandomState(4).randn(30, 4).astype(np.float32)
    graph, starts = build_graph(x)
    assert graph.shape[0] == 30 and (graph[starts[0]] >= 0).any()
