"""Merkle manifest of a dataset: a digest tree a source, a tree over the sources, and a proof for every row.

Row digests are Spark's own ``sha2`` over length-prefixed values; texts are read once and only digests travel. A row's position in
its source comes from one range sort: places within a range, plus the rows of the source in the ranges before it. Positions cut a
source into aligned blocks of ``fanout ** levels`` leaves. In a block the digests are one contiguous matrix of 64-byte hex rows,
which is reshaped by the fan-out and hashed row by row, level by level; the siblings of any node are a slice of that matrix, found
by index arithmetic. Block digests are the leaves of the next round, so a source of any size takes log(rows) / log(4096) rounds, and
no task, group or driver ever holds a source. On the way down each block gets the path from its digest to the root (some levels
of at most fan-out - 1 siblings), and its rows are proved and folded again.

Rules: while a level has several nodes, every ``fanout`` consecutive ones, and the rest, even one, become the digest of their
texts joined; a lone leaf is the root of its source itself.

Cases: null values count as ``-`` (so differ from empty ones); sources ascend by their UTF-8 bytes, null first, and rows in a source
by id, null first, then by digest, so repeated ids have a defined place and repeated rows are leaves of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sessions import CRC_SQL, crc_sql
from .store import cut

FANOUT = 16
#: Levels of a block; a block has FANOUT ** LEVELS leaves.
LEVELS = 3
HEX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<l: binary, r: binary>>"


def row_digest(values: list[Column]) -> Column:
    """sha256 of values joined, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself; 32 bytes."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, a row's place (from 0) within its ``k`` by ``order``, and ``n``, the rows of its ``k``."""
    ties = F.rand(12)  # deals rows that are alike to several ranges; which of them comes first shows nowhere
    by = [F.col("k"), *(F.col(c).asc_nulls_first() for c in order), F.col("_tie")]
    dealt = rows.withColumn("_tie", ties).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    dealt = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_at", 33))
    held = dealt.groupBy("k", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    parts = Window.partitionBy("k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("k", "_part", "_first", F.coalesce(F.sum("_c").over(parts), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy("k")).alias("n"))
    return dealt.join(held, ["k", "_part"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def digest_matrix(column: pa.ChunkedArray, order: np.ndarray) -> np.ndarray:
    """32-byte digests as a contiguous matrix of their 64 hex characters, in the given order."""
    raw = b"".join(column.to_pylist())
    hexed = np.frombuffer(raw.hex().encode(), dtype=np.uint8).reshape(len(order), HEX)
    return np.ascontiguousarray(hexed[order])


def level_up(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The digests of every ``fanout`` rows joined; the last run may be shorter."""
    full = len(nodes) // fanout
    runs = [*nodes[: full * fanout].reshape(full, fanout * HEX), *([nodes[full * fanout :].reshape(-1)] if len(nodes) % fanout else [])]
    return np.frombuffer("".join(hashlib.sha256(run).hexdigest() for run in runs).encode(), dtype=np.uint8).reshape(len(runs), HEX)


def block_levels(leaves: np.ndarray, n: int, fanout: int, levels: int) -> list[np.ndarray]:
    """All levels of a block, leaves first, up to the single node that stands for it; ``n`` is the size of its whole source."""
    found = [leaves]
    for _ in range(levels):
        if n == 1:
            break
        found.append(level_up(found[-1], fanout))
        n = -(-n // fanout)
    return found


def siblings(levels: list[np.ndarray], i: int, fanout: int) -> list[tuple[bytes, bytes]]:
    """What stands left and right of leaf ``i``'s node in its run, on each level below the last."""
    out = []
    for nodes in levels[:-1]:
        first = i // fanout * fanout
        out.append((nodes[first:i].tobytes(), nodes[i + 1 : first + fanout].tobytes()))
        i //= fanout
    return out


def _sorted(table: pa.Table) -> tuple[np.ndarray, int]:
    return np.argsort(table.column("pos").to_numpy(), kind="stable"), int(table.column("n")[0].as_py())


def _folded(fanout: int, levels: int):
    size = fanout**levels

    def run(table: pa.Table) -> pa.Table:
        order, n = _sorted(table)
        top = block_levels(digest_matrix(table.column("d"), order), n, fanout, levels)[-1]
        block = int(table.column("pos")[0].as_py()) // size
        digest = bytes.fromhex(top.tobytes().decode())
        return pa.table({"k": table.column("k").slice(0, 1), "pos": pa.array([block], pa.int64()), "n": pa.array([-(-n // size)], pa.int64()), "d": pa.array([digest], pa.binary())})

    return run


def _paths(fanout: int, levels: int):
    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        order, n = _sorted(nodes)
        found = block_levels(digest_matrix(nodes.column("d"), order), n, fanout, levels)
        rest = above.column("path")[0].as_py()
        paths = [[{"l": a, "r": b} for a, b in siblings(found, i, fanout)] + rest for i in range(len(order))]
        kind = pa.list_(pa.struct([("l", pa.binary()), ("r", pa.binary())]))
        return pa.table({"k": nodes.column("k"), "pos": pa.array(np.sort(nodes.column("pos").to_numpy())), "path": pa.array(paths, kind)})

    return run


def _proved(fanout: int, levels: int):
    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        order, n = _sorted(nodes)
        found = block_levels(digest_matrix(nodes.column("d"), order), n, fanout, levels)
        rest = [(x["l"], x["r"]) for x in above.column("path")[0].as_py()]
        tail = b"".join(a + b for a, b in rest)
        others = nodes.column("other").to_pylist()
        proofs, folds = [], []
        for i, row in enumerate(order):
            own = siblings(found, i, fanout)
            proofs.append(hashlib.sha256(b"".join(a + b for a, b in own) + tail).hexdigest())
            node = found[0][i].tobytes() if others[row] is None else others[row].hex().encode()
            for a, b in (*own, *rest):
                node = hashlib.sha256(a + node + b).hexdigest().encode()
            folds.append(node.decode())
        same = lambda c: pa.array([above.column(c)[0].as_py()] * len(order), pa.string())
        leaves = [row.tobytes().decode() for row in found[0]]
        return pa.table({"id": nodes.column("id").take(pa.array(order)), "leaf": leaves, "subroot": same("subroot"), "root": same("root"), "proof_sha256": proofs, "folded_root": folds})

    return run


def _fold(nodes: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of every round (k, pos, n, d) that has several in a key, and each key's root with the round that gave it."""
    size, rounds, roots = fanout**levels, [], []
    while True:
        rounds.append(nodes)
        blocks = nodes.select("k", "pos", "n", "d").groupBy("k", F.floor(F.col("pos") / size).alias("block"))
        up = cut(blocks.applyInArrow(_folded(fanout, levels), "k string, pos long, n long, d binary"), "round")
        roots.append(up.where("n = 1").select("k", "d", F.lit(len(rounds)).alias("round")))
        nodes = up.where("n > 1")
        if nodes.isEmpty():
            break
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return rounds, found


def _descend(rounds: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(k, block, path) for the blocks of the first round; ``tops`` (k, round, path) are the paths from each key's root."""
    top = lambda i: tops.where(F.col("round") == i).select("k", F.lit(0).cast("long").alias("pos"), "path")
    found = top(len(rounds))
    for i in range(len(rounds) - 1, 0, -1):
        found = cut(_paths_of(rounds[i], found, fanout, levels).unionByName(top(i)), "paths")
    return found.withColumnRenamed("pos", "block")


def _paths_of(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    size = fanout**levels
    left = nodes.select("k", "pos", "n", "d").groupBy("k", F.floor(F.col("pos") / size).alias("block"))
    right = above.withColumnRenamed("pos", "block").groupBy("k", "block")
    return left.cogroup(right).applyInArrow(_paths(fanout, levels), f"k string, pos long, path {_PATH}")


def merkle_proofs(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group: str = "source", tamper: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row a row of ``docs``: its id, leaf, the root of its group, the root, the digest of its proof, the root folded anew and
    whether that is the root. ``tamper`` gives columns that stand for those of the same name when a leaf is folded anew."""
    given = [F.col(c) for c in fields]
    changed = [(tamper or {}).get(c, F.col(c)) for c in fields]
    k = F.coalesce(F.concat(F.lit("v"), F.col(group).cast("string")), F.lit("n"))
    differs = F.lit(False)
    for a, b in zip(given, changed, strict=True):
        differs = differs | ~a.eqNullSafe(b)
    leaves = docs.select(k.alias("k"), F.col(id_col).alias("id"), row_digest(given).alias("d"), F.when(differs, row_digest(changed)).alias("other"))
    leaves = cut(_positions(cut(leaves, "leaves"), ["id", "d"]), "nodes")
    rounds, roots = _fold(leaves, fanout, levels)
    roots = cut(roots, "roots")

    over = roots.select(F.lit("").alias("k"), F.col("k").alias("name"), "d")
    over = cut(_positions(over, ["name"]), "sources")
    upper, root = _fold(over, fanout, levels)
    start = root.select("k", "round", F.array().cast(_PATH).alias("path"))
    paths = _paths_of(over, _descend(upper, start, fanout, levels).withColumnRenamed("block", "pos"), fanout, levels)
    named = over.select("pos", F.col("name").alias("k")).join(paths.drop("k"), "pos").drop("pos")
    top = root.first()
    of_source = roots.join(named, "k").select("k", "round", "path", F.lower(F.hex("d")).alias("subroot"), F.lit(top.d.hex() if top else None).alias("root"))
    of_source = cut(of_source.withColumn("root", F.col("root").cast("string")), "tops")

    blocks = _descend(rounds, of_source.select("k", "round", "path"), fanout, levels).join(of_source.select("k", "subroot", "root"), "k")
    size = fanout**levels
    left = leaves.select("k", "pos", "n", "d", "other", "id").groupBy("k", F.floor(F.col("pos") / size).alias("block"))
    out = left.cogroup(blocks.groupBy("k", "block")).applyInArrow(_proved(fanout, levels), f"id {docs.schema[id_col].dataType.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumnRenamed("id", id_col).withColumn("verified", F.col("folded_root") == F.col("root"))


def document_proofs(docs: DataFrame) -> DataFrame:
    """Proofs of all documents; folded anew with A-Z lower-cased in the texts of ids whose crc32 five divides."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return merkle_proofs(docs, tamper={"text": F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))})


def _sql(rounds: int = 6, upper: int = 4) -> str:
    """The trees level by level, as many levels as 16 ** rounds rows of a source and 16 ** upper sources need."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    text = f"translate(text, '{UPPER}', '{LOWER}')"

    def level(a: str, i: int) -> str:
        sides = (f"coalesce(string_agg(d, '') OVER (PARTITION BY k, p // 16 ORDER BY p ROWS BETWEEN {w}), '')" for w in ("UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"))
        l, r = sides  # noqa: E741
        return (
            f"{a}{i}s AS (SELECT *, {l} AS l, {r} AS r FROM {a}{i}),\n"
            f"{a}{i + 1} AS (SELECT k, p // 16 AS p, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d FROM {a}{i} GROUP BY k, p // 16)"
        )

    def climb(a: str, i: int, source: str) -> str:
        """One level of every row's proof and fold."""
        key = "t.k = x.k" if a == "b" else "true"
        step = f"t.p // {16**i}" if a == "b" else f"t.sp // {16**i}"
        return f"SELECT t.* EXCLUDE (proof, folded), CASE WHEN x.n = 1 THEN t.proof ELSE t.proof || x.l || x.r END AS proof, CASE WHEN x.n = 1 THEN t.folded ELSE sha256(x.l || t.folded || x.r) END AS folded FROM {source} t JOIN {a}{i}s x ON {key} AND x.p = {step}"

    steps = ["WITH RECURSIVE " + CRC_SQL]
    steps.append(f"given AS (SELECT doc_id, coalesce('v' || source, 'n') AS k, {leaf('text')} AS leaf, CASE WHEN {crc_sql('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(text)} ELSE {leaf('text')} END AS other FROM documents, crc_table)")
    steps.append("b0 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY k) AS n, leaf AS d, doc_id, other FROM given)")
    steps += [level("b", i) for i in range(rounds)]
    steps.append(f"subroots AS (SELECT k, d FROM b{rounds})")
    steps.append("s0 AS (SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS p, count(*) OVER () AS n, d FROM subroots)")
    steps.append("named AS (SELECT k, d AS subroot, row_number() OVER (ORDER BY k) - 1 AS sp FROM subroots)")
    steps += [level("s", i) for i in range(upper)]
    steps.append("c0 AS (SELECT b0.doc_id, b0.k, b0.p, b0.d AS leaf, named.subroot, named.sp, '' AS proof, b0.other AS folded FROM b0 JOIN named ON named.k = b0.k)")
    steps += [f"c{i + 1} AS ({climb('b', i, f'c{i}')})" for i in range(rounds)]
    steps += [f"c{rounds + i + 1} AS ({climb('s', i, f'c{rounds + i}')})" for i in range(upper)]
    last = f"SELECT doc_id, leaf, subroot, s{upper}.d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = s{upper}.d AS verified FROM c{rounds + upper}, s{upper}"
    return ",\n".join(steps) + "\n" + last


OP12_SQL = _sql()
