"""Session versions under late events, for all snapshots at once.

After every batch the events of a key that have arrived form sessions: neighbours in time at most ``gap`` apart share one. A
session that gets an event of a batch is a new version and retracts the standing sessions inside it. Snapshots are not replayed
one after another, and their active events are not listed again in each, which would be quadratic for a session that grows over
many batches. Sessions only ever grow, so each snapshot's graph is taken with the sessions that stood before it contracted:

* An event starts a session from the batch in which it arrives until the first batch that puts an event at most ``gap`` before
  it; likewise it ends one until an event follows at most ``gap`` later. Both spans of batches come from windows of ``gap`` over
  time buckets, so a busy key is dealt to many tasks.
* The gap-edge graph of a snapshot has the batch's new events, the starts that stand and those that fell in it as nodes, and an
  edge from each that starts no session to the node before it. Alternating large-star and small-star steps over the graphs
  of all snapshots give the components, which are the versions; their starts are the components' smallest nodes.
* A standing session is contained in the version in which its start fell, or in the next version of the same start: that is its
  successor. Events and values are differences of prefix sums (within a bucket, then over buckets) less the late ones inside.

Nothing is collected or broadcast. A window holds one bucket of one key, one line a bucket of one key, or what one batch changed in
one unbroken run of a key; rows of one key, second and batch are summed before. A late event is listed for each batch that it
missed while a session already spanned its time, so work grows with lateness counted in batches.

Cases: rows with a null key, time or batch are left out; a null value counts as 0; repeated rows are events of their own; events
at one time belong together; times may be negative; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .store import cut

#: Seconds of a bucket; at least the gap.
BUCKET = 3600
_FIRST, _NOW, _LAST = Window.unboundedPreceding, Window.currentRow, Window.unboundedFollowing


def _placed(points: DataFrame, gap: int, bucket: int) -> DataFrame:
    """Each point (k, at, b, n, v) with: ``first``, the batch that brought its time; ``before`` and ``after``, the first batch with
    an event at most ``gap`` before or after it (null: none ever); ``lo`` and ``hi``, the unbroken run of the last snapshot that
    holds it, as structs of its ends with prefix sums; ``n0, v0, n1, v1``, sums over the key's events before this time and up to it."""
    length = max(int(bucket), int(gap), 1)
    slot = lambda t: F.floor(t / F.lit(length))
    near = F.explode(F.array_distinct(F.array(slot(F.col("at") - gap), slot(F.col("at")), slot(F.col("at") + gap))))
    spread = points.withColumn("bk", near).withColumn("own", F.col("bk") == slot(F.col("at")))
    time = Window.partitionBy("k", "bk").orderBy("at")
    mine = lambda c: F.when(F.col("own"), F.col(c)).otherwise(0)
    spread = spread.select(
        "*",
        F.min("b").over(time.rangeBetween(0, 0)).alias("first"),
        F.min("b").over(time.rangeBetween(-gap, -1)).alias("before") if gap else F.lit(None).cast("long").alias("before"),
        F.min("b").over(time.rangeBetween(1, gap)).alias("after") if gap else F.lit(None).cast("long").alias("after"),
        *(F.sum(mine(c)).over(time.rangeBetween(_FIRST, 0)).alias(f"{c}1") for c in "nv"),
    )
    spread = spread.where("own").drop("own")
    alike = Window.partitionBy("k", "bk", "at")
    spread = cut(spread.withColumns({f"{c}0": F.col(f"{c}1") - F.sum(c).over(alike) for c in "nv"}), "points")

    opens, closes = F.when(F.col("before").isNull(), F.struct("at", "first", "n0", "v0")), F.when(F.col("after").isNull(), F.struct("at", "n1", "v1"))
    sums = spread.groupBy("k", "bk").agg(F.sum("n").alias("sn"), F.sum("v").alias("sv"), F.max(opens).alias("lo"), F.min(closes).alias("hi"))
    left, right = Window.partitionBy("k").orderBy("bk").rowsBetween(_FIRST, -1), Window.partitionBy("k").orderBy(F.desc("bk")).rowsBetween(_FIRST, -1)
    sums = sums.withColumns({f"{c}_": F.coalesce(F.sum(f"s{c}").over(left), F.lit(0)) for c in "nv"})
    sums = sums.select("k", "bk", "n_", "v_", _shift("lo", "n0", "v0").alias("lo"), _shift("hi", "n1", "v1").alias("hi"))
    sums = sums.select("k", "bk", "n_", "v_", F.last("lo", True).over(left).alias("lo_"), F.last("hi", True).over(right).alias("hi_"))

    both = spread.hint("merge").join(sums.hint("merge"), ["k", "bk"])
    both = both.withColumns({f"{c}{i}": F.col(f"{c}{i}") + F.col(f"{c}_") for c in "nv" for i in "01"})
    back = Window.partitionBy("k", "bk").orderBy(F.desc("at"))
    both = both.withColumn("lo", F.coalesce(F.last(opens, True).over(time.rangeBetween(_FIRST, _NOW)), "lo_"))
    both = both.withColumn("hi", F.coalesce(F.last(closes, True).over(back.rangeBetween(_FIRST, _NOW)), "hi_"))
    return cut(both.drop("lo_", "hi_", "n_", "v_", "bk"), "placed")


def _shift(name: str, n: str, v: str) -> Column:
    """A struct's sums counted from the key's first event instead of the bucket's."""
    return F.when(F.col(name).isNotNull(), F.col(name).withField(n, F.col(f"{name}.{n}") + F.col("n_")).withField(v, F.col(f"{name}.{v}") + F.col("v_")))


def _span(low: Column, high: Column) -> Column:
    """The batches from ``low`` to before ``high``."""
    return F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))


def _changes(placed: DataFrame) -> DataFrame:
    """What each snapshot has to look at, by (k, run, batch): new events ("n"), starts ("s") and ends ("e") that stand within a run
    without being its own, starts that fell ("d"), and events that come later but whose time a session may span ("p")."""
    rep = F.col("b") == F.col("first")
    some = F.lit(2**62)
    at_left, at_right = (F.least(F.coalesce(c, some), F.col("first")) for c in ("before", "after"))
    each = lambda kind, batches: F.transform(batches, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("batch")))
    held = lambda side: F.when(rep & F.col(side).isNotNull(), _span(F.col("first"), F.col(side))).otherwise(F.array().cast("array<bigint>"))
    fell = F.when(rep & (F.col("before") > F.col("first")), F.array("before")).otherwise(F.array().cast("array<bigint>"))
    seen = F.concat(
        each("n", F.array("b")), each("s", held("before")), each("e", held("after")), each("d", fell), each("p", _span(F.greatest(at_left, at_right), F.col("b")))
    )
    return placed.withColumn("_", F.explode(seen)).select("k", "lo", "hi", F.col("lo.at").alias("run"), "_.batch", "_.kind", "at", "first", *"nv", "n0", "v0", "n1", "v1")


def session_versions(events: DataFrame, gap: int, key: str = "key", at: str = "at", batch: str = "batch", value: str = "value", bucket: int = BUCKET) -> DataFrame:
    """Every version of every session: key, batch, start, end, n_events, n_new, n_retracted, value_sum, and the batch and start of
    the version that retracts it (null for a final one). ``at``, ``batch`` and ``value`` are integers."""
    given = events.select(F.col(key).alias("k"), *(F.col(c).cast("long").alias(a) for c, a in ((at, "at"), (batch, "b"))), F.coalesce(F.col(value).cast("long"), F.lit(0)).alias("v"))
    points = given.where("k IS NOT NULL AND at IS NOT NULL AND b IS NOT NULL").groupBy("k", "at", "b").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    rows = _changes(_placed(points, gap, bucket))

    group = Window.partitionBy("k", "run", "batch")
    up, down = group.orderBy("at"), group.orderBy(F.desc("at"))
    start = F.when(F.col("kind") == "s", F.struct("at", "first", "n0", "v0"))
    stop = F.when(F.col("kind") == "e", F.struct("at", "n1", "v1"))
    node = F.when(F.col("kind").isin("n", "s", "d"), F.col("at"))
    rows = rows.withColumns({"start": F.last(start, True).over(up.rangeBetween(_FIRST, _NOW)), "stopped": F.last(stop, True).over(up.rangeBetween(_FIRST, -1))["at"], "previous": F.last(node, True).over(up.rangeBetween(_FIRST, -1))})
    rows = rows.withColumns({"stop": F.last(stop, True).over(down.rangeBetween(_FIRST, _NOW)), "starting": F.last(start, True).over(down.rangeBetween(_FIRST, -1))["at"]})
    # a later event's time lies inside a session if the nearest end of one to its left is a start, or there is none and to its right none is a start
    left_in = F.col("start").isNotNull() & F.coalesce(F.col("start.at") > F.col("stopped"), F.lit(True))
    right_in = F.col("start").isNull() & F.col("stopped").isNull() & (F.col("starting").isNull() | F.coalesce(F.col("stop.at") < F.col("starting"), F.lit(False)))
    rows = rows.where(F.col("kind").isin("n", "d") | (F.col("kind") == "p") & (left_in | right_in) | (F.col("kind") == "s"))
    rows = rows.select("k", "run", "batch", "kind", "at", *"nv", "previous", F.coalesce("start", "lo").alias("start"), F.coalesce("stop", "hi").alias("stop"))
    rows = cut(rows, "changes")

    # gap edges of all snapshots, and the components that they form; a node alone is a component of its own
    nodes = rows.where(F.col("kind") != "p")
    name = lambda t: F.struct("k", "batch", F.col(t).alias("at"))
    edges = nodes.where(F.col("start.at") < F.col("at")).withColumn("previous", F.coalesce("previous", "run")).select(name("at").alias("a"), name("previous").alias("b"))
    found = components(edges).select(F.col("node.k").alias("k"), F.col("node.batch").alias("batch"), F.col("node.at").alias("at"), F.col("component.at").alias("label"))
    nodes = nodes.where(F.col("kind") != "s").hint("merge").join(found.hint("merge"), ["k", "batch", "at"], "left").withColumn("label", F.coalesce("label", "at"))
    late = rows.where(F.col("kind") == "p").withColumn("label", F.col("start.at"))
    both = cut(nodes.unionByName(late), "labelled")

    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    made = both.groupBy("k", "batch", "label").agg(
        of("n", "n").alias("n_new"), F.count(F.when(F.col("kind") == "d", 1)).alias("fallen"), of("p", "n").alias("pn"), of("p", "v").alias("pv"),
        F.min(F.when(F.col("kind") == "n", F.col("start"))).alias("start"), F.max(F.when(F.col("kind") == "n", F.col("stop"))).alias("stop"),
    ).where("n_new > 0")
    made = made.select(
        "k", "batch", F.col("label").alias("start"), F.col("stop.at").alias("end"), (F.col("stop.n1") - F.col("start.n0") - F.col("pn")).alias("n_events"), "n_new",
        (F.col("fallen") + (F.col("start.first") < F.col("batch")).cast("long")).alias("n_retracted"), (F.col("stop.v1") - F.col("start.v0") - F.col("pv")).alias("value_sum"), F.col("label").alias("into"),
    )
    fallen = both.where(F.col("kind") == "d").select("k", "batch", F.col("at").alias("start"), F.col("label").alias("into"))
    following = Window.partitionBy("k", "start").orderBy("batch")
    chained = made.unionByName(fallen, allowMissingColumns=True).withColumns({"retracted_batch": F.lead("batch").over(following), "retracted_start": F.lead("into").over(following)})
    return chained.where("n_new IS NOT NULL").select(F.col("k").alias("key"), "batch", "start", "end", "n_events", "n_new", "n_retracted", "value_sum", "retracted_batch", "retracted_start")


def conversation_events(turns: DataFrame) -> DataFrame:
    """Turns as events of users: key, at, batch and value from checksums of their ids; turns without a number are none."""
    turn, conv = F.col("turn").cast("long"), F.col("conv_id").cast("long")
    crc = lambda c: F.crc32(c.cast("binary"))
    said = turns.where(turn.isNotNull()).select(conv.alias("conv"), turn.alias("turn"), crc(conv.cast("string")).alias("c"), crc(F.concat_ws(":", conv.cast("string"), turn.cast("string"))).alias("h"))
    said = said.withColumn("g", F.floor(F.col("h") / 600)).withColumn("at", F.floor(F.col("c") / 2) % 7200 + 300 * F.col("turn") + F.col("h") % 600)
    late = F.when(F.col("g") % 3 == 0, F.col("g") % 4).otherwise(0)
    return said.where("conv IS NOT NULL").select((2 * F.shiftright("conv", 3) + F.col("c") % 2).alias("key"), "at", (F.floor(F.col("at") / 1800) + late).alias("batch"), F.col("h").alias("value"))


def conversation_sessions(turns: DataFrame, gap: int = 240) -> DataFrame:
    """All session versions of the users of a conversations table."""
    names = {"key": "user", "start": "start_s", "end": "end_s", "value_sum": "h_sum", "retracted_start": "retracted_start_s"}
    return session_versions(conversation_events(turns), gap).withColumnsRenamed(names)


#: crc32 by its rule (reflected, polynomial 0xEDB88320), a byte at a time; ``crc_table`` is computed, not listed.
CRC_SQL = r"""
crc_steps(i, v, n) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, n + 1 FROM crc_steps WHERE n < 8),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM crc_steps WHERE n = 8)
"""


def crc_sql(text: str) -> str:
    """SQL for crc32 of an ASCII text, where ``crc_table`` is joined."""
    bytes_ = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce({bytes_}, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
said AS (SELECT conv_id, turn, {crc_sql("conv_id::VARCHAR")} AS c, {crc_sql("conv_id::VARCHAR || ':' || turn::VARCHAR")} AS h FROM conversations, crc_table WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
timed AS (SELECT 2 * (conv_id >> 3) + c % 2 AS u, (c // 2) % 7200 + 300 * turn + h % 600 AS s, h, h // 600 AS g FROM said),
ev AS (SELECT u, s, h, floor(s / 1800)::BIGINT + CASE WHEN g % 3 = 0 THEN g % 4 ELSE 0 END AS b FROM timed),
snaps AS (SELECT DISTINCT u, b AS snap FROM ev),
active AS (SELECT u, snap, s, h, b, CASE WHEN s - lag(s) OVER (PARTITION BY u, snap ORDER BY s) <= 240 THEN 0 ELSE 1 END AS opens FROM snaps JOIN ev USING (u) WHERE b <= snap),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY u, snap ORDER BY s) AS k FROM active),
sessions AS (SELECT u, snap, k, min(s) AS a, max(s) AS z, count(*) AS n, count(*) FILTER (b = snap) AS n_new, sum(h) AS hs FROM numbered GROUP BY u, snap, k),
versions AS (SELECT * FROM sessions WHERE n_new > 0),
ends AS (SELECT v.u, v.snap, v.a, min_by(w, w.snap) AS w FROM versions v JOIN versions w ON w.u = v.u AND w.snap > v.snap AND w.a <= v.a AND w.z >= v.z GROUP BY v.u, v.snap, v.a),
gone AS (SELECT u, w.snap AS snap, w.a AS a, count(*) AS n FROM ends GROUP BY ALL)
SELECT v.u::BIGINT AS "user", v.snap::BIGINT AS batch, v.a::BIGINT AS start_s, v.z::BIGINT AS end_s, v.n::BIGINT AS n_events, v.n_new::BIGINT AS n_new, coalesce(g.n, 0)::BIGINT AS n_retracted,
  v.hs::BIGINT AS h_sum, e.w.snap::BIGINT AS retracted_batch, e.w.a::BIGINT AS retracted_start_s
FROM versions v LEFT JOIN ends e ON e.u = v.u AND e.snap = v.snap AND e.a = v.a LEFT JOIN gone g ON g.u = v.u AND g.snap = v.snap AND g.a = v.a
"""
