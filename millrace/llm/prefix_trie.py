"""Prefix trie of conversations by van Emde Boas recursion.

Sequences are cut at half depth, again and again, for all pieces at once: a cut prefix is named by 128 bits, and below a cut
each piece is a forest whose trees have such names as roots, so upper trie and lower forests go on side by side until a piece
is one turn. Totals come back the same way: level by level, what a lower forest holds is grafted onto the upper
piece. Levels within 2 ** LEVELS positions are windows over (conversation, piece), groups of at most so many rows; above, the
chunks themselves are positions of the same recursion. A node lives in the row of its smallest member, so the trie is a set of
paths, and only what hangs below a path's top is added across conversations, as partial sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from millrace.scratch import settle

#: Positions of one group of the recursion: 2 ** LEVELS.
LEVELS = 10
#: Ids of a piece of a node's list: at most this many.
IDS = 1000
#: A conversation starts with up to this many turns of the first conversation of its hundred.
SHARED = 6
NODE = ["depth", "k1", "k2"]


def numbered_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, at, t1, t2, size): turns of each conversation in order as a written table, at being a global place, t1 and t2 120 bits of a hash of role and text, size the text's code points.

    Range partitions and their offsets number the turns, so that no conversation has to fit a task.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    digest = F.md5(both.cast("binary"))
    half = lambda a: F.conv(F.substring(digest, a, 15), 16, 10).cast("long")
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), half(1).alias("t1"), half(17).alias("t2"), F.length(text).cast("long").alias("size"))
    ordered = rows.orderBy("conv_id", F.col("turn").asc_nulls_first(), "t1", "t2").select("conv_id", "t1", "t2", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("local"))
    ordered = settle(ordered, "trie-turns")
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return ordered.join(F.broadcast(starts), "part").select("conv_id", (F.col("start") + F.col("local")).alias("at"), "t1", "t2", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns (conv_id, pos, t1, t2, size), conversations (conv_id, total)) after each conversation's first h turns were replaced by those of the first of its hundred; h = crc32(conv_id) % SHARED. A base is read by at most 199 conversations."""
    sizes = turns.groupBy("conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    sizes = settle(sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED), "trie-conversations")
    bases = sizes.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("first").alias("base_first"), F.col("n").alias("base_n"))
    plan = sizes.join(bases, "base", "left").withColumn("kept", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("total", F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = settle(plan, "trie-plan")
    own = turns.join(plan.select("conv_id", "first", "h", "kept"), "conv_id").where("at - first >= h").select("conv_id", (F.col("kept") + F.col("at") - F.col("first") - F.col("h")).alias("pos"), "t1", "t2", "size")
    heads = turns.where("conv_id % 100 = 0").withColumnRenamed("conv_id", "base").join(bases, "base").withColumn("pos", F.col("at") - F.col("base_first")).where(F.col("pos") < SHARED)
    shared = heads.select("base", "pos", "t1", "t2", "size").join(plan.where("kept > 0").select("conv_id", "base", "kept"), "base").where("pos < kept").select("conv_id", "pos", "t1", "t2", "size")
    return own.unionByName(shared), plan.select("conv_id", "total")


def positions(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, chunk, d, t1, t2, size): a row for each prefix length d of each conversation; t1, t2 belong to the turn after it (NULL at the end), size to the turn before it (0 at the start)."""
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    after = turns.select("conv_id", F.col("pos").alias("d"), "t1", "t2", zero.alias("size"))
    before = turns.select("conv_id", (F.col("pos") + 1).alias("d"), none.alias("t1"), none.alias("t2"), "size")
    start = convs.select("conv_id", zero.alias("d"), none.alias("t1"), none.alias("t2"), zero.alias("size"))
    rows = after.unionByName(before).unionByName(start).withColumn("chunk", F.shiftright("d", LEVELS)).repartition("conv_id", "chunk")
    return rows.groupBy("conv_id", "chunk", "d").agg(F.max("t1").alias("t1"), F.max("t2").alias("t2"), F.max("size").alias("size"))


def _cut(level: int) -> tuple[WindowSpec, Column]:
    """The window of a piece of 2 ** level positions, and whether a row is in its lower half."""
    return Window.partitionBy("conv_id", "chunk", F.shiftright("d", level)), F.col("d").bitwiseAND(F.lit(1 << (level - 1))) != 0


def _levels(last: int) -> int:
    return min(LEVELS, int(last).bit_length())


def names(rows: DataFrame, last: int) -> DataFrame:
    """Adds k1, k2: the name of the prefix of length d. Rows (conv_id, chunk, d, t1, t2, ...), d at most last.

    Each level halves all pieces: rows of a lower half move from their piece's root to the cut prefix, named by
    the old root and the exclusive or of the upper half's turns, each hashed with its place.
    """
    rows = rows.withColumns({"x1": F.when(F.col("t1").isNotNull(), F.xxhash64("d", "t1", "t2")), "x2": F.when(F.col("t1").isNotNull(), F.xxhash64("t2", "d", "t1"))})
    if last >= 1 << LEVELS:
        whole = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
        upper = whole.select("conv_id", F.shiftright("chunk", LEVELS).alias("above"), F.col("chunk").alias("d"), "t1", "t2").withColumnRenamed("above", "chunk")
        upper = names(upper, last >> LEVELS).select("conv_id", F.col("d").alias("chunk"), "k1", "k2")
        rows = rows.join(upper, ["conv_id", "chunk"])
    else:
        rows = rows.withColumns({"k1": F.lit(0).cast("long"), "k2": F.lit(0).cast("long")})
    for level in range(_levels(last), 0, -1):
        w, lower = _cut(level)
        y = {c: F.coalesce(F.bit_xor(F.when(~lower, F.col(c))).over(w), F.lit(0)) for c in ("x1", "x2")}
        rows = rows.withColumns({"y1": y["x1"], "y2": y["x2"]})
        rows = rows.withColumns({"n1": F.xxhash64("k1", "k2", "y1", "y2"), "n2": F.xxhash64("y2", "k2", "y1", "k1")})
        rows = rows.withColumns({"k1": F.when(lower, F.col("n1")).otherwise(F.col("k1")), "k2": F.when(lower, F.col("n2")).otherwise(F.col("k2"))}).drop("y1", "y2", "n1", "n2")
    return rows.drop("x1", "x2")


def grafted(rows: DataFrame, last: int, values: list[str]) -> DataFrame:
    """Replaces each value by the total over the row and all deeper rows of its conversation: level by level, a lower half's total is added to the rows of the upper half."""
    if last >= 1 << LEVELS:
        below = rows.groupBy("conv_id", "chunk").agg(*(F.sum(v).alias(v) for v in values))
        upper = below.select("conv_id", F.shiftright("chunk", LEVELS).alias("above"), F.col("chunk").alias("d"), *values, *(F.col(v).alias(f"own_{v}") for v in values)).withColumnRenamed("above", "chunk")
        upper = grafted(upper, last >> LEVELS, values).select("conv_id", F.col("d").alias("chunk"), *((F.col(v) - F.col(f"own_{v}")).alias(f"low_{v}") for v in values))
        rows = rows.join(upper, ["conv_id", "chunk"])
    else:
        rows = rows.withColumns({f"low_{v}": F.lit(0).cast("long") for v in values})
    rows = rows.withColumns({f"sum_{v}": F.col(v) + F.col(f"low_{v}") for v in values})
    for level in range(1, _levels(last) + 1):
        w, lower = _cut(level)
        rows = rows.withColumns({f"sum_{v}": F.col(f"sum_{v}") + F.when(~lower, F.coalesce(F.sum(F.when(lower, F.col(v))).over(w), F.lit(0))).otherwise(F.lit(0)) for v in values})
    return rows.withColumns({v: F.col(f"sum_{v}") for v in values}).drop(*(f"{p}_{v}" for v in values for p in ("low", "sum")))


def ends(places: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes at which a conversation ends: lists are put together in pieces of IDS ids and hashed as a stream."""
    piece = F.floor(F.col("conv_id") / IDS)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = places.where("t1 is null").groupBy(*NODE, piece.alias("piece")).agg(ids.alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        pack = lambda rows: pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.string())], names=[*NODE, "ends_sha256"])
        for batch in batches:
            for *now, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(ids.encode())
            yield pack(out)
            out = []
        if key is not None:
            yield pack([(*key, state.hexdigest())])

    dealt = parts.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids")
    return dealt.mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(conversations: DataFrame, rebuild: bool = True, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns (role, text); its members are the conversations that start with it. With
    rebuild, conversations first take over the head of the first of their hundred; without it they stay as they are.
    Turns go by turn, null first, repeated turns by a hash of role and text; null roles and texts are empty; rows without a
    conversation are left out; repeated rows are turns of their own; an empty table has no node; other columns are not read.
    """
    turns = numbered_turns(conversations, conv_col, turn_col, role_col, text_col)
    if rebuild:
        turns, convs = rebuilt(turns)
    else:
        sizes = settle(turns.groupBy("conv_id").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("total")), "trie-conversations")
        turns, convs = turns.join(sizes, "conv_id").select("conv_id", (F.col("at") - F.col("first")).alias("pos"), "t1", "t2", "size"), sizes.select("conv_id", "total")
    last = convs.agg(F.max("total")).first()[0] or 0
    places = settle(names(positions(turns, convs), last).withColumnRenamed("d", "depth").select("conv_id", *NODE, "t1", "size"), "trie-places")

    nodes = places.groupBy(*NODE).agg(F.min(F.struct("conv_id", F.col("t1").isNull().alias("ends"))).alias("first"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"))
    nodes = settle(nodes.select(*NODE, "first.conv_id", "first.ends", "n_convs", "size"), "trie-nodes")
    # a conversation holds its nodes from some depth to its end: a path, whose top hangs under a node of another one
    tops = settle(nodes.groupBy("conv_id").agg(F.min("depth").alias("top")), "trie-tops")
    under = places.withColumn("top", F.col("depth") + 1).join(tops, ["conv_id", "top"]).select("conv_id", *NODE)
    parents = under.join(nodes.select(*NODE, F.col("conv_id").alias("parent")), NODE).select("conv_id", "parent")
    branches = under.groupBy(*NODE).agg(F.count(F.lit(1)).alias("branches"))

    with_top = nodes.join(tops, "conv_id").join(branches, NODE, "left").withColumn("n_children", F.coalesce("branches", F.lit(0)) + F.when(F.col("ends"), 0).otherwise(1))
    leaf, saved = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), (F.col("n_convs") - 1) * F.col("size")
    with_top = with_top.select("conv_id", *NODE, "top", "n_convs", "n_children", leaf.alias("n_leaves"), saved.alias("saved_tokens"))
    cut = with_top.withColumn("d", F.col("depth")).withColumn("chunk", F.shiftright("depth", LEVELS)).repartition("conv_id", "chunk")
    values = ["n_leaves", "saved_tokens"]
    paths = settle(grafted(cut, last, values).drop("d", "chunk"), "trie-paths")

    # what hangs below a path's top counts for every prefix of the path that other conversations hold
    whole = paths.where("depth = top").select("conv_id", "top", *values)
    above = places.select("conv_id", *NODE).join(whole, "conv_id").where("depth < top").groupBy(*NODE).agg(*(F.sum(v).alias(f"more_{v}") for v in values))
    full = paths.join(above, NODE, "left").join(ends(places), NODE, "left").join(parents, "conv_id", "left")
    more = {v: F.col(v) + F.coalesce(f"more_{v}", F.lit(0)) for v in values}
    parent = F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent"))
    none = hashlib.sha256(b"").hexdigest()
    return full.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), *(c.alias(v) for v, c in more.items()), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
