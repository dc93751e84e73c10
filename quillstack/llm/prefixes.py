"""A trie of conversations' prefixes, built by van Emde Boas recursion.

A trie of depth 2B is an upper trie of depth B and, below each prefix that reaches its end, a lower one. All tries of one
depth are built in the same jobs: going down, sequences are cut at half depth and the cut prefixes named by their trie
and the digest of the half; going up, totals of the lower tries are grafted on the nodes of the upper ones. So a
trie of depth d takes about log2(d) rounds. Every table has a row for each turn or fewer, its keys are single turns,
prefixes' counts are pre-aggregated, and no conversation, prefix or node gathers its rows in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.llm.common import materialise
from quillstack.scratch import discard

#: Conversations of so many consecutive ids share the beginning of the first of them.
FAMILY, HEADS = 20, 4
#: Nodes with over one in so many of all children are looked up by broadcast: fewer than so many are.
HEAVY = 256
#: Characters of ids that are joined before they are hashed.
JOINED = 1 << 18
WORDS = r"[^\x20\x09-\x0D]+"
ROOT = b"root".ljust(16)


def _digest(*parts: Column) -> Column:
    """128 bits of the parts' SHA-256."""
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """((conv, d, sym, words), (conv, size)): the turns of rebuilt conversations from 1 on, and all conversations with their sizes.

    A conversation's first crc32(id) % heads turns are those of the first conversation of its family, all if that has
    fewer and none if it is absent; its own after as many follow. Turns (conv, turn, sym, words) are numbered in the
    order of turn, null first, and sym. They are sorted by ranges, as one conversation may have most rows; what a
    range needs to know of a conversation, as how many turns of it are in earlier ones, comes with a row for both.
    """
    c = F.col
    order = (c("turn").asc_nulls_first(), c("sym").asc())
    placed = materialise(turns.repartitionByRange(c("conv").asc(), *order).withColumn("_range", F.spark_partition_id()), "turns")
    counts = materialise(placed.groupBy("conv", "_range").agg(F.count("*").alias("_n")), "counts")
    sizes = counts.groupBy("conv").agg(F.sum("_n").alias("own"))
    h = F.crc32(c("conv").cast("string").cast("binary")) % heads
    known = sizes.select(c("conv").alias("base"), c("own").alias("base_size"))
    convs = sizes.select("conv", "own", (c("conv") - c("conv") % family).alias("base"), h.alias("h")).join(known, "base", "left")
    convs = materialise(convs.withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0)))), "conversations")

    earlier = Window.partitionBy("conv").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    of_range = counts.withColumn("before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(convs.select("conv", "h", "taken"), "conv")
    at = F.row_number().over(Window.partitionBy("conv", "_range").orderBy(*order))
    rows = placed.withColumn("_at", at).join(of_range, ["conv", "_range"]).withColumn("pos", c("_at") + c("before"))
    rows = materialise(rows.select("conv", "pos", "sym", "words", "h", "taken"), "numbered")
    first = rows.where(c("pos") < heads).select(c("conv").alias("base"), "pos", "sym", "words")
    begun = convs.where("taken > 0").join(first, "base").where("pos <= taken").select("conv", c("pos").alias("d"), "sym", "words")
    own = rows.where("pos > h").select("conv", (c("pos") - c("h") + c("taken")).alias("d"), "sym", "words")
    out = materialise(begun.union(own), "rebuilt")
    ends = materialise(convs.select("conv", (F.greatest(c("own") - c("h"), F.lit(0)) + c("taken")).alias("size")), "sizes")
    discard(placed, counts, rows, convs)
    return out, ends


def named_prefixes(rows: DataFrame, ends: DataFrame, levels: int) -> DataFrame:
    """(conv, d, name) for each prefix of each conversation, that of no turns included; equal names are equal prefixes.

    Halves' digests are joined upward; then, from the whole depth down, each trie's sequences are cut at half depth,
    and the prefix there is named by its trie's name and the half.
    """
    halves = [rows.select("conv", (F.col("d") - 1).alias("j"), F.col("sym").alias("g"))]
    for _ in range(levels - 1):
        even = F.col("j") % 2 == 0
        both = halves[-1].groupBy("conv", F.shiftright("j", 1).alias("j")).agg(F.max(F.when(even, F.col("g"))).alias("a"), F.max(F.when(~even, F.col("g"))).alias("b"))
        halves.append(materialise(both.where("b is not null").select("conv", "j", _digest(F.col("a"), F.col("b")).alias("g")), "halves"))
    known = [ends.select("conv", F.lit(0).cast("long").alias("d"), F.lit(bytearray(ROOT)).alias("name"))]
    for k in reversed(range(levels)):
        cut = halves[k].where("j % 2 = 0").select("conv", (F.col("j") * 2 ** k).alias("d"), "g")
        tries = known[0]
        for t in known[1:]:
            tries = tries.union(t)
        down = tries.join(cut, ["conv", "d"]).select("conv", (F.col("d") + 2 ** k).alias("d"), _digest(F.col("name"), F.col("g")).alias("name"))
        known.append(materialise(down, "prefixes"))
    every = known[0]
    for t in known[1:]:
        every = every.union(t)
    out = materialise(every, "named")
    discard(*halves[1:], *known[1:])
    return out


def grafted(nodes: DataFrame, named: DataFrame, levels: int) -> DataFrame:
    """(d, name, leaves, saved): leaves and saved tokens of all nodes below each node, from (d, name, rep, leaf, cost).

    In round k tries of depth 2 ** k are put together in pairs: what the root of a lower one has gathered goes to each
    node of the upper one that lies on the way to it, which its first member's prefixes tell.
    """
    parts = [nodes.where("leaf > 0 or cost > 0").select("d", "name", F.col("leaf").alias("leaves"), F.col("cost").alias("saved"))]
    at = nodes.select("d", "name", "rep")
    for k in range(levels):
        low = (F.col("d") % 2 ** (k + 1)) == 2 ** k
        gathered = parts[0].where(low)
        for p in parts[1:]:
            gathered = gathered.union(p.where(low))
        roots = gathered.groupBy("d", "name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).join(at.where(low), ["d", "name"])
        on_way = roots.select(F.col("rep").alias("conv"), F.explode(F.sequence(F.col("d") - 2 ** k, F.col("d") - 1)).alias("d"), "leaves", "saved")
        up = on_way.join(named, ["conv", "d"]).groupBy("d", "name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        parts.append(materialise(up, "grafts"))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    out = materialise(every.groupBy("d", "name").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "totals")
    discard(*parts[1:])
    return out


def _joined(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one node's ids, comma-joined, of about ``most`` characters at most; rows come sorted by node and id."""
        now, first, ids, size = None, 0, [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)], pa.string())], names=["d", "name", "first", "ids"])
        for b in batches:
            for d, name, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (d, name) != now or size > most:
                    if ids:
                        yield out()
                    now, first, ids, size = (d, name), conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            yield out()
    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, name, hash) of each node's runs of ids, which come sorted by node and first id."""
    now, state = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["d", "name", "hash"])
    for b in batches:
        for d, name, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (d, name) != now:
                if now:
                    yield out()
                now, state = (d, name), sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if now:
        yield out()


def ends_hashes(ending: DataFrame, joined: int = JOINED) -> DataFrame:
    """(d, name, hash): SHA-256 of the ids (conv) that end at a node, ascending.

    A hash reads its input in order, so a node's ids meet in one task; they come there in long runs, not row by row.
    """
    runs = ending.select("d", "name", "conv").repartitionByRange("d", "name", "conv").sortWithinPartitions("d", "name", "conv").mapInArrow(_joined(joined), "d long, name binary, first long, ids string")
    runs = materialise(runs, "runs")
    return runs.repartition("d", "name").sortWithinPartitions("d", "name", "first").select("d", "name", "ids").mapInArrow(_hashed, "d long, name binary, hash string")


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = FAMILY, heads: int = HEADS,
         joined: int = JOINED) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conversation's id belong to none and are left out. Turns are ordered by turn, null first; equal ones
    by a digest of role and text, and repeated rows are turns of their own. Null roles and texts count as empty. An empty table has no
    node, not even a root. Other columns are not read.
    """
    c = F.col
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    sym = _digest(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.select(c(conv_col).cast("long").alias("conv"), c(turn_col).alias("turn"), sym.alias("sym"), F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words")).where("conv is not null")
    rows, ends = rebuilt(turns, family, heads)
    deepest = ends.agg(F.max("size")).first()[0] or 0
    levels = max(1, int(deepest).bit_length())  # depths 0 to 2 ** levels - 1
    named = named_prefixes(rows, ends, levels)

    members = named.groupBy("d", "name").agg(F.min("conv").alias("rep"), F.count("*").alias("n_convs"))
    up = named.select(c("conv").alias("rep"), (c("d") + 1).alias("d"), c("name").alias("parent"))
    last = rows.select(c("conv").alias("rep"), "d", "words")
    nodes = materialise(members.join(up, ["rep", "d"], "left").join(last, ["rep", "d"], "left"), "members")
    children = nodes.where("parent is not null").groupBy((c("d") - 1).alias("d"), c("parent").alias("name")).agg(F.count("*").alias("n_children"))
    cost = (c("n_convs") - 1) * F.coalesce("words", F.lit(0))
    full = nodes.join(children, ["d", "name"], "left").select("d", "name", "rep", "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.when(c("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"), cost.alias("cost"))
    full = materialise(full, "nodes")

    totals = grafted(full, named, levels)
    hashes = ends_hashes(named.join(ends.select("conv", c("size").alias("d")), ["conv", "d"]), joined)
    out = full.join(totals, ["d", "name"], "left").join(hashes, ["d", "name"], "left")
    # a parent's id: nodes of few children by a join, the fewer than HEAVY with very many by broadcast
    above = full.where("n_children > 0").select((c("d") + 1).alias("d"), c("name").alias("parent"), c("rep").alias("parent_conv_id"), "n_children")
    many = c("n_children") > full.count() / HEAVY
    heavy = F.broadcast(above.where(many).select("d", "parent", c("parent_conv_id").alias("_heavy")))
    out = materialise(out.drop("leaf", "cost").join(heavy, ["d", "parent"], "left"), "joined")
    columns = [c("rep").alias("conv_id"), c("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(0).cast("long")).alias("n_leaves"),
               F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens"), F.coalesce("hash", F.lit(sha256(b"").hexdigest())).alias("ends_sha256")]
    found = out.where("_heavy is not null or parent is null").withColumn("parent_conv_id", c("_heavy")).select(columns)
    rest = out.where("_heavy is null and parent is not null").join(above.where(~many).drop("n_children"), ["d", "parent"]).select(columns)
    out = materialise(found.union(rest), "trie")
    discard(rows, ends, named, nodes, full, totals)
    return out
