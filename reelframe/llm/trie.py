"""The trie of conversation prefixes: which turns many conversations begin with, and what sharing them would save.

Method: truncation peeling. Conversations with the same turns are one class. From the greatest depth downwards, a step takes
the nodes left by the step before and the classes that end at this depth, strips one turn from each node, and regroups
by what is left: members, children, leaves and savings are added up while the nodes are found, so each distinct prefix is
shuffled once, however many conversations begin with it.

Prefixes are named by 128 bits: the exclusive or of two 64-bit hashes of (depth, SHA-256 of role and text) of every turn.
Such names can be put together from pieces, so a conversation of any length is cut into pieces of BLOCK turns and no row
or window holds a whole one. Depths are peeled block by block. A node that shares its first turn in a block with no other
node of that block cannot meet one there: its chain down to the block's beginning is written out at once. The other nodes
take one step a depth, so the number of steps follows the greatest depth at which two conversations still agree in a block.

Defined results: rows without conv_id are left out; a null role or text is an empty one; turns follow each other by turn
(null first), then role, then text; repeated rows are turns of their own; extra columns are ignored; conversations without a
turn end at the root; an empty table has no node.
"""
from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import remove, written

BLOCK, IDS = 64, 12
ROW_BITS = 33  # of monotonically_increasing_id: the bits of the row within its partition
NODE = ["depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, spans): the turns of (conv_id, turn, role, text) in order, hashed, and how many each partition has of a conversation.

    Rows are sorted over range partitions, so a conversation that holds most rows is spread over many tasks.
    """
    kept = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    keys = ["conv_id", "turn", "role", "text"]
    digest = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    turns = kept.repartitionByRange(*keys).sortWithinPartitions(*keys)
    turns = turns.select("conv_id", digest.alias("digest"), F.char_length("text").cast("long").alias("size"), F.monotonically_increasing_id().alias("at"))
    turns = written(turns.withColumn("part", F.shiftright("at", ROW_BITS)), "turns")
    counts = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return turns, written(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "spans")


def positions(turns: DataFrame, spans: DataFrame) -> DataFrame:
    """(conv_id, depth from 1, digest, size) of every turn."""
    own = turns.join(spans.drop("n"), ["conv_id", "part"])
    return own.select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("depth"), "digest", "size")


def grafted(turns: DataFrame, spans: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(steps, ids) of conversations whose first h turns come from conversation c - c % every, h = crc32(decimal c) % (most + 1).

    Their own turns after the first h follow. At most `most` turns of a conversation are copied, to fewer than 2 * every others.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    counts = spans.groupBy("conv_id").agg(F.sum("n").alias("n"))
    sources = counts.select(F.col("conv_id").alias("source"), F.col("n").alias("there"))
    plan = counts.select("conv_id", (F.col("conv_id") - F.col("conv_id") % every).alias("source"), h.alias("h"))
    plan = plan.join(sources, "source", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    plan = written(plan.select("conv_id", "source", "h", "taken"), "plan")
    places = positions(turns, spans)
    own = turns.join(spans.drop("n").join(plan, "conv_id"), ["conv_id", "part"])
    own = own.withColumn("pos", F.col("at") - F.col("first") + F.col("before") + 1).where("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "digest", "size")
    heads = places.where((F.col("conv_id") % every == 0) & (F.col("depth") <= most)).withColumnRenamed("conv_id", "source")
    copied = plan.where("taken > 0").select("conv_id", "source", "taken").join(heads, "source").where("depth <= taken")
    return own.unionByName(copied.select("conv_id", "depth", "digest", "size")), plan.select("conv_id")


def pieces_of(steps: DataFrame) -> DataFrame:
    """(conv_id, block, path, last): paths of at most BLOCK turns. path[0] is the prefix before the piece, path[i] the prefix that
    ends with its i-th turn: its name (k1, k2), and the code points of the piece's turns up to there. last: nothing follows."""
    block = F.expr(f"(depth - 1) div {BLOCK}")
    one = Window.partitionBy("conv_id", "block").orderBy("depth")
    rows = steps.withColumn("block", block)
    rows = rows.withColumn("k1", F.bit_xor(F.xxhash64(F.lit(1), "depth", "digest")).over(one))
    rows = rows.withColumn("k2", F.bit_xor(F.xxhash64("digest", "depth", F.lit(2))).over(one)).withColumn("upto", F.sum("size").over(one))
    lists = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("depth", "k1", "k2", "upto"))).alias("path"))
    whole = Window.partitionBy("conv_id").orderBy("block")
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    end = F.element_at("path", -1)
    for k in ("k1", "k2"):
        lists = lists.withColumn(f"from_{k}", F.coalesce(F.bit_xor(end[k]).over(earlier), F.lit(0)))
    lists = lists.withColumn("last", F.lead("block").over(whole).isNull())
    before = F.struct(F.col("from_k1").alias("k1"), F.col("from_k2").alias("k2"), F.lit(0).cast("long").alias("upto"))
    named = F.transform("path", lambda e: F.struct(e.k1.bitwiseXOR(F.col("from_k1")).alias("k1"), e.k2.bitwiseXOR(F.col("from_k2")).alias("k2"), e.upto.alias("upto")))
    return lists.select("conv_id", "block", F.concat(F.array(before), named).alias("path"), "last")


def digested(batches):
    """One row a class from its chunks of ids, which follow each other in order: the SHA-256 of all ids is fed chunk by chunk."""
    key, state, rows = None, None, []

    def flush():
        done = list(zip(*rows))
        rows.clear()
        kinds = [pa.int64()] * 5 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(done, kinds)], names=["depth", "k1", "k2", "conv_id", "n", "ends_sha256"])

    for b in batches:
        for *own, first, n, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "k1", "k2", "first", "n", "ids"))):
            if own != key:
                if key is not None:
                    rows.append((*key, least, members, state.hexdigest()))
                    if len(rows) >= 10_000:
                        yield flush()
                key, state, least, members = own, hashlib.sha256(), first, 0
            else:
                state.update(b",")
            state.update(ids.encode())
            members += n
    if key is not None:
        rows.append((*key, least, members, state.hexdigest()))
        yield flush()


def classes_of(pieces: DataFrame, ids: DataFrame) -> DataFrame:
    """(depth, k1, k2, conv_id, n, ends_sha256): conversations with the same turns, their least id, number and the digest of their ids.

    Ids are joined within chunks of 4,096 successive ids before they meet; SHA-256 over the ids in order is one pass over
    those chunks, which holds one of them at a time.
    """
    end = F.element_at("path", -1)
    ends = pieces.where("last").select("conv_id", (F.col("block") * BLOCK + F.size("path") - 1).alias("depth"), end.k1.alias("k1"), end.k2.alias("k2"))
    none = F.lit(0).cast("long")
    turnless = ids.join(pieces.where("block = 0").select("conv_id"), "conv_id", "left_anti").select("conv_id", none.alias("depth"), none.alias("k1"), none.alias("k2"))
    chunk = F.shiftright("conv_id", IDS)
    chunks = ends.unionByName(turnless).groupBy("depth", "k1", "k2", chunk.alias("chunk")).agg(F.array_sort(F.collect_set("conv_id")).alias("ids"))
    chunks = chunks.select("depth", "k1", "k2", "chunk", F.col("ids")[0].alias("first"), F.size("ids").cast("long").alias("n"), F.concat_ws(",", F.transform("ids", lambda i: i.cast("string"))).alias("ids"))
    chunks = chunks.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "chunk")
    return chunks.mapInArrow(digested, "depth long, k1 long, k2 long, conv_id long, n long, ends_sha256 string")


def regrouped(units: DataFrame, depth: int, low: int) -> DataFrame:
    """The nodes at one depth from what arrives there: (conv_id, n, kid 0 or 1, leaves, saved, ends_sha256, path)."""
    here, above = F.col("path")[depth - low], F.col("path")[depth - low - 1]
    rows = units.select("*", here.k1.alias("k1"), here.k2.alias("k2"))
    found = rows.groupBy("k1", "k2").agg(
        F.min(F.struct("conv_id", F.slice("path", 1, depth - low + 1).alias("path"))).alias("least"), F.sum("n").alias("n_convs"), F.sum("kid").alias("n_children"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("ends_sha256").alias("ends_sha256"),
    )
    found = found.select("*", "least.conv_id", "least.path").withColumn("size", here.upto - above.upto)
    return found.select(
        F.lit(depth).cast("long").alias("depth"), "k1", "k2", above.k1.alias("p1"), above.k2.alias("p2"), "conv_id", "n_convs", "n_children",
        F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"),
        "ends_sha256", "path",
    )


def chains(units: DataFrame, low: int) -> DataFrame:
    """All nodes of units that meet no other unit above depth `low`: members and leaves stay as they are on the way."""
    leaf = F.when(F.col("kid") == 0, F.lit(1)).otherwise(F.col("leaves")).cast("long")
    rows = units.select("*", F.explode(F.sequence(F.lit(low + 1).cast("long"), "level")).alias("depth"))
    at = (F.col("depth") - low).cast("int")
    here, above, end = F.get("path", at), F.get("path", at - 1), F.get("path", (F.col("level") - low).cast("int"))
    top = F.col("depth") == F.col("level")
    return rows.select(
        "depth", here.k1.alias("k1"), here.k2.alias("k2"), above.k1.alias("p1"), above.k2.alias("p2"), "conv_id", F.col("n").alias("n_convs"), F.when(top, F.col("kid")).otherwise(1).cast("long").alias("n_children"),
        leaf.alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * (end.upto - above.upto)).alias("saved_tokens"), F.when(top, F.col("ends_sha256")).alias("ends_sha256"),
    )


UNIT = ["conv_id", "n", "kid", "leaves", "saved", "ends_sha256"]


def as_units(nodes: DataFrame, *more: str) -> DataFrame:
    """Nodes with their last turn stripped: children of the nodes one depth higher."""
    one = F.lit(1).cast("long")
    return nodes.select("conv_id", F.col("n_convs").alias("n"), one.alias("kid"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends_sha256"), *more)


def peeled(pieces: DataFrame, classes: DataFrame) -> list[DataFrame]:
    """Tables of the trie's nodes (columns NODE), the root's last."""
    none = F.lit(0).cast("long")
    ended = classes.select("conv_id", "n", none.alias("kid"), none.alias("leaves"), none.alias("saved"), "ends_sha256", F.col("depth").alias("level"))
    deepest = classes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return []
    tables, left = [], None
    for block in range((deepest - 1) // BLOCK, -1, -1):
        low = block * BLOCK
        units = ended.where(F.col("level").between(low + 1, low + BLOCK))
        if left is not None:
            units = units.unionByName(left.withColumn("level", F.lit(low + BLOCK).cast("long")))
        first = F.col("path")[1]
        units = units.join(pieces.where(F.col("block") == block).select("conv_id", "path"), "conv_id").select("*", first.k1.alias("t1"), first.k2.alias("t2"))
        units = written(units, "units")
        crowds = written(units.groupBy("t1", "t2").agg(F.count("*").alias("c")).where("c > 1").drop("c"), "crowds")
        alone = written(chains(units.join(crowds, ["t1", "t2"], "left_anti"), low), "nodes")
        met = units.join(crowds, ["t1", "t2"], "left_semi").select(*UNIT, "level", "path")
        highest = met.agg(F.max("level")).first()[0]
        tables.append(alone)
        left, carried = as_units(alone.where(F.col("depth") == low + 1)), None
        if highest:
            met = written(met, "met")
            for depth in range(highest, low, -1):
                arrived = met.where(F.col("level") == depth).select(*UNIT, "path")
                nodes = written(regrouped(arrived if carried is None else arrived.unionByName(carried), depth, low), "nodes")
                tables.append(nodes.drop("path"))
                carried = as_units(nodes, "path")
            left = left.unionByName(as_units(nodes))
            remove(met)
        remove(units)
        remove(crowds)
    rest = ended.where("level = 0").select(*UNIT)
    rest = rest if left is None else rest.unionByName(left)
    root = rest.agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("kid").alias("n_children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"))
    leaves = F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("leaves")).cast("long")
    root = root.select(none.alias("depth"), none.alias("k1"), none.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), "conv_id", "n_convs", "n_children", leaves.alias("n_leaves"), "saved_tokens", "ends_sha256")
    return [*tables, written(root, "nodes")]


def prefix_trie(steps: DataFrame, ids: DataFrame) -> DataFrame:
    """The trie's nodes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    steps: (conv_id, depth, digest, size), the turns of each conversation; ids: (conv_id) of all conversations, turnless ones
    too. conv_id: the least member. ends_sha256: SHA-256 of the ids, ascending and joined by commas, that end at the node.
    """
    pieces = written(pieces_of(steps), "pieces")
    classes = written(classes_of(pieces, ids), "classes")
    tables = peeled(pieces, classes)
    remove(pieces)
    if not tables:
        return classes.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("n").alias("n_children"), F.col("n").alias("n_leaves"), F.col("n").alias("saved_tokens"), "ends_sha256")
    nodes = tables[0].select(*NODE)
    for t in tables[1:]:
        nodes = nodes.unionByName(t.select(*NODE))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(parents, ["depth", "p1", "p2"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def conversations_trie(rows: DataFrame, grafts: bool = False) -> DataFrame:
    """prefix_trie() of (conv_id, turn, role, text), as they are or with their first turns taken from others (grafted())."""
    turns, spans = ordered(rows)
    steps, ids = grafted(turns, spans) if grafts else (positions(turns, spans), spans.select("conv_id").distinct())
    return prefix_trie(steps, ids)
