"""Prefix trie of conversations, by burst tries.

Different conversations are suffixes in containers under the heads of a trie. A container with too many
turns is burst: its head becomes a node and its suffixes go on to containers by their next turn. Turns
that all of them share are passed in one step, so that long common beginnings take no round each. What is
left are containers small enough for one task; there the suffixes are sorted and swept into nodes. What a
head needs to know of its subtree is summed up from the containers, round by round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.llm.arrow import bounded_batches
from roomledger.sources.tables import materialize

TURNS = 4096  # a container with more turns is burst
WIDTH = 16  # bytes of a turn's id
SALTS = 32  # tasks that share the suffixes of one head while it is burst
BLOCK = 1 << 16  # conversation ids that are joined into one text at once
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
_NODE_FIELDS = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE)


def turn_lists(conversations: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """conv_id and turns (id and text_bytes each) of every conversation, in order of turn.

    Turns without a number come first; turns with the same number are put in order of role and id. Null
    roles and texts are empty. Rows without a conversation are in none. A turn's id is the MD5 of its
    role and text, so texts themselves are not shuffled. A conversation's turns become one value.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"), role.alias("role"),
            F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("id"),
            F.octet_length(text).cast("long").alias("text_bytes"),
        ).alias("turn"),
    )
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return lists.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["text_bytes"].alias("text_bytes"))).alias("turns"))


def branched(lists: DataFrame, family: int = 5, most: int = 8) -> DataFrame:
    """The conversations with their beginnings replaced by that of the first of their family.

    Conversation c gets the first h turns of c - c % family (all if fewer, none if there is no such
    conversation), then its own turns after the first h; h is the CRC-32 of c modulo most + 1.
    """
    lists = materialize(lists, "turn-lists")
    heads = lists.select(F.col("conv_id").alias("origin"), F.slice("turns", 1, most).alias("begin"))
    taken = F.crc32(F.col("conv_id").cast("string")) % (most + 1)
    joined = lists.withColumns({"origin": F.col("conv_id") - F.col("conv_id") % family, "taken": taken.cast("int")}).join(heads, "origin", "left")
    begin = F.coalesce(F.slice("begin", F.lit(1), F.col("taken")), F.slice("turns", F.lit(1), F.lit(0)))
    return joined.select("conv_id", F.concat(begin, F.slice("turns", F.col("taken") + 1, F.size("turns"))).alias("turns"))


def _sequences(lists: DataFrame) -> DataFrame:
    """key, conv_id, path (the turns' ids side by side) and sizes (their texts' bytes)."""
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    rows = lists.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["text_bytes"]).alias("sizes"))
    return rows.select(F.unhex(F.md5("path")).alias("key"), "conv_id", "path", "sizes")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of key and conv_id, one row per key and block of conversations."""
    for batch in batches:
        out: list[list] = []
        for key, conv_id, path, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out and out[-1][0] == key and len(out[-1][4]) < BLOCK:
                out[-1][4].append(str(conv_id))
            else:
                out.append([key, conv_id, path, sizes, [str(conv_id)]])
        if out:
            keys, first, paths, sizes, ids = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.binary()), pa.array(first, pa.int64()), pa.array(paths, pa.binary()),
                pa.array(sizes, pa.list_(pa.int64())), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([",".join(i) for i in ids], pa.string()),
            ], names=["key", "first", "path", "sizes", "n", "ids"])


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks in order of key and first, one row per key; a block at a time is fed to the digest."""
    now = digest = None

    def done(rows: list) -> pa.RecordBatch:
        paths, sizes, first, n, ends = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([
            pa.array(paths, pa.binary()), pa.array(sizes, pa.list_(pa.int64())), pa.array(first, pa.int64()),
            pa.array(n, pa.int64()), pa.array(ends, pa.string()),
        ], names=["path", "sizes", "first", "n", "ends"])

    for batch in batches:
        out = []
        for key, first, path, sizes, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is not None and now[0] == key:
                digest.update(b"," + ids.encode())
                now[4] += n
                continue
            if now is not None:
                out.append((*now[1:], digest.hexdigest()))
            now, digest = [key, path, sizes, first, n], hashlib.sha256(ids.encode())
        if out:
            yield done(out)
    if now is not None:
        yield done([(*now[1:], digest.hexdigest())])


def different(lists: DataFrame) -> DataFrame:
    """path, sizes, first (smallest conversation), n and ends of every different conversation.

    ``ends`` is the SHA-256 of the ids of all its copies, ascending, comma-joined. Copies are put in order
    by ranges, which may part them, and joined into blocks, so that a task of the next step reads a few
    rows of one conversation however many copies it has.
    """
    rows = materialize(_sequences(lists), "sequences")
    ordered = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    blocks = ordered.mapInArrow(_blocks, "key binary, first long, path binary, sizes array<long>, n long, ids string")
    dealt = blocks.repartition("key").sortWithinPartitions("key", "first")
    return dealt.mapInArrow(_copies, "path binary, sizes array<long>, first long, n long, ends string")


def common_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two paths share at their beginning, if they share the first ``known``."""
    most, at = min(len(a), len(b)) // WIDTH, known
    if a[: most * WIDTH] == b[: most * WIDTH]:
        return most
    while a[at * WIDTH : (at + 1) * WIDTH] == b[at * WIDTH : (at + 1) * WIDTH]:
        at += 1
    return at


def _shared_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Heads with the depth to which all their suffixes agree, and the sizes on the way there."""
    for batch in batches:
        low, high, depth, sizes = (batch.column(c).to_pylist() for c in ("low", "high", "depth", "sizes"))
        until = [common_turns(a, b, d) for a, b, d in zip(low, high, depth, strict=True)]
        way = [s[d - 1 : u] for s, d, u in zip(sizes, depth, until, strict=True)]
        kept = batch.select(["head", "depth", "n", "conv_id"])
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(until, pa.int32()), pa.array(way, pa.list_(pa.int64()))],
            names=[*kept.schema.names, "until", "sizes"])


def _head_of(depth) -> F.Column:
    """Key of the container that holds a path from that depth on."""
    return F.unhex(F.md5(F.substring("path", F.lit(1), depth * WIDTH)))


def _burst(suffixes: DataFrame, turns: int) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """Heads of the containers with too many turns, and all suffixes, marked with ``until`` if in one of those.

    Sizes are combined on the map side. The suffixes meet the heads salted, since one head may have a
    third of all of them.
    """
    measured = suffixes.groupBy("head", "depth").agg(
        F.count("*").alias("suffixes"), F.sum(F.size("sizes") - F.col("depth") + 1).alias("turns"), F.sum("n").alias("n"),
        F.min("first").alias("conv_id"), F.min("path").alias("low"), F.max("path").alias("high"), F.first("sizes").alias("sizes"))
    large = measured.filter((F.col("suffixes") > 1) & (F.col("turns") > turns))
    heads = materialize(large.mapInArrow(
        _shared_turns, "head binary, depth int, n long, conv_id long, until int, sizes array<long>"), "heads")
    if heads.isEmpty():
        return None, suffixes, suffixes
    salted = heads.select("head", F.col("conv_id").alias("head_conv"), "until", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marked = suffixes.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(salted, ["head", "salt"], "left")
    marked = materialize(marked.drop("salt"), "suffixes")
    return heads, marked.filter("until IS NULL").drop("until", "head_conv"), marked.filter("until IS NOT NULL")


class _Sweep:
    """Nodes of one container after another, from suffixes in order of head and path."""

    def __init__(self):
        self.head = self.path = None
        self.stack: list[list] = []  # conv_id, n, children, leaves, saved, size, ends, waiting rows of its children
        self.rows: list[tuple] = []

    def close(self, keep: int) -> None:
        """Leave nodes until so many are open; a node's children are told its smallest conversation."""
        while len(self.stack) > keep:
            conv, n, children, leaves, saved, size, ends, waiting = self.stack.pop()
            leaves, saved = leaves or 1, saved + (n - 1) * size
            self.rows += [(*self.place, False, c, d, conv, *rest) for c, d, *rest in waiting]
            node = (conv, self.depth + len(self.stack), n, children, leaves, saved, ends)
            if not self.stack:
                self.rows.append((*self.place, True, node[0], node[1], self.parent, *node[2:]))
                return
            up = self.stack[-1]
            up[0] = min(up[0], conv)
            up[1] += n
            up[2] += 1
            up[3] += leaves
            up[4] += saved
            up[7].append(node)

    def add(self, head, depth, up, level, parent, path, sizes, first, n, ends) -> None:
        if head != self.head:
            self.close(0)
            self.head, self.depth, self.place, self.parent, common = head, depth, (up, level), parent, depth - 1
        else:
            common = common_turns(self.path, path, depth)
        self.close(common - depth + 1)
        for size in sizes[common:]:
            self.stack.append([first, 0, 0, 0, 0, size, NO_ENDS, []])
        self.stack[-1][1], self.stack[-1][6] = n, ends
        self.path = path


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = _Sweep()

    def out() -> pa.RecordBatch:
        columns = zip(*sweep.rows, strict=True)
        kinds = [pa.binary(), pa.int32(), pa.bool_(), *[pa.int64()] * 7, pa.string()]
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        sweep.rows = []
        return pa.RecordBatch.from_arrays(arrays, names=["up", "level", "top", *NODE])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sweep.add(*row)
            if len(sweep.rows) > BLOCK:
                yield out()
    sweep.close(0)
    if sweep.rows:
        yield out()


_SUFFIX = ("head", "depth", "up", "level", "parent", "path", "sizes", "first", "n", "ends")


def _sweep(containers: DataFrame) -> DataFrame:
    dealt = containers.select(*_SUFFIX).repartition("head").sortWithinPartitions("head", "path")
    return dealt.mapInArrow(_swept, f"up binary, level int, top boolean, {_NODE_FIELDS}")


def _head_nodes(heads: DataFrame) -> DataFrame:
    """The nodes of heads: the one where the suffixes part, and one for each turn that all share before it."""
    steps = heads.withColumn("step", F.explode(F.sequence(F.col("depth"), F.col("until"))))
    # texts of the turns from this node to where the suffixes part
    rest = F.aggregate(F.slice("sizes", F.col("step") - F.col("depth") + 1, F.size("sizes")), F.lit(0).cast("long"), lambda a, x: a + x)
    parts = F.col("step") == F.col("until")
    return steps.select(
        "conv_id", F.col("step").cast("long").alias("depth"),
        F.when(F.col("step") == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(parts, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("below") + (F.col("n") - 1) * rest).alias("saved_tokens"),
        F.when(parts, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
        F.col("up"), parts.alias("parts"), (F.col("step") == F.col("depth")).alias("top"),
    )


def prefix_trie(lists: DataFrame, turns: int = TURNS) -> DataFrame:
    """One row per node of the trie of conversations (conv_id, turns with id and text_bytes), from the root.

    conv_id is the smallest member, parent_conv_id the parent's (null for the root); n_convs, n_children
    and n_leaves count members, children and childless nodes of the subtree; saved_tokens sums
    (n_convs - 1) * text_bytes of the last turn over the subtree; ends_sha256 is the digest of the ids
    that end there. Conversations without turns are members of the root only. Without conversations
    there are no nodes. ``turns`` bounds a container and changes no result.
    """
    bounded_batches(lists.sparkSession)
    whole = materialize(different(lists), "different")
    root = materialize(whole.agg(
        F.sum("n").alias("n"), F.min("first").alias("conv_id"), F.max(F.when(F.length("path") == 0, F.col("ends"))).alias("ends"),
    ).filter("n IS NOT NULL").select(
        F.lit(b"").alias("head"), F.lit(0).alias("depth"), F.lit(0).alias("until"), "n", "conv_id", F.lit(None).cast("long").alias("parent"),
        F.lit(None).cast("binary").alias("up"), F.array(F.lit(0).cast("long")).alias("sizes"), "ends"), "root")
    found = root.select("n", "conv_id").first()  # one row
    if found is None:
        return root.select(*[F.lit(None).cast("string" if c == "ends_sha256" else "long").alias(c) for c in NODE])

    rows = whole.filter(F.length("path") > 0).select(
        _head_of(F.lit(1)).alias("head"), F.lit(1).alias("depth"), F.lit(b"").alias("up"), F.lit(0).alias("level"),
        F.lit(found["conv_id"]).cast("long").alias("parent"), "path", "sizes", "first", "n", "ends")
    levels, containers = [root], []
    while True:
        heads, small, large = _burst(rows, turns)
        containers.append(small.select(*_SUFFIX))
        if heads is None:
            break
        place = large.groupBy("head").agg(
            F.first("up").alias("up"), F.first("parent").alias("parent"),
            F.max(F.when(F.length("path") == F.col("until") * WIDTH, F.col("ends"))).alias("ends"))
        levels.append(materialize(heads.join(place, "head"), "placed-heads"))
        on = large.filter(F.length("path") > F.col("until") * WIDTH)
        rows = on.select(
            _head_of(F.col("until") + 1).alias("head"), (F.col("until") + 1).alias("depth"), F.col("head").alias("up"),
            F.lit(len(levels) - 1).alias("level"), F.col("head_conv").alias("parent"), "path", "sizes", "first", "n", "ends")

    every = containers[0]
    for more in containers[1:]:
        every = every.union(more)
    swept = materialize(_sweep(every), "swept")
    nodes = swept.select(*NODE)
    carried = None
    for level in range(len(levels) - 1, -1, -1):
        below = swept.filter(F.col("top") & (F.col("level") == level)).select("up", "n_leaves", "saved_tokens")
        if carried is not None:
            below = below.union(carried)
        summed = levels[level].join(_sums(below), F.col("head") == F.col("below_head"), "left").drop("below_head")
        made = materialize(_head_nodes(summed.fillna(0, ["n_children", "below"]).fillna(1, ["n_leaves"])), "head-nodes")
        carried = made.filter("top").select("up", "n_leaves", "saved_tokens")
        nodes = nodes.union(made.select(*NODE))
    return nodes


def _sums(below: DataFrame) -> DataFrame:
    """What the nodes and heads right below each head sum up to."""
    return below.groupBy(F.col("up").alias("below_head")).agg(
        F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
