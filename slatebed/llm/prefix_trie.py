"""The trie of conversations' prefixes, built compressed and expanded last.

A turn is the digest of its role and text, a conversation the digests of its
turns laid end to end, so that the order of these byte strings is that of the
sequences and what two of them share is a common prefix. Equal conversations
are one sequence with many members. The different sequences are sorted over
the cluster; a stack that goes over a sorted part once makes the compressed
(Patricia) tree: a point where sequences branch, where one ends or where a leaf
is, edges of any length between them. When a point is left, its numbers are
whole and its edge is written out: along an edge members and leaves stay, and
what it saves grows by the suffix sums of the edge's turns.

Parts of the sorted order meet in prefixes that both have. For every part the
last sequence before it and the first one after it are known, so a part can
tell its own points from those it shares. Of shared ones it writes what its
sequences add, at most two paths a part; these are summed by prefix. All numbers
are sums over sequences:

* a sequence has the turns after its common prefix with the one before it for
  itself: it alone brings those nodes, and their bytes, in;
* a sequence is a leaf unless the next one continues it;
* what a subtree saves is the bytes of its members' turns less those of its
  different nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from slatebed.llm.common import forget, scratch, small, stored

#: Bytes of a turn's digest.
DIGEST = 16
#: Rows of a batch that a task hands on.
BATCH = 1 << 13
#: Shared nodes up to which they are broadcast.
FEW_SHARED = 200_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns`` in order of turn, null first; each turn's digest and UTF-8 bytes.

    Equal turn numbers are ordered by role, then digest. Null role and text are
    empty. Rows without a conv_id belong to no conversation. A conversation is
    24 bytes a turn in one row; texts aren't moved.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    # the role's length tells it from the text
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    each = conversations.where("conv_id is not null").select(
        "conv_id", F.struct("turn", role.alias("role"), F.substring(digest, 1, 2 * DIGEST).alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t")
    )
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
    return each.groupBy("conv_id").agg(ordered.alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """The contract's conversations: of each the first h turns are those of conversation c - c % 5."""
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    first = turns.select(F.col("conv_id").alias("_base"), F.slice("turns", 1, 8).alias("_first"))
    own = turns.withColumns({"_base": F.expr("conv_id - conv_id % 5"), "_h": head})
    rest = F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    heads = F.slice(F.coalesce("_first", F.slice("turns", 1, 0)), F.lit(1), F.col("_h"))
    return own.join(first, "_base", "left").select("conv_id", F.concat(heads, rest).alias("turns"))


def sequences(turns: DataFrame) -> DataFrame:
    """Different sequences: ``seq, sizes, n, first_id, ends``, the last the digest of all members' ids."""
    spelled = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    members = stored(turns.select("conv_id", F.unhex(spelled).alias("seq"), F.transform("turns", lambda t: t["size"]).alias("sizes")), "members")
    keyed = members.withColumn("key", F.sha2("seq", 256))
    kinds = keyed.groupBy("key").agg(
        F.any_value("seq").alias("seq"), F.any_value("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("first_id")
    )
    alone = kinds.where("n = 1").select("seq", "sizes", "n", "first_id", F.sha2(F.col("first_id").cast("string"), 256).alias("ends"))
    several = kinds.where("n > 1")
    # the ids of a sequence stream past in order, however many they are
    shared = keyed.select("key", "conv_id").join(several.select("key"), "key", "left_semi")
    ends = shared.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_ends, "key string, ends string")
    return alone.union(several.join(ends, "key").select("seq", "sizes", "n", "first_id", "ends"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, hashlib.sha256()
    for batch in batches:
        keys, ids = batch.column(0), batch.column(1)
        done: list[tuple[str, str]] = []
        runs = pc.run_end_encode(keys)
        low = 0
        for key, high in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            text = ",".join(map(str, ids.slice(low, high - low).to_pylist()))
            if key == now:
                text = "," + text
            else:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256()
            digest.update(text.encode())
            low = high
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], ["key", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], ["key", "ends"])


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences begin with alike."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * DIGEST : middle * DIGEST] == b[low * DIGEST : middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


class _Point:
    """A point of the compressed tree and what the sequences below it add up to."""

    __slots__ = ("depth", "brought", "n", "first_id", "leaves", "spoken", "new", "children", "ends", "waiting")

    def __init__(self, depth: int, brought: int, n: int, first_id: int, spoken: int, new: int, ends: str | None):
        self.depth = depth
        self.brought = brought  # turns that its first sequence shares with the one before it, -1: none before
        self.n, self.first_id, self.leaves, self.children = n, first_id, 0, 0
        self.spoken = spoken  # bytes of all members' turns
        self.new = new  # bytes of the nodes that its sequences bring in
        self.ends = ends
        self.waiting: list[tuple] = []  # rows of children that wait for its smallest member

    def take(self, child: _Point) -> None:
        self.n += child.n
        self.first_id = min(self.first_id, child.first_id)
        self.leaves += child.leaves
        self.spoken += child.spoken
        self.new += child.new
        if child.brought <= self.depth:  # else an earlier part has brought the child in
            self.children += 1


class TrieBuilder:
    """Sorted different sequences of one part to ``rows`` of nodes, as NODE has them.

    A node that other parts have too has its ``hash``, and its numbers are this
    part's share. ``parent`` is the hash of a shared parent, which alone knows
    its smallest member.
    """

    def __init__(self, before: bytes | None):
        self.seq, self.total = before, [0]
        self.left = self.right = -1  # turns shared with the last sequence before the part, the first after it
        self.stack: list[_Point] = []
        self.rows: list[tuple] = []
        self.hashes = [b""]  # of the current sequence's prefixes, as far as needed
        self.started = False

    def add(self, seq: bytes, sizes: list[int], n: int, first_id: int, ends: str) -> None:
        shared = -1 if self.seq is None else common_turns(self.seq, seq)
        if self.started:
            self._leave(shared)
            self.left = min(self.left, shared)
        else:
            self.left, self.started = shared, True
        del self.hashes[max(shared, 0) + 1 :]
        self.seq, self.total = seq, [0, *accumulate(sizes)]
        whole = self.total[-1]
        self.stack.append(_Point(len(sizes), shared, n, first_id, n * whole, whole - self.total[max(shared, 0)], ends))

    def finish(self, after: bytes | None) -> None:
        self.right = -1 if after is None else common_turns(self.seq, after)
        self._leave(self.right)
        while self.stack:
            point = self.stack.pop()
            self._close(point, self.stack[-1] if self.stack else None)

    def _leave(self, shared: int) -> None:
        """Closes the points that the next sequence, of so many shared turns, doesn't have."""
        if self.stack[-1].depth > shared:  # nothing continues the sequence
            self.stack[-1].leaves += 1
        while self.stack and self.stack[-1].depth > shared:
            point = self.stack.pop()
            if shared >= 0 and (not self.stack or self.stack[-1].depth < shared):
                self.stack.append(_Point(shared, point.brought, 0, point.first_id, 0, 0, None))
            self._close(point, self.stack[-1] if self.stack else None)

    def _close(self, point: _Point, parent: _Point | None) -> None:
        """Writes the nodes of the edge from the parent down to the point, deepest first."""
        above, met = parent.depth if parent else -1, max(self.left, self.right)
        children, ends = point.children, point.ends
        for depth in range(point.depth, above, -1):
            upto, brought = self.total[max(depth - 1, 0)], self.total[min(max(point.brought, 0), depth)]
            saved = point.spoken - point.n * upto - (point.new - max(0, upto - brought))
            row = (point.first_id, depth, None, point.n, children, point.leaves, saved, ends, self._hash(depth) if depth <= met else None, None)
            if depth == 0:
                self.rows.append(row)
            elif depth - 1 <= met:
                self.rows.append((*row[:9], self._hash(depth - 1)))
            elif depth - 1 > above:
                self.rows.append((*row[:2], point.first_id, *row[3:]))
            else:
                parent.waiting.append(row)
            children, ends = int(point.brought < depth), None
        for row in point.waiting:
            self.rows.append((*row[:9], self._hash(point.depth)) if point.depth <= met else (*row[:2], point.first_id, *row[3:]))
        if parent:
            parent.take(point)

    def _hash(self, depth: int) -> bytes:
        while len(self.hashes) <= depth:
            at = (len(self.hashes) - 1) * DIGEST
            self.hashes.append(hashlib.blake2b(self.hashes[-1] + self.seq[at : at + DIGEST], digest_size=DIGEST).digest())
        return self.hashes[depth]


NODE = {
    "conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(),
    "saved_tokens": pa.int64(), "ends": pa.string(), "hash": pa.binary(), "parent": pa.binary(),
}
_NODE_SQL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, hash binary, parent binary"
#: Of a part's rows the last sequence before it, its own ones, the first one after it.
BEFORE, OWN, AFTER = 0, 1, 2


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, before, builder = None, None, None

    def written(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(NODE)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, NODE.values())], list(NODE))

    for batch in batches:
        for pid, kind, seq, sizes, n, first_id, ends in zip(*(c.to_pylist() for c in batch.columns)):
            if pid != part:
                if builder:
                    builder.finish(None)  # the last part of all
                    yield written(builder.rows)
                part, before, builder = pid, None, None
            if kind == BEFORE:
                before = seq
            elif kind == OWN:
                if builder is None:
                    builder = TrieBuilder(before)
                builder.add(seq, sizes, n, first_id, ends)
                if len(builder.rows) >= BATCH:
                    yield written(builder.rows)
                    builder.rows = []
            else:
                builder.finish(seq)
                yield written(builder.rows)
                builder = None
    if builder:
        builder.finish(None)
        yield written(builder.rows)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """``conv_id, turns`` to one row per node of the trie of turn prefixes.

    Columns are those of the contract. ``turns`` is an array of structs of a
    ``digest`` (32 hexadecimal digits) and a ``size``. No conversations, no nodes.
    """
    spark = turns.sparkSession
    with scratch(spark) as kept:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = stored(sequences(turns).repartitionByRange(parts, "seq").withColumn("pid", F.spark_partition_id()), "sequences")
        # a row for each part: as many as the session has shuffle partitions
        ends = ordered.groupBy("pid").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
        row = Window.orderBy("pid")
        borders = ends.select("pid", F.lag("high").over(row).alias("before"), F.lead("low").over(row).alias("after"))
        none = [F.lit(None).cast(t).alias(c) for c, t in (("sizes", "array<long>"), ("n", "long"), ("first_id", "long"), ("ends", "string"))]
        stream = ordered.select("pid", F.lit(OWN).alias("kind"), "seq", "sizes", "n", "first_id", "ends")
        for kind, column in ((BEFORE, "before"), (AFTER, "after")):
            stream = stream.union(borders.where(f"{column} is not null").select("pid", F.lit(kind), column, *none))
        sorted_parts = stream.repartition(parts, "pid").sortWithinPartitions("pid", "kind", "seq")
        nodes = stored(sorted_parts.mapInArrow(_build, _NODE_SQL), "nodes")
        sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
        shared = stored(
            nodes.where("hash is not null").groupBy("hash").agg(F.min("conv_id").alias("conv_id"), F.any_value("depth").alias("depth"), *sums, F.max("ends").alias("ends"), F.max("parent").alias("parent")),
            "shared",
        )
        kept += [nodes, shared]
    numbers = ["n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")]
    own = nodes.where("hash is null")
    of_own = own.where("parent is null").select("conv_id", "depth", "parent_conv_id", *numbers)
    below = own.where("parent is not null").select(*shared.columns).union(shared)
    parents = small(shared.select(F.col("hash").alias("parent"), F.col("conv_id").alias("parent_conv_id")), FEW_SHARED)
    return of_own.union(below.drop("hash").join(parents, "parent", "left").select("conv_id", "depth", "parent_conv_id", *numbers))


def op11_prefix_trie(conversations: DataFrame) -> DataFrame:
    """The contract's columns, one row per node of the rebuilt conversations' trie.

    Null role and text are empty, null turns come first, equal turns by role
    and digest, and repeated rows are turns of their own; rows without a
    conv_id are left out; other columns are ignored. An empty table has no
    members and so no root.
    """
    turns = stored(turns_of(conversations), "turns")
    found = prefix_trie(rebuilt(turns))
    forget(turns.sparkSession, turns)
    return found
