"""Trie of the turns that conversations begin with, built from adaptive radix trees.

A turn becomes an id of 16 bytes (the head of the digest of role and text), a conversation the string of its turns' ids. The
strings are sorted over all tasks; a task puts a bounded slice of them at a time into an adaptive radix tree (`radix`), whose
depth counts bytes, and only depths at whole turns emit nodes of the trie. The order leaves most nodes inside one slice: these are
complete. Nodes on the paths of a slice's first and last string may go on in its neighbours; they are emitted in parts that
add up. Parts count what begins in a slice (a node is new below the turns shared with the string before) and what ends in it (a
node is childless if the string after does not extend it), so that sums over slices are right; where a task cannot see the string
before or after, a few correcting parts are derived from the tasks' outermost strings. A node that a third of all
conversations share, or that many copies end in, is a few parts for each slice.

Texts never travel. A conversation is one row with 20 bytes a turn, which bounds its turns by Spark's 2 GB a row; nothing else is
gathered. `ends_sha256` is one digest over all ids of a node in order, so the packed ids of one node are streamed through one task.

Defined cases: a null role or text is empty. A null turn stands first; rows of one turn stand in order of their ids, so
repeated rows are all turns. A null conv_id names no conversation: such rows are left out. An empty table has no root and no
rows. Columns other than the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cropgrid.llm.merkle import checksum_sql
from cropgrid.llm.radix import Tree, common
from cropgrid.operators.skew import salted_join
from cropgrid.session import cut_lineage, kept_table

ID = 16
#: Conversations whose beginning the others of its hundred take over, and the most turns they take.
HUNDRED, TAKEN = 100, 5
#: Bytes of strings, ids and conversations in one radix tree.
SLICE = 4 << 20
NONE = hashlib.sha256(b"").hexdigest()
#: One table for nodes, parts (node is set) and the outermost strings of tasks (task is set).
PARTS = ("node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, ends_from long, ends binary, task long, first binary, first_sizes array<int>, last binary")
COLUMNS = [x.split()[0] for x in PARTS.split(", ")]


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, key (ids of the rebuilt conversation's turns) and sizes (code points of their texts)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * ID)
    own = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").cast("long").alias("turn"), name.alias("id"), F.length(text).alias("size")).alias("t"))
    whole = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    heads = whole.where(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, TAKEN).alias("head"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (TAKEN + 1)).cast("int")
    each = (whole.withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED).withColumn("taken", taken).join(heads, "base", "left")
            .select("conv_id", F.expr("concat(coalesce(slice(head, 1, taken), array()), slice(turns, taken + 1, size(turns)))").alias("turns")))
    return each.select("conv_id", F.unhex(F.expr("array_join(transform(turns, t -> t.id), '')")).alias("key"), F.expr("transform(turns, t -> t.size)").alias("sizes"))


class Slice:
    """Strings that follow each other in order, with their conversations in order."""

    def __init__(self, before: bytes | None):
        self.before, self.bytes = before, 0
        self.keys: list[bytes] = []
        self.convs: list[list[int]] = []
        self.sizes: list[list[int]] = []

    def add(self, key: bytes, conv: int, sizes: list[int]) -> None:
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
            self.convs.append([])
            self.sizes.append(sizes)
            self.bytes += 2 * len(key)
        self.convs[-1].append(conv)
        self.bytes += 16

    def nodes(self, after: bytes | None) -> Iterator[tuple]:
        """Rows of PARTS. `before` and `after` are the strings beside the slice, or None where they are not known."""
        tree, length = Tree(), {}
        for at, key in enumerate(self.keys):
            tree.insert(key, at)
            length.update((key[k * ID:(k + 1) * ID], n) for k, n in enumerate(self.sizes[at]))
        parent, depth, size, ends = walked(tree, length)
        n = len(parent)
        shared = common(self.before, self.keys[0]) // ID if self.before is not None else -1
        edge = {}  # nodes on the first and last string's path, by place; the first string's nodes come first in the walk
        first_path, last_path = (path_of(parent, at) for at in (next(i for i, e in enumerate(ends) if e is not None), max(i for i, e in enumerate(ends) if e is not None)))
        for key, path in ((self.keys[0], first_path), (self.keys[-1], last_path)):
            edge.update(zip(path, names(key), strict=True))
        new = np.ones(n, np.int64)
        new[[at for at in first_path if depth[at] <= shared]] = 0
        convs, least, leaves, kids, total = (np.zeros(n, np.int64) for _ in range(5))
        least[:] = np.iinfo(np.int64).max
        has_kids = np.zeros(n, bool)
        has_kids[parent[1:]] = True
        goes_on = after is not None and after.startswith(self.keys[-1])
        for at in range(n - 1, -1, -1):  # kids stand behind their parents
            if ends[at] is not None:
                own = self.convs[ends[at]]
                convs[at] += len(own)
                least[at] = min(least[at], own[0])
                leaves[at] += not has_kids[at] and not (goes_on and at == last_path[-1])
            total[at] += (convs[at] - new[at]) * size[at]
            if at:
                up = parent[at]
                convs[up] += convs[at]
                least[up] = min(least[up], least[at])
                leaves[up] += leaves[at]
                total[up] += total[at]
                kids[up] += new[at]
        for at in range(n):
            up = parent[at]
            is_open, own = at in edge, self.convs[ends[at]] if ends[at] is not None else []
            text = ",".join(map(str, own)).encode()
            yield (edge.get(at), edge.get(up) if at else None, int(least[at]), int(depth[at]),
                   int(least[up]) if at and up not in edge else None, int(convs[at]), int(kids[at]), int(leaves[at]), int(total[at]),
                   None if is_open else hashlib.sha256(text).hexdigest(), own[0] if is_open and own else None, text if is_open and own else None,
                   None, None, None, None)


def walked(tree: Tree, length: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Nodes of the trie in order, parents before kids: parent, depth in turns, code points of the last text, what ends there."""
    parent, depth, size, ends = [0], [0], [0], [None]
    todo = [(tree.root, b"", 0)]
    while todo:
        node, tail, at = todo.pop()
        tail += node.prefix  # bytes since the last whole turn
        for k in range(0, len(tail) - ID + 1, ID):
            parent.append(at)
            depth.append(depth[at] + 1)
            size.append(length[tail[k:k + ID]])
            ends.append(None)
            at = len(parent) - 1
        tail = tail[len(tail) - len(tail) % ID:]
        if node.ends is not None:
            ends[at] = node.ends
        todo.extend((kid, tail + bytes([byte]), at) for byte, kid in reversed(list(node.branches())))
    return np.array(parent), np.array(depth), np.array(size), ends


def path_of(parent: np.ndarray, at: int) -> list[int]:
    path = [at]
    while path[-1]:
        path.append(int(parent[path[-1]]))
    return path[::-1]


def names(key: bytes) -> list[bytes]:
    """The names of a string's nodes, the root first: digests of its beginnings."""
    digest = hashlib.sha256()
    out = [digest.digest()[:ID]]
    for k in range(0, len(key), ID):
        digest.update(key[k:k + ID])
        out.append(digest.digest()[:ID])
    return out


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


SCHEMA = pa.schema([(x.split()[0], {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[x.split()[1]])
                    for x in PARTS.split(", ")])
ROWS = 1 << 14


def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield batch_of(held, SCHEMA)
            held = []
    if held:
        yield batch_of(held, SCHEMA)


def parts_of(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nodes, parts and outermost strings of one task's sorted conversations."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, first = Slice(None), None
        for batch in batches:
            for key, conv, sizes in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "sizes")), strict=True):
                if first is None:
                    first = (key, sizes)
                if held.bytes >= most:
                    yield from held.nodes(key)
                    held = Slice(held.keys[-1])
                held.add(key, conv, sizes)
        if first is not None:
            yield from held.nodes(None)
            yield (*[None] * 12, TaskContext.get().partitionId(), *first, held.keys[-1])

    return lambda batches: batched(rows(batches))


def corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts that take back what a task counted for want of its neighbours' strings. Rows: first, first_sizes, last, before, after."""
    def part(name: bytes, up: bytes | None, depth: int, kids: int, leaves: int, saved: int) -> tuple:
        return (name, up, None, depth, None, 0, kids, leaves, saved, *[None] * 7)

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for first, sizes, last, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shared = common(before, first) // ID if before is not None else 0
                known, saved = names(first[:shared * ID]), 0
                for depth in range(shared, -1, -1):
                    saved += sizes[depth - 1] if depth else 0
                    yield part(known[depth], known[depth - 1] if depth else None, depth, -int(depth < shared), 0, saved)
                if after is not None and after.startswith(last):
                    known = names(last)
                    for depth, name in enumerate(known):
                        yield part(name, known[depth - 1] if depth else None, depth, 0, -1, 0)

    yield from batched(rows())


def streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node and ends_sha256 of parts that come in order of node and ends_from."""
    at, digest = None, hashlib.sha256()
    for batch in batches:
        done: tuple[list, list] = ([], [])
        for node, text in zip(batch.column("node").to_pylist(), batch.column("ends"), strict=True):
            if node != at:
                if at is not None:
                    done[0].append(at)
                    done[1].append(digest.hexdigest())
                at, digest = node, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["node", "ends_sha256"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["node", "ends_sha256"])


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(turns: DataFrame, slice_bytes: int = SLICE) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations (columns RESULT)."""
    order = ["key", "conv_id"]
    ordered = rebuilt(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    made = kept_table(ordered.mapInArrow(parts_of(slice_bytes), PARTS), "trie")
    tasks = Window.orderBy("task")
    edges = made.where("task is not null").select(
        "first", "first_sizes", "last", F.lag("last").over(tasks).alias("before"), F.lead("first").over(tasks).alias("after"))
    parts = made.where("node is not null").unionAll(edges.mapInArrow(corrections, PARTS))
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    merged = cut_lineage(parts.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), *[F.sum(c).alias(c) for c in sums]))
    packed = made.where("ends is not null").select("node", "ends_from", "ends")
    digests = packed.repartition("node").sortWithinPartitions("node", "ends_from").mapInArrow(streamed_digests, "node binary, ends_sha256 string")
    over = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("_over"))
    shared = (merged.join(digests, "node", "left").join(over, "parent", "left")
              .select("conv_id", "depth", F.col("_over").alias("parent_conv_id"), *sums, F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256")))
    own = made.where("node is null and task is null").select("parent", *RESULT)
    below = salted_join(own.where("parent is not null"), over, ["parent"]).withColumn("parent_conv_id", F.col("_over"))
    return shared.select(RESULT).unionAll(own.where("parent is null").select(RESULT)).unionAll(below.select(RESULT))


SQL = f"""
with named as (
  select conv_id, turn, length(coalesce(text, '')) as size,
    substring(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, {2 * ID}) as id
  from conversations where conv_id is not null),
own as (select conv_id, id, size, row_number() over (partition by conv_id order by turn nulls first, id, size) - 1 as place from named),
convs as (select distinct conv_id, {checksum_sql('conv_id')} % {TAKEN + 1} as taken from own),
joined as (
  select c.conv_id, 0 as part, o.place, o.id, o.size from convs c join own o on o.conv_id = c.conv_id - c.conv_id % {HUNDRED} and o.place < c.taken
  union all
  select c.conv_id, 1, o.place, o.id, o.size from convs c join own o on o.conv_id = c.conv_id and o.place >= c.taken),
numbered as (select conv_id, id, size, row_number() over (partition by conv_id order by part, place) as depth from joined),
steps as (
  select conv_id, depth, size, sha256(string_agg(id, '') over (partition by conv_id order by depth)) as node from numbered
  union all
  select conv_id, 0, 0, sha256('') from convs),
found as (select node, depth, min(conv_id) as conv_id, count(*) as n_convs, max(size) as size from steps group by node, depth),
placed as (
  select f.*, s.node as parent from found f left join steps s on s.conv_id = f.conv_id and s.depth = f.depth - 1),
kids as (select parent as node, count(*) as n_children from placed where parent is not null group by parent),
counted as (select p.*, coalesce(k.n_children, 0) as n_children from placed p left join kids k using (node)),
below as (
  select a.node, sum((y.n_children = 0)::bigint) as n_leaves, sum((y.n_convs - 1) * y.size) as saved_tokens
  from counted y join steps a on a.conv_id = y.conv_id and a.depth <= y.depth group by a.node),
ended as (
  select node, string_agg(conv_id, ',' order by conv_id) as ids
  from (select conv_id, arg_max(node, depth) as node from steps group by conv_id) group by node)
select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, cast(b.n_leaves as bigint) as n_leaves,
  cast(b.saved_tokens as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from counted c join below b using (node) left join counted p on p.node = c.parent left join ended e on e.node = c.node
"""
