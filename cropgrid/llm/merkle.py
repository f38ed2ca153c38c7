"""Merkle manifest of a dataset: a tree of digests for each source, a tree over the sources, and a proof for every row.

Leaves are ranked in their source without gathering it. Each aligned block of FAN ^ DEPTH consecutive nodes is one row that
keeps a level of the tree as one string of hex digests, one after the other. A parent is the hash of a fixed-width substring of
the level below; a node's siblings are the two substrings that flank it in the same run. The tops of a source's blocks are the
nodes of the next tier, which is cut into blocks again, until every source has one node; the subroots of all sources are
then the nodes of one more tree, built the same way. Proofs come down again: a block's own path is appended to each of its
nodes' paths, block by block, so no task holds more than a block and a few strings for each of its nodes.

Only SQL functions are used. Texts are read once, for the digests, and never shuffled.

Defined cases: a null field is hashed as `-`; a null source is a source of its own and the first of all. Rows of equal id stand
in the order of their leaves, so repeated rows are interchangeable. A null doc_id stands first and is never tampered with. An empty
table has no root and gives no rows. Columns that are not hashed may have any name; they are not carried.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropgrid.operators.ranking import ranked
from cropgrid.session import kept_table

FAN, DEPTH, HEX = 16, 3, 64
BLOCK = FAN ** DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: What a node's path is: for each level the siblings before and after it, from the leaf's run to the root's.
PATH = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value with its length in bytes, or `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: dict[str, Column]) -> Column:
    return digest(*[framed(value) for value in fields.values()])


def levels() -> list[Column]:
    """The block's levels above `l0`, one string each."""
    def above(j: int) -> Column:
        runs = f"cast(ceil(length(l{j - 1}) / {FAN * HEX}) as int)"
        return F.expr(f"array_join(transform(sequence(0, {runs} - 1), i -> sha2(substring(l{j - 1}, i * {FAN * HEX} + 1, {FAN * HEX}), 256)), '')")
    return [above(j) for j in range(1, DEPTH + 1)]


def blocks_of(nodes: DataFrame) -> DataFrame:
    """One row for each block of `nodes` (tree, position, digest, carried): its levels, its height and its top.

    A block that is alone in its tree ends at its first single node; blocks with neighbours all have DEPTH levels.
    """
    filled = nodes.groupBy("tree", F.floor(F.col("position") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("position", "digest", "carried"))).alias("items"))
    held = filled.withColumn("l0", F.expr("array_join(transform(items, x -> x.digest), '')"))
    for j, level in enumerate(levels(), 1):
        held = held.withColumn(f"l{j}", level)
    several = filled.groupBy("tree").agg(F.max("block").alias("last")).where("last > 0")
    alone = F.expr(f"cast(filter(sequence(0, {DEPTH}), j -> length(element_at(array({', '.join(f'l{j}' for j in range(DEPTH + 1))}), j + 1)) = {HEX})[0] as int)")
    tall = held.join(several, "tree", "left").withColumn("many", F.col("last").isNotNull()).drop("last")
    tall = tall.withColumn("height", F.when(F.col("many"), DEPTH).otherwise(alone))
    return tall.withColumn("top", F.expr(f"element_at(array({', '.join(f'l{j}' for j in range(DEPTH + 1))}), height + 1)"))


def tiers_of(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Block tables of a forest, each kept in the shared folder; the tops of one are the nodes of the next."""
    tiers = []
    while True:
        tiers.append(kept_table(blocks_of(nodes), f"{name}-{len(tiers)}"))
        tops = tiers[-1].where("many")
        if not tops.limit(1).count():
            return tiers
        nodes = tops.select("tree", F.col("block").alias("position"), F.col("top").alias("digest"), F.lit(None).cast("string").alias("carried"))


def tops_of(tiers: list[DataFrame]) -> DataFrame:
    """tree and the digest of its only node."""
    return reduce(DataFrame.unionAll, [t.where("not many").select("tree", "top") for t in tiers])


def flanks(level: str, at: str) -> str:
    """SQL for the siblings of the node with place `at` of a level, in its run."""
    run = f"cast(floor({at} / {FAN}) as int)"
    return (f"named_struct('before', substring({level}, {run} * {FAN * HEX} + 1, ({at} - {run} * {FAN}) * {HEX}),"
            f" 'after', substring({level}, ({at} + 1) * {HEX} + 1, (({run} + 1) * {FAN} - {at} - 1) * {HEX}))")


def opened(tier: DataFrame) -> DataFrame:
    """The nodes of a tier's blocks: `_item`, and `path` inside the block. A place in a long string is found by reading
    up to it, so levels are cut for each run of nodes, and only the run's own string for each node."""
    run = f"struct(substring(l0, r * {FAN * HEX} + 1, {FAN * HEX}) as nodes, slice(items, r * {FAN} + 1, {FAN}) as items)"
    runs = tier.select("*", F.posexplode(F.expr(f"transform(sequence(0, cast(ceil(size(items) / {FAN}) as int) - 1), r -> {run})")).alias("_run", "_in"))
    upper = [flanks(f"l{j}", f"cast(floor(_run / {FAN ** (j - 1)}) as int)") for j in range(1, DEPTH)]
    path = F.expr(f"slice(array({', '.join(upper)}), 1, greatest(height - 1, 0))") if upper else F.array().cast(PATH)
    kept = [c for c in runs.columns if c not in ("items", "_run", *(f"l{j}" for j in range(DEPTH + 1)))]
    nodes = runs.withColumn("_above", path).select(*kept, "_above", F.posexplode("_in.items").alias("_at", "_item"))
    return nodes.withColumn("path", F.expr(f"concat(slice(array({flanks('_in.nodes', '_at')}), 1, least(height, 1)), _above)"))


def paths(tiers: list[DataFrame], finished: DataFrame, carried: list[str]) -> DataFrame:
    """tree, position, digest, carried and path of every node of the first tier.

    `finished`: tree, path and the columns `carried` of every tree's only node.
    """
    below = None
    for tier in reversed(tiers):
        above = tier.where("not many").select("tree", "block").join(finished, "tree").select("tree", "block", F.col("path").alias("_up"), *carried)
        if below is not None:
            above = above.unionAll(below.select("tree", F.col("position").alias("block"), F.col("path").alias("_up"), *carried))
        below = opened(tier.join(above, ["tree", "block"])).select(
            "tree", "_item.position", "_item.digest", "_item.carried", *carried, F.concat("path", "_up").alias("path"))
    return below


def proofs(leaves: DataFrame) -> DataFrame:
    """`leaves` (tree, position, digest, carried) with subroot, root and path. Trees are ordered by their names."""
    sources = tiers_of(leaves, "sources")
    roots = ranked(tops_of(sources), [], ["tree"]).select(
        F.lit("").alias("tree"), "position", F.col("top").alias("digest"), F.col("tree").alias("carried"))
    whole = tiers_of(roots, "roots")
    root = tops_of(whole).select("tree", F.col("top").alias("root"), F.array().cast(PATH).alias("path"))
    over = paths(whole, root, ["root"]).select(F.col("carried").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    return paths(sources, over, ["subroot", "root"])


def siblings(path: str) -> Column:
    """All siblings of a path in one string, level by level and left to right."""
    return F.expr(f"array_join(transform({path}, s -> concat(s.before, s.after)), '')")


def folded(start: str, path: str) -> Column:
    """The root that a leaf and its path give."""
    return F.expr(f"aggregate({path}, {start}, (node, s) -> sha2(concat(s.before, node, s.after), 256))")


def manifest(docs: DataFrame, tampered: Column | None = None, text: Column | None = None) -> DataFrame:
    """doc_id, position, leaf, changed, subroot, root and path of every row of `docs`.

    Where `tampered` holds, `changed` is the leaf of the row with `text` in place of its own; else it is `leaf`.
    """
    fields = {c: F.col(c) for c in FIELDS}
    leaf = leaf_of(fields)
    changed = F.when(tampered, leaf_of(fields | {"text": text})).otherwise(leaf) if tampered is not None else leaf
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))  # the null source sorts first
    narrow = docs.select(tree.alias("tree"), F.col("doc_id"), leaf.alias("digest"), changed.alias("changed"))
    placed = ranked(kept_table(narrow, "leaves"), ["tree"], ["doc_id", "digest", "changed"])
    leaves = placed.select("tree", "position", "digest", F.struct("doc_id", "changed").alias("carried"))
    return proofs(leaves).select("carried.doc_id", "position", F.col("digest").alias("leaf"), "carried.changed", "subroot", "root", "path")


def checked(docs: DataFrame) -> DataFrame:
    """The manifest with proofs folded after tampering: where 5 divides the checksum of doc_id, A-Z of the text are lower-cased."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = manifest(docs, F.coalesce(checksum % 5 == 0, F.lit(False)), lower).withColumn("folded_root", folded("changed", "path"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings("path"), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


def checksum_sql(value: str) -> str:
    """The unsigned CRC-32 of a number's decimal digits."""
    return f"""xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(cast({value} as varchar), ''), lambda ch: ascii(ch)::bigint)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, z: xor(c >> 1, 3988292384::bigint * (c & 1)))), 4294967295::bigint)"""


def framed_sql(value: str) -> str:
    return f"coalesce(strlen(cast({value} as varchar)) || ':' || {value}, '-')"


LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
with recursive given as (
  select doc_id, coalesce('s' || source, '-') as tree, {' || '.join(map(framed_sql, FIELDS[:-1]))} as head, text,
    coalesce({checksum_sql('doc_id')} % 5 = 0, false) as tampered
  from documents),
hashed as (
  select doc_id, tree, sha256(head || {framed_sql('text')}) as leaf,
    sha256(head || case when tampered then {framed_sql(LOWER_SQL)} else {framed_sql('text')} end) as changed from given),
leaves as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf, changed) - 1 as place from hashed),
climb(tree, level, place, node) as (
  select tree, 0, place, leaf from leaves
  union all
  select tree, level + 1, place // {FAN}, sha256(string_agg(node, '' order by place))
  from (select *, max(place) over (partition by tree) as last from climb) where last > 0 group by tree, level, place // {FAN}),
tops as (
  select tree, max(level) as height from climb group by tree),
subroots as (
  select tree, node, row_number() over (order by tree) - 1 as place from climb join tops using (tree) where level = height),
upper_climb(level, place, node) as (
  select 0, place, node from subroots
  union all
  select level + 1, place // {FAN}, sha256(string_agg(node, '' order by place))
  from (select *, max(place) over () as last from upper_climb) where last > 0 group by level, place // {FAN}),
root as (
  select node from upper_climb order by level desc limit 1),
steps as (
  select l.tree, l.place as leaf_place, c.level, false as is_upper,
    coalesce(string_agg(c.node, '' order by c.place) filter (c.place < l.place // power({FAN}, c.level)::bigint), '') as before,
    coalesce(string_agg(c.node, '' order by c.place) filter (c.place > l.place // power({FAN}, c.level)::bigint), '') as after
  from leaves l join tops t using (tree) join climb c on c.tree = l.tree and c.level < t.height
    and c.place // {FAN} = l.place // power({FAN}, c.level + 1)::bigint
  group by all
  union all
  select l.tree, l.place, u.level, true,
    coalesce(string_agg(u.node, '' order by u.place) filter (u.place < s.place // power({FAN}, u.level)::bigint), ''),
    coalesce(string_agg(u.node, '' order by u.place) filter (u.place > s.place // power({FAN}, u.level)::bigint), '')
  from leaves l join subroots s using (tree) join upper_climb u
    on u.place // {FAN} = s.place // power({FAN}, u.level + 1)::bigint and u.level < (select max(level) from upper_climb)
  group by all),
proof as (
  select tree, leaf_place as place, list(struct_pack(b := before, a := after) order by is_upper, level) as path from steps group by all),
fold(tree, place, step, node) as (
  select tree, place, 0, changed from leaves
  union all
  select f.tree, f.place, f.step + 1, sha256(p.path[f.step + 1].b || f.node || p.path[f.step + 1].a)
  from fold f join proof p on p.tree = f.tree and p.place = f.place where f.step < len(p.path))
select l.doc_id, l.leaf, s.node as subroot, r.node as root,
  sha256(coalesce(list_aggregate(list_transform(p.path, lambda x: x.b || x.a), 'string_agg', ''), '')) as proof_sha256,
  f.node as folded_root, f.node = r.node as verified
from leaves l join subroots s using (tree) cross join root r left join proof p on p.tree = l.tree and p.place = l.place
  join fold f on f.tree = l.tree and f.place = l.place and f.step = coalesce(len(p.path), 0)
"""
