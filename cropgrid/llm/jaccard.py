"""N-gram Jaccard join by parity sketches, and the groups that its links make.

A text's distinct 5-word shingles flip one bit each of a parity sketch; the Hamming distance of two
sketches never exceeds the symmetric difference of the sets, which for a link is (a + b) / 9 at most (Jaccard 0.8).

Candidates: in a band of sizes the shingles are dealt over k words of a sketch so wide that a word has a bit
for every hash; a word is kept as the XOR of the hashes that fell into it. Sets of a and b <= 1.25 a shingles differ in
a / 4 words at most, so among the first floor(a / 4) + 1 words that are not empty at least one is the same in both
(pigeonhole). Each set sends those words, for its own band and, if a partner may be in the next band, for
that one too. Sets with fewer words than this share one more key.

Shingles known to be frequent (from a share of the texts, at most FREQUENT of them) have words of their own, which come
last in the order, so that passages which many texts share seldom bring texts together that have no more in common. This
order only decides how many pairs are looked at: the argument above holds for any order that all sets share.

Groups: sets that share a key are paired with one hub (first inside a slice of a task, then over all), so a key that a
third of all rows share makes a star and not all its pairs. Pairs whose sketches lie too far apart are dropped, the rest is
verified on the sets themselves. Keys whose members are not in one group by then are opened again, and all pairs
between different groups are sketched and verified. So every link is found that joins two groups.

Defined cases: null or empty texts have no set and stand alone. Texts of fewer than five words are one shingle.
Exact copies are one class with one representative. A null doc_id never links; rows of one doc_id are one document
with several texts and share the component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cropgrid.llm import textbytes as tb
from cropgrid.llm.components import components
from cropgrid.session import cut_lineage, kept_table

WORDS = 5
SLICE = 3 << 20
#: Tasks that the partners of one hub are dealt over.
SALTS = 32
#: Members of a family outside its largest group that are compared with all others at a time.
BLOCK = 1024
#: One text in so many is looked at for frequent shingles, those in at least so many of these count, and so many are broadcast (8 bytes each).
SHARE, SEEN, FREQUENT = 32, 3, 1 << 20
#: Bits that ids are dealt over by hash before a shuffle (8 MB in all), and those of one row.
SPOTS, ROW = 1 << 26, 1 << 15


def sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their texts, ordered by text and hash."""
    low = tb.LOWER[data]
    starts, ends, text = tb.words(low, offsets)
    hashes = tb.Rolling(low).of(starts, ends)
    keys, at = tb.grams(hashes, text, WORDS)
    keys, owner = [keys], [text[at]]
    size = np.bincount(text, minlength=len(offsets) - 1)
    for n in range(1, WORDS):
        short, first = tb.grams(hashes, text, n)
        whole = size[text[first]] == n
        keys.append(tb.mix(short[whole] + np.uint64(n)))
        owner.append(text[first][whole])
    keys, owner = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return keys[new], owner[new]


def sketch_bits(n: int) -> int:
    return max(64, 1 << (4 * n - 1).bit_length())


def sketch(keys: np.ndarray) -> bytes:
    """The parity sketch of one set: each hash flips the bit of its low end."""
    bits = sketch_bits(len(keys))
    return np.packbits((np.bincount((keys & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def distance(a: bytes, b: bytes) -> int:
    """Hamming distance of two sketches, the larger one folded to the smaller one's width."""
    a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(a) > len(b):
        a, b = b, a
    folded = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
    return int(np.bitwise_count(a ^ folded).sum())


def bands(size: np.ndarray) -> np.ndarray:
    """Number of the band: up to 8 shingles, up to 16, ..."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64) - 3)


def words_of(keys: np.ndarray, owner: np.ndarray, n: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sketch words that each set sends, and the sets they are of. `frequent` is sorted."""
    out_keys, out_owner = [], []
    size = np.bincount(owner, minlength=n)
    own = bands(size)
    last = np.zeros(len(keys), bool)
    if len(frequent):
        place = np.searchsorted(frequent, keys)
        place[place == len(frequent)] = 0
        last = frequent[place] == keys
    image = tb.mix(keys)
    for step in (0, 1):
        band = own + step
        most = 8 << band
        sends = (size > 3) & ((step == 0) | (5 * size > 4 * (most // 2)))
        take = np.flatnonzero(sends[owner])
        if not len(take):
            continue
        width = most * 2 // 5 + 3
        word = (((keys[take] >> np.uint64(32)) * width[owner[take]].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        word += np.where(last[take], width[owner[take]], 0)
        order = np.lexsort((word, owner[take]))
        take, word = take[order], word[order]
        text = owner[take]
        first = np.ones(len(take), bool)
        first[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(first)
        parity = np.bitwise_xor.reduceat(image[take], at)
        text, word = text[at], word[at]
        rank = np.arange(len(at)) - np.searchsorted(text, np.arange(n))[text]
        need = size // 4 + 1
        label = tb.mix(word.astype(np.uint64) + (band[text].astype(np.uint64) << np.uint64(40)))
        sent = rank < need[text]
        out_keys.append(tb.mix(parity[sent] ^ label[sent]))
        out_owner.append(text[sent])
        few = np.flatnonzero(sends & (np.bincount(text, minlength=n) < need))
        out_keys.append(tb.mix(~band[few].astype(np.uint64)))
        out_owner.append(few)
    if not out_keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_keys) >> np.uint64(16), np.concatenate(out_owner)  # 48 bits pack better and tell enough apart


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of shingles that many of the looked-at texts have. Exact copies count once for each slice."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in tb.slices(batches, "text", SLICE):
            keys, times = np.unique(sets(data, offsets)[0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"shingle": pa.array(keys.view(np.int64)), "times": pa.array(times)})

    looked_at = docs.where(F.pmod(F.xxhash64("text"), F.lit(SHARE)) == 0).select("text")
    counted = looked_at.mapInArrow(each, "shingle long, times long").groupBy("shingle").agg(F.sum("times").alias("times"))
    top = counted.where(F.col("times") >= SEEN).orderBy(F.desc("times"), "shingle").limit(FREQUENT).select("shingle")
    return np.sort(top.toPandas()["shingle"].to_numpy(np.int64).view(np.uint64))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n, h1, h2 and sketch of every text."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.slices(batches, "text", SLICE):
            keys, owner = sets(data, offsets)
            n = len(offsets) - 1
            edge = np.searchsorted(owner, np.arange(n + 1))
            sums = [np.r_[np.uint64(0), np.cumsum(tb.mix(keys ^ np.uint64(salt)), dtype=np.uint64)] for salt in (1, 2)]
            h1, h2 = (s[edge[1:]] - s[edge[:-1]] for s in sums)
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column("doc_id"), "n": pa.array(np.diff(edge)), "h1": pa.array(h1.view(np.int64)),
                "h2": pa.array(h2.view(np.int64)),
                "sketch": pa.array([sketch(keys[a:b]) if b > a else b"" for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})

    return docs.mapInArrow(each, "doc_id long, n long, h1 long, h2 long, sketch binary")


def keys_of(docs: DataFrame, star: bool, frequent) -> DataFrame:
    """(key, doc, hub): the keys of every text. With `star`, of equal keys in a slice one stays and the others become edges to its hub."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.slices(batches, "text", SLICE):
            key, owner = words_of(*sets(data, offsets), len(offsets) - 1, frequent.value)
            doc = rows.column("doc_id").to_numpy()[owner]
            hub, no_hub = np.zeros(len(doc), np.int64), np.ones(len(doc), bool)
            if star and len(key):
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                first = np.ones(len(key), bool)
                first[1:] = key[1:] != key[:-1]
                at = np.flatnonzero(first)
                hub = np.repeat(doc[at], np.diff(np.r_[at, len(key)]))
                edges = np.unique(np.stack([hub[~first & (hub != doc)], doc[~first & (hub != doc)]]), axis=1)
                key = np.r_[key[at], tb.mix(edges[1].astype(np.uint64)) >> np.uint64(16)]
                no_hub = np.r_[np.ones(len(at), bool), np.zeros(edges.shape[1], bool)]
                doc, hub = np.r_[doc[at], edges[1]], np.r_[hub[at], edges[0]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(doc), pa.array(hub, mask=no_hub)], ["key", "doc", "hub"])

    return docs.mapInArrow(each, "key long, doc long, hub long")


def stars(keys: DataFrame) -> DataFrame:
    """Edges (a, b) from every document to the first one with the same key. Rows of a key stream by in order of documents."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_hub = None, None
        for batch in batches:
            made = batch.column("hub").is_valid().to_numpy(zero_copy_only=False)
            key, doc = batch.column("key").to_numpy(), batch.column("doc").to_numpy()
            a, b = [pc.fill_null(batch.column("hub"), 0).to_numpy()[made]], [doc[made]]
            key, doc = key[~made], doc[~made]
            if len(key):
                first = np.ones(len(key), bool)
                first[1:] = key[1:] != key[:-1]
                hub = doc[np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))]
                if last_key is not None and key[0] == last_key:
                    hub[:len(key) if not first[1:].any() else int(np.flatnonzero(first[1:])[0]) + 1] = last_hub
                last_key, last_hub = key[-1], hub[-1]
                a.append(hub[hub != doc])
                b.append(doc[hub != doc])
            pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])

    ordered = keys.repartition("key").sortWithinPartitions("key", F.col("hub").asc_nulls_last(), "doc")
    return ordered.mapInArrow(each, "a long, b long")


@F.pandas_udf(LongType())
def sketch_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([distance(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def represented(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of representatives."""
    side = lambda c: classes.select(F.col("doc_id").alias(c), F.col("rep").alias(f"r{c}"))
    return (pairs.join(side("a"), "a").join(side("b"), "b").where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())


def near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sizes and sketches allow a link."""
    side = lambda c: classes.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")
    return sized.where(9 * sketch_distance("sa", "sb") <= F.col("na") + F.col("nb")).select("a", "b").distinct()


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of 0.8 or more. `texts`: doc_id, text of all that occur in pairs.

    The texts of a hub's partners and the hub's own meet by hub; a hub with many partners is dealt over SALTS tasks.
    """
    salt = F.pmod(F.xxhash64("a"), F.lit(SALTS)).alias("salt")
    wanted = (pairs.select(F.col("b").alias("hub"), salt, F.col("a").alias("doc_id"))
              .unionAll(pairs.select(F.col("b").alias("hub"), salt, F.col("b").alias("doc_id"))).distinct())
    met = (wanted.join(texts, "doc_id").select("hub", "salt", "doc_id", "text")
           .repartition("hub", "salt").sortWithinPartitions("hub", "salt", (F.col("doc_id") != F.col("hub")).alias("is_partner")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs = None, []
        for rows, data, offsets in tb.slices(batches, "text", SLICE):
            keys, owner = sets(data, offsets)
            edge = np.searchsorted(owner, np.arange(len(offsets)))
            found: tuple[list, list] = ([], [])
            for i, (hub, salt, doc) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("hub", "salt", "doc_id")), strict=True)):
                own = keys[edge[i]:edge[i + 1]]
                if at != (hub, salt):
                    at, hubs = (hub, salt), []
                if doc == hub:
                    hubs.append(own.copy())
                    continue
                for other in hubs:
                    shared = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * shared >= 80 * (len(own) + len(other) - shared) > 0:
                        found[0].append(doc)
                        found[1].append(hub)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return met.mapInArrow(each, "a long, b long").distinct()


def maybe_in(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id may be one of `nodes`: all that are, and a few others, so that a join need not shuffle the rest."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(SPOTS))
    at, bit = (spot / ROW).cast("int"), (spot % ROW).cast("int")
    bits = nodes.select(at.alias("at"), bit.cast("long").alias("bit")).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits"))
    found = docs.withColumn("at", at).withColumn("bit", bit).join(F.broadcast(bits), "at")
    return found.where("shiftright(cast(conv(hex(substring(bits, bit div 8 + 1, 1)), 16, 10) as int), bit % 8) % 2 = 1").select(*docs.columns)


class Held:
    """Sets that many others are compared with, as rows of one growing sketch table for each width in use."""

    def __init__(self):
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def add(self, doc: int, group: int, n: int, bits: bytes) -> None:
        table, numbers, used = self.tables.get(len(bits)) or (np.zeros((8, len(bits)), np.uint8), np.zeros((8, 3), np.int64), 0)
        if used == len(table):
            table, numbers = (np.concatenate([x, np.zeros_like(x)]) for x in (table, numbers))
        table[used], numbers[used] = np.frombuffer(bits, np.uint8), (doc, group, n)
        self.tables[len(bits)] = table, numbers, used + 1

    def near(self, group: int, n: int, bits: bytes) -> list[int]:
        """Documents of other groups whose sizes and sketches allow a link."""
        out: list[int] = []
        own = np.frombuffer(bits, np.uint8)
        for width, (table, numbers, used) in self.tables.items():
            size = numbers[:used, 2]
            at = np.flatnonzero((numbers[:used, 1] != group) & (5 * np.minimum(size, n) >= 4 * np.maximum(size, n)))
            if len(at):
                narrow = min(width, len(own))
                theirs = np.bitwise_xor.reduce(table[at].reshape(len(at), -1, narrow), axis=1)
                apart = np.bitwise_count(theirs ^ np.bitwise_xor.reduce(own.reshape(-1, narrow), axis=0)).sum(axis=1, dtype=np.int64)
                out.extend(numbers[at[9 * apart <= n + size[at]], 0].tolist())
        return out


def crossing(families: DataFrame, of: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of one family (a hub and all that share a key with it) but different groups that may still link.

    All members are held against those outside the family's largest group, BLOCK of the latter at a time. Sketches are compared
    inside the task; only pairs near enough come out.
    """
    member = families.select(F.col("a").alias("hub"), F.col("b").alias("doc_id")).unionAll(
        families.select(F.col("a").alias("hub"), F.col("a").alias("doc_id")).distinct()).join(of, "doc_id")
    sizes = member.groupBy("hub", "component").agg(F.count("*").alias("n")).groupBy("hub").agg(
        F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("largest"))
    opened = sizes.where("all > 2 and all > largest.n").select(
        "hub", F.col("largest.component").alias("largest"), F.ceil((F.col("all") - F.col("largest.n")) / BLOCK).alias("blocks"))
    sent = (member.join(opened, "hub").join(classes.select("doc_id", "n", "sketch").dropDuplicates(["doc_id"]), "doc_id")
            .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .select("hub", "block", "doc_id", "component", "n", "sketch",
                    ((F.col("component") != F.col("largest")) & (F.pmod(F.xxhash64("doc_id"), F.col("blocks")) == F.col("block"))).alias("held"))
            .repartition("hub", "block").sortWithinPartitions("hub", "block", F.desc("held"), "doc_id"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, Held()
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for hub, block, doc, group, n, bits, is_held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (hub, block):
                    at, held = (hub, block), Held()
                for other in held.near(group, n, bits):
                    found[0].append(min(doc, other))
                    found[1].append(max(doc, other))
                if is_held:
                    held.add(doc, group, n, bits)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    return sent.mapInArrow(each, "a long, b long").distinct()


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of `docs`."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(own))
    seen = described(own)
    first = seen.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    classes = kept_table(seen.join(first, ["h1", "h2", "n"], "left").select(
        "doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"), "sketch"), "classes")
    known = classes.where("n > 0 and doc_id is not null")
    starred = cut_lineage(represented(stars(keys_of(own.where("doc_id is not null"), True, frequent)), known))
    nodes = cut_lineage(starred.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    tried = cut_lineage(near(starred, known))
    texts = kept_table(maybe_in(own, nodes).join(nodes, "doc_id"), "texts")
    links = cut_lineage(linked(tried, texts))
    made = cut_lineage(components(links))
    of = nodes.join(made, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    families = cut_lineage(stars(keys_of(texts, False, frequent)).distinct())
    again = crossing(families, of, known)
    more = linked(again.join(tried, ["a", "b"], "left_anti"), texts)
    per_id = classes.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    several = per_id.where("rep <> last").select("doc_id", F.col("rep").alias("a"))
    same_id = classes.join(several, "doc_id").select("a", F.col("rep").alias("b"))
    whole = components(links.unionAll(more).unionAll(same_id))
    label = per_id.join(whole, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    return classes.join(label, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
