"""SimHash near-dedup by meet-in-the-middle ball hashing.

A text's fingerprint has a bit set where over half of its shingle hashes have it set. Two fingerprints at most two
bits apart have a common point at most one bit away from either. So every distinct fingerprint is sent to all 65 points
within half the radius (itself and its 64 single flips), and fingerprints that meet in a point are candidates; they are verified
by their own distance. No more than 65 distinct fingerprints can meet in a point, so no point is ever hot: copies share a
fingerprint and are one entry, however many there are.

Groups are the connected components of the links between distinct fingerprints. All that meet in a point are at most two
bits apart from each other, so one star for each point joins what all its pairs would; `links` lists the pairs themselves.

Defined cases: null or empty texts, and texts without a word, have fingerprint zero and link like any other; texts of fewer
words than a shingle are one shingle. A null doc_id has a fingerprint but links with nothing and has no component. Rows of one
doc_id are one document with several texts and share the component. An empty table gives an empty result; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropgrid.llm import textbytes as tb
from cropgrid.llm.components import components
from cropgrid.operators.skew import salted_join
from cropgrid.session import cut_lineage, kept_table

WORDS, BITS, RADIUS = 3, 64, 2
SEED = 42
#: Bytes of texts taken at a time, and shingles whose bits are counted at a time.
SLICE, CHUNK = 1 << 20, 1 << 15


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words in lower case with one space after each, their starts and ends in that, and their texts."""
    low = tb.LOWER[data]
    starts, ends, text = tb.words(low, offsets)
    size = ends - starts
    to = np.cumsum(size + 1) - size - 1
    out = np.full(int(size.sum() + len(size)), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[to + size] = False
    out[inside] = low[~tb.SPACE[low]]
    return out, to, to + size, text


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The fingerprint of each text of a slice."""
    n = len(offsets) - 1
    joined, starts, ends, text = spaced(data, offsets)
    whole = memoryview(joined)
    words = np.bincount(text, minlength=n)
    last = np.cumsum(words) - 1  # the last word of each text
    stop = np.minimum(np.arange(len(text)) + WORDS - 1, last[text])
    rank = np.arange(len(text)) - (last - words + 1)[text]
    at = np.flatnonzero(rank <= np.maximum(words[text] - WORDS, 0))
    owner, begin, end = text[at], starts[at], ends[stop[at]]
    counts, total, digest = np.zeros((n, BITS), np.int64), np.bincount(owner, minlength=n), xxhash.xxh64_intdigest
    for a in range(0, len(at), CHUNK):
        some = slice(a, a + CHUNK)
        hashes = np.fromiter((digest(whole[x:y], SEED) for x, y in zip(begin[some].tolist(), end[some].tolist(), strict=True)),
                             np.uint64, len(begin[some]))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.r_[True, owner[some][1:] != owner[some][:-1]])
        counts[owner[some][first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > total[:, None], axis=1, bitorder="little").view("<u8").ravel()


def described(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed long of every row."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(fingerprints(data, offsets).view(np.int64))], ["doc_id", "print"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(each, "doc_id long, print long")


def met(prints: DataFrame, every_pair: bool) -> DataFrame:
    """Verified links (a, b), a < b, of the distinct fingerprints in `print`; not `every_pair`: one star for each point."""
    point = F.expr(f"explode(concat(array(print), transform(sequence(0, {BITS - 1}), i -> print ^ shiftleft(1L, i))))")
    sent = prints.select(point.alias("point"), "print").repartition("point").sortWithinPartitions("point", "print")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)  # the last point's rows so far, 65 at most
        for batch in batches:
            where, own = (np.r_[h, c.to_numpy()] for h, c in zip(held, batch.columns, strict=True))
            first = np.r_[True, where[1:] != where[:-1]]
            rank = np.arange(len(where)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            fresh = np.arange(len(where)) >= held.shape[1]
            a, b = [], []
            for back in range(1, int(rank.max(initial=0)) + 1):
                late = np.flatnonzero(fresh & ((rank >= back) if every_pair else (rank == back)))
                a.append(own[late - back])
                b.append(own[late])
            pair = np.stack([np.concatenate(a), np.concatenate(b)]) if a else np.zeros((2, 0), np.int64)
            pair = pair[:, np.bitwise_count((pair[0] ^ pair[1]).view(np.uint64)) <= RADIUS]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pair], ["a", "b"])
            begin = int(np.flatnonzero(first)[-1]) if len(first) else 0
            held = np.stack([where[begin:], own[begin:]])

    return sent.mapInArrow(each, "a long, b long").distinct()


def links(docs: DataFrame) -> DataFrame:
    """All links between different fingerprints of `docs`, as pairs (a, b), a < b; members of a fingerprint are in `described`."""
    return met(described(docs).where("doc_id is not null").select("print").distinct(), every_pair=True)


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable by links) of every row of `docs`."""
    seen = kept_table(described(docs), "prints")
    known = seen.where("doc_id is not null")
    classes = known.groupBy("print").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    several = known.groupBy("doc_id").agg(F.min("print").alias("a"), F.max("print").alias("z")).where("a <> z")
    same_id = known.join(several, "doc_id").select("a", F.col("print").alias("b")).where("a <> b").distinct()
    made = cut_lineage(components(met(classes.select("print"), every_pair=False).unionAll(same_id)))
    of = classes.join(made, F.col("print") == F.col("node"), "left").select("print", "rep", F.coalesce("component", "print").alias("component"))
    least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = of.join(least, "component").select("print", "component_id")
    shown = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    linked = salted_join(known, label, ["print"]).select("doc_id", shown, "component_id")
    return linked.unionAll(seen.where("doc_id is null").select("doc_id", shown, F.lit(None).cast("long")))
