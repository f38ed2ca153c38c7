"""Substring dedup on words: passages that an earlier document has, found by fixed-block anchors.

Every document's words are cut into blocks of BLOCK words that do not overlap; these are the index. A window of WINDOW =
2 * BLOCK - 1 words holds at least one whole block of its document, wherever that begins. So the blocks are probed with the hash
of every run of BLOCK words of every document, and each hit is extended: all windows around it are hashed in full, and a window
that a document with a smaller id has too is a repeat. Overlapping repeats join to maximal ones.

Hashes meet by bucket (see exchange). In a slice of a task, copies of a hash in several documents are told at once and only the
first and last one travel, so passages that very many documents share cost a few entries a slice.

Defined cases: null or empty texts have no words. Texts of fewer than WINDOW words keep all. A null doc_id has no order: such rows
keep all words and take none from others. Rows of one doc_id never take words from each other. Repeats inside one document stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropgrid.llm import exchange as ex
from cropgrid.llm import textbytes as tb

BLOCK = 7
WINDOW = 2 * BLOCK - 1
SLICE = 4 << 20


def worded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, texts and hashes of the words."""
    starts, ends, text = tb.words(data, offsets)
    return starts, ends, text, tb.Rolling(data).of(starts, ends)


def shorten(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (the highest bits) and the next 32 bits."""
    return (keys >> np.uint64(64 - bits)).astype(np.int64), ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def ends_of(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key and document; in that order, which entries are of the first and of the last document with their key."""
    order = np.lexsort((doc, key))
    doc, key = doc[order], key[order]
    start = np.r_[True, key[1:] != key[:-1]]
    at = np.flatnonzero(start)
    size = np.diff(np.r_[at, len(key)])
    return order, doc == np.repeat(doc[at], size), doc == np.repeat(doc[at + size - 1], size)


def anchors(docs: DataFrame, bits: int) -> DataFrame:
    """Index blocks and probes by bucket. Rows of bucket -1 are hits told already inside a slice."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.slices(batches, "text", SLICE):
            _, _, text, hashes = worded(data, offsets)
            key, at = tb.grams(hashes, text, BLOCK)
            if not len(key):
                continue
            doc = rows.column("doc_id").to_numpy()[text[at]]
            block = (at - np.searchsorted(text, text[at])) % BLOCK == 0
            order, first, last = ends_of(doc, key)
            key, doc, block = key[order], doc[order], block[order]
            known = ~(first & last)
            bucket, prints = shorten(key, bits)
            probe = first | last
            # of the blocks of one key the first document's is enough; others are known by now
            where, size = np.unique(key[block], return_index=True)[1], np.flatnonzero(block)
            index = size[where]
            yield ex.batch_of(ex.packed(
                np.r_[bucket[probe], bucket[index]], np.r_[doc[probe], doc[index]], np.r_[prints[probe], prints[index]],
                np.r_[np.zeros(int(probe.sum()), bool), np.ones(len(index), bool)]))
            if known.any():
                yield ex.batch_of(ex.packed(-1 - bucket[known], doc[known], prints[known], np.zeros(int(known.sum()), bool)))

    return docs.mapInArrow(each, ex.SCHEMA)


class Index:
    """The blocks of one bucket: hashes, the first document of each, and the last one that probed it."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        doc, prints = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
        order = np.lexsort((doc, prints))
        self.doc, self.prints = doc[order], prints[order]
        self.at = np.flatnonzero(np.r_[True, self.prints[1:] != self.prints[:-1]]) if len(doc) else np.zeros(0, np.int64)
        self.keys, self.first = self.prints[self.at], self.doc[self.at]
        self.last = np.full(len(self.at), np.iinfo(np.int64).min)

    def probe(self, doc: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Which entries hit a block of a smaller document."""
        if not len(self.keys):
            return np.zeros(len(doc), bool)
        place = np.searchsorted(self.keys, prints)
        place[place == len(self.keys)] = 0
        hit = self.keys[place] == prints
        np.maximum.at(self.last, place[hit], doc[hit])
        return hit & (doc > self.first[place])

    def probed(self) -> tuple[np.ndarray, np.ndarray]:
        """Blocks that a larger document probed."""
        hit = self.doc < np.repeat(self.last, np.diff(np.r_[self.at, len(self.doc)]))
        return self.doc[hit], self.prints[hit]


def hits(rows: DataFrame) -> DataFrame:
    """doc_id and marks: the bucket, then the hashes in it of the runs of BLOCK words that an index block matches, on both sides."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, index = None, [], None

        def mark(bucket: int, doc: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            return ex.per_doc(doc, prints, np.array([bucket], np.uint32).tobytes())

        for bucket, indexed, docs, counts, prints in ex.streamed(batches):
            if bucket < 0:
                yield mark(-1 - bucket, *ex.unpacked(docs, counts, prints, np.uint32))
                continue
            if at != bucket:
                if index is not None:
                    yield mark(at, *index.probed())
                at, parts, index = bucket, [], None
            entries = ex.unpacked(docs, counts, prints, np.uint32)
            if indexed:
                parts.append(entries)
                continue
            index = index or Index(parts)
            hit = index.probe(*entries)
            yield mark(bucket, entries[0][hit], entries[1][hit])
        if index is not None:
            yield mark(at, *index.probed())

    return ex.ordered(rows).mapInArrow(each, "doc_id long, marks binary")


def windows(texts: DataFrame, bits: int) -> DataFrame:
    """Hashes of the whole windows around the hits, by bucket. Of a slice's copies the first travels, later ones (bucket -1) are told."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.slices(batches, "text", SLICE):
            _, _, text, hashes = worded(data, offsets)
            key, at = tb.grams(hashes, text, BLOCK)
            bucket, prints = shorten(key, bits)
            told = (bucket.astype(np.uint64) << np.uint64(32)) | prints.astype(np.uint64)
            near = np.zeros(len(hashes), bool)
            edge = np.searchsorted(text[at], np.arange(len(offsets)))
            for i, marks in enumerate(rows.column("marks").to_pylist()):
                parts = [np.frombuffer(m, np.uint32).astype(np.uint64) for m in marks or ()]
                marks = np.concatenate([(m[0] << np.uint64(32)) | m[1:] for m in parts]) if parts else np.zeros(0, np.uint64)
                own = slice(edge[i], edge[i + 1])
                near[at[own][np.isin(told[own], marks)]] = True
            full, start = tb.grams(hashes, text, WINDOW)
            count = np.r_[0, np.cumsum(near)]
            held = count[start + BLOCK] > count[start]  # a hit begins in the first BLOCK words of the window
            full, doc = full[held], rows.column("doc_id").to_numpy()[text[start[held]]]
            if not len(full):
                continue
            order, first, _ = ends_of(doc, full)
            full, doc = full[order], doc[order]
            lead = np.unique(full, return_index=True)[1]
            bucket = (full >> np.uint64(64 - bits)).astype(np.int64)
            yield ex.batch_of(ex.packed(bucket[lead], doc[lead], full[lead], np.zeros(len(lead), bool)))
            if not first.all():
                yield ex.batch_of(ex.packed(-1 - bucket[~first], doc[~first], full[~first], np.zeros(int((~first).sum()), bool)))

    return texts.mapInArrow(each, ex.SCHEMA)


def repeats(rows: DataFrame) -> DataFrame:
    """doc_id and marks: hashes of the windows that a document with a smaller id has too."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def told() -> pa.RecordBatch:
            doc, full = (np.concatenate(x) for x in zip(*parts, strict=True))
            order, first, _ = ends_of(doc, full)
            return ex.per_doc(doc[order][~first], full[order][~first])

        for bucket, _, docs, counts, prints in ex.streamed(batches):
            if bucket < 0:
                yield ex.per_doc(*ex.unpacked(docs, counts, prints, np.uint64))
                continue
            if at != bucket:
                if parts:
                    yield told()
                at, parts = bucket, []
            parts.append(ex.unpacked(docs, counts, prints, np.uint64))
        if parts:
            yield told()

    return ex.ordered(rows).mapInArrow(each, "doc_id long, marks binary")


def cut(texts: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans and kept_sha256 of every row, given the hashes of its repeated windows."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tb.slices(batches, "text", SLICE):
            marks = ex.joined_marks(rows.column("marks"), np.uint64)
            if any(len(m) for m in marks):
                starts, ends, text, hashes = worded(data, offsets)
                full, at = tb.grams(hashes, text, WINDOW)
                edge = np.searchsorted(text[at], np.arange(len(offsets)))
                hit = [at[edge[i]:edge[i + 1]][np.isin(full[edge[i]:edge[i + 1]], m)] for i, m in enumerate(marks) if len(m)]
                gone = tb.covered(np.concatenate(hit), WINDOW, len(starts))
            else:
                starts, ends, text = tb.words(data, offsets)
                gone = np.zeros(len(starts), bool)
            edge, raw = np.searchsorted(text, np.arange(len(offsets))), data.tobytes()
            begins = gone & ~(np.r_[False, gone[:-1]] & np.r_[False, text[1:] == text[:-1]]) if len(gone) else gone
            out = {c: [] for c in ("n_words", "n_removed", "n_spans", "kept_sha256")}
            for i in range(len(offsets) - 1):
                own = slice(edge[i], edge[i + 1])
                kept = np.flatnonzero(~gone[own]) + edge[i]
                out["n_words"].append(int(edge[i + 1] - edge[i]))
                out["n_removed"].append(int(gone[own].sum()))
                out["n_spans"].append(int(begins[own].sum()))
                out["kept_sha256"].append(hashlib.sha256(
                    b" ".join([raw[a:b] for a, b in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)])).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), **out})

    return texts.mapInArrow(each, "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans (maximal removed runs) and kept_sha256 of every row.

    The texts are shuffled once: both joins read one exchange, as `known` is the same plan with the same partitioning in both.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known, lone = own.where("doc_id is not null"), own.where("doc_id is null")
    bits = ex.bucket_count(own).bit_length() - 1
    found = ex.gathered(hits(anchors(known, bits)))
    again = ex.gathered(repeats(windows(known.join(found, "doc_id"), bits)))
    return cut(known.join(again, "doc_id", "left")).unionAll(cut(lone.withColumn("marks", F.lit(None).cast("array<binary>"))))
